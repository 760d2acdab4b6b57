"""Fill-in-the-middle transformation of whole texts.

A text is a list of units, runs of ASCII letters and single other characters.
Two draws from the digest of the document's id cut the list into prefix, middle
and suffix; two more choose the form (plain, or marked parts in one of two
orders).  The work on texts is a pipeline of Arrow arrays per batch: units as
list arrays, flattened with the index of their text, numbered within it, filtered
by role, rebuilt into lists and joined again.  No text is looped over.

`fill_middle` gives a struct per row; `restored` rebuilds the exact text from an
output and its form, with Spark's own expressions.

Special cases: null and empty texts have no unit, are plain and give an empty
output; a text that holds a marker is plain, so that outputs stay reversible; a
null id is drawn as an empty one; rows of one id and one text come out alike; texts
of any length are cut whole; extra columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

FORMS = "struct<n: bigint, form: string, output: string, prefix_chars: bigint, middle_chars: bigint>"
_FORMS_TYPE = pa.struct([("n", pa.int64()), ("form", pa.string()), ("output", pa.string()),
                         ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])
#: Bytes of text taken through the arrays at a time (a longer text goes alone).
BATCH_BYTES = 2 << 20
_ROLES = 3


@dataclass(frozen=True)
class Plan:
    """Markers of the three parts and the shares, of a hundred, of the forms."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    #: Texts left plain, and of the others those with the suffix first.
    plain_percent: int = 10
    spm_percent: int = 20
    seed: int = 1

    @property
    def markers(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(doc_id: Column, seed: int = 1) -> Column:
    """Four 32-bit draws of an id, from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def _bytes_of(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins (one more entry for the end)."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def units(texts: pa.StringArray) -> pa.ListArray:
    """The units of each text: runs of ASCII letters, and other characters one by one."""
    raw, ends = _bytes_of(texts)
    low = raw | 0x20
    letter = (low >= ord("a")) & (low <= ord("z")) & (raw < 0x80)
    begins = (raw & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    # a text begins a unit even if the one before it ends with a letter
    begins[ends[:-1][ends[:-1] < len(raw)]] = True
    starts = np.append(np.flatnonzero(begins), len(raw))
    flat = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(raw))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, ends).astype(np.int32)), flat)


def _part(flat: pa.Array, parent: np.ndarray, chosen: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray]:
    """The chosen units of each of n texts joined, and the number of their characters."""
    kept = flat.filter(pa.array(chosen))
    offsets = np.concatenate(([0], np.cumsum(np.bincount(parent[chosen], minlength=n)))).astype(np.int32)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), kept), "")
    return joined, pc.utf8_length(joined).cast(pa.int64())


def transform(texts: pa.StringArray, draw: np.ndarray, plan: Plan) -> pa.StructArray:
    """One batch: texts (no nulls) and an array of four draws per text."""
    n = len(texts)
    listed = units(texts)
    flat, parent = listed.flatten(), pc.list_parent_indices(listed).to_numpy()
    sizes = listed.value_lengths().to_numpy().astype(np.int64)
    ordinal = np.arange(len(flat)) - listed.offsets.to_numpy()[:-1][parent]
    ends = np.sort(draw[:, :2] % (sizes + 1)[:, None], axis=1)
    role = (ordinal >= ends[parent, 0]).astype(np.int8) + (ordinal >= ends[parent, 1])
    (prefix, prefix_chars), (middle, middle_chars), (suffix, _) = [
        _part(flat, parent, role == r, n) for r in range(_ROLES)]

    marked = pa.array(np.zeros(n, bool))
    for marker in plan.markers:
        marked = pc.or_(marked, pc.match_substring(texts, marker))
    plain = pc.or_(marked, pa.array((sizes == 0) | (draw[:, 2] % 100 >= 100 - plan.plain_percent)))
    spm = pa.array(draw[:, 3] % 100 < plan.spm_percent)
    p, s, m = (pc.binary_join_element_wise(marker, part, "") for marker, part in
               zip(plan.markers, (prefix, suffix, middle), strict=True))
    changed = pc.if_else(spm, pc.binary_join_element_wise(s, p, m, ""), pc.binary_join_element_wise(p, s, m, ""))
    none = pa.scalar(None, pa.int64())
    return pa.StructArray.from_arrays(
        [pa.array(sizes), pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")), pc.if_else(plain, texts, changed),
         pc.if_else(plain, none, prefix_chars), pc.if_else(plain, none, middle_chars)],
        names=["n", "form", "output", "prefix_chars", "middle_chars"])


def _slices(texts: pa.StringArray, most: int) -> Iterator[tuple[int, int]]:
    """(begin, length) of runs of texts of up to so many bytes, a longer text alone."""
    _, ends = _bytes_of(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield at, to - at
        at = to


def fill_middle(text: Column, doc_id: Column, plan: Plan = Plan(), batch_bytes: int = BATCH_BYTES) -> Column:
    """Struct of n (units), form, output, prefix_chars and middle_chars (null if plain)."""

    @F.arrow_udf(FORMS)
    def of(values: pa.Array, drawn: pa.Array) -> pa.Array:
        texts = pc.fill_null(values, "").cast(pa.string())
        draw = drawn.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 4)
        parts = [transform(texts.slice(at, size), draw[at:at + size], plan) for at, size in _slices(texts, batch_bytes)]
        return pa.concat_arrays(parts) if parts else pa.array([], _FORMS_TYPE)

    return of(text, draws(doc_id, plan.seed))


def restored(output: Column, form: Column, plan: Plan = Plan()) -> Column:
    """The exact text an output was made of.

    No marker occurs in the text, and none can arise where a marker meets the
    text beside it as long as its first character occurs in it only there.
    """
    pattern = "|".join("\\Q" + m + "\\E" for m in plan.markers)
    parts = F.split(output, pattern, 4)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
