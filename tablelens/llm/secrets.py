"""Secret scan with multipart credential linking.

Some parts of a credential speak for themselves: a value assigned to a secret's
name, a well-known access key, a long run of hex digits.  Others are weak: a bare
token of mixed letters and digits, a user or key name, an address.  Weak parts
count only together.  A text is cut into scopes (stretches of lines without an
empty line); every part is an interval, and an interval join puts it into the
scope that holds its beginning.  A weak part is reported where its scope also
holds the parts that complete it:

* a named user, client or account beside an assigned secret or a hex run, or
  beside an address and a bare token together;
* an address beside an assigned secret, or beside an identifier of either kind
  together with a hex run or a bare token;
* a bare token beside an access key, or beside a named user and an address.

Parts are found by one regular expression a kind.  The join runs over all texts of
a batch at once, on sorted begins of scopes and parts; nothing is compared in pairs
and no text leaves its task.  Every text is scanned whole.

Special cases: null and empty texts have no span; a scope of any length is one
scope; weak parts that overlap a strong span belong to it and are not reported;
texts of several megabytes are scanned like others; repeated rows are scanned
each; extra columns do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The strong kinds, in the order in which spans of one beginning are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
# The weak kinds, listed after the strong ones.
IDENTIFIER = (r"""(?<![A-Za-z0-9])(?:user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?)["']?"""
              r"""\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,128}""")
ENDPOINT = r"""(?:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqps?|jdbc:[a-z]+)://[^\x20\x09-\x0D"'<>]+"""
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,256}={0,2}(?![A-Za-z0-9+/_=-])"
KINDS = ["assign", "access", "hex", "identifier", "endpoint", "key"]
_EMPTY_LINE = r"\n[\x20\x09\x0B-\x0D]*(?:\n[\x20\x09\x0B-\x0D]*)*\n"
_STRONG_KINDS = 3

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_access = re.compile(ACCESS)
_hex = re.compile(HEX)
_identifier = re.compile(IDENTIFIER, re.IGNORECASE | re.ASCII)
_endpoint = re.compile(ENDPOINT, re.IGNORECASE | re.ASCII)
_token = re.compile(TOKEN)
_empty_line = re.compile(_EMPTY_LINE)
# Cheap tests: every match holds one of these, in lower case.
_ASSIGN_HINTS = ("passw", "secret", "token", "key")
_IDENTIFIER_HINTS = ("user", "login", "account", "client", "access")

SPANS = "array<struct<kind: string, start: bigint, stop: bigint>>"
#: Characters taken through the join at a time (a longer text goes alone).
BATCH_CHARS = 4 << 20


def strong_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of the spans that count by themselves, in code points."""
    # a hex run or an access key of the length asked for begins at the same place with or without the bound
    found = [(m.start(), 1, m.end()) for m in _access.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    low = text.lower()
    if any(hint in low for hint in _ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found.sort()
    return found


def _mixed(value: str) -> bool:
    """Letters of both cases and digits: what a random key has and a word or path rarely."""
    return any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)


def weak_parts(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of the parts that count only beside others."""
    low = text.lower()
    named = any(hint in low for hint in _IDENTIFIER_HINTS)
    found = [(m.start(), 3, m.end()) for m in _identifier.finditer(text)] if named else []
    found += [(m.start(), 4, m.end()) for m in _endpoint.finditer(text)] if "://" in text else []
    found += [(m.start(), 5, m.end()) for m in _token.finditer(text) if _mixed(m.group())]
    found.sort()
    return found


def scope_begins(text: str) -> list[int]:
    """Where each scope begins; the first at 0."""
    return [0, *(m.end() for m in _empty_line.finditer(text))] if "\n" in text else [0]


def _overlapped(start: np.ndarray, stop: np.ndarray, by_start: np.ndarray, by_stop: np.ndarray) -> np.ndarray:
    """Which intervals meet one of the others, which come sorted by their start."""
    if not len(by_start):
        return np.zeros(len(start), bool)
    reach = np.maximum.accumulate(by_stop)
    before = np.searchsorted(by_start, stop) - 1
    return (before >= 0) & (reach[np.maximum(before, 0)] > start)


def linked(texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """All spans (start, kind, stop) of each text: the strong ones, and weak ones whose scope completes them."""
    strong = [strong_spans(t) for t in texts]
    # a weak part needs another part beside it, so texts with a single part are done
    weak = [weak_parts(t) for t in texts]
    chosen = [i for i in range(len(texts)) if weak[i] and len(strong[i]) + len(weak[i]) > 1]
    if not chosen:
        return strong
    # one line of positions for the whole batch, text after text
    shift = np.concatenate(([0], np.cumsum([len(texts[i]) + 1 for i in chosen])))
    begins = np.concatenate([np.array(scope_begins(texts[i]), np.int64) + shift[k] for k, i in enumerate(chosen)])
    parts = np.array([(k, s, kind, e) for k, i in enumerate(chosen) for s, kind, e in strong[i] + weak[i]], np.int64)
    start, stop, kind = parts[:, 1] + shift[parts[:, 0]], parts[:, 3] + shift[parts[:, 0]], parts[:, 2]
    scope = np.searchsorted(begins, start, side="right") - 1
    is_strong = kind < _STRONG_KINDS
    order = np.argsort(start[is_strong], kind="stable")
    weak_alone = ~is_strong & ~_overlapped(start, stop, start[is_strong][order], stop[is_strong][order])
    # a token inside an address or a name belongs to that
    named = weak_alone & (kind != 5)
    order = np.argsort(start[named], kind="stable")
    weak_alone &= (kind != 5) | ~_overlapped(start, stop, start[named][order], stop[named][order])

    def in_scope(which: np.ndarray) -> np.ndarray:
        has = np.zeros(len(begins), bool)
        has[scope[which]] = True
        return has

    identifier, endpoint, key = (in_scope(weak_alone & (kind == k)) for k in (3, 4, 5))
    assigned, access, run = (in_scope(kind == k) for k in range(_STRONG_KINDS))
    complete = np.stack([
        assigned | run | endpoint & key,
        assigned | (identifier | access) & (run | key),
        access | identifier & endpoint,
    ])
    reported = weak_alone.copy()
    reported[weak_alone] = complete[kind[weak_alone] - _STRONG_KINDS, scope[weak_alone]]
    for k, s, at_kind, e in parts[reported].tolist():
        strong[chosen[k]].append((s, at_kind, e))
    for k in set(parts[reported, 0].tolist()):
        strong[chosen[k]].sort()
    return strong


def _batches(values: pa.Array) -> Iterator[list[str]]:
    held, chars = [], 0
    for value in values:
        held.append(value.as_py() or "")
        chars += len(held[-1])
        if chars >= BATCH_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def secret_spans(text: Column) -> Column:
    """Spans of a text by beginning, then kind as listed: array of kind, start, stop (end exclusive, code points)."""

    @F.arrow_udf(SPANS)
    def of(values: pa.Array) -> pa.Array:
        counts, flat = [], []
        for texts in _batches(values):
            for spans in linked(texts):
                counts.append(len(spans))
                flat += spans
        kinds = pa.array([KINDS[k] for _, k, _ in flat], pa.string())
        starts, stops = pa.array([s for s, _, _ in flat], pa.int64()), pa.array([e for _, _, e in flat], pa.int64())
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([kinds, starts, stops], names=["kind", "start", "stop"]))

    return of(text)


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"]))
    return F.array_join(each, ",")


def of_kind(spans: Column, kind: str) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def strong_only(spans: Column) -> Column:
    """The spans that count by themselves."""
    return F.filter(spans, lambda s: s["kind"].isin(*KINDS[:_STRONG_KINDS]))
