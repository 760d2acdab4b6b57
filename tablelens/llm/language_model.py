"""Language-model scores from a log-frequency Bloom filter.

Training texts give counts of words and of word pairs.  Pair counts are
quantised to levels (powers of a base); the filter holds (pair, level) for every
level up to the pair's own, so a pair's level is read by probing upwards until
a probe fails.  The filter is cut into segments, one per slice of the hash
space; tasks fill them on their own, each as large as its entries ask, so the
filter grows with the corpus and holds every pair.  It is broadcast if its
measured size stays below a bound.  A larger one stays where it is: chunks send
their distinct pairs to the segments and get the levels back.  Both ways probe
the same bits and give the same scores.

Probabilities mix the pair's relative frequency with the word's smoothed
frequency; the more often a word was seen, the more its pairs count.  A level
stands for its smallest count, so that over all next words the probabilities sum
to at most one, but for pairs that the filter takes for seen.

Word counts are exact: texts are cut into tokens once and kept as chunks of
token numbers; a chunk asks for the counts of its distinct words, slices of the
hash space add them up and answer, and the chunk is scored with the answers.
What is shuffled are packed arrays of token numbers, 64-bit word and 48-bit pair
hashes; texts are not.  Words and pairs are known by their hashes.

Special cases: a null or empty text has one token, its end; without training
texts all counts are zero; equal rows are scored each, and count each; a null id
is an id like any other; extra columns do no harm.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tablelens.llm.common import cut, quoted

CHUNK_BYTES = 8 << 20
#: Size up to which the filter is broadcast.
MOST_FILTER_BYTES = 64 << 20
HASHES = 3
BITS_PER_ENTRY = 6.0
LEVEL_BASE = 2.0
#: Weight of pairs after a word seen c times: c / (c + SPREAD * c ** POWER).
SPREAD, POWER = 1.5, 0.9

END = b" "  # never a word
START = np.uint64(0x9E3779B97F4A7C15)
PAIR_BITS = 48


def _chunked(chunk_bytes: int, id_type: pa.DataType):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of texts as token numbers, with the hash of each number's token."""
        ids, held, texts, size = [], [], [], 0
        for batch in batches:
            for i, h, text in zip(*(batch.column(k) for k in ("id", "held", "text")), strict=True):
                text = text.as_py() or b""
                if size and size + len(text) > chunk_bytes:
                    yield _chunk(ids, held, texts, id_type)
                    ids, held, texts, size = [], [], [], 0
                ids.append(i.as_py())
                held.append(h.as_py())
                texts.append(text)
                size += len(text) + 1
        if ids:
            yield _chunk(ids, held, texts, id_type)

    return of_batches


def _chunk(ids: list, held: list[bool], texts: list[bytes], id_type: pa.DataType) -> pa.RecordBatch:
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    end, pieces, sizes = numbers[END], [], []
    for text in texts:
        found = list(map(numbers.__getitem__, text.lower().split()))
        found.append(end)
        pieces.append(np.array(found, np.int32))
        sizes.append(len(found))
    digest = xxhash.xxh64_intdigest
    words = np.fromiter(map(digest, numbers), np.uint64, len(numbers))
    tokens = np.concatenate(pieces)
    # one plane per byte: the upper ones are nearly constant
    planes = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 4).T).tobytes())
    train = sum(not h for h in held)
    return pa.RecordBatch.from_arrays([
        pa.array([ids], pa.list_(id_type)), pa.array([held], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int64())),
        pa.array([planes], pa.binary()), pa.array([words.tobytes()], pa.binary()), pa.array([len(tokens)], pa.int64()),
        pa.array([train], pa.int64())], names=["ids", "held", "sizes", "numbers", "words", "tokens", "train"])


def _tokens(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token numbers of all texts in turn, tokens per text, hash per number) of a chunk."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["numbers"]), np.uint8).reshape(4, -1)
    numbers = np.ascontiguousarray(planes.T).view(np.int32).ravel()
    return numbers, np.array(row["sizes"], np.int64), np.frombuffer(row["words"], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _pairs(numbers: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """48-bit hash of each token with the one before it in its text."""
    own = hashes[numbers]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)] = START
    return _mixed(before * np.uint64(0xD6E8FEB86659FD93) + own) >> np.uint64(64 - PAIR_BITS)


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values).tobytes(), 1)


def _unpacked(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), kind)


def _five_bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view(np.uint64).ravel()


def _slices(values: np.ndarray, bits: int, of: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values are cut where their upper bits change: (slices, cuts)."""
    top = (values >> np.uint64(bits - of)).astype(np.int64)
    found, at = np.unique(top, return_index=True)
    return found, np.append(at, len(values))


ASKED = "slice int, chunk long, words binary, counts binary, pairs binary, pair_counts binary"


def _ask(of: int):
    def of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each chunk wants to know and adds, by slice."""
        for batch in batches:
            for k in range(batch.num_rows):
                yield _asked(batch.slice(k, 1).to_pylist()[0], of)

    return of_chunks


def _asked(chunk: dict, of: int) -> pa.RecordBatch:
    numbers, sizes, hashes = _tokens(chunk)
    trains = np.repeat(~np.array(chunk["held"], bool), sizes)
    counts = np.bincount(numbers[trains], minlength=len(hashes)).astype(np.int64)
    order = np.argsort(hashes)
    words, counts = hashes[order], counts[order]
    none = _packed(np.zeros(0, np.int64))
    rows = {}
    found, at = _slices(words, 64, of)
    for s, a, b in zip(found.tolist(), at[:-1], at[1:], strict=True):
        rows[s] = [words[a:b].tobytes(), _packed(counts[a:b]), b"", none]
    pairs, often = np.unique(_pairs(numbers, sizes, hashes)[trains], return_counts=True)
    found, at = _slices(pairs, PAIR_BITS, of)
    for s, a, b in zip(found.tolist(), at[:-1], at[1:], strict=True):
        rows.setdefault(s, [b"", none, b"", none])[2:] = [_five_bytes(pairs[a:b]), _packed(often[a:b].astype(np.int64))]
    columns = list(zip(*rows.values(), strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(list(rows), pa.int32()), pa.array([chunk["chunk"]] * len(rows), pa.int64()), *(pa.array(c, pa.binary()) for c in columns)],
        names=["slice", "chunk", "words", "counts", "pairs", "pair_counts"])


ANSWERED = "slice int, chunk long, counts binary, tokens long, distinct long, filter_bytes long, filter binary"


def levels(counts: np.ndarray, base: float) -> np.ndarray:
    """Level of each count, from 1; exact at powers of the base."""
    return 1 + np.floor(np.log(counts) / math.log(base) + 1e-9).astype(np.int64)


def _bits(pairs: np.ndarray, level, size) -> list[np.ndarray]:
    """Places of (pair, level) in segments of so many bits."""
    x = _mixed(pairs + (np.asarray(level, np.uint64) << np.uint64(PAIR_BITS)))
    step = (x >> np.uint64(32)) | np.uint64(1)
    size = np.asarray(size, np.uint64)
    return [((x + np.uint64(i) * step) % size).astype(np.int64) for i in range(HASHES)]


def _answer(base: float, bits_per_entry: float):
    def of_slice(table: pa.Table) -> pa.Table:
        """Counts for every chunk that asked, and this slice's segment of the filter."""
        own = table["slice"][0].as_py()
        words = [np.frombuffer(v.as_py(), np.uint64) for v in table["words"]]
        counts = [_unpacked(v.as_py(), np.int64) for v in table["counts"]]
        distinct, where = np.unique(np.concatenate(words), return_inverse=True)
        # whole numbers below 2 ** 53 add up exactly
        total = np.bincount(where, np.concatenate(counts), len(distinct)).astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        answers = [_packed(total[where[e - len(w):e]]) for w, e in zip(words, ends, strict=True)]
        seen, each = np.unique(np.concatenate([_from_five(v.as_py()) for v in table["pairs"]]), return_inverse=True)
        often = np.bincount(each, np.concatenate([_unpacked(v.as_py(), np.int64) for v in table["pair_counts"]]), len(seen))
        level = levels(np.maximum(often, 1), base) if len(seen) else np.zeros(0, np.int64)
        filter_bytes = 1 + int(level.sum() * bits_per_entry) // 8
        segment = np.zeros(8 * filter_bytes, bool)
        for k in range(1, int(level.max(initial=0)) + 1):
            for places in _bits(seen[level >= k], k, len(segment)):
                segment[places] = True
        n = len(answers)
        first = [True] + [False] * (n - 1)
        return pa.table([
            pa.array([own] * n, pa.int32()), table["chunk"].combine_chunks(), pa.array(answers, pa.binary()),
            pa.array([int(total.sum()) * f for f in first], pa.int64()), pa.array([int((total > 0).sum()) * f for f in first], pa.int64()),
            pa.array([filter_bytes * f for f in first], pa.int64()),
            pa.array([zlib.compress(np.packbits(segment, bitorder="little").tobytes(), 1) if f else None for f in first], pa.binary()),
        ], names=["slice", "chunk", "counts", "tokens", "distinct", "filter_bytes", "filter"])

    return of_slice


class _Filter:
    """Reads levels of pairs from the segments of some slices."""

    def __init__(self, segments: dict[int, bytes], of: int):
        self.of = of
        # a slice without pairs is an empty byte at the end
        self.raw = np.frombuffer(b"".join(segments.values()) + b"\0", np.uint8)
        self.start, self.size = np.full(1 << of, 8 * (len(self.raw) - 1), np.int64), np.full(1 << of, 8, np.uint64)
        at = 0
        for own, segment in segments.items():
            self.start[own], self.size[own] = at, 8 * len(segment)
            at += 8 * len(segment)

    def levels(self, pairs: np.ndarray) -> np.ndarray:
        """Level of each pair; 0: not in the filter."""
        own = (pairs >> np.uint64(PAIR_BITS - self.of)).astype(np.int64)
        inner = pairs & np.uint64((1 << 40) - 1)
        reached = np.zeros(len(pairs), np.uint8)
        active, level = np.arange(len(pairs)), 1
        while len(active) and level < 200:
            held = np.ones(len(active), bool)
            for places in _bits(inner[active], level, self.size[own[active]]):
                at = self.start[own[active]] + places
                held &= (self.raw[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            active = active[held]
            reached[active] = level
            level += 1
        return reached


def _probes(of: int):
    def of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct pairs of each chunk, by slice."""
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = batch.slice(k, 1).to_pylist()[0]
                pairs = np.unique(_pairs(*_tokens(chunk)))
                found, at = _slices(pairs, PAIR_BITS, of)
                packets = [_five_bytes(pairs[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.int32()), pa.array([chunk["chunk"]] * len(packets), pa.int64()), pa.array(packets, pa.binary())],
                    names=["slice", "chunk", "pairs"])

    return of_chunks


PROBED = "chunk long, slice int, levels binary"


def _probed(of: int):
    def of_slice(probes: pa.Table, segments: pa.Table) -> pa.Table:
        """Levels of the pairs that chunks ask a slice for."""
        known = _Filter({s["slice"]: zlib.decompress(s["filter"]) for s in segments.to_pylist()}, of)
        found = []
        for own, raw in zip(probes["slice"], probes["pairs"], strict=True):
            inner = _from_five(raw.as_py())
            # the upper bits of a pair are its slice
            upper = np.uint64(own.as_py() << (PAIR_BITS - of) & ~((1 << 40) - 1))
            found.append(_packed(known.levels(inner | upper)))
        return pa.table([probes["chunk"].combine_chunks(), probes["slice"].combine_chunks(), pa.array(found, pa.binary())],
                        names=["chunk", "slice", "levels"])

    return of_slice


SCORED = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SCORED_NAMES = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def _scored_types(id_type: pa.DataType) -> list[pa.DataType]:
    return [id_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def _in_turn(answers: list[dict], name: str, kind) -> np.ndarray:
    """What the slices answered, in the order of the hashes."""
    parts = sorted((a["slice"], a[name]) for a in answers if a[name] is not None)
    return np.concatenate([_unpacked(raw, kind) for _, raw in parts])


def _score(filter_at, base: float, total: int, distinct: int, train_texts: int, spread: float, power: float, id_type: pa.DataType):
    # the least count of each level
    least = np.concatenate(([0.0], np.ceil(base ** np.arange(199.0) - 1e-9)))

    def of_chunk(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        kept, answered = [], answers.to_pylist()
        # a chunk is one row
        for chunk in chunks.to_pylist():
            numbers, sizes, hashes = _tokens(chunk)
            counts = np.empty(len(hashes), np.int64)
            counts[np.argsort(hashes)] = _in_turn(answered, "counts", np.int64)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
            own = counts[numbers]
            plain = (own + 0.5) / (total + 0.5 * (distinct + 1))
            before = np.empty_like(own)
            before[1:] = own[:-1]
            before[starts] = train_texts
            pairs, where = np.unique(_pairs(numbers, sizes, hashes), return_inverse=True)
            level = filter_at.value.levels(pairs) if filter_at is not None else _in_turn(answered, "levels", np.uint8)
            together = least[level[where]]
            weight = before / (before + spread * np.maximum(before, 1) ** power)
            after = np.minimum(1.0, together / np.maximum(before, 1))
            whole = np.log10(weight * after + (1 - weight) * plain)
            kept.append(pa.table([
                pa.array(chunk["ids"], id_type), pa.array(chunk["held"], pa.bool_()), pa.array(sizes),
                pa.array(np.add.reduceat((own > 0).astype(np.int64), starts)), pa.array([total] * len(sizes), pa.int64()),
                pa.array(np.add.reduceat(np.log10(plain), starts)), pa.array(np.add.reduceat(whole, starts))], names=SCORED_NAMES))
        return pa.concat_tables(kept) if kept else pa.table([pa.array([], t) for t in _scored_types(id_type)], names=SCORED_NAMES)

    return of_chunk


def scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", base: float = LEVEL_BASE,
           spread: float = SPREAD, power: float = POWER, chunk_bytes: int = CHUNK_BYTES,
           most_filter_bytes: int = MOST_FILTER_BYTES, bits_per_entry: float = BITS_PER_ENTRY) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    Learns from the rows that are not held out and scores all.  base_score is
    the smoothed frequency of the words alone, score the model's log10
    probability of the text.
    """
    spark = docs.sparkSession
    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), quoted(text_col).cast("binary").alias("text"))
    id_kind = rows.schema["id"].dataType
    id_type = to_arrow_type(id_kind)
    blobs = f"ids array<{id_kind.simpleString()}>, held array<boolean>, sizes array<long>, numbers binary, words binary, tokens long, train long"
    chunks = rows.mapInArrow(_chunked(chunk_bytes, id_type), blobs)
    # from here on a chunk has its name
    chunks = cut(chunks.withColumn("chunk", F.monotonically_increasing_id()))
    size = chunks.agg(F.count("*"), F.sum("train")).first()
    train_texts = size[1] or 0
    # slices of the hash spaces; enough for memory, few enough that what a chunk asks of one stays large
    of = max(8, min(17, math.ceil(math.log2(max(1, size[0])))))
    asked = chunks.select("chunk", "held", "sizes", "numbers", "words").mapInArrow(_ask(of), ASKED)
    answered = cut(asked.groupBy("slice").applyInArrow(_answer(base, bits_per_entry), ANSWERED))
    total, distinct, filter_bytes = (x or 0 for x in answered.agg(F.sum("tokens"), F.sum("distinct"), F.sum("filter_bytes")).first())
    segments = answered.where("filter IS NOT NULL").select("slice", "filter")
    answers = answered.select("chunk", "slice", "counts", F.lit(None).cast("binary").alias("levels"))
    if filter_bytes <= most_filter_bytes:
        known = _Filter({r["slice"]: zlib.decompress(r["filter"]) for r in segments.collect()}, of)
        filter_at = spark.sparkContext.broadcast(known)
    else:
        filter_at = None
        probes = chunks.select("chunk", "sizes", "numbers", "words").mapInArrow(_probes(of), "slice int, chunk long, pairs binary")
        levels_found = probes.groupBy("slice").cogroup(segments.groupBy("slice")).applyInArrow(_probed(of), PROBED)
        answers = answers.unionByName(levels_found, allowMissingColumns=True)
    score = _score(filter_at, base, total, distinct, train_texts, spread, power, id_type)
    asks = chunks.select("chunk", "ids", "held", "sizes", "numbers", "words")
    return asks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, f"id {id_kind.simpleString()}, {SCORED}")
