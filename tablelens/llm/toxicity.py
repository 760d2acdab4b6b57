"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on what is
typical of toxic text.  A window of a text (a word between spaces, or 64 bytes
of a longer one) is compressed with the ordinary dictionary alone and with both;
the bytes that the toxic dictionary saves are its distance.  How many windows
of a text go beyond two thresholds, and by how much, is calibrated to a
probability by logistic regression.

Training reads a bounded sample of labelled texts (`per_class`, taken in order
of a hash); one half trains the dictionaries, the other calibrates.  Typical of
toxic text are word beginnings that occur in significantly more toxic texts
than their share; the toxic samples are the words that have them.  Scoring reads
every text whole.

Special cases: null and empty texts have no windows and get the score of a text
without findings; without labels of both classes every score is the smoothed
share of toxic labels; null labels are ignored, and of contradicting labels of
one id the highest counts, of several texts of one id the smallest; equal rows are scored each; extra columns do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import cut, give_back, quoted, raw_bytes

#: Labelled texts of each class that training takes at most.
PER_CLASS = 4000


@dataclass(frozen=True)
class Bounds:
    """What training keeps of them at most; scoring knows no bounds."""

    #: Typical word beginnings, and toxic words that have them.
    beginnings: int = 2000
    words: int = 4000
    #: Windows of ordinary text.
    windows: int = 20000
    #: Most frequent toxic words kept beside what the trainer picks.
    appended: int = 150
    ordinary_bytes: int = 8192
    toxic_bytes: int = 4096


#: Texts before and after each window, known to both dictionaries.  The compressor stores short
#: inputs as they are and looks for no match in the last bytes; with these, every window counts.
CARRIER = b"~carrier-of-thirty-two-bytes-len~"
TAIL = b"~and-a-tail-behind-it~"
WINDOW_BYTES = 64
#: Distances from which a window counts as found.
THRESHOLDS = (3, 5)
WORDS_REMEMBERED = 100_000


@dataclass(frozen=True)
class Model:
    """Dictionaries, and weights over the features of a text; no weights: a constant score."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    constant: float


def _parts(text: bytes) -> Iterator[bytes]:
    for word in text.lower().split():
        if len(word) <= WINDOW_BYTES:
            yield word
        else:
            yield from (word[i:i + WINDOW_BYTES] for i in range(0, len(word), WINDOW_BYTES))


class _Distances(dict):
    """Bytes saved by the toxic dictionary, by window; remembers a bounded number."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        super().__init__()
        settings = zstandard.ZstdCompressionParameters(
            compression_level=9, strategy=zstandard.STRATEGY_BTLAZY2, min_match=4, window_log=16, hash_log=14,
            chain_log=14, search_log=4, target_length=32, write_content_size=0, write_dict_id=0, write_checksum=0)
        self.sides = []
        for content in (ordinary + CARRIER + TAIL, ordinary + toxic + CARRIER + TAIL):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=settings)
            self.sides.append(zstandard.ZstdCompressor(dict_data=held, compression_params=settings).compress)

    def __missing__(self, part: bytes) -> int:
        if len(self) >= WORDS_REMEMBERED:
            self.clear()
        window = CARRIER + b" " + part + b" " + TAIL
        plain, known = (len(compress(window)) for compress in self.sides)
        self[part] = plain - known
        return plain - known


@lru_cache(maxsize=2)
def _distances(ordinary: bytes, toxic: bytes) -> _Distances:
    return _Distances(ordinary, toxic)


def features(text: bytes, ordinary: bytes, toxic: bytes) -> list[float]:
    """What calibration sees of a text."""
    known = _distances(ordinary, toxic)
    counted = windows = excess = 0
    found = [0] * len(THRESHOLDS)
    for part in _parts(text):
        windows += 1
        distance = known[part]
        if distance >= THRESHOLDS[0]:
            counted += 1
            excess += distance
            for i, least in enumerate(THRESHOLDS):
                found[i] += distance >= least
    per_hundred = 100.0 / (windows + 50.0)
    return [1.0, math.log1p(excess), *(math.log1p(f) for f in found), *(math.log1p(f * per_hundred) for f in found),
            math.log1p(windows) / 10.0, float(counted > 0)]


def _probability(row: list[float], model: Model) -> float:
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(row, model.weights, strict=True))))))


def score(text: Column, model: Model) -> Column:
    """Probability that a text is toxic."""

    @F.arrow_udf("double")
    def of(values: pa.Array) -> pa.Array:
        if not model.weights:
            return pa.array([model.constant] * len(values), pa.float64())
        each = (_probability(features(v, model.ordinary, model.toxic), model) for v in raw_bytes(values))
        scores = pa.array(each, pa.float64(), size=len(values))
        give_back()
        return scores

    return of(text.cast("binary"))


def _beginnings(text: bytes) -> list[bytes]:
    """Distinct word beginnings of 4 to 9 bytes, and short whole words, each after a space."""
    out = set()
    for part in set(_parts(text)):
        word = b" " + part
        out.update(word[:k] for k in range(4, min(10, len(word) + 1)))
        out.add(word[:20] + b" ")
    return sorted(out)


def _toxic_words(text: bytes, typical: frozenset[bytes]) -> list[bytes]:
    words = (b" " + part for part in set(_parts(text)))
    return sorted(w + b" " for w in words
                  if w + b" " in typical or any(w[:k] in typical for k in range(4, min(10, len(w) + 1))))


def _ordinary_windows(text: bytes) -> list[bytes]:
    parts = list(_parts(text))
    return [b" " + b" ".join(parts[i:i + 8]) + b" " for i in range(0, len(parts), 8)]


def _listed(function, *more) -> Column:
    @F.arrow_udf("array<binary>")
    def of(values: pa.Array) -> pa.Array:
        return pa.array((function(v, *more) for v in raw_bytes(values)), pa.list_(pa.binary()), size=len(values))

    return of


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary; of too few samples, the samples themselves."""
    # the trainer skips samples of a few bytes
    samples = [s * (1 + 16 // len(s)) for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _fit(rows: np.ndarray, labels: np.ndarray, prior: float) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method; classes weigh as in all labels."""
    share = labels.mean()
    weight = np.where(labels == 1, prior / share, (1 - prior) / (1 - share))
    w = np.zeros(rows.shape[1])
    ridge = np.full(rows.shape[1], 0.5)
    ridge[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        gradient = rows.T @ (weight * (p - labels)) + ridge * w
        curve = (rows * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ rows + np.diag(ridge)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(x) for x in w)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", per_class: int = PER_CLASS, bounds: Bounds = Bounds()) -> Model:
    """Train on the labelled documents given; hold others back before the call."""
    known = labels.select(quoted(id_col).alias("id"), quoted(label_col).alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    known = cut(known.groupBy("id").agg(F.max("label").cast("int").alias("label")))
    totals = known.agg(F.count("*"), F.sum("label")).first()
    prior = ((totals[1] or 0) + 0.5) / (totals[0] + 1)
    order = F.xxhash64("id")
    sample = None
    for label in (0, 1):
        some = known.where(F.col("label") == label).orderBy(order, "id").limit(per_class)
        sample = some if sample is None else sample.union(some)
    # ids of a bounded sample: 2 * per_class rows; of several texts of one id the smallest counts
    texts = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("binary").alias("text"))
    texts = texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    texts = cut(texts.withColumn("half", F.xxhash64("id", F.lit(1)) % 2 == 0))
    counts = {(r["half"], r["label"]): r["count"] for r in texts.groupBy("half", "label").count().collect()}
    if min(counts.get((half, label), 0) for half in (True, False) for label in (0, 1)) == 0:
        return Model(b"", b"", (), prior)

    first = texts.where("half")
    toxic_texts, ordinary_texts = counts[True, 1], counts[True, 0]
    beginnings = first.select("label", F.explode(_listed(_beginnings)("text")).alias("b"))
    beginnings = beginnings.groupBy("b").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("o"))
    expected = (F.col("o") + 0.5) * (toxic_texts / ordinary_texts)
    beginnings = beginnings.withColumn("z", (F.col("t") - expected) / F.sqrt(expected + 1))
    beginnings = beginnings.where(f"t >= {min(5, max(1, toxic_texts // 20))} AND z >= {6.0 if toxic_texts >= 100 else 2.0}")
    typical = frozenset(bytes(r["b"]) for r in beginnings.orderBy(F.desc("z"), "b").limit(bounds.beginnings).collect())
    words = first.where("label = 1").select(F.explode(_listed(_toxic_words, typical)("text")).alias("w"))
    words = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(bounds.words).collect()
    windows = first.where("label = 0").select(F.explode(_listed(_ordinary_windows)("text")).alias("w"))
    windows = windows.orderBy(F.xxhash64("w"), "w").limit(bounds.windows).collect()
    ordinary = _dictionary([bytes(r["w"]) for r in windows], bounds.ordinary_bytes)
    toxic = _dictionary([bytes(r["w"]) for r in words for _ in range(min(r["count"], 30))], bounds.toxic_bytes)
    # the trainer samples; the most frequent words are appended so that it loses none
    toxic += b"".join(bytes(r["w"]) for r in words[:bounds.appended])

    @F.arrow_udf("array<double>")
    def seen(values: pa.Array) -> pa.Array:
        return pa.array((features(v, ordinary, toxic) for v in raw_bytes(values)), pa.list_(pa.float64()), size=len(values))

    rows = texts.where("NOT half").select("id", "label", seen("text").alias("row")).orderBy("id").collect()
    weights = _fit(np.array([r["row"] for r in rows]), np.array([float(r["label"]) for r in rows]), prior)
    return Model(ordinary, toxic, weights, prior)
