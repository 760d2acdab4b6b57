"""SentencePiece encoding and decoding by suffix-array matching.

The distinct space-led segments of a batch of texts are concatenated and their
suffixes sorted, as far as the longest piece reaches.  Binary search finds the
range of suffixes that begin with each piece; the ranges give one edge per
occurrence.  Edges are sorted by position and relaxed from left to right: each
position keeps the one piece that ends there and may follow the encoding of what
is before it (see merges.py), which is the library's own result.

Only byte-pair models with byte fallback, identity normalisation and a dummy
prefix are taken; others are refused rather than encoded wrongly.

Special cases: null and empty texts have no pieces; characters outside the
vocabulary become byte pieces; control pieces are never matched in a text; equal
rows are encoded each; texts and segments of any length are encoded whole; the
mark for a space (U+2581) in a text decodes to a space, as in the library;
extra columns do no harm.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

from tablelens.llm.common import give_back
from tablelens.llm.merges import Borders, merge_all

MARK = "▁"
#: Bytes of encoded segments a worker remembers, in each of two generations; longer segments are not kept.
REMEMBERED_BYTES = 32 << 20
REMEMBERED_CHARS = 64
#: Segments longer than this are relaxed edge by edge, the others side by side.
SIDE_BY_SIDE = 48
#: Characters indexed at a time.
INDEX_CHARS = 1 << 19
#: Characters of text encoded at a time (a longer text goes alone).
TEXT_CHARS = 1 << 20
CACHE_BITS = 20
BORDERS_REMEMBERED = 50_000


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places in order of their key, keys in order, distinct keys, rank of each place)."""
    places = np.argsort(key)
    ordered = key[places]
    first = np.empty(len(key), bool)
    first[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    rank = np.empty(len(key), np.uint64)
    rank[places] = np.cumsum(first) - 1
    return places, ordered, ordered[first], rank


class PieceCoder:
    """Encodes and decodes with one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules, trained = model.normalizer_spec, model.trainer_spec
        if (trained.model_type != 2 or not trained.byte_fallback or rules.precompiled_charsmap or rules.remove_extra_whitespaces
                or not rules.add_dummy_prefix or trained.treat_whitespace_as_suffix):
            raise ValueError(f"not a plain byte-pair model with byte fallback: {path}")
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        self.text = [library.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if model.pieces[i].type == 1]
        if any(model.pieces[i].type in (4, 5) for i in range(size)):
            raise ValueError(f"user-defined or unused pieces are not handled: {path}")
        if any(MARK in re.sub(f"^{MARK}+", "", self.text[i]) for i in normal):
            raise ValueError(f"pieces that hold a space inside are not handled: {path}")
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(size):
            if model.pieces[i].type == 6:
                self.byte_ids[int(self.text[i][3:5], 16)] = i
        self.surface = [b"" if library.is_control(i) else self.text[i].replace(MARK, " ").encode() for i in range(size)]
        for value, i in enumerate(self.byte_ids.tolist()):
            self.surface[i] = bytes([value])
        self.bytes_of = set(self.byte_ids.tolist())

        # equal scores share a place; the higher score merges first
        scores = sorted({-library.get_score(i) for i in normal})
        place = {s: k for k, s in enumerate(scores)}
        ids = {self.text[i]: i for i in normal}
        order_of = {i: place[-library.get_score(i)] for i in normal}
        letters = sorted({c for t in ids for c in t})
        # a letter that is no piece of its own still merges; beyond it, one atom stands for all unknown letters
        self.atoms = {c: ids.get(c, size + k) for k, c in enumerate(letters)}
        self.unknown = size + len(letters)
        spelled = dict(enumerate(self.text)) | {i: c for c, i in self.atoms.items()} | {self.unknown: "\0"}

        def joined(a: int, b: int) -> int | None:
            return ids.get(spelled[a] + spelled[b])

        def merge(a: int, b: int) -> tuple[int, int] | None:
            token = joined(a, b)
            return None if token is None else (order_of[token], token)

        parts, order, used = {}, {}, []
        for i in normal:
            if len(self.text[i]) == 1:
                used.append(i)
                continue
            made = merge_all([self.atoms[c] for c in self.text[i]], merge)
            if len(made) == 1:
                parts[i], order[i] = made[0][1], order_of[i]
                used.append(i)

        def merge_order(a: int, b: int) -> int | None:
            token = joined(a, b)
            return None if token is None else order_of[token]

        # the array of answers below is asked first
        self.borders = Borders(parts, order, merge_order, BORDERS_REMEMBERED)
        self.alphabet = np.zeros(0x110000, np.uint16)
        self.alphabet[:] = len(letters) + 1
        for k, c in enumerate(letters):
            self.alphabet[ord(c)] = k + 1
        self.alphabet[ord(" ")] = self.alphabet[ord(MARK)]
        longest = max(len(self.text[i]) for i in used)
        self.width = 4
        while self.width < longest:
            self.width *= 2
        self.piece_ids = np.array(used, np.int32)
        self.piece_sizes = np.array([len(self.text[i]) for i in used], np.int64)
        self.piece_letters = np.zeros((len(used), self.width), np.uint64)
        for row, i in enumerate(used):
            codes = np.frombuffer(self.text[i].encode("utf-32-le"), np.uint32)
            self.piece_letters[row, :len(codes)] = self.alphabet[codes]
        # letters that are no piece: one edge each
        self.lone = {k + 1: self.atoms[c] for k, c in enumerate(letters) if c not in ids} | {len(letters) + 1: self.unknown}
        self.sizes = np.ones(self.unknown + 1, np.int64)
        self.sizes[self.piece_ids] = self.piece_sizes
        self.cache_keys = np.full(1 << CACHE_BITS, -1, np.int64)
        self.cache_values = np.zeros(1 << CACHE_BITS, bool)
        self.segments: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.room = REMEMBERED_BYTES

    # the index

    def _edges(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every occurrence of every piece."""
        n = len(letters)
        wide = np.zeros(n + 2 * self.width, np.uint64)
        wide[:n] = letters
        size = n + self.width
        key = np.zeros(size, np.uint64)
        for k in range(4):
            key |= wide[k:k + size] << np.uint64(16 * (3 - k))
        columns = [(self.piece_letters[:, at:at + 4]) for at in range(0, self.width, 4)]
        blocks = []
        for at, block in enumerate(columns):
            packed = np.zeros(len(block), np.uint64)
            for k in range(4):
                packed |= block[:, k] << np.uint64(16 * (3 - k))
            filled = np.clip(self.piece_sizes - 4 * at, 0, 4)
            blocks.append((packed, filled))
        suffixes, ordered, distinct, rank = _ranked(key)
        # of each block of four letters of each piece: the ranks that begin with it
        spans = []
        for packed, filled in blocks:
            step = np.where(filled > 0, np.uint64(1) << (16 * (4 - np.maximum(filled, 1))).astype(np.uint64), 0).astype(np.uint64)
            begin = np.searchsorted(distinct, packed)
            end = np.where(filled > 0, np.searchsorted(distinct, packed + step), len(distinct))
            spans.append((np.where(filled > 0, begin, 0), end))
        reach = 4
        while reach < self.width:
            # twice the letters: pairs of ranks
            after = np.zeros(size, np.uint64)
            after[:size - reach] = rank[reach:]
            key = rank << np.uint64(32) | after
            suffixes, ordered, distinct, rank = _ranked(key)
            doubled = []
            for (a, b), (c, d) in zip(spans[::2], spans[1::2], strict=True):
                # a block that is not full decides alone; after a full one, the next block narrows its rank
                exact = (b - a == 1) & (d > c)
                start = np.where(exact, a.astype(np.uint64) << np.uint64(32) | c.astype(np.uint64), a.astype(np.uint64) << np.uint64(32))
                stop = np.where(exact, a.astype(np.uint64) << np.uint64(32) | d.astype(np.uint64), b.astype(np.uint64) << np.uint64(32))
                missing = (b <= a) | (d <= c)
                begin, end = np.searchsorted(distinct, start), np.searchsorted(distinct, stop)
                doubled.append((begin, np.where(missing, begin, end)))
            spans = doubled
            reach *= 2
        begin, end = spans[0]
        found = end > begin
        bounds = np.append(distinct, np.uint64(2**64 - 1))
        first = np.searchsorted(ordered, bounds[begin[found]], side="left")
        last = np.where(end[found] < len(distinct), np.searchsorted(ordered, bounds[end[found]], side="left"), len(ordered))
        counts = last - first
        jumps = np.repeat(first - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
        starts = suffixes[np.arange(counts.sum()) + jumps]
        return starts, np.repeat(self.piece_ids[found], counts)

    # the relaxation

    def _stay(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Borders.stays for arrays, with a table of recent answers."""
        key = left.astype(np.int64) << 24 | right
        slot = ((key * -7046029254386353131).view(np.uint64) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        missed = np.flatnonzero(self.cache_keys[slot] != key)
        out = self.cache_values[slot]
        if len(missed):
            stays = self.borders.stays
            distinct, where = np.unique(key[missed], return_inverse=True)
            answers = np.fromiter((stays(k >> 24, k & 0xFFFFFF) for k in distinct.tolist()), bool, len(distinct))
            out[missed] = answers[where]
            self.cache_keys[slot[missed]] = key[missed]
            self.cache_values[slot[missed]] = answers[where]
        return out

    def _encode_new(self, segments: list[str]) -> list[bytes]:
        """Encode distinct segments."""
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.concatenate(([0], np.cumsum(lengths + 1)))
        ends = begins[:-1] + lengths
        # one empty place after each segment, which no piece matches
        places = np.arange(len(codes)) + np.repeat(np.arange(len(segments)), lengths)
        letters = np.zeros(begins[-1], np.uint16)
        letters[places] = self.alphabet[codes]
        starts, tokens = self._edges(letters)
        for letter, atom in self.lone.items():
            at = np.flatnonzero(letters == letter)
            starts, tokens = np.concatenate((starts, at)), np.concatenate((tokens, np.full(len(at), atom, np.int32)))
        last = np.full(begins[-1] + 1, -1, np.int32)
        segment_of = np.repeat(np.arange(len(segments)), lengths + 1)
        stops = starts + self.sizes[tokens]
        long = lengths[segment_of[starts]] > SIDE_BY_SIDE
        self._relax_long(starts[long], stops[long], tokens[long], last, set(begins[:-1][lengths > SIDE_BY_SIDE].tolist()))
        starts, stops, tokens = starts[~long], stops[~long], tokens[~long]
        # by position in the segment: all segments advance together
        offset = (stops - begins[segment_of[starts]]).astype(np.uint16)
        by_position = np.argsort(offset, kind="stable")
        starts, stops, tokens = starts[by_position], stops[by_position], tokens[by_position]
        edges = np.searchsorted(offset[by_position], np.arange(SIDE_BY_SIDE + 2))
        opening = np.zeros(begins[-1] + 1, bool)
        opening[begins[:-1]] = True
        for k in range(1, SIDE_BY_SIDE + 1):
            a, b = edges[k], edges[k + 1]
            if a == b:
                continue
            s, t, e = starts[a:b], tokens[a:b], stops[a:b]
            fits = opening[s]
            inner = np.flatnonzero(~fits)
            fits[inner] = self._stay(last[s[inner]], t[inner])
            last[e[fits]] = t[fits]
        return self._read_back(segments, begins, ends, last)

    def _relax_long(self, starts, stops, tokens, last, openings: set[int]) -> None:
        order = np.argsort(stops, kind="stable")
        stays = self.borders.stays
        for s, e, t in zip(starts[order].tolist(), stops[order].tolist(), tokens[order].tolist(), strict=True):
            if s in openings or stays(int(last[s]), t):
                last[e] = t

    def _read_back(self, segments, begins, ends, last) -> list[bytes]:
        """Pieces of each segment, from its end to its beginning."""
        here, active = ends.copy(), np.arange(len(segments))
        active = active[here > begins[:-1]]
        rows, pieces, steps = [], [], 0
        while len(active):
            token = last[here[active]]
            rows.append(active)
            pieces.append(token)
            here[active] -= self.sizes[token]
            active = active[here[active] > begins[active]]
            steps += 1
        if rows:
            row, piece = np.concatenate(rows), np.concatenate(pieces)
            step = np.repeat(np.arange(steps), [len(r) for r in rows])
            order = np.lexsort((-step, row))
            row, piece = row[order], piece[order]
        else:
            row, piece = np.zeros(0, np.int64), np.zeros(0, np.int32)
        cuts = np.searchsorted(row, np.arange(len(segments) + 1)).tolist()
        strange = set(row[piece >= len(self.text)].tolist())
        piece = piece.astype(np.int32)
        raw = piece.tobytes()
        return [self._with_bytes(piece[a:b], segments[i]) if i in strange else raw[4 * a:4 * b]
                for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]

    def _with_bytes(self, pieces: np.ndarray, segment: str) -> bytes:
        """Bytes in place of letters without a piece."""
        out, at = [], 0
        for token in pieces.tolist():
            if token < len(self.text):
                out.append(token)
                at += len(self.text[token])
            else:
                out += self.byte_ids[list(segment[at].encode("utf-8", "surrogatepass"))].tolist()
                at += 1
        return np.array(out, np.int32).tobytes()

    # whole texts

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Piece ids of each text, as bytes of 32-bit integers."""
        split = re.compile(" +[^ ]*").findall
        cut = [split(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        known, new = {}, []
        for segment in {s for segments in cut for s in segments}:
            pieces = self.segments.get(segment)
            if pieces is None:
                pieces = self.older.get(segment)
                if pieces is None:
                    new.append(segment)
                    continue
                self._remember(segment, pieces)
            known[segment] = pieces
        at = 0
        while at < len(new):
            end, chars = at, 0
            while end < len(new) and (chars == 0 or chars + len(new[end]) <= INDEX_CHARS):
                chars += len(new[end]) + 1
                end += 1
            for segment, pieces in zip(new[at:end], self._encode_new(new[at:end]), strict=True):
                known[segment] = pieces
                self._remember(segment, pieces)
            at = end
        found = known.__getitem__
        return [b"".join(map(found, segments)) for segments in cut]

    def _remember(self, segment: str, pieces: bytes) -> None:
        """Keep a segment; when there is no more room, what is not met again until the next time is forgotten."""
        if len(segment) > REMEMBERED_CHARS:
            return
        # both values and their place in the table
        self.room -= sys.getsizeof(segment) + sys.getsizeof(pieces) + 100
        if self.room < 0:
            self.older, self.segments, self.room = self.segments, {}, REMEMBERED_BYTES
        self.segments[segment] = pieces

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        # the dummy prefix goes, unless the text began with a byte piece
        spaced = raw.startswith(b" ") and ids[0] not in self.bytes_of
        return (raw[1:] if spaced else raw).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def coder(path: str) -> PieceCoder:
    """One coder per model and worker."""
    return PieceCoder(path)


def _texts(values: pa.Array, most_chars: int = TEXT_CHARS) -> Iterable[list[str]]:
    """Texts in lists of bounded size."""
    held, chars = [], 0
    for value in values:
        text = value.as_py() or ""
        held.append(text)
        chars += len(text)
        if chars >= most_chars:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _listed(encoded: list[bytes]) -> pa.ListArray:
    """Arrays of ids of texts, from their bytes."""
    offsets = np.concatenate(([0], np.cumsum([len(e) // 4 for e in encoded]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), np.int32)))


def piece_ids(text: Column, path: str) -> Column:
    """Piece ids of a text, by the model at a path that all executors have."""

    @F.arrow_udf("array<int>")
    def of(values: pa.Array) -> pa.Array:
        # arrays of a few texts at a time, so that ids are held once and not twice
        parts = [_listed(coder(path).encode(some)) for some in _texts(values)]
        give_back()
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return of(text)


_CODED = pa.struct([("piece_ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])


def coded(text: Column, path: str) -> Column:
    """Struct of piece_ids and round_trip: whether decoding them gives the text back.

    Texts are encoded and decoded in one call.  As two columns, the ids that
    decoding starts from would be computed once more.  A mark for a space in the
    text counts as the space it decodes to.
    """

    @F.arrow_udf("struct<piece_ids: array<int>, round_trip: boolean>")
    def of(values: pa.Array) -> pa.Array:
        own, parts = coder(path), []
        for some in _texts(values):
            encoded = own.encode(some)
            same = [own.decode(np.frombuffer(e, np.int32).tolist()) == t.replace(MARK, " ") for e, t in zip(encoded, some, strict=True)]
            parts.append(pa.StructArray.from_arrays([_listed(encoded), pa.array(same, pa.bool_())], fields=list(_CODED)))
        give_back()
        return pa.concat_arrays(parts) if parts else pa.array([], _CODED)

    return of(text)


def decoded(ids: Column, path: str) -> Column:
    """The text of piece ids; null ids give an empty text."""

    @F.arrow_udf("string")
    def of(values: pa.Array) -> pa.Array:
        decode = coder(path).decode
        return pa.array((decode(v.as_py() or []) for v in values), pa.string(), size=len(values))

    return of(ids)
