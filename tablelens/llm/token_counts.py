"""Token counts of whole texts by prefix dynamic programming.

For every prefix of a word the table holds how many tokens it has; the count of
a text is the sum over its words, and the same tables say how much of a text
fits into a number of tokens, without encoding anything again.  The vocabulary
is a word-level byte-pair file of the `tokenizers` library; the library cuts a
text into words, the tables count.

A vocabulary of another make is refused rather than counted wrongly.

Special cases: null and empty texts have no tokens; special strings of the
vocabulary inside a text count as one token, as the library does by default;
equal rows are counted each; words of any length are counted whole; extra
columns do no harm.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablelens.llm.common import raw_bytes
from tablelens.llm.merges import Borders, merge_all

#: Results a worker remembers, and the longest argument that is worth it: some 100 MB at most.
CHUNKS_REMEMBERED = 400_000
WORDS_REMEMBERED = 200_000
REMEMBERED_LENGTH = 64


class PrefixCounter:
    """Counts tokens of text with the vocabulary in one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or not self.suffix or model.get("dropout") or model.get("ignore_merges") or described.get("truncation"):
            raise ValueError(f"not a word-level byte-pair vocabulary: {path}")
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        special = [t["content"] for t in described["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.starts = sorted({s[0] for s in special})
        vocabulary: dict[str, int] = model["vocab"]
        merges = {}
        for place, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merges.setdefault((vocabulary[a], vocabulary[b]), (place, vocabulary[a + b]))
        made: dict[int, list[tuple[int, int]]] = {}
        for pair, (_, token) in merges.items():
            made.setdefault(token, []).append(pair)
        parts, order = {}, {}
        self.inside: dict[str, int] = {}
        self.last: dict[str, int] = {}
        for text, token in vocabulary.items():
            ends = text.endswith(self.suffix) and text != self.suffix
            letters = text[:-len(self.suffix)] if ends else text
            pairs = made.get(token, [])
            if len(pairs) == 1:
                parts[token] = pairs[0]
                order[token] = merges[pairs[0]][0]
            elif pairs or len(letters) > 1:
                # several ways to make it: the one that merging by order takes
                atoms = [vocabulary[c] for c in letters[:-1]] + [vocabulary[letters[-1] + self.suffix * ends]]
                result = merge_all(atoms, merges.get)
                if len(result) != 1:
                    continue  # never comes out of an encoding
                parts[token] = result[0][1]
                order[token] = merges[result[0][1]][0]
            (self.last if ends else self.inside)[letters] = token
        # no token that ends in these two letters is longer
        self.reach, self.last_reach = _reach(self.inside), _reach(self.last)
        self.longest = max(map(len, [*self.inside, *self.last]))
        self.borders = Borders(parts, order, lambda a, b: merges[a, b][0] if (a, b) in merges else None)
        self.chunks = _Remembered(self._count_chunk, CHUNKS_REMEMBERED)
        self.words = _Remembered(self._count_word, WORDS_REMEMBERED)
        self.plain = re.compile(r"[!-~]+").fullmatch
        self.plain_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall

    def prefixes(self, word: str) -> list[int]:
        """Tokens of each prefix of a word (in the library's spelling of bytes), each as a word of its own."""
        return self._relax(word, True)

    def _relax(self, word: str, all_ends: bool, most: int | None = None) -> list[int]:
        """Tokens of each prefix (of the whole word at least); with `most`, prefixes that must have more are left out."""
        stays, inside, last_tokens = self.borders.stays, self.inside.get, self.last.get
        reach, last_reach = self.reach.get, self.last_reach.get
        size = len(word) if most is None else min(len(word), (most + 1) * self.longest)
        ends_with, tokens = [-1] * (size + 1), [0] * (size + 1)
        answers = [0] * (size + 1)
        for end in range(1, size + 1):
            two = word[end - 2:end] if end > 1 else ""
            if end < len(word):
                for start in range(max(0, end - reach(two, 1)), end):
                    token = inside(word[start:end])
                    if token is not None and (not start or stays(ends_with[start], token)):
                        ends_with[end], tokens[end] = token, tokens[start] + 1
                        break
            if all_ends or end == len(word):
                for start in range(max(0, end - last_reach(two, 1)), end):
                    token = last_tokens(word[start:end])
                    if token is not None and (not start or stays(ends_with[start], token)):
                        answers[end] = tokens[start] + 1
                        break
        return answers

    def _count_word(self, word: str) -> int:
        return 1 if word in self.last else self._relax(word, False)[-1]

    def _count_chunk(self, chunk: bytes) -> int:
        """Tokens of a text without white space."""
        text = chunk.decode("utf-8", "replace")
        if self.special is not None and any(s in text for s in self.starts) and self.special.search(text):
            found = len(self.special.findall(text))
            return found + sum(self._count_plain(t) for t in self.special.split(text) if t)
        return self._count_plain(text)

    def _count_plain(self, text: str) -> int:
        words = self.words
        if self.plain(text):
            return sum(words[w] for w in self.plain_words(text.lower()))
        return sum(words[w] for w, _ in self.split(self.normalize(text)))

    def count(self, text: bytes) -> int:
        # words never span ASCII white space, so equal chunks are counted once
        return sum(map(self.chunks.__getitem__, text.split()))

    def fit(self, text: bytes, budget: int) -> int:
        """Bytes of the longest prefix, cut between characters, of at most `budget` tokens.

        Whole chunks are added from the table; only the chunk in which the
        budget ends is looked at by its own prefixes.
        """
        used, best = 0, 0
        for match in re.finditer(rb"[^\x20\x09-\x0D]+", text):
            more = self.chunks[match[0]]
            if used + more <= budget:
                used, best = used + more, match.end()
                continue
            inner = self._fit_chunk(match[0].decode("utf-8", "replace"), budget - used)
            return match.start() + len(inner.encode()) if inner else best
        return len(text)

    def _fit_chunk(self, text: str, budget: int) -> str:
        """The longest prefix of a text without white space that has at most `budget` tokens."""
        if self.special is not None:
            at, used = 0, 0
            for found in self.special.finditer(text):
                before = text[at:found.start()]
                more = (self._count_plain(before) if before else 0) + 1
                if used + more > budget:
                    # a special string that is cut is plain text
                    return text[:at] + self._fit_plain(text[at:found.end() - 1], budget - used)
                at, used = found.end(), used + more
            return text[:at] + self._fit_plain(text[at:], budget - used)
        return self._fit_plain(text, budget)

    def _fit_plain(self, text: str, budget: int) -> str:
        """The same for a text without special strings.

        The library cuts the text into words once.  All prefixes up to the word
        in which the budget ends are known from the words' counts, and those in
        it from its table.
        """
        plain = self.normalize(text)
        each = [self.normalize(c) for c in text]
        spelled = [w for w, _ in self.split(plain)] if plain else []
        ends = list(accumulate(len(c.encode()) for c in each))
        if "".join(each) != plain or sum(map(len, spelled)) != (ends[-1] if ends else 0):
            # letters that combine with the ones before them: look at the prefixes themselves
            kept = [k for k in range(len(text) + 1) if k == 0 or self._count_plain(text[:k]) <= budget]
            return text[:kept[-1]]
        used, begin, fits = 0, 0, 0
        for word in spelled:
            count = self.words[word]
            if used + count <= budget:
                used, begin = used + count, begin + len(word)
                fits = begin
                continue
            table = self._relax(word, True, budget - used)
            if len(word) == 3 and word[0] == "'":
                # cut short, an ending like 're is a mark and a letter
                table[2] = self.words["'"] + self.words[word[1]]
            inner = [k for k, n in enumerate(table) if 0 < n <= budget - used]
            within = {begin + k for k in inner}
            last = max((e for e in ends if e in within), default=fits)
            fits = max(fits, last)
            break
        return text[:bisect_right(ends, fits)]


def _reach(tokens: dict[str, int]) -> dict[str, int]:
    longest: dict[str, int] = {}
    for letters in tokens:
        longest[letters[-2:]] = max(len(letters), longest.get(letters[-2:], 1))
    return longest


class _Remembered(dict):
    """Results by argument; long arguments are not kept, and when full all are forgotten."""

    def __init__(self, function, most: int):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self.function(key)
        if len(key) <= REMEMBERED_LENGTH:
            self[key] = value
        return value


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    """One counter per vocabulary and worker."""
    return PrefixCounter(path)


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text as long, by the vocabulary at a path that all executors have."""

    @F.arrow_udf("long")
    def of(values: pa.Array) -> pa.Array:
        count = counter(path).count
        return pa.array((count(v) for v in raw_bytes(values)), pa.int64(), size=len(values))

    return of(text.cast("binary"))


def bytes_within(text: Column, path: str, budget: int) -> Column:
    """Bytes of the longest prefix of a text that has at most `budget` tokens."""

    @F.arrow_udf("long")
    def of(values: pa.Array) -> pa.Array:
        fit = counter(path).fit
        return pa.array((fit(v, budget) for v in raw_bytes(values)), pa.int64(), size=len(values))

    return of(text.cast("binary"))
