"""Token counts and pieces next to the public libraries."""

from __future__ import annotations

import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablelens.llm.pieces import coded, coder, decoded, piece_ids
from tablelens.llm.token_counts import bytes_within, counter, token_count

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "abcdefghijklmnopqrstuvwxyz'.,!?<>|0123456789    \n\tÀÉßüİſ́中文かな한글кошка😀\x1c\x00\x85ﬁⅧ▁ "


def texts(n, seed):
    rng = random.Random(seed)
    out = ["".join(rng.choices(LETTERS, k=rng.randrange(60))) for _ in range(n)]
    return out + ["don't we'll they're !!'re", "<|endoftext|>x<|startoftext|> <|end", "a" * 3000, "ab" * 700, " " * 70,
                  "the quick  brown   fox", "<s>x</s>", "=" * 99, "▁▁a ▁"]


def test_counts_equal_the_library():
    library, own = Tokenizer.from_file(WORDS), counter(WORDS)
    for text in texts(1500, 1):
        assert own.count(text.encode()) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_prefix_tables_equal_counts_of_prefixes():
    own = counter(WORDS)
    library = Tokenizer.from_file(WORDS)
    for word in ["themselves", "wouldn", "=====", "antidisestablishmentarianism"]:
        counts = own.prefixes(word)
        assert counts == [len(library.encode(word[:k], add_special_tokens=False).ids) for k in range(len(word) + 1)]


def test_budget_needs_no_encoding():
    library, own = Tokenizer.from_file(WORDS), counter(WORDS)
    for text in texts(40, 2):
        for budget in (0, 1, 4, 20):
            at = own.fit(text.encode(), budget)
            kept = text.encode()[:at].decode()
            assert len(library.encode(kept, add_special_tokens=False).ids) <= budget
            if at < len(text.encode()):
                more = [text[:k] for k in range(len(kept) + 1, len(text) + 1) if text[len(kept):k].strip()]
                assert all(len(library.encode(m, add_special_tokens=False).ids) > budget for m in more[:1])


def test_refuses_other_makes():
    with pytest.raises(ValueError):
        counter(public_tokenizers.path("byte_bpe_50k.json"))


def test_pieces_equal_the_library():
    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), coder(PIECES)
    some = texts(1500, 3) + ["x" * 5000, "thethethe" * 100, "word " * 2000]
    for text, raw in zip(some, own.encode(some), strict=True):
        ids = np.frombuffer(raw, np.int32).tolist()
        assert ids == library.encode(text), repr(text[:80])
        assert own.decode(ids) == library.decode(ids)
        assert own.decode(ids) == text.replace("▁", " ")


def test_forgetting_changes_nothing(monkeypatch):
    from tablelens.llm import pieces

    monkeypatch.setattr(pieces, "REMEMBERED_BYTES", 2000)
    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.PieceCoder(PIECES)
    own.room = 0
    some = texts(400, 5)
    for at in range(0, len(some), 7):
        got = own.encode(some[at:at + 7])
        assert [np.frombuffer(g, np.int32).tolist() for g in got] == [library.encode(t) for t in some[at:at + 7]]
    assert len(own.segments) < 40


def test_odd_rows(spark, odd_rows):
    df = spark.createDataFrame([(*r, "x") for r in odd_rows], "doc_id long, text string, n_tokens string")
    got = df.select("text", token_count(F.col("text"), WORDS).alias("n"), bytes_within(F.col("text"), WORDS, 5).alias("b"),
                    piece_ids(F.col("text"), PIECES).alias("ids"), coded(F.col("text"), PIECES).alias("c"))
    got = got.withColumn("back", decoded(F.col("ids"), PIECES)).collect()
    words, pieces = Tokenizer.from_file(WORDS), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert len(got) == len(odd_rows)
    for r in got:
        text = r["text"] or ""
        assert r["n"] == len(words.encode(text, add_special_tokens=False).ids)
        assert r["b"] <= len(text.encode())
        assert r["ids"] == pieces.encode(text)
        assert r["back"] == text.replace("▁", " ")
        assert r["c"]["piece_ids"] == r["ids"] and r["c"]["round_trip"]
    empty = spark.createDataFrame([], "text string")
    assert empty.select(token_count(F.col("text"), WORDS), piece_ids(F.col("text"), PIECES)).collect() == []


def longest_within(library, text, budget):
    """Characters of the longest prefix within a budget, by encoding every prefix."""
    return max(k for k in range(len(text) + 1) if len(library.encode(text[:k], add_special_tokens=False).ids) <= budget)


def test_budgets_equal_all_prefixes():
    library, own = Tokenizer.from_file(WORDS), counter(WORDS)
    rng = random.Random(9)
    letters = "中文字かなабвé'rtüß1.!" + "é" + "<|"
    some = ["".join(rng.choices(letters, k=rng.randrange(1, 25))) for _ in range(250)]
    some += ["don't", "we're", "они'll", "x<|endoftext|>中文", "中<|endoftext|", "<|startoftext|><|endoftext|>a", "éé", "ΑΣ", "straße"]
    for text in some:
        for budget in (0, 1, 2, 5, 9):
            want = text[:longest_within(library, text, budget)]
            got = text.encode()[:own.fit(text.encode(), budget)].decode()
            # white space after the last token counts nothing, and there is none here
            assert got == want, (text, budget)


def test_budget_of_a_text_without_spaces_is_quick():
    own = counter(WORDS)
    text = "汉字" * 50_000
    start = time.process_time()
    assert 0 < own.fit(text.encode(), 5) < 100
    at = own.fit(text.encode(), 1000)
    assert time.process_time() - start < 2
    library = Tokenizer.from_file(WORDS)
    kept = text.encode()[:at].decode()
    assert len(library.encode(kept, add_special_tokens=False).ids) <= 1000
    assert len(library.encode(text[:len(kept) + 1], add_special_tokens=False).ids) > 1000
