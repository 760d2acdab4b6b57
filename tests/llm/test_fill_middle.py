from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tablelens.llm.fill_middle import Plan, fill_middle, restored


def brute(doc_id, text):
    """(n, form, output, prefix_chars, middle_chars) of one document."""
    text = text or ""
    found = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(found)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", text, None, None
    p, m, s = "".join(found[:a]), "".join(found[a:b]), "".join(found[b:])
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def rows_of(odd_rows):
    rng = random.Random(4)
    letters = list("abcXYZ <>PSM\n\t0é😀▁'") + ["<", ">", "<P", "S>", "\x00", "汉"]
    rows = [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(900, "a <P> b"), (901, "<M>"), (902, "x<S>"), (903, "a"), (904, "é"), (905, "汉字" * 2000), (-7, "negative id here")]
    return rows + odd_rows


@pytest.mark.parametrize("batch_bytes", [2 << 20, 100])
def test_equals_brute_force_and_gives_the_text_back(spark, odd_rows, batch_bytes):
    rows = rows_of(odd_rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, form string")
    made = df.select("doc_id", "text", fill_middle(F.col("text"), F.col("doc_id"), batch_bytes=batch_bytes).alias("m"))
    got = made.select("doc_id", "text", "m.*", restored(F.col("m.output"), F.col("m.form")).alias("back")).collect()
    assert len(got) == len(rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"]) == brute(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")


def test_other_markers_and_shares(spark):
    plan = Plan(prefix="[pre]", suffix="[suf]", middle="[mid]", plain_percent=0, spm_percent=100)
    df = spark.createDataFrame([(i, f"some text, number {i}.") for i in range(50)], "doc_id long, text string")
    made = df.select("text", fill_middle(F.col("text"), F.col("doc_id"), plan).alias("m"))
    got = made.select("text", "m.*", restored(F.col("m.output"), F.col("m.form"), plan).alias("back")).collect()
    assert {r["form"] for r in got} == {"spm"} and all(r["output"].startswith("[suf]") for r in got)
    assert all(r["back"] == r["text"] for r in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert df.select(fill_middle(F.col("text"), F.col("doc_id")).alias("m")).collect() == []
