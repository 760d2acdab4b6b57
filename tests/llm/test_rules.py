"""Quality rules, URL rules, licences and mixing."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tablelens.llm import licenses, mixing, quality, queries, url_rules


def oracle(name, **tables):
    connection = duckdb.connect()
    for table, (columns, rows) in tables.items():
        connection.execute(f"CREATE TABLE {table} ({columns})")
        if rows:
            connection.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    result = connection.execute(queries.all_oracles()[name])
    return [d[0] for d in result.description], result.fetchall()


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:]))
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_quality_measures(spark, odd_rows):
    texts = [t for _, t in odd_rows] + ["a b c a b c a b c", "a a a a a", "x y z\nx y z\n\nq\n \nx y z", "#|<> $5 a*b", "a b c d a b c e b c d"]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r["doc_id"]: tuple(r[m] for m in quality.MEASURES) for r in quality.ledger(df).collect()}
    for i, text in enumerate(texts):
        assert got[i] == brute_measures(text), (i, (text or "")[:40])
    assert quality.ledger(spark.createDataFrame([], "text string")).collect() == []


def test_ledger_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d", "own", "l", "h", "p", 5)]
    df = spark.createDataFrame(rows, "doc_id int, text string, __w string, __l string, __h string, __words string, __lines int")
    got = quality.ledger(df).first()
    assert (got["__w"], got["__l"], got["__h"], got["__words"], got["__lines"], got["n_words"]) == ("own", "l", "h", "p", 5, 4)


def test_policies_and_ablation(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    texts = [clean, "too few", "a b c " * 40, clean + " |||" * 40, " ".join("abcdefghijklmnopqrstuvwxyz"[i % 26] * 30 + str(i) for i in range(60))]
    df = spark.createDataFrame([(i, t, {"k": 1}) for i, t in enumerate(texts)], "doc_id int, text string, m map<string,int>")
    rated = quality.ledger(df).cache()
    kept = {r["doc_id"] for r in rated.where(quality.passes("v1")).collect()}
    assert kept == {0}
    assert [r["doc_id"] for r in quality.accepted(df).collect()] == [0]
    assert quality.accepted(df).columns == df.columns
    rules = {r["rule"]: (r["rejected"], r["rejected_alone"], r["kept_without"]) for r in quality.ablation(rated).collect()}
    for i, rule in enumerate(quality.RULES):
        failed = [r["failures"] for r in rated.collect()]
        assert rules[rule.name] == (sum(f >> i & 1 for f in failed), sum(f == 1 << i for f in failed), sum(f in (0, 1 << i) for f in failed))


URLS = [None, "", "no scheme", "http://", "HTTP://Sub.Example.NET/en/1?x#y", "https://example.net/de/1", "https://notexample.net/de/1", "https://example.com/de/x",
        "https://a.example.com/den", "https://x.example.org/fr/9", "https://org/fr/", "https://x.net", "https://x.net?q=/", "ftp://É.net/a b", "https://a://b.net/en/"]


def test_explicit_url_rules(spark):
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS)], "page_id int, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(df, queries.URL_RULES).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        assert got[i][:3] == (host, path, best.text if best else None), url
        if best:
            assert got[i][3] == best.verdict


def test_mined_rules_equal_counting(spark):
    rows = [(["a", "b"], "block")] * 30 + [(["a", "c"], "allow")] * 30 + [(["a", "b", "c"], "block")] * 10 + [(["d"], "block")] * 2 + [(["a", "e"], "block")] * 20 + [(["a", "e"], "allow")] * 10
    mined = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.05, 0.8).collect()
    got = {(tuple(r["tokens"]), r["verdict"]): round(r["confidence"], 6) for r in mined}
    assert got[("b",), "block"] == 1.0  # {a, b} and {b, c} say no more than {b}
    assert (("a", "b"), "block") not in got and (("d",), "block") not in got and (("e",), "block") not in got
    for (tokens, verdict), confidence in got.items():
        having = [label for t, label in rows if set(tokens) <= set(t)]
        assert confidence == round(having.count(verdict) / len(having), 6) >= 0.8 and having.count(verdict) >= 0.05 * len(rows)


def test_mined_rules_decide_other_urls(spark):
    rows = [f"http://s{i}.bad.net/casino/{i}" for i in range(40)] + [f"http://s{i}.good.org/fr/home/{i}" for i in range(40)]
    rows += ["http://new.com/casino/5", "http://other.com/home/2", "http://plain.com/x"]
    got = {r["url"]: r for r in url_rules.judge(spark.createDataFrame([(u,) for u in rows], "url string"), queries.URL_RULES).collect()}
    assert got["http://new.com/casino/5"]["verdict"] == "block" and got["http://new.com/casino/5"]["mined_rule"]
    assert got["http://other.com/home/2"]["verdict"] == "allow" and got["http://other.com/home/2"]["mined_rule"]
    assert got["http://plain.com/x"]["verdict"] == "allow"
    assert url_rules.judge(spark.createDataFrame([], "url string"), queries.URL_RULES).collect() == []


def test_tokens_that_always_go_together(spark):
    """Long lists of tokens that never part are mined as one, and every one of them still makes a rule."""
    words = [f"w{k}" for k in range(18)]
    rows = [(words + ["x"], "block")] * 30 + [(["y", "x"], "allow")] * 30 + [(["y"], "allow")] * 5
    found = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.05, 0.8).collect()
    got = {tuple(r["tokens"]): (r["verdict"], r["confidence"], r["first"]) for r in found}
    assert got == {(w,): ("block", 1.0, w) for w in words} | {("y",): ("allow", 1.0, "y")}


def test_url_column_of_a_written_name_and_hot_lists(spark):
    rows = [f"http://s{i}.bad.net/casino/{i}" for i in range(40)] + ["http://new.com/casino/5"] * 50
    df = spark.createDataFrame([(u, i) for i, u in enumerate(rows)], "HOST string, rule int")
    got = url_rules.judge(df, queries.URL_RULES, url_col="host").collect()
    assert len(got) == 90 and {r["verdict"] for r in got} == {"block"} and got[0].asDict().keys() == {"host", "path", "rule", "verdict", "mined_rule"}


def test_licenses(spark, odd_rows):
    mit = licenses.KNOWN_LICENSES["MIT"]
    texts = [mit, mit.upper().replace("\n", "  \n"), mit.replace("Copyright (c) <year> <copyright holders>", "Copyright (c) 1999-2003 Someone, Inc.\nCopyright 2004 Other"),
             mit.replace("sublicense", "sub-license"), mit + " more", "licensed under the APACHE licence, version 2.0", "Copyright (c) 2020 X", "x\rLicensed under CC BY NC 4.0"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + k, t) for k, (_, t) in enumerate(odd_rows)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, license string")
    got = {r["doc_id"]: r for r in licenses.scan(df, licenses.known_digests(spark)).collect()}
    assert [got[i]["license"] for i in range(8)] == ["MIT", "MIT", "MIT", "MIT", None, "Apache-2.0-notice", None, None]
    assert all(got[100 + k]["license"] is None for k in range(len(odd_rows)))
    _, want = oracle("op10_licenses", documents=("doc_id BIGINT, text VARCHAR", [r for r in rows if "\x00" not in (r[1] or "")]))
    assert all((got[i]["license_digest"], got[i]["license"]) == (d, name) for i, d, name in want)
    assert licenses.scan(df, licenses.known_digests(spark, {})).where("license IS NOT NULL").count() == 0


def test_neighbours_with_equivalent_spellings(spark, tmp_path):
    pairs = [("licence licence licence", "license license license"), ("per cent per cent a", "percent percent a"), ("sub licence favour", "sublicense favor"),
             ("a licencee", "a licencee"), ("x\nCopyright (c) 1999 A\nnon commercial", "x noncommercial")]
    df = spark.createDataFrame([(i, t, u) for i, (t, u) in enumerate(pairs)], "doc_id long, text string, other string")
    got = {r["doc_id"]: r for r in df.select("doc_id", licenses.canonical(F.col("text")).alias("c"), licenses.canonical(F.col("other")).alias("d")).collect()}
    assert [got[i]["c"] for i in range(len(pairs))] == [u for _, u in pairs] == [got[i]["d"] for i in range(len(pairs))]
    _, want = oracle("op10_licenses", documents=("doc_id BIGINT, text VARCHAR", [(i, t) for i, (t, _) in enumerate(pairs)]))
    found = {r["doc_id"]: r["license_digest"] for r in licenses.scan(df, licenses.known_digests(spark)).collect()}
    assert found == {i: d for i, d, _ in want}
    # whole texts from files, met with other case, punctuation and copyright lines
    body = "\n".join(f"{k}. The licensee may, in favour of \"others\", do thing {k}." for k in range(200))
    (tmp_path / "Long-1.0").write_text(f"Long License\nCopyright (C) 2001 Some One\n{body}\n")
    (tmp_path / "Empty").write_text(" \n")
    known = licenses.known_from_files(spark, str(tmp_path))
    texts = spark.createDataFrame([(1, "LONG LICENCE\n(c) 2020-2024 Somebody Else\n" + body.upper().replace("FAVOUR", "FAVOR").replace(".", " ;")), (2, body)], "doc_id int, text string")
    assert {r["doc_id"]: r["license"] for r in licenses.scan(texts, known).collect()} == {1: "Long-1.0", 2: None}


def brute_targets(sizes, most=3):
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        share = (total - sum(fixed.values())) / max(sum(weights[s] for s in free), 1)
        above = [s for s in free if share * weights[s] > most * sizes[s]]
        if not above:
            return fixed | {s: share * weights[s] for s in free}
        fixed |= {s: most * sizes[s] for s in above}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 1000, None: 50, "é": 5, "Z": 0}, {"a": 1}, {"a": 0}, {"x": 5, "y": 5, "z": 5, "w": 5}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix(spark, odd_rows):
    rows = [(i, t, "odd") for i, t in odd_rows] + [(1000 + i, "w " * (1 + i % 40), ["s0", "s1", None, "s3", "s4"][i % 5 if i % 3 else 0]) for i in range(1500)]
    df = spark.createDataFrame([(*r, 1, {"a": 1}) for r in rows], "doc_id long, text string, source string, size int, copies map<string,int>")
    once = mixing.copies(df).collect()
    assert sorted(map(str, once)) == sorted(map(str, mixing.copies(df.repartition(3)).collect()))
    by_source = {}
    for r in once:
        assert 0 <= r["copies"] <= 3 and r["size"] == len((r["text"] or "").encode().split())
        taken, _ = by_source.get(r["source"], (0, 0))
        by_source[r["source"]] = (taken + r["copies"] * r["size"], r["target"])
    assert {s: t for s, (_, t) in by_source.items()} == pytest.approx(brute_targets(dict(Counter({s: sum(r["size"] for r in once if r["source"] == s) for s in by_source}))))
    for source, (taken, target) in by_source.items():
        assert source == "odd" or abs(taken - target) <= 0.03 * target, (source, taken, target)
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in once)
    columns, want = oracle("op9_mixing", documents=("doc_id BIGINT, text VARCHAR, source VARCHAR", [r for r in rows if "\x00" not in (r[1] or "")]))
    at = columns.index("copies")
    plain = df.where(~F.coalesce(F.col("text"), F.lit("")).contains("\x00"))
    assert Counter(r[at] for r in want) == Counter(r["copies"] for r in mixing.copies(plain).collect())
    assert mixing.mixed(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
