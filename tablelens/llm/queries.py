"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm import (
    caps,
    fill_middle,
    hard_negatives,
    language_model,
    licenses,
    mixing,
    pieces,
    quality,
    secrets,
    simhash,
    token_counts,
    toxicity,
    url_rules,
)

Query = Callable[[SparkSession, str], DataFrame]

# The explicit rules of the URL query.
URL_RULES = [
    url_rules.PrefixRule("block", "net", "/"),
    url_rules.PrefixRule("allow", "example.net", "/en/"),
    url_rules.PrefixRule("block", "example.com", "/de/"),
    url_rules.PrefixRule("allow", "org", "/fr/"),
]
TOXIC_FROM = 0.3
TOKEN_LIMIT = 2048


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold(id_col: str, folds: int, held: int) -> Column:
    """Whether a row belongs to the fold that is held out; a null id does not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held, F.lit(False))


def op1_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Every text encoded, and whether decoding gives it back."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    done = table(spark, sf, "documents").select("doc_id", pieces.coded(F.col("text"), path).alias("c"))
    return done.select("doc_id", F.size("c.piece_ids").cast("long").alias("n_pieces"), "c.piece_ids", "c.round_trip")


def op2_language_model(spark: SparkSession, sf: str) -> DataFrame:
    scored = language_model.scores(table(spark, sf, "documents"), fold("doc_id", 5, 1))
    return scored.withColumnRenamed("id", "doc_id")


def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf, "documents"), shingle=3, distance=2)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op4_embedding_caps(spark: SparkSession, sf: str) -> DataFrame:
    found = caps.cap_components(table(spark, sf, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
                        F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op5_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    counted = table(spark, sf, "documents").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        token_counts.token_count(F.col("text"), path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = url_rules.judge(table(spark, sf, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "mined_rule")


def toxicity_model(spark: SparkSession, sf: str) -> toxicity.Model:
    labels = table(spark, sf, "labels").where(~fold("doc_id", 4, 2))
    return toxicity.train(table(spark, sf, "documents"), labels)


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    model = toxicity_model(spark, sf)
    scored = table(spark, sf, "documents").select(
        "doc_id", fold("doc_id", 4, 2).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    rated = quality.ledger(table(spark, sf, "documents").select("doc_id", "text"))
    return rated.select("doc_id", *quality.MEASURES, "failures",
                        (~quality.passes("base")).alias("base_failed"), quality.passes("v1").alias("kept"))


OP8_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM documents),
windows AS (
    SELECT row_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
    FROM d, unnest(range(1, greatest(1, len(w)::BIGINT - 1))) AS r(i)),
again AS (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, g) AS c FROM windows),
covered AS (
    SELECT row_id, count(DISTINCT i + k) AS n
    FROM again, (VALUES (0), (1), (2)) AS s(k) WHERE c > 1 GROUP BY row_id),
m AS (
    SELECT doc_id, len(w)::BIGINT AS n_words,
           length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
           (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
           coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM d LEFT JOIN covered USING (row_id)),
f AS (
    SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
            + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
            + (CASE WHEN n_words > 1000000 THEN 4 ELSE 0 END)
            + (CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END)
            + (CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END)
            + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 32 ELSE 0 END)
            + (CASE WHEN n_lines > 3 AND 10 * n_dup_lines > 3 * n_lines THEN 64 ELSE 0 END) AS failures
    FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures::BIGINT AS failures,
       (failures & 3) != 0 AS base_failed, failures = 0 AS kept
FROM f
"""


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    planned = mixing.copies(table(spark, sf, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"),
                          F.col("copies").cast("long").alias("copies"))


OP9_SQL = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) AS k
    FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (
    SELECT *, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) AS place FROM s),
w AS (SELECT *, [5.0, 2.0, 1.0][((place - 1) % 3) + 1]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS most FROM p),
r AS (
    SELECT *, (sum(source_size) OVER ())::DOUBLE
              - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
           sum(weight) OVER ()
              - coalesce(sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_rest
    FROM w),
lv AS (
    SELECT rest / weight_rest AS level FROM r
    WHERE rest / weight_rest * weight <= most ORDER BY most / weight, place LIMIT 1),
t AS (
    SELECT source, source_size,
           CASE WHEN (SELECT level FROM lv) IS NULL OR (SELECT level FROM lv) * weight >= most THEN most
                ELSE (SELECT level FROM lv) * weight END AS target
    FROM r),
x AS (
    SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END::DOUBLE AS rate FROM t),
draws AS (
    SELECT d.source, seed, sum(CASE WHEN ('0x' || substr(md5(seed::VARCHAR || ':' || k), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
                                         < rate - floor(rate) THEN size ELSE 0 END) AS got,
           any_value((rate - floor(rate)) * source_size) AS wanted
    FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source, range(32) AS g(seed)
    GROUP BY d.source, seed),
best AS (
    SELECT source, seed FROM draws QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(got - wanted), seed) = 1)
SELECT doc_id, size, x.source_size, x.target,
       c::BIGINT * size AS taken, c::BIGINT AS copies
FROM (
    SELECT d.*, least(3, floor(rate) + CASE WHEN ('0x' || substr(md5(seed::VARCHAR || ':' || k), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
                                                 < rate - floor(rate) THEN 1 ELSE 0 END) AS c
    FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source JOIN best ON d.source IS NOT DISTINCT FROM best.source) AS d
JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""


def op10_licenses(spark: SparkSession, sf: str) -> DataFrame:
    found = licenses.scan(table(spark, sf, "documents").select("doc_id", "text"), licenses.known_digests(spark))
    return found.select("doc_id", "license_digest", "license")


def _canonical_sql(text: str) -> str:
    form = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(13), 'abcdefghijklmnopqrstuvwxyz' || chr(10))"
    for _ in range(2):
        form = f"regexp_replace({form}, '{licenses.COPYRIGHT_LINE}', chr(10), 'g')"
    # every word gets two spaces of its own, so that neighbours share none
    form = f"'  ' || regexp_replace({form}, '[^a-z0-9]+', '  ', 'g') || '  '"
    for old, new in licenses.EQUIVALENT_SPELLINGS:
        form = f"replace({form}, ' {old.replace(' ', '  ')} ', ' {new} ')"
    return f"sha256(trim(regexp_replace({form}, ' +', ' ', 'g')))"


def op10_sql() -> str:
    listed = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.KNOWN_LICENSES.items())
    return f"""
WITH known AS (SELECT {_canonical_sql('t')} AS license_digest, min(name) AS license FROM (VALUES {listed}) AS k(name, t) GROUP BY 1)
SELECT doc_id, license_digest, license
FROM (SELECT doc_id, {_canonical_sql('text')} AS license_digest FROM documents) AS d LEFT JOIN known USING (license_digest)
"""


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    mined = hard_negatives.hard_negatives(rows.withColumn("label", shifted), F.col("vec_id") % 50 == 0)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


OP11_SQL = """
WITH r AS (
    SELECT row_number() OVER () AS row_id, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
    SELECT a.row_id AS anchor, a.vec_id AS anchor_id, b.row_id, b.vec_id, a.label = b.label AS same,
           list_dot_product(a.v, b.v)::BIGINT AS score
    FROM r AS a JOIN r AS b ON a.row_id != b.row_id AND len(a.v) = len(b.v)
    WHERE a.vec_id % 50 = 0),
p AS (
    SELECT anchor, anchor_id, row_id, vec_id, score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row_id) <= 5),
n AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
           (row_number() OVER (PARTITION BY p.anchor, p.row_id ORDER BY s.score DESC, s.vec_id, s.row_id))::INTEGER AS rank
    FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def op12_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").select("doc_id", secrets.secret_spans(F.col("text")).alias("found"))
    spans = F.col("found")
    counts = [secrets.of_kind(spans, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(secrets.strong_only(spans)), 256).alias("base_sha256"),
                        secrets.listed(spans).alias("spans"))


def op13_fill_middle(spark: SparkSession, sf: str) -> DataFrame:
    made = table(spark, sf, "documents").select("doc_id", fill_middle.fill_middle(F.col("text"), F.col("doc_id")).alias("m"))
    back = fill_middle.restored(F.col("m.output"), F.col("m.form"))
    return made.select("doc_id", "m.n", "m.form", "m.prefix_chars", "m.middle_chars",
                       F.sha2("m.output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP13_SQL = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
           sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digest
    FROM documents),
h AS (
    SELECT doc_id, text, u, len(u)::BIGINT AS n, ('0x' || digest[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || digest[9:16])::BIGINT % (len(u) + 1) AS y,
           ('0x' || digest[17:24])::BIGINT % 100 AS z, ('0x' || digest[25:32])::BIGINT % 100 AS w
    FROM d),
c AS (
    SELECT doc_id, text, n, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m,
           array_to_string(u[greatest(x, y) + 1:], '') AS s,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR z >= 90 THEN 'plain'
                WHEN w < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM h)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(p) END::BIGINT AS prefix_chars,
       CASE WHEN form != 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""


def all_queries() -> dict[str, Query]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_language_model": op2_language_model,
        "op3_simhash": op3_simhash,
        "op4_embedding_caps": op4_embedding_caps,
        "op5_token_counts": op5_token_counts,
        "op6_url_rules": op6_url_rules,
        "op7_toxicity": op7_toxicity,
        "op8_quality": op8_quality,
        "op9_mixing": op9_mixing,
        "op10_licenses": op10_licenses,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_secrets": op12_secrets,
        "op13_fill_middle": op13_fill_middle,
    }


def all_oracles() -> dict[str, str]:
    return {"op8_quality": OP8_SQL, "op9_mixing": OP9_SQL, "op10_licenses": op10_sql(),
            "op11_hard_negatives": OP11_SQL, "op13_fill_middle": OP13_SQL}
