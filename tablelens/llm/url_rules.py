"""URL filter by association rules.

A few explicit rules (host and path prefix) decide the urls they fit; their
verdicts are the labels.  FP-growth mines which combinations of url tokens go
with which label; rules below a support or confidence, or not better than a
rule with fewer tokens, are pruned.  The rest are matched by an inverted index
on the rarest token of each rule and verified whole.  The rules' number is
bounded by the support, not by the urls.

Special cases: a null url, or one without "://", has an empty host and path, no
tokens, and gets the default verdict; equal rows are judged each; without any
labelled url there are no mined rules and the default holds; ties between rules
go to the higher confidence, then support, then the smaller token list; other
columns are carried along, and those with the name of a column written here are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import cut, free_name, quoted, without

DEFAULT_VERDICT = "allow"
LABEL_MARK = "="
MOST_TOKENS = 3


@dataclass(frozen=True)
class PrefixRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parsed(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: parts of the host, and of the path with numbers made one token."""
    parts = lambda text, mark: F.transform(
        F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: t != ""),
        lambda t: F.concat(F.lit(mark), F.when(t.rlike("^[0-9]+$"), F.lit("0")).otherwise(F.lower(t))))
    return F.array_sort(F.array_distinct(F.concat(parts(host, "h:"), parts(path, "p:"))))


def explicit(host: Column, path: Column, rules: list[PrefixRule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, the earlier of equally long ones; else nulls."""
    longest_first = sorted(rules, key=lambda r: -len(r.text))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(longest_first):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def _merged(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tokens, label) with tokens that always occur together made one, and (token, stands_for) of all.

    Tokens occur together if their rows are the same: equal numbers of rows and
    equal sums of two hashes over them.  The smallest stands for the others, so
    that a list of many such tokens has few item sets.
    """
    rows = cut(labelled.withColumn("row", F.monotonically_increasing_id()))
    # decimals, since sums of hashes go beyond a long
    sums = [F.sum(F.xxhash64("row", F.lit(k)).cast("decimal(20,0)")).alias(f"s{k}") for k in (1, 2)]
    seen = rows.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), *sums)
    # one entry per token and no list of them: a class may be large
    least = seen.groupBy("n", "s1", "s2").agg(F.min("token").alias("stands_for"))
    classes = cut(seen.join(least, ["n", "s1", "s2"]).select(F.col("stands_for"), "token"))
    kept = classes.where("stands_for = token").select(F.col("token"))
    each = rows.select("row", F.explode_outer("tokens").alias("token")).join(kept, "token", "left_semi")
    lists = each.groupBy("row").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    merged = rows.select("row", "label").join(lists, "row", "left")
    return merged.select(F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), "label"), classes


def mine(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.8) -> DataFrame:
    """(tokens, verdict, confidence, support, first) from (tokens, label); first is the rarest token.

    FP-growth runs over the token lists with the label as one more item.  Tokens
    that never part are one item there, and each of them makes the rule
    afterwards.  A rule has to beat the share its verdict has among all labels.
    """
    if labelled.isEmpty():
        return labelled.sparkSession.createDataFrame([], "tokens array<string>, verdict string, confidence double, support double, first string")
    merged, classes = _merged(labelled)
    items = merged.select(F.concat("tokens", F.array(F.concat(F.lit(LABEL_MARK), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    is_label = lambda t: t.startswith(LABEL_MARK)
    rules = model.associationRules.where(is_label(F.element_at("consequent", 1)) & (F.size("antecedent") <= MOST_TOKENS)
                                         & ~F.exists("antecedent", is_label))
    # at a lift of one a rule is as sure as no rule
    rules = rules.where((F.col("lift") > 1) | (F.col("confidence") == 1))
    rules = cut(rules.select(F.array_sort("antecedent").alias("tokens"), F.expr(f"substring(consequent[0], {len(LABEL_MARK) + 1})").alias("verdict"),
                             "confidence", "support"))
    # a rule goes if one with some of its tokens is as sure of the same verdict
    fewer = F.filter(F.expr("""concat(array(cast(array() AS array<string>)), transform(tokens, t -> array(t)),
        transform(tokens, t -> array_remove(tokens, t)))"""), lambda s: F.size(s) < F.size("tokens"))
    shorter = rules.select(F.col("tokens").alias("part"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    beaten = rules.select("tokens", "verdict", "confidence", F.explode(F.array_distinct(fewer)).alias("part"))
    beaten = beaten.join(shorter, "part").where("v = verdict AND c >= confidence").select("tokens", "verdict").distinct()
    kept = rules.join(beaten, ["tokens", "verdict"], "left_anti")
    # any token of a class may stand where the class does; two of one class would say no more than one
    members = classes.select(F.col("stands_for"), F.col("token").alias("member"))
    for place in range(MOST_TOKENS):
        kept = kept.join(members, F.get("tokens", F.lit(place)) == F.col("stands_for"), "left").withColumn("tokens", F.expr(
            f"transform(tokens, (t, i) -> if(i = {place}, coalesce(member, t), t))")).drop("stands_for", "member")
    kept = kept.withColumn("tokens", F.array_sort("tokens"))
    # how often each token occurs, among the single items FP-growth counted
    counts = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("stands_for"), "freq")
    counts = counts.join(classes, "stands_for").select(F.col("token").alias("first"), "freq")
    each = kept.select("*", F.explode("tokens").alias("first")).join(counts, "first")
    rarest = each.groupBy("tokens", "verdict", "confidence", "support").agg(F.min(F.struct("freq", "first"))["first"].alias("first"))
    return cut(rarest)


#: Parts that the pages of one token list are dealt to; the matches, one row per list, are copied to each.
LIST_PARTS = 16


def judge(pages: DataFrame, rules: list[PrefixRule], url_col: str = "url", min_support: float = 0.005,
          min_confidence: float = 0.8, default: str = DEFAULT_VERDICT) -> DataFrame:
    """The table with host, path, rule (explicit, else null), mined_rule (else null) and verdict."""
    name = free_name(pages, "__url")
    host, path = parsed(quoted(url_col))
    rule, verdict = explicit(F.col("host"), F.col("path"), rules)
    # urls repeat, and their token lists even more: each list is matched once
    seen = pages.select(host.alias("host"), path.alias("path")).withColumns({"rule": rule, "label": verdict, "tokens": url_tokens(F.col("host"), F.col("path"))})
    mined = mine(seen.where("label IS NOT NULL").select("tokens", "label"), min_support, min_confidence)
    lists = seen.where("label IS NULL").select("tokens").distinct()
    index = mined.select(F.struct(F.col("confidence").alias("c"), F.col("support").alias("s"), F.size("tokens").alias("n"), F.col("tokens").alias("t"),
                                  F.col("verdict").alias("v")).alias("r"), F.col("first").alias("token"))
    hits = lists.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    hits = hits.where(F.size(F.array_except(F.col("r")["t"], F.col("tokens"))) == 0)
    # surest first; the order of the struct after signs are turned
    rank = F.struct((-F.col("r")["c"]).alias("c"), (-F.col("r")["s"]).alias("s"), F.col("r")["n"].alias("n"), F.col("r")["t"].alias("t"), F.col("r")["v"].alias("v"))
    best = hits.groupBy("tokens").agg(F.min(rank).alias("best"))
    best = best.select(F.col("tokens").alias(name + "t"), F.concat_ws(" ", F.col("best")["t"]).alias(name + "m"), F.col("best")["v"].alias(name + "v"),
                       F.explode(F.sequence(F.lit(0), F.lit(LIST_PARTS - 1))).alias(name + "q"))

    # the url is read before columns of the names written here go
    read = pages.withColumns({name + "h": host, name + "p": path})
    out = without(read, ["host", "path", "rule", "verdict", "mined_rule"])
    out = out.withColumnsRenamed({name + "h": "host", name + "p": "path"}).withColumn("rule", rule).withColumn("verdict", verdict)
    # decided urls need no list; they get a key that meets nothing and spreads over all tasks
    tokens = F.when(F.col("verdict").isNull(), url_tokens(F.col("host"), F.col("path")))
    out = out.withColumns({name: tokens, name + "r": F.pmod(F.monotonically_increasing_id(), F.lit(LIST_PARTS)).cast("int")})
    out = out.join(best, (F.col(name) == F.col(name + "t")) & (F.col(name + "r") == F.col(name + "q")), "left")
    mined_rule = F.when(F.col("verdict").isNull(), F.col(name + "m"))
    return out.withColumn("mined_rule", mined_rule).withColumn(
        "verdict", F.coalesce("verdict", F.col(name + "v"), F.lit(default))).drop(name, *(name + x for x in "tmvqr"))
