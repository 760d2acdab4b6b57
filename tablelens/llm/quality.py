"""Quality rules as a ledger of failure bits.

Every rule is evaluated once a text: its measurement is stored, and a failure
sets the rule's bit in one mask.  Policies are versioned sets of bits; applying
one, or taking rules out of it (an ablation), is bitwise work on the stored
masks and reads no text again.  Only Spark's own expressions are used.

Special cases: a null text counts as empty and has no words; an empty text
fails the word count alone (ratios over no words pass); equal rows are rated
each; other columns are carried along, and those with the name of a column
written here are replaced.  64-bit hashes stand for three-word windows when
repeats are looked for inside one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import SPACES, SPACE_RUN, free_name, quoted, without, words

SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """A failure test over the measurements, in SQL."""

    name: str
    fails: str


#: A rule's place is its bit; new rules go to the end, so stored masks stay readable.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_words", "n_words > 1000000"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "n_lines > 3 AND 10 * n_dup_lines > 3 * n_lines"),
)
#: Policies by version.  A policy says which bits reject a text.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "many_words", "short_words", "long_words", "symbols", "repeated_lines"),
}


def rule_bits(names: tuple[str, ...] | list[str]) -> int:
    known = {rule.name: i for i, rule in enumerate(RULES)}
    return sum(1 << known[name] for name in names)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The table with one column per measurement (long)."""
    out = without(docs, [*MEASURES, "n_lines"])
    parts, rows, hashes, again = (free_name(out, f"__{stem}") for stem in ("words", "lines", "hashes", "again"))
    text = F.coalesce(quoted(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, SPACES, "") != "")
    out = out.withColumn(parts, words(quoted(text_col))).withColumn(rows, lines)
    out = out.withColumns({
        "n_words": F.size(parts).cast("long"),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(rows).cast("long"),
        "n_dup_lines": (F.size(rows) - F.size(F.array_distinct(rows))).cast("long"),
        hashes: _window_hashes(F.col(parts)),
    }).drop(parts, rows)
    out = out.withColumn(again, _repeated_starts(F.col(hashes))).drop(hashes)
    return out.withColumn("n_repeat_words", _covered(F.col(again), 3)).drop(again)


def _window_hashes(parts: Column) -> Column:
    """Hash of each three-word window, by its start."""
    starts = F.when(F.size(parts) >= 3, F.sequence(F.lit(0), F.size(parts) - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(
        F.concat_ws(" ", F.get(parts, i), F.get(parts, i + 1), F.get(parts, i + 2))))


def _repeated_starts(hashes: Column) -> Column:
    """Starts, in order, of the windows whose hash occurs twice or more."""
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = F.array_sort(pairs)

    def chosen(s: Column) -> Column:
        again = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        return F.array_sort(F.transform(again, lambda x: x["i"]))

    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    sorted_once = F.element_at(F.transform(F.array(ordered), chosen), 1)
    return F.when(some, sorted_once).otherwise(F.array().cast("array<int>"))


def _covered(starts: Column, width: int) -> Column:
    """Number of words under windows that begin at these ordered starts."""
    first = F.when(F.size(starts) > 0, F.lit(width)).otherwise(F.lit(0))
    steps = F.transform(starts, lambda s, k: F.when(k > 0, F.least(s - F.get(starts, k - 1), F.lit(width))).otherwise(F.lit(0)))
    return F.aggregate(steps, first.cast("long"), lambda a, x: a + x)


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The table with its measurements and `failures`, a long with bit i set if rule i fails."""
    out = measured(without(docs, ["failures"]), text_col)
    mask = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        mask = mask.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("failures", mask)


def passes(policy: str) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failures").bitwiseAND(F.lit(rule_bits(POLICIES[policy])).cast("long")) == 0


def accepted(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows that pass a policy, with the columns they had."""
    rated = ledger(docs.select(F.struct([quoted(c) for c in docs.columns]).alias("row"), quoted(text_col).alias("text")))
    # a filter would be pushed below the measurements, with each of them copied into it
    return rated.select(F.explode(F.when(passes(policy), F.array("row"))).alias("row")).select("row.*")


def ablation(kept_ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: rows it rejects, rows that only it rejects, rows kept without it.

    One aggregation over the failure masks: they are counted by value first,
    of which there are at most two to the number of rules.
    """
    bits = rule_bits(POLICIES[policy])
    masks = kept_ledger.groupBy(F.col("failures").bitwiseAND(F.lit(bits).cast("long")).alias("m")).count()
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit"))
                      for i, r in enumerate(RULES) if r.name in POLICIES[policy]])
    each = masks.select("m", "count", F.explode(rules).alias("r")).select("m", "count", "r.rule", "r.bit")
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("count"))), F.lit(0)).alias
    hit, only = F.col("m").bitwiseAND(F.col("bit")) != 0, F.col("m") == F.col("bit")
    return each.groupBy("rule").agg(total(hit)("rejected"), total(only)("rejected_alone"),
                                    total((F.col("m") == 0) | only)("kept_without"))
