"""Quality rules with risk-controlled thresholds.

A rule measures a ratio of a document and rejects it above a cutoff. Cutoffs aren't chosen by hand. The rules' candidate cutoffs
form one sequence of levels: level 1 has only the loosest cutoff of the first rule, each next level tightens one rule by one cutoff, in turn.
Labelled good documents (the holdout) say how many of them a level would reject, by all its rules together, and the exact
binomial distribution says whether that proves a false rejection rate of at most alpha: P(X <= k) for X ~ Binomial(n, alpha) is the
p-value of "the rate is above alpha" when k of n good documents are rejected.

The levels of a stratum are tested in their fixed order, loosest first, and testing stops at the first that fails, so all tests of a
stratum share one error level (a level beyond a true limit is only reached through a false one). Strata share delta by Bonferroni. Hence with
confidence 1 - delta the levels of all strata at once keep their promise: of the good documents that the base rules pass, at most alpha are rejected.
A stratum whose first level fails rejects nothing.

Only DataFrame functions run here. Defined results: a null text has no words; documents that fail the base rules are not
in the holdout; a null stratum is a stratum of its own; labels that contradict each other count as not good; labels without a
document are ignored; repeated rows are judged each by itself; an empty table gives no rows; other columns
are ignored. Repeated windows are found by 64-bit hashes of their three words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SPACE, save, text_or_empty

GAPS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """value: a column over the features; a document goes if it is above the cutoff."""

    name: str
    value: Column
    cutoffs: tuple[float, ...]


#: Candidate cutoffs of each rule, as many for each.
CUTOFFS = {
    "symbols": (0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0),
    "marks": (0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0),
    "repeats": (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4),
    "long_words": (6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0),
    "dup_lines": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6),
}


def rules() -> tuple[Rule, ...]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    values = {
        "symbols": F.col("n_symbols") / words,
        "marks": F.col("n_marks") / words,
        "repeats": F.col("n_repeat_words") / words,
        "long_words": F.col("word_chars") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }
    return tuple(Rule(name, values[name], cuts) for name, cuts in CUTOFFS.items())


def features(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts of each document. Steps are separate selects, so each array is made once."""
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), text_or_empty(text_col).alias("text"))
    words = text.select(
        "doc_id",
        "stratum",
        F.array_remove(F.split("text", GAPS), "").alias("w"),
        (F.size(F.split("text", SYMBOLS)) - 1).alias("n_symbols"),
        (F.size(F.split("text", "!")) - 1).alias("n_marks"),
        F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "").alias("lines"),
    )
    counted = words.select(
        "doc_id",
        "stratum",
        F.size("w").alias("n_words"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        "n_symbols",
        "n_marks",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.expr("slice(transform(w, (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2))), 1, greatest(0, size(w) - 2))").alias("h"),
    )
    # most texts repeat no window: only the others sort theirs, by hash and place
    placed = counted.withColumn("s", F.expr("CASE WHEN size(array_distinct(h)) < size(h) THEN sort_array(transform(h, (x, i) -> struct(x AS h, i AS i))) END")).drop("h")
    again = placed.withColumn("p", F.expr("sort_array(transform(filter(transform(s, (x, i) -> struct(x.i AS i, coalesce(x.h = get(s, i - 1).h, false) OR coalesce(x.h = get(s, i + 1).h, false) AS twice)), x -> x.twice), x -> x.i))")).drop("s")
    covered = F.expr("coalesce(aggregate(p, struct(-3 AS stop, 0 AS n), (a, x) -> struct(x + 3 AS stop, a.n + least(3, x + 3 - a.stop) AS n)).n, 0)")
    out = again.withColumn("n_repeat_words", covered).drop("p")
    return out.select("doc_id", "stratum", *[F.col(c).cast("bigint") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_lines")])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed in log space; 1 where k is at or above the mean, which no test here accepts."""
    odds = math.log(p) - math.log1p(-p)
    start = F.struct((n * math.log1p(-p)).alias("term"), (n * math.log1p(-p)).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        high, low = F.greatest(acc["sum"], term), F.least(acc["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    below = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>")), start, step)["sum"]
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(below))


def rejected_from(rule: Rule, place: int, n_rules: int) -> Column:
    """The first level at which a rule, the place-th of n_rules, rejects the document; null if none does."""
    below = F.size(F.filter(F.array(*map(F.lit, rule.cutoffs)), lambda c: c < rule.value))
    return F.when(below > 0, n_rules * (len(rule.cutoffs) - below) + place + 1)


def cutoffs_of(level: int, chosen: tuple[Rule, ...] | None = None) -> dict[str, float]:
    """The cutoffs that are in force at a level."""
    chosen = chosen or rules()
    steps = {r.name: min(len(r.cutoffs), (level - place - 1) // len(chosen) + 1) for place, r in enumerate(chosen)}
    return {r.name: r.cutoffs[-steps[r.name]] for r in chosen if steps[r.name] > 0}


def levels(feats: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05, label_col: str = "quality", id_col: str = "doc_id", chosen: tuple[Rule, ...] | None = None) -> DataFrame:
    """stratum, level, n, k, p: the last level of each stratum's sequence that holds. Strata without one are left out."""
    chosen = chosen or rules()
    good = labels.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("good")).filter("good = 1")
    held = feats.filter(~base_failed()).join(good, feats["doc_id"] == good["__id"], "left_semi")
    first = F.array_min(F.array(*(rejected_from(r, i, len(chosen)) for i, r in enumerate(chosen))))
    n_levels = len(chosen) * max(len(r.cutoffs) for r in chosen)
    counts = [F.count_if(first <= t).alias(f"k{t}") for t in range(1, n_levels + 1)]
    wide = save(held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *counts), "quality-holdout")
    strata = max(1, wide.count())
    tests = F.explode(F.array(*(F.struct(F.lit(t).alias("level"), F.col(f"k{t}").alias("k")) for t in range(1, n_levels + 1))))
    tested = wide.select("stratum", "n", tests.alias("t")).select("stratum", "n", "t.*").withColumn("p", binomial_tail(F.col("k"), F.col("n"), alpha))
    # k, and p with it, never falls from level to level, so the levels that hold are the first ones
    sure = tested.filter(F.col("p") <= delta / strata)
    return sure.groupBy("stratum").agg(F.max_by(F.struct("level", "n", "k", "p"), "level").alias("c")).select("stratum", "c.*")


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05, text_col: str = "text", id_col: str = "doc_id", stratum_col: str = "lang") -> DataFrame:
    """doc_id, the counts, base_failed, kept and the names of the rules that the document breaks."""
    chosen = rules()
    feats = save(features(docs, text_col, id_col, stratum_col), "quality-features")
    # a row for each stratum: a written table, so Spark knows its size and picks the join by it
    limits = save(levels(feats, labels, alpha, delta, chosen=chosen).select(F.col("stratum").alias("__stratum"), "level"), "quality-limits")
    both = feats.join(limits, feats["stratum"].eqNullSafe(F.col("__stratum")), "left")
    broken = F.array_compact(F.array(*(F.when(rejected_from(r, i, len(chosen)) <= F.col("level"), F.lit(r.name)) for i, r in enumerate(chosen))))
    broken = F.coalesce(broken, F.array().cast("array<string>"))
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & (F.size(broken) == 0)).alias("kept"), broken.alias("broken"))
