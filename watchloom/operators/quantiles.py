"""Exact order statistics of any table by refined histograms: no task and not the driver holds more than the buckets.

A column's values between the least and the greatest are counted in BUCKETS ranges of equal width; the range that holds the wanted rank is counted again in
finer ranges between its own least and greatest value, until it holds one value only, or so few that their counts can be read. Each pass is one aggregation
with partial sums; a pass narrows the range by the number of buckets, so ordinary columns take two or three.

Nulls and NaN don't count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.landing import stored

#: Ranges of a pass for each wanted rank.
BUCKETS = 4096


@dataclass
class Search:
    """A rank (from 0) among the rows between low and high, below rows below them."""

    rank: int
    low: object
    high: object
    below: int
    rows: int


def _bucket(x: Column, low: object, high: object, whole: bool) -> Column:
    """The range of x, growing with x; whole numbers are subtracted as such before they are scaled."""
    if whole:
        share = (x.cast("decimal(38,0)") - F.lit(low).cast("decimal(38,0)")).cast("double") / float(int(high) - int(low))
    else:
        share = x / 2 - F.lit(low / 2)  # halves: the distance of two doubles may have no double
        share = share / (high / 2 - low / 2)
    return F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def order_statistics(rows: DataFrame, value: str | Column, ranks: list[int] | None = None, shares: list[float] | None = None) -> tuple[int, list]:
    """(number of values, the values at the given ranks from 0). shares: ranks as positions between 0 and 1, rounded down and up, in turn.

    Ranks below 0 count from the end. A rank that isn't there is None.
    """
    x = F.col(value) if isinstance(value, str) else value
    kept = rows.select(x.alias("x")).filter("x is not null")
    whole = kept.schema["x"].dataType.typeName() in ("byte", "short", "integer", "long")
    kept = stored(kept if whole else kept.select(F.col("x").cast("double").alias("x")).filter(~F.isnan("x")), "order-statistics")
    n, low, high = kept.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if shares is not None:
        ranks = [r for p in shares for r in (int(p * (n - 1)), -int(-p * (n - 1) // 1))] if n else [0, 0] * len(shares)
    ranks = [r + n if r < 0 else r for r in ranks]
    found = {r: None for r in ranks if not 0 <= r < n}
    open_ = [Search(r, low, high, 0, n) for r in sorted(set(ranks) - set(found))]
    while open_:
        found |= {s.rank: s.low for s in open_ if s.low == s.high}
        open_ = [s for s in open_ if s.low < s.high]
        if not open_:
            break
        spans = list(dict.fromkeys((s.low, s.high, s.below) for s in open_))
        each = F.array_compact(F.array(*(F.when(F.col("x").between(a, b), F.struct(F.lit(k).alias("k"), _bucket(F.col("x"), a, b, whole).alias("b"))) for k, (a, b, _) in enumerate(spans))))
        counts = kept.select("x", F.explode(each).alias("s")).groupBy("s.k", "s.b").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        by: dict[int, list] = {}
        for r in sorted(counts, key=lambda r: (r["k"], r["b"])):
            by.setdefault(r["k"], []).append(r)
        nxt = []
        for s in open_:
            below = s.below
            for r in by[spans.index((s.low, s.high, s.below))]:
                if s.rank < below + r["n"]:
                    nxt.append(Search(s.rank, r["low"], r["high"], below, r["n"]))
                    break
                below += r["n"]
        open_ = nxt
    return n, [found[r] for r in ranks]


def percentiles(rows: DataFrame, value: str | Column, shares: list[float]) -> list[float | None]:
    """The percentiles at shares between 0 and 1, between two values by their distance (as percentile and quantile_cont do); None of no rows."""
    n, at = order_statistics(rows, value, shares=shares)
    out = []
    for k, p in enumerate(shares):
        low, high = at[2 * k : 2 * k + 2]
        out.append(None if low is None else float(low) + (float(high) - float(low)) * (p * (n - 1) - int(p * (n - 1))))
    return out


def one_row(rows: DataFrame, **values: float | int | None) -> DataFrame:
    """A table of one row with these numbers."""
    return rows.sparkSession.range(1).select(*(F.lit(v).cast("int" if isinstance(v, int) else "double").alias(k) for k, v in values.items()))


def number_of(rows: DataFrame, name: str) -> Column | None:
    """A column as a number in the same order: days of a date, microseconds of a timestamp; None if it has none (texts)."""
    kind, c = rows.schema[name].dataType.typeName(), F.col(name)
    if kind in ("byte", "short", "integer", "long", "float", "double"):
        return c
    if kind == "date":
        return F.unix_date(c)
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "timestamp_ntz":  # from its parts, since time zones skip and repeat hours
        seconds = F.unix_date(F.to_date(c)).cast("bigint") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
        return seconds * 1_000_000 + (F.expr(f"extract(SECOND FROM `{name}`)") * 1_000_000).cast("bigint")
    return None


def largest(rows: DataFrame, k: int, by: Column, tie: Column) -> DataFrame:
    """The k rows with the greatest by (a number), of equals those with the least tie (a number); rows without a number come last.

    Thresholds are searched for, then rows are filtered by them: no sort, and no task that holds k rows. Of rows alike in by and tie any may stay.
    """
    if k <= 0:
        return rows.limit(0)
    first, second = "__by", "__tie"
    marked = rows.withColumns({first: by, second: tie})
    _, (cut,) = order_statistics(marked, first, [-k])
    sure, equal = (F.col(first).isNotNull(), F.col(first).isNull()) if cut is None else (F.col(first) > cut, F.col(first) == cut)
    left = k - marked.filter(sure).count()
    kept, rest = marked.filter(sure), marked.filter(equal)
    n, (last,) = order_statistics(rest, second, [left - 1])
    if last is not None:
        nearer = F.col(second) < last
        kept, rest, left = kept.unionByName(rest.filter(nearer)), rest.filter(F.col(second) == last), left - rest.filter(nearer).count()
    else:  # the rows with a tie are too few
        kept, rest, left = kept.unionByName(rest.filter(F.col(second).isNotNull())), rest.filter(F.col(second).isNull()), left - n
    return (kept.unionByName(rest.limit(left)) if left > 0 else kept).drop(first, second)
