"""Statistical functions as column expressions (whole-stage codegen or higher-order functions); one UDF, on a row a group, for the exact tail of U."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import cut_lineage


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1 by Stirling's series after shifting the argument by 8."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    shift = F.lit(0.0)
    for k in range(8):
        shift = shift + F.log(x + k)
    return series - shift


def log_choose(n: Column, k: Column) -> Column:
    n, k = n.cast("double"), k.cast("double")
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def hypergeom_sf(M: Column, K: Column, N: Column, X: Column) -> Column:
    """P(at least X of N draws are among K of M): the upper tail from X on.

    1 if X is at most 0, 0 if X is beyond min(K, N). The terms go by the
    ratio of neighbours from the first one, so each row needs one set of
    factorials whatever the number of terms. Terms further from the mode than
    40 standard deviations plus 800 add nothing that a double shows: the sum
    ends there, and a tail that begins so far below the mode is 1.
    """
    top = F.least(K, N).cast("long")
    low = F.greatest(X.cast("long"), F.lit(0), (K + N - M).cast("long"))
    share = F.coalesce(F.try_divide(K.cast("double"), M.cast("double")), F.lit(0.0))
    mode = F.floor((N.cast("double") + 1) * F.coalesce(F.try_divide(K.cast("double") + 1, M.cast("double") + 2), F.lit(0.0))).cast("long")
    reach = F.ceil(40 * F.sqrt(F.greatest(N.cast("double") * share * (1 - share), F.lit(0.0)))).cast("long") + 800
    first = log_choose(K, low) + log_choose(M - K, N - low) - log_choose(M, N)
    Kd, Nd, Md = K.cast("double"), N.cast("double"), M.cast("double")

    def step(acc, i):
        j = i.cast("double")
        ratio = (Kd - j) * (Nd - j) / ((j + 1) * (Md - Kd - Nd + j + 1))
        term = acc["t"] * ratio
        return F.struct((acc["s"] + term).alias("s"), term.alias("t"))

    end, certain = F.least(top, F.greatest(low, mode) + reach), low < mode - reach
    terms = F.when((low < end) & ~certain, F.sequence(low, end - 1)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(terms, F.struct(F.lit(1.0).alias("s"), F.lit(1.0).alias("t")), step)
    p = F.least(F.lit(1.0), F.exp(first) * tail["s"])
    return F.when(X > top, 0.0).when(certain | (X <= F.greatest(F.lit(0), (K + N - M).cast("long"))), 1.0).otherwise(p)


def fold_enrichment(M: Column, K: Column, N: Column, X: Column) -> Column:
    """(X / N) / (K / M), 0 where a division by zero would occur."""
    return F.coalesce(F.try_divide(F.try_divide(X.cast("double"), N.cast("double")), F.try_divide(K.cast("double"), M.cast("double"))), F.lit(0.0))


def normal_sf(z: Column) -> Column:
    """P(Z > z) of the standard normal: a series below 3, a continued fraction from 3 on."""
    a = F.abs(z)
    density = F.exp(-a * a / 2) / 2.5066282746310002
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(a.alias("s"), a.alias("t")),
        lambda acc, k: F.struct((acc["s"] + acc["t"] * a * a / (2 * k + 1)).alias("s"), (acc["t"] * a * a / (2 * k + 1)).alias("t")),
    )["s"]
    fraction = F.aggregate(F.reverse(F.sequence(F.lit(1), F.lit(60))), a, lambda acc, k: a + k / acc)
    upper = F.when(a < 3, 0.5 - density * series).otherwise(density / fraction)
    return F.when(z >= 0, upper).otherwise(1 - upper)


#: Ordered values are counted by this many buckets first, so that no task sorts all of them.
BUCKETS = 1024


def adjusted_bh(df: DataFrame, p: str, by: list[str] | None = None, out: str = "p_adj", ties: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg: the running minimum of p * m / rank from the largest p down, at most 1.

    ``by``: the families of tests; without it all rows are one family. Equal
    p-values get equal results (that of the last of them), so only distinct
    values are put in order, and these within buckets of p; ``ties`` is for
    callers that name an order and changes nothing.
    """
    keys = list(by or [])
    rows = cut_lineage(df)
    place = F.when(F.col(p) <= 0, 0).otherwise(F.greatest(F.lit(0), BUCKETS - 1 + F.floor(F.log2(p) * 16))).cast("int")
    counts = cut_lineage(rows.groupBy(*keys, p).agg(F.count("*").alias("_n")).withColumn("_b", place))
    family = Window.partitionBy(*keys).orderBy("_b")  # at most BUCKETS rows a family
    parts = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_nb"))
    parts = parts.withColumn("_base", F.coalesce(F.sum("_nb").over(family.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.withColumn("_m", F.sum("_nb").over(family.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).drop("_nb")
    inside = Window.partitionBy(*keys, "_b").orderBy(p)
    raw = cut_lineage(
        counts.join(parts, [*keys, "_b"]).withColumn("_raw", F.col(p) * F.col("_m") / (F.col("_base") + F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    )
    later = raw.groupBy(*keys, "_b").agg(F.min("_raw").alias("_least")).withColumn("_later", F.min("_least").over(family.rowsBetween(1, Window.unboundedFollowing))).drop("_least")
    best = F.least(F.lit(1.0), F.min("_raw").over(inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)), F.coalesce("_later", F.lit(1.0)))
    found = raw.join(later, [*keys, "_b"]).select(*keys, p, best.alias(out))
    return rows.join(found, [*keys, p]).select(*df.columns, out)


#: A range of values with so many rows or fewer is put in order in one task.
SORTED_ROWS = 10_000


def quantiles(df: DataFrame, value: str, points: list[float], by: list[str] | None = None) -> DataFrame:
    """``by``, n and quantiles (an array): exact order statistics with linear interpolation; nulls are left out.

    Counts by range of values show in which range each wanted place lies; only
    ranges that hold one are looked at again, until they have one value or
    ``SORTED_ROWS`` rows, so no task holds a group. Each look is a scan with a
    partial aggregation; a value that many rows share is a range of its own.
    """
    keys = list(by or [])
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    whole = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).filter("n > 0")
    if keys:
        whole = whole.withColumn("_g", F.struct(*keys))
    whole = cut_lineage(whole)
    place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    wanted = F.array_distinct(F.array(*[f(place(p)).cast("long") for p in points for f in (F.floor, F.ceil)]))
    # Ranges that hold wanted places: their values, the rows before them, their rows, the places.
    ranges = whole.select(*keys, "lo", "hi", F.lit(0).cast("long").alias("base"), F.col("n").alias("m"), wanted.alias("places"))
    known = None
    while True:
        settled = ranges.filter("lo = hi").select(*keys, F.explode("places").alias("place"), F.col("lo").alias("at"))
        few = ranges.filter(f"lo <> hi and m <= {SORTED_ROWS}")
        inside = _in_ranges(rows, few, keys)
        order = Window.partitionBy(*keys, "lo").orderBy("_v")  # SORTED_ROWS rows at most
        sorted_out = inside.groupBy(*keys, "lo", "base", "places", "_v").agg(F.count("*").alias("c")).withColumn("upto", F.col("base") + F.sum("c").over(order))
        sorted_out = sorted_out.select(*keys, F.explode(F.filter("places", lambda k: (k < F.col("upto")) & (k >= F.col("upto") - F.col("c")))).alias("place"), F.col("_v").alias("at"))
        found = settled.unionByName(sorted_out)
        known = found if known is None else known.unionByName(found)
        many = ranges.filter(f"lo <> hi and m > {SORTED_ROWS}")
        if not many.limit(1).count():
            break
        span = (F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        middle = F.when(F.isnan(span) | span.isNull(), BUCKETS // 2).otherwise(F.floor(span * BUCKETS))
        part = F.when(F.col("_v") == F.col("lo"), 0).when(F.col("_v") == F.col("hi"), BUCKETS - 1).otherwise(F.least(F.greatest(middle, F.lit(0)), F.lit(BUCKETS - 1))).cast("int")
        counts = _in_ranges(rows, many, keys).withColumn("_b", part).groupBy(*keys, "lo", "base", "places", "_b").agg(F.count("*").alias("m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        over = Window.partitionBy(*keys, "lo").orderBy("_b")  # BUCKETS rows at most
        counts = counts.withColumn("_base", F.col("base") + F.sum("m").over(over) - F.col("m"))
        counts = counts.withColumn("places", F.filter("places", lambda k: (k >= F.col("_base")) & (k < F.col("_base") + F.col("m")))).filter(F.size("places") > 0)
        ranges = cut_lineage(counts.select(*keys, F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_base").alias("base"), "m", "places"))
    values = known.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("place", "at"))).alias("values"))  # two for each point
    met = _matched(whole, values, keys)

    def between(p):
        low, high = (F.element_at("values", f(place(p)).cast("long")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low + (high - low) * (place(p) - F.floor(place(p))))

    return met.select(*keys, "n", F.array(*[between(p) for p in points]).alias("quantiles"))


def _matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A join on keys where nulls are equal; without keys ``right`` is one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"_r_{k}"])
    return left.join(right, on).drop(*[f"_r_{k}" for k in keys])


def _in_ranges(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that lie in a range of their group, with it; a group's ranges are disjoint and one row."""
    listed = ranges.groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi", "base", "places")).alias("_ranges"))
    met = _matched(rows, listed, keys).withColumn("_r", F.get(F.filter("_ranges", lambda r: (r["lo"] <= F.col("_v")) & (F.col("_v") <= r["hi"])), F.lit(0)))
    return met.filter("_r is not null").select(*keys, "_v", "_r.lo", "_r.hi", "_r.base", "_r.places")


def _sections(counts: DataFrame, value: str, n: str, descending: bool = False) -> DataFrame:
    """Counts by value in sections of values of about equal size, with the rows before each section (``_section``, ``_base``).

    For orders over a whole table: only values of a section are sorted together.
    """
    counts = cut_lineage(counts)
    shares = [k / BUCKETS for k in range(1, BUCKETS)]
    cuts = counts.agg(F.percentile_approx(value, F.array(*[F.lit(x) for x in shares]), 10_000).alias("_cuts"))  # one row
    at = F.size(F.filter("_cuts", lambda c: c <= F.col(value)))
    dealt = counts.crossJoin(F.broadcast(cuts)).withColumn("_section", at if not descending else -at).drop("_cuts")
    before = Window.orderBy("_section").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows
    bases = dealt.groupBy("_section").agg(F.sum(n).alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    return dealt.join(F.broadcast(bases), "_section")


def rows_before(counts: DataFrame, value: str, n: str, by: list[str] | None = None, descending: bool = False, out: str = "_before") -> DataFrame:
    """The rows before each value, from counts ``n`` by value (in each group of ``by``)."""
    keys = list(by or [])
    order = F.desc(value) if descending else F.asc(value)
    if keys:
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn(out, F.coalesce(F.sum(n).over(window), F.lit(0)))
    inside = Window.partitionBy("_section").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = _sections(counts, value, n, descending)
    return placed.withColumn(out, F.col("_base") + F.coalesce(F.sum(n).over(inside), F.lit(0))).drop("_section", "_base")


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None, out: str = "avg_rank") -> DataFrame:
    """Ranks from 1 where equal values share the mean of their places.

    Ranks run over distinct values with their counts, so a value that most
    rows share is one row in the window; without groups the values are sorted
    by sections.
    """
    keys = list(by or [])
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = rows_before(counts, value, "_n", keys).withColumn(out, F.col("_before") + (F.col("_n") + 1) / 2).drop("_n", "_before")
    return df.join(placed, [*keys, value])


def mann_whitney(df: DataFrame, value: str, side: str, by: list[str] | None = None, alternative: str = "greater") -> DataFrame:
    """n1, n2, u1, z, p for the boolean ``side`` (true: first sample) against the rest.

    Tie-corrected normal approximation with continuity correction of a half;
    only counts by distinct value are sorted. In a group without ties whose
    smaller sample has 1 to 8 members p is from the exact distribution.
    """
    counts = df.groupBy(*(by or []), value).agg(F.count_if(F.col(side)).alias("a"), F.count_if(~F.col(side)).alias("b"))
    return mann_whitney_counts(counts, value, by, alternative)


def mann_whitney_counts(counts: DataFrame, value: str, by: list[str] | None = None, alternative: str = "greater") -> DataFrame:
    """``mann_whitney`` from the counts a and b of both samples by distinct value; ``alternative`` may be two-sided here (always by the normal approximation)."""
    keys = list(by or [])
    t = F.col("a") + F.col("b")
    placed = rows_before(counts.withColumn("t", t), value, "t", keys).withColumn("r", F.col("_before") + (t + 1) / 2)
    sums = placed.groupBy(*keys).agg(
        F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * F.col("r")).alias("r1"), F.sum((t * t * t - t).cast("double")).alias("ties")
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    u = F.greatest(u1, n1 * n2 - u1) if alternative == "two-sided" else u1 if alternative == "greater" else n1 * n2 - u1
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.coalesce(F.try_divide(F.col("ties"), n * (n - 1)), F.lit(0.0))))
    z = F.try_divide(u - n1 * n2 / 2 - 0.5, sd)
    if alternative == "two-sided":
        return sums.select(*keys, "n1", "n2", u1.alias("u1"), z.alias("z"), F.least(2 * normal_sf(z), F.lit(1.0)).alias("p"))
    exact = F.udf(_small_u_tail, "double")("n1", "n2", u, "ties")  # on one row a group
    return sums.select(*keys, "n1", "n2", u1.alias("u1"), z.alias("z"), F.coalesce(exact, normal_sf(z)).alias("p"))


@lru_cache(maxsize=16)
def _arrangements(n1: int, n2: int) -> list[int]:
    """The number of arrangements without ties by U."""
    ways = [1] + [0] * (n1 * n2)
    for i in range(1, n1 + 1):
        # Gaussian binomial: multiply by (1 - q^(n2+i)) / (1 - q^i).
        for s in range(n1 * n2, n2 + i - 1, -1):
            ways[s] -= ways[s - n2 - i]
        for s in range(i, n1 * n2 + 1):
            ways[s] += ways[s - i]
    return ways


def exact_u_tail(n1: int, n2: int, u: float) -> float:
    """P(U >= u) without ties, by counting arrangements (small samples only)."""
    ways = _arrangements(min(n1, n2), max(n1, n2))  # the same for both orders
    return sum(w for s, w in enumerate(ways) if s >= u) / sum(ways)


def _small_u_tail(n1: int, n2: int, u: float, ties: float) -> float | None:
    """The exact tail where the rule asks for it, else None."""
    return exact_u_tail(n1, n2, u) if ties == 0 and 1 <= min(n1, n2) <= 8 else None


def mann_whitney_exact(df: DataFrame, value: str, side: str, alternative: str = "greater", small: int = 8) -> float:
    """The p-value by the rule "exact if the smaller sample has at most 8 members and no ties"."""
    row = mann_whitney(df, value, side, alternative=alternative).first()
    ties = df.groupBy(value).count().filter("count > 1").limit(1).count()
    if ties or min(row["n1"], row["n2"]) > small:
        return row["p"]
    u = row["u1"] if alternative == "greater" else row["n1"] * row["n2"] - row["u1"]
    return exact_u_tail(int(row["n1"]), int(row["n2"]), u)
