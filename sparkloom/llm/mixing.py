"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws the key ``-ln(u) / w``: ``u`` in (0, 1) is a hash of its
id and a seed, ``w`` its quality weight. Ascending keys give an order in which
heavier documents tend to come first. For each source the target is cut into
complete epochs, which take every document whole, and a rest, which takes
documents in key order until its words are spent; the document at that line
gives only the words that are left, so targets are met exactly.

Nothing sorts a whole source. Keys fall into ``N_BUCKETS`` even buckets; sums
by (source, bucket) show in which bucket a source's rest ends, and only that
bucket's rows are ordered. The plan holds one row a source.

Defined results: null text has size 0; null sources form one source that
sorts last; null ids hash like any value; repeated rows are taken alike (they
share what is left at the line, rounded down); an empty table gives an empty
result; other columns are kept by ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, WORD, materialize, read_table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
N_BUCKETS = 1024
SEED = "mix-1"
#: Quality weights that are broadcast, at most.
SMALL_WEIGHTS = 500_000


def draw(seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on doc_id and the seed alone."""
    digest = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def words() -> Column:
    """The number of words of the text; 0 for null."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def keyed(rows: DataFrame, weight: Column, seed: str = SEED) -> DataFrame:
    """Adds the sampling key and its bucket to rows with mix_size."""
    return rows.withColumn("mix_key", -F.log(draw(seed)) / F.coalesce(weight, F.lit(1.0))).withColumn(
        "mix_bucket", F.least(F.floor((1 - F.exp(-F.col("mix_key"))) * N_BUCKETS), F.lit(N_BUCKETS - 1)).cast("int")
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from source, source_size.

    Sharing by weight, stopping at ``max_epochs`` times the size and sharing
    the excess again until nobody is above is water-filling: with sources in
    ascending order of size / weight, the first k stop and the others split
    the rest by weight, for the smallest k at which nobody else is above.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1)
    filled = (
        sizes.withColumn("w", weight)
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("source_size") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("w_left"))
        # The first source in this order that the level does not lift above its cap sets the level.
        .withColumn("settled", F.col("level") * F.col("w") <= F.col("cap"))
        .withColumn("final", F.min(F.when(F.col("settled"), F.struct("ratio", F.col("source").isNull().alias("n"), "source", "level"))).over(everything).getField("level"))
    )
    return filled.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.col("final")).alias("target"))


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row a source: size, target, epochs and where its rest ends.

    ``rows``: source, doc_id, mix_size, mix_key, mix_bucket.
    """
    sums = materialize(
        rows.groupBy("source", "mix_bucket").agg(F.sum("mix_size").alias("words"), F.count("*").alias("n")), "mix-buckets"
    )
    aims = materialize(
        targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("long"))
        .withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long")),
        "mix-targets",
    )
    same = sums["source"].eqNullSafe(aims["source"])
    by_bucket = Window.partitionBy("source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        sums.withColumn("before", F.coalesce(F.sum("words").over(by_bucket), F.lit(0)))
        .join(aims.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        .filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
        .select("s", F.col("mix_bucket").alias("b"), F.col("before"), "rest")
    )
    last = materialize(last, "mix-last-bucket")
    # Only the bucket in which the rest ends is put in order; equal rows form one unit.
    units = (
        rows.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("mix_bucket") == F.col("b")))
        .groupBy("s", "mix_key", "doc_id", "mix_size").agg(F.count("*").alias("m"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    )
    order = Window.partitionBy("s").orderBy("mix_key", F.col("doc_id").asc_nulls_first(), "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    line = (
        units.withColumn("spent", F.col("before") + F.coalesce(F.sum(F.col("mix_size") * F.col("m")).over(order), F.lit(0)))
        .filter((F.col("spent") <= F.col("rest")) & (F.col("rest") < F.col("spent") + F.col("mix_size") * F.col("m")))
        .select("s", F.col("mix_key").alias("line_key"), F.col("doc_id").alias("line_id"), F.col("mix_size").alias("line_size"),
                F.floor((F.col("rest") - F.col("spent")) / F.col("m")).cast("long").alias("line_words"))
    )
    # Sources whose rest is their whole size (rounding) have no line: all their rows are before it.
    return materialize(
        aims.join(line, aims["source"].eqNullSafe(F.col("s")), "left").select(
            F.col("source").alias("plan_source"), "source_size", "target", "epochs",
            F.when(F.col("rest") <= 0, F.lit(-1.0)).otherwise(F.coalesce("line_key", F.lit(float("inf")))).alias("line_key"),
            "line_id", "line_size", "line_words",
        ),
        "mix-plan",
    )


def take(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Adds source_size, target, whole (copies taken) and part (words at the line)."""
    joined = rows.join(plans, F.col("source").eqNullSafe(F.col("plan_source")))
    here = F.struct(F.col("mix_key"), F.col("doc_id"), F.col("mix_size"))
    line = F.struct(F.col("line_key").alias("mix_key"), F.col("line_id").alias("doc_id"), F.col("line_size").alias("mix_size"))
    before, at = here < line, (F.col("mix_key") == F.col("line_key")) & F.col("doc_id").eqNullSafe(F.col("line_id")) & (F.col("mix_size") == F.col("line_size"))
    return joined.withColumn("whole", F.col("epochs") + F.when(before & ~at, 1).otherwise(0)).withColumn(
        "part", F.when(at, F.col("line_words")).otherwise(F.lit(0)).cast("long")
    )


def quality_weight(labels: DataFrame) -> DataFrame:
    """doc_id, quality_weight in [0.125, 2]: good labels up, bad and toxic ones down."""
    return (
        labels.filter(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("q"), F.max("toxic").alias("t"))
        .select(
            F.col("doc_id").alias("label_id"),
            (F.when(F.col("q") >= 0.5, 2.0).when(F.col("q") < 0.5, 0.5).otherwise(1.0) * F.when(F.col("t") > 0, 0.25).otherwise(1.0)).alias("quality_weight"),
        )
    )


def mix(docs: DataFrame, labels: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document; weights from labels."""
    sized = docs.select("doc_id", "source", words().alias("mix_size"))
    joined = sized.join(quality_weight(labels), F.col("doc_id") == F.col("label_id"), "left")
    narrow = materialize(keyed(joined, F.col("quality_weight"), seed).select("doc_id", "source", "mix_size", "mix_key", "mix_bucket"), "mix-rows")
    return take(narrow, plan(narrow)).select(
        "doc_id", F.col("mix_size").alias("size"), "source_size", "target",
        (F.col("whole") * F.col("mix_size") + F.col("part")).alias("taken"),
    )


def mix_documents(docs: DataFrame, labels: DataFrame | None = None, seed: str = SEED) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken; weights from labels, as in ``mix``.

    The one document at a source's line keeps its first ``part`` words,
    with the blanks and line breaks between them. The plan is made on narrow rows. Weights are written before they meet the
    texts: up to ``SMALL_WEIGHTS`` of them (16 bytes each) are broadcast, more
    cost one shuffle of the texts. Without labels all weights are 1.
    """
    names = docs.columns
    clash = [c for c in names if c.startswith("mix_") or c in ("label_id", "quality_weight", "plan_source", "source_size", "target", "epochs", "line_key", "line_id", "line_size", "line_words", "whole", "part")]
    aside = docs.select(*[F.col(f"`{c}`").alias(f"kept_{c}" if c in clash else c) for c in names])
    sized = aside.withColumn("mix_size", words())
    if labels is None:
        sized = sized.withColumn("quality_weight", F.lit(1.0))
    else:
        weights = materialize(quality_weight(labels), "mix-weights")
        small = weights.count() <= SMALL_WEIGHTS
        sized = sized.join(F.broadcast(weights) if small else weights, F.col("doc_id") == F.col("label_id"), "left")
    ready = keyed(sized, F.col("quality_weight"), seed)
    plans = plan(materialize(ready.select("doc_id", "source", "mix_size", "mix_key", "mix_bucket"), "mix-rows"))
    taken = take(ready, plans)
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"((?:{BLANKS})?{WORD})"), F.lit(1)), F.lit(1), F.greatest(F.col("part").cast("int"), F.lit(0))), "")
    copies = F.concat(
        F.array_repeat(F.lit(False), F.col("whole").cast("int")),
        F.when(F.col("part") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")),
    )
    # A row that is not taken has no copies and goes here.
    spread = taken.withColumn("mix_cut", F.explode(copies))
    back = {c: F.col(f"kept_{c}") if c in clash else F.col(f"`{c}`") for c in names}
    return spread.select(*[(F.when(F.col("mix_cut"), head).otherwise(back[c]) if c == "text" else back[c]).alias(c) for c in names])


def op4_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).withColumn("target", F.round("target", 4))


OP4_SQL = r"""
WITH RECURSIVE labelled AS (
  SELECT doc_id AS label_id,
         (CASE WHEN avg(quality) >= 0.5 THEN 2.0 WHEN avg(quality) < 0.5 THEN 0.5 ELSE 1.0 END
          * CASE WHEN max(toxic) > 0 THEN 0.25 ELSE 1.0 END)::DOUBLE AS w
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
r AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
           / coalesce(w, 1.0) AS k
  FROM documents LEFT JOIN labelled ON doc_id = label_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
n AS (SELECT source, source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w FROM s),
f AS (
  SELECT 0 AS step, source, source_size, w, false AS stopped, 0.0::DOUBLE AS target FROM n
  UNION ALL
  SELECT step + 1, source, source_size, w,
         stopped OR share > 3.0 * source_size,
         CASE WHEN stopped OR share > 3.0 * source_size THEN 3.0 * source_size ELSE share END
  FROM (SELECT *, CASE WHEN stopped THEN target ELSE
          w * ((sum(source_size) OVER () - sum(CASE WHEN stopped THEN 3.0 * source_size ELSE 0 END) OVER ())
          / greatest(1, sum(CASE WHEN stopped THEN 0 ELSE w END) OVER ())) END AS share FROM f)
  WHERE step < 64),
t AS (SELECT source, source_size, target,
             CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS epochs FROM f WHERE step = 64),
o AS (
  SELECT r.*, source_size, target, epochs, floor(target - epochs * source_size + 0.5)::BIGINT AS rest,
         coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY k, r.doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 4) AS target,
       (epochs * size + greatest(0, least(size, rest - spent)))::BIGINT AS taken
FROM o
"""
