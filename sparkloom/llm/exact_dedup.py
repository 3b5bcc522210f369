"""Exact dedup by a Golomb-coded fingerprint exchange.

1. Every partition (a sender) hashes its normalised texts and sends each owner
   of a hash range its sorted, distinct fingerprints, Golomb-Rice coded.
2. An owner decodes what its senders sent, finds the fingerprints that more
   than one sender has, and returns each sender a bitmap of them.
3. A sender marks as suspects its rows whose fingerprint is in a bitmap, or
   occurs twice in the sender itself.
4. Only suspects' texts are shuffled: they are grouped by their bytes, with
   partial aggregation first, so a group of copies sends one text a task.

The fingerprints by row are written to the shared folder, with the sender's
number, before the exchange; a lost executor repeats no numbering. Suspect
fingerprints are one row a group of copies; they are broadcast for the second
scan only if a count shows that they are few. Fingerprints of ``FP_BITS`` bits
that collide only make suspects, which the bytes clear.

Defined results: null text counts as empty; rows with a null id are documents
too, and a group with nothing but null ids keeps a null; of several rows with
the smallest id one stays (equal rows are interchangeable); an empty table
gives an empty result; ``drop_copies`` keeps all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, fresh, materialize, partitions_for, read_table, sized_semi_join, text_or_empty

FP_BITS = 56


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(column), BLANKS, " ")


def golomb_encode(values, parameter: int) -> bytes:
    """Sorted distinct unsigned integers as Rice-coded gaps.

    Quotients go as a unary bit string, remainders as ``parameter`` bits each,
    in two strings, so both directions are array operations.
    """
    import numpy as np

    values = np.asarray(values, dtype=np.uint64)
    gaps = np.diff(values, prepend=np.uint64(0))
    quotients = (gaps >> np.uint64(parameter)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    unary[ends - 1] = 1
    shifts = np.arange(parameter, dtype=np.uint64)
    low = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    head = np.array([len(values), parameter, len(unary)], dtype="<u8").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(low.reshape(-1)).tobytes()


def golomb_decode(data: bytes):
    import numpy as np

    n, parameter, n_unary = (int(x) for x in np.frombuffer(data, "<u8", 3))
    size = -(-n_unary // 8)
    unary = np.unpackbits(np.frombuffer(data, np.uint8, size, 24), count=n_unary)
    quotients = np.diff(np.flatnonzero(unary), prepend=-1) - 1
    low = np.unpackbits(np.frombuffer(data, np.uint8, -1, 24 + size), count=n * parameter).reshape(n, parameter)
    weights = np.uint64(1) << np.arange(parameter, dtype=np.uint64)
    remainders = low.astype(np.uint64) @ weights if parameter else np.zeros(n, dtype=np.uint64)
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(parameter)) + remainders, dtype=np.uint64)


def rice_parameter(n: int, width: int) -> int:
    """Remainder bits for n values out of ``width``: about log2 of the mean gap."""
    return max(0, (width // max(1, n)).bit_length() - 1)


def owners_of(fps, n_owners: int):
    """The owner of each fingerprint: even ranges of the fingerprint space."""
    import numpy as np

    return (fps >> np.uint64(FP_BITS - 32)) * np.uint64(n_owners) >> np.uint64(32)


def sent(fingerprints: DataFrame, n_owners: int) -> DataFrame:
    """owner, sender, coded: one row for each pair that has fingerprints."""

    def run(sender, table):
        import numpy as np
        import pyarrow as pa

        fps = np.unique(table.column("fp").to_numpy().astype(np.uint64))
        owner = owners_of(fps, n_owners)
        cuts = np.searchsorted(owner, np.arange(n_owners + 1))
        parts = [(o, fps[a:b]) for o, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        width = (1 << FP_BITS) // n_owners
        base = [fp[0] for _, fp in parts]
        coded = [golomb_encode(fp - fp[0], rice_parameter(len(fp), width)) for _, fp in parts]
        return pa.table(
            {"owner": pa.array([o for o, _ in parts], pa.int32()), "sender": pa.array([sender[0].as_py()] * len(parts), pa.int32()),
             "base": pa.array(base, pa.int64()), "coded": pa.array(coded, pa.binary())}
        )

    return fingerprints.select("sender", "fp").groupBy("sender").applyInArrow(run, "owner int, sender int, base long, coded binary")


def answered(messages: DataFrame) -> DataFrame:
    """owner, sender, base, coded, bitmap: which of a message's fingerprints others sent too."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        lists = [golomb_decode(c) + np.uint64(b) for c, b in zip(table.column("coded").to_pylist(), table.column("base").to_pylist(), strict=True)]
        everything = np.sort(np.concatenate(lists))
        twice = np.unique(everything[1:][everything[1:] == everything[:-1]])
        maps = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in lists]
        return table.append_column("bitmap", pa.array(maps, pa.binary()))

    return messages.groupBy("owner").applyInArrow(run, "owner int, sender int, base long, coded binary, bitmap binary")


def suspects(fingerprints: DataFrame, n_owners: int) -> DataFrame:
    """fp of every fingerprint that two rows share, once."""
    replies = answered(sent(fingerprints, n_owners)).select("sender", "base", "coded", "bitmap")

    def mark(rows, answers):
        import numpy as np
        import pyarrow as pa

        fps, counts = np.unique(rows.column("fp").to_numpy().astype(np.uint64), return_counts=True)
        marked = counts > 1
        for base, coded, bitmap in zip(answers.column("base").to_pylist(), answers.column("coded").to_pylist(), answers.column("bitmap").to_pylist(), strict=True):
            shared = np.unpackbits(np.frombuffer(bitmap, np.uint8))
            if shared.any():
                values = golomb_decode(coded) + np.uint64(base)
                marked |= np.isin(fps, values[shared[: len(values)].astype(bool)], assume_unique=True)
        return pa.table({"fp": pa.array(fps[marked].astype(np.int64), pa.int64())})

    found = fingerprints.select("sender", "fp").groupBy("sender").cogroup(replies.groupBy("sender")).applyInArrow(mark, "fp long")
    return found.distinct()


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    spark = docs.sparkSession
    text = normalised()
    mask = (1 << FP_BITS) - 1
    hashed = docs.select("doc_id", text.alias("norm")).select(
        "doc_id", F.sha2("norm", 256).alias("text_sha256"), F.xxhash64("norm").bitwiseAND(F.lit(mask)).alias("fp"),
        F.spark_partition_id().alias("sender"), F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(hashed, "fingerprints")
    shared = materialize(suspects(rows, max(8, partitions_for(spark))), "suspects")
    texts = docs.select("doc_id", text.alias("norm")).withColumn("fp", F.xxhash64("norm").bitwiseAND(F.lit(mask)))
    groups = materialize(
        # The bytes themselves are the key: this is the verification.
        sized_semi_join(texts, shared, "fp").groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1").select(F.sha2("norm", 256).alias("sha"), "keep_id", "group_size"),
        "copies",
    )
    clash = groups.groupBy("sha").count().filter("count > 1").limit(1).count()
    if clash:
        raise ValueError("two different texts have the same SHA-256")
    # Of rows that repeat the smallest id one stays: the first as they were written.
    stays = sized_semi_join(rows, shared, "fp").groupBy("text_sha256").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"))
    groups = materialize(groups.join(stays, F.col("sha") == F.col("text_sha256")).select("sha", "keep_id", "group_size", F.col("first.row").alias("keep_row")), "copies")
    if groups.count() <= 100_000:  # about 100 bytes each
        groups = F.broadcast(groups)
    return rows.join(groups, rows["text_sha256"] == groups["sha"], "left").select(
        "doc_id", F.when(F.col("sha").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("sha").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows of a group that share its smallest id are told apart by a number.
    """
    gone = materialize(deduplicated(docs).filter("not kept"), "dropped")
    # A row goes if its (id, text) was dropped and it is not the one that stays.
    plain = gone.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "text_sha256").distinct()
    tied = gone.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "text_sha256").distinct()
    sha = fresh(docs.columns, "text_sha256")
    number = fresh([*docs.columns, sha], "copy_number")
    keyed = docs.withColumn(sha, F.sha2(normalised(), 256))

    def match(d, k):
        return d["doc_id"].eqNullSafe(k["doc_id"]) & (d[sha] == k["text_sha256"])

    plain, tied = materialize(plain, "dropped-plain"), materialize(tied, "dropped-tied")
    few, few_tied = plain.count() <= 200_000, tied.count()
    kept = keyed.join(F.broadcast(plain) if few else plain, match(keyed, plain), "left_anti")
    if not few_tied:
        return kept.drop(sha)
    alone = kept.join(tied, match(kept, tied), "left_anti")
    same = kept.join(tied, match(kept, tied), "left_semi")
    one = same.withColumn(number, F.row_number().over(Window.partitionBy("doc_id", sha).orderBy(F.lit(0)))).filter(F.col(number) == 1).drop(number)
    return alone.unionByName(one).drop(sha)


def op1_golomb_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""
