"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark's setting to remove the shuffle files of a query when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """A new path in the cluster's shared folder, ``spark.checkpoint.dir``.

    Only where that setting is absent (a local session, as in tests) a temporary
    folder of this machine stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("courtflow.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="courtflow-")
        spark.conf.set("courtflow.scratch", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files behind the table are not needed once it is written, so Spark is told to remove them then.
    """
    spark = df.sparkSession
    path = scratch(spark)
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def arrow_rows(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches small enough that even batches of the longest texts fit a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def one_text(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, a row a doc_id, nulls left out: of rows that repeat a doc_id the longest text (ties: the greatest) stands."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    if rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return rows
    return saved(rows.groupBy("doc_id").agg(F.max(F.struct(F.octet_length("text").alias("l"), "text")).alias("m")).select("doc_id", "m.text"))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, keys: Sequence[str], order: str, name: str, buckets: int = 256, ties: Sequence[str] = ()) -> DataFrame:
    """Add ``name``: row numbers from 0 without gaps within ``keys``.

    Rows of a key are dealt into ``buckets`` by a hash of ``order`` and numbered there;
    bucket offsets come from counts. So no task holds a whole key, however large. Rows of one ``order`` (null ones
    among them) are told apart by ``ties``, which deal and order as well: a task that runs again numbers them alike.
    """
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(F.col(order), *ties), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*keys, "_b").orderBy(order, *ties)
    rows = dealt.withColumn("_r", F.row_number().over(inside) - 1)
    return (
        rows.join(offsets.hint("merge"), [*keys, "_b"])
        .withColumn(name, (F.col("_o") + F.col("_r")).cast("long"))
        .drop("_b", "_o", "_r")
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(id, component)``, component = smallest id.

    Alternating large-star and small-star rounds: each is one shuffle over the edges, and
    a hub's neighbours are never gathered, only their minimum. Ends when a round changes nothing.
    Empty input gives an empty result; nulls and self-links are ignored.
    """
    pairs = saved(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )
    for _ in range(max_rounds):
        before = _state(pairs)
        if not before[0]:
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u")
            .join(least.hint("merge"), "u")
            .where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down.hint("merge"), "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u != v")
            .distinct()
        )
        pairs = saved(small)
        if _state(pairs) == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    heads = pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return heads.unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _state(pairs: DataFrame) -> tuple:
    """A fingerprint of a set of links: two equal sets give equal values."""
    h = F.xxhash64("u", "v")
    row = pairs.agg(
        F.count(F.lit(1)),
        F.sum(F.shiftrightunsigned(h, 20)),
        F.sum(h.bitwiseAND(F.lit((1 << 20) - 1))),
    ).first()
    return tuple(row)


def sized(df: DataFrame, rows: int = 2_000_000, lists: str | None = None) -> DataFrame:
    """A saved table of a few fixed-width columns, hinted for a join: broadcast where its counted rows are
    at most ``rows`` (some tens of MB), else a shuffled sort-merge join. With a column of ``lists`` of
    fixed-width structs, their elements are counted instead."""
    if lists:
        n = df.agg(F.coalesce(F.sum(F.size(lists)), F.lit(0))).first()[0]
    else:
        n = df.limit(rows + 1).count()
    return df.hint("broadcast") if n <= rows else df.hint("merge")
