"""Line dedup over overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtflow.llm.common import one_text, saved

WINDOW = 3


def windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, pos, h1, h2): a 128-bit hash of each ``width`` lines in a row; texts are cut at ``\\n``."""
    lines = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("a")).where(F.size("a") >= width)
    hashed = lines.select("doc_id", F.transform("a", lambda x: F.xxhash64(x)).alias("x"), F.transform("a", lambda x: F.xxhash64(F.lit(width), x)).alias("y"))
    starts = F.sequence(F.lit(0), F.size("x") - width)
    pair = F.transform(
        starts,
        lambda i: F.struct(
            F.xxhash64(*(F.get(F.col("x"), i + k) for k in range(width))).alias("h1"),
            F.xxhash64(F.lit(width), *(F.get(F.col("y"), i + k) for k in range(width))).alias("h2"),
        ),
    )
    return hashed.select("doc_id", F.posexplode(pair)).select("doc_id", "pos", "col.h1", "col.h2")


def covered_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, spans): merged runs [start, end) of lines in windows that also start earlier
    (smaller doc_id, or earlier in the document); only documents with such a window."""
    all_ = windows(docs, width)
    first = all_.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = all_.join(first.hint("merge"), ["h1", "h2"]).where(F.struct("doc_id", "pos") > F.col("first"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    runs = again.select("doc_id", "pos", F.sum((F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(-width - 1)) > width).cast("int")).over(w).alias("run"))
    spans = runs.groupBy("doc_id", "run").agg(F.min("pos").alias("start"), (F.max("pos") + width).alias("end"))
    return spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def dedup_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``doc_id, n_lines, n_removed, n_spans, text``: each text without the lines of repeated windows.

    A window counts as repeated where the same lines stand in a row earlier, judged on the input; overlapping
    windows merge. Null texts are empty (one empty line); texts under ``width`` lines keep all. A null doc_id names no
    document: such rows keep their texts and repeat nobody's lines. Rows that repeat a doc_id are one document, for which
    the longest text stands (ties: the greatest), and are each returned. Other columns are ignored; no rows, no result.
    """
    named = one_text(docs)
    found = saved(covered_lines(named, width))
    nameless = docs.where("doc_id is null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast(found.schema["spans"].dataType).alias("spans"))
    again = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).cast("int").alias("n")).where("n > 1")
    each = named.join(found.hint("merge"), "doc_id", "left").join(again.hint("merge"), "doc_id", "left")
    each = each.withColumn("_i", F.explode(F.array_repeat(F.lit(0), F.coalesce("n", F.lit(1))))).select("doc_id", "text", "spans")
    rows = each.unionByName(nameless)
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x, i: ~F.exists("spans", lambda s: (s.start <= i) & (i < s.end)))
    out = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    removed = F.coalesce(F.aggregate("spans", F.lit(0), lambda a, s: a + s.end - s.start), F.lit(0))
    return rows.select("doc_id", F.size(lines).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), out.alias("text"))
