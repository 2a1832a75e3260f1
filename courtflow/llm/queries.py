"""The corpus queries: one for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtflow.llm import boosting, decontam, fim, lines, minhash, mixing, quality, sharding, suffix, tokens, toxicity, urls, whitening
from courtflow.llm.common import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public byte-level BPE that the token queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, one row a pair."""
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings cut out of all documents."""
    return suffix.dedup_substrings(_table(spark, sf_dir, "documents"), keep_bytes=False)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with similar sets of three-word shingles."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and robust outliers of all documents."""
    return quality.quality(_table(spark, sf_dir, "documents"))


def op5_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents from shards by source into shards of equal counts, moving few bytes."""
    docs = _table(spark, sf_dir, "documents")
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    old = F.pmod(F.xxhash64(F.coalesce(F.col("source"), F.lit(""))), F.lit(sharding.SHARDS)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 8).cast("long").alias("size"), old.alias("old_shard"), F.crc32(data).alias("text_crc32"))
    placed = sharding.reshard(rows, sharding.SHARDS, carry=["text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later copies of three lines in a row."""
    out = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slot of the mixture for every document."""
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.tempered(docs))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as read back from packed token files."""
    path = scratch(spark)
    tokens.write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer_path())
    return tokens.token_digest(spark, path)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    weights = urls.fit(urls.labelled_urls(spark))
    return urls.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), weights)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in the order of their form, as digests of outputs and of the texts rebuilt from them."""
    return fim.digests(fim.fill_in_middle(_table(spark, sf_dir, "documents")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen whitened components of every embedding."""
    return whitening.whitening(_table(spark, sf_dir, "embeddings"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    return boosting.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_suffix_dedup, op3_minhash, op4_quality, op5_resharding, op6_line_dedup, op7_mixing, op8_token_ids, op9_url_filter, op10_toxicity, op11_fill_in_middle, op12_whitening, op13_quality_classifier, pipeline)}

ORACLE_SQL = {
    "op6_line_dedup": r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
lines AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS pos FROM docs),
three AS (
  SELECT doc_id, pos, line, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
again AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, pos) AS k
  FROM three WHERE l3 IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, pos + d AS pos FROM again, (SELECT unnest([0, 1, 2]) AS d) WHERE k > 1),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
    coalesce(string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '') AS text
  FROM lines l LEFT JOIN gone g USING (doc_id, pos) GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(text) AS kept_sha256 FROM kept
""",
}
