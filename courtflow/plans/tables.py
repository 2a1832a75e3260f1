"""Intermediate tables that plans read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder ``spark.checkpoint.dir`` and read back: what Python made is made once, and a lost executor
    costs no more than a task. Only a local session without that setting, as in tests, uses a temporary folder of its machine."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("courtflow.tables", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="courtflow-tables-")
        spark.conf.set("courtflow.tables", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
