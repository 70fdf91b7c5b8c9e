"""op6: sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolume.llm.common import table
from cargolume.llm.sharding import checksum, uniform_shards

SHARDS = 24


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        checksum(F.col("text")).alias("text_crc32"),
        F.xxhash64("doc_id", "text").alias("row_key"),
    )
    sharded = uniform_shards(documents, F.col("row_key"), SHARDS)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op6_sharding": op6_sharding}
