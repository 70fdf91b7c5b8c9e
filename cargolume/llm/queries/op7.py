"""op7: embedding near-dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cargolume.llm.common import table
from cargolume.llm.vectors import near_vectors


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_embedding_dedup": op7_embedding_dedup}
