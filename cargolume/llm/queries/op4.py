"""op4: MinHash near-dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cargolume.llm.common import table
from cargolume.llm.dedup import near_duplicates


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicates(table(spark, sf_dir, "documents"))
    return classes.selectExpr("doc_id", "class_id", "doc_id <=> class_id as kept")


QUERIES = {"op4_minhash_dedup": op4_minhash_dedup}
