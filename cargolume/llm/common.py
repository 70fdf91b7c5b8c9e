"""Small helpers the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolume.session import hadoop_path, scratch_dir

#: White space of the word definition `[^\x20\x09-\x0D]+` (fixed value of the contracts).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(frame: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """The frame as a table in the shared folder: lineage ends there, so lost executors cost nothing.

    Returns the table read back and its path, for `forget` once nothing reads it any more.
    """
    spark = frame.sparkSession
    path = scratch_dir(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, target = hadoop_path(spark, path)
        fs.delete(target, True)


def fold_of(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id written as text, modulo the number of folds; null ids fall in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % folds, F.lit(0))
