"""op9: quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolume.llm.common import fold_of, table
from cargolume.llm.quality import scorer, train

#: Fixed values of the contract: rows of this fold of four are held out; least score of a good text.
FOLDS, HELD_OUT, LEAST = 4, 2, 0.7


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = fold_of("doc_id", FOLDS) == HELD_OUT
    model = train(documents, table(spark, sf_dir, "labels"), held_out)
    scored = documents.select("doc_id", held_out.alias("held_out"), scorer(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= LEAST).cast("int"))


QUERIES = {"op9_quality": op9_quality}
