"""op11: language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cargolume.llm.common import fold_of, table
from cargolume.llm.language import identify, train

#: Fixed values of the contract: rows of this fold of five are held out.
FOLDS, HELD_OUT = 5, 0


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = fold_of("doc_id", FOLDS) == HELD_OUT
    model = train(documents.filter(~held_out).select("text", "lang"))
    told = documents.select("doc_id", held_out.alias("held_out"), identify(model, "text").alias("told"))
    return told.select("doc_id", "held_out", "told.lang_pred", "told.score", "told.accepted", "told.entropy")


QUERIES = {"op11_language_id": op11_language_id}
