"""op8: LM scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolume.llm.common import fold_of, table
from cargolume.llm.ngrams import score_texts, train_model

#: Fixed values of the contract: rows of this fold of five are held out.
FOLDS, HELD_OUT = 5, 1


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold_of("doc_id", FOLDS) == HELD_OUT
    model = train_model(documents.filter(~held_out))
    scored = documents.select("doc_id", held_out.alias("held_out"), score_texts(model).alias("lm"))
    return scored.select("doc_id", "held_out", "lm.n_tokens", "lm.n_known", F.lit(model.n).cast("bigint").alias("train_tokens"), "lm.base_score", "lm.score")


QUERIES = {"op8_lm_scoring": op8_lm_scoring}
