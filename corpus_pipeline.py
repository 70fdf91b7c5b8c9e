"""The corpus pipeline: stages over `documents`, each applying one operator of cargolume.llm.

Each stage gets what its predecessor kept, written as Parquet, and returns the columns of documents;
the last adds the token ids and the text they decode to. Null texts are empty texts; rows with a null
id stay, unless their text is rejected; empty tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cargolume.llm.bpe import encode_documents
from cargolume.llm.common import fold_of, table, written
from cargolume.llm.dedup import without_near_duplicates
from cargolume.llm.mixing import mix_documents
from cargolume.llm.quality import scorer, train
from cargolume.llm.queries.op3 import TOKENIZER
from cargolume.llm.queries.op9 import FOLDS, HELD_OUT, LEAST


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; all of them if there is no label to learn from."""
    model = train(docs, table(spark, sf_dir, "labels"), fold_of("doc_id", FOLDS) == HELD_OUT)
    if model.learnt == 0:
        return docs
    return docs.filter(scorer(model)("text") >= LEAST)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one of smallest id."""
    return without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: some documents twice, some not at all."""
    return mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE token ids of every document the mixture holds, with the text they decode to."""
    return encode_documents(docs, TOKENIZER)


STAGES = [("quality_classifier", quality), ("minhash_near_dedup", near_dedup), ("source_mixing", mix), ("bpe_encoding", encode)]

#: Scores, signatures and token ids are beyond SQL; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
