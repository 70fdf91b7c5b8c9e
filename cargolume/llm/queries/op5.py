"""op5: HTML extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolume.llm.common import table, written
from cargolume.llm.html import main_text


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    texts = main_text(pages, scratch=lambda frame: written(frame, "op5-pages")[0])
    return texts.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))


QUERIES = {"op5_html_extraction": op5_html_extraction}
