"""op2: exact top-k search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolume.llm.common import table
from cargolume.llm.mtree import finite, top_inner_products

K, EVERY = 20, 20


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(64 * x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").filter(finite("embedding")).filter("vec_id is not null")
    rows = rows.select(F.col("vec_id").alias("id"), whole.alias("vector"))
    found = top_inner_products(rows, rows.filter(F.col("id") % EVERY == 0), K)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("score").cast("bigint").alias("score"))


QUERIES = {"op2_topk_search": op2_topk_search}
ORACLES = {
    "op2_topk_search": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) v
  from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
  where q.vec_id % 20 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20""",
}
