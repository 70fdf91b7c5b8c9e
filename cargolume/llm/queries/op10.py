"""op10: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolume.llm.common import table, written
from cargolume.llm.mixing import SEED, copies_of, order_key, plan_mixture, source_key, words_in


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    keyed, _ = written(
        documents.select("doc_id", source_key("source").alias("key"), words_in("text").alias("size"), order_key("doc_id", "text", SEED).alias("order")),
        "op10-keys",
    )
    plan = plan_mixture(keyed.select("key", "size", "order"))
    return keyed.join(plan, "key").select("doc_id", "size", "source_size", "target", (copies_of() * F.col("size")).alias("taken"))


QUERIES = {"op10_mixing": op10_mixing}
ORACLES = {
    "op10_mixing": f"""
with d as (
  select doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) size,
    case when source is null then 'z' else 's' || source end k,
    md5('{SEED}:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')) h
  from documents),
s as (select k, cast(sum(size) as bigint) n from d group by k),
w as (select *, case (row_number() over (order by k) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end w, sum(n) over () total from s),
l as (
  select *, 150 * total - 200 * (coalesce(sum(n) over (order by n / w, k rows between unbounded preceding and 1 preceding), 0)) room,
    sum(w) over (order by n / w, k rows between current row and unbounded following) open
  from w),
f as (select *, cast(room as double) * w >= 200.0 * n * open filled from l),
g as (select 150 * sum(n) - 200 * coalesce(sum(n) filter (filled), 0) num, 100 * coalesce(sum(w) filter (not filled), 0) den from f),
t as (
  select k, n, case when filled then cast(2 * n as double) else cast(w as double) * cast(num as double) / cast(den as double) end target
  from f, g),
p as (
  select doc_id, size, n, target, case when n > 0 then floor(target / n) else 0 end whole,
    sum(size) over (partition by k order by h rows unbounded preceding) - size / 2 middle
  from d join t using (k))
select doc_id, cast(size as bigint) size, n source_size, target,
  cast((whole + case when middle <= target - whole * n then 1 else 0 end) * size as bigint) taken
from p""",
}
