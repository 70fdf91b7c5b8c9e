"""op12: fill-in-middle transformation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cargolume.llm.common import table
from cargolume.llm.fim import fill_in_middle


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}
ORACLES = {
    "op12_fill_in_middle": """
with d as (
  select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') u,
    sha256('1:' || coalesce(cast(doc_id as varchar), '')) h
  from documents),
k as (
  select *, len(u) n, cast('0x' || h[1:8] as bigint) h1, cast('0x' || h[9:16] as bigint) h2,
    cast('0x' || h[17:24] as bigint) h3, cast('0x' || h[25:32] as bigint) h4
  from d),
c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end form
  from k),
s as (select *, array_to_string(u[1:a], '') p, array_to_string(u[a + 1:b], '') m, array_to_string(u[b + 1:n], '') x from c)
select doc_id, n, form, case when form <> 'plain' then length(p) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || x || '<M>' || m else '<S>' || x || '<P>' || p || '<M>' || m end) output_sha256,
  sha256(t) restored_sha256
from s""",
}
