"""op13: phrase collocation mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cargolume.llm.collocations import collocations
from cargolume.llm.common import table


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {"op13_collocations": op13_collocations}
ORACLES = {
    "op13_collocations": """
with d as (
  select coalesce(lang, 'und') lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) piece
  from documents),
p as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') w from d),
o as (select lang, w, unnest(range(1, len(w) + 1)) i from p where len(w) > 0),
g as (
  select lang, w[i] w1, case when k > 1 then w[i + 1] end w2, case when k > 2 then w[i + 2] end w3, k, count(*) f
  from o, (values (1), (2), (3)) s(k) where i + k - 1 <= len(w) group by all),
u as (select lang, w1 w, f from g where k = 1),
n as (select lang, cast(sum(f) as bigint) n from u group by lang),
b as (select lang, w1, w2, f from g where k = 2 and f >= 10),
t as (select lang, w1, w2, w3, f from g where k = 3 and f >= 10),
x as (
  select b.lang, b.w1 || ' ' || b.w2 phrase, 1 cut, b.f a, l.f l, r.f r
  from b join u l on l.lang = b.lang and l.w = b.w1 join u r on r.lang = b.lang and r.w = b.w2
  where not exists (select 1 from t where t.lang = b.lang and 100 * t.f >= 50 * b.f and t.w1 = b.w1 and t.w2 = b.w2)
    and not exists (select 1 from t where t.lang = b.lang and 100 * t.f >= 50 * b.f and t.w2 = b.w1 and t.w3 = b.w2)
  union all
  select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 1, t.f, l.f, r.f
  from t join u l on l.lang = t.lang and l.w = t.w1 join b r on r.lang = t.lang and r.w1 = t.w2 and r.w2 = t.w3
  union all
  select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 2, t.f, l.f, r.f
  from t join b l on l.lang = t.lang and l.w1 = t.w1 and l.w2 = t.w2 join u r on r.lang = t.lang and r.w = t.w3),
s as (select *, cast(1000000 * cast(a as hugeint) * a // (cast(l as hugeint) * r) as bigint) score from x),
c as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1)
select lang, rank, phrase, a, l, r, n, score from (
  select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) rank from c join n using (lang))
where rank <= 2000""",
}
