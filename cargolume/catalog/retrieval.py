"""Chunking, hybrid retrieval and corpus reconciliation over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolume.catalog.logs import with_log
from cargolume.catalog.registry import query
from cargolume.operators import chunking, retrieval
from cargolume.plans.corpus import CorpusStore
from cargolume.session import scratch_dir
from cargolume.sources.derived_log import event_log
from cargolume.sources.tables import table

# Documents as markdown: a heading per document, another after each line that ends a sentence.
_MARKDOWN = r"""concat('# ', source, ' ', lang, chr(10), replace(replace(text, concat('.', chr(10)),
  concat('.', chr(10), '## Part', chr(10))), concat(',', chr(10)), concat(',', chr(10), chr(10))))"""
_CHUNK_SQL = f"""
md as (select concat('doc-', doc_id) document_id, source, lang, {_MARKDOWN} text from documents),
bk as (select document_id, unnest(string_split(concat(chr(10), text), concat(chr(10), '#'))) b,
  generate_subscripts(string_split(concat(chr(10), text), concat(chr(10), '#')), 1) pos from md),
sc as (select document_id, pos, trim(ltrim(split_part(b, chr(10), 1), '# ')) title,
  substr(b, instr(b, chr(10)) + 1) body from bk where pos > 1 and instr(b, chr(10)) > 0),
sl as (select *, coalesce(nullif(substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'),
  '-'), 1, 80), ''), 'section') slug from sc),
sx as (select *, concat(slug, '-', row_number() over (partition by document_id, slug order by pos))
  section_id from sl),
pr as (select document_id, section_id, title, pos, trim(unnest(string_split_regex(body,
  '\\n\\s*\\n')), concat(' ', chr(10), chr(9), chr(13))) p,
  generate_subscripts(string_split_regex(body, '\\n\\s*\\n'), 1) pn from sx),
fr as (select document_id, section_id, title, row_number() over (partition by document_id,
  section_id order by pn, g) idx, substr(p, (g * 1800 + 1)::bigint, 1800) f
  from pr, unnest(generate_series(0, (length(p) - 1) // 1800)) s(g) where p <> ''),
pk as (select document_id, section_id, title, idx, f cur, 0 ordinal from fr where idx = 1
  union all select n.document_id, n.section_id, n.title, n.idx,
    case when length(k.cur) + length(n.f) + 2 > 1800 then n.f
      else trim(concat(k.cur, chr(10), chr(10), n.f), concat(' ', chr(10), chr(9), chr(13))) end,
    case when length(k.cur) + length(n.f) + 2 > 1800 then k.ordinal + 1 else k.ordinal end
  from pk k join fr n on n.document_id = k.document_id and n.section_id = k.section_id
    and n.idx = k.idx + 1),
ch as (select concat(document_id, ':', section_id, ':', ordinal) chunk_id, document_id, section_id,
  title section_title, ordinal, arg_max(cur, idx) chunk_text from pk group by all)"""


def chunk_sql(select: str, extra: str = "") -> str:
    more = f",\n{extra}" if extra else ""
    return f"with recursive {_CHUNK_SQL.strip()}{more}\n{select}"


def markdown(spark, sf):
    return table(spark, sf, "documents").selectExpr(
        "concat('doc-', doc_id) document_id", "source", "lang", f"{_MARKDOWN} text"
    )


def chunks(spark, sf):
    return chunking.chunk_documents(markdown(spark, sf))


@query(
    "chunk_documents",
    chunk_sql(
        """select chunk_id, document_id, section_id, section_title, ordinal::bigint ordinal,
        chunk_text, sha256(chunk_text) content_sha256 from ch"""
    ),
)
def _(spark, sf):
    return chunks(spark, sf)


# Queries: per label, the vector of its lowest vec_id; in fusion every benchmark text, with the vector
# of the same number.
_BY_LABEL = """q as (select cast(label as varchar) query_id, arg_min(embedding, vec_id)::double[] v
  from embeddings group by label),"""
_BY_ITEM = """q as (select cast(item_id as varchar) query_id, embedding::double[] v
  from benchmark join embeddings on vec_id = item_id),"""
_NEAREST = """
vd as (select query_id, cast(vec_id as varchar) id,
  round(list_cosine_distance(embedding::double[], v), 9) distance from embeddings, q),
vt as (select *, row_number() over (partition by query_id order by distance, id) "rank" from vd
  qualify "rank" <= 12)"""
_Q = _BY_LABEL + _NEAREST


def query_vectors(spark, sf):
    """One vector per label, as a table."""
    first = table(spark, sf, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return first.select(F.col("label").cast("string").alias("query_id"), "embedding")


def vector_rows(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.vector_topk(vectors, query_vectors(spark, sf))


@query(
    "vector_topk_of_model",
    """with e as (select *, case when vec_id % 3 = 0 then 'old' else 'new' end model_id from embeddings),
    q as (select cast(label as varchar) query_id, arg_min(embedding, vec_id)::double[] v from embeddings group by label),
    vd as (select query_id, cast(vec_id as varchar) id, round(list_cosine_distance(embedding::double[], v), 9) distance
      from e, q where model_id = 'new')
    select query_id, id, distance, row_number() over (partition by query_id order by distance, id) "rank" from vd
    qualify "rank" <= 12""",
)
def _(spark, sf):
    # A third of the vectors belongs to another model and must not be found.
    model = F.when(F.col("vec_id") % 3 == 0, "old").otherwise("new").alias("model_id")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", model)
    found = retrieval.vector_topk(vectors, query_vectors(spark, sf), model_id="new")
    return found.withColumn("distance", F.round("distance", 9))


@query("vector_topk", f"with {_Q.strip()} select query_id, id, distance, \"rank\" from vt")
def _(spark, sf):
    return vector_rows(spark, sf).withColumn("distance", F.round("distance", 9))


_STOP = "(" + ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS) + ")"
_LEX = f"""
tm as (select cast(item_id as varchar) query_id, t term from (select item_id, unnest(list_distinct_ordered) t from (select item_id, list_filter(ws, lambda w, i:
  list_position(ws, w) = i) list_distinct_ordered from (select item_id,
  regexp_extract_all(lower(text), '[a-z0-9]{{3,}}') ws from benchmark))) where t not in {_STOP}),
wd as (select id, term, count(*) hits from (select id, unnest(regexp_extract_all(lower(text),
  '[a-z0-9]+')) term from corpus) group by 1, 2),
ls as (select query_id, id, sum(hits)::bigint hits from wd join tm using (term) group by 1, 2),
lt as (select *, row_number() over (partition by query_id order by hits desc, id) "rank" from ls
  qualify "rank" <= 12)"""


def lexical_queries(spark, sf):
    return table(spark, sf, "benchmark").selectExpr("cast(item_id as string) query_id", "text query")


@query(
    "lexical_topk",
    chunk_sql(
        'select query_id, id, hits, "rank" from lt',
        "corpus as (select chunk_id id, concat(chunk_text, ' ', section_title) text from ch)," + _LEX,
    ),
)
def _(spark, sf):
    corpus = chunks(spark, sf).selectExpr("chunk_id id", "concat(chunk_text, ' ', section_title) text")
    # a chunk id names its document, so only documents of one id can repeat it; no need to chunk all twice
    docs = markdown(spark, sf)
    repeated = docs.groupBy("document_id").count().filter("count > 1").select(F.col("document_id").alias("id"))
    if not repeated.isEmpty():
        again = docs.join(repeated, F.col("document_id").eqNullSafe(F.col("id")), "left_semi")
        repeated = chunking.chunk_documents(again).select(F.col("chunk_id").alias("id"))
    found = retrieval.lexical_topk(corpus, lexical_queries(spark, sf), repeated=repeated)
    return found.select("query_id", "id", "hits", "rank")


_FUSE = f"""{_BY_ITEM}{_NEAREST},
corpus as (select cast(doc_id as varchar) id, text from documents),{_LEX},
rf as (select query_id, id, sum(1.0::double / ("rank" + 60)) score from (select query_id, id, "rank"
  from vt union all select query_id, id, "rank" from lt)
  group by 1, 2),
rt as (select query_id, id, round(score, 9) score, row_number() over (partition by query_id
  order by round(score, 12) desc, id) "rank" from rf qualify "rank" <= 4)"""


def fused(spark, sf):
    corpus = table(spark, sf, "documents").selectExpr("cast(doc_id as string) id", "text")
    items = table(spark, sf, "benchmark").select("item_id")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    pairs = items.join(vectors, F.col("item_id") == F.col("id")).select("item_id", "embedding")
    asked = pairs.select(F.col("item_id").cast("string").alias("query_id"), "embedding")
    return retrieval.rank_fusion(
        retrieval.vector_topk(vectors, asked),
        retrieval.lexical_topk(corpus, lexical_queries(spark, sf)),
    )


@query("rank_fusion", f'with {_FUSE} select query_id, id, score, "rank" from rt')
def _(spark, sf):
    return fused(spark, sf).withColumn("score", F.round("score", 9))


@query(
    "chunk_document_join",
    f"""with {_FUSE} select query_id, "rank", concat('doc-', doc_id) document_id, lang, source
    from rt join documents on cast(doc_id as varchar) = rt.id""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").selectExpr(
        "cast(doc_id as string) chunk_id", "concat('doc-', doc_id) document_id", "lang", "source"
    )
    found = fused(spark, sf).withColumn("document_id", F.concat(F.lit("doc-"), "id"))
    joined = retrieval.chunk_document_join(
        found.drop("document_id"), docs.select("chunk_id", "document_id"), docs.drop("chunk_id")
    )
    return joined.select("query_id", "rank", "document_id", "lang", "source")


# Expected: the two lowest vec_ids of the query's label. Even labels are the dev split.
_RECALL = f"""with {_Q.strip()},
cs as (select label, cast(label as varchar) id, case when label % 2 = 0 then 'dev' else 'holdout' end
  split, unnest(list_slice(list(vec_id order by vec_id), 1, 2))::varchar want from embeddings
  group by label),
rc as (select cs.id, split, count(vt.id) hits, count(vt.id)::double / count(*) recall from cs
  left join vt on vt.query_id = cs.id and vt.id = want and vt."rank" <= 4 group by 1, 2)"""


def _cases(spark, sf):
    ranked = table(spark, sf, "embeddings").withColumn(
        "n", F.expr("row_number() over (partition by label order by vec_id)")
    )
    cases = (
        ranked.filter("n <= 2")
        .groupBy(F.col("label").cast("string").alias("id"), F.expr("if(label % 2 = 0, 'dev', 'holdout')").alias("split"))
        .agg(F.collect_list(F.col("vec_id").cast("string")).alias("expected"))
    )
    returned = (
        vector_rows(spark, sf)
        .filter("rank <= 4")
        .groupBy(F.col("query_id").alias("id"))
        .agg(F.collect_list(F.struct("rank", F.col("id").alias("s"))).alias("top"))
        .selectExpr("id", "transform(top, t -> t.s) sections")
    )
    return cases, returned


@query("recall_at_k", f"{_RECALL} select id, split, hits, recall from rc")
def _(spark, sf):
    return retrieval.recall_at_k(*_cases(spark, sf)).withColumn("hits", F.size("hits"))


@query("recall_summary", f"{_RECALL} select split, avg(recall) mean_recall, count(recall) cases from rc group by 1")
def _(spark, sf):
    return retrieval.recall_summary(retrieval.recall_at_k(*_cases(spark, sf)))


@query(
    "expected_sections_hit",
    f"""{_RECALL} select id, hits from rc where hits > 0""",
)
def _(spark, sf):
    scored = retrieval.recall_at_k(*_cases(spark, sf))
    return scored.withColumn("hits", F.size("hits")).filter("hits > 0").select("id", "hits")


@query(
    "citation_integrity",
    with_log(
        """select order_id explanation_id, problem, count(*) "rows" from (
        select order_id, 'duplicate_citation_id' problem from e where event_type = 'refund_requested'
        union all select order_id, 'unprovided_citation' from e where event_type = 'payment_failed'
        union all select order_id, 'incident_citation_required' from e where event_type =
          'order_created' and region = 'eu-west') group by 1, 2"""
    ),
)
def _(spark, sf):
    # An explanation per order cites its events. Refunds are cited twice, failed payments
    # come with an unknown id, and eu-west orders lack their incident citation.
    log = event_log(spark, sf).filter("order_id is not null")
    copies = F.explode(F.when(F.col("event_type") == "refund_requested", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    citations = log.select("*", copies.alias("copy")).selectExpr(
        "order_id explanation_id",
        "event_id citation_id",
        "if(event_type = 'order_created' and region <> 'eu-west', 'incident', 'event') kind",
    )
    statements = log.selectExpr(
        "order_id explanation_id",
        "if(event_type = 'payment_failed', array(event_id, 'unknown'), array(event_id)) citation_ids",
    )
    return retrieval.citation_integrity(citations, statements)


# Stored corpus: all but the German documents. Wanted: all but the French ones, where web
# documents got longer and the rest of English a new title.
_CORPUS = """
st as (select concat('doc-', doc_id) document_id, source title, lang topic, source source_path,
  sha256(text) content_sha256 from documents where lang <> 'de'),
wt as (select concat('doc-', doc_id) document_id, case when lang = 'en' then concat(source, '!')
  else source end title, lang topic, source source_path, sha256(case when n_chars % 2 = 0 then
  concat(text, '.') else text end) content_sha256 from documents where lang <> 'fr')"""


def corpora(spark, sf):
    docs = table(spark, sf, "documents")
    stored = docs.filter("lang <> 'de'").selectExpr(
        "concat('doc-', doc_id) document_id", "source title", "lang topic", "source source_path",
        "sha2(text, 256) content_sha256",
    )
    wanted = docs.filter("lang <> 'fr'").selectExpr(
        "concat('doc-', doc_id) document_id",
        "if(lang = 'en', concat(source, '!'), source) title",
        "lang topic",
        "source source_path",
        "sha2(if(n_chars % 2 = 0, concat(text, '.'), text), 256) content_sha256",
    )
    return stored, wanted


@query(
    "reconcile_corpus",
    f"""with {_CORPUS.strip()} select coalesce(st.document_id, wt.document_id) document_id,
    case when wt.document_id is null then 'delete' when st.document_id is null then 'insert'
    when st.content_sha256 <> wt.content_sha256 then 'replace' when st.title <> wt.title
    then 'update' else 'keep' end action from st full join wt on st.document_id = wt.document_id""",
)
def _(spark, sf):
    return retrieval.reconcile_corpus(*corpora(spark, sf))


@query(
    "rebuild_chunks",
    """with v as (select 1::bigint "version", concat('doc-', doc_id) document_id, source title, text body
      from documents where lang <> 'de'
    union all select 2, concat('doc-', doc_id), case when lang = 'en' then concat(source, '!') else source end,
      case when n_chars % 2 = 0 then concat(text, '.') else text end from documents where lang <> 'fr'),
    c as (select "version", document_id, title, body, unnest(range(0, (length(body) + 499) // 500)) ordinal from v)
    select "version", document_id, title, ordinal, sha256(substr(body, ordinal * 500 + 1, 500)) chunk_sha256 from c""",
)
def _(spark, sf):
    # Both corpora loaded one after the other, the second twice; readers of either version. Chunks are 500 characters.
    docs = table(spark, sf, "documents")
    body = F.expr("if(n_chars % 2 = 0, concat(text, '.'), text)")
    stored, wanted = corpora(spark, sf)
    bodies = [docs.select(F.concat(F.lit("doc-"), "doc_id").alias("document_id"), b.alias("body")) for b in (F.col("text"), body)]

    def pieces(frame):
        starts = "transform(sequence(0, (length(body) + 499) div 500), i -> substring(body, int(i * 500 + 1), 500))"
        cut = frame.select("document_id", F.posexplode(F.expr(starts)).alias("ordinal", "chunk_text"))
        return cut.filter("chunk_text <> ''")

    store = CorpusStore(spark, scratch_dir(spark, "corpus"))
    first = store.load(stored.join(bodies[0], "document_id"), pieces)
    second = store.load(wanted.join(bodies[1], "document_id"), pieces)
    if store.load(wanted.join(bodies[1], "document_id"), pieces) != second:
        raise AssertionError("a load without changes made a version")
    seen = [store.chunks(v).withColumn("version", F.lit(v).cast("bigint")) for v in (first, second)]
    both = seen[0].unionByName(seen[1])
    return both.select("version", "document_id", "title", "ordinal", F.sha2("chunk_text", 256).alias("chunk_sha256"))


@query(
    "corpus_digest",
    f"""with {_CORPUS.strip()}, lf as (select sha256(concat_ws(':', document_id, title, topic,
    source_path, content_sha256)) leaf from st), bu as (select substr(leaf, 1, 4) bucket,
    sha256(string_agg(leaf, '|' order by leaf)) digest from lf group by 1)
    select sha256(string_agg(concat(bucket, digest), '|' order by concat(bucket, digest)))
    corpus_sha256 from bu""",
)
def _(spark, sf):
    return retrieval.corpus_digest(corpora(spark, sf)[0])


@query(
    "load_corpus_checks",
    """select document_id, problem from (
    select concat('doc-', doc_id, case when lang = 'es' then '_' else '' end) document_id, lang
    from documents) d, lateral (select 'malformed_id' problem where lang = 'es'
    union all select 'path_not_allowed' where lang = 'fr')""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").selectExpr(
        "concat('doc-', doc_id, if(lang = 'es', '_', '')) document_id", "lang source_path"
    )
    allowed = docs.filter("source_path <> 'fr'").select("source_path")
    return retrieval.corpus_problems(docs, allowed)
