"""Queries of retrieval: documents as index texts, embeddings as vectors, every twentieth row as a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators.ingest import index_texts
from ..registry import query
from ..runtime import once, release, shared_path, table

TOKENS = lambda t: rf"regexp_extract_all(lower(coalesce({t}, '')), '[\p{{L}}\p{{N}}]+')"


def asked(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.filter("doc_id % 20 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.col("title").alias("text"))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("values"))


def text_hits(spark: SparkSession, sf: str) -> DataFrame:
    return R.bm25(asked(spark, sf), texts(spark, sf))


def vector_hits(spark: SparkSession, sf: str) -> DataFrame:
    own = vectors(spark, sf)
    return R.knn(own.filter("key % 20 = 0").withColumnRenamed("key", "query_id"), own)


BM25 = f"""q as (select doc_id as query_id, unnest({TOKENS('title')}) as term from documents where doc_id % 20 = 0 and title is not null),
qt as (select query_id, term, count(*) as qtf from q group by 1, 2),
d as (select doc_id as key, {TOKENS('text')} as w from documents),
st as (select count(*) as docs, avg(len(w)) as mean from d),
po as (select key, len(w) as dl, unnest(w) as term from d),
tf as (select term, key, dl, count(*) as tf from po group by all),
df as (select term, count(*) as df from tf group by 1),
sc as (select query_id, key, round(sum(qtf * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))), 6) as score
       from qt join tf using (term) join df using (term), st group by 1, 2),
th as (select * from (select *, row_number() over (partition by query_id order by score desc, key) as rank from sc) where rank <= 50)"""

KNN = """v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
vs as (select a.vec_id as query_id, b.vec_id as key,
       round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) as score
       from v a, v b where a.vec_id % 20 = 0),
vh as (select * from (select *, row_number() over (partition by query_id order by score desc, key) as rank from vs) where rank <= 50)"""

FUSED = f"""{BM25}, {KNN},
fu as (select query_id, key, max(s) as score_sparse, max(d) as score_dense, round(sum(1.0 / (60 + rank)), 6) as fusion from (
       select query_id, key, score as s, null as d, rank from th union all select query_id, key, null, score, rank from vh) group by 1, 2)"""

HITS = f"""{FUSED},
hd as (select f.*, 'document' as kind, d.source as page_id, d.url, d.title, d.text from fu f join documents d on d.doc_id = f.key)"""


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """Fused hits with the source of their document, which stands for the page."""
    fused = R.fuse(text_hits(spark, sf), vector_hits(spark, sf))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("page_id"))
    return fused.join(docs, "key").withColumn("kind", F.lit("block"))


def sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "url", "title", "text")


@query("search_bm25_topk", f"with {BM25} select query_id, key, score, rank from th")
def search_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return text_hits(spark, sf)


@query("search_knn_topk", f"with {KNN} select query_id, key, score, rank from vh")
def search_knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vector_hits(spark, sf)


@query("search_hybrid_rrf", f"with {FUSED} select query_id, key, score_sparse, score_dense, fusion, rank from (select *, row_number() over (partition by query_id order by fusion desc, key) as rank from fu) where rank <= 4")
def search_hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return R.top(R.fuse(text_hits(spark, sf), vector_hits(spark, sf)), "fusion", R.FAST.final_top)


@query("search_source_scoped_post", f"with {FUSED} select query_id, key, fusion from fu join documents d on d.doc_id = fu.key where d.source = 'portal.velmora.example'")
def search_source_scoped_post(spark: SparkSession, sf: str) -> DataFrame:
    """Q12: the source filter after the global top-k, as the reference has it."""
    return hits(spark, sf).filter("page_id = 'portal.velmora.example'").select("query_id", "key", "fusion")


@query(
    "search_source_scoped_pre",
    f"with {BM25.replace('from documents),' + chr(10) + 'st', 'from documents where source = ' + chr(39) + 'portal.velmora.example' + chr(39) + '),' + chr(10) + 'st')} select query_id, key, score, rank from th",
)
def search_source_scoped_pre(spark: SparkSession, sf: str) -> DataFrame:
    """Q12: the source filter before the top-k."""
    own = table(spark, sf, "documents").filter("source = 'portal.velmora.example'")
    return R.bm25(asked(spark, sf), own.select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text")))


@query(
    "search_dedupe_by_page",
    f"with {HITS} select query_id, key, page_id, fusion from (select *, row_number() over (partition by query_id, page_id order by fusion desc, key) as n from hd) where n = 1",
)
def search_dedupe_by_page(spark: SparkSession, sf: str) -> DataFrame:
    return R.one_for_page(hits(spark, sf)).select("query_id", "key", "page_id", "fusion")


RERANKED = f"""{HITS},
op as (select * from (select *, row_number() over (partition by query_id, page_id order by fusion desc, key) as n from hd) where n = 1),
rk as (select *, row_number() over (partition by query_id order by fusion desc, key) as place from op),
lx as (select rk.*, list_distinct({TOKENS('q.title')}) as qw, list_distinct({TOKENS('rk.text')}) as tw
       from rk left join (select doc_id, title from documents where doc_id % 20 = 0 and title is not null) q on q.doc_id = rk.query_id),
fn as (select *, case when place <= 8 then case when len(qw) > 0 then round(len(list_intersect(qw, tw)) / len(qw), 6) else 0.0 end else fusion end as score_final from lx)"""


@query("search_rerank_lexical", f"with {RERANKED} select query_id, key, fusion, score_final from fn")
def search_rerank_lexical(spark: SparkSession, sf: str) -> DataFrame:
    return reranked(spark, sf).select("query_id", "key", "fusion", "score_final")


def reranked(spark: SparkSession, sf: str) -> DataFrame:
    return R.rerank(R.one_for_page(hits(spark, sf)), asked(spark, sf), sources=sources(spark, sf))


CONTEXT = f"""{RERANKED},
tp as (select *, row_number() over (partition by query_id order by score_final desc, key) as num from fn),
cx as (select query_id, num, key, url, '[' || num || '] ' || coalesce(url, '') || chr(10) || 'title: ' || coalesce(title, '') || chr(10) || 'content: ' || coalesce(text, '') as entry from tp where num <= 4)"""


def entries(spark: SparkSession, sf: str) -> DataFrame:
    return R.context(reranked(spark, sf), sources=sources(spark, sf))


@query("search_context", f"with {CONTEXT} select query_id, cast(num as int) as num, key, url, entry from cx")
def search_context(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf)


@query(
    "search_prompt",
    f"""with {CONTEXT} select c.query_id, 'Context' || chr(10) || string_agg(entry, chr(10) || chr(10) order by num) || chr(10) || chr(10) || 'Question' || chr(10) || any_value(q.title) || chr(10) as prompt
        from cx c join documents q on q.doc_id = c.query_id where q.title is not null group by 1""",
)
def search_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return R.prompts(entries(spark, sf), asked(spark, sf))


@query("search_result_view", f"with {CONTEXT} select f.query_id, f.key, f.score_final, coalesce(c.entry, 'not found') as text from fn f left join cx c on c.query_id = f.query_id and c.key = f.key")
def search_result_view(spark: SparkSession, sf: str) -> DataFrame:
    """R13, by exact key (Q13)."""
    ranked = reranked(spark, sf)
    return R.result_view(ranked, R.context(ranked, sources=sources(spark, sf)))


@query(
    "answer_citations",
    """with a as (select doc_id as query_id, 'See [' || (1 + doc_id % 5) || '] and [' || (1 + length(coalesce(text, '')) % 3) || '], not [a].' as answer from documents),
        m as (select query_id, unnest(regexp_extract_all(answer, '\\[(\\d{1,9})\\]', 1)) as n, generate_subscripts(regexp_extract_all(answer, '\\[(\\d{1,9})\\]', 1), 1) - 1 as place from a),
        e as (select doc_id as query_id, k as num, doc_id * 10 + k as key from documents, range(1, 4) t(k))
        select m.query_id, place, cast(n as int) as num, e.key from m left join e on e.query_id = m.query_id and e.num = cast(m.n as int)""",
)
def answer_citations(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    size = F.length(F.coalesce("text", F.lit("")))
    text = F.concat(F.lit("See ["), 1 + F.col("doc_id") % 5, F.lit("] and ["), 1 + size % 3, F.lit("], not [a]."))
    own = docs.select(F.col("doc_id").alias("query_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("num"))
    return R.citations(docs.select(F.col("doc_id").alias("query_id"), text.alias("answer")), own.withColumn("key", F.col("query_id") * 10 + F.col("num")))


@query("index_postings_stats", f"with d as (select doc_id as key, unnest({TOKENS('text')}) as term from documents) select term, count(distinct key) as df, count(*) as cf from d group by 1")
def index_postings_stats(spark: SparkSession, sf: str) -> DataFrame:
    return R.term_stats(R.postings(texts(spark, sf)))


@query(
    "search_hydrate",
    r"""with p as (select distinct id, url, title from pages)
        select 'block:' || b.id as key, p.id as page_id, p.url, p.title from (select distinct id, page_id from page_blocks) b join p on p.id = b.page_id
        union all select 'document:' || d.id, p.id, d.url, d.description from (select distinct id, page_id, url, description from page_documents) d join p on p.id = d.page_id""",
)
def search_hydrate(spark: SparkSession, sf: str) -> DataFrame:
    """The keys of every block and document to their pages."""
    blocks, files = table(spark, sf, "page_blocks"), table(spark, sf, "page_documents")
    keys = blocks.select(F.concat(F.lit("block:"), "id").alias("key")).union(files.select(F.concat(F.lit("document:"), "id"))).distinct()
    return R.hydrate(keys, blocks, files, table(spark, sf, "pages")).select("key", "page_id", "url", "title")


STORE = rf"""{BM25.replace(f"d as (select doc_id as key, {TOKENS('text')} as w from documents)", f"x as (select 'block:' || id as key, text from (select distinct id, text from page_blocks) union all select 'document:' || id, extracted_text from (select distinct id, extracted_text from page_documents) where trim(coalesce(extracted_text, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) <> ''), d as (select key, {TOKENS('text')} as w from x)")}"""


def stored_index(spark: SparkSession, sf: str) -> R.TextIndex:
    """The text index of all blocks and attached files, written to the shared folder and opened again."""
    keyed = index_texts(table(spark, sf, "page_blocks").dropDuplicates(["id"]), table(spark, sf, "page_documents").dropDuplicates(["id"]))
    path = shared_path(spark)
    R.write_text_index(keyed, path)
    index = R.open_text_index(spark, path)
    index.postings._millrace_path = path
    return index


def stored_hits(spark: SparkSession, sf: str) -> DataFrame:
    index = stored_index(spark, sf)
    found = R.bm25(asked(spark, sf), index)
    release(index.postings)  # nothing else asks it
    return found


@query("search_blocks_topk", f"with {STORE} select query_id, key, score, rank from th")
def search_blocks_topk(spark: SparkSession, sf: str) -> DataFrame:
    """R01 over every block and attached file, through the stored index."""
    return stored_hits(spark, sf)


@query(
    "search_blocks_context",
    f"""with {STORE},
        p as (select distinct id, url, title from pages),
        hb as (select th.query_id, th.key, round(1.0 / (60 + rank), 6) as fusion, 'block' as kind, b.page_id, p.url, p.title, b.text
               from th join (select distinct id, page_id, text from page_blocks) b on th.key = 'block:' || b.id join p on p.id = b.page_id
               union all select th.query_id, th.key, round(1.0 / (60 + rank), 6), 'document', d.page_id, d.url, d.description, d.extracted_text
               from th join (select distinct id, page_id, url, description, extracted_text from page_documents) d on th.key = 'document:' || d.id join p on p.id = d.page_id),
        op as (select * from (select *, row_number() over (partition by query_id, kind, case when kind = 'block' then page_id else key end order by fusion desc, key) as n from hb) where n = 1),
        rk as (select *, row_number() over (partition by query_id order by fusion desc, key) as place from op),
        lx as (select rk.*, list_distinct({TOKENS('q.title')}) as qw, list_distinct({TOKENS('rk.text')}) as tw
               from rk left join (select doc_id, title from documents where doc_id % 20 = 0 and title is not null) q on q.doc_id = rk.query_id),
        fn as (select *, case when place <= 8 then case when len(qw) > 0 then round(len(list_intersect(qw, tw)) / len(qw), 6) else 0.0 end else fusion end as score_final from lx),
        tp as (select * from (select *, row_number() over (partition by query_id order by score_final desc, key) as num from fn) where num <= 4),
        pg as (select page_id, string_agg(coalesce(text, ''), chr(10) order by ord, id) as page from (select distinct id, page_id, ord, text from page_blocks) group by 1),
        fl as (select 'document:' || id as key, extracted_text as file, description as own from (select distinct id, extracted_text, description from page_documents)),
        ab as (select url, min(description) as about from page_documents group by 1)
        select query_id, cast(num as int) as num, tp.key, tp.url, '[' || num || '] ' || coalesce(tp.url, '') || chr(10) || 'title: ' || coalesce(title, '') || chr(10)
            || case when trim(coalesce(case when kind = 'block' then about else own end, '')) <> '' then 'description: ' || case when kind = 'block' then about else own end || chr(10) else '' end
            || 'content: ' || coalesce(case when kind = 'block' then page else file end, '') as entry
        from tp left join pg using (page_id) left join fl on fl.key = tp.key left join ab on ab.url = tp.url""",
)
def search_blocks_context(spark: SparkSession, sf: str) -> DataFrame:
    """R01-R11 over every block and attached file, with full sources."""
    blocks, files, pages = (table(spark, sf, t) for t in ("page_blocks", "page_documents", "pages"))
    found = stored_hits(spark, sf)
    none = found.limit(0)
    keyed = lambda d, kind: d.withColumn("key", F.concat(F.lit(f"{kind}:"), "id"))
    # texts are read for the hits that are scored, and of all other rows the keys of those found
    of = [R.of_keys(keyed(d.select("id", "page_id", *own), kind), found) for d, kind, own in ((blocks, "block", ["text", "ord"]), (files, "document", ["url", "description", "extracted_text"]))]
    hits = R.hydrate(R.fuse(found, none), *of, pages).drop("text")
    texts = of[0].select("key", "text").unionByName(of[1].select("key", F.col("extracted_text").alias("text")))
    ranked = R.rerank(R.one_for_page(hits), asked(spark, sf), sources=once(texts, "key"))
    return R.full_context(ranked, blocks, files)


HEX = lambda at: f"list_reduce(list_transform(string_split(substring(h, {at}, 8), ''), lambda c: cast(strpos('0123456789abcdef', c) - 1 as bigint)), lambda a, b: a * 16 + b)"


@query(
    "embed_hashed",
    f"""with w as (select doc_id, md5(unnest({TOKENS('text')})) as h from documents),
        s as (select doc_id, {HEX(1)} % 64 as slot, sum(case when {HEX(9)} % 2 = 0 then 1 else -1 end) as v from w group by 1, 2),
        n as (select doc_id, sqrt(sum(v * v)) as norm from s group by 1),
        e as (select d.doc_id, t.i as slot, coalesce(round(case when norm > 0 then coalesce(v, 0) / norm else 0.0 end, 6), 0.0) as x
              from documents d, range(64) t(i) left join n on n.doc_id = d.doc_id left join s on s.doc_id = d.doc_id and s.slot = t.i)
        select doc_id, list(cast(x as double) order by slot) as values from e group by 1""",
)
def embed_hashed(spark: SparkSession, sf: str) -> DataFrame:
    return R.hashed_embeddings(texts(spark, sf)).select(F.col("key").alias("doc_id"), F.transform("values", lambda x: F.round(x, 6)).alias("values"))
