"""The registered queries of the core: callables over (spark, sf_dir), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.chunkers.operators import chunked
from loamdex.embed.operators import cache_stats, looked_up, with_vectors
from loamdex.functions.text import heading, line_count, snippet, xml_text
from loamdex.functions.vector import dot, truncated, unpacked
from loamdex.operators.export import export_lines, export_rows
from loamdex.operators.filters import at_least, first_of_file, in_path, modified_after, of_type, page, tool_page
from loamdex.operators.hybrid import search
from loamdex.operators.incremental import replay_changes
from loamdex.operators.keyword import bm25_batch, bm25_search, fts_search, postings, syntax_search, term_statistics
from loamdex.operators.metadata import classified, current_sources, index_stats, list_sources, living, modified_since, parent_directories, removed, stale, upserted
from loamdex.operators.references import broken_references, orphan_report
from loamdex.operators.vector import CellIndex, vector_batch, vector_search
from loamdex.parsers.registry import parsed
from loamdex.session import scratch_dir, table
from loamdex.sources.filesystem import mime_column
from loamdex.sources.mime import MIME_OF
from loamdex.streaming.watch import debounced, debounced_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


P3_SQL = """
WITH ok AS (SELECT run_id, finished_at FROM scan_runs WHERE status = 'success' AND finished_at IS NOT NULL),
spans AS (SELECT run_id, finished_at AS hi, max(finished_at) OVER (ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo FROM ok),
taken AS (SELECT s.*, r.run_id FROM sources s JOIN spans r ON s.indexed_at <= r.hi AND (r.lo IS NULL OR s.indexed_at > r.lo) WHERE s.uri IS NOT NULL),
last AS (SELECT * FROM taken QUALIFY row_number() OVER (PARTITION BY run_id, uri ORDER BY indexed_at DESC, source_id DESC) = 1),
seen AS (SELECT *, lag(run_id) OVER w AS prev_run, lag(content_hash) OVER w AS prev_hash, lag(coalesce(status, 'indexed')) OVER w AS prev_status
         FROM last WINDOW w AS (PARTITION BY uri ORDER BY run_id))
SELECT run_id, uri FROM seen
WHERE coalesce(status, 'indexed') <> 'deleted'
  AND (prev_run IS NULL OR prev_status = 'deleted' OR content_hash IS DISTINCT FROM prev_hash)
"""


@query("p3_found", P3_SQL)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_changes(table(spark, sf_dir, "sources"), table(spark, sf_dir, "scan_runs"), scratch_dir(spark))


P5_SQL = """
WITH src AS (SELECT uri, min(indexed_at) AS first_at, arg_max(coalesce(status, 'indexed'), (indexed_at, source_id)) AS last_status
             FROM sources WHERE uri IS NOT NULL GROUP BY uri),
cache AS (SELECT hash, min(created_at) AS first_at FROM embedding_cache WHERE hash IS NOT NULL GROUP BY hash),
found AS (
  SELECT 'source_uri' AS ref_field, chunk_id,
         CASE WHEN s.uri IS NULL THEN 'missing' WHEN s.last_status = 'deleted' THEN 'deleted' WHEN s.first_at > c.indexed_at THEN 'late' END AS reason,
         strftime(make_timestamp(c.indexed_at * 1000000), '%Y-%m') AS period
  FROM embedded_chunks c LEFT JOIN src s ON c.source_uri = s.uri WHERE c.source_uri IS NOT NULL
  UNION ALL
  SELECT 'text_hash', chunk_id, CASE WHEN k.hash IS NULL THEN 'missing' WHEN k.first_at > c.indexed_at THEN 'late' END,
         strftime(make_timestamp(c.indexed_at * 1000000), '%Y-%m')
  FROM embedded_chunks c LEFT JOIN cache k ON c.text_hash = k.hash WHERE c.text_hash IS NOT NULL)
SELECT ref_field, chunk_id, reason, period FROM found WHERE reason IS NOT NULL
"""


@query("p5_found", P5_SQL)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, cache = table(spark, sf_dir, "sources"), table(spark, sf_dir, "embedding_cache")
    specs = [
        {"field": "source_uri", "parents": sources, "parent_key": "uri", "at": "indexed_at", "order_id": "source_id", "gone": F.coalesce("status", F.lit("indexed")) == "deleted"},
        {"field": "text_hash", "parents": cache, "parent_key": "hash", "at": "created_at"},
    ]
    return broken_references(table(spark, sf_dir, "embedded_chunks"), "chunk_id", "indexed_at", specs)


@query("p5_report", f"SELECT ref_field, reason, period, count(*) AS n FROM ({P5_SQL}) GROUP BY ALL")
def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(p5_found(spark, sf_dir))


#: The words of the example queries.
WORDS = ("ledger", "budget", "schedule")
QUERY = "budget schedule vector"
#: Seconds: a time inside the tables, to tell old rows from new ones.
SPLIT_AT = 1767225600
TOP, WINDOW = 10, 50


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk."""
    rows = table(spark, sf_dir, "documents")
    return rows.select(F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("uri"), F.lit(0).alias("chunk_index"), "text", "title", "file_type")


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embedded_chunks").withColumnRenamed("source_uri", "uri")


def terms_sql(column: str) -> str:
    return f"[lower(x) FOR x IN regexp_extract_all({column}, '[\\p{{L}}\\p{{N}}]+') IF strlen(x) >= 2]"


def bm25_sql(source: str, words: tuple[str, ...], keys: str, out: str) -> str:
    """Scores of the rows of ``source`` (id, keys, text) that hold a word."""
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""
{out}_terms AS (SELECT id, unnest({terms_sql("text")}) AS term FROM {source}),
{out}_dl AS (SELECT id, count(*) AS dl FROM {out}_terms GROUP BY id),
{out}_size AS (SELECT (SELECT count(*) FROM {source}) AS n, (SELECT count(*) FROM {out}_terms) / (SELECT count(*) FROM {source}) AS avgdl),
{out}_tf AS (SELECT id, term, count(*) AS tf FROM {out}_terms WHERE term IN ({listed}) GROUP BY ALL),
{out}_df AS (SELECT term, count(*) AS df FROM {out}_tf GROUP BY term),
{out}_sum AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
              FROM {out}_tf JOIN {out}_df USING (term) JOIN {out}_dl USING (id), {out}_size GROUP BY id),
{out} AS (SELECT {keys}, score FROM {out}_sum JOIN {source} USING (id))"""


DOCS_SQL = "docs AS (SELECT doc_id AS id, 'doc://' || doc_id AS uri, 0 AS chunk_index, text, title, file_type FROM documents)"
CHUNKS_SQL = "chunks AS (SELECT chunk_id AS id, source_uri AS uri, chunk_index, text, title, file_type, content_type, vector FROM embedded_chunks)"
ORDER = "ORDER BY score DESC, uri NULLS FIRST, chunk_index NULLS FIRST"
#: The best WINDOW chunks by keywords, which the filters below work on.
FOUND_SQL = f"WITH {CHUNKS_SQL}, {bm25_sql('chunks', tuple(QUERY.split()), 'uri, chunk_index, file_type, title', 'kw')}, found AS (SELECT * FROM kw {ORDER} LIMIT {WINDOW})"


@query("bm25_topk", f"WITH {DOCS_SQL}, {bm25_sql('docs', WORDS, 'uri, chunk_index', 'kw')} SELECT uri, score FROM kw {ORDER} LIMIT {TOP}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_search(document_chunks(spark, sf_dir), WORDS, TOP).select("uri", "score")


@query(
    "bm25_batch_topk",
    f"""
WITH {DOCS_SQL},
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({terms_sql("query_text")}) AS term FROM search_queries) GROUP BY ALL),
t AS (SELECT id, unnest({terms_sql("text")}) AS term FROM docs),
dl AS (SELECT id, count(*) AS dl FROM t GROUP BY id),
size AS (SELECT (SELECT count(*) FROM docs) AS n, (SELECT count(*) FROM t) / (SELECT count(*) FROM docs) AS avgdl),
tf AS (SELECT id, term, count(*) AS tf FROM t SEMI JOIN q USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, 'doc://' || id AS uri, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (id), size GROUP BY query_id, id)
SELECT query_id, uri, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uri) AS place FROM s QUALIFY place <= {TOP}
""",
)
def bm25_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_batch(document_chunks(spark, sf_dir), table(spark, sf_dir, "search_queries"), TOP).drop("chunk_index")


@query("term_stats", f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({terms_sql('text')}) AS term FROM documents) GROUP BY term")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_statistics(document_chunks(spark, sf_dir))


@query(
    "postings_tf",
    f"""
WITH t AS (SELECT doc_id, unnest({terms_sql('text')}) AS term FROM documents)
SELECT 'doc://' || doc_id AS uri, 0 AS chunk_index, sum(count(*)) OVER (PARTITION BY doc_id)::BIGINT AS dl, term, count(*) AS tf FROM t GROUP BY doc_id, term
""",
)
def postings_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(document_chunks(spark, sf_dir))


FTS_WORDS = ("résumé", "budget", "schedule")
FTS_SQL = f"""
WITH {CHUNKS_SQL},
tok AS (SELECT id, uri, chunk_index, list_concat(regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\\p{{L}}\\p{{N}}]+'),
        regexp_extract_all(lower(strip_accents(coalesce(title, ''))), '[\\p{{L}}\\p{{N}}]+')) AS tokens FROM chunks),
tf AS (SELECT id, uri, chunk_index, len(tokens) AS dl, w, len(list_filter(tokens, lambda x: x = w)) AS tf FROM tok, (SELECT unnest({[w.replace("é", "e") for w in FTS_WORDS]}) AS w)),
size AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok),
df AS (SELECT w, count(*) AS df FROM tf WHERE tf > 0 GROUP BY w),
s AS (SELECT any_value(uri) AS uri, any_value(chunk_index) AS chunk_index,
             round(sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM tf JOIN df USING (w), size WHERE tf > 0 GROUP BY id)
SELECT uri, chunk_index, score FROM s {ORDER} LIMIT {TOP}
"""


@query("bm25_fts_topk", FTS_SQL)
def bm25_fts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts_search(stored_chunks(spark, sf_dir), " ".join(FTS_WORDS), TOP).select("uri", "chunk_index", "score")


@query("syntax_topk")
def syntax_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax_search(stored_chunks(spark, sf_dir), "+budget -invoice title:schedule vector", TOP).select("uri", "chunk_index", "score")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    rows = table(spark, sf_dir, "export_entries").where(F.size("vector") == 64)
    return rows.orderBy("entry_id").select("vector").head()[0]


ASKED_SQL = "asked AS (SELECT vector::DOUBLE[] AS q FROM export_entries WHERE len(vector) = 64 ORDER BY entry_id LIMIT 1)"


def cosine_sql(a: str, b: str) -> str:
    norms = f"sqrt(list_inner_product({a}, {a}) * list_inner_product({b}, {b}))"
    return f"CASE WHEN {norms} = 0 THEN 0.0 ELSE list_inner_product({a}, {b}) / {norms} END"


# What has no similarity becomes a zero vector, which has none.
VECTORS_SQL = "vecs AS (SELECT uri, chunk_index, CASE WHEN len(vector) = 64 AND NOT list_contains([x IS NULL FOR x IN vector], true) THEN vector::DOUBLE[] ELSE [0.0 FOR i IN range(64)]::DOUBLE[] END AS v FROM chunks)"
NEAR_SQL = f"near AS (SELECT uri, chunk_index, round({cosine_sql('v', 'q')}, 6) AS score FROM vecs, asked)"


@query("vector_topk", f"WITH {CHUNKS_SQL}, {ASKED_SQL}, {VECTORS_SQL}, {NEAR_SQL} SELECT * FROM near {ORDER} LIMIT {TOP}")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search(stored_chunks(spark, sf_dir), _query_vector(spark, sf_dir), TOP).select("uri", "chunk_index", "score")


@query(
    "vector_zero_guard",
    f"WITH {CHUNKS_SQL}, {ASKED_SQL}, {VECTORS_SQL}, {NEAR_SQL} SELECT count(*) AS chunks, count_if(score = 0) AS zero, count_if(score < 0) AS negative, count_if(score > 0) AS positive FROM near",
)
def vector_zero_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = vector_search(stored_chunks(spark, sf_dir), _query_vector(spark, sf_dir), 0)
    return scored.agg(F.count("*").alias("chunks"), F.count_if(F.col("score") == 0).alias("zero"), F.count_if(F.col("score") < 0).alias("negative"), F.count_if(F.col("score") > 0).alias("positive"))


@query(
    "vector_batch_topk",
    f"""
WITH {CHUNKS_SQL}, {VECTORS_SQL},
asked AS (SELECT chunk_id, vector::DOUBLE[] AS q FROM embedded_chunks WHERE chunk_id % 20 = 0 AND len(vector) = 64),
near AS (SELECT chunk_id, uri, chunk_index, round({cosine_sql('v', 'q')}, 6) AS score FROM vecs, asked)
SELECT chunk_id AS query_id, uri, chunk_index, score FROM near QUALIFY row_number() OVER (PARTITION BY chunk_id {ORDER}) <= 5
""",
)
def vector_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk whose id is divisible by 20, against all chunks."""
    chunks = stored_chunks(spark, sf_dir)
    asked = chunks.where((F.col("chunk_id") % 20 == 0) & (F.size("vector") == 64))
    return vector_batch(chunks, asked.select(F.col("chunk_id").alias("query_id"), "vector"), 5).drop("place")


@query("ann_topk")
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = stored_chunks(spark, sf_dir).where(F.size("vector") == 64)
    index = CellIndex.fit(chunks)
    return index.search(index.assign(chunks), _query_vector(spark, sf_dir), TOP).select("uri", "chunk_index", "score")


def hybrid_sql(alpha: float) -> str:
    return f"""
WITH {CHUNKS_SQL}, {ASKED_SQL}, {VECTORS_SQL}, {NEAR_SQL}, {bm25_sql('chunks', tuple(QUERY.split()), 'uri, chunk_index', 'kw')},
v AS (SELECT uri, chunk_index, {alpha} / (60 + row_number() OVER ({ORDER})) AS part FROM near {ORDER} LIMIT {3 * TOP}),
w AS (SELECT uri, chunk_index, (1 - {alpha}) / (60 + row_number() OVER ({ORDER})) AS part FROM kw {ORDER} LIMIT {3 * TOP}),
fused AS (SELECT uri, chunk_index, round(sum(part), 12) AS score FROM (FROM v UNION ALL FROM w) GROUP BY ALL)
SELECT * FROM fused {ORDER} LIMIT {TOP}
"""


def _hybrid(alpha: float | None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search(stored_chunks(spark, sf_dir), QUERY, _query_vector(spark, sf_dir), TOP, "hybrid", alpha).select("uri", "chunk_index", "score")

    return run


for _name, _alpha, _weight in (("hybrid_rrf", None, 0.7), ("hybrid_alpha0", -1.0, 0.0), ("hybrid_alpha1", 3.0, 1.0)):
    query(_name, hybrid_sql(_weight))(_hybrid(_alpha))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_search(stored_chunks(spark, sf_dir).drop("vector"), QUERY, WINDOW).select("uri", "chunk_index", "file_type", "title", "score")


@query("search_threshold", f"{FOUND_SQL} SELECT * FROM found WHERE score >= 5")
def search_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_least(_found(spark, sf_dir), 5)


@query("search_post_type", f"{FOUND_SQL} SELECT * FROM found WHERE file_type = 'md'")
def search_post_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_type(_found(spark, sf_dir), "md")


@query("search_post_glob", f"{FOUND_SQL} SELECT * FROM found WHERE regexp_matches(replace(uri, 'file://', ''), '^.*/repos/.*/[a-m].*\\.(md|txt|rst)$')")
def search_post_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_path(_found(spark, sf_dir), "*/repos/*/[a-m]*.{md,txt,rst}")


@query("search_post_substring", f"{FOUND_SQL} SELECT * FROM found WHERE contains(uri, 'repos')")
def search_post_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_path(_found(spark, sf_dir), "*repos*")


@query("search_post_after", f"{FOUND_SQL} SELECT * FROM found WHERE uri IN (SELECT uri FROM sources WHERE modified_at >= {SPLIT_AT})")
def search_post_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modified_after(_found(spark, sf_dir), table(spark, sf_dir, "sources"), SPLIT_AT)


@query("search_page", f"{FOUND_SQL} SELECT * FROM found {ORDER} LIMIT 10 OFFSET 20")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(_found(spark, sf_dir), 10, 20)


@query(
    "search_tool_page",
    f"""{FOUND_SQL}, w AS (SELECT * FROM found {ORDER} LIMIT 35), k AS (SELECT *, row_number() OVER ({ORDER}) AS place, count(*) OVER () AS total FROM w WHERE contains(uri, '/repos/'))
SELECT *, total > 25 AS has_more FROM k WHERE place > 5 AND place <= 25""",
)
def search_tool_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_page(_found(spark, sf_dir), 20, 5, path="/repos/")


@query("search_dedup_uri", f"{FOUND_SQL} SELECT uri, chunk_index, score FROM found QUALIFY row_number() OVER (PARTITION BY uri ORDER BY score DESC, chunk_index NULLS FIRST) = 1")
def search_dedup_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_of_file(_found(spark, sf_dir)).select("uri", "chunk_index", "score")


def _now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_sources(table(spark, sf_dir, "sources"))


def _then(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_sources(table(spark, sf_dir, "sources").where(F.col("indexed_at") <= SPLIT_AT))


LAST = "QUALIFY row_number() OVER (PARTITION BY uri ORDER BY indexed_at DESC, source_id DESC) = 1"
NOW_SQL = f"now_ AS (SELECT * FROM sources WHERE uri IS NOT NULL {LAST})"
THEN_SQL = f"then_ AS (SELECT * FROM sources WHERE uri IS NOT NULL AND indexed_at <= {SPLIT_AT} {LAST})"


@query(
    "index_stats",
    f"WITH {NOW_SQL} SELECT coalesce(file_type, 'unknown') AS file_type, count(*) AS files, coalesce(sum(chunk_count), 0)::BIGINT AS chunks, false AS whole FROM now_ GROUP BY 1 UNION ALL SELECT NULL, count(*), coalesce(sum(chunk_count), 0)::BIGINT, true FROM now_",
)
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_stats(_now(spark, sf_dir))


@query("list_sources", f"WITH {NOW_SQL} SELECT uri, file_type, chunk_count FROM now_ WHERE coalesce(status, 'indexed') <> 'deleted' ORDER BY uri")
def listed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_sources(living(_now(spark, sf_dir))).select("uri", "file_type", "chunk_count")


@query("date_filter", f"SELECT DISTINCT uri FROM sources WHERE modified_at >= {SPLIT_AT}")
def date_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modified_since(table(spark, sf_dir, "sources"), SPLIT_AT)


@query(
    "scan_classify",
    f"WITH {NOW_SQL}, {THEN_SQL} SELECT n.uri, CASE WHEN t.uri IS NULL THEN 'new' WHEN t.content_hash IS NOT DISTINCT FROM n.content_hash THEN 'same' ELSE 'changed' END AS state FROM now_ n LEFT JOIN then_ t USING (uri)",
)
def scan_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(_now(spark, sf_dir).select("uri", "content_hash"), _then(spark, sf_dir)).select("uri", "state")


@query("upsert_sources", f"WITH {NOW_SQL} SELECT uri, hex(content_hash) AS hash, indexed_at, source_id FROM now_")
def upsert_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = table(spark, sf_dir, "sources").where((F.col("indexed_at") > SPLIT_AT) & F.col("uri").isNotNull())
    return upserted(_then(spark, sf_dir), later).select("uri", F.hex("content_hash").alias("hash"), "indexed_at", "source_id")


@query("delete_sources", f"WITH {NOW_SQL} SELECT uri, source_id FROM now_ WHERE uri NOT IN (SELECT source_uri FROM embedded_chunks WHERE source_uri IS NOT NULL)")
def delete_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(_now(spark, sf_dir), stored_chunks(spark, sf_dir).where(F.col("uri").isNotNull())).select("uri", "source_id")


@query("delete_prefix", f"WITH {NOW_SQL} SELECT uri, source_id FROM now_ WHERE NOT starts_with(uri, 'file:///data/repos/atlas-web/') AND uri <> 'file:///data/repos/atlas-web'")
def delete_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    below = spark.createDataFrame([("file:///data/repos/atlas-web/",)], "uri string")
    return removed(_now(spark, sf_dir), below, prefix=True).select("uri", "source_id")


@query("stale_sources", f"WITH {NOW_SQL} SELECT uri FROM now_ WHERE starts_with(uri, 'file://') AND uri NOT IN (SELECT uri FROM documents WHERE uri IS NOT NULL)")
def stale_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stale(_now(spark, sf_dir), table(spark, sf_dir, "documents")).select("uri")


@query("parent_directories", f"WITH {NOW_SQL} SELECT DISTINCT regexp_replace(replace(uri, 'file://', ''), '/[^/]*$', '') AS directory FROM now_ ORDER BY 1")
def directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parent_directories(_now(spark, sf_dir))


@query(
    "embed_cache_join",
    """
WITH known AS (SELECT DISTINCT hash FROM embedding_cache WHERE hash IS NOT NULL AND vector IS NOT NULL)
SELECT content_type, k.hash IS NOT NULL AS cached, count(*) AS chunks FROM embedded_chunks c LEFT JOIN known k ON c.text_hash = k.hash GROUP BY ALL
""",
)
def embed_cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = looked_up(table(spark, sf_dir, "embedded_chunks"), table(spark, sf_dir, "embedding_cache"))
    return found.groupBy("content_type", "cached").agg(F.count("*").alias("chunks"))


@query("embed_cache_stats", "SELECT model, count(*) AS entries, count(DISTINCT hash) AS hashes, coalesce(sum(octet_length(vector)), 0)::BIGINT AS bytes FROM embedding_cache GROUP BY model")
def embed_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache_stats(table(spark, sf_dir, "embedding_cache"))


@query("embed_cache_vectors")
def embed_cache_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length and norm of every cached vector, read from its bytes."""
    rows = unpacked(table(spark, sf_dir, "embedding_cache").select("hash", "vector"), "vector", "v")
    return rows.select(F.hex("hash").alias("hash"), F.size("v").alias("dimensions"), F.round(F.sqrt(dot("v", "v")), 4).alias("norm"))


@query("embed_no_model", "SELECT count(*) AS chunks, 768::BIGINT * count(*) AS zeros FROM embedded_chunks")
def embed_no_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = with_vectors(stored_chunks(spark, sf_dir), None)
    return rows.agg(F.count("*").alias("chunks"), F.sum(F.size(F.filter("vector", lambda x: x == 0))).alias("zeros"))


@query(
    "vector_truncated",
    """
WITH v AS (SELECT entry_id, vector[1:16]::DOUBLE[] AS h FROM export_entries WHERE len(vector) >= 16)
SELECT entry_id, round(CASE WHEN list_inner_product(h, h) > 0 THEN h[1] / sqrt(list_inner_product(h, h)) ELSE 0 END, 4) AS first FROM v
""",
)
def vector_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "export_entries").where(F.size("vector") >= 16)
    return rows.select("entry_id", F.round(truncated("vector", 16)[0].cast("double"), 4).alias("first"))


@query(
    "export_rows",
    "SELECT source_uri AS uri, text, chunk_index, content_type, file_type, title, CASE WHEN byte_range IS NOT NULL THEN [byte_range.start_off, byte_range.end_off] END AS byte_range FROM embedded_chunks WHERE file_type = 'md'",
)
def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export_rows(stored_chunks(spark, sf_dir), "md")


@query("export_lines")
def exported_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export_lines(stored_chunks(spark, sf_dir), vectors=True)


@query("doc_headings", "SELECT doc_id, trim(regexp_extract(text, '(?m)^[^\\S\\n]*# (.*)$', 1), ' \t\r\n') AS heading FROM documents WHERE regexp_matches(text, '(?m)^[^\\S\\n]*# ')")
def doc_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", heading("text").alias("heading")).where(F.col("heading").isNotNull())


@query(
    "doc_lines",
    "SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + (CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END) END AS lines, replace(text[1:120], chr(10), ' ') AS snippet FROM documents WHERE text IS NOT NULL",
)
def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return rows.select("doc_id", line_count("text").alias("lines"), snippet("text").alias("snippet"))


@query("mime_types", f"SELECT doc_id, m.mime FROM documents d LEFT JOIN (VALUES {', '.join(repr(p) for p in MIME_OF.items())}) m(ext, mime) ON regexp_extract(d.uri, '[^/]\\.([^./]+)$', 1) = m.ext")
def mime_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", mime_column("uri").alias("mime"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages with a script, a title and marks of several kinds."""
    marked = F.concat(F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title><script>if (a < b) x();</script></head><body><h1>"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("<br>\n")), F.lit("</h1><p class=x>&amp;lt; end</p></body></html>"))
    return table(spark, sf_dir, "documents").select("doc_id", marked.alias("page"))


@query("html_text")
def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _pages(spark, sf_dir).select("doc_id", F.encode("page", "UTF-8").alias("content"), F.lit("text/html").alias("mime_type"), F.lit("html").alias("extension"))
    return parsed(files).select("doc_id", "text", "title")


@query("xml_text")
def xml_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("doc_id", xml_text("page").alias("text"))


@query("json_flatten", "SELECT event_id, k || ': ' || json_extract_string(props, '$.' || k) AS line FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return rows.select("event_id", F.concat("k", F.lit(": "), "v").alias("line"))


@query("parse_documents")
def parse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document read as the file that its type says."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"), mime_column("uri").alias("mime_type"), F.col("file_type").alias("extension"))
    return parsed(files).select("doc_id", "parser", "content_type", "language", F.length("text").alias("chars"), F.col("error").isNotNull().alias("failed"))


def _chunked(strategy: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "documents").select("doc_id", "text", "content_type", "file_type")
        return chunked(rows, strategy=strategy).select("doc_id", "chunk_index", "byte_range.start_off", "byte_range.end_off", F.md5("text").alias("digest"))

    return run


for _strategy in ("fixed", "semantic", "recursive", "code"):
    query(f"chunk_{_strategy}")(_chunked(_strategy))


@query("chunk_stats")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunked(table(spark, sf_dir, "documents").select("doc_id", "text", "content_type", "file_type"))
    return rows.groupBy("content_type").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.max(F.octet_length("text")).alias("longest"))


@query(
    "debounce_batches",
    """
WITH m AS (SELECT ts, user_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, user_id) >= 600000000, true)::INT AS new FROM events WHERE ts IS NOT NULL),
b AS (SELECT *, sum(new) OVER (ORDER BY ts, user_id ROWS UNBOUNDED PRECEDING) AS batch FROM m)
SELECT min(ts) AS started, max(ts) AS ended, count(*) AS events, count(DISTINCT user_id) AS members FROM b GROUP BY batch
""",
)
def debounce_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debounced_counts(table(spark, sf_dir, "events"), 600, "ts", "user_id")


@query(
    "debounce_by_user",
    """
WITH m AS (SELECT ts, user_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 600000000, true)::INT AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS batch FROM m)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM b GROUP BY user_id, batch
""",
)
def debounce_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debounced(table(spark, sf_dir, "events"), 600, "ts", "event_type", ("user_id",)).drop("members")
