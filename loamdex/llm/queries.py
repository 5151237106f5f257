"""The registered queries of the data-preparation operators: callables over (spark, sf_dir), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.llm.bpe import encode_column
from loamdex.llm.handmade import not_by_hand
from loamdex.llm.mixing import mix_shares, sample_mix, short_sources
from loamdex.llm.neighbours import similar_pairs
from loamdex.llm.prose import not_prose, prose_statistics
from loamdex.llm.ranking import fused_top
from loamdex.llm.splitting import oversized, split_oversized
from loamdex.llm.terms import characteristic_terms
from loamdex.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("collection"), F.col(i).alias("id"), "vector") for t, i in (("embedded_chunks", "chunk_id"), ("export_entries", "entry_id"))]
    return similar_pairs(parts[0].unionByName(parts[1]), 0.9, 5).select("collection", "id_a", "id_b")


P2_SQL = """
WITH hits AS (SELECT query_id, engine, uri, chunk_index, max(score) AS score FROM search_results
              WHERE score IS NOT NULL AND NOT isnan(score) AND engine IS NOT NULL GROUP BY ALL),
asked AS (SELECT query_id, max(greatest(least(coalesce(alpha, 0.7::FLOAT)::DOUBLE, 1.0), 0.0)) AS alpha
          FROM search_queries WHERE search_mode = 'hybrid' GROUP BY query_id),
kept AS (SELECT h.*, alpha FROM hits h JOIN asked USING (query_id) WHERE CASE WHEN engine = 'vector' THEN alpha > 0 ELSE alpha < 1 END),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, engine ORDER BY score DESC, uri NULLS FIRST, chunk_index NULLS FIRST) AS rank FROM kept),
lists AS (SELECT query_id, count(DISTINCT engine) AS n, count(DISTINCT engine) FILTER (engine <> 'vector') AS others,
                 count(DISTINCT (uri, chunk_index)) AS items, max(alpha) AS alpha, bool_or(engine = 'vector') AS vec FROM kept GROUP BY query_id),
weighed AS (SELECT query_id, engine, uri, chunk_index, n, rank / items AS x,
                   CASE WHEN engine = 'vector' THEN l.alpha ELSE (1 - l.alpha) / others END
                   / ((CASE WHEN vec THEN l.alpha ELSE 0 END) + (CASE WHEN others > 0 THEN 1 - l.alpha ELSE 0 END)) AS w
            FROM ranked JOIN lists l USING (query_id)),
placed AS (SELECT *, row_number() OVER it AS k, sum(w) OVER it AS cum FROM weighed
           WINDOW it AS (PARTITION BY query_id, uri, chunk_index ORDER BY x, w DESC ROWS UNBOUNDED PRECEDING)),
tails AS (SELECT query_id, uri, chunk_index, cum,  -- at least k of n uniform values are at most x, for n up to 3
                 CASE WHEN x >= 1 THEN 1 WHEN k = n THEN x ** n WHEN k = 1 THEN 1 - (1 - x) ** n ELSE 3 * x * x * (1 - x) + x ** 3 END AS p FROM placed),
scored AS (SELECT query_id, uri, chunk_index, round(min(p / cum), 9) AS significance FROM tails GROUP BY ALL)
SELECT query_id, uri, chunk_index FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY significance, uri NULLS FIRST, chunk_index NULLS FIRST) <= 5
"""


@query("p2_found", P2_SQL)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_top(table(spark, sf_dir, "search_queries"), table(spark, sf_dir, "search_results"), 5)


@query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_by_hand(table(spark, sf_dir, "documents")).select("uri")


@query("p6_found", "SELECT chunk_id FROM embedded_chunks c JOIN chunk_profiles p USING (content_type) WHERE strlen(c.text) > p.chunk_size")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized(p6_pieces(spark, sf_dir))


@query("p6_pieces")
def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "embedded_chunks"), table(spark, sf_dir, "chunk_profiles"))


@query("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return characteristic_terms(table(spark, sf_dir, "documents"), table(spark, sf_dir, "term_probes"), 1).select("doc_id", "term")


@query("p8_ids")
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


@query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return short_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).select("mix_name", "source")


@query("p9_shares")
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@query("p9_sample")
def p9_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_prose(table(spark, sf_dir, "documents")).select("doc_id")


@query("p10_statistics")
def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose_statistics(table(spark, sf_dir, "documents"))
