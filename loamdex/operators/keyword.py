"""Keyword search over chunks: two BM25 engines, for one query or for a table of them.

Chunks are rows of (uri, chunk_index, text, title, ...). Every ranking is total: equal scores, to six
digits, go by uri and chunk_index.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loamdex.functions.text import fold, folded_tokens, query_terms, terms_of
from loamdex.operators.best import HALF, Best, blocks
from loamdex.session import materialize, shuffle_partitions, with_fields

#: Parameters of BM25: saturation of the term count, and share of the length normalisation.
K1, B = 1.2, 0.75
#: What an inverse document frequency that is not positive becomes in the full-text engine.
LEAST_IDF = 1e-6
#: Queries that a task scores at a time, and queries and chunks of one tile.
QUERY_BLOCK, TILE = 50_000, (256, 1024)
#: Any hit scores more than 0.
LEAST_SCORE = np.finfo(float).tiny


def saturated(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def postings(chunks: DataFrame, keys: Sequence[str] = ("uri", "chunk_index")) -> DataFrame:
    """(keys, dl, term, tf): how often each term is in each chunk, and the chunk's number of terms."""
    terms = chunks.select(*keys, terms_of("text").alias("terms"))
    each = terms.select(*keys, F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return each.groupBy(*keys, "dl", "term").agg(F.count("*").alias("tf"))


def term_statistics(chunks: DataFrame) -> DataFrame:
    """(term, df, cf): the chunks that hold a term, and its occurrences."""
    each = chunks.select(terms_of("text").alias("terms")).select(F.explode(F.array_distinct("terms")).alias("term"), "terms")
    held = each.groupBy("term").agg(F.count("*").alias("df"))
    every = chunks.select(F.explode(terms_of("text")).alias("term")).groupBy("term").agg(F.count("*").alias("cf"))
    return held.join(every, "term")


def _matching(chunks: DataFrame, counts: list[Column], dl: Column, idf, k: int | None) -> DataFrame:
    """``chunks`` that hold any of the counted phrases, scored; the top ``k``.

    One pass computes the statistics (partial sums, one row), a second the scores: nothing is
    exploded and no text is shuffled.
    """
    names = [f"_tf{i}" for i in range(len(counts))]
    counted = chunks.withColumns({"_dl": dl, **dict(zip(names, counts, strict=True))})
    size = counted.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avgdl"), *[F.count_if(F.col(t) > 0).alias(f"_df{i}") for i, t in enumerate(names)])
    scored = counted.where(reduce(lambda a, b: a | b, [F.col(t) > 0 for t in names])).crossJoin(F.broadcast(size))  # one row
    parts = [F.when(F.col(t) > 0, idf(F.col("_n"), F.col(f"_df{i}")) * saturated(F.col(t), F.col("_dl"), F.col("_avgdl"))).otherwise(0.0) for i, t in enumerate(names)]
    scored = scored.withColumn("score", F.round(reduce(add, parts), 6)).select(*chunks.columns, "score")
    return scored if k is None else scored.orderBy(F.desc("score"), "uri", "chunk_index").limit(k)


def bm25_search(chunks: DataFrame, query: str | Sequence[str], k: int | None = 10) -> DataFrame:
    """The ``k`` best chunks for a query, with ``score``; chunks without any of its terms are no hits.

    Terms are runs of letters and digits of two bytes or more. A term given twice counts twice; only the
    text is searched. All chunks count for the average length and the inverse document frequency, null
    and empty texts with length 0.
    """
    words = query_terms(query) if isinstance(query, str) else list(query)
    if not words:
        return chunks.where(F.lit(False)).withColumn("score", F.lit(0.0))
    terms = F.coalesce(terms_of("text"), F.array().cast("array<string>"))
    counts = [_occurrences(terms, [w]) for w in words]
    return _matching(chunks, counts, F.size(terms), lambda n, df: F.log(1 + (n - df + 0.5) / (df + 0.5)), k)


def phrases(query: str) -> list[list[str]]:
    """The tokens of each word of a query; words of a single byte are dropped, as are those without any token."""
    return [t for w in (query or "").split() if len(w.encode()) >= 2 and (t := fold(w))]


def fts_query(query: str) -> str:
    """A query as the full-text engine's match expression: words quoted, any of them."""
    return " OR ".join('"' + w.replace('"', '""') + '"' for w in (query or "").split() if len(w.encode()) >= 2)


def _occurrences(tokens: Column, phrase: list[str]) -> Column:
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda x: x == phrase[0]))
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - len(phrase) + 1, F.lit(1)))
    return F.size(F.filter(starts, lambda i: F.slice(tokens, i, F.lit(len(phrase))) == F.array(*map(F.lit, phrase))))


def fts_search(chunks: DataFrame, query: str, k: int | None = 10) -> DataFrame:
    """The ``k`` best chunks of the full-text engine: text and title, case and diacritics folded.

    A word of several tokens is a phrase. Length is that of both columns; inverse document frequencies
    that are not positive become LEAST_IDF.
    """
    wanted = phrases(query)
    if not wanted:
        return chunks.where(F.lit(False)).withColumn("score", F.lit(0.0))
    nothing = F.array().cast("array<string>")
    columns = [F.coalesce(folded_tokens(c), nothing) for c in ("text", "title")]
    counts = [reduce(add, [_occurrences(c, p) for c in columns]) for p in wanted]

    def idf(n: Column, df: Column) -> Column:
        raw = F.log((n - df + 0.5) / (df + 0.5))
        return F.when(raw > 0, raw).otherwise(LEAST_IDF)

    return _matching(chunks, counts, F.size(columns[0]) + F.size(columns[1]), idf, k)


def bm25_batch(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, uri, chunk_index, score, place): the ``k`` best chunks for each row of a bounded set of (query_id, query_text).

    Texts are read once; the queries' terms in each chunk are written in between, as numbers. Every task
    scores its chunks against the queries tile by tile and passes on its own k best; these are ranked per
    query. So hits, which grow as queries times chunks, are never rows. Rows of one uri and chunk_index
    are one chunk with the terms of all.
    """
    asked = queries.select("query_id", F.explode(terms_of("query_text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")).toArrow()
    term, who = (asked.column(c).combine_chunks().dictionary_encode("encode") for c in ("term", "query_id"))
    vocabulary, ids = term.dictionary, who.dictionary
    held = materialize(_held(chunks, vocabulary))
    size = held.agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).head()
    n, avgdl = size["n"] or 0, (size["dl"] or 0) / (size["n"] or 1)
    df = np.zeros(len(vocabulary))
    for r in held.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # no more than the vocabulary
        df[r["term"]] = r["df"]
    word, query = np.asarray(term.indices), np.asarray(who.indices)
    weight = np.log(1 + (n - df + 0.5) / (df + 0.5))[word] * np.asarray(asked.column("times"))
    schema = StructType([queries.schema["query_id"], chunks.schema["uri"], chunks.schema["chunk_index"], StructField("score", DoubleType())])
    parts = []
    for b in range(0, max(1, len(ids)), QUERY_BLOCK):
        mine = (query >= b) & (query < b + QUERY_BLOCK)
        parts.append(_scored(held, ids.slice(b, QUERY_BLOCK), query[mine] - b, word[mine], weight[mine], len(vocabulary), avgdl, k, schema))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "uri", "chunk_index")
    return reduce(DataFrame.unionByName, parts).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _held(chunks: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(uri, chunk_index, n, dl, terms): rows and length of each chunk, and which terms of the vocabulary it holds, with repetition."""
    keys = [chunks.schema[c] for c in ("uri", "chunk_index")]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            known = pc.index_in(lists.flatten(), value_set=vocabulary)
            kept = np.bincount(np.asarray(pc.list_parent_indices(lists))[np.asarray(known.is_valid())], minlength=batch.num_rows)
            terms = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)], pa.int32()), known.drop_null())
            yield pa.RecordBatch.from_arrays([batch.column("uri"), batch.column("chunk_index"), lists.value_lengths().cast(pa.int64()), terms], names=["uri", "chunk_index", "dl", "terms"])

    each = chunks.select("uri", "chunk_index", F.coalesce(terms_of("text"), F.array().cast("array<string>")).alias("terms"))
    found = each.mapInArrow(numbered, with_fields(StructType(keys), "dl bigint, terms array<int>"))
    return found.repartition(shuffle_partitions(chunks.sparkSession), "uri", "chunk_index").groupBy("uri", "chunk_index").agg(F.count("*").alias("n"), F.sum("dl").alias("dl"), F.flatten(F.collect_list("terms")).alias("terms"))


def _scored(held: DataFrame, ids: pa.Array, query: np.ndarray, word: np.ndarray, weight: np.ndarray, words: int, avgdl: float, k: int, schema: StructType) -> DataFrame:
    """The ``k`` best chunks of each task for queries that have the weighted words; ``ids`` by the queries' numbers."""
    width = np.bincount(query, minlength=len(ids))
    longest = np.argsort(-width, kind="stable")
    names, width = ids.take(pa.array(longest)), width[longest]
    by = np.argsort(np.argsort(longest)[query], kind="stable")  # entries in the order of ``names``
    word, weight, ends = word[by], weight[by], np.cumsum(width)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            top = Best(len(names), k)
            lists = block.column("terms")
            code, tf = np.unique(np.asarray(pc.list_parent_indices(lists)).astype(np.int64) * words + np.asarray(lists.flatten()), return_counts=True)
            row, term = np.divmod(code, max(1, words))
            part = saturated(tf, np.asarray(block.column("dl"))[row], avgdl)
            for a in range(0, block.num_rows, TILE[1]):
                of = slice(*np.searchsorted(row, (a, a + TILE[1])))
                there, at = np.unique(term[of], return_inverse=True)
                parts = np.zeros((len(there) + 1, min(TILE[1], block.num_rows - a)))
                parts[at, row[of] - a] = part[of]
                place = np.full(words, len(there))  # the last row is that of terms not there
                place[there] = np.arange(len(there))
                for b in range(0, len(names), TILE[0]):
                    some = slice(b, min(b + TILE[0], len(names)))
                    tile = np.zeros((some.stop - b, parts.shape[1]))
                    for j in range(width[b]):
                        n = np.count_nonzero(width[some] > j)
                        entry = (ends - width)[b : b + n] + j
                        tile[:n] += weight[entry][:, None] * parts[place[word[entry]]]
                    least = np.maximum(top.bound(some, tile, a == 0) - 2 * HALF, LEAST_SCORE)
                    q, r = np.divmod(np.flatnonzero(tile >= least[:, None]), tile.shape[1])
                    top.offer(some, q, r + a, np.round(tile[q, r], 6))
            yield from top.found(names, block)

    return held.select("uri", "chunk_index", "dl", "terms").mapInArrow(best, schema)


def parsed_query(query: str) -> list[tuple[str, str | None, list[str]]]:
    """(must, field, terms) of each clause of a query: ``+word``, ``-word``, ``"a phrase"``, ``field:word``.

    ``must`` is +, - or empty. Raises ValueError for an unclosed quote or an unknown field.
    """
    import re

    clauses = []
    rest = query.strip()
    pattern = re.compile(r'([+-]?)(?:(\w+):)?(?:"([^"]*)"|([^\s"]+))\s*')
    while rest:
        m = pattern.match(rest)
        if not m:
            raise ValueError(f"can't read the query from {rest!r} on")
        sign, name, quoted, word = m.groups()
        if name not in (None, "text", "title"):
            raise ValueError(f"no field {name!r}")
        if terms := query_terms(quoted if quoted is not None else word):
            clauses.append((sign, name, terms))
        rest = rest[m.end() :]
    return clauses


def syntax_search(chunks: DataFrame, query: str, k: int | None = 10) -> DataFrame:
    """The engine with a query syntax: required, excluded, quoted and fielded words over text and title."""
    clauses = parsed_query(query)
    nothing = F.array().cast("array<string>")
    of = {c: F.coalesce(terms_of(c), nothing) for c in ("text", "title")}

    def count(name: str | None, terms: list[str]) -> Column:
        return reduce(add, [_occurrences(of[c], terms) for c in ([name] if name else of)])

    wanted = [(sign, count(name, terms)) for sign, name, terms in clauses]
    if not any(sign != "-" for sign, _ in wanted):
        return chunks.where(F.lit(False)).withColumn("score", F.lit(0.0))
    allowed = reduce(lambda a, b: a & b, [c == 0 if sign == "-" else c > 0 for sign, c in wanted if sign], F.lit(True))
    scored = _matching(chunks.withColumn("_allowed", allowed), [c for sign, c in wanted if sign != "-"], F.size(of["text"]) + F.size(of["title"]), lambda n, df: F.log(1 + (n - df + 0.5) / (df + 0.5)), None)
    kept = scored.where("_allowed").drop("_allowed")
    return kept if k is None else kept.orderBy(F.desc("score"), "uri", "chunk_index").limit(k)
