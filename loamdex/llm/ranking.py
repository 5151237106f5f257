"""One ranking out of the hit lists of several engines, whatever the scale of their scores.

Method: robust rank aggregation. In each list an item has its rank divided by the number of items
of the query, 1 where the list does not hold it. Were the lists random, the k-th smallest of n such
ranks x would have a beta distribution; its probability P(Beta(k, n - k + 1) <= x) tells how unlikely
it is that k lists agree on a rank that good. An item's significance is the smallest of these
probabilities, each corrected for the choice among the n of them; items are ranked by it.

The plain correction multiplies each probability by n, as if every list counted the same. Here the
lists have weights, so the correction is the weighted one of Bonferroni: the probability of the k-th
smallest rank is divided by the weight that those k lists have together. With equal weights this
orders single lists last among equals, and no list's range of scores plays any part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of the vector list where a query gives none.
DEFAULT_ALPHA = 0.7


def beta_order_probability(x: Column, k: Column, n: Column) -> Column:
    """P(Beta(k, n - k + 1) <= x): the chance that at least k of n uniform ranks are at most x.

    The upper tail of a binomial distribution, summed term by term, so that small values stay exact.
    """
    one = F.lit(1.0)
    choose = F.aggregate(F.sequence(F.lit(1), k), one, lambda a, i: a * (n - i + 1) / i)
    first = choose * F.pow(x, k) * F.pow(one - x, n - k)
    start = F.struct(first.alias("term"), first.alias("total"))
    # Past k each term follows from the one before it; k = n has no further term.
    steps = F.when(k < n, F.sequence(k + 1, n)).otherwise(F.array().cast("array<int>"))

    def step(a: Column, j: Column) -> Column:
        term = a["term"] * (n - j + 1) / j * x / (one - x)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    return F.when(x >= 1, one).otherwise(F.aggregate(steps, start, step, lambda a: a["total"]))


def significance(places: Column, n: Column) -> Column:
    """The least corrected probability of an item; ``places`` is (x, w) of the lists that hold it, sorted."""
    at = F.transform(places, lambda p, i: F.struct((i + 1).cast("int").alias("k"), p["x"].alias("x"), F.aggregate(F.slice(places, F.lit(1), i + 1), F.lit(0.0), lambda a, q: a + q["w"]).alias("w")))
    return F.array_min(F.transform(at, lambda p: beta_order_probability(p["x"], p["k"], n) / p["w"]))


def score_bucket(score: Column) -> Column:
    """A whole number that grows with a score: 256 steps between powers of two. Null for null.

    Where the logarithm is off by one at a power of two the fraction makes up for it, so larger scores
    never have smaller numbers.
    """
    size = F.abs(score)
    exponent = F.floor(F.log2(size))
    place = F.lit(1100 * 256) + exponent * 256 + F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * 256)
    found = F.when(score == 0, 0).when(size == float("inf"), 1 << 20).otherwise(place)
    return (F.signum(score) * found).cast("bigint")


def ranked_hits(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, uri, chunk_index, lists, significance, place) of every item of each hybrid query.

    The vector list weighs alpha (cut to 0..1, null means 0.7), the other lists with a hit share
    1 - alpha equally; a list of weight 0 takes no part, so an item in no other list has no place.
    If only such lists have hits, the query has no rows. Where the vector list has no hit the others
    share the whole weight, and the reverse: weights count relative to the lists that are there.
    Repeated rows count once, by their best score; null and NaN scores and rows of unknown queries are
    no hits; infinite scores are. Equal scores in a list, and equal significance, are ordered by uri
    and chunk_index (null first). Null uri or chunk_index are a value like any other. Repeated query
    rows must agree; the largest alpha counts. Extra columns of either table are ignored.

    A list of any length is ranked by buckets of its scores: hits are numbered within a bucket, and a
    bucket starts after the sizes of those above it, of which a list has few rows. Everything else about
    a query is counted within tasks first. So a query with a third of all hits is spread over its buckets.
    """
    alpha = F.greatest(F.least(F.coalesce(F.col("alpha"), F.lit(DEFAULT_ALPHA).cast("float")).cast("double"), F.lit(1.0)), F.lit(0.0))
    asked = queries.where((F.col("search_mode") == "hybrid") & F.col("query_id").isNotNull()).groupBy("query_id").agg(F.max(alpha).alias("alpha"))
    is_vector = F.col("engine") == "vector"
    hits = (
        results.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("engine").isNotNull())
        .groupBy("query_id", "engine", "uri", "chunk_index")
        .agg(F.max(F.col("score").cast("double")).alias("score"))
        .join(asked, "query_id")
        .where(F.when(is_vector, F.col("alpha") > 0).otherwise(F.col("alpha") < 1))
        .withColumn("bucket", score_bucket(F.col("score")))
    )
    sizes = hits.groupBy("query_id", "engine", "bucket").agg(F.count("*").alias("size"), F.max("alpha").alias("alpha"))
    above = Window.partitionBy("query_id", "engine").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("query_id", "engine", "bucket", F.coalesce(F.sum("size").over(above), F.lit(0)).alias("start"))
    lists = sizes.groupBy("query_id", "engine").agg(F.max("alpha").alias("alpha"))
    counts = lists.groupBy("query_id").agg(F.max("alpha").alias("alpha"), F.count("*").cast("int").alias("n"), F.count_if(~is_vector).alias("others"))
    items = hits.select("query_id", "uri", "chunk_index").distinct().groupBy("query_id").agg(F.count("*").alias("items"))
    whole = F.when(F.col("n") > F.col("others"), F.col("alpha")).otherwise(0.0) + F.when(F.col("others") > 0, 1 - F.col("alpha")).otherwise(0.0)
    known = counts.join(items, "query_id").select("query_id", "n", "items", F.try_divide("alpha", whole).alias("first_weight"), F.try_divide(1 - F.col("alpha"), F.col("others") * whole).alias("other_weight"))
    in_bucket = Window.partitionBy("query_id", "engine", "bucket").orderBy(F.desc("score"), "uri", "chunk_index")
    ranked = hits.withColumn("nth", F.row_number().over(in_bucket)).join(starts, ["query_id", "engine", "bucket"]).join(known, "query_id")
    x = (F.col("start") + F.col("nth")) / F.col("items")
    w = F.when(is_vector, F.col("first_weight")).otherwise(F.col("other_weight"))
    # At most one entry for each list.
    places = ranked.groupBy("query_id", "uri", "chunk_index", "n").agg(F.sort_array(F.collect_list(F.struct(x.alias("x"), (-w).alias("v"), w.alias("w")))).alias("places"))
    scored = places.select("query_id", "uri", "chunk_index", F.size("places").alias("lists"), F.round(significance(F.col("places"), F.col("n")), 9).alias("significance"))
    best = Window.partitionBy("query_id").orderBy("significance", "uri", "chunk_index")
    return scored.withColumn("place", F.row_number().over(best))


def fused_top(queries: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """(query_id, uri, chunk_index): the first ``k`` items of the combined ranking of each hybrid query.

    Only ``k`` items of a query leave each task for the last step.
    """
    return ranked_hits(queries, results).where(F.col("place") <= k).select("query_id", "uri", "chunk_index")
