"""Terms by how characteristic they are of a document against the whole collection.

Method: divergence from randomness. The count of a term in a document is first brought to the
average length (normalisation 2: tf * log2(1 + average / length)). Its information content is how
unlikely that count would be if the collection's occurrences fell on documents geometrically with
their mean rate; the after-effect of Laplace, 1 / (tf + 1), is the gain that one more occurrence
still brings. Their product is the weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.functions.text import terms_of


def dfr_weight(tf: Column, length: Column, avg_length: Column, rate: Column) -> Column:
    """Geometric information content times Laplace gain; ``rate`` is occurrences per document."""
    n = tf * F.log2(1 + avg_length / length)
    # -log2 of (1 / (1 + rate)) * (rate / (1 + rate)) ** n
    information = F.log2(1 + rate) + n * F.log2((1 + rate) / rate)
    return information / (n + 1)


def term_statistics(documents: DataFrame) -> DataFrame:
    """(term, occurrences) over all documents. Counted within each partition before the shuffle."""
    # Terms are never null; saying so lets both users of the counts share one shuffle.
    return documents.select(F.explode(terms_of("text")).alias("term")).where(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("occurrences"))


def characteristic_terms(documents: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """(doc_id, term, score): the ``k`` most characteristic terms of each probed document.

    All statistics are over all documents. Null, empty and blank texts have no terms but count as
    documents; with no term at all there are no rows. Rows of documents repeated under one doc_id
    count as one longer document. Equal scores (to nine digits) are ordered by term. A probe that is
    null, repeated, unknown or without terms has one row or none. Other columns are ignored.

    Terms are counted within each partition before they are shuffled, so a frequent term costs one
    row a partition; the totals come from the same counts. Only the probed documents' own terms are
    joined with them.
    """
    asked_ids = probes.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    asked = documents.select("doc_id", "text").join(asked_ids, "doc_id", "left_semi").select("doc_id", F.explode(terms_of("text")).alias("term"))
    tf = asked.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    tf = tf.withColumn("length", F.sum("tf").over(Window.partitionBy("doc_id")))
    total = term_statistics(documents)
    # One row each: the totals reuse the exchange of the counts.
    size = total.agg(F.sum("occurrences").alias("all")).crossJoin(documents.agg(F.count("*").alias("docs"))).withColumn("avg_length", F.col("all") / F.col("docs"))
    scored = tf.join(total, "term").crossJoin(F.broadcast(size))  # size is one row
    score = dfr_weight(F.col("tf"), F.col("length"), F.col("avg_length"), F.col("occurrences") / F.col("docs"))
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.round("score", 9)), "term")
    return scored.withColumn("score", score).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("doc_id", "term", "score")
