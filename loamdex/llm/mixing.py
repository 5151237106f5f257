"""Mixes of sources with target shares of a token budget.

Method: systematic sampling. Each document of a source has the same expected number of copies in a
mix, the wanted tokens over the source's tokens, at most max_repeats. The documents of a source are
laid out in a fixed order, their expected copies summed up from the start, one random offset added,
and a document comes out once for each whole number its interval crosses. So the number of copies
of any stretch of a source is right to within one, whatever the draw.

The shares are those of the sample. One cannot be reached where the sample has every document of the
source max_repeats times and still has fewer tokens than wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamdex.llm.bpe import count_tokens
from loamdex.session import materialize

#: Pieces of a source whose documents are numbered apart; a source of any size is spread over them.
STRETCHES = 512
#: What names a row of the targets; the same mix and source may come with several budgets.
TARGET = ("mix_name", "source", "target_share", "max_repeats", "budget_tokens")


def source_tokens(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of the documents with a source, whole texts."""
    return count_tokens(documents.select("doc_id", "source", "text").where(F.col("source").isNotNull()), vocabulary=vocabulary).drop("text")


def mix_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Each row of ``targets`` with what its source can give.

    Adds ``source_tokens`` (0 without documents), ``wanted_tokens`` (share times budget),
    ``reachable_tokens`` (source_tokens times max_repeats) and ``copies`` (expected copies of each
    document, at most max_repeats; 0 where there is nothing to give). A null share, budget or
    max_repeats counts as 0; negative ones too. Rows that are equal then count once.
    """
    tokens = sized.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    # A few rows for each mix: the planner broadcasts them if they are small.
    zero = F.lit(0)
    rows = targets.select("mix_name", "source", *[F.greatest(F.coalesce(c, zero), zero).alias(c) for c in TARGET[2:]]).distinct()
    rows = rows.join(tokens, "source", "left").withColumn("source_tokens", F.coalesce("source_tokens", zero))
    rows = rows.withColumn("wanted_tokens", F.col("target_share") * F.col("budget_tokens")).withColumn("reachable_tokens", F.col("source_tokens") * F.col("max_repeats"))
    full = F.least(F.col("wanted_tokens") / F.col("source_tokens"), F.col("max_repeats").cast("double"))
    return rows.withColumn("copies", F.when(F.col("source_tokens") > 0, full).otherwise(F.lit(0.0)))


def number_in_source(sized: DataFrame) -> DataFrame:
    """``sized`` plus ``position``, 1 to n within the source in the order of a hash of doc_id.

    The hash cuts a source into STRETCHES pieces; rows are numbered within a piece, and a piece
    starts after the sum of the pieces before it. No task holds a whole source.
    """
    order = F.xxhash64("doc_id")
    cut = sized.withColumn("_order", order).withColumn("_stretch", F.pmod(F.shiftright("_order", 32), F.lit(STRETCHES)).cast("int"))
    counts = cut.groupBy("source", "_stretch").agg(F.count("*").alias("_n"))
    # At most STRETCHES rows a source.
    before = Window.partitionBy("source").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source", "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("source", "_stretch").orderBy("_order", "doc_id")
    numbered = cut.withColumn("_at", F.row_number().over(inside)).join(starts, ["source", "_stretch"])
    return numbered.withColumn("position", F.col("_start") + F.col("_at")).drop("_order", "_stretch", "_start", "_at")


def draw(sized: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """The rows of ``plan`` with each document drawn for them: doc_id, tokens and copies (1 or more)."""
    given = plan.where(F.col("copies") > 0).select(*TARGET, F.col("copies").alias("_each"))
    offset = F.pmod(F.xxhash64(F.lit(seed), "mix_name", "source"), F.lit(1 << 32)) / float(1 << 32)
    drawn = number_in_source(sized).join(given, "source").withColumn("_u", offset)
    # Rounded, so that a whole number of copies is not lost to the last bit of a product.
    upto = F.floor(F.round(F.col("_each") * F.col("position") + F.col("_u"), 6))
    since = F.floor(F.round(F.col("_each") * (F.col("position") - 1) + F.col("_u"), 6))
    return drawn.withColumn("copies", (upto - since).cast("int")).where(F.col("copies") > 0).select(*TARGET, "doc_id", "tokens", "copies")


def sample_mix(documents: DataFrame, targets: DataFrame, seed: int = 0, vocabulary: str | None = None) -> DataFrame:
    """(mix_name, source, doc_id, tokens, copies): the documents of each mix, each with its copies (1 or more).

    A document appears at most max_repeats times. The offset of a mix and source follows from
    ``seed`` and both names, so equal input gives equal output on any number of tasks. Null sources
    belong to no mix; null and empty texts have no tokens and are drawn like the rest. Rows repeated
    under a doc_id are drawn one by one.
    """
    sized = materialize(source_tokens(documents, vocabulary))  # three steps use it; tokens are counted once
    return draw(sized, mix_plan(sized, targets), seed).select("mix_name", "source", "doc_id", "tokens", "copies")


def reached(documents: DataFrame, targets: DataFrame, seed: int = 0, vocabulary: str | None = None) -> DataFrame:
    """Each row of the plan with ``drawn_tokens`` and ``documents`` of its sample, 0 where nothing was drawn, and ``short``.

    ``short``: the sample has every document max_repeats times, and still fewer tokens than wanted.
    """
    sized = materialize(source_tokens(documents, vocabulary))
    plan = mix_plan(sized, targets)
    got = draw(sized, plan, seed).groupBy(*TARGET).agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.count("*").alias("documents"))
    # Grouped, not joined: a null mix is one too.
    bare = plan.select(*TARGET, "wanted_tokens", "reachable_tokens", F.lit(0).cast("bigint").alias("drawn_tokens"), F.lit(0).cast("bigint").alias("documents"))
    rows = bare.unionByName(got, allowMissingColumns=True).groupBy(*TARGET)
    rows = rows.agg(*[F.max(c).alias(c) for c in ("wanted_tokens", "reachable_tokens")], *[F.sum(c).alias(c) for c in ("drawn_tokens", "documents")])
    used_up = F.col("drawn_tokens") >= F.col("reachable_tokens")
    return rows.withColumn("short", used_up & (F.col("drawn_tokens") < F.col("wanted_tokens")))


def mix_shares(documents: DataFrame, targets: DataFrame, seed: int = 0, vocabulary: str | None = None) -> DataFrame:
    """(mix_name, source, target_share, actual_share, drawn_tokens, documents, short) of every target.

    ``actual_share`` is of the mix's budget; 0 where nothing was drawn, null for a budget of 0.
    """
    share = F.when(F.col("budget_tokens") > 0, F.col("drawn_tokens") / F.col("budget_tokens"))
    rows = reached(documents, targets, seed, vocabulary)
    return rows.select("mix_name", "source", "target_share", F.round(share, 6).alias("actual_share"), "drawn_tokens", "documents", "short")


def short_sources(documents: DataFrame, targets: DataFrame, seed: int = 0, vocabulary: str | None = None) -> DataFrame:
    """(mix_name, source) whose sample uses up the source, max_repeats copies of each document, and misses the share."""
    return reached(documents, targets, seed, vocabulary).where("short").select("mix_name", "source").distinct()
