"""What happens to hits after the search: filters, paging, one row a file.

Filters run after the limit, as a user of the command line expects: fewer than k rows may remain.
Filter chunks before the search to get k of the wanted kind.
"""

from __future__ import annotations

import re
import time
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamdex.functions.text import path_matches
from loamdex.operators.metadata import modified_since

DAY = 86400
SPANS = {"d": 1, "w": 7, "m": 30}
RANK = ("score", "uri", "chunk_index")


def at_least(hits: DataFrame, threshold: float) -> DataFrame:
    """Hits with a score of ``threshold`` or more, whatever the mode's scores mean."""
    return hits.where(F.col("score") >= threshold)


def of_type(hits: DataFrame, file_type: str | None) -> DataFrame:
    return hits if file_type is None else hits.where(F.col("file_type") == file_type)


def in_path(hits: DataFrame, pattern: str | None) -> DataFrame:
    """Hits whose path matches a glob (``*`` crosses slashes), or whose uri contains what is no glob."""
    return hits if pattern is None else hits.where(path_matches("uri", pattern))


def modified_after(hits: DataFrame, sources: DataFrame, since: int | None) -> DataFrame:
    """Hits in files modified at ``since`` (epoch seconds) or later; files without a time never match."""
    return hits if since is None else hits.join(modified_since(sources, since), "uri", "left_semi")


def narrowed(hits: DataFrame, sources: DataFrame | None = None, threshold: float = 0.0, file_type: str | None = None, path: str | None = None, since: int | None = None) -> DataFrame:
    """All filters in their order: threshold, type, path, date."""
    hits = in_path(of_type(at_least(hits, threshold), file_type), path)
    return hits if since is None else modified_after(hits, sources, since)


def page(hits: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """Rows ``offset`` + 1 to ``offset`` + ``limit`` of the ranking."""
    return hits.orderBy(F.desc("score"), "uri", "chunk_index").offset(max(0, offset)).limit(limit)


def tool_page(found: DataFrame, limit: int = 10, offset: int = 0, file_type: str | None = None, path: str | None = None) -> DataFrame:
    """A page as the tool server shows it, of a window of ``limit + offset + 10`` hits.

    ``path`` is a beginning or any part of the uri. ``total`` counts what is left of the window, so it
    and ``has_more`` are only hints.
    """
    limit, offset = min(50, max(1, limit)), max(0, offset)
    window = page(found, limit + offset + 10)
    kept = of_type(window, file_type)
    if path is not None:
        kept = kept.where(F.col("uri").startswith(path) | F.col("uri").contains(path))
    total = Window.partitionBy()  # the window has few rows
    rows = kept.withColumn("place", F.row_number().over(total.orderBy(F.desc("score"), "uri", "chunk_index"))).withColumn("total", F.count("*").over(total))
    return rows.where((F.col("place") > offset) & (F.col("place") <= offset + limit)).withColumn("has_more", F.col("total") > offset + limit)


def first_of_file(hits: DataFrame) -> DataFrame:
    """The best hit of each uri."""
    w = Window.partitionBy("uri").orderBy(F.desc("score"), "chunk_index")
    return hits.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") == 1).drop("_nth")


def skill_page(found: DataFrame, limit: int = 5, scope: str | None = None) -> DataFrame:
    """Skill files among the best ``5 * limit`` hits, each once; ``scope`` is a part of the uri."""
    limit = min(20, max(1, limit))
    kept = page(found, 5 * limit).where(F.col("uri").endswith("SKILL.md"))
    if scope:
        kept = kept.where(F.col("uri").contains(scope))
    return page(first_of_file(kept), limit)


def parse_after(text: str, now: int | None = None) -> int:
    """``7d``, ``2w``, ``3m`` (of 30 days) back from now, or YYYY-MM-DD in UTC, as epoch seconds.

    A day may be 1 to 31 in any month; those past its end run into the next.
    """
    text = text.strip()
    if m := re.fullmatch(r"(\d+)([dwm])", text):
        return (int(time.time()) if now is None else now) - int(m[1]) * SPANS[m[2]] * DAY
    m = re.fullmatch(r"(\d{1,4})-(\d{1,2})-(\d{1,2})", text)
    if not m:
        raise ValueError(f"no date or span: {text!r}")
    year, month, day = map(int, m.groups())
    if year < 1970 or not 1 <= month <= 12 or not 1 <= day <= 31:
        raise ValueError(f"no such date: {text!r}")
    return ((date(year, month, 1) - date(1970, 1, 1)).days + day - 1) * DAY
