"""Sorting, top-k and paging."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewell.session import cut_lineage

NEAR = 10_000  # rows that one task may gather for a page
SORT_MODES = ("priority", "recent", "budget", "urgency")


def topk(df: DataFrame, score: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.col(score).desc_nulls_last(), F.col(tie)).limit(k)


def shortlist_size(k: int, n: int | None = None) -> int:
    """``max(6k, 12)``, at most the number of candidates when that is known."""
    size = max(6 * k, 12)
    return size if n is None else min(size, n)


def shortlist(df: DataFrame, base_score: str, tie: str, k: int) -> DataFrame:
    """Candidates by base score, to be re-ranked and cut to ``k`` afterwards."""
    return topk(df, base_score, shortlist_size(k), tie)


def numbered(df: DataFrame, order: Sequence[Column], out: str = "rank") -> tuple[DataFrame, DataFrame]:
    """Every row with its place from 1 in ``order``, and the ranges of the order: ``__range``, ``__start`` and ``__n`` rows.

    The rows are sorted by ranges and written once. A place is that within the range after the rows of
    the ranges before it, so no task holds more than a range. There is one range per shuffle
    partition at most, so their sizes are summed up on the driver.
    """
    spark = df.sparkSession
    placed = cut_lineage(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "sorted-rows").withColumn("__range", F.shiftright("__at", 33))
    sizes = sorted((r["__range"], r["n"]) for r in placed.groupBy("__range").agg(F.count("*").alias("n")).collect())
    starts = [0, *itertools.accumulate(n for _, n in sizes)]
    ranges = spark.createDataFrame([(k, starts[i], n) for i, (k, n) in enumerate(sizes)], "__range bigint, __start bigint, __n bigint")
    place = F.col("__start") + F.col("__at") - F.shiftleft("__range", 33) + 1
    return placed.join(F.broadcast(ranges.drop("__n")), "__range").withColumn(out, place).drop("__at", "__start"), ranges


def page(df: DataFrame, order: Sequence[Column], page_no: int, size: int, near: int = NEAR) -> DataFrame:
    """The rows of a 1-based page.

    A page among the first ``near`` rows is cut from each partition's first rows. For one further
    back the order is numbered, and only the ranges that hold the page are read, so that no task gathers all rows before it.
    """
    first = (page_no - 1) * size
    if first + size <= near:
        return df.orderBy(*order).offset(first).limit(size)
    rows, ranges = numbered(df, order, "__place")
    wanted = ranges.where((F.col("__start") < first + size) & (F.col("__start") + F.col("__n") > first)).select("__range")
    inside = rows.join(F.broadcast(wanted), "__range", "left_semi").where(F.col("__place").between(first + 1, first + size))
    return inside.orderBy("__place").select(*df.columns)


def page_info(df: DataFrame, page_no: int, size: int) -> DataFrame:
    """One row: total, page, page_size, total_pages."""
    return df.agg(F.count("*").alias("total")).select(
        "total",
        F.lit(page_no).alias("page"),
        F.lit(size).alias("page_size"),
        F.ceil(F.col("total") / size).cast("bigint").alias("total_pages"),
    )


def sort_columns(mode: str, id_col: str = "note_id") -> list[Column]:
    """Descending orders of the opportunity board with an id tie-break."""
    if mode not in SORT_MODES:
        raise ValueError(f"sort must be one of {SORT_MODES}")
    lead = {
        "priority": [F.col("priority_score").desc()],
        "recent": [F.col("timestamp").desc_nulls_last()],
        "budget": [F.coalesce(F.col("budget_value"), F.lit(0.0)).desc()],
        "urgency": [F.col("urgency_level").desc(), F.col("priority_score").desc()],
    }[mode]
    return [*lead, F.col(id_col).asc()]


def sort_opportunities(df: DataFrame, mode: str = "priority", id_col: str = "note_id") -> DataFrame:
    return df.orderBy(*sort_columns(mode, id_col))


def ranked_opportunities(df: DataFrame, mode: str = "priority", id_col: str = "note_id") -> DataFrame:
    """Every row with ``rank``, its place from 1 in the whole order of ``mode``."""
    return numbered(df, sort_columns(mode, id_col))[0].drop("__range")


def candidate_limit(limit: int) -> int:
    return min(max(limit * 10, 500), 5000)


def recent_candidates(notes: DataFrame, limit: int, ts: str = "timestamp", id_col: str = "id") -> DataFrame:
    """The newest rows that a board looks at; taken *before* its filters, by design of the board."""
    return notes.orderBy(F.col(ts).desc_nulls_last(), F.col(id_col)).limit(candidate_limit(limit))


def top_tags(df: DataFrame, tags: str, n: int) -> DataFrame:
    return topk(tag_counts(df, tags), "count", n, "tag")


def tag_counts(df: DataFrame, tags: str) -> DataFrame:
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("count"))
