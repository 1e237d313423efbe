"""Ranking and running operators that stay parallel when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewell import fixed_values as fv


SALTS = 64  # parts in which the first rows of a hot group are cut before they meet


def with_row_index(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """1-based position in the exported order; ranked only after the top-k cut."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("row_index", F.row_number().over(Window.orderBy(*order)))


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group.

    The rank filter directly above the window lets Spark cut every map partition to
    ``n`` rows per group before the shuffle, so a hot group moves at most ``n`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def recent_per_advisor(notes: DataFrame, n: int = 5, keys: Sequence[str] = ("advisor_name", "advisor_store"),
                       ts: str = "timestamp", id_col: str = "id") -> DataFrame:
    return top_n_per_group(notes, keys, [F.col(ts).desc(), F.col(id_col).desc()], n)


def top_n_of_hot_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, id_col: str) -> DataFrame:
    """As :func:`top_n_per_group`, cut in ``SALTS`` parts of each group first.

    For a large ``n``: a part gets ``n`` rows of each map task, and the last cut ``n`` rows of each part.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)))
    return top_n_per_group(top_n_per_group(salted, [*keys, "__salt"], order, n).drop("__salt"), keys, order, n)


def stratified_sample(df: DataFrame, lang: str, id_col: str, total: int, n_languages: int | None = None, seed: int = 42) -> DataFrame:
    """``max(1, total // n_languages)`` rows per language, chosen by a seeded hash of the id; without ``n_languages`` the languages are counted."""
    n_languages = df.select(lang).distinct().count() if n_languages is None else n_languages
    per_language = max(1, total // max(1, n_languages))
    order = [F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)]
    return top_n_of_hot_groups(df, [lang], order, per_language, id_col)


def running_totals(df: DataFrame, key: str, ts: str, id_col: str, value: Column, chunk: str = "day", fine: str = "minute") -> DataFrame:
    """Running sum and count per key in (ts, id) order: ``running_sum``, ``running_count``.

    A prefix sum in three levels: rows within (key, ``fine`` chunk), fine chunks within
    (key, ``chunk``), chunks within the key. Totals are pre-aggregated, so a hot key meets in
    no task with more than its rows of one fine chunk.
    """
    chunked = df.withColumns({"__chunk": F.date_trunc(chunk, F.col(ts)), "__fine": F.date_trunc(fine, F.col(ts)), "__v": value})
    totals = chunked.groupBy(key, "__chunk", "__fine").agg(F.sum("__v").alias("__s"), F.count("__v").alias("__n"))

    def ahead(rows: DataFrame, group: Sequence[str], by: str, level: str) -> DataFrame:
        before = Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select(*group, by, F.coalesce(F.sum("__s").over(before), F.lit(0)).alias(f"__s{level}"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(f"__n{level}"))

    coarse = totals.groupBy(key, "__chunk").agg(F.sum("__s").alias("__s"), F.sum("__n").alias("__n"))
    offsets = ahead(totals, [key, "__chunk"], "__fine", "1").join(ahead(coarse, [key], "__chunk", "0"), [key, "__chunk"])
    inside = Window.partitionBy(key, "__chunk", "__fine").orderBy(ts, id_col).rowsBetween(Window.unboundedPreceding, 0)
    return (
        chunked.withColumns({"__s": F.sum("__v").over(inside), "__n": F.count("__v").over(inside)})
        .join(offsets, [key, "__chunk", "__fine"])
        .withColumn("running_sum", F.coalesce(F.col("__s"), F.lit(0)) + F.col("__s1") + F.col("__s0"))
        .withColumn("running_count", F.col("__n") + F.col("__n1") + F.col("__n0"))
        .drop("__chunk", "__fine", "__v", "__s", "__n", "__s0", "__n0", "__s1", "__n1")
    )


def running_sentiment(notes: DataFrame, client: str = "client_id", ts: str = "timestamp", id_col: str = "id",
                      score: str = "sentiment_score", chunk: str = "day") -> DataFrame:
    """Mean sentiment of a client's notes so far."""
    out = running_totals(notes, client, ts, id_col, F.col(score), chunk)
    return out.withColumn(
        "running_sentiment", F.when(F.col("running_count") > 0, F.col("running_sum") / F.col("running_count"))
    ).drop("running_sum")


def running_points(notes: DataFrame, advisor: str = "advisor_id", ts: str = "timestamp", id_col: str = "id",
                   points: str = "points_awarded", chunk: str = "day") -> DataFrame:
    out = running_totals(notes, advisor, ts, id_col, F.coalesce(F.col(points), F.lit(0)), chunk)
    return out.withColumnRenamed("running_sum", "running_points").drop("running_count")


def _locate(counts: DataFrame, group: Sequence[str], level: str, wanted: DataFrame) -> DataFrame:
    """The ``level`` that holds each wanted rank of its group, and the rank ``__r`` inside it."""
    upto = F.sum("__n").over(Window.partitionBy(*group).orderBy(level).rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("__upto", upto).join(wanted, list(group))
    found = found.where((F.col("__r") <= F.col("__upto")) & (F.col("__r") > F.col("__upto") - F.col("__n")))
    return found.select(*group, level, "__p", (F.col("__r") - F.col("__upto") + F.col("__n")).alias("__r"))


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[int]) -> DataFrame:
    """Nearest-rank percentiles per key: the value at index ``round(p/100 * (n-1))`` (half to even).

    Exact without sorting a group in one task: counts per bucket locate the bucket of each
    rank, counts per part of that bucket locate the part, and only its rows are counted by
    value. Buckets (64 per power of two) and their parts (4,096 each) are monotone in the value
    and bounded in number.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    scaled = F.log2(F.abs(v) + 1.0) * 64
    bucket = (F.signum(v) * F.floor(scaled)).cast("int")
    part = F.floor((F.signum(v) * scaled - bucket) * 4096).cast("int")
    data = df.where(v.isNotNull()).select(*keys, v.alias("__v"), bucket.alias("__b"), part.alias("__s"))

    def counted(rows: DataFrame, *levels: str) -> DataFrame:
        return rows.groupBy(*keys, *levels).agg(F.count("*").alias("__n"))

    buckets = counted(data, "__b")
    rank = F.struct(*[(F.bround(F.lit(p / 100.0) * (F.sum("__n") - 1), 0) + 1).cast("bigint").alias(f"p{p}") for p in percents])
    ranks = buckets.groupBy(*keys).agg(rank.alias("__t"))
    wanted = ranks.select(*keys, F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col("__t")[f"p{p}"].alias("r")) for p in percents])).alias("__w"))
    wanted = wanted.select(*keys, F.col("__w.p").alias("__p"), F.col("__w.r").alias("__r"))
    for levels in (["__b"], ["__b", "__s"], ["__b", "__s", "__v"]):
        group = [*keys, *levels[:-1]]
        rows = data.join(wanted.select(*group).distinct(), group, "left_semi") if levels[1:] else data
        wanted = _locate(buckets if not levels[1:] else counted(rows, *levels), group, levels[-1], wanted)
    return wanted.groupBy(*keys).agg(*[F.max(F.when(F.col("__p") == p, F.col("__v"))).alias(f"p{p}") for p in percents])


def last_n(df: DataFrame, keys: Sequence[str], ts: str, id_col: str, n: int = fv.MAX_SNAPSHOTS) -> DataFrame:
    return top_n_of_hot_groups(df, keys, [F.col(ts).desc(), F.col(id_col).desc()], n, id_col)


def metrics_history(snapshots: DataFrame, end, id_col: str, hours: int = 24, metric: str | None = None, ts: str = "timestamp",
                    keep: int = fv.MAX_SNAPSHOTS) -> DataFrame:
    """The newest ``keep`` snapshots (of equally new ones the larger ids) that are younger than ``hours``, one metric projected when asked."""
    newest = snapshots.orderBy(F.col(ts).desc(), F.col(id_col).desc()).limit(keep)
    recent = newest.where(F.col(ts) > F.lit(end) - F.expr(f"INTERVAL {int(hours)} HOURS"))
    return recent.select(ts, metric) if metric else recent


def client_gender(text: Column) -> Column:
    """Gender of the earliest mention; the female pattern wins a tie."""
    def position(label: str) -> Column:
        at = F.regexp_instr(text, F.lit("(?iU)" + fv.GENDERS[label]))
        return F.when(at > 0, at)

    female, male = position("female"), position("male")
    return (
        F.when(female.isNull() & male.isNull(), F.lit(None).cast("string"))
        .when(male.isNull() | (female <= male), "female")
        .otherwise("male")
    )
