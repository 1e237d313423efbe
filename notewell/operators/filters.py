"""Row filters. All are declarative predicates, so they reach the Parquet scan where the column is stored."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewell import fixed_values as fv
from notewell.functions import matching as m
from notewell.functions import scalars

WINDOW_DAYS = {"today": 1, "7d": 7, "30d": 30, "all": None}


def resolve_window(
    end: datetime | None = None, start: datetime | None = None, days: int | None = None, window: str | None = None
) -> tuple[datetime | None, datetime | None]:
    """Bounds of a time window; ``end`` is an argument so that results do not depend on the clock."""
    if window is not None:
        if window not in WINDOW_DAYS:
            raise ValueError(f"window must be one of {sorted(WINDOW_DAYS)}")
        days = WINDOW_DAYS[window] if days is None else days
    if start is None and days is not None:
        if end is None:
            raise ValueError("a window of days needs its end")
        start = end - timedelta(days=days)
    if start is not None and end is not None and start > end:
        raise ValueError("start must be <= end")
    return start, end


def in_window(df: DataFrame, ts: str, start: datetime | None = None, end: datetime | None = None,
              days: int | None = None, window: str | None = None) -> DataFrame:
    """Inclusive on both ends."""
    start, end = resolve_window(end, start, days, window)
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end))
    return df


def on_day(df: DataFrame, ts: str, day: str) -> DataFrame:
    """The half-open day ``[day, day + 1)``."""
    first = datetime.strptime(day, "%Y-%m-%d")
    return df.where((F.col(ts) >= F.lit(first)) & (F.col(ts) < F.lit(first + timedelta(days=1))))


def contains_any_case(columns: Sequence[str], query: str) -> Column:
    """Case-insensitive substring in any column; ``%`` and ``_`` of the query are literal."""
    escaped = query.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    out = F.lit(False)
    for name in columns:
        out = out | F.coalesce(F.col(name).ilike(f"%{escaped}%"), F.lit(False))
    return out


def search(df: DataFrame, columns: Sequence[str], query: str | None) -> DataFrame:
    return df if not query else df.where(contains_any_case(columns, query))


def parse_ids(ids: str | None) -> list[int] | None:
    """"1, 2,3" to integers; anything that is not digits is an error."""
    if not ids:
        return None
    tokens = [t.strip() for t in ids.split(",") if t.strip()]
    for token in tokens:
        if not token.isdigit():
            raise ValueError(f"invalid id {token!r}")
    return [int(t) for t in tokens] or None


def with_ids(df: DataFrame, id_col: str, ids: str | Iterable[int] | DataFrame | None) -> DataFrame:
    """Keep the listed ids; a DataFrame of ids is joined, a short list becomes a predicate."""
    if isinstance(ids, DataFrame):
        keys = ids.select(F.col(ids.columns[0]).alias(id_col))
        return df.join(keys, id_col, "left_semi")
    values = parse_ids(ids) if isinstance(ids, str) else (list(ids) if ids is not None else None)
    return df if values is None else df.where(F.col(id_col).isin(values))


def filter_products(df: DataFrame, category: str | None = None, min_price: float | None = None,
                    max_price: float | None = None, text: str | None = None, in_stock: bool | None = None) -> DataFrame:
    if category:
        df = df.where(F.col("category1") == category)
    if min_price is not None:
        df = df.where(F.col("price_eur") >= min_price)
    if max_price is not None:
        df = df.where(F.col("price_eur") <= max_price)
    if text:
        df = df.where(contains_any_case(["name", "sku"], text))
    if in_stock:
        df = df.where(F.col("stock") > 0)
    return df


def metadata_predicate(field: str, op: str, value) -> Column:
    """``$ne`` and ``$nin`` keep nulls; range operators and ``$in`` are null there, so a filter drops them.

    The latter stay bare comparisons: wrapped in a default they would not reach the scan.
    """
    col = F.col(field)
    if op == "$eq":
        return col.eqNullSafe(F.lit(value))
    if op == "$ne":
        return ~col.eqNullSafe(F.lit(value))
    if op == "$in":
        return col.isin(*value)
    if op == "$nin":
        return ~F.coalesce(col.isin(*value), F.lit(False))
    ranges = {"$gt": col > value, "$gte": col >= value, "$lt": col < value, "$lte": col <= value}
    if op not in ranges:
        raise ValueError(f"unknown operator {op!r}")
    return ranges[op]


def apply_filters(df: DataFrame, filters: Iterable[tuple[str, str, object]]) -> DataFrame:
    """AND of metadata predicates; fields that the table lacks are skipped."""
    for field, op, value in filters:
        if field in df.columns:
            df = df.where(metadata_predicate(field, op, value))
    return df


def filter_results(df: DataFrame, tier: int | None = None, text: str | None = None,
                   sensitive_only: bool = False, text_col: str = "transcription") -> DataFrame:
    if tier is not None:
        df = df.where(F.col("tier") == tier)
    if text:
        df = df.where(contains_any_case([text_col], text))
    if sensitive_only:
        df = df.where(F.col("contains_sensitive"))
    return df


def filter_opportunities(df: DataFrame, advisor: str | None = None, priority: str = "all",
                         status: str = "all", text: str | None = None) -> DataFrame:
    if priority not in ("all", "urgent", "vip", "tier3"):
        raise ValueError(f"invalid priority {priority!r}")
    if status not in ("all", *fv.ACTION_STATUSES):
        raise ValueError(f"invalid status {status!r}")
    if advisor and advisor.strip().lower() != "all":
        df = df.where(F.lower(F.trim("advisor_name")) == advisor.strip().lower())
    if priority == "urgent":
        df = df.where(F.col("urgency_level") == 3)
    elif priority == "vip":
        df = df.where("is_vip")
    elif priority == "tier3":
        df = df.where(F.col("tier") == 3)
    if status != "all":
        df = df.where(F.col("action_status") == status)
    if text and text.strip():
        blob = F.lower(F.concat_ws(" ", "client_name", "advisor_name", "next_action", "vip_label", "budget_label"))
        df = df.where(blob.contains(text.strip().lower()))
    return df


def empty_row(df: DataFrame) -> Column:
    out = F.lit(True)
    for name in df.columns:
        out = out & F.col(name).isNull()
    return out


def drop_empty(df: DataFrame, text_col: str) -> DataFrame:
    """Drop all-null rows and rows whose text is null or blank."""
    return df.where(~empty_row(df) & ~m.blank(F.col(text_col)))


def count_empty(df: DataFrame, text_col: str) -> DataFrame:
    """One row with the counts of both kinds, from one scan."""
    empty = empty_row(df)
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(empty).alias("empty_rows"),
        F.count_if(~empty & m.blank(F.col(text_col))).alias("blank_texts"),
    )


def null_literals(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Trim string columns and turn the usual spellings of null into null."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType) and f.name not in skip:
            value = F.trim(f.name)
            out[f.name] = F.when(value.isin(*fv.NULL_LITERALS), F.lit(None)).otherwise(value)
    return df.withColumns(out) if out else df


def note_errors(text: Column) -> Column:
    """Names of the input rules that a note breaks."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.array_compact(
        F.array(
            F.when(n < 10, F.lit("too_short")),
            F.when(n > 10000, F.lit("too_long")),
            F.when(F.lower(text).contains("<script"), F.lit("script_tag")),
        )
    )


def validate_notes(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Adds ``errors`` and the normalised language; the text is trimmed."""
    return df.withColumns(
        {"errors": note_errors(F.col(text)), lang: scalars.norm_language(F.col(lang)), text: F.trim(text)}
    )


def tag_gaps(df: DataFrame, text: str, tags: str) -> DataFrame:
    """Per note: keyword groups present in the text that no tag covers, and severity mentions."""
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    joined = F.lower(F.array_join(m.list_or_empty(F.col(tags)), ","))
    columns = {}
    for group, (words, covering) in fv.GAP_GROUPS.items():
        columns[f"{group}_gap"] = m.any_word(lowered, words) & ~m.any_word(joined, covering)
    allergy = m.any_word(lowered, fv.GAP_ALLERGY)
    columns["allergy"] = allergy
    columns["allergy_severity"] = allergy & m.any_word(lowered, fv.GAP_SEVERITY)
    return df.withColumns(columns)


def tag_gap_counts(df: DataFrame, text: str, tags: str) -> DataFrame:
    names = ("profession_gap", "relation_gap", "allergy", "allergy_severity")
    return tag_gaps(df, text, tags).agg(*[F.count_if(F.col(n)).alias(n) for n in names])
