"""Array functions: parsing, ordered unions, case-insensitive de-duplication, set scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notewell.functions import matching as m


def trimmed(values: Column) -> Column:
    """Trim the entries and drop null and blank ones."""
    return F.filter(F.transform(m.list_or_empty(values), lambda v: F.trim(v)), lambda v: v != "")


def merge_unique(first: Column, second: Column) -> Column:
    """Entries of both lists in order of first appearance."""
    return F.array_distinct(trimmed(F.concat(m.list_or_empty(first), m.list_or_empty(second))))


def dedup_ci(values: Column) -> Column:
    """Keep the first spelling of entries that differ only in case."""
    def keep_first(clean: Column) -> Column:
        lowered = F.transform(clean, lambda v: F.lower(v))
        return m.let(lowered, lambda low: F.filter(clean, lambda v, i: F.array_position(low, F.lower(v)) == i + 1))

    return m.let(trimmed(values), keep_first)


def append_unique(values: Column, value: Column | str, condition: Column) -> Column:
    """Append ``value`` when ``condition`` holds and no spelling of it is present."""
    value = F.lit(value) if isinstance(value, str) else value
    present = F.exists(values, lambda v: F.lower(v) == F.lower(value))
    return F.when(condition & ~present, F.concat(values, F.array(value))).otherwise(values)


def parse_list(col: Column) -> Column:
    """"['a', 'b']", "[\\"a\\"]" or a comma list, as an array of trimmed strings."""
    text = F.trim(F.coalesce(col, F.lit("")))
    quoted = F.regexp_extract_all(text, F.lit("'([^']*)'|\"([^\"]*)\""), F.lit(0))
    unquoted = F.transform(quoted, lambda q: F.substring(q, F.lit(2), F.length(q) - 2))
    bare = F.split(F.regexp_replace(text, r"^\[|\]$", ""), ",")
    is_quoted = text.startswith("[") & (F.size(quoted) > 0)
    return trimmed(F.when(is_quoted, unquoted).otherwise(bare))


def tag_set(values: Column) -> Column:
    """Trimmed lower-case distinct entries."""
    return F.array_distinct(F.transform(trimmed(values), lambda v: F.lower(v)))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two tag sets; 1.0 when both are empty."""
    left, right = tag_set(a), tag_set(b)
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(tag_set(a)) == F.array_sort(tag_set(b))


def set_counts(expected: Column, actual: Column) -> Column:
    """struct(tp, fp, fn) of two tag sets."""
    left, right = tag_set(expected), tag_set(actual)
    return F.struct(
        F.size(F.array_intersect(left, right)).alias("tp"),
        F.size(F.array_except(right, left)).alias("fp"),
        F.size(F.array_except(left, right)).alias("fn"),
    )


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Reusable expressions; 0 on empty denominators."""
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return {"precision": precision, "recall": recall, "f1": f1}
