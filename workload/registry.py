"""Query registry and small SQL builders shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain_counts(sql: str) -> str:
    """``count_if(x)`` as ``count(CASE WHEN x THEN 1 END)``, whose type is a plain bigint in both engines."""
    mark = "count_if("
    while (at := sql.find(mark)) >= 0:
        end, depth, quoted = at + len(mark), 1, False
        while depth:
            c = sql[end]
            if c == "'":
                quoted = not quoted
            elif not quoted:
                depth += (c == "(") - (c == ")")
            end += 1
        body = sql[at + len(mark) : end - 1]
        sql = f"{sql[:at]}count(CASE WHEN {body} THEN 1 END){sql[end:]}"
    return sql


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name!r}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = plain_counts(sql)
        return fn

    return register


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_regex(expr: str, patterns: Iterable[str]) -> str:
    """RE2 predicate for a list of patterns (none of them may use look-around)."""
    return f"regexp_matches({expr}, {lit('(?i)' + '|'.join(f'(?:{p})' for p in patterns))})"


def any_contains(expr: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {lit(w)})" for w in words) + ")"


def labels(expr: str, groups: Mapping[str, Iterable[str]], how=any_regex) -> str:
    """Comma list of the labels whose patterns match, in the order given."""
    cases = ", ".join(f"CASE WHEN {how(expr, pats)} THEN {lit(label)} END" for label, pats in groups.items())
    return f"concat_ws(',', {cases})"


def first(expr: str, groups: Iterable[tuple[str, Iterable[str]]], default: str | None, how=any_regex) -> str:
    cases = " ".join(f"WHEN {how(expr, pats)} THEN {lit(label)}" for label, pats in groups)
    return f"CASE {cases} ELSE {lit(default) if default is not None else 'NULL'} END"


def case_of(expr: str, table: Mapping, default: str = "NULL") -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {k} THEN {v}" for k, v in table.items()) + f" ELSE {default} END"
