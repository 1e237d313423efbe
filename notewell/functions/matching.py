"""Pattern and keyword predicates as Column expressions.

``(?iU)`` makes ``\\w``, ``\\b`` and case folding work on accented letters.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?iU)"


def alternation(patterns: Iterable[str], flags: str = FLAGS) -> str:
    """One regular expression that matches when any of ``patterns`` does."""
    return flags + "|".join(f"(?:{p})" for p in patterns)


def fold(pattern: str) -> str:
    """The pattern for lower-cased text: letters outside escapes become lower case."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "\\":
            end = pattern.find("}", i) + 1 if pattern[i + 1 : i + 3] in ("p{", "P{") else i + 2
            out.append(pattern[i:end])
            i = end
        else:
            out.append(pattern[i].lower())
            i += 1
    return "".join(out)


def _branches(pattern: str) -> list[str]:
    """The alternatives of a pattern at its outermost level."""
    parts, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = pattern.index("]", i + 2)
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:]]


def needed_words(pattern: str) -> set[str] | None:
    """Lower-case literals of which every match contains at least one; None when unknown."""
    found: set[str] = set()
    for branch in _branches(pattern):
        best = _branch_words(branch)
        if best is None:
            return None
        found |= best
    return found


def _branch_words(branch: str) -> set[str] | None:
    options: list[set[str]] = []
    run, i = "", 0

    def close() -> str:
        if len(run) >= 3:
            options.append({run.lower()})
        return ""

    while i < len(branch):
        c = branch[i]
        if c in "?*{":
            run = run[:-1]
            run = close()
            i = branch.index("}", i) if c == "{" else i
        elif c == "\\":
            run = close()
            i = branch.index("}", i) if branch[i + 1 : i + 3] in ("p{", "P{") else i + 1
        elif c == "[":
            run = close()
            i = branch.index("]", i + 2)
        elif c == "(":
            run = close()
            end, depth = i, 0
            while True:
                if branch[end] == "\\":
                    end += 1
                elif branch[end] == "[":
                    end = branch.index("]", end + 2)
                elif branch[end] == "(":
                    depth += 1
                elif branch[end] == ")":
                    depth -= 1
                    if depth == 0:
                        break
                end += 1
            body = branch[i + 1 : end]
            optional = branch[end + 1 : end + 2] in ("?", "*", "{") and end + 1 < len(branch)
            if not optional and (body.startswith("?:") or not body.startswith("?")):
                inner = needed_words(body.removeprefix("?:"))
                if inner is not None:
                    options.append(inner)
            i = end
        elif c.isalnum() or c in " '_":
            run += c
        else:
            run = close()
        i += 1
    close()
    return min(options, key=lambda o: (len(o), -min(map(len, o)))) if options else None


def any_match(text: Column, patterns: Iterable[str], flags: str = FLAGS) -> Column:
    """True when any pattern matches.

    The text is lower-cased once and the patterns are folded, and a plain substring test for
    the words that every match needs goes first: most notes fail it, and it costs a fraction
    of the regular expression.
    """
    patterns = list(patterns)
    if flags != FLAGS:
        return F.coalesce(text.rlike(alternation(patterns, flags)), F.lit(False))
    lowered = F.lower(text)
    found = lowered.rlike(alternation([fold(p) for p in patterns], "(?U)"))
    words = [needed_words(p) for p in patterns]
    if all(words):
        needed = sorted(set().union(*words), key=lambda w: (len(w), w))
        # a word that contains another needed word adds nothing
        minimal = [w for n, w in enumerate(needed) if not any(v in w for v in needed[:n])]
        if len(minimal) <= 24:
            found = any_word(lowered, minimal) & found
    return F.coalesce(found, F.lit(False))


def any_word(lowered: Column, words: Iterable[str]) -> Column:
    """True when any word is a substring of ``lowered`` (already lower case)."""
    expr = F.lit(False)
    for word in words:
        expr = expr | lowered.contains(word)
    return F.coalesce(expr, F.lit(False))


def count_words(lowered: Column, words: Iterable[str]) -> Column:
    """How many distinct words of the list occur as substrings."""
    expr = F.lit(0)
    for word in words:
        expr = expr + lowered.contains(word).cast("int")
    return F.coalesce(expr, F.lit(0))


def labels_matching(text: Column, groups: Mapping[str, Iterable[str]], flags: str = FLAGS) -> Column:
    """Labels, in the order given, whose patterns match ``text``."""
    if not groups:
        return F.array().cast("array<string>")
    return F.array_compact(
        F.array(*[F.when(any_match(text, pats, flags), F.lit(label)) for label, pats in groups.items()])
    )


def labels_containing(lowered: Column, groups: Mapping[str, Iterable[str]]) -> Column:
    """Labels, in the order given, with a word in ``lowered``, which is worked out once and not for every word."""
    if not groups:
        return F.array().cast("array<string>")
    return F.array_compact(
        let(lowered, lambda low: F.array(*[F.when(any_word(low, words), F.lit(label)) for label, words in groups.items()]))
    )


def first_matching(
    text: Column, groups: Iterable[tuple[str, Iterable[str]]], default: str | None = None, flags: str = FLAGS
) -> Column:
    """The first label whose patterns match."""
    out = None
    for label, pats in groups:
        cond = any_match(text, pats, flags)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default))


def first_containing(
    lowered: Column, groups: Iterable[tuple[str, Iterable[str]]], default: str | None = None
) -> Column:
    out = None
    for label, words in groups:
        cond = any_word(lowered, words)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def list_or_empty(col: Column) -> Column:
    return F.coalesce(col, empty_strings())


def blank(col: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(F.trim(col) == "", F.lit(True))


def word_count(text: Column) -> Column:
    """Number of white-space separated words."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, " ")))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Optimizer rules may inline an expression wherever it is referenced; binding it to a
    lambda variable keeps long chains of rewrites linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
