"""Masking and detection of personal data, secrets and injected instructions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from notewell import fixed_values as fv
from notewell.functions import matching as m
from notewell.functions.packs import quote


def mask_rules(brands: Sequence[str] = (), brand_mask: str = "[PRODUIT]") -> list[tuple[str, str, str]]:
    """(name, mask, regex) in the order of application.

    ``brands`` adds a product-code rule (brand prefix plus code) before the addresses.
    """
    rules = []
    for name, mask, ignore_case, pattern in fv.PII_MASKS:
        if name == "adresse_paris" and brands:
            prefix = "|".join(quote(b) for b in brands)
            rules.append(("produit", brand_mask, rf"(?iU)\b(?:{prefix})-?[A-Z0-9-]{{3,15}}\b"))
        rules.append((name, mask, ("(?iU)" if ignore_case else "(?U)") + pattern))
    return rules


def has_digit(text: Column) -> Column:
    """Every pattern of ``fixed_values.PII_MASKS`` and every amount, date and product zone holds a digit; brand rules need none."""
    return text.rlike(r"\p{Nd}")


def mask_pii(text: Column, brands: Sequence[str] = ()) -> Column:
    """Replace every personal-data pattern by its mask, in order; texts without a digit are read once."""

    def masked(t: Column) -> Column:
        for _, mask, regex in mask_rules(brands):
            t = F.regexp_replace(t, regex, mask)
        return t

    return masked(text) if brands else m.let(text, lambda t: F.when(has_digit(t), masked(t)).otherwise(t))


def masked_and_counted(text: Column, brands: Sequence[str] = ()) -> Column:
    """struct(t, n): the masked text, and the hits of each rule on the text left by the rules before it, in one chain."""
    rules = mask_rules(brands)

    def counted(t: Column) -> Column:
        state = F.struct(t.alias("t"), F.array().cast("array<int>").alias("n"))
        for _, mask, regex in rules:
            state = m.let(state, _counter(mask, regex))
        return state

    none = F.array(*[F.lit(0)] * len(rules))
    return counted(text) if brands else m.let(text, lambda t: F.when(~has_digit(t), F.struct(t.alias("t"), none.alias("n"))).otherwise(counted(t)))


def pii_counts(text: Column, brands: Sequence[str] = ()) -> Column:
    """map(name -> hits), each rule counted on the text left by the rules before it."""
    names = F.array(*[F.lit(name) for name, _, _ in mask_rules(brands)])
    counts = F.map_from_arrays(names, masked_and_counted(text, brands)["n"])
    return F.map_filter(counts, lambda _, hits: hits > 0)


def _counter(mask: str, regex: str):
    return lambda state: F.struct(
        F.regexp_replace(state["t"], regex, mask).alias("t"),
        F.concat(state["n"], F.array(F.regexp_count(state["t"], F.lit(regex)))).alias("n"),
    )


def pii_audit(text: Column, brands: Sequence[str] = ()) -> Column:
    """struct(by_type, total, risk): HIGH above 5 hits, MEDIUM above 0, else LOW."""
    def audit(counts: Column) -> Column:
        total = F.aggregate(F.map_values(counts), F.lit(0), lambda acc, v: acc + v)
        return F.struct(counts.alias("by_type"), total.alias("total"), risk_level(total).alias("risk"))

    return m.let(pii_counts(text, brands), audit)


def risk_level(total: Column) -> Column:
    return F.when(total > 5, "HIGH").when(total > 0, "MEDIUM").otherwise("LOW")


_CIVILITIES = ("M.", "Mme", "Mlle", "Mr", "Ms", "Monsieur", "Madame", "Dr", "Prof.")  # each match of CIVILITY_NAME holds one


def mask_contacts(text: Column) -> Column:
    """E-mails, phones and the name after a civility."""
    text = m.let(text, lambda t: F.when(t.contains("@"), F.regexp_replace(t, "(?U)" + fv.EMAIL, "[EMAIL]")).otherwise(t))
    text = m.let(text, lambda t: F.when(has_digit(t), F.regexp_replace(t, "(?U)" + fv.PHONE_CONTACT, "[PHONE]")).otherwise(t))
    return m.let(text, lambda t: F.when(m.any_word(t, _CIVILITIES), F.regexp_replace(t, "(?U)" + fv.CIVILITY_NAME, "$1 [NAME]")).otherwise(t))


def guard_mask(text: Column) -> Column:
    """struct(text, email, phone, credit_card, risk_score): counts precede each replacement; the risk is 1 if any was made."""
    fields = []
    for name, (pattern, mask) in fv.GUARD_PATTERNS.items():
        fields.append(F.regexp_count(text, F.lit("(?U)" + pattern)).alias(name))
        text = F.regexp_replace(text, "(?U)" + pattern, mask)
    found = reduce(or_, (hits > 0 for hits in fields))
    return F.struct(text.alias("text"), *fields, F.when(found, 1.0).otherwise(0.0).alias("risk_score"))


def is_injection(text: Column) -> Column:
    return m.any_match(F.lower(text), fv.INJECTION_PATTERNS)


def secrets(text: Column) -> Column:
    """Names of the secrets whose pattern occurs."""
    return m.labels_matching(text, {name: (p,) for name, p in fv.SECRET_PATTERNS.items()}, flags="(?iU)")


def sensitive_categories(text: Column) -> Column:
    """Sensitive categories with at least one keyword present."""
    return m.labels_containing(F.lower(F.coalesce(text, F.lit(""))), fv.SENSITIVE_KEYWORDS)


def rgpd_from_markers(text: Column) -> Column:
    """struct(contains_sensitive, categories_detected, severity) from mask tokens."""
    tokens = F.filter(F.array(*[F.lit(t) for t in fv.MARKER_TOKENS]), lambda t: F.contains(text, t))
    critical = m.any_word(text, fv.CRITICAL_MARKERS)
    return F.struct(
        (F.size(tokens) > 0).alias("contains_sensitive"),
        tokens.alias("categories_detected"),
        F.when(critical, "medium").otherwise("low").alias("severity"),
    )


def redact_spans(text: Column, spans: Column) -> Column:
    """Replace each span's text, longest first, by ``[RGPD_<CATEGORY>_REDACTED]``.

    ``spans``: array<struct<text:string,category:string,severity:string>>.
    """
    usable = F.filter(spans, lambda s: F.length(s["text"]) > 0)
    ordered = F.array_sort(usable, lambda a, b: F.length(b["text"]) - F.length(a["text"]))

    def token(span: Column) -> Column:
        return F.concat(
            F.lit("[RGPD_"), F.upper(F.coalesce(span["category"], F.lit("sensitive"))), F.lit("_REDACTED]")
        )

    return F.aggregate(ordered, text, lambda acc, s: F.replace(acc, s["text"], token(s)))


def span_severity(spans: Column) -> Column:
    """The highest severity over the spans."""
    levels = F.transform(spans, lambda s: F.lower(s["severity"]))
    return (
        F.when(F.array_contains(levels, "high"), "high")
        .when(F.array_contains(levels, "medium"), "medium")
        .otherwise("low")
    )
