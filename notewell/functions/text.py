"""Text cleaning: protected zones, fillers, nuances, repeated words and sentences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewell import fixed_values as fv
from notewell.functions import matching as m
from notewell.functions import privacy
from notewell.functions.packs import quote
from notewell.functions.similarity import dedup_sentences
from notewell.session import bounded_batches

_ZONE = m.alternation((*fv.AMOUNT_ZONE, fv.PRODUCT_ZONE, *fv.DATE_ZONE))
_AMOUNT = m.alternation(fv.AMOUNT_ZONE)
_DATE = m.alternation(fv.DATE_ZONE)


def zones(text: Column) -> Column:
    """array<struct<placeholder, original>> of the amounts, product names and dates."""
    found = F.when(~privacy.has_digit(text), m.empty_strings()).otherwise(F.regexp_extract_all(text, F.lit(_ZONE), F.lit(0)))

    def kind(zone: Column) -> Column:
        return F.when(zone.rlike(_AMOUNT), "AMOUNT").when(zone.rlike(_DATE), "DATE").otherwise("PRODUCT")

    return F.transform(
        found,
        lambda z, i: F.struct(
            F.concat(F.lit("__"), kind(z), F.lit("_"), i.cast("string"), F.lit("__")).alias("placeholder"),
            z.alias("original"),
        ),
    )


def protect(text: Column, found: Column) -> Column:
    """Swap the zones for their placeholders; ``found`` is ``zones(text)``."""
    pieces = F.split(text, _ZONE, -1)
    joined = F.transform(
        pieces, lambda p, i: F.concat(p, F.coalesce(F.try_element_at(found, i + 1)["placeholder"], F.lit("")))
    )
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(joined, ""))


_PLACEHOLDER = r"__(?:AMOUNT|DATE|PRODUCT)_\d+__"


def restore(text: Column, found: Column) -> Column:
    """The originals back in place of their placeholders, in one pass over the text."""

    def rebuilt(marks: Column) -> Column:
        def original(mark: Column) -> Column:
            zone = F.try_element_at(found, F.regexp_extract(mark, r"(\d+)__$", 1).try_cast("int") + 1)
            return F.when(zone["placeholder"] == mark, zone["original"]).otherwise(mark)

        pieces = F.split(text, _PLACEHOLDER, -1)
        return F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(original(F.try_element_at(marks, i + 1)), F.lit("")))), "")

    whole = m.let(F.regexp_extract_all(text, F.lit(_PLACEHOLDER), F.lit(0)), rebuilt)
    return F.when(F.size(found) <= 0, text).otherwise(whole)


_SPACES = r"(?U)\s{2,}|[\s&&[^ ]]"  # single spaces need no change


def squeeze(text: Column) -> Column:
    """Repeated !?. once, letters repeated three times or more once, single spaces."""
    text = F.regexp_replace(text, r"([!?.]){2,}", "$1")
    text = F.regexp_replace(text, r"([a-zA-Z])\1{2,}", "$1")
    return F.trim(F.regexp_replace(text, _SPACES, " "))


REPEATED_WORD = r"(?iU)\b(\w+)(?:\s+\1\b)++"  # possessive: Java's stack does not grow with the repeats, and its overflow would end an executor


def collapse_words(text: Column) -> Column:
    """A word repeated in a row, however often, is kept once."""
    return F.regexp_replace(text, REPEATED_WORD, "$1")


def tidy_spaces(text: Column) -> Column:
    text = F.regexp_replace(text, _SPACES, " ")
    return F.trim(F.regexp_replace(text, r"(?U)\s+([.,;:!?])", "$1"))


def by_language(lang: Column, text: Column, per_language: dict[str, Column]) -> Column:
    out = None
    for code, expr in per_language.items():
        out = F.when(lang == code, expr) if out is None else out.when(lang == code, expr)
    return text if out is None else out.otherwise(text)


def filler_variants(text: Column, lang: Column) -> Column:
    """Spelling variants of hesitations to their canonical form."""
    per_language = {}
    for code, groups in fv.FILLER_VARIANTS.items():
        expr = text
        for canonical, variants in groups.items():
            expr = F.regexp_replace(expr, r"(?iU)\b(?:" + "|".join(variants) + r")\b", canonical)
        every = r"(?iU)\b(?:" + "|".join(v for variants in groups.values() for v in variants) + r")\b"
        per_language[code] = F.when(text.rlike(every), expr).otherwise(text)
    return by_language(lang, text, per_language)


def filler_pattern(code: str) -> str:
    return r"(?iU)\b(?:" + "|".join(f"(?:{p})" for p in fv.FILLERS[code]) + r")\b"


def strip_fillers(text: Column, lang: Column) -> Column:
    return by_language(lang, text, {c: F.regexp_replace(text, filler_pattern(c), "") for c in fv.FILLERS})


def count_fillers(text: Column, lang: Column) -> Column:
    return by_language(lang, F.lit(0), {c: F.regexp_count(text, F.lit(filler_pattern(c))) for c in fv.FILLERS})


def fillers_cut(text: Column, lang: Column) -> Column:
    """struct(t, n): the text without its fillers, and their number, in one reading."""
    def cut(code: str) -> Column:
        return m.let(F.split(text, filler_pattern(code), -1), lambda parts: F.struct(F.array_join(parts, "").alias("t"), (F.size(parts) - 1).alias("n")))

    return by_language(lang, F.struct(text.alias("t"), F.lit(0).alias("n")), {c: cut(c) for c in fv.FILLERS})


def nuance_pattern(nuance: str, terms: Sequence[str], window: int = fv.NUANCE_WINDOW) -> str:
    """The nuance, unless a business term lies within ``window`` characters on either side."""
    before = "|".join(f"{quote(t)}.{{0,{max(0, window - len(t))}}}" for t in terms)
    after = "|".join(f".{{0,{max(0, window - len(t))}}}{quote(t)}" for t in terms)
    # the literal comes first, so the look-behind runs only where the nuance occurs
    return rf"(?iUs)\b{quote(nuance)}\b(?<!(?:{before}){quote(nuance)})(?!(?:{after}))"


def strip_nuances(text: Column, lang: Column) -> Column:
    per_language = {}
    for code, groups in fv.NUANCES.items():
        expr = text
        for nuance, terms in groups.items():
            expr = F.regexp_replace(expr, nuance_pattern(nuance, terms), "")
        per_language[code] = expr
    return by_language(lang, text, per_language)


def count_nuances(text: Column, lang: Column) -> Column:
    return by_language(
        lang,
        F.lit(0),
        {
            code: sum((F.regexp_count(text, F.lit(nuance_pattern(n, t))) for n, t in groups.items()), F.lit(0))
            for code, groups in fv.NUANCES.items()
        },
    )


def clean_text(df: DataFrame, text: str = "text", lang: str = "lang", brands: Sequence[str] = ()) -> DataFrame:
    """The full cleaning sequence as chained projections.

    Adds ``cleaned``, ``fillers_removed``, ``duplicates_removed``, ``compression_ratio``
    and ``tokens_saved``. Languages without filler lists keep masking and squeezing only.
    """
    bounded_batches(df.sparkSession)  # long texts go to the comparison of sentences
    code = F.upper(F.col(lang))
    supported = code.isin(*fv.FILLERS)
    src = F.coalesce(F.col(text), F.lit(""))
    w = "__w"
    out = (
        df.withColumn(w, privacy.mask_pii(privacy.mask_contacts(src), brands))
        .withColumn("__zones", zones(F.col(w)))
        .withColumn(w, protect(F.col(w), F.col("__zones")))
        .withColumn(w, squeeze(F.col(w)))
        .withColumn(w, collapse_words(filler_variants(F.col(w), code)))
        .withColumn("__cut", fillers_cut(F.col(w), code))
        .withColumns({w: F.col("__cut")["t"], "__fillers": F.col("__cut")["n"]})
        .withColumn("__nuances", count_nuances(F.col(w), code))
        .withColumn(w, tidy_spaces(F.when(F.col("__nuances") == 0, F.col(w)).otherwise(strip_nuances(F.col(w), code))))
        .withColumn("__dedup", dedup_sentences(F.when(supported, F.col(w))))
        .withColumn(w, F.coalesce(F.col("__dedup")["text"], F.col(w)))
        .withColumn("cleaned", restore(F.col(w), F.col("__zones")))
    )
    before, after = F.length(src), F.length("cleaned")
    return (
        out.withColumn("fillers_removed", F.col("__fillers") + F.col("__nuances"))
        .withColumn("duplicates_removed", F.coalesce(F.col("__dedup")["removed"], F.lit(0)))
        .withColumn("compression_ratio", F.when(before > 0, after / before).otherwise(F.lit(1.0)))
        .withColumn("tokens_saved", ((before - after) / 4).cast("int"))
        .drop(w, "__zones", "__fillers", "__nuances", "__dedup", "__cut")
    )
