"""Value normalisers: booleans, numbers, enums, budgets, dates and steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notewell import fixed_values as fv
from notewell.functions import matching as m


def to_bool(col: Column) -> Column:
    """1, true, yes, y, oui, on; any non-zero number; everything else is false."""
    text = F.lower(F.trim(col.cast("string")))
    number = text.try_cast("double")
    return F.when(number.isNotNull(), number != 0).otherwise(F.coalesce(text.isin(*fv.TRUTHY), F.lit(False)))


def clamp(col: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        col = F.greatest(col, F.lit(low))
    if high is not None:
        col = F.least(col, F.lit(high))
    return col


def to_int(col: Column, default: int = 0, low: int | None = None, high: int | None = None) -> Column:
    """Rounds half to even, as Python does."""
    value = F.coalesce(F.bround(col.cast("string").try_cast("double"), 0).cast("bigint"), F.lit(default).cast("bigint"))
    return clamp(value, low, high)


def to_float(col: Column, default: float = 0.0, low: float | None = None, high: float | None = None) -> Column:
    value = F.coalesce(col.cast("string").try_cast("double"), F.lit(float(default)))
    return clamp(value, low, high)


def norm_tier(col: Column) -> Column:
    return to_int(col, default=1, low=1, high=3).cast("int")


def known_tier(col: Column) -> Column:
    """Dashboards count an unknown tier as tier 1 (no clamping)."""
    tier = col.cast("string").try_cast("int")
    return F.when(tier.isin(1, 2, 3), tier).otherwise(F.lit(1))


def norm_confidence(col: Column) -> Column:
    return to_float(col, default=0.0, low=0.0, high=1.0)


def score_pct(col: Column) -> Column:
    """Scores up to 1 are shares; the result is 0..100."""
    score = F.coalesce(col.cast("string").try_cast("double"), F.lit(0.0))
    return clamp(F.when(score <= 1.0, score * 100.0).otherwise(score), 0.0, 100.0)


def confidence_label(col: Column) -> Column:
    pct = F.when(col <= 1, col * 100).otherwise(col)
    return F.when(col.isNull(), F.lit("-")).otherwise(
        F.concat(F.bround(pct, 0).cast("bigint").cast("string"), F.lit("%"))
    )


def budget_value(col: Column) -> Column:
    """Largest positive number in the text, with k / m suffixes and decimal commas."""
    text = F.lower(col.cast("string"))
    pattern = F.lit(r"(\d+(?:[.,]\d+)?)\s*(k|m)?")
    numbers = F.regexp_extract_all(text, pattern, F.lit(1))
    suffixes = F.regexp_extract_all(text, pattern, F.lit(2))
    values = F.zip_with(
        numbers,
        suffixes,
        lambda n, s: F.replace(n, F.lit(","), F.lit(".")).try_cast("double")
        * F.when(s == "m", F.lit(1_000_000.0)).when(s == "k", F.lit(1_000.0)).otherwise(F.lit(1.0)),
    )
    return F.array_max(F.filter(values, lambda v: v > 0))


def norm_urgency(col: Column) -> Column:
    """struct(level, label) with 3 High, 2 Medium, 1 Low."""
    text = F.lower(F.trim(F.coalesce(col.cast("string"), F.lit(""))))
    high, medium = m.any_word(text, fv.URGENCY_HIGH), m.any_word(text, fv.URGENCY_MEDIUM)
    level = F.when(high, 3).when(medium, 2).otherwise(1)
    label = F.when(high, "High").when(medium, "Medium").otherwise("Low")
    return F.struct(level.alias("level"), label.alias("label"))


def norm_priority(col: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(col, F.lit(""))))
    return (
        F.when(text.isin("critical", "urgent"), "Critical")
        .when(text == "high", "High")
        .when(text == "low", "Low")
        .otherwise("Medium")
    )


def norm_step(col: Column) -> Column:
    raw = F.lower(F.coalesce(col, F.lit("")))
    return (
        F.when(raw == "", F.lit(None).cast("string"))
        .when((raw == "failed") | raw.contains("error"), "failed")
        .when(raw.isin("done", "cache_hit", "semantic_cache_hit"), "done")
        .when(raw.isin("cleaning", "rgpd"), "cleaning")
        .when(raw == "routing", "routing")
        .when(raw.contains("tier") | raw.isin("cross_validation", "extraction"), "extraction")
        .when(raw == "rag", "rag")
        .when(raw.isin("injection", "nba"), "nba")
        .otherwise(raw)
    )


def norm_language(col: Column) -> Column:
    """Locale aliases folded, unknown or missing languages become FR."""
    raw = F.upper(F.trim(F.coalesce(col, F.lit("FR"))))
    out = F.when(raw == "", F.lit("FR"))
    for alias, target in fv.LANGUAGE_ALIASES.items():
        out = out.when(raw == alias, F.lit(target))
    return out.when(raw.isin(*fv.SUPPORTED_LANGUAGES), raw).otherwise(F.lit("FR"))


def price_range(budget_specific: Column, budget_potential: Column) -> Column:
    """struct(low, high): 25 % around an exact budget, else read from the label."""
    exact = budget_specific.cast("string").try_cast("double")
    text = F.lower(F.coalesce(budget_potential.cast("string"), F.lit("")))

    def number(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group).try_cast("double") * 1000.0

    def pair(low: Column, high: Column) -> Column:
        return F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"))

    both = r"(\d+(?:\.\d+)?)\s*k\s*-\s*(\d+(?:\.\d+)?)\s*k"
    plus = r"(\d+(?:\.\d+)?)\s*k\+"
    under = r"under[_\s-]*(\d+(?:\.\d+)?)\s*k"
    out = (
        F.when(exact > 0, pair(exact * 0.75, exact * 1.25))
        .when(text.rlike(both), pair(number(both, 1), number(both, 2)))
        .when(text.rlike(plus), pair(number(plus, 1), number(plus, 1) * 2.0))
        .when(text.rlike(under), pair(F.lit(0.0), number(under, 1)))
    )
    # "ultra_high" is tested before "high", which it contains
    for tier, (low, high) in fv.TIER_PRICE_RANGES.items():
        out = out.when(text.contains(tier), pair(F.lit(low), F.lit(high)))
    return out


def meeting_hint(text: Column) -> Column:
    """Weekday with the hour when one follows, else null."""
    day = F.regexp_extract(text, m.FLAGS + fv.MEETING_HINT, 1)
    hour = F.trim(F.regexp_extract(text, m.FLAGS + fv.MEETING_HINT, 2))
    return F.when(day != "", F.when(hour != "", F.concat_ws(" ", day, hour)).otherwise(day))


def event_date(text: Column, year: Column | int) -> Column:
    """'12 mars' with the given year, as a date; impossible dates are null."""
    year = F.lit(year) if isinstance(year, int) else year
    pattern = m.FLAGS + r"(\d{1,2})\s+(" + "|".join(fv.MONTHS_FR) + ")"
    day = F.regexp_extract(text, pattern, 1).try_cast("int")
    name = F.lower(F.regexp_extract(text, pattern, 2))
    month = F.array_position(F.array(*[F.lit(x) for x in fv.MONTHS_FR]), name).cast("int")
    iso = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.when(day.isNotNull() & (month > 0), iso.try_cast("date"))


def sentiment(text: Column) -> Column:
    """struct(label, score) from substring keyword counts."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    pos = m.count_words(lowered, fv.POSITIVE_WORDS)
    neg = m.count_words(lowered, fv.NEGATIVE_WORDS)
    score = F.when(pos + neg == 0, F.lit(0.0)).otherwise((pos - neg) / (pos + neg))
    label = (
        F.when(score > fv.SENTIMENT_BAND, "POSITIF").when(score < -fv.SENTIMENT_BAND, "NEGATIF").otherwise("NEUTRE")
    )
    return F.struct(label.alias("label"), score.alias("score"))


def detect_language(text: Column, default: str = "en") -> Column:
    """Two pattern groups per language; ties go to fr, es, de, it in that order."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    scores = {
        lang: sum((m.any_match(lowered, (p,)).cast("int") for p in pats), F.lit(0))
        for lang, pats in fv.LANGUAGE_PATTERNS.items()
    }
    best = F.greatest(*scores.values())
    out = F.when(best < 1, F.lit(default))
    for lang, score in scores.items():
        out = out.when(score == best, F.lit(lang))
    return out


def detect_language_words(text: Column, default: str = "EN") -> Column:
    """Counts of frequent words per language; ties go to the order of the list."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    scores = {lang: m.count_words(lowered, words) for lang, words in fv.LANGUAGE_WORDS.items()}
    best = F.greatest(*scores.values())
    out = F.when(best == 0, F.lit(default))
    for lang, score in scores.items():
        out = out.when(score == best, F.lit(lang))
    return out


def normalized_text(text: Column) -> Column:
    """Lower case, no punctuation, single spaces."""
    bare = F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def text_key(text: Column, step: str, salt: str = "v1") -> Column:
    """Reuse key of a text for a step."""
    return F.md5(F.concat_ws(":", F.lit(salt), F.lit(step), normalized_text(text)).cast("binary"))


def preview(text: Column, n: int) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("..."))).otherwise(flat)


def is_high_signal(text: Column) -> Column:
    """Eighteen words, or at least two signal words."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return (m.word_count(text) >= fv.HIGH_SIGNAL_MIN_WORDS) | (m.count_words(lowered, fv.HIGH_SIGNAL_WORDS) >= 2)


def action_label(status: Column, action_type: Column) -> Column:
    return (
        F.when(status == "done", "Action finalisee")
        .when(action_type == "call", "Appel planifie")
        .when(action_type == "schedule", "Rappel planifie")
        .when(status == "planned", "Action planifiee")
        .otherwise("Action en cours")
    )
