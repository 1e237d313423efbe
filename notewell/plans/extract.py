"""Rule extraction: note text to the four-pillar record, as chained projections (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewell import fixed_values as fv
from notewell import schemas
from notewell.functions import lists, packs, scalars, similarity
from notewell.functions import matching as m
from notewell.functions.packs import RulePack
from notewell.operators import windows

RECORD = "extraction"


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def excluded_tags(text: Column) -> Column:
    """Tags that a comparison or a negation rules out."""
    lowered = F.lower(text)
    mentioned = m.labels_containing(lowered, fv.NEGATED_TAGS)
    negated = F.concat(
        F.when(m.any_match(lowered, (fv.NEGATION_LEATHER,)), _array(["leather_goods"])).otherwise(m.empty_strings()),
        F.when(m.any_match(lowered, fv.NEGATIONS), mentioned).otherwise(m.empty_strings()),
    )
    return F.when(m.any_match(lowered, fv.COMPARISONS), _array(fv.COMPARISON_EXCLUDED)).otherwise(
        F.array_distinct(negated)
    )


def extract_tags(text: Column, pack: RulePack) -> Column:
    """Keyword tags without excluded and non-product tags, in pack order."""
    found = pack.matching(F.lower(F.coalesce(text, F.lit(""))))
    return F.array_except(found, F.concat(excluded_tags(F.coalesce(text, F.lit(""))), _array(fv.NON_PRODUCT_TAGS)))


def extract_relations(text: Column) -> Column:
    """struct(gift_for, shopping_with)."""
    return F.struct(
        packs.RELATIONS.matching(text).alias("gift_for"), packs.COMPANIONS.matching(text).alias("shopping_with")
    )


def client_status(text: Column) -> Column:
    out = None
    for _, pattern, status in fv.STATUSES:
        cond = m.any_match(text, (pattern,))
        out = F.when(cond, F.lit(status)) if out is None else out.when(cond, F.lit(status))
    return out


def _by_bound(value: Column, bounds, top: str) -> Column:
    out = None
    for limit, label in bounds:
        out = F.when(value < limit, F.lit(label)) if out is None else out.when(value < limit, F.lit(label))
    return out.otherwise(F.lit(top))


def infer_budget(text: Column, status: Column, rules=packs.AMOUNT_RULES) -> Column:
    """struct(amount, min, max, range, tier, confidence).

    An explicit amount wins (±20 % after the modifier), then the range of the client
    status, then the range of luxury wording.
    """
    lowered = F.lower(text)
    amount = packs.first_amount(lowered, rules)
    modifier = None
    for pattern, factor in fv.BUDGET_MODIFIERS:
        cond = m.any_match(lowered, (pattern,))
        modifier = F.when(cond, F.lit(factor)) if modifier is None else modifier.when(cond, F.lit(factor))
    modifier = modifier.otherwise(F.lit(1.0))
    explicit = F.coalesce(amount != 0, F.lit(False))
    luxury = m.any_match(lowered, (fv.LUXURY_WORDS,))

    def by_status(index: int) -> Column:
        out = None
        for name, bounds in fv.STATUS_BUDGETS.items():
            out = F.when(status == name, F.lit(float(bounds[index]))) if out is None else out.when(
                status == name, F.lit(float(bounds[index]))
            )
        return out

    def bound(index: int, factor: float) -> Column:
        return (
            F.when(explicit, (amount.cast("double") * modifier * F.lit(factor)).cast("bigint"))
            .when(by_status(index).isNotNull(), (by_status(index) * modifier).cast("bigint"))
            .when(luxury, F.lit(fv.LUXURY_BUDGET[index]).cast("bigint"))
        )

    high = bound(1, 1.2)
    known = F.coalesce(high > 0, F.lit(False))
    confidence = (
        F.when(explicit & (modifier != 1.0), "explicit_modified")
        .when(explicit, "explicit")
        .when(by_status(0).isNotNull(), "inferred_status")
        .when(luxury, "inferred_keywords")
        .otherwise("none")
    )
    return F.struct(
        amount.alias("amount"),
        bound(0, 0.8).alias("min"),
        high.alias("max"),
        F.when(known, _by_bound(high, fv.BUDGET_LABELS, fv.BUDGET_TOP_LABEL)).alias("range"),
        F.when(known, _by_bound(high, fv.BUDGET_TIERS, fv.BUDGET_TOP_TIER)).otherwise("flexible_unknown").alias("tier"),
        confidence.alias("confidence"),
    )


def extract_care(text: Column) -> Column:
    """struct(allergies, severity, diet); the severity is null without an allergy."""
    allergies = packs.ALLERGIES.matching(text)
    severity = F.when(F.size(allergies) > 0, packs.SEVERITIES.first(text, "low"))
    return F.struct(allergies.alias("allergies"), severity.alias("severity"), packs.DIETS.matching(text).alias("diet"))


def urgency(text: Column) -> Column:
    out = None
    for pattern, level in fv.URGENCY:
        cond = m.any_match(text, (pattern,))
        out = F.when(cond, F.lit(level)) if out is None else out.when(cond, F.lit(level))
    return out.otherwise(F.lit("low"))


def extract_temporal(text: Column, year: int | Column) -> Column:
    """struct(occasions, urgency, date)."""
    return F.struct(
        packs.OCCASIONS.matching(text).alias("occasions"),
        urgency(text).alias("urgency"),
        scalars.event_date(text, year).alias("date"),
    )


def extract_preferences(text: Column, product_names: RulePack = packs.NO_PRODUCT_NAMES,
                        product_materials: RulePack = packs.NO_PRODUCT_NAMES) -> Column:
    """struct(colors, materials, usage, products)."""
    return F.struct(
        packs.COLORS.matching(text).alias("colors"),
        F.concat(packs.MATERIALS.matching(text), product_materials.matching(text)).alias("materials"),
        packs.USAGES.matching(text).alias("usage"),
        product_names.matching(text).alias("products"),
    )


def extract_choices(text: Column) -> Column:
    """array<struct<first, second>>: "A ou B" pairs without stop words."""
    lowered = F.lower(text)
    pairs = []
    for pattern in fv.CHOICES:
        regex = F.lit("(?iU)" + pattern)
        pairs.append(
            F.zip_with(
                F.regexp_extract_all(lowered, regex, F.lit(1)),
                F.regexp_extract_all(lowered, regex, F.lit(2)),
                lambda a, b: F.struct(a.alias("first"), b.alias("second")),
            )
        )
    stop = list(fv.CHOICE_STOP_WORDS)
    return F.filter(F.concat(*pairs), lambda p: ~p["first"].isin(stop) & ~p["second"].isin(stop))


def rule_confidence(tag_count: Column, budget_confidence: Column, status: Column, allergies: Column,
                    occasions: Column) -> Column:
    score = (
        F.lit(0.60)
        + F.least(tag_count * 0.05, F.lit(0.15))
        + F.when(budget_confidence.isin("explicit", "explicit_modified"), 0.15)
        .when(budget_confidence == "inferred_status", 0.08)
        .otherwise(0.0)
        + F.when(status.isNotNull(), 0.05).otherwise(0.0)
        + F.when(F.size(allergies) > 0, 0.05).otherwise(0.0)
        + F.when(F.size(occasions) > 0, 0.05).otherwise(0.0)
    )
    return F.least(score, F.lit(0.95))


def _feedback(quality: Column, missing: Column) -> Column:
    def few(n: int) -> Column:
        return F.array_join(F.slice(missing, 1, n), ", ")

    return (
        F.when(quality > 80, F.lit("✨ Note excellente ! Tous les éléments clés sont présents."))
        .when(quality > 50, F.concat(F.lit("👍 Bonne note. Pour améliorer : "), few(2), F.lit(".")))
        .otherwise(F.concat(F.lit("📝 Note à compléter. Manque : "), few(3), F.lit(".")))
    )


def extract_note(df: DataFrame, text: str = "text", pack: RulePack = packs.EXTRA_KEYWORDS,
                 product_names: RulePack = packs.NO_PRODUCT_NAMES,
                 product_materials: RulePack = packs.NO_PRODUCT_NAMES, year: int = 2024) -> DataFrame:
    """Adds ``extraction`` (the record) plus the flat columns that other steps read.

    Flat columns: ``tags``, ``client_status``, ``budget``, ``care``, ``temporal``,
    ``relations``, ``preferences``, ``gender``, ``all_tags``, ``rule_confidence``.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumns(
        {
            "tags": extract_tags(t, pack),
            "relations": extract_relations(t),
            "client_status": client_status(t),
            "care": extract_care(t),
            "temporal": extract_temporal(t, year),
            "preferences": extract_preferences(t, product_names, product_materials),
            "gender": windows.client_gender(t),
        }
    ).withColumns(
        {
            "budget": infer_budget(t, F.col("client_status")),
            "all_tags": F.array_distinct(
                F.concat("tags", F.col("relations.gift_for"), F.col("relations.shopping_with"), F.col("temporal.occasions"))
            ),
        }
    )
    occasions, budget = F.col("temporal.occasions"), F.col("budget")
    has_amount = F.coalesce(budget["amount"] != 0, F.lit(False))
    quality = 100 * sum(
        (
            F.when(cond, weight).otherwise(0.0)
            for cond, weight in (
                (has_amount, 0.25),
                (F.col("client_status").isNotNull(), 0.15),
                (F.size(occasions) > 0, 0.15),
                (F.size("preferences.colors") > 0, 0.15),
                (F.size("preferences.materials") > 0, 0.15),
                (F.size("preferences.usage") > 0, 0.15),
            )
        ),
        F.lit(0.0),
    )
    completeness = (
        F.when(F.size("tags") > 0, 25.0).otherwise(0.0)
        + F.lit(25.0)
        + F.when(F.size("care.allergies") == 0, 25.0).otherwise(0.0)
        + F.when(has_amount, 25.0).otherwise(0.0)
    )
    missing = F.array_compact(
        F.array(
            F.when(~has_amount, F.lit("Budget non spécifié")),
            F.when(F.col("client_status").isNull(), F.lit("Statut client inconnu")),
            F.when(F.size(occasions) == 0, F.lit("Occasion non mentionnée")),
        )
    )
    out = out.withColumns(
        {
            "rule_confidence": rule_confidence(
                F.size("all_tags"), budget["confidence"], F.col("client_status"), F.col("care.allergies"), occasions
            ),
            "__quality": F.round(quality, 2),
            "__completeness": completeness,
            "__missing": missing,
        }
    )
    none = m.empty_strings()
    null = F.lit(None)
    p1 = F.struct(
        F.col("tags").alias("categories"),
        F.col("preferences.products").alias("produits_mentionnes"),
        F.col("preferences.usage").alias("usage"),
        F.struct(
            F.col("preferences.colors").alias("colors"), none.alias("styles"), none.alias("hardware"),
            F.col("preferences.materials").alias("materials"),
        ).alias("preferences"),
        F.array().cast(f"array<{schemas.MATCHED_PRODUCT}>").alias("matched_products"),
    )
    p2 = F.struct(
        F.struct(
            F.when(F.size("relations.gift_for") > 0, "Gift").otherwise("Self").alias("type"), null.cast("string").alias("behavior")
        ).alias("purchase_context"),
        F.struct(null.cast("string").alias("sector"), F.col("gender").alias("status")).alias("profession"),
        F.struct(none.alias("passions"), F.coalesce("client_status", F.lit("Unknown")).alias("family")).alias("lifestyle"),
    )
    p3 = F.struct(
        F.col("care.diet").alias("diet"),
        F.struct(none.alias("food"), F.col("care.allergies").alias("contact")).alias("allergies"),
        none.alias("values"),
        F.try_element_at(occasions, F.lit(1)).alias("occasion"),
    )
    p4 = F.struct(
        F.when(F.col("temporal.urgency") == "high", "Warm").otherwise("Discovery").alias("lead_temperature"),
        null.cast(schemas.NEXT_ACTION).alias("next_best_action"),
        F.concat(budget["tier"], F.lit(" ("), F.coalesce(budget["range"], F.lit("None")), F.lit(")")).alias("budget_potential"),
        budget["amount"].cast("int").alias("budget_specific"),
        F.col("temporal.urgency").alias("urgency"),
        null.cast("double").alias("churn_risk"), null.cast("string").alias("churn_level"),
        null.cast("double").alias("clv_estimate"), null.cast("string").alias("clv_tier"),
        null.cast("string").alias("prediction_source"),
    )
    meta = F.struct(
        F.col("rule_confidence").alias("confidence_score"),
        F.col("__missing").alias("missing_info"),
        none.alias("risk_flags"),
        F.col("__quality").alias("quality_score"),
        F.col("__completeness").alias("completeness_score"),
        _feedback(F.col("__quality"), F.col("__missing")).alias("advisor_feedback"),
    )
    record = F.struct(
        F.col("tags"), *[p.alias(name) for p, name in zip((p1, p2, p3, p4), schemas.PILLARS)],
        meta.alias("meta_analysis"), F.col("rule_confidence").alias("confidence"),
    )
    return out.withColumn(RECORD, record.cast(schemas.EXTRACTION)).drop("__quality", "__completeness", "__missing")


# --- model responses ------------------------------------------------------------------

def normalized_list(df: DataFrame, column: str, vocabulary: list[str], out: str,
                    aliases: dict[str, str] | None = None, cutoff: float = fv.TAG_RATIO) -> DataFrame:
    """Each entry of an array column through exact / alias / closest; null where nothing fits.

    Stays within the row: only entries that neither rule settles go to the similarity helper.
    """
    aliases = fv.TAG_ALIASES if aliases is None else aliases
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])

    def rule(tag: Column) -> Column:
        dynamic = F.lit(False)
        for prefix in fv.DYNAMIC_TAG_PREFIXES:
            dynamic = dynamic | tag.startswith(prefix)
        return F.coalesce(F.when(tag.isin(vocabulary) | dynamic, tag), F.try_element_at(table, F.lower(tag)))

    values = m.list_or_empty(F.col(column))
    open_entries = F.array_distinct(F.filter(values, lambda t: t.isNotNull() & rule(t).isNull()))
    return (
        df.withColumn("__open", open_entries)
        .withColumn("__fuzzy", similarity.closest_of_each(F.col("__open"), vocabulary, cutoff))
        .withColumn(
            out,
            F.transform(
                values,
                lambda t: F.coalesce(rule(t), F.try_element_at(F.col("__fuzzy"), F.array_position(F.col("__open"), t).cast("int"))),
            ),
        )
        .drop("__open", "__fuzzy")
    )


def sanitize_profession(value: Column, locations: Column) -> Column:
    """Places and status words are not professions."""
    trimmed = F.trim(value)
    lowered = F.lower(trimmed)
    here = F.array_contains(F.transform(m.list_or_empty(locations), lambda x: F.lower(F.trim(x))), lowered)
    blocked = lowered.isin(*fv.PROFESSION_BLOCKED, *fv.LOCATION_BLOCKED) | here
    return F.when((trimmed != "") & ~F.coalesce(blocked, F.lit(False)), trimmed)


def normalize_flat_json(raw: DataFrame, column: str, vocabulary: list[str], occasion_tags: list[str]) -> DataFrame:
    """Flat model responses to the record: tags normalised, occasions re-routed, professions checked."""
    parsed = raw.withColumn(
        "__r", F.when(F.try_parse_json(column).isNotNull(), F.from_json(column, schemas.FLAT_RESPONSE))
    ).withColumns({"__tags": F.col("__r.tags"), "__urg": F.array(F.col("__r.urgency"))})
    parsed = normalized_list(parsed, "__tags", vocabulary, "__norm")
    parsed = normalized_list(parsed, "__urg", vocabulary, "__urgency")
    norm = F.filter("__norm", lambda t: t.isNotNull())
    is_occasion = lambda t: t.isin(occasion_tags)
    occasions = F.array_distinct(F.concat(m.list_or_empty(F.col("__r.occasions")), F.filter(norm, is_occasion)))
    null = F.lit(None)
    return parsed.withColumns(
        {
            "categories": F.filter(norm, lambda t: ~is_occasion(t)),
            "usage": m.list_or_empty(F.col("__r.usage_context")),
            "colors": m.list_or_empty(F.col("__r.colors")),
            "materials": m.list_or_empty(F.col("__r.materials")),
            "purchase_type": F.when(F.col("__r").isNotNull(), F.when(F.col(column).contains("self"), "Self").otherwise("Gift")),
            "behavior": F.when(~m.blank(F.col("__r.client_status")), F.trim("__r.client_status")),
            "sector": sanitize_profession(F.col("__r.profession"), F.col("__r.locations")),
            "diet": m.list_or_empty(F.col("__r.dietary")),
            "allergies": m.list_or_empty(F.col("__r.allergies")),
            "occasion": F.try_element_at(occasions, F.lit(1)),
            "urgency": F.coalesce(F.try_element_at("__urgency", F.lit(1)), F.trim("__r.urgency")),
            "budget_potential": F.when(
                F.col("__r").isNotNull(),
                F.concat(F.coalesce("__r.budget_tier", F.lit("None")), F.lit(" ("), F.coalesce("__r.budget_range", F.lit("None")), F.lit(")")),
            ),
            "confidence": F.when(F.col("__r").isNull(), 0.0).otherwise(F.coalesce("__r.confidence", F.lit(0.8))),
            "error": F.when(F.col("__r").isNull(), F.lit("malformed response")).otherwise(null.cast("string")),
            "processing_tier": F.lit("tier2"),
        }
    ).drop("__r", "__tags", "__norm", "__urg", "__urgency")


def normalize_nested_json(raw: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """Nested model responses cast to the record with its defaults; malformed rows get ``error``."""
    parsed = raw.withColumn(
        "__r", F.when(F.try_parse_json(column).isNotNull(), F.from_json(column, schemas.NESTED_RESPONSE))
    ).withColumn("__cats", F.col("__r.pilier_1_univers_produit.categories"))
    parsed = normalized_list(parsed, "__cats", vocabulary, "__norm")
    p1, p2, p3, p4 = (F.col(f"__r.{p}") for p in schemas.PILLARS)
    meta = F.col("__r.meta_analysis")
    flags = m.list_or_empty(meta["risk_flags"])
    return parsed.withColumns(
        {
            "categories": F.filter("__norm", lambda t: t.isNotNull()),
            "usage": m.list_or_empty(p1["usage"]),
            "colors": m.list_or_empty(p1["preferences"]["colors"]),
            "styles": m.list_or_empty(p1["preferences"]["styles"]),
            "hardware": m.list_or_empty(p1["preferences"]["hardware"]),
            "materials": m.list_or_empty(p1["preferences"]["materials"]),
            "purchase_type": p2["purchase_context"]["type"],
            "behavior": p2["purchase_context"]["behavior"],
            "sector": p2["profession"]["sector"],
            "passions": m.list_or_empty(p2["lifestyle"]["passions"]),
            "family": F.coalesce(p2["lifestyle"]["family"], F.lit("Unknown")),
            "diet": m.list_or_empty(p3["diet"]),
            "food_allergies": m.list_or_empty(p3["allergies"]["food"]),
            "contact_allergies": m.list_or_empty(p3["allergies"]["contact"]),
            "occasion": p3["occasion"],
            "lead_temperature": F.coalesce(p4["lead_temperature"], F.lit("Warm")),
            "next_best_action": p4["next_best_action"],
            "budget_potential": p4["budget_potential"],
            "urgency": p4["urgency"],
            "confidence": F.when(F.col("__r").isNull(), 0.0).otherwise(F.coalesce(meta["confidence_score"], F.lit(0.8))),
            "missing_info": m.list_or_empty(meta["missing_info"]),
            "risk_flags": flags,
            "rgpd_flag": F.size(flags) > 0,
            "error": F.when(F.col("__r").isNull(), F.lit("malformed response")),
            "processing_tier": F.lit("tier3"),
        }
    ).drop("__r", "__cats", "__norm")


def normalize_spans(df: DataFrame, spans: str = "spans", text: str = "text") -> DataFrame:
    """Grounded spans (class, text, attributes) to record fields; the last span of a kind wins."""
    def first(value: Column) -> Column:
        return F.when(value.startswith("["), F.try_element_at(lists.parse_list(value), F.lit(1))).otherwise(value)

    def of(kind: str, field: str) -> Column:
        return F.filter(F.col(spans), lambda s: (s["class"] == kind) & ~m.blank(s["attributes"][field]))

    def last(kind: str, field: str) -> Column:
        return F.try_element_at(of(kind, field), F.lit(-1))["attributes"][field]

    status_spans = F.filter(
        of("profil_client", "statut"),
        lambda s: F.lower(s["attributes"]["statut"]).isin("vic", "vip", "fidèle", "nouveau"),
    )
    status = F.lower(F.try_element_at(status_spans, F.lit(-1))["attributes"]["statut"])
    budgets = F.filter(
        F.transform(
            of("produit", "budget"), lambda s: F.regexp_replace(s["attributes"]["budget"], "[€,]", "").try_cast("int")
        ),
        lambda b: b.isNotNull(),
    )
    brands = F.transform(of("produit", "marque"), lambda s: F.concat_ws(" ", s["attributes"]["marque"], s["text"]))
    action = first(last("action_business", "type_action"))
    behavior = F.when(status.isin("vic", "vip"), "VIP").when(status == "fidèle", "Regular").when(status == "nouveau", "New")
    return df.withColumns(
        {
            "categories": F.filter(
                F.transform(of("produit", "categorie"), lambda s: first(s["attributes"]["categorie"])), lambda c: ~m.blank(c)
            ),
            "produits_mentionnes": brands,
            "budget_max": F.try_element_at(budgets, F.lit(-1)),
            "behavior": behavior,
            "occasion": first(last("hospitalite", "occasion")),
            "action_type": action,
            "action_description": F.concat(F.lit("Action: "), action),
            "urgency": F.when(F.lower(last("action_business", "urgence")) == "haute", "high").when(
                last("action_business", "urgence").isNotNull(), "medium"
            ),
            "word_count": m.word_count(F.col(text)),
            "has_budget": F.coalesce(F.try_element_at(budgets, F.lit(-1)) != 0, F.lit(False)),
            "has_brand": F.size(brands) > 0,
            "is_vic": F.coalesce(behavior == "VIP", F.lit(False)),
        }
    )
