"""Enrichment, next best action, cross-sell and quality scoring over the extraction record.

Records are plain columns here (see FIELDS), so every rule is a projection. ``unpack``
opens the record struct, ``pack`` closes it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewell import fixed_values as fv
from notewell import schemas
from notewell.functions import lists, scalars
from notewell.functions import matching as m

P1, P2, P3, P4 = schemas.PILLARS
FIELDS = {
    "categories": f"{P1}.categories",
    "produits_mentionnes": f"{P1}.produits_mentionnes",
    "usage": f"{P1}.usage",
    "colors": f"{P1}.preferences.colors",
    "styles": f"{P1}.preferences.styles",
    "hardware": f"{P1}.preferences.hardware",
    "materials": f"{P1}.preferences.materials",
    "matched_products": f"{P1}.matched_products",
    "purchase_type": f"{P2}.purchase_context.type",
    "behavior": f"{P2}.purchase_context.behavior",
    "sector": f"{P2}.profession.sector",
    "profession_status": f"{P2}.profession.status",
    "diet": f"{P3}.diet",
    "food": f"{P3}.allergies.food",
    "contact": f"{P3}.allergies.contact",
    "care_values": f"{P3}.values",
    "occasion": f"{P3}.occasion",
    "action": f"{P4}.next_best_action",
    "budget_potential": f"{P4}.budget_potential",
    "budget_specific": f"{P4}.budget_specific",
    "urgency": f"{P4}.urgency",
}
LISTS = ("categories", "produits_mentionnes", "usage", "colors", "styles", "hardware", "materials", "diet", "food",
         "contact", "care_values")


def unpack(df: DataFrame, record: str = "extraction") -> DataFrame:
    columns = {}
    for name, path in FIELDS.items():
        col = F.col(f"{record}.{path}")
        columns[name] = m.list_or_empty(col) if name in LISTS else col
    columns["matched_products"] = F.coalesce(columns["matched_products"], F.array().cast(f"array<{schemas.MATCHED_PRODUCT}>"))
    columns["record_confidence"] = F.greatest(
        scalars.score_pct(F.col(f"{record}.meta_analysis.confidence_score")), scalars.score_pct(F.col(f"{record}.confidence"))
    )
    return df.withColumns(columns)


def pack(df: DataFrame, record: str = "extraction") -> DataFrame:
    """Write the working columns back into the record and drop them."""
    def put(struct: Column, updates: dict[str, Column]) -> Column:
        for name, value in updates.items():
            struct = struct.withField(name, value)
        return struct

    e = F.col(record)
    prefs = put(e[P1]["preferences"], {n: F.col(n) for n in ("colors", "styles", "hardware", "materials")})
    p1 = put(e[P1], {**{n: F.col(n) for n in ("categories", "produits_mentionnes", "usage", "matched_products")}, "preferences": prefs})
    p2 = put(e[P2], {
        "purchase_context": F.struct(F.col("purchase_type").alias("type"), "behavior"),
        "profession": F.struct("sector", F.col("profession_status").alias("status")),
    })
    p3 = put(e[P3], {
        "diet": F.col("diet"), "allergies": F.struct("food", "contact"), "values": F.col("care_values"), "occasion": F.col("occasion"),
    })
    p4 = put(e[P4], {n: F.col(n if n != "next_best_action" else "action") for n in ("next_best_action", "budget_potential", "budget_specific", "urgency")})
    meta = e["meta_analysis"]
    if "quality_score" in df.columns:
        meta = put(meta, {
            "quality_score": F.col("quality_score"), "completeness_score": F.col("completeness_score"),
            "confidence_score": F.col("quality_confidence"), "missing_info": F.col("missing_info"),
            "advisor_feedback": F.col("advisor_feedback"),
        })
    e = put(e, {P1: p1, P2: p2, P3: p3, P4: p4, "meta_analysis": meta})
    return df.withColumn(record, e.cast(schemas.EXTRACTION)).drop(
        *FIELDS, "record_confidence", "quality_score", "completeness_score", "quality_confidence", "missing_info", "advisor_feedback"
    )


# --- enrichment -------------------------------------------------------------------------

def enrich_record(df: DataFrame, text: str = "text") -> DataFrame:
    """Fill empty fields of an unpacked record from multilingual patterns."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))

    def additions(column: str, groups, condition: Column | None = None) -> Column:
        found = m.labels_matching(low, groups)
        if condition is not None:
            found = F.when(condition, found).otherwise(m.empty_strings())
        present = F.transform(F.col(column), lambda v: F.lower(v))
        return F.concat(F.col(column), F.filter(found, lambda v: ~F.array_contains(present, F.lower(v))))

    allergic = m.any_match(low, fv.ENRICH_ALLERGY_MENTION)
    out = df.withColumns(
        {
            "purchase_type": F.when(~m.blank(F.col("purchase_type")), F.col("purchase_type"))
            .when(m.any_match(low, fv.ENRICH_GIFT), "Gift")
            .when(m.any_match(low, fv.ENRICH_SELF), "Self")
            .otherwise(F.col("purchase_type")),
            "behavior": F.when(~m.blank(F.col("behavior")), F.col("behavior")).otherwise(
                F.coalesce(m.first_matching(low, fv.ENRICH_BEHAVIOR.items()), F.col("behavior"))
            ),
            "sector": F.when(~m.blank(F.col("sector")), F.col("sector")).otherwise(
                F.coalesce(m.first_matching(low, fv.ENRICH_SECTOR.items()), F.col("sector"))
            ),
            "usage": F.when(F.size("usage") > 0, F.col("usage")).otherwise(m.labels_matching(low, fv.ENRICH_USAGE)),
            "colors": additions("colors", fv.ENRICH_COLORS),
            "materials": additions("materials", fv.ENRICH_MATERIALS),
            "occasion": F.when(~m.blank(F.col("occasion")), F.col("occasion")).otherwise(
                F.coalesce(m.first_matching(low, fv.ENRICH_OCCASIONS.items()), F.col("occasion"))
            ),
            "food": additions("food", fv.ENRICH_FOOD, allergic),
            "contact": additions("contact", fv.ENRICH_CONTACT, allergic),
            "diet": additions("diet", fv.ENRICH_DIET),
        }
    )
    unspecific = allergic & (F.size("food") == 0) & (F.size("contact") == 0)
    out = out.withColumn("care_values", lists.append_unique(F.col("care_values"), "allergy_mentioned", unspecific))
    return out.withColumn(
        "care_values", lists.append_unique(F.col("care_values"), "no_known_allergies", m.any_match(low, fv.ENRICH_NO_ALLERGY))
    )


# --- actions ------------------------------------------------------------------------------

def _action(kind: str, description: Column, priority: Column | str, targets: Column, deadline: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("action_type"),
        description.alias("description"),
        (F.lit(priority) if isinstance(priority, str) else priority).alias("priority"),
        targets.cast("array<string>").alias("target_products"),
        (deadline if deadline is not None else F.lit(None).cast("string")).alias("deadline"),
    ).cast(schemas.NEXT_ACTION)


def product_names() -> Column:
    return F.transform("matched_products", lambda p: p["name"])


def base_action() -> Column:
    """The four ordered rules over an unpacked record; null when none applies."""
    names = product_names()
    top = F.try_element_at(names, F.lit(1))
    status = F.when(m.blank(F.col("behavior")), F.lit("client")).otherwise(F.col("behavior"))
    birthday = F.concat(
        F.lit("Contacte le "), status, F.lit(" pour son "), F.replace(F.col("occasion"), F.lit("_"), F.lit(" ")), F.lit(". "),
        F.coalesce(
            F.concat(F.lit("Suggère le "), top, F.lit(" qui correspond à ses goûts.")),
            F.lit("Propose une sélection de nouveautés."),
        ),
    )
    visit = F.concat(
        F.lit("Le client "), F.upper(status),
        F.lit(" est passé pour un service. Invite-le à découvrir la nouvelle collection en salon privé."),
    )
    thanks = F.concat(
        F.lit("Envoie un mot de remerciement post-visite. "),
        F.coalesce(F.concat(F.lit("Relance sur le "), top, F.lit(".")), F.lit("")),
    )
    interest = F.concat(
        F.lit("Relance le client sur ses favoris: "), F.array_join(F.slice("categories", 1, 2), ", "), F.lit(". "),
        F.when(~m.blank(F.col("budget_potential")), F.concat(F.lit("Budget estimé: "), F.col("budget_potential"), F.lit("."))).otherwise(""),
    )
    soon = F.when(F.col("urgency").isin("urgent", "today", "this_week"), "High").otherwise("Medium")
    return (
        F.when(
            F.col("occasion").isin("birthday", "birthday_gift", "wedding_anniversary"),
            _action("gift_suggestion", birthday, soon, F.slice(names, 1, 2), F.col("urgency")),
        )
        .when(
            F.array_contains("categories", "luxury_service") & status.isin("vic", "ultimate"),
            _action("invitation", visit, "High", F.array(F.lit("new_collection"))),
        )
        .when(status == "first_visit", _action("follow_up", thanks, "Medium", F.slice(names, 1, 1)))
        .when(F.size("categories") > 0, _action("follow_up", interest, "Medium", F.slice(names, 1, 2)))
    )


def augment_action(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the reservation, nickel, meeting and wallet hints of the text to the action."""
    raw = F.coalesce(F.col(text), F.lit(""))
    default = _action("follow_up", F.lit("Relance client avec preparation personnalisee."), "Medium", m.empty_strings())
    df = df.withColumn("action", F.coalesce("action", default))
    targets = lists.merge_unique(
        F.col("action.target_products"), F.concat(F.slice("produits_mentionnes", 1, 2), F.slice(product_names(), 1, 2))
    )
    df = df.withColumn("action", F.col("action").withField("target_products", targets))
    first_target = F.coalesce(F.try_element_at("action.target_products", F.lit(1)), F.lit("le produit mentionne"))
    reserve = m.any_match(raw, fv.RESERVE_WORDS)
    nickel = m.any_match(raw, (r"\bnickel\b",)) | F.exists("contact", lambda c: F.lower(c).contains("nickel"))
    meeting = m.any_match(raw, fv.MEETING_WORDS)
    hint = scalars.meeting_hint(raw)
    fragments = F.array_compact(
        F.array(
            F.when(reserve, F.concat(F.lit("Reserver "), first_target, F.lit(" avant le prochain passage client."))),
            F.when(nickel, F.lit("Verifier les finitions sans nickel avant presentation.")),
            F.when(
                meeting,
                F.coalesce(
                    F.concat(F.lit("Preparer la selection pour le RDV "), hint, F.lit(".")),
                    F.lit("Preparer une selection pour le prochain RDV."),
                ),
            ),
            F.when(m.any_match(raw, fv.WALLET_WORDS), F.lit("Preparer un portefeuille assorti en cross-sell.")),
        )
    )
    description = F.aggregate(
        fragments,
        F.col("action.description"),
        lambda acc, f: F.when(F.contains(F.lower(acc), F.lower(f)), acc).otherwise(F.trim(F.concat_ws(" ", F.trim(acc), f))),
    )
    raised = F.when((reserve | nickel) & F.col("action.priority").isin("Low", "Medium"), "High").otherwise(F.col("action.priority"))
    return df.withColumn("action", F.col("action").withField("description", description).withField("priority", raised))


def next_best_action(df: DataFrame, text: str = "text") -> DataFrame:
    """Rules first, then the hints of the text; an action already present is kept."""
    return augment_action(df.withColumn("action", F.coalesce("action", base_action())), text)


def adjust_for_prediction(df: DataFrame, churn_level: str = "churn_level", churn_risk: str = "churn_risk",
                          clv_tier: str = "clv_tier", clv: str = "clv_estimate") -> DataFrame:
    """High churn makes the action critical, platinum value makes it at least high."""
    risk_text = F.concat(F.bround(F.col(churn_risk) * 100, 0).cast("bigint").cast("string"), F.lit("%"))
    retention = _action(
        "retention_call",
        F.concat(F.lit("Client a risque churn ("), risk_text, F.lit(") - appel de retention prioritaire.")),
        "Critical", F.slice(product_names(), 1, 1), F.lit("48h"),
    )
    action = F.col("action")
    said = F.lower(action["description"]).contains("churn")
    critical = action.withField("priority", F.lit("Critical")).withField(
        "description",
        F.when(said, action["description"]).otherwise(
            F.concat(action["description"], F.lit(" Risque churn estime: "), risk_text, F.lit("."))
        ),
    )
    df = df.withColumn(
        "action",
        F.when(F.col(churn_level) == "high", F.when(action.isNull(), retention).otherwise(critical)).otherwise(action),
    )
    worth = F.format_number(F.bround(F.col(clv), 0), 0)
    platinum = F.col("action").withField(
        "priority",
        F.when(F.col("action.priority").isin("Low", "Medium"), "High").otherwise(F.col("action.priority")),
    ).withField(
        "description",
        F.when(F.col("action.description").contains("CLV"), F.col("action.description")).otherwise(
            F.concat(F.col("action.description"), F.lit(" CLV estime: "), worth, F.lit(" EUR."))
        ),
    )
    return df.withColumn(
        "action",
        F.when((F.col(clv_tier) == "platinum") & F.col("action").isNotNull(), platinum).otherwise(F.col("action")),
    )


def _one_decimal(score: Column) -> Column:
    return F.format_string("%.1f", score)


def event_action(category: Column, sentiment: Column, interests: Column) -> Column:
    """Event invitation or escalation from category and sentiment; null when none applies."""
    lowered = F.transform(m.list_or_empty(interests), lambda c: F.lower(c))

    def likes(words) -> Column:
        return F.arrays_overlap(lowered, F.array(*[F.lit(w) for w in words]))

    none = m.empty_strings()
    vip = category.isin("VIP", "Ultimate")
    client = F.concat(F.lit("Client "), category)
    return (
        F.when(
            vip & (sentiment >= 0.5),
            F.when(likes(fv.EVENT_FASHION), _action("invitation", F.lit("Client VIP enchanté + intérêt mode → Inviter Fashion Week ou défilés privés"), "High", none))
            .when(likes(fv.EVENT_JEWELRY), _action("invitation", F.lit("Client VIP enchanté + intérêt jewels → Inviter exposition Haute Joaillerie"), "High", none))
            .when(likes(fv.EVENT_PERFUME), _action("invitation", F.lit("Client VIP enchanté + intérêt parfum → Inviter lancement parfum exclusif"), "High", none))
            .otherwise(_action("invitation", F.concat(client, F.lit(" content (sentiment: "), _one_decimal(sentiment), F.lit(") → Inviter événement privé boutique")), "Medium", none)),
        )
        .when(
            vip & (sentiment < -0.3),
            _action("escalation", F.concat(client, F.lit(" mécontent (sentiment: "), _one_decimal(sentiment), F.lit(") → Escalade manager pour appel personnalisé urgent")), "Critical", none),
        )
        .when(
            (category == "Premium") & (sentiment >= 0.7),
            _action("invitation", F.lit("Client Premium très satisfait → Inviter événement boutique exclusif"), "Medium", none),
        )
    )


def priority_rank(priority: Column) -> Column:
    return F.when(priority == "Critical", 3).when(priority == "High", 2).when(priority == "Medium", 1).otherwise(0)


def loyalty_action(category: Column, sentiment: Column, existing: Column) -> Column:
    """The loyalty call when it outranks the existing action, else the existing action."""
    none = m.empty_strings()
    vip = category.isin("VIP", "Ultimate")
    client = F.concat(F.lit("Client "), category)
    call = (
        F.when(vip & (sentiment < -0.3), _action("appel_fidelisation", F.concat(client, F.lit(" mécontent (sentiment: "), _one_decimal(sentiment), F.lit(") → Appel fidélisation prioritaire par le manager")), "Critical", none))
        .when(vip & (sentiment < 0.0), _action("appel_fidelisation", F.concat(client, F.lit(" neutre à négatif → Appel fidélisation pour améliorer l'expérience")), "High", none))
        .when((category == "Premium") & (sentiment < -0.3), _action("appel_fidelisation", F.lit("Client Premium mécontent → Appel pour récupérer la relation"), "High", none))
    )
    return F.when(call.isNotNull() & (priority_rank(call["priority"]) > priority_rank(existing["priority"])), call).otherwise(existing)


def cross_sell(categories: Column, category: Column) -> Column:
    """Complementary products, first two per interest, in order and distinct, at most three."""
    lowered = F.transform(m.list_or_empty(categories), lambda c: F.lower(c))
    pairs = []
    for interest, products in fv.CROSS_SELL.items():
        pairs += [F.lit(interest), F.array(*[F.lit(p) for p in products[:2]])]
    table = F.create_map(*pairs)
    found = F.flatten(F.transform(lowered, lambda c: F.coalesce(F.try_element_at(table, c), m.empty_strings())))
    vip = category.isin("VIP", "Ultimate")

    def extra(words, label: str) -> Column:
        likes = F.arrays_overlap(lowered, F.array(*[F.lit(w) for w in words]))
        return F.when(vip & likes, F.array(F.lit(label))).otherwise(m.empty_strings())

    extras = F.concat(
        extra(("parfums", "fragrance"), "Collection privée - Accès avant-première"),
        extra(("bijoux", "joaillerie"), "Rendez-vous atelier joaillerie"),
    )
    return F.slice(F.array_distinct(F.concat(found, extras)), 1, 3)


def recommend(matched_names: Column, categories: Column, category: Column) -> Column:
    """Matched product names, then cross-sell, distinct, at most five."""
    names = F.slice(lists.trimmed(matched_names), 1, 3)
    return F.slice(F.array_distinct(F.concat(names, cross_sell(categories, category))), 1, 5)


# --- quality ---------------------------------------------------------------------------------

def minimum_tag(text: Column) -> Column:
    return m.first_containing(F.lower(F.coalesce(text, F.lit(""))), fv.MINIMUM_TAGS, fv.MINIMUM_TAG_DEFAULT)


def quality_fallback(df: DataFrame, tags: str, rule_tags: str, text: str = "text", required: bool = True) -> DataFrame:
    """Never leave a note without tags: rule tags first, then the product tag of the text.

    Adds ``fallbacks_applied``.
    """
    if not required:
        return df.withColumn("fallbacks_applied", m.empty_strings())
    own = lists.trimmed(F.col(tags))
    ruled = lists.merge_unique(F.col(tags), F.col(rule_tags))
    empty, still = F.size(own) == 0, F.size(ruled) == 0
    return df.withColumn(
        "fallbacks_applied",
        F.when(~empty, m.empty_strings())
        .when(~still, F.array(F.lit("tier1_no_tag_merge")))
        .otherwise(F.array(F.lit("deterministic_minimum_tag"))),
    ).withColumn(tags, F.when(~empty, F.col(tags)).when(~still, ruled).otherwise(F.array(minimum_tag(F.col(text)))))


def quality_gate(text: Column, tags: Column) -> Column:
    """struct(passed, reason): a high-signal note must have tags."""
    failed = scalars.is_high_signal(text) & (F.size(m.list_or_empty(tags)) == 0)
    return F.struct(
        (~failed).alias("passed"),
        F.when(failed, F.lit("High-signal note produced empty tags after fallback.")).alias("reason"),
    )


def quality_score(df: DataFrame, text: str = "text") -> DataFrame:
    """Present weight over expected weight of an unpacked record, damped on short notes.

    Adds ``quality_score``, ``completeness_score``, ``quality_confidence``, ``missing_info``
    and ``advisor_feedback``.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    words = F.regexp_count(low, F.lit(r"(?U)\w+"))
    signal = {name: m.any_word(low, terms) for name, terms in fv.QUALITY_SIGNALS.items()}

    def any_text(*columns: str) -> Column:
        out = F.lit(False)
        for c in columns:
            out = out | ~m.blank(F.col(c))
        return out

    def any_list(*columns: str) -> Column:
        out = F.lit(False)
        for c in columns:
            out = out | F.exists(c, lambda v: ~m.blank(v))
        return out

    occasion = F.lower(F.trim(F.coalesce("occasion", F.lit(""))))
    has_categories = F.size("categories") > 0
    expected = {
        "categories": F.lit(True), "context": F.lit(True), "usage": signal["usage"], "preferences": signal["preferences"],
        "budget": signal["budget"] | (words >= fv.HIGH_SIGNAL_MIN_WORDS), "profession": signal["profession"],
        "occasion": signal["occasion"], "occasion_specificity": signal["occasion"], "care": signal["care"], "rag": has_categories,
    }
    present = {
        "categories": has_categories,
        "context": any_text("purchase_type", "behavior"),
        "usage": any_list("usage"),
        "preferences": any_list("colors", "materials", "styles", "hardware"),
        "budget": any_text("budget_potential", "urgency") | F.col("budget_specific").isNotNull(),
        "profession": any_text("sector", "profession_status"),
        "occasion": occasion != "",
        "occasion_specificity": occasion.endswith("_gift") | occasion.isin(*fv.SPECIFIC_OCCASIONS),
        "care": any_list("food", "contact", "diet", "care_values"),
        "rag": F.size("matched_products") > 0,
    }
    df = df.withColumns(
        {
            "__expected": sum((F.when(expected[n], w).otherwise(0) for n, w in fv.QUALITY_WEIGHTS.items()), F.lit(0)),
            "__earned": sum((F.when(expected[n] & present[n], w).otherwise(0) for n, w in fv.QUALITY_WEIGHTS.items()), F.lit(0)),
            "missing_info": F.array_compact(
                F.array(*[F.when(expected[n] & ~present[n], F.lit(label)) for n, label in fv.QUALITY_LABELS.items()])
            ),
            "__factor": F.lit(0.72) + F.lit(0.28) * F.least(F.lit(1.0), words / 18.0),
        }
    )
    raw = F.col("__earned") / F.col("__expected") * 100.0
    final = scalars.clamp(raw * F.col("__factor"), 0.0, 100.0)
    confidence = F.when(F.col("record_confidence") > 0, F.col("record_confidence")).otherwise(
        scalars.clamp(F.lit(40.0) + final * 0.55, 45.0, 95.0)
    )
    top = F.when(F.size("missing_info") > 0, F.array_join(F.slice("missing_info", 1, 3), ", ")).otherwise("contexte client")
    feedback = (
        F.when(final >= 80, F.lit("Super note: profil client tres complet et exploitable en CRM."))
        .when(final >= 50, F.lit("Bonne note: le profil est exploitable, encore un peu de profondeur possible."))
        .otherwise(F.concat(F.lit("Note a enrichir: ajoute des details sur "), top, F.lit(".")))
    )
    return df.withColumns(
        {
            "quality_score": F.round(final, 2),
            "completeness_score": F.round(raw, 2),
            "quality_confidence": F.round(confidence, 2),
            "advisor_feedback": feedback,
        }
    ).drop("__expected", "__earned", "__factor")


def batch_points(quality: Column, fast: bool = False) -> Column:
    """10 above half quality, else 5; the fast profile earns none."""
    if fast:
        return F.lit(0)
    pct = F.when(quality <= 1, quality * 100).otherwise(quality)
    return F.when(pct > 50, 10).otherwise(5)


def note_points(quality: Column) -> Column:
    pct = F.when(quality <= 1, quality * 100).otherwise(quality)
    return F.when(pct >= 80, 15).otherwise(10)


def client_category(behavior: Column, current: Column) -> Column:
    low = F.lower(behavior)
    return F.when(low.isin("vic", "platinum"), "VIC").when(low == "ultimate", "Ultimate").otherwise(current)


def recommend_note(df: DataFrame, text: str = "text", sentiment: str | None = None, category: str | None = None) -> DataFrame:
    """The whole recommendation step over records: enrich, act, invite, call, cross-sell, score."""
    score = F.col(sentiment) if sentiment else F.lit(0.0)
    kind = F.col(category) if category else F.lit("Regular")
    out = next_best_action(enrich_record(unpack(df), text), text)
    out = out.withColumn("action", F.coalesce(event_action(kind, score, F.col("categories")), F.col("action")))
    out = out.withColumn("action", loyalty_action(kind, score, F.col("action")))
    out = out.withColumn("__products", recommend(product_names(), F.col("categories"), kind))
    out = out.withColumn(
        "action",
        F.when(F.size("__products") > 0, F.col("action").withField("target_products", F.col("__products"))).otherwise(F.col("action")),
    )
    return pack(quality_score(out, text).drop("__products"))
