"""Rule extraction, routing, recommendation and model-response normalisers over free-text notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewell import fixed_values as fv
from notewell import schemas
from notewell.functions.packs import RulePack
from notewell.operators import quality
from notewell.plans import catalog as match
from notewell.plans import extract, recommend, route
from notewell.session import cut_lineage
from workload import tables as t
from workload.registry import any_contains, any_regex, first, labels, lit, query

T = t.ORDER_TEXTS_SQL
WORDS = {
    "leather_goods": ("bag", "sac"), "shoes": ("shoes",), "accessories": ("belt", "ceinture"), "watches": ("watch", "montre"),
    "textile": ("toile", "canvas"), "vegan": ("vegan",), "travel": ("travel",), "gift": ("gift", "cadeau"),
}
PACK = RulePack.from_keywords("shop", WORDS)


def _joined(col):
    return F.array_join(col, ",")


# --- extraction ---------------------------------------------------------------------------------

_CMP = any_regex("lower(text)", fv.COMPARISONS)
_NEG = any_regex("lower(text)", fv.NEGATIONS)
_NEGL = any_regex("lower(text)", (fv.NEGATION_LEATHER,))


def _tag_sql(tag: str, words) -> str:
    present = f"regexp_matches(lower(text), {lit('(?:^|[^\\p{L}\\p{N}])(?:' + '|'.join(words) + ')(?:$|[^\\p{L}\\p{N}])')})"
    excluded = _CMP if tag in fv.COMPARISON_EXCLUDED else "false"
    rules = []
    if tag in fv.NEGATED_TAGS:
        rules.append(f"({_NEG} AND {any_contains('lower(text)', fv.NEGATED_TAGS[tag])})")
    if tag == "leather_goods":
        rules.append(_NEGL)
    negated = f"(NOT {_CMP} AND ({' OR '.join(rules)}))" if rules else "false"
    return f"CASE WHEN {present} AND NOT {excluded} AND NOT {negated} THEN '{tag}' END"


_TAGS = "concat_ws(',', " + ", ".join(_tag_sql(tag, w) for tag, w in WORDS.items() if tag not in fv.NON_PRODUCT_TAGS) + ")"
_STATUS = first("text", [(s, (p,)) for _, p, s in fv.STATUSES], None)
_OCC_GROUPS = {k: v for k, v in fv.OCCASIONS.items() if k != "birthday"}
_OCC = ("concat_ws(',', CASE WHEN regexp_matches(regexp_replace(lower(text), 'anniversaire\\s+de\\s+mariage', '', 'g'), 'anniversaire|birthday|fête') THEN 'birthday' END, "
        + labels("text", _OCC_GROUPS)[len("concat_ws(',', "):])
_URG = first("text", [(level, (p,)) for p, level in fv.URGENCY], "low")
_REL, _COMP = labels("text", fv.RELATIONS), labels("text", fv.COMPANIONS)
_ALL, _DIET = labels("text", fv.ALLERGIES), labels("text", fv.DIETS)


@query("note_tags", f"SELECT id, {_TAGS} AS tags FROM ({T})")
def note_tags(spark, sf):
    return t.order_texts(spark, sf).select("id", _joined(extract.extract_tags(F.col("text"), PACK)).alias("tags"))


@query("relations", f"SELECT id, {_REL} AS gift_for, {_COMP} AS shopping_with FROM ({T})")
def relations(spark, sf):
    r = extract.extract_relations(F.col("text"))
    found = t.read_once(spark, sf, lambda texts: texts.select("text", _joined(r["gift_for"]).alias("gift_for"), _joined(r["shopping_with"]).alias("shopping_with")))
    return found.drop("text")


@query("status", f"SELECT id, {_STATUS} AS status FROM ({T})")
def status(spark, sf):
    return t.order_texts(spark, sf).select("id", extract.client_status(F.col("text")).alias("status"))


BUDGET_SQL = f"""
SELECT *, CASE WHEN amount <> 0 THEN CAST(floor(amount * modifier * 1.2e0) AS BIGINT) WHEN hi IS NOT NULL THEN CAST(floor(hi * modifier) AS BIGINT) WHEN luxury THEN 50000 END AS max,
  CASE WHEN amount <> 0 THEN CAST(floor(amount * modifier * 0.8e0) AS BIGINT) WHEN lo IS NOT NULL THEN CAST(floor(lo * modifier) AS BIGINT) WHEN luxury THEN 10000 END AS min,
  CASE WHEN amount <> 0 AND modifier <> 1 THEN 'explicit_modified' WHEN amount <> 0 THEN 'explicit' WHEN lo IS NOT NULL THEN 'inferred_status' WHEN luxury THEN 'inferred_keywords' ELSE 'none' END AS confidence
FROM (SELECT x.*, s.lo, s.hi FROM (SELECT id, text, CASE WHEN contains(text, 'Budget ') THEN CAST(regexp_extract(text, 'Budget ([0-9]+)k', 1) AS BIGINT) * 1000
    WHEN contains(text, 'budget de ') THEN CAST(regexp_extract(text, 'budget de ([0-9]+)', 1) AS BIGINT) END AS amount,
  CASE WHEN contains(text, 'flexible') THEN 1.2e0 ELSE 1e0 END AS modifier, contains(text, 'luxe') AS luxury, {_STATUS} AS status FROM ({T})) x
LEFT JOIN (VALUES {', '.join(f"('{k}', {a}e0, {b}e0)" for k, (a, b) in fv.STATUS_BUDGETS.items())}) s(status, lo, hi) ON s.status = x.status)"""
_RANGE = "CASE WHEN max > 0 THEN CASE " + " ".join(f"WHEN max < {n} THEN '{v}'" for n, v in fv.BUDGET_LABELS) + f" ELSE '{fv.BUDGET_TOP_LABEL}' END END"
_BTIER = "CASE WHEN max > 0 THEN CASE " + " ".join(f"WHEN max < {n} THEN '{v}'" for n, v in fv.BUDGET_TIERS) + f" ELSE '{fv.BUDGET_TOP_TIER}' END ELSE 'flexible_unknown' END"


@query("budget", f"SELECT id, amount, min, max, {_RANGE} AS range, {_BTIER} AS tier, confidence FROM ({BUDGET_SQL})")
def budget(spark, sf):
    notes = t.order_texts(spark, sf).withColumn("status", extract.client_status(F.col("text")))
    return notes.select("id", extract.infer_budget(F.col("text"), F.col("status")).alias("b")).select("id", "b.*")


@query("care", f"SELECT id, {_ALL} AS allergies, CASE WHEN {_ALL} <> '' THEN {first('text', fv.SEVERITIES.items(), 'low')} END AS severity, {_DIET} AS diet FROM ({T})")
def care(spark, sf):
    c = extract.extract_care(F.col("text"))
    return t.order_texts(spark, sf).select("id", _joined(c["allergies"]).alias("allergies"), c["severity"].alias("severity"), _joined(c["diet"]).alias("diet"))


@query("temporal", f"SELECT id, {_OCC} AS occasions, {_URG} AS urgency, CASE WHEN contains(text, '12 mars') THEN '2024-03-12' END AS date FROM ({T})")
def temporal(spark, sf):
    x = extract.extract_temporal(F.col("text"), 2024)
    return t.order_texts(spark, sf).select("id", _joined(x["occasions"]).alias("occasions"), x["urgency"].alias("urgency"), x["date"].cast("string").alias("date"))


@query("preferences", f"""
SELECT id, {labels('text', fv.COLORS)} AS colors, {labels('text', fv.MATERIALS)} AS materials, {labels('text', fv.USAGES)} AS usage,
  CASE WHEN contains(text, 'Martin') THEN 'martin_bag' ELSE '' END AS products FROM ({T})""")
def preferences(spark, sf):
    names = RulePack("models", {"martin_bag": (r"\bMartin\b",), "aurora": (r"\bAurora\s*(\d{2,3})?\b",)})
    p = extract.extract_preferences(F.col("text"), names)
    return t.order_texts(spark, sf).select("id", *[_joined(p[n]).alias(n) for n in ("colors", "materials", "usage", "products")])


@query("choices", """
SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'noir|marron,noir|marron' WHEN 'O' THEN 'sac|belt' ELSE '' END AS pairs FROM orders""")
def choices(spark, sf):
    s = F.col("o_orderstatus")
    note = F.when(s == "F", "Elle cherche un sac noir ou marron ?").when(s == "O", "sac or belt for ?").otherwise("il veut le ou la ?")
    pairs = F.transform(extract.extract_choices(note), lambda p: F.concat_ws("|", p["first"], p["second"]))
    return t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), _joined(pairs).alias("pairs"))


def _count(expr: str) -> str:
    return f"len(list_filter(string_split({expr}, ','), lambda x: x <> ''))"


NOTE_SQL = f"""
SELECT b.id, b.text, b.amount, b.status, b.confidence AS budget_confidence, {_BTIER} || ' (' || coalesce({_RANGE}, 'None') || ')' AS budget_potential,
  {_TAGS} AS tags, {_REL} AS gift_for, {_COMP} AS shopping_with, {_OCC} AS occasions, {_URG} AS urgency, {_ALL} AS allergies, {_DIET} AS diet,
  {labels('text', fv.COLORS)} AS colors, {labels('text', fv.MATERIALS)} AS materials, {labels('text', fv.USAGES)} AS usage FROM ({BUDGET_SQL}) b"""
_CONF = f"""least(0.95e0, 0.6e0 + least(({_count('tags')} + {_count('gift_for')} + {_count('shopping_with')} + {_count('occasions')}) * 0.05e0, 0.15e0)
  + CASE WHEN budget_confidence IN ('explicit', 'explicit_modified') THEN 0.15e0 WHEN budget_confidence = 'inferred_status' THEN 0.08e0 ELSE 0 END
  + CASE WHEN status IS NOT NULL THEN 0.05e0 ELSE 0 END + CASE WHEN allergies <> '' THEN 0.05e0 ELSE 0 END + CASE WHEN occasions <> '' THEN 0.05e0 ELSE 0 END)"""


@query("rule_confidence", f"SELECT id, round({_CONF}, 6) AS confidence FROM ({NOTE_SQL})")
def rule_confidence(spark, sf):
    found = t.read_once(spark, sf, lambda texts: extract.extract_note(texts, "text", PACK).select("text", F.round("rule_confidence", 6).alias("confidence")))
    return found.drop("text")


@query("extract_note", f"""
SELECT id, tags, CASE WHEN gift_for <> '' THEN 'Gift' ELSE 'Self' END AS purchase_type, coalesce(status, 'Unknown') AS family, diet, allergies AS contact,
  nullif(split_part(occasions, ',', 1), '') AS occasion, urgency, CASE WHEN urgency = 'high' THEN 'Warm' ELSE 'Discovery' END AS lead_temperature, budget_potential,
  CAST(amount AS INTEGER) AS budget_specific,
  round(100 * (CASE WHEN amount <> 0 THEN 0.25e0 ELSE 0 END + CASE WHEN status IS NOT NULL THEN 0.15e0 ELSE 0 END + CASE WHEN occasions <> '' THEN 0.15e0 ELSE 0 END
    + CASE WHEN colors <> '' THEN 0.15e0 ELSE 0 END + CASE WHEN materials <> '' THEN 0.15e0 ELSE 0 END + CASE WHEN usage <> '' THEN 0.15e0 ELSE 0 END), 2) AS quality,
  25e0 * (1 + CAST(tags <> '' AS INTEGER) + CAST(allergies = '' AS INTEGER) + CAST(coalesce(amount <> 0, false) AS INTEGER)) AS completeness,
  concat_ws('|', CASE WHEN NOT coalesce(amount <> 0, false) THEN 'Budget non spécifié' END, CASE WHEN status IS NULL THEN 'Statut client inconnu' END,
    CASE WHEN occasions = '' THEN 'Occasion non mentionnée' END) AS missing FROM ({NOTE_SQL})""")
def extract_note(spark, sf):
    return t.read_once(spark, sf, _extracted).drop("text")


def _extracted(texts):
    e = extract.extract_note(texts, "text", PACK)
    x = F.col("extraction")
    p1, p2, p3, p4 = (x[p] for p in schemas.PILLARS)
    meta = x["meta_analysis"]
    return e.select(
        "text", _joined(p1["categories"]).alias("tags"), p2["purchase_context"]["type"].alias("purchase_type"), p2["lifestyle"]["family"].alias("family"),
        _joined(p3["diet"]).alias("diet"), _joined(p3["allergies"]["contact"]).alias("contact"), p3["occasion"].alias("occasion"), p4["urgency"].alias("urgency"),
        p4["lead_temperature"].alias("lead_temperature"), p4["budget_potential"].alias("budget_potential"), p4["budget_specific"].alias("budget_specific"),
        meta["quality_score"].alias("quality"), meta["completeness_score"].alias("completeness"), F.array_join(meta["missing_info"], "|").alias("missing"),
    )


# --- routing -----------------------------------------------------------------------------------------

_SPECIAL = {"excessive_punct": r"\.{3,}|!{3,}|\?{3,}", "simple_or": r"(?:^|[^a-zA-Z])(ou|or)(?:\s|$|\?|!|\.)"}


def _flag(name: str, pattern: str) -> str:
    return any_regex("text", (_SPECIAL.get(name, pattern),))


def _sum(groups) -> str:
    return "(" + " + ".join(f"CASE WHEN {_flag(n, p)} THEN {pts}e0 ELSE 0e0 END" for n, p, pts in groups) + ")"


_NW = "len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))"
_NS = "len(list_filter(string_split_regex(text, '[.!?]+'), lambda x: trim(x) <> ''))"
ROUTE_SQL = f"""
SELECT *, least(20e0, q) AS lq, least(30e0, b) AS bc, least(15e0, i) AS it, least(10e0, r) AS rf,
  least(25e0, CASE WHEN words < 30 THEN 0 WHEN words < 100 THEN 5 WHEN words < 250 THEN 10 WHEN words < 500 THEN 15 WHEN words < 1000 THEN 20 ELSE 25 END
    + CASE WHEN sentences > 0 AND words / sentences > 30 THEN 5 ELSE 0 END + CASE WHEN len(regexp_extract_all(text, '[?]')) >= 3 THEN 3e0 ELSE 0e0 END) AS tc FROM (
  SELECT id, text, {_NW} AS words, {_NS} AS sentences, {_sum((n, p, pts // 2 if minor else pts) for n, (p, pts, minor) in fv.QUALITY_FLAGS.items())} AS q,
    {_sum((n, p, pts) for n, (p, pts) in fv.CRITICAL_FLAGS.items())} AS b,
    greatest({', '.join(f"CASE WHEN {_flag(n, p)} THEN {pts}e0 ELSE 0e0 END" for n, (p, pts) in fv.INTENT_FLAGS.items())}) AS i,
    {_sum((n, p, pts) for n, (p, pts) in fv.RISK_FLAGS.items())} AS r, {any_regex('text', fv.NEGATION_CONTEXT)} AS negation,
    {any_regex('text', (fv.COMPLAINT_WORDS,))} AS complaint, regexp_matches(text, '\\bVIC\\b') AS vic FROM ({T}))"""
SCORE_SQL = f"SELECT *, tc + lq + bc + it + rf + CASE WHEN negation THEN 15 ELSE 0 END AS total FROM ({ROUTE_SQL})"


@query("complexity", f"SELECT id, CAST(words AS INTEGER) AS word_count, tc AS text_complexity, lq AS linguistic_quality, bc AS business_criticality, it AS intent_type, rf AS risk_flags, negation, total AS complexity FROM ({SCORE_SQL})")
def complexity(spark, sf):
    return route.complexity(t.order_texts(spark, sf)).select("id", *route.FEATURES, "negation", "complexity")


@query("route", f"""
SELECT id, score AS complexity, CASE WHEN rf >= 10 OR (bc >= 10 AND complaint) OR (vic AND score > 60) THEN 3 WHEN score < 25 THEN 1 WHEN score < 75 THEN 2 ELSE 3 END AS tier,
  CASE WHEN vic AND score > 60 THEN 'critical' WHEN bc >= 10 AND complaint THEN 'high' WHEN rf >= 10 THEN 'critical' WHEN score < 25 THEN 'low' WHEN score < 75 THEN 'medium' WHEN score < 90 THEN 'high' ELSE 'critical' END AS priority,
  CASE WHEN rf >= 10 THEN 0.95e0 WHEN score < 25 THEN 0.85e0 WHEN score < 75 THEN 0.8e0 ELSE 0.9e0 END AS routing_confidence,
  CASE WHEN score < 25 THEN 2 WHEN score < 75 THEN 3 END AS fallback_tier FROM (SELECT *, total + CASE WHEN rf >= 8 THEN 30 ELSE 0 END AS score FROM ({SCORE_SQL}))""")
def route_notes(spark, sf):
    found = t.read_once(spark, sf, lambda texts: route.route(texts).select("text", "complexity", "tier", "priority", "routing_confidence", "fallback_tier"))
    return found.drop("text")


@query("router_training_set", f"""
SELECT label, count(*) AS n FROM (SELECT coalesce(actual_tier, CASE WHEN k % 6 = 0 THEN processing_tier END) AS label FROM ({t.FEEDBACK_SQL})) WHERE label IS NOT NULL GROUP BY 1""")
def router_training_set(spark, sf):
    return route.training_set(t.event_feedback(spark, sf)).groupBy("label").agg(F.count("*").alias("n"))


@query("route_ml")
def route_ml(spark, sf):
    counted = t.order_texts(spark, sf).groupBy("text").agg(F.count("*").alias("rows"))  # equal texts are read once
    texts = cut_lineage(counted.repartition(4 * spark.sparkContext.defaultParallelism), "router-texts")
    routed = route.route(texts, thresholds=(20, 60)).select("text", F.col("tier").alias("label"), "rows")
    router = route.train_router(routed)
    return route.route_ml(texts, router).groupBy("tier", "priority").agg(F.sum("rows").alias("n"), F.round(F.min("model_confidence"), 2).alias("least_confidence"))


@query("escalation", """
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' AND c < 0.9 THEN true WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND c < 0.6 THEN true ELSE false END AS escalate
FROM (SELECT *, (CAST(floor(o_totalprice) AS BIGINT) % 100) / 100e0 AS c FROM orders)""")
def escalation(spark, sf):
    o = t.table(spark, sf, "orders")
    conf = (F.floor("o_totalprice") % 100) / 100.0
    priority = F.when(F.col("o_orderpriority") == "1-URGENT", "Critical").when(F.col("o_orderpriority") == "2-HIGH", "high").otherwise("low")
    return o.select(F.col("o_orderkey").alias("id"), route.should_escalate(F.when(F.col("o_orderstatus") == "F", "VIC"), conf, priority).alias("escalate"))


@query("best_tier", """
SELECT l_orderkey AS note_id, max(l_linenumber) AS tier, arg_max(l_quantity, l_linenumber * 1000000 + l_quantity * 100) AS quantity FROM lineitem GROUP BY 1""")
def best_tier(spark, sf):
    results = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("note_id"), F.col("l_linenumber").alias("tier"), F.col("l_quantity").alias("quantity"))
    # several results of one tier: the largest one is defined first
    unique = results.groupBy("note_id", "tier").agg(F.max("quantity").alias("quantity"))
    return route.best_tier(unique)


# --- recommendation ------------------------------------------------------------------------------------

@query("min_tag", f"""
SELECT id, {first('lower(text)', fv.MINIMUM_TAGS, fv.MINIMUM_TAG_DEFAULT, any_contains)} AS tag FROM ({T})""")
def min_tag(spark, sf):
    return t.order_texts(spark, sf).select("id", recommend.minimum_tag(F.col("text")).alias("tag"))


@query("quality_fallback", f"""
SELECT id, CASE WHEN o_orderpriority = '5-LOW' THEN 'own' WHEN {_TAGS} <> '' THEN {_TAGS} ELSE {first('lower(text)', fv.MINIMUM_TAGS, fv.MINIMUM_TAG_DEFAULT, any_contains)} END AS tags,
  CASE WHEN o_orderpriority = '5-LOW' THEN '' WHEN {_TAGS} <> '' THEN 'tier1_no_tag_merge' ELSE 'deterministic_minimum_tag' END AS fallbacks FROM ({T})""")
def quality_fallback(spark, sf):
    own = F.when(F.col("o_orderpriority") == "5-LOW", F.array(F.lit("own"))).otherwise(F.array(F.lit(" ")))
    notes = t.order_texts(spark, sf).withColumns({"tags": own, "rule_tags": extract.extract_tags(F.col("text"), PACK)})
    out = recommend.quality_fallback(notes, "tags", "rule_tags")
    return out.select("id", _joined("tags").alias("tags"), _joined("fallbacks_applied").alias("fallbacks"))


@query("quality_gate", f"""
SELECT id, NOT (tags = '' AND ({_NW} >= 18 OR ({' + '.join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in fv.HIGH_SIGNAL_WORDS)}) >= 2)) AS passed FROM (SELECT id, text, {_TAGS} AS tags FROM ({T}))""")
def quality_gate(spark, sf):
    notes = t.order_texts(spark, sf)
    return notes.select("id", recommend.quality_gate(F.col("text"), extract.extract_tags(F.col("text"), PACK))["passed"].alias("passed"))


def _bounded_any(groups) -> dict:
    return {k: tuple(p for p in v) for k, v in groups.items()}


@query("enrich", f"""
SELECT id, CASE WHEN gift_for <> '' THEN 'Gift' ELSE 'Self' END AS purchase_type, {first('lower(text)', fv.ENRICH_BEHAVIOR.items(), None)} AS behavior,
  {labels('lower(text)', fv.ENRICH_COLORS)} AS new_colors, {labels('lower(text)', fv.ENRICH_MATERIALS)} AS new_materials,
  coalesce(nullif(split_part(occasions, ',', 1), ''), {first('lower(text)', fv.ENRICH_OCCASIONS.items(), None)}) AS occasion,
  CASE WHEN {any_regex('lower(text)', fv.ENRICH_ALLERGY_MENTION)} THEN {labels('lower(text)', fv.ENRICH_FOOD)} ELSE '' END AS food FROM ({NOTE_SQL})""")
def enrich(spark, sf):
    return t.read_once(spark, sf, _enriched).drop("text")


def _enriched(texts):
    notes = extract.extract_note(texts, "text", PACK).select("text", "extraction")
    e = recommend.enrich_record(recommend.unpack(notes))
    colors, materials = list(fv.ENRICH_COLORS), list(fv.ENRICH_MATERIALS)
    old = F.col("extraction")[schemas.PILLARS[0]]["preferences"]
    # 'black', 'beige' and 'canvas' style labels may already be there from extraction
    def shown(column, names, previous):
        low = F.lower("text")
        groups = fv.ENRICH_COLORS if column == "colors" else fv.ENRICH_MATERIALS
        from notewell.functions.matching import labels_matching

        ours = F.array_distinct(F.concat(F.filter(F.col(column), lambda v: v.isin(names)), previous))
        found = labels_matching(low, groups)
        return _joined(F.filter(found, lambda v: F.array_contains(ours, v)))

    return e.select(
        "text", "purchase_type", "behavior", shown("colors", colors, old["colors"]).alias("new_colors"),
        shown("materials", materials, old["materials"]).alias("new_materials"), "occasion", _joined("food").alias("food"),
    )


_BEH = first("lower(text)", fv.ENRICH_BEHAVIOR.items(), None)
_OCC1 = f"coalesce(nullif(split_part(occasions, ',', 1), ''), {first('lower(text)', fv.ENRICH_OCCASIONS.items(), None)})"
_RESERVE, _MEET, _WALLET = any_regex("text", fv.RESERVE_WORDS), any_regex("text", fv.MEETING_WORDS), any_regex("text", fv.WALLET_WORDS)
_NICKEL = "regexp_matches(text, '(?i)\\bnickel\\b')"


@query("next_action", f"""
SELECT id, CASE WHEN occ IN ('birthday', 'birthday_gift', 'wedding_anniversary') THEN 'gift_suggestion' ELSE 'follow_up' END AS action_type,
  CASE WHEN {_RESERVE} OR {_NICKEL} THEN 'High' ELSE 'Medium' END AS priority, {_MEET} AS meeting, {_NICKEL} AS nickel, {_WALLET} AS wallet,
  occ NOT IN ('birthday', 'birthday_gift', 'wedding_anniversary') AND coalesce(beh, 'client') <> 'first_visit' AND tags <> '' AS on_interest
FROM (SELECT *, coalesce({_OCC1}, '') AS occ, {_BEH} AS beh FROM ({NOTE_SQL}))""")
def next_action(spark, sf):
    return t.read_once(spark, sf, _acted).drop("text")


def _acted(texts):
    notes = extract.extract_note(texts, "text", PACK).select("text", "extraction")
    out = recommend.next_best_action(recommend.enrich_record(recommend.unpack(notes)))
    d = F.col("action.description")
    return out.select(
        "text", F.col("action.action_type").alias("action_type"), F.col("action.priority").alias("priority"), d.contains("RDV").alias("meeting"),
        d.contains("sans nickel").alias("nickel"), d.contains("portefeuille assorti").alias("wallet"), d.startswith("Relance le client sur ses favoris").alias("on_interest"),
    )


@query("adjust_prediction", """
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'Critical' WHEN o_orderpriority = '1-URGENT' THEN 'High' ELSE 'Medium' END AS priority,
  'base' || CASE WHEN o_orderstatus = 'F' THEN ' Risque churn estime: ' || CAST(round_even(((CAST(floor(o_totalprice) AS BIGINT) % 100) / 100e0) * 100, 0) AS BIGINT) || '%.' ELSE '' END
    || CASE WHEN o_orderpriority = '1-URGENT' THEN ' CLV estime: 12,346 EUR.' ELSE '' END AS description FROM orders""")
def adjust_prediction(spark, sf):
    action = F.struct(
        F.lit("follow_up").alias("action_type"), F.lit("base").alias("description"), F.lit("Medium").alias("priority"),
        F.array().cast("array<string>").alias("target_products"), F.lit(None).cast("string").alias("deadline"),
    ).cast(schemas.NEXT_ACTION)
    o = t.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), action.alias("action"), F.array().cast(f"array<{schemas.MATCHED_PRODUCT}>").alias("matched_products"),
        F.when(F.col("o_orderstatus") == "F", "high").otherwise("low").alias("churn_level"), ((F.floor("o_totalprice") % 100) / 100.0).alias("churn_risk"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "platinum").otherwise("gold").alias("clv_tier"), F.lit(12345.6).alias("clv_estimate"),
    )
    return recommend.adjust_for_prediction(o).select("id", "action.priority", "action.description")


_CUST = """SELECT c_custkey, c_mktsegment, (c_nationkey - 12) / 12e0 AS s, CASE c_mktsegment WHEN 'BUILDING' THEN 'VIP' WHEN 'MACHINERY' THEN 'Ultimate' WHEN 'FURNITURE' THEN 'Premium' ELSE 'Regular' END AS cat,
  CASE WHEN c_acctbal > 6000 THEN 'Mode' WHEN c_acctbal > 3000 THEN 'bijoux' WHEN c_acctbal > 1000 THEN 'parfums' ELSE 'vin' END AS interest FROM customer"""


def _customers(spark, sf):
    seg, bal = F.col("c_mktsegment"), F.col("c_acctbal")
    return t.table(spark, sf, "customer").select(
        "c_custkey", ((F.col("c_nationkey") - 12) / 12.0).alias("s"),
        F.when(seg == "BUILDING", "VIP").when(seg == "MACHINERY", "Ultimate").when(seg == "FURNITURE", "Premium").otherwise("Regular").alias("cat"),
        F.when(bal > 6000, "Mode").when(bal > 3000, "bijoux").when(bal > 1000, "parfums").otherwise("vin").alias("interest"),
    )


@query("event_action", f"""
SELECT c_custkey, CASE WHEN cat IN ('VIP', 'Ultimate') AND s >= 0.5 THEN 'invitation' WHEN cat IN ('VIP', 'Ultimate') AND s < -0.3 THEN 'escalation' WHEN cat = 'Premium' AND s >= 0.7 THEN 'invitation' END AS action_type,
  CASE WHEN cat IN ('VIP', 'Ultimate') AND s >= 0.5 THEN CASE WHEN interest = 'vin' THEN 'Medium' ELSE 'High' END WHEN cat IN ('VIP', 'Ultimate') AND s < -0.3 THEN 'Critical' WHEN cat = 'Premium' AND s >= 0.7 THEN 'Medium' END AS priority FROM ({_CUST})""")
def event_action(spark, sf):
    a = recommend.event_action(F.col("cat"), F.col("s"), F.array("interest"))
    return _customers(spark, sf).select("c_custkey", a["action_type"].alias("action_type"), a["priority"].alias("priority"))


@query("loyalty_action", f"""
SELECT c_custkey, CASE WHEN cat IN ('VIP', 'Ultimate') AND s < 0 AND NOT (interest = 'Mode' AND s >= -0.3) THEN 'appel_fidelisation' WHEN cat = 'Premium' AND s < -0.3 AND interest <> 'Mode' THEN 'appel_fidelisation' ELSE 'existing' END AS action_type FROM ({_CUST})""")
def loyalty_action(spark, sf):
    existing = F.struct(
        F.lit("existing").alias("action_type"), F.lit("x").alias("description"), F.when(F.col("interest") == "Mode", "High").otherwise("Medium").alias("priority"),
        F.array().cast("array<string>").alias("target_products"), F.lit(None).cast("string").alias("deadline"),
    ).cast(schemas.NEXT_ACTION)
    return _customers(spark, sf).withColumn("existing", existing).select(
        "c_custkey", recommend.loyalty_action(F.col("cat"), F.col("s"), F.col("existing"))["action_type"].alias("action_type")
    )


_CS = """CASE interest WHEN 'Mode' THEN ['Accessoires', 'Sacs'] WHEN 'bijoux' THEN ['Bijoux fins', 'Bracelets'] WHEN 'parfums' THEN ['Parfums femme', 'Parfums homme'] ELSE ['Champagne', 'Vins fins'] END"""
_EXTRA = """CASE WHEN cat IN ('VIP', 'Ultimate') AND interest = 'parfums' THEN ['Collection privée - Accès avant-première'] WHEN cat IN ('VIP', 'Ultimate') AND interest = 'bijoux' THEN ['Rendez-vous atelier joaillerie'] ELSE [] END"""


@query("cross_sell", f"SELECT c_custkey, array_to_string(list_concat({_CS}, {_EXTRA}), '|') AS products FROM ({_CUST})")
def cross_sell(spark, sf):
    return _customers(spark, sf).select("c_custkey", F.array_join(recommend.cross_sell(F.array("interest"), F.col("cat")), "|").alias("products"))


@query("recommend", f"SELECT c_custkey, 'Item ' || (c_custkey % 3) || '|' || array_to_string(list_concat({_CS}, {_EXTRA}), '|') AS products FROM ({_CUST})")
def recommend_products(spark, sf):
    item = F.concat(F.lit("Item "), (F.col("c_custkey") % 3).cast("string"))
    names = F.array(item, item, F.lit(" "))
    return _customers(spark, sf).select("c_custkey", F.array_join(recommend.recommend(names, F.array("interest"), F.col("cat")), "|").alias("products"))


_SIG = {k: any_contains("lower(text)", v) for k, v in fv.QUALITY_SIGNALS.items()}
_W = fv.QUALITY_WEIGHTS
_LONG = "(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) >= 18)"
_COMPONENTS = {
    "categories": ("true", "tags <> ''"), "context": ("true", "true"), "usage": (_SIG["usage"], "usage <> ''"),
    "preferences": (_SIG["preferences"], "(colors <> '' OR materials <> '')"), "budget": (f"({_SIG['budget']} OR {_LONG})", "true"),
    "profession": (_SIG["profession"], "gender"), "occasion": (_SIG["occasion"], "occasions <> ''"),
    "occasion_specificity": (_SIG["occasion"], "split_part(occasions, ',', 1) = 'wedding_anniversary'"), "care": (_SIG["care"], "(allergies <> '' OR diet <> '')"),
    "rag": ("tags <> ''", "false"),
}
_EXP = " + ".join(f"CASE WHEN {e} THEN {_W[n]} ELSE 0 END" for n, (e, _) in _COMPONENTS.items())
_GOT = " + ".join(f"CASE WHEN {e} AND {p} THEN {_W[n]} ELSE 0 END" for n, (e, p) in _COMPONENTS.items())
_MISS = "concat_ws('|', " + ", ".join(f"CASE WHEN {e} AND NOT {p} THEN {lit(fv.QUALITY_LABELS[n])} END" for n, (e, p) in _COMPONENTS.items() if n in fv.QUALITY_LABELS) + ")"


@query("quality_score", f"""
SELECT id, round(got / exp * 100e0 * (0.72e0 + 0.28e0 * least(1e0, words / 18e0)), 2) AS quality_score, round(got / exp * 100e0, 2) AS completeness_score, missing FROM (
  SELECT id, {_EXP} AS exp, {_GOT} AS got, {_MISS} AS missing, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS words
  FROM (SELECT *, regexp_matches(text, '(?i)\\b(Mme|Madame|Mrs|Ms|Dame|femme|cliente|elle|she|Mr|Monsieur|Sir|homme|client|il|he)\\b') AS gender FROM ({NOTE_SQL})))""")
def quality_score(spark, sf):
    return t.read_once(spark, sf, _scored).drop("text")


def _scored(texts):
    notes = extract.extract_note(texts, "text", PACK).select("text", "extraction")
    out = recommend.quality_score(recommend.unpack(notes))
    return out.select("text", "quality_score", "completeness_score", F.array_join("missing_info", "|").alias("missing"))


@query("recommend_note")
def recommend_note(spark, sf):
    def read(texts):
        out = recommend.recommend_note(extract.extract_note(texts, "text", PACK).select("text", "extraction"))
        action = F.col("extraction")[schemas.PILLARS[3]]["next_best_action"]
        return out.select("text", action["action_type"].alias("action_type"), action["priority"].alias("priority"), F.col("extraction.meta_analysis.quality_score").alias("quality"))

    return t.read_once(spark, sf, read).groupBy("action_type", "priority").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 2).alias("avg_quality"))


@query("points", """
SELECT c_custkey, CASE WHEN CASE WHEN q <= 1 THEN q * 100 ELSE q END > 50 THEN 10 ELSE 5 END AS batch, CASE WHEN CASE WHEN q <= 1 THEN q * 100 ELSE q END >= 80 THEN 15 ELSE 10 END AS single, 0 AS fast
FROM (SELECT c_custkey, c_acctbal / 9999e0 AS q FROM customer)""")
def points(spark, sf):
    q = F.col("c_acctbal") / 9999.0
    return t.table(spark, sf, "customer").select(
        "c_custkey", recommend.batch_points(q).alias("batch"), recommend.note_points(q).alias("single"), recommend.batch_points(q, fast=True).alias("fast")
    )


@query("client_category", """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'VIC' WHEN 'MACHINERY' THEN 'Ultimate' WHEN 'FURNITURE' THEN 'VIC' ELSE 'Regular' END AS category FROM customer""")
def client_category(spark, sf):
    seg = F.col("c_mktsegment")
    behavior = F.when(seg == "BUILDING", "vic").when(seg == "MACHINERY", "Ultimate").when(seg == "FURNITURE", "PLATINUM").when(seg == "HOUSEHOLD", "vip")
    return t.table(spark, sf, "customer").select("c_custkey", recommend.client_category(behavior, F.lit("Regular")).alias("category"))


@query("parity", """
SELECT p_partkey AS id, p_size % 3 <> p_size % 2 AS tier_mismatch, (p_type = 'PROMO') <> (p_size > 25) AS rgpd_mismatch,
  round(CASE WHEN w1 = lower(p_type) OR w2 = lower(p_type) THEN 0.5e0 ELSE 1e0 / 3 END, 6) AS tag_jaccard
FROM (SELECT *, string_split(p_name, ' ')[1] AS w1, string_split(p_name, ' ')[2] AS w2 FROM part)""")
def parity(spark, sf):
    tags = t.part_tags(spark, sf)
    a = tags.select("id", (F.col("p_size") % 3).alias("tier"), (F.col("p_type") == "PROMO").alias("contains_sensitive"), F.col("actual").alias("tags"))
    b = tags.select("id", (F.col("p_size") % 2).alias("tier"), (F.col("p_size") > 25).alias("contains_sensitive"), F.col("expected").alias("tags"))
    return quality.parity(a, b).withColumn("tag_jaccard", F.round("tag_jaccard", 6))


# --- model responses ----------------------------------------------------------------------------------

VOCAB = ["standard", "promo", "large", "small", "economy", "medium", "birthday_gift", "widget", "gear"]


def _responses(spark, sf):
    p = t.table(spark, sf, "part")
    raw = F.to_json(
        F.struct(
            F.array(F.lower("p_type"), F.lit("Birthday"), F.substring_index("p_name", " ", 1), F.concat(F.lower("p_type"), F.lit("x"))).alias("tags"),
            F.array(F.substring_index("p_name", " ", 1)).alias("colors"),
            F.when(F.col("p_size") > 25, "VIP").otherwise("  ").alias("client_status"),
            F.when(F.col("p_size") > 40, "Paris").when(F.col("p_size") > 20, "avocat").otherwise("Lyon").alias("profession"),
            F.array(F.lit("lyon")).alias("locations"),
            F.lit("this_month").alias("urgency"), F.lit("core").alias("budget_tier"),
            F.when(F.col("p_size") > 10, F.col("p_size") / 100.0).alias("confidence"),
        )
    )
    return p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_type") == "PROMO", "{oops").otherwise(raw).alias("raw"))


@query("model_json_flat", """
SELECT p_partkey AS id, CASE WHEN p_type = 'PROMO' THEN '' ELSE lower(p_type) || CASE WHEN split_part(p_name, ' ', 1) IN ('standard', 'promo', 'large', 'small', 'economy', 'medium', 'widget', 'gear') THEN ',' || split_part(p_name, ' ', 1) ELSE '' END || ',' || lower(p_type) END AS categories, CASE WHEN p_type = 'PROMO' THEN NULL ELSE 'birthday_gift' END AS occasion,
  CASE WHEN p_type <> 'PROMO' AND p_size > 25 THEN 'VIP' END AS behavior, CASE WHEN p_type <> 'PROMO' AND p_size > 20 AND p_size <= 40 THEN 'avocat' END AS sector,
  CASE WHEN p_type = 'PROMO' THEN NULL ELSE 'core (None)' END AS budget_potential, CASE WHEN p_type = 'PROMO' THEN 0e0 WHEN p_size > 10 THEN p_size / 100e0 ELSE 0.8e0 END AS confidence FROM part""")
def model_json_flat(spark, sf):
    out = extract.normalize_flat_json(_responses(spark, sf), "raw", VOCAB, ["birthday_gift"])
    return out.select("id", _joined("categories").alias("categories"), "occasion", "behavior", "sector", "budget_potential", "confidence")


@query("model_json_nested", """
SELECT p_partkey AS id, CASE WHEN p_type = 'PROMO' THEN '' ELSE lower(p_type) || ',birthday_gift' END AS categories, CASE WHEN p_type = 'PROMO' THEN '' ELSE string_split(p_name, ' ')[1] END AS colors,
  'Unknown' AS family, 'Warm' AS lead_temperature, CASE WHEN p_type = 'PROMO' THEN 0e0 WHEN p_size > 10 THEN p_size / 100e0 ELSE 0.8e0 END AS confidence,
  p_type <> 'PROMO' AND p_size > 25 AS rgpd_flag FROM part""")
def model_json_nested(spark, sf):
    raw = F.to_json(
        F.struct(
            F.struct(F.array(F.lower("p_type"), F.lit("birthday"), F.lit("zzzz")).alias("categories"), F.struct(F.array(F.substring_index("p_name", " ", 1)).alias("colors")).alias("preferences")).alias("pilier_1_univers_produit"),
            F.struct(
                F.when(F.col("p_size") > 10, F.col("p_size") / 100.0).alias("confidence_score"), F.when(F.col("p_size") > 25, F.array(F.lit("health"))).alias("risk_flags")
            ).alias("meta_analysis"),
        )
    )
    p = t.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_type") == "PROMO", "[1,").otherwise(raw).alias("raw"))
    out = extract.normalize_nested_json(p, "raw", VOCAB)
    return out.select("id", _joined("categories").alias("categories"), _joined("colors").alias("colors"), "family", "lead_temperature", "confidence", "rgpd_flag")


@query("model_spans", """
SELECT p_partkey AS id, p_type AS categories, p_brand || ' ' || p_name AS products, p_size * 100 AS budget_max, CASE WHEN p_size > 25 THEN 'VIP' ELSE 'Regular' END AS behavior,
  'gala' AS occasion, 'call' AS action_type, CASE WHEN p_size > 40 THEN 'high' ELSE 'medium' END AS urgency, p_size > 25 AS is_vic FROM part""")
def model_spans(spark, sf):
    def span(kind, text, **attrs):
        names = ("categorie", "marque", "budget", "statut", "occasion", "type_action", "urgence")
        cells = [(attrs[n] if n in attrs else F.lit(None)).cast("string").alias(n) for n in names]
        return F.struct(F.lit(kind).alias("class"), text.alias("text"), F.struct(*cells).alias("attributes"), F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end"))

    size = F.col("p_size")
    spans = F.array(
        span("produit", F.col("p_name"), categorie=F.concat(F.lit("['"), "p_type", F.lit("']")), marque=F.col("p_brand"), budget=F.concat((size * 100).cast("string"), F.lit("€"))),
        span("profil_client", F.lit("x"), statut=F.when(size > 25, "VIC").otherwise("Fidèle")),
        span("profil_client", F.lit("x"), statut=F.lit("autre")),
        span("hospitalite", F.lit("soirée"), occasion=F.lit("mariage")),
        span("hospitalite", F.lit("soirée"), occasion=F.lit('["gala", "x"]')),
        span("action_business", F.lit("rappel"), type_action=F.lit("call"), urgence=F.when(size > 40, "Haute").otherwise("basse")),
    ).cast(f"array<{schemas.SPAN}>")
    p = t.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), spans.alias("spans"))
    out = extract.normalize_spans(p)
    return out.select("id", _joined("categories").alias("categories"), _joined("produits_mentionnes").alias("products"), "budget_max", "behavior", "occasion", "action_type", "urgency", "is_vic")


@query("query_intents", f"""
SELECT id, concat_ws(',', CASE WHEN {any_contains('lower(text)', fv.INTENT_WORDS['bags'])} THEN 'bags' END, CASE WHEN {any_contains('lower(text)', fv.INTENT_WORDS['small_leather'])} THEN 'small_leather' END,
  CASE WHEN {any_contains('lower(text)', fv.INTENT_WORDS['apparel'])} THEN 'apparel' END) AS intents, {labels('lower(text)', fv.COLOR_ALIASES, any_contains)} AS colors,
  {first('lower(text)', fv.CATEGORY_INFERENCE, None, any_contains)} AS category FROM ({T})""")
def query_intents(spark, sf):
    x = F.col("text")
    return t.order_texts(spark, sf).select(
        "id", _joined(match.infer_intents(x)).alias("intents"), _joined(match.color_hints(x)).alias("colors"), match.infer_category(x).alias("category")
    )


