import pytest
from pyspark.sql import functions as F

from notewell import schemas
from notewell.functions import packs
from notewell.functions.packs import RulePack
from notewell.operators import windows
from notewell.plans import catalog, extract, metrics, recommend, route

X = F.col("text")
PACK = RulePack.from_keywords(
    "shop", {"leather_goods": ["sac", "bag", "maroquinerie"], "watches": ["montre", "watch"], "accessories": ["ceinture", "belt"], "gift": ["cadeau"], "shoes": ["chaussures"]}
)
# invented notes: text, tags, budget, status, allergies, relation, gender, diet, urgency
LABELLED = [
    ("Mme Leroy, VIC, cherche un sac noir pour elle. Budget 4000 euros. Urgent.", {"leather_goods"}, 4000, "vic", set(), "Gift", "female", set(), "high"),
    ("Client VIP looking for a watch, gift for his wife, budget 12k. Peanut allergy.", {"watches"}, 12000, "vip", {"nut_allergy"}, "Gift", "male", set(), "low"),
    ("Monsieur Petit veut une ceinture, budget 3-4k, cette semaine, allergie nickel.", {"accessories"}, 3500, None, {"nickel_allergy"}, "Self", "male", set(), "medium"),
    ("Nouvelle cliente, vegan, sans budget.", set(), None, "first_visit", set(), "Self", "female", {"vegan"}, "low"),
    ("Pas fan de cuir, elle prend une montre.", set(), None, None, set(), "Self", "female", set(), "low"),
    ("Elle veut un sac comme celui de sa soeur.", set(), None, None, set(), "Gift", "female", set(), "low"),
]


@pytest.fixture(scope="module")
def extracted(spark):
    rows = [(i, r[0]) for i, r in enumerate(LABELLED)]
    return {r["id"]: r for r in extract.extract_note(spark.createDataFrame(rows, "id int, text string"), "text", PACK).collect()}


@pytest.mark.parametrize("i", range(len(LABELLED)))
def test_labelled_notes(extracted, i):
    _, tags, budget, status, allergies, relation, gender, diet, urgency = LABELLED[i]
    row = extracted[i]
    p1, p2, p3, p4 = (row["extraction"][p] for p in schemas.PILLARS)
    assert set(p1["categories"]) == tags
    assert p4["budget_specific"] == budget and row["client_status"] == status
    assert set(p3["allergies"]["contact"]) == allergies and set(p3["diet"]) == diet
    assert p2["purchase_context"]["type"] == relation and p2["profession"]["status"] == gender and p4["urgency"] == urgency
    assert 0.6 <= row["rule_confidence"] <= 0.95


@pytest.mark.parametrize(
    "note,amount", [("budget 3-4k", 3500), ("budget 120000", 120000), ("budget de 3000 à 5000 euros", 4000), ("Budget: 5K", 5000), ("entre 3 et 5k", 4000),
                    ("8k de budget", 8000), ("4500 €", 4500), ("$12000", 12000), ("budget 800", 800), ("rien", None)]
)
def test_amounts(one, note, amount):
    assert one(note, packs.first_amount(F.lower(X))) == amount


def test_unlimited_is_not_limited(one):
    assert one("budget 1000, illimité", extract.infer_budget(X, F.lit(None).cast("string"))).max == 1200
    assert one("budget 1000, limité", extract.infer_budget(X, F.lit(None).cast("string"))).max == 840


def test_budget_by_status_and_wording(one):
    assert one("x", extract.infer_budget(X, F.lit("vic"))).asDict() == {"amount": None, "min": 10000, "max": 50000, "range": "50K+", "tier": "ultra_high", "confidence": "inferred_status"}
    assert one("du luxe", extract.infer_budget(X, F.lit(None).cast("string"))).confidence == "inferred_keywords"
    assert one("x", extract.infer_budget(X, F.lit(None).cast("string"))).tier == "flexible_unknown"


def test_severity_is_kept(one):
    care = one("allergie au nickel sévère", extract.extract_care(X))
    assert care.severity == "high" and care.allergies == ["nickel_allergy"]
    assert one("rien de grave", extract.extract_care(X)).severity is None


def test_choices_skip_stop_words(one):
    assert [tuple(p) for p in one("Elle cherche un sac noir ou marron ?", extract.extract_choices(X))][0] == ("noir", "marron")
    assert one("elle veut le ou la ?", extract.extract_choices(X)) == []


def test_gender_is_the_first_mention(one):
    assert one("Monsieur vient avec sa femme", windows.client_gender(X)) == "male" and one("Madame et son mari, il paie", windows.client_gender(X)) == "female"
    assert one("rien", windows.client_gender(X)) is None


def test_keyword_of_two_tags_belongs_to_the_last(one):
    pack = RulePack.from_keywords("p", {"a": ["sac"], "b": ["sac", "cat"]})
    assert one("un sac", pack.matching(F.lower(X))) == ["b"] and one("la catégorie", pack.matching(F.lower(X))) == []
    with pytest.raises(ValueError):
        RulePack("big", {str(i): ("x",) for i in range(packs.MAX_INLINE_LABELS + 1)})


def routed(spark, note, **kw):
    return route.route(spark.createDataFrame([(note,)], "text string"), **kw).first()


def test_routing_levels(spark):
    assert routed(spark, "Cherche un sac").tier == 1
    assert routed(spark, "Client VIP, urgent, flexible et un sac").tier == 2
    risky = routed(spark, "Note: elle a un cancer")
    assert risky.tier == 3 and risky.priority == "critical" and risky.routing_confidence == 0.95 and risky.estimated_cost == 0.005
    complaint = routed(spark, "Plainte du client, mécontent")
    assert complaint.tier == 3 and complaint.priority == "high"
    assert any("Complaint" in r for r in complaint.reasons)
    assert routed(spark, "Client VIP, urgent, flexible", thresholds=(5, 20)).tier == 3


def test_long_notes_keep_the_top_length_points(spark):
    assert routed(spark, "mot " * 12000).text_complexity == 25.0


def test_written_mode_halves_small_slips(spark):
    df = spark.createDataFrame([("euhhh rdv svp!!!",)], "text string")
    assert route.complexity(df, written=True).first().linguistic_quality == 5.0
    assert route.complexity(df, written=False).first().linguistic_quality == 12.0


def test_learned_router_keeps_the_floor(spark):
    notes = [(f"Cherche un sac {i}", 1) for i in range(30)] + [(f"Client VIP urgent flexible {i} budget 20 k", 2) for i in range(30)]
    router = route.train_router(spark.createDataFrame(notes, "text string, label int"), trees=5, folds=2)
    assert router is not None and router.threshold in (0.70, 0.75, 0.80, 0.85)
    out = {r["text"]: r for r in route.route_ml(spark.createDataFrame([("Cherche un sac",), ("elle a un cancer",)], "text string"), router).collect()}
    assert out["elle a un cancer"].tier == 3 and out["Cherche un sac"].tier == 1
    assert route.train_router(spark.createDataFrame(notes[:5], "text string, label int")) is None
    assert route.confidence_threshold(0.91) == 0.70 and route.confidence_threshold(0.5) == 0.85


def test_recommendation_over_records(spark):
    note = "Mme Leroy, VIC, anniversaire de mariage, réserver le sac, rdv lundi 11h, allergie nickel, portefeuille"
    df = extract.extract_note(spark.createDataFrame([(note,)], "text string"), "text", PACK).select("text", "extraction")
    row = recommend.recommend_note(df).first()["extraction"]
    action = row[schemas.PILLARS[3]]["next_best_action"]
    assert action["action_type"] == "gift_suggestion" and action["priority"] == "High"
    for part in ("Reserver", "sans nickel", "RDV lundi 11h", "portefeuille assorti"):
        assert part in action["description"]
    assert row[schemas.PILLARS[1]]["purchase_context"]["behavior"] == "vic" and 0 < row["meta_analysis"]["quality_score"] <= 100


def test_events_and_calls(one):
    args = (F.lit("Ultimate"), F.lit(-0.6))
    event = recommend.event_action(*args, F.array(F.lit("mode")))
    assert one("x", event).action_type == "escalation"
    assert one("x", recommend.loyalty_action(*args, event)).action_type == "escalation"  # equal priority does not replace
    assert one("x", recommend.event_action(F.lit("Regular"), F.lit(0.9), F.array(F.lit("mode")))) is None


def test_cross_sell_is_ordered_distinct_and_bounded(one):
    got = one("x", recommend.cross_sell(F.array(F.lit("Parfums"), F.lit("fragrance"), F.lit("vin")), F.lit("VIP")))
    assert got == ["Parfums femme", "Parfums homme", "Champagne"]


def test_quality_gate(one):
    gate = one("budget et cadeau", recommend.quality_gate(X, F.array().cast("array<string>")))
    assert not gate.passed and gate.reason


def test_rerank_bounds(one):
    score = catalog.rerank(F.lit(0.2), F.lit("jean pant"), F.array(F.lit("bags"), F.lit("small_leather")), F.array(F.lit("x")), F.array(F.lit("y")), F.lit("bags"))
    assert one("x", score) == 0.0


def test_malformed_model_json_is_reported(spark):
    raw = spark.createDataFrame([(1, '{"tags": ["VIP_visit", "birthdayy"], "urgency": "now"}'), (2, "{oops"), (3, None)], "id int, raw string")
    out = {r["id"]: r for r in extract.normalize_flat_json(raw, "raw", ["birthday", "gear"], ["birthday"]).collect()}
    assert out[1].occasion == "birthday" and out[1].urgency == "now" and out[1].confidence == 0.8 and out[1].error is None
    assert out[2].error and out[3].error and out[2].confidence == 0.0


def test_alerts_and_health(spark):
    row = spark.createDataFrame([(6000.0, 90.0, 11.0, 50.0, 12)], "avg_processing_time_ms double, success_rate double, total_cost_eur double, accuracy_rate double, total_feedback int")
    out = metrics.health(row).first()
    assert out.alerts_count == 4 and out.health_score == 0.0 and out.health_status == "critical"
