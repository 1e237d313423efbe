"""Complexity scoring and routing to an extraction tier, by rules and by a learned model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewell import fixed_values as fv
from notewell.functions import matching as m

FEATURES = ("text_complexity", "linguistic_quality", "business_criticality", "intent_type", "risk_flags", "word_count")


def _title(name: str) -> str:
    return name.replace("_", " ").title()


def _points(points: dict[str, tuple[Column, float]]) -> Column:
    return sum((F.when(cond, float(p)).otherwise(0.0) for cond, p in points.values()), F.lit(0.0))


def _factor_list(points: dict[str, tuple[Column, float]], prefix: str = "") -> list[Column]:
    return [
        F.when(cond, F.lit(f"{prefix}{_title(name)}: +{p}")) for name, (cond, p) in points.items() if p > 0
    ]


def complexity(df: DataFrame, text: str = "text", written: bool = True) -> DataFrame:
    """Adds the five capped components, ``word_count``, ``negation``, ``complexity`` and ``factors``."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = m.word_count(t)
    length_points = None
    for limit, points in fv.LENGTH_POINTS:
        length_points = F.when(words < limit, float(points)) if length_points is None else length_points.when(
            words < limit, float(points)
        )
    length_points = length_points.otherwise(float(fv.LENGTH_POINTS_MAX))
    sentences = F.size(F.filter(F.split(t, r"[.!?]+"), lambda s: ~m.blank(s)))
    long_sentences = (sentences > 0) & (words / sentences > 30)
    questions = F.regexp_count(t, F.lit(r"\?"))

    def flags(patterns) -> dict[str, tuple[Column, float]]:
        return {name: (m.any_match(t, (p,)), points) for name, (p, points) in patterns.items()}

    quality = {
        # back-references need the pattern alone; written notes halve the penalty of small slips
        name: (F.coalesce(t.rlike(m.FLAGS + p), F.lit(False)), points // 2 if written and minor else points)
        for name, (p, points, minor) in fv.QUALITY_FLAGS.items()
    }
    business, intents, risks = flags(fv.CRITICAL_FLAGS), flags(fv.INTENT_FLAGS), flags(fv.RISK_FLAGS)
    caps = fv.COMPONENT_CAPS
    top_intent = F.greatest(*[F.when(c, float(p)).otherwise(0.0) for c, p in intents.values()])
    ranked = sorted(intents.items(), key=lambda kv: -kv[1][1])
    intent_factor = None
    for name, (cond, points) in ranked:
        label = F.lit(f"Intent: {_title(name)}: +{points}")
        intent_factor = F.when(cond, label) if intent_factor is None else intent_factor.when(cond, label)
    negation = m.any_match(t, fv.NEGATION_CONTEXT)
    scored = df.withColumns(
        {
            "word_count": words,
            "text_complexity": F.least(
                length_points + F.when(long_sentences, 5.0).otherwise(0.0) + F.when(questions >= 3, 3.0).otherwise(0.0),
                F.lit(caps["text"]),
            ),
            "linguistic_quality": F.least(_points(quality), F.lit(caps["quality"])),
            "business_criticality": F.least(_points(business), F.lit(caps["business"])),
            "intent_type": F.least(top_intent, F.lit(caps["intent"])),
            "risk_flags": F.least(_points(risks), F.lit(caps["risk"])),
            "negation": negation,
            "factors": F.array_compact(
                F.array(
                    F.when(length_points > 10, F.format_string("Texte long (%d mots): +%d", words, length_points.cast("int"))),
                    F.when(long_sentences, F.format_string("Phrases complexes (avg %.0f mots): +5", words / sentences)),
                    F.when(questions >= 3, F.format_string("Multiples questions (%d): +3", questions)),
                    *_factor_list(quality),
                    *_factor_list(business),
                    intent_factor,
                    *_factor_list(risks, "🚨 "),
                    F.when(negation, F.lit("⚠️ Negation context detected: +15")),
                )
            ),
        }
    )
    total = sum((F.col(c) for c in FEATURES[:5]), F.lit(0.0)) + F.when(F.col("negation"), 15.0).otherwise(0.0)
    return scored.withColumn("complexity", total)


def _by_tier(tier: Column, table: dict[int, float]) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(tier == key, F.lit(value)) if out is None else out.when(tier == key, F.lit(value))
    return out


def route(df: DataFrame, text: str = "text", thresholds: tuple[int, int] = fv.ROUTER_THRESHOLDS,
          client_status: str | None = None, written: bool = True) -> DataFrame:
    """Adds tier, priority, routing confidence, reasons, cost, time and fallback tier."""
    scored = complexity(df, text, written)
    t = F.coalesce(F.col(text), F.lit(""))
    low, high = thresholds
    boost = F.col("risk_flags") >= 8
    scored = scored.withColumn("complexity", F.col("complexity") + F.when(boost, 30.0).otherwise(0.0))
    score = F.col("complexity")
    critical = F.col("risk_flags") >= 10
    complaint = (F.col("business_criticality") >= 10) & m.any_match(t, (fv.COMPLAINT_WORDS,))
    vic = F.coalesce(t.rlike(r"\bVIC\b"), F.lit(False))
    if client_status:
        vic = vic | F.coalesce(F.lower(client_status).isin("vic", "ultimate", "platinum"), F.lit(False))
    premium = vic & (score > 60)
    base_tier = F.when(score < low, 1).when(score < high, 2).otherwise(3)
    base_priority = (
        F.when(score < low, "low").when(score < high, "medium").when(score < 90, "high").otherwise("critical")
    )
    tier = F.when(critical | complaint | premium, 3).otherwise(base_tier)
    priority = F.when(premium, "critical").when(complaint, "high").when(critical, "critical").otherwise(base_priority)
    confidence = F.when(critical, 0.95).when(score < low, 0.85).when(score < high, 0.80).otherwise(0.90)
    reasons = F.concat(
        "factors",
        F.array_compact(
            F.array(
                F.when(boost, F.lit("🔒 RGPD detected → Force Tier 2+ (+30 pts)")),
                F.when(critical, F.lit("🚨 Critical risk → Force Tier 3")),
                F.when(complaint, F.lit("⚠️ Complaint detected → Force Tier 3")),
                F.when(premium, F.lit("👑 VIC/Ultimate + Very Complex → Premium Tier 3")),
            )
        ),
    )
    fallback = F.when(score < low, 2).when(score < high, 3)
    return scored.withColumns(
        {"tier": tier, "priority": priority, "routing_confidence": confidence, "reasons": reasons, "fallback_tier": fallback}
    ).withColumns(
        {
            "estimated_cost": _by_tier(F.col("tier"), fv.TIER_COSTS),
            "estimated_time_ms": _by_tier(F.col("tier"), fv.TIER_TIMES_MS),
        }
    ).drop("factors")


# --- learned router ---------------------------------------------------------------------

EQUAL_ROWS = 64  # rows of the training set that stand for examples of equal features and label


@dataclass
class TrainedRouter:
    model: PipelineModel
    accuracy: float
    threshold: float


def training_set(feedback: DataFrame) -> DataFrame:
    """(text, label): the actual tier, else the processing tier of a correct routing."""
    label = F.coalesce(
        F.col("actual_tier"), F.when(F.col("routing_correct"), F.coalesce("processing_tier", F.lit(1)))
    )
    return feedback.select(F.col("original_text").alias("text"), label.cast("int").alias("label")).where(
        "label IS NOT NULL"
    )


def confidence_threshold(accuracy: float) -> float:
    for floor, threshold in fv.LEARNED_THRESHOLDS:
        if accuracy > floor:
            return threshold
    return fv.LEARNED_THRESHOLD_DEFAULT


def train_router(examples: DataFrame, text: str = "text", label: str = "label", min_rows: int = 50,
                 trees: int = 100, folds: int = 5, seed: int = 42) -> TrainedRouter | None:
    """Balanced forest over the complexity features; None when there are too few examples.

    ``examples`` may count equal examples in a column ``rows``. Equal texts are read once, and examples
    of equal features and label are ``EQUAL_ROWS`` rows at most that share the weight of all of them; up to
    that number each example is a row of its own. The rows are written once to the shared folder, because every fold reads them.
    """
    from notewell.session import cut_lineage

    number = F.sum("rows") if "rows" in examples.columns else F.count(F.lit(1))
    cores = examples.sparkSession.sparkContext.defaultParallelism
    texts = examples.groupBy(text, label).agg(number.alias("rows")).repartition(4 * cores)
    data = complexity(texts, text).select(*[F.col(c).cast("double") for c in FEATURES], F.col(label).cast("double").alias("label"), "rows")
    equal = data.groupBy(*FEATURES, "label").agg(F.sum("rows").alias("rows"))
    shared = F.least(F.col("rows"), F.lit(EQUAL_ROWS))
    data = equal.select(*FEATURES, "label", (F.col("rows") / shared).alias("rows"), F.explode(F.sequence(F.lit(1), shared.cast("int"))).alias("__nth"))
    data = cut_lineage(data.drop("__nth"), "router-features")
    counts = {r["label"]: r["n"] for r in data.groupBy("label").agg(F.sum("rows").alias("n")).where("label IN (1, 2, 3)").collect()}
    total = sum(counts.values())
    if round(total) < min_rows:
        return None
    weights = {k: total / (len(counts) * n) for k, n in counts.items()}
    weighted = data.where(F.col("label").isin(*counts)).withColumn("weight", _by_tier(F.col("label"), weights) * F.col("rows"))
    pipeline = Pipeline(
        stages=[
            VectorAssembler(inputCols=list(FEATURES), outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
            RandomForestClassifier(
                labelCol="label", featuresCol="features", weightCol="weight", numTrees=trees, seed=seed,
                predictionCol="model_tier", probabilityCol="model_probability", rawPredictionCol="model_raw",
            ),
        ]
    )
    fitted = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=ParamGridBuilder().build(),
        evaluator=MulticlassClassificationEvaluator(labelCol="label", predictionCol="model_tier", metricName="accuracy", weightCol="rows"),
        numFolds=folds,
        seed=seed,
    ).fit(weighted)
    accuracy = float(fitted.avgMetrics[0])
    return TrainedRouter(fitted.bestModel, accuracy, confidence_threshold(accuracy))


def route_ml(df: DataFrame, router: TrainedRouter | None, text: str = "text",
             thresholds: tuple[int, int] = fv.ROUTER_THRESHOLDS) -> DataFrame:
    """Rule routing, replaced by the model where it is sure; a floor keeps critical notes up."""
    routed = route(df, text, thresholds)
    if router is None:
        return routed.withColumn("model_confidence", F.lit(None).cast("double"))
    features = routed.withColumns({c: F.col(c).cast("double") for c in FEATURES})
    scored = router.model.transform(features)
    sure = F.array_max(vector_to_array("model_probability"))
    floor = F.when(
        F.col("priority").isin("high", "critical") | (F.col("tier") >= 3), F.col("tier")
    ).when(F.col("risk_flags") >= 8, 2).otherwise(1)
    chosen = F.when(sure >= router.threshold, F.greatest(F.col("model_tier").cast("int"), floor)).otherwise(F.col("tier"))
    out = scored.withColumns(
        {
            "model_confidence": sure,
            "fallback_tier": F.when(chosen != F.col("tier"), F.col("tier")),
            "routing_confidence": F.when(sure >= router.threshold, sure).otherwise(F.col("routing_confidence")),
            "__tier": chosen,
        }
    ).withColumn("tier", F.col("__tier"))
    return out.withColumns(
        {
            "priority": F.when((F.col("tier") == 3) & (F.col("priority") != "critical"), "high").otherwise(F.col("priority")),
            "estimated_cost": _by_tier(F.col("tier"), fv.TIER_COSTS),
            "estimated_time_ms": _by_tier(F.col("tier"), fv.TIER_TIMES_MS),
            "word_count": F.col("word_count").cast("int"),
        }
    ).drop("raw", "features", "model_raw", "model_probability", "__tier")


def should_escalate(behavior: Column, confidence: Column, priority: Column) -> Column:
    """Critical clients below .90, or high-risk notes below .60."""
    critical = F.coalesce(F.lower(behavior).isin("vic", "ultimate", "platinum"), F.lit(False))
    risky = F.coalesce(F.lower(priority).isin("high", "critical"), F.lit(False))
    conf = F.coalesce(confidence, F.lit(0.0))
    return F.when(critical, (conf < 0.90) | (risky & (conf < 0.60))).otherwise(risky & (conf < 0.60))


def best_tier(results: DataFrame, note_id: str = "note_id", tier: str = "tier") -> DataFrame:
    """The result of the highest tier of every note (combined map-side)."""
    rest = [c for c in results.columns if c != note_id]
    picked = results.groupBy(note_id).agg(F.max_by(F.struct(*rest), F.col(tier)).alias("__r"))
    return picked.select(note_id, *[F.col(f"__r.{c}").alias(c) for c in rest])
