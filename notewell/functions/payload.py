"""Functions over the JSON payload that is stored with every note."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notewell import fixed_values as fv
from notewell import schemas
from notewell.functions import lists
from notewell.functions import matching as m
from notewell.session import cut_lineage


def parse_analysis(col: Column, schema: str = schemas.PAYLOAD) -> Column:
    """The payload as a struct; null when the text is missing or malformed.

    ``from_json`` alone would give a struct of nulls for malformed text.
    """
    return F.when(F.try_parse_json(col).isNotNull(), F.from_json(col, schema))


def note_fields(payload: Column) -> dict[str, Column]:
    """The fields that dashboards read, with their fallbacks."""
    extraction = payload["extraction"]
    p1 = extraction["pilier_1_univers_produit"]
    p4 = extraction["pilier_4_action_business"]
    tags = extraction["tags"]
    return {
        "tier": F.coalesce(payload["routing"]["tier"].try_cast("int"), F.lit(1)),
        "confidence": F.coalesce(payload["routing"]["confidence"], F.lit(0.0)),
        "tags": F.when(F.size(tags) > 0, tags).otherwise(m.list_or_empty(p1["categories"])),
        "matched_products": F.coalesce(p1["matched_products"], F.array().cast(f"array<{schemas.MATCHED_PRODUCT}>")),
        "next_action": F.coalesce(p4["next_best_action"]["description"], F.lit("Relance conseiller recommandee.")),
        "contains_sensitive": F.coalesce(payload["rgpd"]["contains_sensitive"], F.lit(False)),
        "processing_time_ms": F.coalesce(payload["processing_time_ms"], F.lit(0.0)),
        "from_cache": F.coalesce(payload["from_cache"], F.lit(False)) | F.coalesce(payload["cache_hit"], F.lit(False)),
    }


def derive_tags(extraction: Column) -> Column:
    """Explicit tags when there are any, else the lists of the record, without case repeats."""
    p1, p2 = extraction["pilier_1_univers_produit"], extraction["pilier_2_profil_client"]
    p3, p4 = extraction["pilier_3_hospitalite_care"], extraction["pilier_4_action_business"]
    explicit = lists.dedup_ci(extraction["tags"])
    singles = F.array_compact(
        F.array(
            p2["purchase_context"]["behavior"],
            p2["purchase_context"]["type"],
            p3["occasion"],
            F.concat(F.lit("action:"), p4["next_best_action"]["action_type"]),
        )
    )
    parts = [
        p1["categories"], p1["produits_mentionnes"], p1["preferences"]["colors"], p1["preferences"]["materials"],
        p3["allergies"]["food"], p3["allergies"]["contact"], p3["diet"],
    ]
    derived = lists.dedup_ci(F.concat(*[m.list_or_empty(p) for p in parts], singles))
    return F.when(F.size(explicit) > 0, explicit).otherwise(derived)


def completeness(record: Column) -> Column:
    """Share of the five groups budget, product, occasion, purchase context, urgency, in percent."""
    p1, p2 = record["pilier_1_univers_produit"], record["pilier_2_profil_client"]
    p3, p4 = record["pilier_3_hospitalite_care"], record["pilier_4_action_business"]

    def filled(col: Column) -> Column:
        return ~m.blank(col)

    checks = [
        (F.coalesce(p4["budget_specific"], F.lit(0)) != 0) | filled(p4["budget_potential"]),
        (F.size(m.list_or_empty(p1["categories"])) > 0) | (F.size(m.list_or_empty(p1["produits_mentionnes"])) > 0),
        filled(p3["occasion"]),
        filled(p2["purchase_context"]["type"]) | filled(p2["purchase_context"]["behavior"]),
        filled(p4["urgency"]),
    ]
    return (sum((c.cast("int") for c in checks), F.lit(0)) * 20).cast("int")


def find_audio_paths(df, json_col: str):
    """(all columns, path, value) rows: leaves named like audio or valued like audio files, at any depth.

    The texts are parsed once. Each level's containers are written to the shared folder and
    opened in the next round; the rounds end when a level has no container.
    """
    keep = [c for c in df.columns if c != json_col]
    level = df.select(*keep, F.try_parse_json(json_col).alias("__v"), F.lit("").alias("__path"))
    audio = "(?:" + "|".join(s.replace(".", r"\.") for s in fv.AUDIO_SUFFIXES) + ")$"
    hits = None
    while True:
        opened = level.lateralJoin(
            df.sparkSession.tvf.variant_explode(F.col("__v").outer()).select(
                F.col("pos").alias("__pos"), F.col("key").alias("__key"), F.col("value").alias("__child")
            )
        )
        step = F.when(
            F.col("__key").isNotNull(),
            F.when(F.col("__path") == "", F.col("__key")).otherwise(F.concat_ws(".", "__path", "__key")),
        ).otherwise(F.concat(F.col("__path"), F.lit("["), F.col("__pos").cast("string"), F.lit("]")))
        kind = F.schema_of_variant("__child")
        leaf = F.when(kind == "STRING", F.try_variant_get("__child", "$", "string"))
        named = m.any_word(F.lower(F.coalesce(F.col("__key"), F.lit(""))), fv.AUDIO_KEYS)
        is_audio = F.col("__key").isNotNull() & (named | F.lower(leaf).rlike(audio))
        container = kind.rlike("^(?:OBJECT|ARRAY)")
        opened = opened.select(*keep, step.alias("__path"), leaf.alias("value"), F.when(container, F.col("__child")).alias("__v"), is_audio.alias("__audio"))
        opened = cut_lineage(opened.where(F.col("__v").isNotNull() | (F.col("value").isNotNull() & F.col("__audio"))), "audio-paths")
        found = opened.where("value IS NOT NULL").select(*keep, F.col("__path").alias("path"), "value")
        hits = found if hits is None else hits.unionAll(found)
        level = opened.where("__v IS NOT NULL").select(*keep, "__v", "__path")
        if level.isEmpty():
            return hits
