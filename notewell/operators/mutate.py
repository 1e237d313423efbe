"""Table mutation as DataFrame-to-DataFrame operators; the caller writes the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewell import fixed_values as fv
from notewell.functions import lists
from notewell.functions import matching as m
from notewell.operators import joins, paging


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key, the one with the largest ``order``; combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def product_rows(raw: DataFrame) -> DataFrame:
    """Import rows with alternative column names folded and bad numbers replaced; adds ``error``."""
    def pick(*names: str) -> Column:
        present = [F.trim(F.col(n).cast("string")) for n in names if n in raw.columns]
        return F.coalesce(*present) if present else F.lit(None).cast("string")

    rows = raw.select(
        pick("sku", "product_code").alias("sku"),
        pick("title", "name").alias("name"),
        F.coalesce(pick("itemurl", "url"), F.lit("")).alias("url"),
        F.coalesce(pick("imageurl", "image_url"), F.lit("")).alias("image_url"),
        F.coalesce(pick("price_eur", "price").try_cast("double"), F.lit(0.0)).alias("price_eur"),
        F.coalesce(pick("category1_code", "category1"), F.lit("")).alias("category1"),
        F.coalesce(pick("category2_code", "category2"), F.lit("")).alias("category2"),
        F.coalesce(pick("category3_code", "category3"), F.lit("")).alias("category3"),
        F.coalesce(pick("flg_discount", "is_discount").isin("1", "true", "True"), F.lit(False)).alias("is_discount"),
        F.coalesce(pick("stock").try_cast("int"), F.lit(10)).alias("stock"),
    )
    error = F.when(m.blank(F.col("sku")), F.lit("missing_sku")).when(m.blank(F.col("name")), F.lit("missing_name"))
    return rows.withColumn("error", error)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``source`` replace or extend ``target``; adds ``change`` = inserted, updated or kept.

    ``source`` holds one row per key (see :func:`latest_per_key`).
    """
    keys = list(keys)
    fields = [c for c in target.columns if c not in keys]
    t = target.select(*keys, F.struct(*fields).alias("__t"))
    s = source.select(*keys, F.struct(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in fields]).alias("__s"))
    joined = t.join(s, keys, "full_outer")
    change = (
        F.when(F.col("__t").isNull(), "inserted").when(F.col("__s").isNotNull(), "updated").otherwise("kept")
    )
    return joined.select(
        *keys,
        *[F.when(F.col("__s").isNotNull(), F.col(f"__s.{c}")).otherwise(F.col(f"__t.{c}")).alias(c) for c in fields],
        change.alias("change"),
    )


def upsert_products(target: DataFrame, raw: DataFrame, order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(new table with ``change``, rejected rows). The last row of a repeated sku wins when ``order`` is given."""
    checked = product_rows(raw)
    good = checked.where("error IS NULL").drop("error")
    if order is None:
        order = F.struct(*[F.col(c) for c in good.columns if c != "sku"])
    return upsert(target, latest_per_key(good, ["sku"], order), ["sku"]), checked.where("error IS NOT NULL")


def change_counts(changed: DataFrame) -> DataFrame:
    return changed.agg(
        F.count_if(F.col("change") == "inserted").alias("imported"),
        F.count_if(F.col("change") == "updated").alias("updated"),
    )


def adjust_stock(products: DataFrame, deltas: DataFrame, sku: str = "sku") -> DataFrame:
    """``stock`` plus the summed deltas; a result below zero keeps the stock and sets ``rejected``."""
    summed = deltas.groupBy(sku).agg(F.sum("delta").alias("__delta"))
    new = F.col("stock") + F.coalesce("__delta", F.lit(0))
    return (
        products.join(summed, sku, "left")
        .withColumn("rejected", new < 0)
        .withColumn("stock", F.when(new < 0, F.col("stock")).otherwise(new))
        .drop("__delta")
    )


def set_stock(products: DataFrame, values: DataFrame, sku: str = "sku") -> DataFrame:
    given = values.select(sku, F.col("stock").alias("__new"))
    bad = F.coalesce(F.col("__new") < 0, F.lit(False))
    return (
        products.join(given, sku, "left")
        .withColumn("rejected", bad)
        .withColumn("stock", F.when(bad | F.col("__new").isNull(), F.col("stock")).otherwise(F.col("__new")))
        .drop("__new")
    )


def delete_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_anti")


def upsert_vectors(collection: DataFrame, docs: DataFrame, id_col: str = "id") -> DataFrame:
    """New vectors and fields replace old ones; fields that a document leaves null are kept."""
    fields = [c for c in collection.columns if c != id_col]
    t = collection.select(id_col, *[F.col(c).alias(f"__t_{c}") for c in fields])
    s = docs.select(id_col, *[F.col(c).alias(f"__s_{c}") for c in fields if c in docs.columns])
    joined = t.join(s, id_col, "full_outer")
    return joined.select(
        id_col,
        *[F.coalesce(f"__s_{c}", f"__t_{c}").alias(c) if c in docs.columns else F.col(f"__t_{c}").alias(c) for c in fields],
    )


def check_actions(updates: DataFrame) -> DataFrame:
    """Normalises the enums and names the first broken rule in ``error``."""
    kind, status = F.lower(F.trim("action_type")), F.lower(F.trim("status"))
    return updates.withColumns({"action_type": kind, "status": status}).withColumn(
        "error",
        F.when(~F.coalesce(F.col("action_type").isin(*fv.ACTION_TYPES), F.lit(False)), F.lit("invalid_action_type"))
        .when(~F.coalesce(F.col("status").isin(*fv.ACTION_STATUSES), F.lit(False)), F.lit("invalid_status")),
    )


def upsert_actions(actions: DataFrame, updates: DataFrame, notes: DataFrame, note_id: str = "id") -> DataFrame:
    """One row per note: the newest valid update of an existing note wins, ``created_at`` survives."""
    valid = check_actions(updates).where("error IS NULL").drop("error")
    valid = valid.join(notes.select(F.col(note_id).alias("note_id")), "note_id", "left_semi")
    newest = latest_per_key(valid, ["note_id"], F.col("updated_at"))
    old_created = actions.select("note_id", F.col("created_at").alias("__created"))
    newest = (
        newest.join(old_created, "note_id", "left")
        .withColumn("created_at", F.coalesce("__created", "updated_at"))
        .drop("__created")
    )
    return upsert(actions, newest.select(*actions.columns), ["note_id"])


def delete_notes(notes: DataFrame, actions: DataFrame, users: DataFrame, ids: DataFrame,
                 adjust_points: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, actions, users) after removing notes; their points leave the advisor's score, floor 0."""
    gone = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    points = notes.join(gone, "id", "left_semi").groupBy(F.col("advisor_id").alias("id")).agg(
        F.sum(F.greatest(F.coalesce("points_awarded", F.lit(0)), F.lit(0))).alias("__removed")
    )
    left_users = users
    if adjust_points:
        left_users = (
            users.join(points, "id", "left")
            .withColumn("score", F.greatest(F.lit(0), F.coalesce("score", F.lit(0)) - F.coalesce("__removed", F.lit(0))))
            .drop("__removed")
        )
    gone_actions = gone.select(F.col("id").alias("note_id"))
    return notes.join(gone, "id", "left_anti"), actions.join(gone_actions, "note_id", "left_anti"), left_users


def reset_points(users: DataFrame, role: str | None = None) -> DataFrame:
    """Scores to zero (for one role); ``reset`` marks the rows that changed."""
    target = F.lit(True) if role is None else F.coalesce(F.col("role") == role, F.lit(False))
    changed = target & (F.coalesce("score", F.lit(0)) != 0)
    return users.withColumn("reset", changed).withColumn(
        "score", F.when(target, F.lit(0)).otherwise(F.col("score"))
    )


def category_of(behavior: Column, current: Column) -> Column:
    low = F.lower(behavior)
    return F.when(low.isin("vic", "platinum"), "VIC").when(low == "ultimate", "Ultimate").otherwise(
        F.coalesce(current, F.lit("Regular"))
    )


def upsert_clients(clients: DataFrame, notes: DataFrame) -> DataFrame:
    """Clients after a batch of notes ``(client_ref, client_name, sentiment, behavior, ts)``.

    A note with a reference belongs to that external id; one with only a name belongs to the
    first client whose name contains it; the rest found new clients (one per reference or
    name), whose ids follow each other above the largest id in use, in the order of reference or name.
    Clients and batch meet by sorting: a small file of clients may hold more rows than a driver can send out.
    The mean sentiment is updated incrementally; ``days_since_contact`` is the gap to the previous contact.
    """
    by_ref = notes.where(F.col("client_ref").isNotNull())
    by_name = notes.where(F.col("client_ref").isNull() & F.col("client_name").isNotNull())
    found = joins.contains_join(by_name, clients, "client_name", "name", "id")
    known = clients.select(F.col("external_client_id").alias("client_ref"), F.col("id"))
    matched = by_ref.join(known.hint("merge"), "client_ref", "left").select(
        "id", F.concat(F.lit("ref:"), "client_ref").alias("__new"), "client_ref", "client_name", "sentiment", "behavior", "ts"
    ).unionByName(
        by_name.withColumn("__low", F.lower("client_name"))
        .join(found.withColumnRenamed("client_name", "__low").hint("merge"), "__low", "left")
        .select("id", F.concat(F.lit("name:"), "__low").alias("__new"), "client_ref", "client_name", "sentiment", "behavior", "ts")
    )
    key = F.coalesce(F.col("id").cast("string"), F.col("__new"))
    batch = matched.withColumn("__key", key).groupBy("__key").agg(
        F.max("id").alias("__id"),
        F.max("__new").alias("__new"),
        F.max("client_ref").alias("__ref"),
        F.min_by("client_name", "ts").alias("__name"),
        F.sum("sentiment").alias("__sum"),
        F.count("*").alias("__n"),
        F.max("ts").alias("__last"),
        F.max_by(F.when(F.lower("behavior").isin("vic", "ultimate", "platinum"), F.lower("behavior")),
                 F.when(F.lower("behavior").isin("vic", "ultimate", "platinum"), F.col("ts"))).alias("__behavior"),
    )
    largest = clients.select(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).scalar()
    ranked = paging.numbered(batch.where("__id IS NULL"), [F.col("__new")], "__nth")[0].drop("__range")
    founded = ranked.withColumn("id", largest + F.col("__nth")).withColumn("__founded", F.lit(True)).drop("__nth")
    joined = clients.join(batch.withColumnRenamed("__id", "id").where("id IS NOT NULL").hint("merge"), "id", "left").unionByName(founded.drop("__id"), allowMissingColumns=True)
    n0 = F.coalesce("total_interactions", F.lit(0))
    mean0 = F.coalesce("sentiment_score", F.lit(0.0))
    touched = F.col("__n").isNotNull()
    return joined.select(
        "id",
        F.coalesce("name", "__name", F.lit("Client inconnu")).alias("name"),
        F.coalesce("external_client_id", F.when(F.col("__founded"), F.col("__ref"))).alias("external_client_id"),
        category_of(F.col("__behavior"), F.col("category")).alias("category"),
        F.coalesce(F.upper("__behavior"), "vic_status", F.lit("Standard")).alias("vic_status"),
        F.when(touched, (mean0 * n0 + F.col("__sum")) / (n0 + F.col("__n"))).otherwise(F.col("sentiment_score")).alias("sentiment_score"),
        F.when(touched, n0 + F.col("__n")).otherwise(F.col("total_interactions")).alias("total_interactions"),
        F.when(touched, F.datediff("__last", "last_contact_date")).otherwise(F.col("days_since_contact")).alias("days_since_contact"),
        F.coalesce("__last", "last_contact_date").alias("last_contact_date"),
    )


def ingest_feedback(df: DataFrame) -> DataFrame:
    """Feedback rows as stored: JSON columns, exact match and the derived routing verdict."""
    return df.select(
        "*",
        (F.col("predicted_tags") == F.col("corrected_tags")).alias("was_correct"),
        F.to_json("predicted_tags").alias("predicted_tags_json"),
        F.to_json("corrected_tags").alias("corrected_tags_json"),
        F.when(F.col("actual_tier").isNotNull(), F.col("actual_tier") == F.col("processing_tier")).alias("derived_routing"),
    ).withColumn("routing_correct", F.coalesce("routing_correct", "derived_routing")).drop("derived_routing")
