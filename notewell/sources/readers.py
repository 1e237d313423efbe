"""Readers: notes, catalogues, lexicons, quarantined rows, newest result file."""

from __future__ import annotations

import os
import re
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewell import schemas
from notewell.functions import matching as m

NOTE_ALIASES = {"note": "Transcription", "text": "Transcription", "note_text": "Transcription", "content": "Transcription",
                "transcription": "Transcription", "id": "ID", "language": "Language"}
CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"'}
LEXICON_LANGUAGES = ("fr", "en", "it", "es", "de")


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with a header, every column as text (types are applied by the operators)."""
    return spark.read.options(**CSV_OPTIONS).csv(path)


def standard_notes(df: DataFrame, default_language: str = "FR") -> DataFrame:
    """Column names stripped and aliased; missing language and ids filled in."""
    renamed: dict[str, str] = {}
    for name in df.columns:
        clean = name.strip()
        target = NOTE_ALIASES.get(clean.lower(), clean)
        renamed[name] = target if target not in renamed.values() else clean
    df = df.toDF(*[renamed[c] for c in df.columns])
    language = F.col("Language") if "Language" in df.columns else F.lit(None).cast("string")
    df = df.withColumn("Language", F.when(m.blank(language), F.lit(default_language)).otherwise(F.upper(F.trim(language))))
    generated = F.concat(F.lit("NOTE_"), F.monotonically_increasing_id().cast("string"))
    given = F.col("ID").cast("string") if "ID" in df.columns else F.lit(None).cast("string")
    return df.withColumn("ID", F.when(m.blank(given), generated).otherwise(given))


def read_notes(spark: SparkSession, path: str | list[str], default_language: str = "FR") -> DataFrame:
    return standard_notes(read_csv(spark, path), default_language)


def pick(df: DataFrame, *names: str) -> Column:
    """First non-blank of the alternatives that the table has, matched without case."""
    by_lower = {c.lower(): c for c in df.columns}
    present = [F.col(by_lower[n]).cast("string") for n in names if n in by_lower]
    usable = [F.when(~m.blank(c) & (F.lower(F.trim(c)) != "nan"), F.trim(c)) for c in present]
    return F.coalesce(*usable) if usable else F.lit(None).cast("string")


def standard_products(df: DataFrame) -> DataFrame:
    return df.select(
        pick(df, "sku", "product_code").alias("sku"),
        F.coalesce(pick(df, "title", "name", "product_name", "model", "description"), F.lit("Unknown Product")).alias("name"),
        F.coalesce(pick(df, "itemurl", "url"), F.lit("")).alias("url"),
        F.coalesce(pick(df, "imageurl", "image_url"), F.lit("")).alias("image_url"),
        F.coalesce(pick(df, "price_eur", "price").try_cast("double"), F.lit(0.0)).alias("price_eur"),
        F.coalesce(pick(df, "category1_code", "category1", "category", "categorie", "universe", "department", "line", "product_type"), F.lit("unknown")).alias("category1"),
        pick(df, "category2_code", "category2").alias("category2"),
        pick(df, "category3_code", "category3").alias("category3"),
        F.coalesce(F.lower(pick(df, "flg_discount", "is_discount")).isin("1", "true"), F.lit(False)).alias("is_discount"),
        F.coalesce(pick(df, "stock").try_cast("int"), F.lit(10)).alias("stock"),
        F.coalesce(pick(df, "description"), F.lit("")).alias("description"),
        F.coalesce(pick(df, "color"), F.lit("")).alias("color"),
        F.coalesce(pick(df, "material"), F.lit("")).alias("material"),
    )


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue from CSV, JSON or Parquet, by file suffix."""
    if path.endswith(".csv"):
        raw = read_csv(spark, path)
    elif path.endswith((".json", ".jsonl")):
        raw = spark.read.option("multiLine", path.endswith(".json")).json(path)
    else:
        raw = spark.read.parquet(path)
    return standard_products(raw)


def read_latest(spark: SparkSession, folder: str, fmt: str = "csv", pattern: str | None = None) -> DataFrame:
    """All rows of the newest output below ``folder``: a file, or a folder of part files read as a whole.

    An output is as new as its newest file; of equally new ones the last by name is taken.
    Only file metadata decides.
    """
    reader = spark.read.options(**CSV_OPTIONS) if fmt == "csv" else spark.read
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        files = files.option("pathGlobFilter", pattern)
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    root = re.sub(scheme, "", folder).rstrip("/")
    root = root if root.startswith("/") else os.path.abspath(root)
    below = F.substring(F.regexp_replace("path", scheme, ""), F.lit(len(root) + 2), F.lit(1 << 20))
    outputs = files.load(folder).select(F.substring_index(below, "/", 1).alias("output"), "modificationTime").groupBy("output").agg(F.max("modificationTime").alias("at"))
    newest = outputs.orderBy(F.col("at").desc(), F.col("output").desc()).limit(1).collect()
    if not newest:
        raise FileNotFoundError(folder)
    return reader.option("recursiveFileLookup", "true").format(fmt).load(f"{folder.rstrip('/')}/{newest[0]['output']}")


def unpivot_lexicon(df: DataFrame) -> DataFrame:
    """(tag, category, language, keyword) from the wide lexicon with comma lists per language."""
    lists = F.array(
        *[
            F.struct(F.lit(lang.upper()).alias("language"), F.col(f"keywords_{lang}").alias("words"))
            for lang in LEXICON_LANGUAGES
            if f"keywords_{lang}" in df.columns
        ]
    )
    return (
        df.select(F.col("tag_name").alias("tag"), "category", F.inline(lists))
        .select("tag", "category", "language", F.explode(F.split(F.coalesce("words", F.lit("")), ",")).alias("keyword"))
        .withColumn("keyword", F.lower(F.trim("keyword")))
        .where("keyword != ''")
    )


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return unpivot_lexicon(read_csv(spark, path))


def read_taxonomy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(core tags ``(category, tag)``, keywords ``(tag, keyword)``) of a taxonomy JSON file."""
    raw = spark.read.text(path, wholetext=True)
    lists = "map<string,array<string>>"
    doc = raw.select(F.from_json("value", f"core_tags {lists}, product_keywords {lists}").alias("d"))
    core = doc.select(F.explode("d.core_tags").alias("category", "tags")).select("category", F.explode("tags").alias("tag"))
    words = doc.select(F.explode("d.product_keywords").alias("tag", "keywords")).select("tag", F.explode("keywords").alias("keyword"))
    return core, words


def keyword_dictionary(text: str) -> dict[str, list[str]]:
    """The ``product_keywords`` of taxonomy JSON text, for an inline pack."""
    return json.loads(text).get("product_keywords", {})


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Labelled notes: ``none`` becomes an empty list, comma lists become arrays."""
    raw = read_csv(spark, path)

    def listed(name: str) -> Column:
        clean = F.lower(F.trim(F.col(name)))
        parts = F.transform(F.split(clean, ","), lambda v: F.trim(v))
        return F.when(F.coalesce(clean, F.lit("none")).isin("none", ""), m.empty_strings()).otherwise(parts)

    columns = {c: listed(c) for c in ("expected_tags", "expected_allergies", "expected_relations", "expected_dietary") if c in raw.columns}
    if "expected_allergies" in columns:
        columns["expected_allergies"] = F.transform(columns["expected_allergies"], lambda a: F.regexp_replace(a, "_allergy|_intolerance", ""))
    return raw.withColumns(columns)


def read_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Daily JSON-lines files of failed notes."""
    return spark.read.schema(schemas.QUARANTINE).option("recursiveFileLookup", "true").json(folder)
