import json

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from notewell import session
from notewell.operators import quality
from notewell.plans import extract, route
from notewell.functions import text
from notewell.sources import readers, writers
from notewell.streaming import streams


def test_notes_csv_with_odd_headers(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text('ID , Note_Text,Language\n1,"Elle dit ""oui"", donc\nsuite",\n,autre,en\n', encoding="utf-8")
    rows = {r["Transcription"]: r for r in readers.read_notes(spark, str(path)).collect()}
    assert rows['Elle dit "oui", donc\nsuite'].Language == "FR" and rows["autre"].ID.startswith("NOTE_") and rows["autre"].Language == "EN"


def test_result_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], {"x": 1.0})], "id int, tags array<string>, m map<string,double>")
    writers.write_results(df, str(tmp_path / "c"), "csv")
    row = readers.read_csv(spark, str(tmp_path / "c")).first()
    assert row.tags == "a, b" and json.loads(row.m) == {"x": 1.0}
    with pytest.raises(ValueError):
        writers.write_results(df, str(tmp_path / "d"), "xlsx")


def test_flatten_metrics(spark):
    df = spark.sql("SELECT named_struct('b', 1, 'c', array('x', 'y')) AS a, 2.5D AS d")
    assert {r["metric"]: r["value"] for r in writers.flatten_metrics(df).collect()} == {"a.b": "1", "a.c": "x; y", "d": "2.5"}


def test_taxonomy_lexicon_and_truth(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"version": "1", "core_tags": {"products": ["bags", "belts"]}, "product_keywords": {"bags": ["sac", "bag"]}}))
    core, words = readers.read_taxonomy(spark, str(tmp_path / "t.json"))
    assert core.count() == 2 and {r["keyword"] for r in words.collect()} == {"sac", "bag"}
    (tmp_path / "l.csv").write_text('tag_id,tag_name,category,keywords_fr,keywords_en\n1,bags,p,"sac, Pochette",\n')
    assert {(r["language"], r["keyword"]) for r in readers.read_lexicon(spark, str(tmp_path / "l.csv")).collect()} == {("FR", "sac"), ("FR", "pochette")}
    (tmp_path / "g.csv").write_text('id,text,expected_tags,expected_allergies\n1,x,"Bags, belts",nut_allergy\n2,y,none,none\n')
    truth = {r["id"]: r for r in readers.read_ground_truth(spark, str(tmp_path / "g.csv")).collect()}
    assert truth["1"].expected_tags == ["bags", "belts"] and truth["1"].expected_allergies == ["nut"] and truth["2"].expected_tags == []


def test_quarantine_files(spark, tmp_path):
    bad = spark.createDataFrame([("n1", "texte", "boom")], "note_id string, note_text string, error string")
    writers.write_quarantine(bad, str(tmp_path / "q"), F.lit("2024-01-02 03:04:05"))
    row = readers.read_quarantine(spark, str(tmp_path / "q")).first()
    assert row.error == "boom" and row.requires_manual_review and row.retry_count == 0
    writers.export_quarantine(readers.read_quarantine(spark, str(tmp_path / "q")), str(tmp_path / "e"))
    assert readers.read_csv(spark, str(tmp_path / "e")).columns == list(writers.QUARANTINE_EXPORT)


def test_catalogue_columns(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"sku": "a", "name": "Sac", "price_eur": 10, "category": "bags"}, {"sku": "b", "name": "nan", "description": "Étui"}]))
    rows = {r["sku"]: r for r in readers.read_products(spark, str(tmp_path / "c.json")).collect()}
    assert rows["a"].category1 == "bags" and rows["a"].stock == 10 and rows["b"].name == "Étui" and rows["b"].price_eur == 0.0


class Cluster:
    """A session as seen on a cluster."""

    def __init__(self, folder):
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: folder or default)})
        self.sparkContext = type("Context", (), {"master": "yarn"})


def test_shared_folder_follows_the_session():
    assert session.shared_folder(Cluster("hdfs://shared/x/"), "t").startswith("hdfs://shared/x/t-")
    with pytest.raises(ValueError):
        session.shared_folder(Cluster(None), "t")


NOTES = [(i, n, "FR") for i, n in enumerate(["Client VIP cherche une montre, urgent.", "Euh elle veut un sac.", "Plainte du client, retard.", "Cadeau pour sa femme, budget 5k"])]
SCHEMA = "id int, text string, lang string"


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    for i, row in enumerate(NOTES):
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.note_stream(spark, str(tmp_path / "in"), SCHEMA, files_per_trigger=1)
    columns = ["id", "cleaned", "tier", "complexity"]
    got = streams.run_available(streams.enrich_stream(stream).select(*columns), "t-enrich").orderBy("id").collect()
    batch = route.route(extract.extract_note(text.clean_text(spark.createDataFrame(NOTES, SCHEMA)), "cleaned"), "cleaned")
    assert got == batch.select(*columns).orderBy("id").collect()


def test_repeated_texts_within_the_ttl(spark, tmp_path):
    rows = [("Bonjour !", "2024-01-01 10:00:00"), ("bonjour", "2024-01-01 12:00:00"), ("autre", "2024-01-01 11:00:00")]
    spark.createDataFrame(rows, "text string, t string").select("text", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = streams.run_available(streams.dedup_stream(streams.note_stream(spark, str(tmp_path / "in"), "text string, ts timestamp")), "t-dedup")
    assert out.count() == 2


def test_bad_rows_go_to_quarantine(spark, tmp_path):
    spark.createDataFrame([(1, "ok ok ok", "2024-01-01"), (2, "x", "2024-01-01")], "id int, original_text string, d string").select(
        "id", "original_text", F.col("d").cast("timestamp").alias("timestamp")
    ).write.parquet(str(tmp_path / "in"))
    stream = streams.note_stream(spark, str(tmp_path / "in"), "id int, original_text string, timestamp timestamp")
    streams.warehouse_sink(
        stream, str(tmp_path / "w"), str(tmp_path / "q"), str(tmp_path / "c"), rules=lambda: {"length": F.length("original_text") > 3}, to_rows=lambda good: good,
    ).awaitTermination()
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "w")).collect()] == [1]
    row = readers.read_quarantine(spark, str(tmp_path / "q")).first()
    assert row.note_id == "2" and row.error == "length"


def test_cleaning_report_counts(spark):
    rows = [(1, "Euh elle veut un sac", "FR"), (2, "Euh elle veut un sac", "FR"), (3, "  ", "FR"), (None, None, None), (4, "mail a@b.fr", "EN")]
    df = spark.createDataFrame(rows, SCHEMA)
    cleaned = quality.cleaned_rows(df)
    row = quality.cleaning_report(df, cleaned).first()
    assert (row.original_rows, row.empty_rows_removed, row.duplicates_removed, row.final_rows, row.reduction_percent) == (5, 2, 1, 2, 60.0)
    assert row.fillers_removed == 2
    kept = quality.clean_dataset(df)
    assert sorted(r["id"] for r in kept.collect()) == [1, 4] and kept.columns == cleaned.columns


def test_stream_queries_read_tables_of_several_files(spark, tmp_path):
    spark.range(6).selectExpr("id AS doc_id", "'Client VIP, urgent.' AS text", "'fr' AS lang", "'s' AS source", "19L AS n_chars").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert tuple(queries()["stream_enrich"](spark, str(tmp_path)).first()) == (6, 6)
