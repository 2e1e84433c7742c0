import json

from pyspark.sql import functions as F

from claimsift import flows
from claimsift.operators.cleaning import claim_profile, clean_claims, dedup_exact, min_support_filter, usable_text
from claimsift.plans.tables import RAW_CLAIMS, STOPS, TAXONOMY, documents, planted
from claimsift.session import new_path
from claimsift.sources.splits import read_split

SF = "/root/testdata/sf0.01"


def _raw(spark):
    return planted(documents(spark, SF), RAW_CLAIMS)


def test_expected_counts_of_the_planted_view(spark):
    raw = _raw(spark)
    usable = usable_text(raw)
    assert raw.count() == 1000 and raw.where("tag IS NOT NULL").count() == 941 and raw.where("claim IS NOT NULL").count() == 857
    assert usable.count() == 819 and usable.select("claim").distinct().count() == 785
    unique = dedup_exact(usable)
    assert unique.count() == 817 and dedup_exact(unique).count() == 817
    profile = claim_profile(raw, TAXONOMY)
    full = clean_claims(raw, TAXONOMY).select(profile.columns)
    assert sorted(map(tuple, profile.collect()), key=str) == sorted(map(tuple, full.collect()), key=str)


def test_support_filter_broadcasts_what_is_small(spark):
    out = min_support_filter(claim_profile(_raw(spark), TAXONOMY))
    out.collect()
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_hot_copies_collapse_before_the_shuffle(spark):
    copies = spark.range(50_000).select(F.col("id").alias("claim_id"), F.lit("t").alias("tag"), F.lit("same text").alias("claim"))
    assert [r["claim_id"] for r in dedup_exact(copies).collect()] == [0]


def test_from_raw_claims_to_report(spark):
    path, out = new_path(spark, "splits"), new_path(spark, "export")
    labelled = _raw(spark).withColumn("tag", F.col("label"))
    flows.make_splits(labelled, path, {}, sample_size=100)
    train, test, sample = (read_split(spark, path, side) for side in ("train", "test", "sample"))
    assert sample.count() == 100 and sample.join(test, "claim_id", "left_semi").count() == 100
    assert train.join(test, "claim_id", "left_semi").count() == 0
    assert test.count() == -(-(train.count() + test.count()) // 5)
    model, trained_on = flows.export_model(spark, path, out, STOPS, full_size=2000)
    assert trained_on == "train" and model.labels == ["de", "en", "es", "fr"]
    report = json.loads(spark.read.text(f"{out}/metrics").first()[0])
    assert report["evaluation_sample_size"] == 100 and report["metrics"]["accuracy"] >= 0.9
    assert set(report["classification_report"]) == {"de", "en", "es", "fr", "macro avg", "weighted avg"}
    assert flows.export_model(spark, path, out, STOPS)[1] == "saved"
    assert flows.export_model(spark, path, new_path(spark, "export"), STOPS, sample_size=50, has_train=False)[1] == "sample"
