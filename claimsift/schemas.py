"""Declared schemas of every table the library reads or writes."""

from pyspark.sql import types as T

RAW_CLAIMS = T.StructType([
    T.StructField("claim_id", T.LongType(), False),
    T.StructField("date_received", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("claim", T.StringType()),
    T.StructField("company", T.StringType()),
])

SPLIT = T.StructType([
    T.StructField("claim_id", T.LongType()),
    T.StructField("claim", T.StringType()),
    T.StructField("tag_clean", T.StringType()),
    T.StructField("in_sample", T.BooleanType()),
    T.StructField("split", T.StringType()),
])

PREDICTIONS = T.StructType([
    T.StructField("claim_id", T.LongType()),
    T.StructField("tag_clean", T.StringType()),
    T.StructField("prediction_raw", T.StringType()),
    T.StructField("latency_sec", T.DoubleType()),
    T.StructField("prediction", T.StringType()),
])

COMPARISON = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("acc_sample", T.DoubleType()),
    T.StructField("f1_sample", T.DoubleType()),
    T.StructField("acc_full", T.DoubleType()),
    T.StructField("f1_full", T.DoubleType()),
    T.StructField("train_s", T.DoubleType()),
    T.StructField("ms_per_claim", T.DoubleType()),
])

SEED_RECORDS = T.StructType([
    T.StructField("content", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("_expected_tag", T.StringType()),
])

CLAIMS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("tag", T.StringType()),
])

EXTERNAL_ANSWERS = T.StructType([
    T.StructField("claim_id", T.LongType()),
    T.StructField("prediction_raw", T.StringType()),
    T.StructField("latency_sec", T.DoubleType()),
    T.StructField("attempts", T.IntegerType()),
])
