from pyspark.sql import functions as F

from claimsift import session


class _Conf:
    def __init__(self, **values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key.replace(".", "_"), default)


class _Session:
    def __init__(self, **values):
        self.conf = _Conf(**values)


def test_shared_folder_comes_from_the_session():
    assert session.shared_folder(_Session(spark_checkpoint_dir="hdfs://data/ck/")) == "hdfs://data/ck"
    assert session.shared_folder(_Session(spark_sql_warehouse_dir="hdfs://data/warehouse/")) == "hdfs://data/warehouse/shared"


def test_clean_up_takes_the_application_folder(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    session.materialise(spark.range(3), "x")
    assert list(tmp_path.glob("claimsift/*/x-*/part-*"))
    session.clean_up(spark)
    assert not list(tmp_path.glob("claimsift/*"))


def test_materialised_tables_keep_schema_and_know_their_size(spark):
    df = spark.range(100).select("id", F.array(F.lit("x")).alias("a"))
    stored = session.materialise(df, "test")
    assert stored.schema.simpleString() == df.schema.simpleString() and stored.count() == 100
    joined = spark.range(10).join(stored, "id")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_spread_leaves_large_tables_alone(spark, monkeypatch):
    few = session.materialise(spark.range(100).coalesce(1), "few")
    assert session.spread(few, "id").rdd.getNumPartitions() == 8
    monkeypatch.setattr(session, "SPREAD_BYTES", 10)
    assert session.spread(few, "id") is few
