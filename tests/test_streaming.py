from factloom.sources.store import FactStore
from factloom.streaming.ingest import ingest, windowed_counts


def test_ingest_and_rerun(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("[['a_b','p','o'],['c','p','d']]\ngarbage\n")
    store = FactStore(spark, str(tmp_path / "store"))
    ingest(spark, str(folder), store, str(tmp_path / "ck")).awaitTermination()
    assert store.size() == 2
    (folder / "b.txt").write_text("[['a b','p','o'],['e','p','f']]\n")
    ingest(spark, str(folder), store, str(tmp_path / "ck")).awaitTermination()
    assert store.size() == 3


def test_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:01:00", "x"), ("2024-01-01 00:04:59", "x"), ("2024-01-01 00:05:00", "y")], "t string, event_type string").selectExpr("timestamp(t) as ts", "event_type")
    assert sorted(r.n for r in windowed_counts(df).collect()) == [1, 2]
