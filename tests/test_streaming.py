import json

from tessera.streaming.ingest import stream_units, windowed_counts


def test_documents_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"id": "d", "title": "T", "text": "hello", "seq": 0}))
    stream_units(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["hello"]


def test_windows(spark):
    e = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 2.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 4.0D")
    assert [(r["n"], r["mean_value"]) for r in windowed_counts(e).collect()] == [(2, 3.0)]
