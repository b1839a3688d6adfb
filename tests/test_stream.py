"""Streaming admission over files that arrive in two batches."""

import datetime

from foliograph.streaming import ingest

SCHEMA = "doc_id bigint, file_hash string, created_at timestamp_ntz"


def test_each_hash_is_published_once(spark, tmp_path):
    day = lambda n: datetime.datetime(2024, 1, n)
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a", day(1)), (2, "a", day(1)), (3, "b", day(2))], SCHEMA).coalesce(1).write.parquet(inbox)
    stored = str(tmp_path / "stored")
    spark.createDataFrame([(9, "c", day(1))], SCHEMA).write.parquet(stored)

    def run():
        stream = ingest.admit(ingest.arriving(spark, inbox, spark.read.parquet(stored).schema))
        ingest.publish(stream, out, str(tmp_path / "check"), stored).awaitTermination()
        return sorted(r.file_hash for r in spark.read.parquet(f"{out}/epoch=*").collect())

    assert run() == ["a", "b"]
    spark.createDataFrame([(4, "b", day(3)), (5, "c", day(3)), (6, "d", day(3))], SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
    assert run() == ["a", "b", "d"]
