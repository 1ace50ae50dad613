from pyspark.sql import functions as F

from loomgraph.sources.repository import append_note, read_notes
from loomgraph.streaming import changes


def test_replays_do_no_harm(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "path string, sha string, ts timestamp"
    rows = spark.createDataFrame([("a", "1", "2024-01-01 00:00:00"), ("a", "2", "2024-01-01 00:00:01"), ("b", "3", "2024-01-01 00:00:00")], "path string, sha string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(source)
    spark.createDataFrame([("a", "0", None), ("c", "9", None)], schema).write.parquet(table)

    def write(df):
        kept = df.collect()
        spark.createDataFrame(kept, schema).write.mode("overwrite").parquet(table)

    for run in ("one", "two"):
        stream = spark.readStream.schema(schema).parquet(source)
        changes.apply_changes(stream, lambda: spark.read.parquet(table), write, "path", "ts", str(tmp_path / run)).awaitTermination()
        assert sorted((r.path, r.sha) for r in spark.read.parquet(table).collect()) == [("a", "2"), ("b", "3"), ("c", "9")]


def test_counts_and_windows(spark, tmp_path, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    source = str(tmp_path / "events")
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))
    query = changes.churn_windows(stream).writeStream.format("memory").queryName("windows").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()


def test_notes(spark, tmp_path):
    path = str(tmp_path / "notes.md")
    append_note(path, "2024-01-01 10:00 UTC", "idea", "first\nline")
    append_note(path, "2024-01-02 10:00 UTC", "bug", "second")
    assert [(r.category, r.body) for r in read_notes(spark, path).collect()] == [("bug", "second"), ("idea", "first\nline")]
