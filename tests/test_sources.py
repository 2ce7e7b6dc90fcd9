"""Readers, writers and streams."""

import sqlite3
import zipfile

from pyspark.sql import functions as F

from strataql import sources, streaming


def test_csv_and_outputs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n2,\n")
    df = sources.read_csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.collect()] == [(1, "x"), (2, None)]
    for mode in ("json", "csv", "line"):
        sources.write_output(df, str(tmp_path / mode), mode)
        assert list((tmp_path / mode).glob("part-*"))


def test_folder_and_zip(spark, tmp_path):
    sources.register_sources(spark)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_text("hello")
    names = {r["name"]: r["size"] for r in spark.read.format("folder").option("path", str(tmp_path)).load().collect()}
    assert names[str(tmp_path / "d" / "x.txt")] == 5
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a", b"one")
        z.writestr("b/c", b"two!")
    got = spark.read.format("zipfile").option("path", str(tmp_path / "z.zip")).load().collect()
    assert sorted((r["name"], bytes(r["data"])) for r in got) == [("a", b"one"), ("b/c", b"two!")]
    assert sources.read_folder(spark, str(tmp_path), "*.txt").first()["size"] == 5


def test_sqlite_round_trip(spark, tmp_path):
    sources.register_sources(spark)
    path = str(tmp_path / "f.db")
    df = spark.createDataFrame([(i, f"n{i}", i / 2, None) for i in range(50)], "k bigint, s string, r double, z bigint")
    sources.write_sqlite(df, path, "t")
    back = spark.read.format("sqlite").options(path=path, table="t", parts="3").load()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert back.filter("k > 46").count() == 3
    with sqlite3.connect(path) as db:
        assert db.execute("SELECT sum(k) FROM t").fetchone() == (1225,)


def test_windows_run_on_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    aggregates = [F.count("*").alias("n")]
    query = streaming.windowed(stream, "ts", "1 day", aggregates, keys=["event_type"]).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = streaming.windowed(events, "ts", "1 day", aggregates, keys=["event_type"])
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, batch.collect()))
