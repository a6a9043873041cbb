import gzip
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from kelpwright.operators.history import prior_histories
from kelpwright.sources import readers, sinks
from kelpwright.streaming import events as stream


def test_delimited_latin1(spark, tmp_path):
    (tmp_path / "ratings.dat").write_text("1::10::5::100\n1::20::4::200\n2::10::3::300\n")
    (tmp_path / "movies.dat").write_bytes("10::Alphä (2000)::Drama|Romance\n20::Beta (2001)::Comedy\n".encode("latin-1"))
    r, m = readers.ratings_and_movies(spark, str(tmp_path))
    assert r.count() == 3 and dict(r.dtypes)["rating"] == "float"
    assert m.where("movie_id = 10").first()["title"] == "Alphä (2000)"


def test_csv_row_numbers_and_tar(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"log_{n}.csv").write_text("user_id,video_id,x\n1,2,9\n3,4,9\n")
    rows = readers.csv_with_row_number(spark, str(tmp_path / "*.csv"), "user_id long, video_id long")
    assert sorted(r.request_id for r in rows.collect()) == ["log_a.csv:0", "log_a.csv:1", "log_b.csv:0", "log_b.csv:1"]
    with tarfile.open(tmp_path / "all.tar.gz", "w:gz") as tar:
        tar.add(tmp_path / "log_a.csv", "d/log_standard_a.csv")
        tar.add(tmp_path / "log_b.csv", "d/other_b.csv")
    got = readers.csv_in_tar(spark, str(tmp_path / "all.tar.gz"), "user_id long, video_id long", "log_standard_")
    assert [(r.member, r.user_id) for r in got.collect()] == [("d/log_standard_a.csv", 1), ("d/log_standard_a.csv", 3)]
    assert readers.csv(spark, str(tmp_path / "log_a.csv"), "user_id long, video_id long, x int", ["x"]).columns == ["x"]


def test_json_lines_gzip_fail_fast(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write('{"a": 1}\n{"a": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "a.json.gz"), "a int").count() == 2
    (tmp_path / "bad.json").write_text('{"a": 1}\n{oops\n')
    with pytest.raises(Exception, match=r"(?i)malformed|failfast"):
        readers.json_lines(spark, str(tmp_path / "bad.json"), "a int").collect()


def test_parquet_pushdown_sinks_and_bundle(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("split"))
    path = str(tmp_path / "t")
    sinks.write_parquet(df, path, row_group_rows=100, partition_by="split")
    sinks.write_parquet(df.where("id < 10"), path, partition_by="split")
    assert spark.read.parquet(path).count() == 10
    plan = readers.parquet(spark, path, ["id"], "id > 5")._jdf.queryExecution().toString()
    assert "GreaterThan(id,5)" in plan and "ReadSchema: struct<id:bigint>" in plan
    manifest = spark.createDataFrame(sinks.checksums(spark, path).collect())
    assert sinks.verify_bundle(spark, path, manifest).collect() == []
    broken = manifest.withColumn("sha256", F.when(F.col("file") == manifest.first()["file"], "x").otherwise(F.col("sha256")))
    assert [r.fault for r in sinks.verify_bundle(spark, path, broken).collect()] == ["changed"]
    sinks.verify_file(b"abc", md5="900150983cd24fb0d6963f7d28e17f72")
    with pytest.raises(ValueError):
        sinks.verify_file(b"abc", md5="0")


def test_json_csv_reports(spark, tmp_path):
    df = spark.createDataFrame([(2, None, "x")], "b int, a string, c string")
    assert sinks.as_json_rows(df).first()[0] == '{"a":null,"b":2,"c":"x"}'
    sinks.write_json(df, str(tmp_path / "j"))
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["b", "a", "c"]
    assert sinks.to_records(df) == [{"b": 2, "a": None, "c": "x"}]
    with pytest.raises(ValueError):
        sinks.to_records(spark.range(5), limit=3)


def test_manifests_logs_and_embedded_json(spark, tmp_path):
    for n in ("r1", "r2"):
        (tmp_path / "x" / n).mkdir(parents=True)
        (tmp_path / "x" / n / "run_manifest.json").write_text(json.dumps({"seed": n}))
    assert sorted((r.run, r.seed) for r in readers.run_manifests(spark, str(tmp_path / "x")).collect()) == [("r1", "r1"), ("r2", "r2")]
    (tmp_path / "log.jsonl").write_text('{"step": 1, "m": 0.5}\n{"step": 2, "m": 0.9}\n{"step": 3, "m": 0.7}\n')
    assert tuple(readers.metric_log(spark, str(tmp_path / "log.jsonl"), "step int, m double", "m", "step").first()) == (0.9, 0.7, 3)
    one, two = "a\n```json\n{\"k\": 3}\n```\nb", "```json\n{}\n```\n```json\n{}\n```"
    got = readers.embedded_json(spark.createDataFrame([(1, one), (2, two), (3, None)], "i int, t string"), "t", "k int")
    assert [(r.data.k if r.data else None) for r in got.orderBy("i").collect()] == [3, None, None]


BASE = 1_699_999_800_000  # on a five-minute border
EVENTS = "request_id string, user_id long, item_id long, request_time_ms long, long_view boolean"


def _stream(spark, tmp_path, rows, build, parts=3):
    for k in range(parts):
        spark.createDataFrame(rows[k::parts] if parts > 1 else rows, EVENTS).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = build(source).writeStream.format("memory").queryName("out_" + tmp_path.name.replace("-", "_")).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.sql("SELECT * FROM out_" + tmp_path.name.replace("-", "_")).collect()


def test_streaming_windows_and_sessions(spark, tmp_path):
    minute = 60_000
    rows = [(f"r{k}", 1, 5, BASE + k * minute, k % 2 == 0) for k in range(12)] + [("end", 2, 5, BASE + 10_000 * minute, True), ("none", 2, 5, None, True)]
    got = _stream(spark, tmp_path, rows, lambda s: stream.windowed_views(stream.first_requests(stream.with_event_time(s, delay="1 day"))), parts=1)
    assert sorted((r.n, r.long_views) for r in got) == [(2, 1), (5, 2), (5, 3)]


def test_streaming_sessions(spark, tmp_path):
    minute = 60_000
    rows = [("a", 1, 5, BASE, True), ("b", 1, 5, BASE + 20 * minute, True), ("c", 1, 5, BASE + 90 * minute, True), ("z", 2, 5, BASE + 100_000 * minute, True), (None, None, 5, BASE, True)]
    got = _stream(spark, tmp_path, rows, lambda s: stream.streaming_sessions(stream.with_event_time(s)), parts=1)
    assert sorted((r.user_id, r.n_events) for r in got) == [(1, 1), (1, 2)]


def test_streaming_histories_equal_batch(spark, tmp_path):
    rows = [(f"r{k:03d}", k % 3, k % 7, (k // 2) * 10, True) for k in range(60)]
    got = _stream(spark, tmp_path, rows, lambda s: stream.streaming_histories(s, 4), parts=1)
    want = prior_histories(spark.createDataFrame(rows, EVENTS), 4).collect()
    assert {r.request_id: r.history_item_ids for r in got} == {r.request_id: r.history_item_ids for r in want}
