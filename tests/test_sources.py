import pytest
from pyspark.sql import functions as F

from citegrain import storage
from citegrain.session import credential
from citegrain.sources import html, records
from citegrain.streaming import ingest


def test_csv_with_mark_and_missing_columns(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿id,name\n1,"a, b"\n2,\n', encoding="utf-8")
    assert [tuple(r) for r in records.read_csv(spark, str(path), ["id", "name"]).collect()] == [("1", "a, b"), ("2", None)]
    with pytest.raises(ValueError, match="x"):
        records.read_csv(spark, str(path), ["x"])


def test_id_list_names_the_line(spark, tmp_path):
    path = tmp_path / "ids.txt"
    path.write_text("W2\n\nhttps://openalex.org/W10\nW2\n")
    assert [r["id"] for r in records.read_ids(spark.read.text(str(path))).collect()] == ["W2", "W10"]
    path.write_text("W2\nS3\n")
    with pytest.raises(Exception, match="line 2"):
        records.read_ids(spark.read.text(str(path))).collect()


def test_records_take_the_first_that_exists(spark, tmp_path):
    (tmp_path / "b.json").write_text('[{"a": 1}, {"a": null}]')
    got = records.read_records(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"), schema="a int")
    assert sorted(r["a"] or 0 for r in got.collect()) == [0, 1]
    with pytest.raises(FileNotFoundError):
        records.read_records(spark, str(tmp_path / "c.json"))


def test_html(spark):
    page = '<p><mat-row><mat-cell class="cdk-column-name" title="A &amp; B">A..</mat-cell><mat-cell class="cdk-column-jif"> 1.5 </mat-cell></mat-row></p>'
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, html string")
    out = html.wide(html.rows_of(pages, "html", "mat-row", "mat-cell", ["id"]), ["id"], ["name", "jif"])
    assert [tuple(r) for r in out.collect()] == [(1, 0, "A & B", "1.5")]


def test_stream_ingest_keeps_the_last_write(spark, tmp_path):
    src, table, check = tmp_path / "src", str(tmp_path / "table"), str(tmp_path / "check")
    src.mkdir()
    schema = "id string, v int, updated_date string"
    (src / "a.json").write_text('{"id":"W1","v":1,"updated_date":"2025-01-01"}\n{"id":"W2","v":1,"updated_date":"2025-01-01"}\n{"id":"W1","v":2,"updated_date":"2025-01-02"}\n')
    ingest.ingest(spark, str(src), schema, table, check).awaitTermination()
    (src / "b.json").write_text('{"id":"W2","v":9,"updated_date":"2025-02-01"}\n{"id":"W3","v":1,"updated_date":"2025-02-01"}\n')
    ingest.ingest(spark, str(src), schema, table, check).awaitTermination()
    assert {r["id"]: r["v"] for r in spark.read.parquet(f"{table}/v1").collect()} == {"W1": 2, "W2": 9, "W3": 1}


def test_event_windows_match_a_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = tmp_path / "events"
    events.coalesce(1).write.parquet(str(folder))
    stream = ingest.event_counts(spark.readStream.schema(events.schema).parquet(str(folder)))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg({"n": "sum"}).first()[0] == events.count()


def test_an_interrupted_output_goes_on(spark, tmp_path):
    """After half the keys, and after a key whose rows were written but not its mark, a second run adds what is
    missing and leaves what is done."""
    path = str(tmp_path / "by")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c/ d", 3), ("e", 4), (None, 5)], "k string, v int")
    assert records.write_by(rows.where("k IN ('a', 'b')"), path, "k") == ["a", "b"]
    rows.where("k = 'e'").withColumn("v", F.lit(99)).write.mode("append").partitionBy("k").parquet(path)  # cut off before its mark
    assert not records.complete(spark, path, ["a", "b", "c/ d", "e"])
    assert records.write_by(rows.withColumn("v", F.col("v") * 10), path, "k") == ["c/ d", "e"]
    assert {(r["k"], r["v"]) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 2), ("c/ d", 30), ("e", 40)}
    assert records.complete(spark, path, ["a", "b", "c/ d", "e"]) and records.write_by(rows, path, "k") == []


def test_one_run_at_a_time_and_cleanup(spark, tmp_path):
    with storage.single_run(spark, "job"):
        with pytest.raises(storage.Locked), storage.single_run(spark, "job"):
            pass
    with pytest.raises(RuntimeError, match="x"), storage.single_run(spark, "job"):
        raise RuntimeError("x")
    with storage.single_run(spark, "job"):  # released after a failure too
        pass
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert [storage.cached(spark, "t", "k", make).count(), storage.cached(spark, "t", "k", make).count(), len(calls)] == [3, 3, 1]
    storage.cached(spark, "t", "other", make)
    assert len(calls) == 2
    (tmp_path / "f").write_text("a")
    before = storage.version(spark, str(tmp_path / "f"))
    (tmp_path / "f").write_text("bc")
    assert storage.version(spark, str(tmp_path / "f")) != before
    path = storage.new_path(spark, "gone")
    spark.range(1).write.parquet(path)
    storage.remove(spark, path)
    assert not storage.exists(spark, path)


def test_records_of_an_xz_array_in_pieces(spark, tmp_path):
    from citegrain.operators import release

    path = str(tmp_path / "r.json.xz")
    rows = spark.range(2000).select("id", F.concat(F.lit('[{"x, ]'), F.repeat(F.lit("é\""), 700)).alias("t"))
    release.write_records(rows, path)
    got = records.read_records(spark, path, schema="id:bigint,t:string")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    assert len(records.file_checksum(spark, path)) == 64
    (tmp_path / "cut.json.xz").write_bytes(__import__("lzma").compress(b'[{"id": 1}, {"id":'))
    with pytest.raises(Exception, match="cut off"):
        records.read_records(spark, str(tmp_path / "cut.json.xz"), schema="id:bigint,t:string").collect()
    release.write_records(rows.limit(0), path)
    assert records.read_records(spark, path, schema="id:bigint,t:string").count() == 0


def test_missing_parts_and_credentials(spark, tmp_path, monkeypatch):
    records.write_json(spark.range(2), str(tmp_path / "part0.json"))
    assert records.read_parts(spark, str(tmp_path), 1, "id bigint").count() == 2
    with pytest.raises(FileNotFoundError, match="part1"):
        records.read_parts(spark, str(tmp_path), 2, "id bigint")
    with pytest.raises(ValueError, match="description"):
        records.dictionary(spark.range(1), {})
    monkeypatch.setenv("CITEGRAIN_STORE_PASSWORD", "secret")
    assert credential("store", "password") == "secret"
    with pytest.raises(LookupError):
        credential("store", "nothing")
