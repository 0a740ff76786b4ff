import pytest
from pyspark.sql import functions as F

from quillmill.session import read_table
from quillmill.sources import files, plugins
from quillmill.streaming import events


def test_documents_and_blobs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.pdf", b"one\n\ntwo\fthree"), ("b.pdf", b"one\n\ntwo\fthree"), ("c.pdf", b""), ("d.txt", b"x")):
        (tmp_path / "in" / name).write_bytes(data)
    docs = files.read_documents(spark, str(tmp_path / "in"))
    assert sorted(r["name"] for r in docs.select("name").collect()) == ["a.pdf", "b.pdf"]
    files.write_blobs(docs, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 1
    parts = plugins.extract_with(docs.dropDuplicates(["content_hash"])).orderBy("block_index").collect()
    assert [(r["page_number"], r["text"]) for r in parts] == [(1, "one"), (1, "two"), (2, "three")]

    def broken(content):
        raise ValueError("unreadable")

    assert plugins.extract_with(docs, broken).filter("error LIKE 'ValueError%'").count() == 2


def test_replace_only_touched_buckets(spark, tmp_path):
    df = spark.createDataFrame([(i, "old") for i in range(50)], "paper_id long, v string")
    files.replace_papers(df, str(tmp_path / "t"), buckets=8)
    one = spark.read.parquet(str(tmp_path / "t"))
    bucket = one.filter("paper_id = 7").first()["bucket"]
    files.replace_papers(one.filter(F.col("bucket") == bucket).select("paper_id", F.lit("new").alias("v")).persist(), str(tmp_path / "t"), buckets=8)
    got = spark.read.parquet(str(tmp_path / "t")).collect()
    assert len(got) == 50 and {r["v"] for r in got if r["bucket"] == bucket} == {"new"} and {r["v"] for r in got if r["bucket"] != bucket} == {"old"}


def test_plugins(spark):
    df = spark.createDataFrame([(1, "a b"), (2, " "), (3, None)], "id int, t string")
    got = {r["id"]: r["v"] for r in plugins.embed_with()(df, "t", "v").collect()}
    assert len(got[1]) == 64 and got[2] is None and got[3] is None
    with pytest.raises(Exception, match="vectors"):
        plugins.embed_with(lambda t: [])(df, "t", "v").collect()
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert plugins.retrying(flaky, wait=0)() == "ok"


def test_links(spark):
    html = '<title> T </title><meta name="description" content="D"><a href="x/y.pdf?z=1">p</a>'
    r = files.links_of(spark.createDataFrame([(html,), (None,)], "h string"), "h").collect()
    assert (r[0]["title"], r[0]["description"], r[0]["pdf_link"]) == ("T", "D", "x/y.pdf?z=1") and r[1]["title"] is None


def test_stream_equals_table(spark, small, tmp_path):
    table = read_table(spark, small, "events")
    table.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = events.deduplicated(events.read_events(spark, str(tmp_path / "in"), table.schema, per_trigger=2), "event_id", "ts", "3650 days")
    q = events.write_snapshots(events.latest_event(stream, ["user_id"], "ts", "event_id", ["event_type", "value"]), str(tmp_path / "out"), str(tmp_path / "mark"))
    q.awaitTermination()
    batch = events.latest_event(table.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts", "event_id", ["event_type", "value"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))


def test_windows_and_sessions(spark, small):
    e = read_table(spark, small, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = events.windowed(e, "ts", "1 hour", ["event_type"], "value")
    assert w.agg(F.sum("events")).first()[0] == e.count()
    s = events.sessions(e, "ts", "10 minutes", ["user_id"])
    assert s.agg(F.sum("events")).first()[0] == e.count() and s.filter("session_end <= session_start").count() == 0
