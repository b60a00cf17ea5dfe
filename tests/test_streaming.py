"""Late data, restarts and timeouts, which the drained checks do not show."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quire import lexicon as L
from quire.streaming import operators as ST
from quire.streaming import runs as R

START = datetime(2024, 1, 1)
SCHEMA = "event_id bigint, book_id bigint, ts timestamp, status string, percent double"


def feed(spark, tmp_path, *batches):
    path = str(tmp_path / "in")
    for rows in batches:
        data = [(i, b, START + timedelta(minutes=m), s, float(p)) for i, b, m, s, p in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return R.open_stream(spark, path, spark.read.parquet(path).schema)


def session(spark):
    s = spark.newSession()
    s.conf.set("spark.sql.shuffle.partitions", "2")
    R.use_rocksdb(s)
    return s


def test_late_rows_are_dropped(spark, tmp_path):
    s = session(spark)
    stream = feed(
        s, tmp_path, [(1, 1, 0, "running", 1)], [(2, 1, 600, "running", 2)], [(3, 1, 700, "running", 3)], [(4, 1, 1, "running", 4)]
    )
    out = str(tmp_path / "out")
    R.drain(ST.stream_activity(stream, "1 hour", delay="1 hour"), str(tmp_path / "ck"), R.batch_sink(out), "update")
    rows = R.latest_per_key(s, out, ["start", "status"]).collect()
    assert sum(r.n for r in rows) == 3


def test_job_state_clamps_ends_and_times_out(spark, tmp_path):
    s = session(spark)
    stream = feed(
        s,
        tmp_path,
        [(1, 1, 0, "running", 250), (2, 2, 0, "running", 5), (3, 3, 0, "pending", -4)],
        [(4, 1, 10, "succeeded", 100), (5, 3, 10, "running", 40)],
        [(6, 1, 20, "running", 10), (7, 3, 2000, "running", 50)],
        [(8, 3, 4000, "running", 60)],
    )
    out = str(tmp_path / "out")
    state = ST.stream_job_state(stream, delay="1 minute", deadline_ms=60 * 60 * 1000)
    R.drain(state, str(tmp_path / "ck"), R.batch_sink(out), "update")
    rows = {r.book_id: (r.status, r.percent) for r in R.latest_per_key(s, out, ["book_id"]).collect()}
    assert rows[1] == ("succeeded", 100.0)
    assert rows[2] == ("timeout", 5.0)
    first = {(r.book_id, r.percent) for r in s.read.parquet(out).filter("batch = 0").collect()}
    assert (1, 100.0) in first and (3, 0.0) in first


def test_restart_adds_nothing(spark, tmp_path):
    s = session(spark)
    path, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    pages = s.createDataFrame([(1, "same text"), (2, "same text"), (3, "other")], "doc_id int, text string")
    pages.coalesce(1).write.mode("append").parquet(path)

    def once():
        stream = ST.new_contents(R.open_stream(s, path, pages.schema))
        R.drain(stream, ck, ST.ingest_sink(out, 10, 2), "append")
        return s.read.parquet(out).select("content_sha", "text").collect()

    assert len(once()) == 2
    assert len(once()) == 2
    pages.withColumn("text", F.concat("text", F.lit("!"))).coalesce(1).write.mode("append").parquet(path)
    assert len(once()) == 4


ANSWERS = "qid string, subject string, versions map<string,int>, embedding_model string, kb_revision int"
VERSIONS = dict(L.COMPONENT_VERSIONS)


def test_staleness_follows_both_streams(spark, tmp_path):
    """Open answers come again when a revision rises, after restarts too; others stay as they are."""
    s = session(spark)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    answers = [
        [("a", "x", VERSIONS, "m", 1), ("b", "y", VERSIONS, "m", None), ("c", None, VERSIONS, "old", 3), ("d", "x", None, "m", 1)],
        [("e", "x", VERSIONS, "m", 2)],
        [("a", "x", VERSIONS, "m", 3)],
        [],
    ]
    bumps = [[("x", 1)], [("x", 2), ("x", 1), (None, 9)], [("x", 3)], [("y", 1), ("x", 2)]]
    seen = []
    for n, (a, b) in enumerate(zip(answers, bumps)):
        s.createDataFrame(a, ANSWERS).write.mode("append").parquet(str(tmp_path / "a"))
        s.createDataFrame(b, "subject string, revision int").write.mode("append").parquet(str(tmp_path / "b"))
        left = R.open_stream(s, str(tmp_path / "a"), s.createDataFrame([], ANSWERS).schema, None)
        right = R.open_stream(s, str(tmp_path / "b"), s.createDataFrame([], "subject string, revision int").schema, None)
        R.drain(ST.stream_staleness(left, right, "m", parts=3), ck, R.batch_sink(out), "update")
        rows = R.latest_per_key(s, out, ["qid"]).collect()
        seen.append({r.qid: tuple(r.stale_reasons) for r in rows})
    kb = ("kb_reindexed",)
    assert {q: r for q, r in seen[0].items() if q != "d"} == {"a": (), "b": (), "c": ("embedding_model_drift",)}
    assert seen[0]["d"][0] == "missing_versions_field" and seen[3]["d"] == seen[0]["d"]
    assert seen[1]["a"] == kb and seen[1]["e"] == ()
    assert seen[2]["a"] == () and seen[2]["e"] == kb and seen[2]["b"] == ()
    assert seen[3]["b"] == kb and seen[3]["a"] == () and seen[3]["c"] == ("embedding_model_drift",)
    # Nothing new arrives: nothing is put out.
    n = s.read.parquet(out).count()
    R.drain(ST.stream_staleness(left, right, "m", parts=3), ck, R.batch_sink(out), "update")
    assert s.read.parquet(out).count() == n


def test_job_records_are_ranked_row_by_row():
    """The first final record, else the newest; one without a time is the newest."""
    better = ST.JobState.better
    run, late, end, later = ("running", 1.0, 5, 1), ("running", 2.0, None, 2), ("failed", 3.0, 9, 3), ("succeeded", 4.0, 9, 4)
    assert better(None, run) == run and better(run, late) == late and better(late, run) == late
    assert better(end, run) == end and better(run, end) == end
    assert better(later, end) == end and better(end, later) == end
