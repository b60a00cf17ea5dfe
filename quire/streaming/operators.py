"""Streaming operators: ingest, status, activity windows, job state, staleness and validation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.operators import cache, chunks, validation

TERMINAL = ("succeeded", "failed")


def new_contents(pages: DataFrame, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Pages whose content was not seen before.

    The hashes live in the state store and grow with each batch only by what is new.  With an
    event time, hashes older than the watermark are forgotten.
    """
    hashed = pages.withColumn("content_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    if event_time is None:
        return hashed.dropDuplicates(["content_sha"])
    return hashed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["content_sha"])


def ingest_sink(path: str, size: int = 1000, overlap: int = 200) -> Callable[[DataFrame, int], None]:
    """Chunk every arriving content and append; a repeated batch replaces itself."""

    def write(df: DataFrame, batch: int) -> None:
        # Several jobs read the batch; source and de-duplication run once for all of them.
        pages = df.select("content_sha", F.lit(1).cast("bigint").alias("page_num"), "text").persist()
        try:
            made = chunks.chunk_windows(pages, size, overlap, keys=["content_sha"])
            made.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        finally:
            pages.unpersist()

    return write


def stream_status(log: DataFrame) -> DataFrame:
    """Latest status per book; run in update mode."""
    newest = log.groupBy("book_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("m"))
    return newest.select("book_id", F.col("m.status").alias("status"), F.col("m.ts").alias("ts"))


def stream_activity(log: DataFrame, window: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Updates per status and event-time window; tumbling without ``slide``."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    counted = log.withWatermark("ts", delay).groupBy(span.alias("w"), "status").agg(
        F.count(F.lit(1)).alias("n"), F.max("percent").alias("max_percent")
    )
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "status", "n", "max_percent")


def stream_sessions(log: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """Bursts of updates per book; a session is emitted once the watermark passes its end."""
    counted = log.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "book_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.select("book_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


# Times are microseconds, which no zone of a worker can shift.
STATE = "status string, percent double, at bigint, event_id bigint"
JOB_OUTPUT = f"book_id bigint, {STATE}"


class JobState(StatefulProcessor):
    """Progress of a job: clamped to 0..100, terminal states final, silent jobs time out.

    Rows of a batch may come in any order: the earliest terminal record wins over everything, and
    without one the newest record counts.  State is one small record per job.
    """

    def __init__(self, deadline_ms: int | None = None):
        self.deadline_ms = deadline_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE)

    @staticmethod
    def place(record: tuple) -> tuple:
        """A record without a time comes last."""
        return record[2] is None, record[2], record[3]

    @classmethod
    def better(cls, old: tuple | None, new: tuple) -> tuple:
        if old is None:
            return new
        old_final, new_final = old[0] in TERMINAL, new[0] in TERMINAL
        if old_final != new_final:
            return old if old_final else new
        return old if (cls.place(old) <= cls.place(new)) == old_final else new

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stored = self.state.get()
        if stored is not None and (stored[0] in TERMINAL or stored[0] == "timeout"):
            return
        current, batch = stored if stored is None else tuple(stored), None
        for row in rows:
            percent = 0.0 if row.percent is None else min(100.0, max(0.0, row.percent))
            batch = self.better(batch, (row.status, percent, row.at, row.event_id))
        if batch is None:
            return
        if current is None or batch[0] in TERMINAL or self.place(batch) > self.place(current):
            current = batch
        self.state.update(current)
        if self.deadline_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if current[0] not in TERMINAL:
                self.handle.registerTimer(current[2] // 1000 + self.deadline_ms)
        yield self.row(key, current)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return
        status, percent, at, event_id = self.state.get()
        if status in TERMINAL or status == "timeout":
            return
        self.state.update(("timeout", percent, at, event_id))
        yield self.row(key, ("timeout", percent, at, event_id))

    @staticmethod
    def row(key, state: tuple) -> Row:
        status, percent, at, event_id = state
        return Row(book_id=key[0], status=status, percent=percent, at=at, event_id=event_id)

    def close(self) -> None:
        pass


def stream_job_state(log: DataFrame, delay: str = "1 hour", deadline_ms: int | None = None) -> DataFrame:
    # Jobs are many and their records few: rows go to Python and back in common batches, not a frame for each job.
    states = (
        log.select("book_id", "event_id", "ts", "status", "percent", F.unix_micros("ts").alias("at"))
        .withWatermark("ts", delay)
        .groupBy("book_id")
        .transformWithState(JobState(deadline_ms), JOB_OUTPUT, "Update", "EventTime")
    )
    return states.select("book_id", "status", "percent", F.timestamp_micros("at").alias("ts"), "event_id")


def stream_stale(answers: DataFrame, revisions: DataFrame, embedding_model: str) -> DataFrame:
    """Staleness of arriving answers against the current corpus revisions.

    A stream-static join: the revisions are read again with every batch and reduced to one row per subject.
    """
    return cache.mark_stale(answers, revisions, embedding_model)


ANSWER_STATE = "kb_revision bigint, reasons string"
STALE_OUTPUT = "qid string, stale boolean, stale_reasons array<string>, revision bigint"
#: Answers of a subject are spread over this many states; every bump of its revision goes to all of them.
SUBJECT_PARTS = 16


class Staleness(StatefulProcessor):
    """Open answers of a part of a subject, judged again whenever the subject's revision rises.

    State is the highest revision so far and, for each answer, its own revision and the reasons that
    follow from the answer alone.  Rows of a batch may come in any order: bumps are taken first.
    Answers are put out in frames of a bounded length.
    """

    FRAME = 10_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.revision = handle.getValueState("revision", "revision bigint")
        self.answers = handle.getMapState("answers", "qid string", ANSWER_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.revision.get()[0] if self.revision.exists() else 0
        now, fresh = before, {}
        for pdf in rows:
            bumps = pdf["revision"].dropna()
            if len(bumps):
                now = max(now, int(bumps.max()))
            arrived = pdf[pdf["qid"].notna()]
            for qid, kb, reasons in zip(arrived["qid"], arrived["kb_revision"], arrived["reasons"]):
                fresh[qid] = (None if pd.isna(kb) else int(kb), reasons)
        for qid, answer in fresh.items():
            self.answers.updateValue((qid,), answer)
        if now != before:
            self.revision.update((now,))
            judged = ((k[0], tuple(v)) for k, v in self.answers.iterator())
        else:
            judged = iter(fresh.items())
        frame = []
        for qid, (kb, reasons) in judged:
            found = reasons.split(",") if reasons else []
            if (kb or 0) != now if kb is not None else now > 0:
                found.append(cache.KB_REINDEXED)
            frame.append((qid, bool(found), found, now))
            if len(frame) == self.FRAME:
                yield pd.DataFrame(frame, columns=["qid", "stale", "stale_reasons", "revision"])
                frame = []
        if frame:
            yield pd.DataFrame(frame, columns=["qid", "stale", "stale_reasons", "revision"])

    def close(self) -> None:
        pass


def stream_staleness(answers: DataFrame, bumps: DataFrame, embedding_model: str, subject: str = "subject", parts: int = SUBJECT_PARTS) -> DataFrame:
    """Staleness of open answers, with both sides as streams; run in update mode.

    ``answers`` has qid, subject, versions, embedding_model and kb_revision, ``bumps`` (subject, revision).  An
    answer is put out when it arrives and again when its subject's revision rises; a later answer of the same
    qid replaces it.  Answers that the corpus doesn't matter to are judged by themselves and keep no state.
    """
    reasons = F.array_join(cache.fixed_reasons(embedding_model), ",")
    watched = cache.watches_corpus(subject)
    none = lambda kind: F.lit(None).cast(kind)
    left = answers.select(
        # An answer without a subject has a key of its own kind, which no bump reaches.
        F.when(watched, F.col(subject)).alias("subject"),
        F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int").alias("part"),
        F.col("qid").cast("string").alias("qid"),
        F.col("kb_revision").cast("bigint").alias("kb_revision"),
        reasons.alias("reasons"),
        none("bigint").alias("revision"),
    )
    right = bumps.filter(F.col(subject).isNotNull()).select(
        F.col(subject).alias("subject"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
        none("string").alias("qid"),
        none("bigint").alias("kb_revision"),
        none("string").alias("reasons"),
        F.col("revision").cast("bigint").alias("revision"),
    )
    alone = left.filter("subject is null")
    open_ = left.filter("subject is not null").unionByName(right)
    judged = open_.groupBy("subject", "part").transformWithStateInPandas(Staleness(), STALE_OUTPUT, "Update", "None")
    own = F.when(F.col("reasons") == "", F.array().cast("array<string>")).otherwise(F.split("reasons", ","))
    return judged.unionByName(alone.select("qid", (F.col("reasons") != "").alias("stale"), own.alias("stale_reasons"), F.lit(0).cast("bigint").alias("revision")))


def stream_validate(answers: DataFrame, disabled=()) -> DataFrame:
    """The validation projection on arriving answers."""
    return validation.validate(answers, disabled)
