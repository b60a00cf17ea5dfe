"""Substring deduplication: words in long windows that an earlier document also has.

Level-wise doubling.  The target width is halved while it is even and wide enough; windows of the
shortest width are compared first, and only where they repeat in another document are windows of twice
the width built and compared, until the target width is reached or no candidate survives.  At the
first level one window stands for its neighbours: of all short windows inside a window of the next width
the one with the smallest hash is taken.  Equal wide windows take equal short ones, so none is lost, and
only one short window in about thirteen has to be moved.

Documents of equal word sequences are one class from the start: the smallest id represents it, the
others are copies and lose all their windows.  What is moved is narrow (hashes and ids); text is moved
once, to the documents that have candidates.  A window that very many documents share is one row per
document, combined in each task before the shuffle; no list of its documents is ever built.

Windows are compared by 64-bit hashes of their words.  Defined results: null text has no words; a null id
is neither source nor target, its words stay; rows that repeat an id count as one document; texts shorter
than the width stay whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import keep
from quire.llm.words import batches, rows_of, window_hashes, word_hashes

#: Windows shorter than this repeat by chance too often to be a first level.
LEAST = 13


def widths(target: int) -> list[int]:
    """Ascending window widths, each twice the one before, that end with ``target``."""
    out = [target]
    while out[0] % 2 == 0 and out[0] // 2 >= LEAST:
        out.insert(0, out[0] // 2)
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values, by doubling."""
    size = 1
    while size * 2 <= width:
        values, size = np.minimum(values[:-size], values[size:]), size * 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def chosen(hashes: np.ndarray, ends: np.ndarray, short: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``wide`` words: the smallest hash of the ``short`` windows in it, and its start."""
    at = np.arange(len(hashes))
    rows = rows_of(ends)
    starts = at[at + wide <= ends[rows]] if len(at) else at
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    full = np.full(len(hashes), np.iinfo(np.uint64).max, np.uint64)
    found, place = window_hashes(hashes, ends, short)
    full[place] = found
    return sliding_min(full, wide - short + 1)[starts], starts


def distinct_per_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[new], values[new]


def hash_lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Lists of 64-bit hashes, one per row, from row numbers in ascending order."""
    ends = np.searchsorted(rows, np.arange(n), side="right")
    return pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(values.view(np.int64)))


def digest_of(text: str | None) -> bytes:
    """SHA-256 of a text's words, joined by one blank."""
    return hashlib.sha256(b" ".join((text or "").encode().split())).digest()


def facts(df: DataFrame, text: str, doc_id: str, first: int, second: int) -> DataFrame:
    """Per row: id, digest of its word sequence, n_words, and the distinct chosen hashes of the first level."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for part in batches(batch, "text"):
                hashes, ends, *_ = word_hashes(part.column("text"))
                best, starts = chosen(hashes, ends, first, second)
                rows, best = distinct_per_row(rows_of(ends)[starts], best)
                digests = [digest_of(t) for t in part.column("text").to_pylist()]
                columns = [part.column("id"), pa.array(digests, pa.binary()), pa.array(np.diff(ends, prepend=0)), hash_lists(rows, best, len(ends))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "n_words", "chosen"])

    schema = f"id {df.schema[doc_id].dataType.simpleString()}, digest binary, n_words long, chosen array<long>"
    return df.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def candidates(df: DataFrame, wide: int, first: int, second: int) -> DataFrame:
    """Distinct hashes of the windows of ``wide`` words whose parts all survived: rows (id, hash).

    ``df`` has id, text and ``alive``: hashes of the level before.  At the second level a window's part is
    its chosen short window; above it, its two halves.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for part in batches(batch, "text"):
                hashes, ends, *_ = word_hashes(part.column("text"))
                alive = part.column("alive")
                alive_rows = np.repeat(np.arange(len(alive)), alive.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                alive = alive.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                grown, starts = window_hashes(hashes, ends, wide)
                rows = rows_of(ends)[starts]
                if wide == second:
                    parts, _ = chosen(hashes, ends, first, second)
                    good = member(rows, parts, alive_rows, alive)
                else:
                    half, place = window_hashes(hashes, ends, wide // 2)
                    full = np.zeros(len(hashes), np.uint64)
                    full[place] = half
                    good = member(rows, full[starts], alive_rows, alive) & member(rows, full[starts + wide // 2], alive_rows, alive)
                rows, grown = distinct_per_row(rows[good], grown[good])
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(rows)), pa.array(grown.view(np.int64))], ["id", "hash"])

    return df.select("id", "text", "alive").mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, hash long")


def member(rows: np.ndarray, values: np.ndarray, of_rows: np.ndarray, of_values: np.ndarray) -> np.ndarray:
    """Whether each (row, value) is among the others."""
    both = np.concatenate([values, of_values])
    _, code = np.unique(both, return_inverse=True)
    width = int(code.max(initial=0)) + 1
    return np.isin(rows * width + code[: len(values)], of_rows * width + code[len(values) :])


def cut(df: DataFrame, width: int) -> DataFrame:
    """Rows id, digest (of all words), n_removed, kept_text: ``df`` has id, text and ``covered``: hashes of windows that go."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for part in batches(batch, "text"):
                hashes, ends, *_ = word_hashes(part.column("text"))
                covered = part.column("covered")
                covered_rows = np.repeat(np.arange(len(covered)), covered.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                values = covered.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                grown, starts = window_hashes(hashes, ends, width)
                gone = starts[member(rows_of(ends)[starts], grown, covered_rows, values)]
                edge = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + width, -1)
                stays = np.cumsum(edge)[:-1] == 0
                digests, texts, removed, begin = [], [], [], 0
                for text, end in zip(part.column("text").to_pylist(), ends.tolist()):
                    digests.append(digest_of(text))
                    mine = stays[begin:end]
                    texts.append(b" ".join([w for w, s in zip((text or "").encode().split(), mine.tolist()) if s]).decode())
                    removed.append(len(mine) - int(mine.sum()))
                    begin = end
                columns = [part.column("id"), pa.array(digests, pa.binary()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "n_removed", "kept_text"])

    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", "text", "covered").mapInArrow(run, f"id {kind}, digest binary, n_removed long, kept_text string")


def repeated(rows: DataFrame) -> DataFrame:
    """(id, hash) rows whose hash another id has too, with the smallest id of each hash."""
    first = rows.groupBy("hash").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least != most").select("hash", "least")
    return rows.join(first, "hash")


def report(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 50) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 of the words that stay, joined by one blank."""
    levels = widths(width)
    first, second = levels[0], levels[min(1, len(levels) - 1)]
    base = keep(facts(df, text, doc_id, first, second), "substring-facts")
    classes = base.where("id is not null").groupBy("digest").agg(F.min("id").alias("source"), F.first("chosen").alias("chosen"))
    alive = repeated(classes.select(F.col("source").alias("id"), F.explode("chosen").alias("hash")))
    alive = alive.groupBy("id").agg(F.collect_set("hash").alias("alive"))
    texts = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    texts = keep(texts.join(alive.hint("shuffle_hash"), "id"), "substring-texts")
    found = None
    for level in levels[1:] or levels:
        asked = texts if found is None else texts.drop("alive").join(found.groupBy("id").agg(F.collect_set("hash").alias("alive")), "id")
        found = keep(repeated(candidates(asked, level, first, second).distinct()), "substring-windows")
    covered = found.where("least < id").groupBy("id").agg(F.collect_set("hash").alias("covered"))
    changed = cut(texts.select("id", "text").join(covered, "id"), width)
    changed = changed.select("id", "digest", "n_removed", F.sha2("kept_text", 256).alias("sha")).distinct()
    # A sequence that very many documents have is spread by the join's own splitting of large partitions.
    out = base.select("id", "n_words", "digest").join(classes.select("digest", "source"), "digest", "left").join(changed, ["id", "digest"], "left")
    gone = F.coalesce((F.col("id") > F.col("source")) & (F.col("n_words") >= width), F.lit(False))
    return out.select(
        F.col("id").alias(doc_id),
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )
