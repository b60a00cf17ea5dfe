"""Language identification by prediction by partial matching over bytes.

For each language a context tree of variable order (up to three bytes) holds how often each byte class
followed each context in the training texts.  The statistics are then frozen.  The code length of a
text under a language is the sum over its bytes of -log2 p, where p comes from the longest context the
tree has; a byte unseen there pays the escape probability d/(n+d) (n: occurrences of the context,
d: distinct successors) and is predicted by the next shorter context, in which the bytes already ruled
out are excluded.  The shortest code wins.  Code lengths are whole 256ths of a bit, so sums don't depend
on order or partitioning.

Bytes are taken in classes: letters a-z without case, digits, blanks, other ASCII signs, and every
byte from 0x80 on by itself.

Training reads at most ``train_docs`` labelled rows of each language, those with the smallest hash of
their id.  That sample is the only bound: every label has its own tree, and it keeps every context and
successor of the language's sample, however large the others are.  The model that is sent to the executors
grows with the number of labels and not with the number of rows.  Scoring reads every text whole.

Defined results: null text or text without letters is ``und`` with score 0, as is everything if there is
nothing to learn from; ties go to the smaller label; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from quire.llm.words import batches, give_back, rows_of, text_bytes

#: 0: before the text; 1-26 letters; 27 digits; 28 blanks; 29 other signs; 30 and more: bytes from 0x80.
SYMBOLS = 158
ORDER = 3
UNIT = 256
#: ``readable``: least share of letters, and bits a byte that are too many for a text of few letters (a byte
#: at random takes 7.3).  Of 10000 sample documents the least share is 0.29 and the longest code 3.43 bits.
MIN_LETTERS = 0.1
MAX_BITS = 6.0


def _symbol_map() -> np.ndarray:
    table = np.full(256, 29, np.uint8)
    for letter in range(26):
        table[[ord("a") + letter, ord("A") + letter]] = 1 + letter
    table[ord("0") : ord("9") + 1] = 27
    table[[0x20, *range(0x09, 0x0E)]] = 28
    table[0x80:] = np.arange(30, 158)
    return table


_SYMBOL = _symbol_map()


def context_codes(column: pa.Array, table: np.ndarray = _SYMBOL, wide: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three classes before each byte as one number, the byte's own class, and where rows end."""
    data, ends = text_bytes(column)
    symbols = table[data].astype(np.int32)
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    code = np.zeros(len(symbols), np.int32)
    for back in range(ORDER, 0, -1):
        one = np.zeros(len(symbols), np.int32)
        one[back:] = symbols[:-back] if back < len(symbols) else 0
        for k in range(back):
            early = begins + k
            one[early[early < len(symbols)]] = 0
        code = code * wide + one
    return code, symbols, ends


@dataclass
class Model:
    """Frozen statistics.  Per language and order: seen n-grams (context code * SYMBOLS + class) in order and
    their code lengths in bits, and the contexts with what an escape from them costs."""

    labels: list[str]
    tables: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]

    def bits(self, k: int, grams: np.ndarray) -> np.ndarray:
        """Code lengths under language ``k``, in units: the longest seen form after the escapes above it."""
        out, open_ = np.zeros(len(grams)), np.arange(len(grams))
        for order in range(ORDER, -1, -1):
            keys, cost, contexts, escape = self.tables[k][order]
            own = grams[open_] % SYMBOLS ** (order + 1)
            at, seen = _places(keys, own)
            out[open_[seen]] += cost[at[seen]]
            open_, own = open_[~seen], own[~seen]
            at, known = _places(contexts, own // SYMBOLS)
            out[open_[known]] += escape[at[known]]
        out[open_] += np.log2(SYMBOLS)
        return np.minimum(np.rint(out * UNIT), 65535).astype(np.int32)

    def code_lengths(self, column: pa.Array) -> np.ndarray:
        code, symbols, ends = context_codes(column)
        out = np.zeros((len(ends), len(self.labels)), np.int64)
        if len(symbols):
            some, which = np.unique(code * SYMBOLS + symbols, return_inverse=True)
            sizes = np.diff(ends, prepend=0)
            full = np.flatnonzero(sizes)
            # One language at a time: memory does not grow with their number.
            for k in range(len(self.labels)):
                out[full, k] = np.add.reduceat(self.bits(k, some)[which], (ends - sizes)[full], dtype=np.int64)
        return out


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted number is in the sorted keys, and whether it is there; keys are not empty."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def count_grams(df: DataFrame, text: str, label: str) -> DataFrame:
    """label, gram (context code * SYMBOLS + class), n; counted in each task first."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for part in batches(batch, text):
                code, symbols, ends = context_codes(part.column(text))
                labels = part.column(label).dictionary_encode()
                row = labels.indices.to_numpy(zero_copy_only=False).astype(np.int64)[rows_of(ends)]
                gram, n = np.unique((row * SYMBOLS**ORDER + code) * SYMBOLS + symbols, return_counts=True)
                which, gram = np.divmod(gram, SYMBOLS ** (ORDER + 1))
                names = labels.dictionary.take(pa.array(which))
                yield pa.RecordBatch.from_arrays([names, pa.array(gram), pa.array(n.astype(np.int64))], ["label", "gram", "n"])

    counted = df.select(F.col(text), F.col(label)).mapInArrow(run, "label string, gram long, n long")
    return counted.groupBy("label", "gram").agg(F.sum("n").alias("n"))


def frozen(labels: list[str], label: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """Code lengths of every counted n-gram of every language, and escapes of every context."""
    order_of = np.argsort(label, kind="stable")
    edges = np.searchsorted(label[order_of], np.arange(len(labels) + 1))
    tables = []
    for k in range(len(labels)):
        own = order_of[edges[k] : edges[k + 1]]
        rows, shorter, p = [], None, None
        for order in range(ORDER + 1):
            keys, which = np.unique(gram[own] % SYMBOLS ** (order + 1), return_inverse=True)
            count = np.bincount(which, weights=n[own])
            contexts, at = np.unique(keys // SYMBOLS, return_inverse=True)
            total, distinct = np.bincount(at, weights=count), np.bincount(at)
            # What follows a context has followed the shorter one too.
            parent = np.full(len(keys), 1 / SYMBOLS) if order == 0 else p[np.searchsorted(shorter, keys % SYMBOLS**order)]
            # After a context that all classes have followed there is no escape.
            whole = distinct == SYMBOLS
            mass = np.where(whole, 1, np.maximum(1 - np.bincount(at, weights=parent), 1e-12))
            p = count / (total + np.where(whole, 0, distinct))[at]
            escape = -np.log2(distinct / (total + distinct) / mass)
            rows.append((keys.astype(np.int32), -np.log2(p).astype(np.float32), contexts.astype(np.int32), escape.astype(np.float32)))
            shorter = keys
        tables.append(rows)
    return Model(labels, tables)


def train(df: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id", train_docs: int = 3000) -> Model | None:
    """The model of the labelled rows of ``df``; None if there are none with text."""
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "") & F.col(label).isNotNull())
    sizes = sorted((name, count) for name, count in rows.groupBy(label).count().collect())
    if not sizes:
        return None
    # Twice the expected number is read at most; a language with fewer rows is read whole.
    shares = [(name, k, min(1.0, train_docs / count)) for k, (name, count) in enumerate(sizes)]
    names = F.broadcast(df.sparkSession.createDataFrame(shares, "label string, __code int, __share double"))
    place = F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    asked = rows.select(F.col(text).alias("text"), F.col(label).alias("label"), place.alias("__place")).join(names, "label").where("__place < __share")
    grams = count_grams(asked, "text", "label")
    found = grams.join(names, "label").select("__code", F.col("gram").cast("int"), "n").toArrow()
    codes, which = np.unique(found["__code"].to_numpy(), return_inverse=True)
    if not len(codes):
        return None
    return frozen([sizes[k][0] for k in codes], which, found["gram"].to_numpy(), found["n"].to_numpy())


def predict(df: DataFrame, model: Model | None, text: str = "text", pred: str = "lang_pred", score: str = "score", cost: str | None = None) -> DataFrame:
    """All rows and columns, with the language and its share of the probability under equal priors.

    ``cost`` names a further column: the shortest code length in bits per byte (null without model or text).
    """
    df = df.drop(pred, score, *[cost] * bool(cost))
    lettered = F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}")
    if model is None:
        none = {pred: F.lit("und"), score: F.lit(0.0)}
        return df.withColumns(none | ({cost: F.lit(None).cast("double")} if cost else {}))
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*df.schema.fields]).add(pred, StringType()).add(score, DoubleType())
    if cost:
        schema = schema.add(cost, DoubleType())

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen = sent.value
        for batch in stream:
            for part in batches(batch, text):
                bits = frozen.code_lengths(part.column(text))
                best = bits.argmin(1)
                ahead = (bits - bits.min(1, keepdims=True)) / UNIT
                sure = 1 / np.exp2(-np.minimum(ahead, 1000)).sum(1)
                good = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False)
                names = pa.array([frozen.labels[k] if g else "und" for k, g in zip(best.tolist(), good.tolist())])
                columns = [*part.columns[:-1], names, pa.array(np.where(good, sure, 0.0))]
                if cost:
                    sizes = np.diff(text_bytes(part.column(text))[1], prepend=0)
                    each = bits.min(1) / UNIT / np.maximum(sizes, 1)
                    columns.append(pa.array(np.where(sizes > 0, each, np.nan), from_pandas=True))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])
            give_back()

    return df.withColumn("__lettered", lettered).mapInArrow(run, schema)


def readable(df: DataFrame, model: Model | None, text: str = "text", label: str | None = None) -> DataFrame:
    """The rows whose text is written language, with their columns; labels are not looked at.

    ``label`` names a column whose nulls are filled with the predicted language.

    A text goes if letters and their marks are less than ``MIN_LETTERS`` of its characters that aren't
    blank, or less than half of them while its code is longer than ``MAX_BITS`` a byte.  Texts of a script
    that the model has never seen have long codes but consist of letters: they stay, as all do that
    pass the first rule when there is no model.
    """
    shown = F.length(F.regexp_replace(text, r"\s+", ""))
    letters = F.length(text) - F.length(F.regexp_replace(text, r"[\p{L}\p{M}]+", ""))
    share = F.coalesce(letters / F.when(shown > 0, shown), F.lit(0.0))
    # Measured once, in the rows that go to the model; what follows looks at columns alone.
    judged = predict(df.withColumn("__letters", share), model, text, "__lang", "__score", "__cost")
    written = (F.col("__letters") > 0) & (F.col("__letters") >= MIN_LETTERS)
    junk = (F.col("__letters") < 0.5) & (F.coalesce("__cost", F.lit(0.0)) > MAX_BITS)
    if label:
        found = F.when(F.col("__lang") != "und", F.col("__lang"))
        judged = judged.withColumn(label, F.coalesce(F.col(label), found))
    return judged.where(written & ~junk).drop("__letters", "__lang", "__score", "__cost")


def third(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def report(df: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; learned from the rows that aren't held out."""
    model = train(df.where(third(doc_id) != 1), text, label, doc_id)
    held = F.coalesce(third(doc_id) == 1, F.lit(False))
    asked = df.select(F.col(doc_id), F.col(text).alias("__text"), held.alias("held_out"))
    return predict(asked, model, "__text").select(doc_id, "held_out", "lang_pred", "score")
