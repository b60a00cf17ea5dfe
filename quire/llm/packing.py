"""Packs tokenised examples into sequences under limits on tokens, segments and loss-bearing tokens.

Vector bin packing by the dot-product heuristic: of the examples that fit what is left of the open
sequence in all three dimensions, the one whose size vector has the largest dot product with the space
left goes in.  Examples longer than a sequence give whole sequences of their own first; when no
example fits the rest of a sequence, one is cut so that the rest is filled.  The choice is made among a
pool of ``pool`` examples, which each task refills from its stream: memory does not grow with the input,
nothing is shuffled, and a source of any size is spread as its scan is.  A task leaves one sequence that
may be short.

An example bears loss on its last ``loss`` tokens (a prompt comes first); by default on all of them.

Defined results: null text counts as empty and is one end token; repeated rows are packed as often as
they occur; limits hold in every sequence; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quire.llm.bpe import Codec
from quire.llm.words import batches, mix


@dataclass(frozen=True)
class Limits:
    """Of one sequence."""

    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


class Packer:
    """Fills sequences from a stream of examples (key, length, loss); yields pieces as
    (key, start, length, sequence, offset)."""

    def __init__(self, limits: Limits, pool: int, first_sequence: int):
        self.limits, self.pool, self.next = limits, pool, first_sequence
        self.size = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.keys = np.zeros(pool, np.int64)
        self.start = np.zeros(pool, np.int64)
        self.left = np.zeros(pool, np.int64)
        self.loss = np.zeros(pool, np.int64)
        self.n = 0
        self.open()

    def number(self) -> int:
        self.next += 1
        return self.next - 1

    def open(self) -> None:
        """A new sequence; its number is taken with its first piece."""
        self.sequence, self.used, self.segments, self.bearing = None, 0, 0, 0

    def add(self, key: int, length: int, loss: int) -> Iterator[tuple[int, int, int, int, int]]:
        start, most = 0, self.limits
        while length - start >= most.tokens and min(loss, length - start) - min(loss, length - start - most.tokens) <= most.loss:
            yield key, start, most.tokens, self.number(), 0
            start += most.tokens
        if start == length:
            return
        k = self.n
        self.keys[k], self.start[k], self.left[k], self.loss[k] = key, start, length - start, min(loss, length - start)
        self.n += 1
        while self.n == self.pool:
            yield self.place()

    def flush(self) -> Iterator[tuple[int, int, int, int, int]]:
        while self.n:
            yield self.place()

    def place(self) -> tuple[int, int, int, int, int]:
        """One piece, into the open sequence if anything of the pool goes in there."""
        most = self.limits
        while True:
            left, bears = self.left[: self.n], self.loss[: self.n]
            space = np.array([most.tokens - self.used, most.segments - self.segments, most.loss - self.bearing])
            take = 0
            if space[0] > 0 and space[1] > 0:
                fits = (left <= space[0]) & (bears <= space[2])
                if fits.any():
                    weight = space / self.size**2
                    k = int(np.argmax(np.where(fits, left * weight[0] + weight[1] + bears * weight[2], -1.0)))
                    take = int(left[k])
                else:
                    # The head of an example: tokens before its loss-bearing ones, then as many of those as may be.
                    heads = np.minimum(space[0], left - bears + space[2])
                    k = int(np.argmax(heads))
                    take = int(heads[k])
            if take > 0:
                break
            self.open()
        if self.sequence is None:
            self.sequence = self.number()
        piece = int(self.keys[k]), int(self.start[k]), take, self.sequence, self.used
        rest, loss = int(left[k]) - take, int(bears[k])
        self.used, self.segments, self.bearing = self.used + take, self.segments + 1, self.bearing + loss - min(loss, rest)
        if rest:
            self.start[k], self.left[k], self.loss[k] = self.start[k] + take, rest, min(loss, rest)
        else:
            self.n -= 1
            for column in (self.keys, self.start, self.left, self.loss):
                column[k] = column[self.n]
        return piece


def pack(
    df: DataFrame,
    codec: Callable[[], Codec],
    end_id: int = 0,
    key: str = "doc_id",
    text: str = "text",
    prompt: str | None = None,
    limits: Limits = Limits(),
    pool: int = 256,
) -> DataFrame:
    """Pieces of all texts: key, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    ``codec`` is called on the workers.  ``prompt`` names a text column that comes before ``text`` and
    bears no loss.  The end token closes each example.
    """
    if min(limits.tokens, limits.segments, limits.loss, pool) < 1:
        raise ValueError("limits and pool start at 1")
    own = df.select(F.col(key).alias("key"), F.col(text).alias("text"), (F.col(prompt) if prompt else F.lit(None).cast("string")).alias("prompt"))
    schema = StructType([StructField(key, df.schema[key].dataType)]).add("start", "long").add("length", "long").add("ids", "binary").add("doc_tokens", "long").add("sequence_id", "long").add("offset", "long")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec()
        context = TaskContext.get()
        packer = Packer(limits, pool, (context.partitionId() if context else 0) << 40)
        open_ids: dict[int, tuple[object, np.ndarray, int]] = {}
        serial = 0
        rows: list[tuple] = []

        def written(pieces) -> None:
            for k, start, length, sequence, offset in pieces:
                name, ids, left = open_ids[k]
                rows.append((name, start, length, ids[start : start + length].tobytes(), len(ids), sequence, offset))
                if left == length:
                    del open_ids[k]
                else:
                    open_ids[k] = name, ids, left - length

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

        names = [f.name for f in schema]
        types = None
        for batch in stream:
            types = types or [batch.column("key").type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for part in batches(batch, "text"):
                ids, ends = encoder.encode(part.column("text"))
                head, head_ends = encoder.encode(part.column("prompt")) if prompt else (ids[:0], np.zeros(len(ends), np.int64))
                begin, head_begin = 0, 0
                for name, end, head_end in zip(part.column("key").to_pylist(), ends.tolist(), head_ends.tolist()):
                    whole = np.concatenate([head[head_begin:head_end], ids[begin:end], [end_id]]).astype("<u4")
                    open_ids[serial] = name, whole, len(whole)
                    written(packer.add(serial, len(whole), end - begin + 1))
                    serial, begin, head_begin = serial + 1, end, head_end
                if len(rows) > 2000:
                    yield out()
        written(packer.flush())
        if rows:
            yield out()

    return own.mapInArrow(run, schema)


class Memory:
    """Ids of tokens met before, by two hashes of each, in sorted arrays: tens of bytes a token."""

    def __init__(self):
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The place of each token, or -1."""
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        if not len(self.keys):
            return np.full(len(keys), -1)
        return np.where((self.keys[place] == keys) & (self.checks[place] == checks), place, -1)

    def add(self, keys: np.ndarray, checks: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        at = len(self.ids) + np.cumsum(sizes) - sizes
        order = np.argsort(keys)
        place = np.searchsorted(self.keys, keys[order])
        self.keys, self.checks = np.insert(self.keys, place, keys[order]), np.insert(self.checks, place, checks[order])
        self.at, self.sizes = np.insert(self.at, place, at[order]), np.insert(self.sizes, place, sizes[order])
        self.ids = np.concatenate([self.ids, flat])


def _gathered(flat: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The elements of some stretches of ``flat``, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at - (ends - sizes), sizes)]


#: Above any rank of a merge.
NO_RANK = np.iinfo(np.int64).max


class FileCodec(Codec):
    """Ids by a file of the ``tokenizers`` library (byte-level BPE), the same as that library gives.

    Added tokens (such as an end mark) in a text get their own ids.
    """

    #: Tokens outside the vocabulary that are remembered, twice at most.
    REMEMBERED = 400_000

    def __init__(self, path: str):
        with open(path) as file:
            whole = json.load(file)
        plain = {"add_prefix_space": False, "use_regex": True}
        if whole["normalizer"] or whole["pre_tokenizer"]["type"] != "ByteLevel" or any(whole["pre_tokenizer"].get(k, v) != v for k, v in plain.items()):
            raise ValueError(f"{path} is no plain byte-level file")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in whole["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        self.added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        vocabulary = whole["model"]["vocab"]
        # The vocabulary writes each byte as one printable character.
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        known = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in self.added}
        self.letters = np.array([known[bytes([b])] for b in range(256)], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in whole["model"]["merges"]]
        made = {}
        for rank, (a, b) in enumerate(merges):
            if made.get(vocabulary[a], -1) > rank or made.get(vocabulary[b], -1) > rank or vocabulary[a + b] in made:
                raise ValueError(f"{path} has a merge before the merges of its parts")
            made[vocabulary[a + b]] = rank
        pairs = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in merges], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.pair_ranks = pairs[order], order
        self.pair_ids = np.array([vocabulary[a + b] for a, b in merges], np.int64)[order]
        # A token that its own merges don't lead to isn't found as a whole.
        tokens = list(known)
        ends = np.cumsum([len(t) for t in tokens])
        lengths = np.diff(ends, prepend=0)
        own, sizes = self.merged(np.frombuffer(b"".join(tokens), np.uint8), ends - lengths, lengths)
        heads = own[np.cumsum(sizes) - sizes]
        reached = [t for t, head, n in zip(tokens, heads.tolist(), sizes.tolist()) if n == 1 and head == known[t]]
        super().__init__(reached, np.array([known[t] for t in reached], np.int32), None)
        self.young, self.old = Memory(), Memory()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = [k for mark in self.added for k in np.flatnonzero(pc.match_substring(column, mark).fill_null(False).to_numpy(zero_copy_only=False))]
        if not marked:
            return super().encode(column)
        # Marks cut a text; what is between them is encoded by itself.
        cut = re.compile("(" + "|".join(re.escape(m) for m in sorted(self.added, key=len, reverse=True)) + ")")
        pieces, marks, rows = [], [], []
        for text in column.to_pylist():
            split = cut.split(text or "")
            pieces += split[0::2]
            marks += [*(self.added[m] for m in split[1::2]), -1]
            rows.append(len(pieces))
        ids, ends = super().encode(pa.array(pieces, pa.large_string()))
        marks = np.array(marks)
        at = np.flatnonzero(marks >= 0)
        more = np.concatenate([[0], np.cumsum(marks >= 0)])
        rows = np.array(rows)
        return np.insert(ids, ends[at], marks[at].astype(ids.dtype)), ends[rows - 1] + more[rows]

    def unknown(self, room: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        eight = np.ndarray((len(room) - 8,), "<u8", room, strides=(1,))
        drop = (64 - 8 * np.minimum(lengths, 8)).astype(np.uint64)
        checks = mix((eight[starts] << drop) ^ (eight[starts + np.maximum(lengths - 8, 0)] * np.uint64(5)) + lengths.astype(np.uint64))
        sizes, at, flat = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), []
        left, base = np.arange(len(keys)), 0
        for memory in (self.young, self.old):
            place = memory.find(keys[left], checks[left])
            hit = left[place >= 0]
            sizes[hit], at[hit] = memory.sizes[place[place >= 0]], memory.at[place[place >= 0]] + base
            flat.append(memory.ids)
            base += len(memory.ids)
            left = left[place < 0]
        if len(left):
            own, n = self.merged(room, starts[left], lengths[left])
            sizes[left], at[left] = n, base + np.cumsum(n) - n
            flat.append(own)
            self.young.add(keys[left], checks[left], own, n)
        out = _gathered(np.concatenate(flat), at, sizes)
        if len(self.young.keys) > self.REMEMBERED:
            self.young, self.old = Memory(), self.young
        return out, sizes

    def merged(self, room: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some tokens, all at once: each round merges every token's pair of the lowest rank.

        A merge never makes a pair of a lower rank (checked when the file is read), so all places of the
        lowest one are merged together, from the left.
        """
        part = self.letters[_gathered(room, starts, lengths)]
        owner = np.repeat(np.arange(len(starts)), lengths)
        rank, new = self.ranks_of(part, owner, np.arange(len(part)))
        ids, owners = [], []
        while len(part):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            count = np.diff(first, append=len(owner))
            least = np.repeat(np.minimum.reduceat(rank, first), count)
            live = least < NO_RANK
            ids.append(part[~live])
            owners.append(owner[~live])
            part, owner, rank, new, least = part[live], owner[live], rank[live], new[live], least[live]
            at = np.flatnonzero(rank == least)
            # Of places that overlap, as in a row of equal parts, every other one from the left.
            run = np.flatnonzero(np.diff(at, prepend=-2) > 1)
            nth = np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))
            at = at[nth % 2 == 0]
            part[at] = new[at]
            stays = np.ones(len(part), bool)
            stays[at + 1] = False
            place = np.cumsum(stays) - 1
            part, owner, rank, new = part[stays], owner[stays], rank[stays], new[stays]
            changed = np.unique(np.concatenate([place[at], np.maximum(place[at] - 1, 0)]))
            rank[changed], new[changed] = self.ranks_of(part, owner, changed)
        ids, owners = np.concatenate([*ids, np.zeros(0, np.int64)]), np.concatenate([*owners, np.zeros(0, np.int64)])
        return ids[np.argsort(owners, kind="stable")].astype(np.int32), np.bincount(owners, minlength=len(starts))

    def ranks_of(self, part: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the merge of the parts at and behind each place."""
        then = np.minimum(at + 1, len(part) - 1)
        pair = part[at] << 32 | part[then]
        place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        found = (self.pairs[place] == pair) & (owner[then] == owner[at]) & (then > at)
        return np.where(found, self.pair_ranks[place], NO_RANK), self.pair_ids[place]


@lru_cache(maxsize=2)
def tokenizer_codec(path: str) -> Codec:
    return FileCodec(path)


@lru_cache(maxsize=1)
def _byte_letters() -> list[str]:
    """The printable character of each byte: its own where Latin-1 shows one, else the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    spare = 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


def report(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = pack(df, lambda: tokenizer_codec(path), key=key, text=text, **options)
    return pieces.select(key, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
