"""Byte-level BPE by a rank file: encoding and decoding of whole texts.

Lookup has two tiers.  A minimal perfect hash over the vocabulary (one slot per token, a displacement
per bucket) tells for all tokens of a batch at once which are in the vocabulary as they are; the bytes
are compared, so a foreign token is never taken for a known one.  The rest, each distinct one once per
batch, goes through merges kept in a heap over linked bytes: the lowest rank first, the leftmost of
equals.  Their ids are remembered in a cache of bounded size.

Defined results: null text counts as empty and has no ids; a text of any length is encoded whole;
repeated rows are encoded alike; other columns are returned as they are, but one that
has the name of the added column is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructType

from quire.llm.pretokens import cut_points, pretokens
from quire.llm.words import batches, mix, padded, span_hash, text_bytes

#: A longer text is encoded in pieces of about this many bytes.
LONG_TEXT = 8 << 20
#: Distinct tokens outside the vocabulary whose ids a worker remembers, twice at most.
CACHE = 150_000
#: Ids decoded at once.
SLICE = 400_000


class PerfectHash:
    """A minimal perfect hash of byte strings: ``find`` gives each span's place in the list, or -1."""

    def __init__(self, tokens: list[bytes]):
        n = self.n = len(tokens)
        self.lengths = np.fromiter(map(len, tokens), np.int64, n)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        _, self.eight = padded(np.frombuffer(b"".join(tokens), np.uint8))
        h = span_hash(self.eight, self.offsets, self.lengths)
        if len(np.unique(h)) < n:
            raise ValueError("two tokens have the same hash")
        self.buckets = max(1, n // 4)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.shift = np.zeros(self.buckets, np.int64)
        self.place = np.full(n, -1, np.int64)
        filled = 0
        for b in np.argsort(-sizes, kind="stable"):
            own = order[firsts[b] : firsts[b] + sizes[b]]
            if len(own) < 2:
                break
            base, step = 0, 16 if filled < 0.7 * n else 512
            filled += len(own)
            while True:
                tries = np.arange(base, base + step, dtype=np.int64)
                slots = self._slots(h[own][None, :], tries[:, None])
                good = (self.place[slots] < 0).all(1)
                for k in np.flatnonzero(good):
                    if len(set(slots[k].tolist())) == len(own):
                        self.shift[b], self.place[slots[k]] = tries[k], own
                        break
                else:
                    base += step
                    continue
                break
        # A bucket of one token names one of the slots that are left.
        single = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(self.place < 0)[: len(single)]
        self.shift[single], self.place[free] = -1 - free, order[firsts[single]]

    def _slots(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(h ^ (shift.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))) % np.uint64(self.n)).astype(np.int64)

    def find(self, h: np.ndarray, eight: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        found = self.place[np.where(shift < 0, -1 - shift, self._slots(h, shift))]
        live = np.flatnonzero(self.lengths[found] == lengths)
        ok, k = np.zeros(len(h), bool), 0
        ok[live] = True
        while len(live):
            left = np.minimum(lengths[live] - k, 8).astype(np.uint64)
            drop = (np.uint64(64) - left * np.uint64(8)) & np.uint64(63)
            same = (eight[starts[live] + k] << drop) == (self.eight[self.offsets[found[live]] + k] << drop)
            ok[live[~same]] = False
            k += 8
            live = live[same]
            live = live[lengths[live] > k]
        return np.where(ok, found, -1)


class Merges:
    """Merges of neighbouring parts: every way to put a token together from two others."""

    def __init__(self, ranks: dict[bytes, int]):
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.wide = max(ranks.values()) + 1
        self.pairs = {
            ranks[t[:k]] * self.wide + ranks[t[k:]]: r
            for t, r in ranks.items()
            for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks
        }

    def ids(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one token: merges by rank, taken from a heap, over a linked list of its bytes.

        A heap entry holds rank and place as one number; it is stale if the place's pair has changed.
        """
        n, wide, pair = len(piece), self.wide, self.pairs.get
        part = [self.single[b] for b in piece]
        rank = [pair(a * wide + b, -1) for a, b in zip(part, part[1:])]
        rank.append(-1)
        heap = [r * n + i for i, r in enumerate(rank) if r >= 0]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while heap:
            r, i = divmod(heappop(heap), n)
            if rank[i] != r:
                continue
            gone = after[i]
            to = after[i] = after[gone]
            part[i], rank[gone] = r, -1
            before[to] = i
            rank[i] = -1
            if to < n and (q := pair(r * wide + part[to], -1)) >= 0:
                rank[i] = q
                heappush(heap, q * n + i)
            left = before[i]
            if left >= 0:
                rank[left] = q = pair(part[left] * wide + r, -1)
                if q >= 0:
                    heappush(heap, q * n + left)
        out, i = [], 0
        while i < n:
            out.append(part[i])
            i = after[i]
        return tuple(out)


class Codec:
    """Encodes batches of text; ``rest`` gives the ids of distinct tokens outside the vocabulary."""

    def __init__(self, tokens: list[bytes], ids: np.ndarray, rest):
        self.hash, self.ids, self.rest = PerfectHash(tokens), ids, rest
        self.fresh: dict[bytes, tuple[int, ...]] = {}
        self.stale: dict[bytes, tuple[int, ...]] = {}

    def known(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        fresh, stale = self.fresh, self.stale
        out = [fresh.get(p) or stale.get(p) for p in pieces]
        new = [k for k, x in enumerate(out) if x is None]
        for k, ids in zip(new, self.rest([pieces[k] for k in new])):
            out[k] = fresh[pieces[k]] = ids
        if len(fresh) > CACHE:
            self.fresh, self.stale = {}, fresh
        return out

    def unknown(self, room: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, one after the other, and their numbers, of distinct tokens outside the vocabulary."""
        raw = room.tobytes()
        lists = self.known([raw[a:b] for a, b in zip(starts.tolist(), (starts + lengths).tolist())])
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and where each row's ids end."""
        data, ends = text_bytes(column)
        if len(ends) == 1 and len(data) > LONG_TEXT:
            text = data.tobytes()
            cuts = [0, *cut_points(text, LONG_TEXT), len(text)]
            parts = [self._encode(np.frombuffer(text[a:b], np.uint8), np.array([b - a]))[0] for a, b in zip(cuts, cuts[1:])]
            ids = np.concatenate(parts)
            return ids, np.array([len(ids)])
        return self._encode(data, ends)

    def _encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, lengths, token_ends, room, eight = pretokens(data, ends)
        if not len(starts):
            return np.zeros(0, np.int32), token_ends
        h = span_hash(eight, starts, lengths)
        place = self.hash.find(h, eight, starts, lengths)
        miss = np.flatnonzero(place < 0)
        count = np.ones(len(starts), np.int64)
        if len(miss):
            # Spans of one batch count as the same token if hash, length and both ends agree.
            tail = eight[starts[miss] + np.maximum(lengths[miss] - 8, 0)]
            key = mix(h[miss] ^ (eight[starts[miss]] * np.uint64(3) + tail) ^ lengths[miss].astype(np.uint64))
            _, first, which = np.unique(key, return_index=True, return_inverse=True)
            flat, sizes = self.unknown(room, starts[miss[first]], lengths[miss[first]], key[first])
            list_at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            count[miss] = sizes[which]
        out_ends = np.cumsum(count)
        out = np.empty(int(out_ends[-1]), np.int32)
        hit = np.flatnonzero(place >= 0)
        out[out_ends[hit] - 1] = self.ids[place[hit]]
        if len(miss):
            n = count[miss]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(out_ends[miss] - n, n) + step] = flat[np.repeat(list_at[which], n) + step]
        return out, np.concatenate([[0], out_ends])[token_ends]


def rank_file(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@lru_cache(maxsize=2)
def rank_codec(path: str) -> Codec:
    ranks = rank_file(path)
    merges = Merges(ranks).ids
    return Codec(list(ranks), np.fromiter(ranks.values(), np.int32, len(ranks)), lambda pieces: [merges(p) for p in pieces])


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens in a row, and by id where each starts and how long it is (0: no token)."""
    ranks = rank_file(path)
    lengths = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
    by_id = [b""] * len(lengths)
    for token, rank in ranks.items():
        by_id[rank] = token
        lengths[rank] = len(token)
    return np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(lengths) - lengths, lengths


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids``: the token ids of ``text`` by the rank file at ``path`` (a file of each worker)."""
    df = df.drop(ids)
    schema = StructType(df.schema.fields[:]).add(ids, ArrayType(IntegerType()))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = rank_codec(path)
        for batch in stream:
            for part in batches(batch, text):
                found, ends = codec.encode(part.column(text))
                column = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(found))
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the bytes that ``ids`` stand for (null: none).  An id without a token is an error."""
    df = df.drop(out)
    schema = StructType(df.schema.fields[:]).add(out, "binary")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, offsets, lengths = token_bytes(path)
        for batch in stream:
            sizes = batch.column(ids).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, at = np.cumsum(sizes), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
                part = batch.slice(at, to - at)
                flat = part.column(ids).flatten().to_numpy(zero_copy_only=False)
                known = (flat >= 0) & (flat < len(lengths))
                if not known.all() or not lengths[flat].all():
                    raise ValueError(f"an id stands for no token of {path}")
                n = lengths[flat]
                stops = np.cumsum(n)
                place = np.arange(int(n.sum())) + np.repeat(offsets[flat] - (stops - n), n)
                row_ends = np.concatenate([[0], stops])[np.cumsum(sizes[at:to])]
                buffers = [None, pa.py_buffer(np.concatenate([[0], row_ends]).astype(np.int32)), pa.py_buffer(table[place])]
                texts = pa.Array.from_buffers(pa.binary(), to - at, buffers)
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, out])
                at = to

    return df.mapInArrow(run, schema)
