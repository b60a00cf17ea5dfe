"""Periodic runs of words in texts, found by recursive frequency splitting, and texts without repeats.

A run is a longest stretch of consecutive words with smallest period q that is at least ``least`` words and
``times`` periods long.  So each of its words occurs at least ``times`` times in it.  A word that occurs
fewer times within the current segment (at first the whole text) can be in no run: it splits the segment,
and the parts are looked at again, until nothing splits or nothing is left.  Parts shorter than
``least`` are dropped.  A part that lost less than 1 in ``SHRINK`` words is not split again but scanned as it
is, which bounds the rounds and changes no result.

The segments that are left are scanned for lags, w = 1, 2, 4, ... at a time.  Where the next place at which
the w words from i on stand again is i + q with w/2 < q <= w, the words from i to i + q + w have period q
and no smaller one; consecutive such i with the same q make up one run, as long as it goes.  Windows of w words
are named exactly (a name of 2w words is a pair of names of w words), a window that stands once is not
looked at again, so a lag costs nothing where nothing repeats and the scan takes n log n.

Words get numbers by 64-bit hash; their bytes are compared, so no two words share a number.

Defined results: null text has no words and no runs, and collapses to an empty text; a text of any length is
scanned whole; repeated rows and null ids are rows like any other; other columns are returned as they
are, but those that have the name of an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructType

from quire.llm.words import batches, word_hashes

SHRINK = 16
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all words of a batch (equal where the words are), where each row's words end, and the spans."""
    hashes, ends, room, starts, lengths = word_hashes(column)
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    like = first[number]
    eight = np.ndarray((len(room) - 8,), "<u8", room, strides=(1,))
    same = lengths[like] == lengths
    left, k = np.flatnonzero(same), 0
    while len(left):
        drop = (64 - 8 * np.minimum(lengths[left] - k, 8)).astype(np.uint64)
        same[left] &= (eight[starts[left] + k] << drop) == (eight[starts[like[left]] + k] << drop)
        k += 8
        left = left[lengths[left] > k]
    if not same.all():
        raw, seen = room.tobytes(), {}
        spans = zip(starts.tolist(), (starts + lengths).tolist())
        number = np.fromiter((seen.setdefault(raw[a:b], len(seen)) for a, b in spans), np.int64, len(starts))
    return number, ends, room, starts, lengths


def _spread(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of some segments, and the segment of each."""
    of = np.repeat(np.arange(len(starts)), lengths)
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + (starts - (ends - lengths))[of], of


def segments(number: np.ndarray, ends: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches that may hold runs."""
    starts, lengths = np.concatenate([[0], ends[:-1]]).astype(np.int64), np.diff(ends, prepend=0)
    big = lengths >= least
    starts, lengths = starts[big], lengths[big]
    wide = int(number.max()) + 1 if len(number) else 1
    done = [(starts[:0], lengths[:0])]
    while len(starts):
        places, of = _spread(starts, lengths)
        _, kind, count = np.unique(of * wide + number[places], return_inverse=True, return_counts=True)
        stays = np.flatnonzero(count[kind] >= times)
        if not len(stays):
            break
        new = np.ones(len(stays), bool)
        new[1:] = (np.diff(stays) > 1) | (np.diff(of[stays]) > 0)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(stays)))
        parent = lengths[of[stays[first]]]
        at = places[stays[first]]
        big = size >= least
        at, size, parent = at[big], size[big], parent[big]
        again = size * SHRINK <= parent * (SHRINK - 1)
        done.append((at[~again], size[~again]))
        starts, lengths = at[again], size[again]
    return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


def runs_of(number: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs inside the segments."""
    found = [tuple(np.zeros(0, np.int64) for _ in range(3))]
    places, of = _spread(starts, lengths)
    if not len(places):
        return found[0]
    # name[k]: which windows of w words are alike within a segment; -1 where there is no other like it.
    _, name = np.unique(of * (int(number.max()) + 1) + number[places], return_inverse=True)
    alive, w = np.arange(len(places)), 1
    while len(alive):
        order = np.argsort(name[alive], kind="stable")
        at = alive[order]
        twin = name[at[1:]] == name[at[:-1]]
        lag = np.zeros(len(name), np.int64)
        lag[at[:-1][twin]] = np.diff(at)[twin]
        hit = np.flatnonzero((lag > w // 2) & (lag <= w))
        if len(hit):
            new = np.ones(len(hit), bool)
            new[1:] = (np.diff(hit) > 1) | (np.diff(lag[hit]) != 0) | (np.diff(of[hit]) > 0)
            first = np.flatnonzero(new)
            period = lag[hit[first]]
            length = np.diff(np.append(first, len(hit))) - 1 + w + period
            fits = (length >= least) & (length >= times * period)
            found.append((places[hit[first[fits]]], length[fits], period[fits]))
        # Windows of 2w words: both halves have a twin, and the segment has room for a longer period.
        repeats = np.zeros(len(at), bool)
        repeats[1:] = twin
        repeats[:-1] |= twin
        other = np.full(len(name) + w, -1, np.int64)
        other[at[repeats]] = name[at[repeats]]
        alive = np.sort(at[repeats])
        inside = alive + w < len(name)
        alive = alive[inside]
        alive = alive[(other[alive + w] >= 0) & (of[alive + w] == of[alive]) & (lengths[of[alive]] >= times * (w + 1))]
        pair = other[alive] * len(name) + other[alive + w]
        name = np.full(len(name), -1, np.int64)
        name[alive] = np.unique(pair, return_inverse=True)[1]
        w *= 2
    return tuple(np.concatenate(c) for c in zip(*found))


def collapse(df: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", least: int = 24, times: int = 3) -> DataFrame:
    """Adds ``runs`` (start, length, period in words, by start, then period) and ``collapsed``: the words
    joined by one blank, without those that a run holds after its first period."""
    if times < 3 or least < 1:
        raise ValueError("a run has three periods at least: a lag is found by windows of up to twice its length")
    df = df.drop(runs, collapsed)
    schema = StructType(df.schema.fields[:]).add(runs, from_arrow_type(pa.list_(RUN))).add(collapsed, "string")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for part in batches(batch, text):
                number, ends, room, starts, lengths = word_numbers(part.column(text))
                start, length, period = runs_of(number, *segments(number, ends, least, times), least, times)
                order = np.lexsort((period, start))
                start, length, period = start[order], length[order], period[order]
                row = np.searchsorted(ends, start, side="right")
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                fields = [pa.array(start - begins[row]), pa.array(length), pa.array(period)]
                offsets = np.searchsorted(row, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.StructArray.from_arrays(fields, fields=list(RUN)))
                edges = np.zeros(len(number) + 1, np.int64)
                np.add.at(edges, start + period, 1)
                np.add.at(edges, start + length, -1)
                stays = np.cumsum(edges[:-1]) == 0
                yield pa.RecordBatch.from_arrays([*part.columns, lists, _joined(room, starts, lengths, ends, stays)], [*part.schema.names, runs, collapsed])

    return df.mapInArrow(run, schema)


def _joined(room: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ends: np.ndarray, stays: np.ndarray) -> pa.Array:
    """The words of each row that stay, joined by one blank."""
    raw = room.tobytes()
    at, to, keep = starts.tolist(), (starts + lengths).tolist(), stays.tolist()
    out, begin = [], 0
    for end in ends.tolist():
        spans = compress(zip(at[begin:end], to[begin:end]), keep[begin:end])
        out.append(b" ".join([raw[a:b] for a, b in spans]))
        begin = end
    return pa.array(out, pa.binary()).cast(pa.string())


