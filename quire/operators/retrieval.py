"""Per-question top-k retrieval inside one subject, and reranking of the hits.

Exact nearest neighbours compare every question with every chunk of its subject; that work cannot
be avoided for exact results, but no pair is ever emitted as a row.  Questions and chunks are cut
into blocks of a bounded size inside each subject, each pair of blocks is one group, and a group
returns at most k rows per question.  A subject that holds a third of all chunks is therefore just
more blocks, and the final ranking is a per-question limit that Spark applies before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.arrays import let
from quire.functions.tokens import keywords
from quire.session import cut_lineage

QUERY_BLOCK = 2048
CHUNK_BLOCK = 1 << 15
UNKNOWN_FLAG = 1 << 62


# --- flags --------------------------------------------------------------------------------


def flag_mask(flags: Sequence[str]) -> Column:
    """Boolean section columns of a chunk as one bit set."""
    total = F.lit(0).cast("bigint")
    for i, name in enumerate(flags):
        total = total + F.when(F.coalesce(F.col(name), F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
    return total


def names_mask(names: Column, flags: Sequence[str]) -> Column:
    """Section names of a filter as one bit set over the same flag order.

    Names without a flag column match no chunk; a reserved bit keeps such a filter from looking
    like an empty one.
    """
    total = F.when(F.size(names) > 0, F.lit(UNKNOWN_FLAG)).otherwise(F.lit(0)).cast("bigint")
    for i, name in enumerate(flags):
        total = total + F.when(F.array_contains(names, name), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
    return total


def metadata_filter(chunks: DataFrame, names: Sequence[str]) -> DataFrame:
    """Chunks that carry any of the named section flags; no names keeps everything."""
    cond = None
    for name in names:
        hit = F.coalesce(F.col(name), F.lit(False))
        cond = hit if cond is None else cond | hit
    return chunks if cond is None else chunks.filter(cond)


# --- nearest neighbours -------------------------------------------------------------------


def _blocks_per_subject(df: DataFrame, size: int, name: str) -> DataFrame:
    """Number of blocks of each subject, as a table that is joined whatever its length."""
    return df.groupBy("subject").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))


def _vectors(col) -> np.ndarray:
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(arr), -1) if len(arr) else flat.reshape(0, 1)


_HITS = pa.schema(
    [("qid", pa.string()), ("chunk_id", pa.string()), ("distance", pa.float64()), ("flags_mask", pa.int64()), ("top_k", pa.int64())]
)
#: Rows of a block that are compared at once; only they are held in double precision.
QUERY_SLICE, CHUNK_SLICE = 256, 2048
#: Pairs whose exact distance is computed at once; more come up only where many distances are equal.
PAIR_SLICE = 1 << 14


def _block_topk(queries: pa.Table, chunks: pa.Table) -> pa.Table:
    """Best k chunks of one block for every question of one block.

    Questions with a ``bound`` (the distance that a chunk may have at most, not squared) and a ``home`` (a ball
    whose chunks they know already) get the other chunks within their bound.
    """
    if queries.num_rows == 0 or chunks.num_rows == 0:
        return _HITS.empty_table()
    # In the order of ids a later chunk at an equal distance never comes first.
    chunks = chunks.take(pc.sort_indices(chunks["chunk_id"]))
    q = _vectors(queries["qvec"])
    k = queries["top_k"].to_numpy()
    want = queries["want_mask"].to_numpy()
    have = chunks["flags_mask"].to_numpy()
    bounded = "bound" in queries.column_names
    bound = queries["bound"].to_numpy() ** 2 if bounded else np.full(len(q), np.inf)
    home, ball = (queries["home"].to_numpy(), chunks["ball"].to_numpy()) if bounded else (None, None)
    asked = np.einsum("ij,ij->i", q, q)
    found = []
    for lo in range(0, len(q), QUERY_SLICE):
        some = slice(lo, lo + QUERY_SLICE)
        best = _Best(q[some], k[some])
        ws, kmax = want[some][:, None], int(k[some].max())
        for at in range(0, chunks.num_rows, CHUNK_SLICE):
            part = slice(at, at + CHUNK_SLICE)
            c = _vectors(chunks["embedding"].slice(at, CHUNK_SLICE))
            norms = np.einsum("ij,ij->i", c, c)
            d = best.q @ c.T
            d *= -2.0
            d += asked[some][:, None]
            d += norms
            if ws.any():
                d[(ws != 0) & ((ws & have[part]) == 0)] = np.inf
            if bounded:
                d[home[some][:, None] == ball[part]] = np.inf
            slack = 1e-9 * (1.0 + asked[some] + norms.max())
            near = (d <= (np.minimum(bound[some], best.edge) + slack)[:, None]) & np.isfinite(d)
            many = np.nonzero(np.count_nonzero(near, axis=1) > kmax)[0]
            if len(many):
                edge = np.partition(d[many], kmax - 1, axis=1)[:, kmax - 1]
                near[many] &= d[many] <= (edge + slack[many])[:, None]
            r, j = np.nonzero(near)
            for i in range(0, len(r), PAIR_SLICE):
                best.add(r[i : i + PAIR_SLICE], j[i : i + PAIR_SLICE], c, at)
        found.append((best.r + lo, best.j, best.exact))
    r, j, exact = (np.concatenate([f[i] for f in found]) for i in range(3))
    columns = [queries["qid"].take(pa.array(r)), chunks["chunk_id"].take(pa.array(j)), pa.array(exact), pa.array(have[j]), pa.array(k[r])]
    return pa.table(columns, schema=_HITS)


class _Best:
    """The best k chunks so far of a slice of questions; ``edge`` is the distance of the k-th, infinite before there are k."""

    def __init__(self, q: np.ndarray, k: np.ndarray):
        self.q, self.k = q, k
        self.edge = np.full(len(q), np.inf)
        self.r = self.j = np.empty(0, np.int64)
        self.exact = np.empty(0)

    def add(self, r: np.ndarray, j: np.ndarray, c: np.ndarray, at: int) -> None:
        """Take in pairs of a question and a row of ``c``, the chunks from ``at`` on; chunks come in ascending order."""
        diff = self.q[r]
        diff -= c[j]
        exact = np.einsum("ij,ij->i", diff, diff)
        closer = exact < self.edge[r]
        if not closer.any():
            return
        r, j = np.concatenate([self.r, r[closer]]), np.concatenate([self.j, j[closer] + at])
        exact = np.concatenate([self.exact, exact[closer]])
        order = np.lexsort((j, exact, r))
        r, j, exact = r[order], j[order], exact[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        keep = place < self.k[r]
        self.r, self.j, self.exact = r[keep], j[keep], exact[keep]
        last = place == self.k[r] - 1
        self.edge[r[last]] = exact[last]


def knn_topk(
    questions: DataFrame,
    chunks: DataFrame,
    k: int | str = "top_k",
    filter_names: str | None = None,
    flags: Sequence[str] = (),
    query_block: int = QUERY_BLOCK,
    chunk_block: int = CHUNK_BLOCK,
) -> DataFrame:
    """``(qid, chunk_id, distance, flags_mask, rank)``: squared L2, ascending, ties by chunk id.

    ``k`` is a number or the name of a per-question column; ``filter_names`` names an array column
    of section flags of which a chunk must carry at least one (an empty array accepts all).
    """
    top_k = F.lit(k) if isinstance(k, int) else F.col(k)
    want = names_mask(F.col(filter_names), flags) if filter_names else F.lit(0).cast("bigint")
    q = questions.filter(F.col("qvec").isNotNull()).select(
        "qid", F.col("subject").alias("subject"), "qvec", top_k.cast("bigint").alias("top_k"), want.alias("want_mask")
    ).filter(F.col("top_k") > 0)
    c = chunks.filter(F.col("embedding").isNotNull()).select(
        "chunk_id", "subject", "embedding", flag_mask(flags).alias("flags_mask")
    )
    blocks = _blocks_per_subject(q, query_block, "__nq").join(_blocks_per_subject(c, chunk_block, "__nc"), "subject")
    spread = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    nq, nc = F.col("__nq"), F.col("__nc")
    qb = q.join(blocks, "subject").withColumn("__qb", spread("qid", nq)).withColumn("__cb", every(nc)).drop("__nq", "__nc")
    cb = c.join(blocks, "subject").withColumn("__cb", spread("chunk_id", nc)).withColumn("__qb", every(nq)).drop("__nq", "__nc")
    keys = ["subject", "__qb", "__cb"]
    near = (
        qb.groupBy(*keys)
        .cogroup(cb.groupBy(*keys))
        .applyInArrow(_block_topk, "qid string, chunk_id string, distance double, flags_mask bigint, top_k bigint")
    )
    most = k if isinstance(k, int) else (q.agg(F.max("top_k")).first()[0] or 0)
    return ranked_hits(near, most).drop("top_k")


def ranked_hits(near: DataFrame, most: int) -> DataFrame:
    """The best ``top_k`` hits of each question with their rank; ``most`` is the largest k.

    As a constant it lets Spark cut every question before the shuffle.
    """
    order = Window.partitionBy("qid").orderBy("distance", "chunk_id")
    ranked = near.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= most).filter(F.col("rank") <= F.col("top_k"))


# --- reranking ----------------------------------------------------------------------------


def metadata_boost(hits: DataFrame, flags: Sequence[str], factor: float = 0.67) -> DataFrame:
    """Shrink the distance of chunks that match target sections and order matches first.

    Needs ``target_sections`` and ``flags_mask`` on the hits.  Questions without targets keep
    their order.
    """
    if not 0.0 < factor <= 1.0:
        raise ValueError("factor must be in (0, 1]")
    matches = F.bit_count(F.col("flags_mask").bitwiseAND(names_mask(F.col("target_sections"), flags))).cast("int")
    adjusted = hits.withColumn("matches", matches).withColumn(
        "boosted", F.col("distance") * F.pow(F.lit(factor), F.col("matches"))
    )
    order = Window.partitionBy("qid").orderBy(F.desc("matches"), F.asc_nulls_last("boosted"), "rank")
    return adjusted.withColumn("boost_rank", F.row_number().over(order))


def heuristic_rerank(
    hits: DataFrame,
    flags: Sequence[str],
    rank_col: str,
    required: str | None = "required_categories",
    top_n: int | None = None,
    section_boost: float = 1.0,
    keyword_boost: float = 0.5,
) -> DataFrame:
    """Score hits by required sections and question keywords found in the chunk text.

    The score is divided by the logarithm of the text length; equal scores keep their order.
    """
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    found = let(text, lambda t: F.size(F.filter(keywords(F.col("question_text")), lambda w: F.contains(t, w))))
    if required is None:
        section = F.lit(False)
    else:
        section = F.col("flags_mask").bitwiseAND(names_mask(F.col(required), flags)) != 0
    length = F.length(F.coalesce(F.col("text"), F.lit("")))
    scored = hits.withColumns({"keyword_matches": found, "section_match": section})
    score = (
        F.when(F.col("section_match"), F.lit(section_boost)).otherwise(F.lit(0.0))
        + F.col("keyword_matches") * F.lit(keyword_boost)
    ) / F.greatest(F.lit(1.0), F.log(length + F.lit(math.e)))
    scored = scored.withColumn("score", score)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), rank_col)
    out = scored.withColumn("rerank", F.row_number().over(order))
    if top_n is None:
        return out
    return out.filter(F.col("rerank") <= max(top_n, 0))


def identity_rerank(hits: DataFrame, rank_col: str = "rank", top_n: int | None = None) -> DataFrame:
    """Input order; a non-positive ``top_n`` means no truncation."""
    return hits if top_n is None or top_n <= 0 else hits.filter(F.col(rank_col) <= top_n)


def truncate_top_n(hits: DataFrame, top_n: int, rank_col: str = "rank") -> DataFrame:
    """First ``top_n`` hits, none for a non-positive number."""
    return hits.filter(F.col(rank_col) <= max(top_n, 0))


# --- evidence, probes, context ------------------------------------------------------------


def section_evidence(spec: DataFrame, questions: DataFrame, chunks: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Nearest chunks of every blueprint section, at most ``max_chunks``, and whether they suffice."""
    key = F.concat_ws("#", "qid", F.col("section_no").cast("string"))
    wanted = spec.filter(F.col("filter_name").isNotNull()).withColumn("skey", key)
    asked = wanted.select("skey", "qid", "subject", "max_chunks", "filter_name")
    probes = asked.join(questions.select("qid", "qvec"), "qid").select(
        F.col("skey").alias("qid"), "subject", "qvec", F.col("max_chunks").alias("top_k"), F.array("filter_name").alias("names")
    )
    hits = knn_topk(probes, chunks, "top_k", "names", flags).withColumnRenamed("qid", "skey")
    per_section = hits.groupBy("skey").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("__best"),
    )
    joined = wanted.join(per_section, "skey", "left")
    return joined.withColumns(
        {
            "n_chunks": F.coalesce("n_chunks", F.lit(0)).cast("bigint"),
            "chunk_ids": F.coalesce(F.array_join(F.transform("__best", lambda b: b["chunk_id"]), ","), F.lit("")),
            "satisfied": F.coalesce("n_chunks", F.lit(0)) >= F.col("min_chunks"),
        }
    ).drop("__best", "skey")


def retrieval_probe(probes: DataFrame, chunks: DataFrame, books: DataFrame, k: int = 5) -> DataFrame:
    """Per book: hits of its subject's probe, and how many of them come from the book."""
    hits = knn_topk(probes, chunks, k)
    owners = chunks.select("chunk_id", F.col("book_id").alias("__book"))
    by_probe = probes.select("qid", "subject").join(hits, "qid").join(owners, "chunk_id")
    totals = by_probe.groupBy("subject").agg(F.count(F.lit(1)).alias("hits"))
    own = by_probe.groupBy("subject", F.col("__book").alias("book_id")).agg(F.count(F.lit(1)).alias("from_book"))
    return (
        books.join(totals, "subject", "left")
        .join(own, ["subject", "book_id"], "left")
        .withColumns({"hits": F.coalesce("hits", F.lit(0)), "from_book": F.coalesce("from_book", F.lit(0))})
    )


def mean_hit_distance(hits: DataFrame) -> DataFrame:
    return hits.groupBy("qid").agg(F.avg("distance").alias("mean_distance"))


def word_band(marks: Column, target: Column) -> tuple[Column, Column]:
    """Lower and upper word limits stated in a prompt."""
    low = F.when(marks <= 3, F.floor(target * 0.70)).when(marks <= 5, F.floor(target * 0.64)).otherwise(F.floor(target * 0.70))
    high = F.when(marks <= 3, F.floor(target * 1.10)).when(marks <= 5, F.floor(target * 1.18)).otherwise(F.floor(target * 1.12))
    return low.cast("bigint"), high.cast("bigint")


def build_context(hits: DataFrame, rank_col: str, max_chunks: int = 8, max_chars: int = 2500) -> DataFrame:
    """Joined text of the best hits per question; at most ``max_chunks`` pieces of ``max_chars``."""
    cut = hits.filter(F.col(rank_col) <= max_chunks).select(
        "qid", F.col(rank_col).alias("r"), F.substring(F.coalesce("text", F.lit("")), 1, max_chars).alias("t")
    )
    parts = cut.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("r", "t"))).alias("__p"))
    texts = F.transform("__p", lambda p: p["t"])
    return parts.select("qid", F.array_join(texts, "\n\n---\n\n").alias("context"), F.size("__p").alias("n_chunks"))


def with_text(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the text of their chunks; only texts of chunks that were hit are moved."""
    hits = cut_lineage(hits)
    texts = chunks.select("chunk_id", "text").join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return hits.join(texts, "chunk_id", "left")


def multipart_floor(marks: Column, target: Column, multipart: Column) -> Column:
    """Words each part of a long multi-part question should reach, else null."""
    return F.when((marks >= 10) & multipart, F.greatest(F.lit(180), F.floor(target * 0.28)).cast("bigint"))


def retrieve(
    planned: DataFrame,
    chunks: DataFrame,
    flags: Sequence[str],
    semantic: str | Callable[[DataFrame], DataFrame] = "identity",
    top_n: int | None = None,
    nearest: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Ranked hits for planned questions: filtered neighbours, metadata boost, semantic rerank.

    ``nearest`` finds the neighbours of planned questions in another way than ``knn_topk`` over all chunks, such as
    ``balls.ball_topk`` with an index.

    ``planned`` carries qid, subject, qvec, question_text, target_sections, top_k, filter_names and,
    for the heuristic reranker, optionally required_categories.  A reranker of one's own is a
    function from hits (with ``boost_rank`` and chunk text) to hits with ``final_rank``.
    """
    hits = nearest(planned) if nearest else knn_topk(planned, chunks, "top_k", "filter_names", flags)
    wanted = [c for c in ("question_text", "target_sections", "top_k", "filter_names", "required_categories") if c in planned.columns]
    info = planned.select("qid", *wanted)
    boosted = metadata_boost(hits.join(info, "qid"), flags)
    if semantic == "identity":
        out = identity_rerank(boosted, "boost_rank", top_n).withColumn("final_rank", F.col("boost_rank"))
    elif callable(semantic):
        out = semantic(with_text(boosted, chunks))
        out = out if top_n is None else out.filter(F.col("final_rank") <= max(top_n, 0))
    elif semantic == "heuristic":
        required = "required_categories" if "required_categories" in wanted else None
        out = heuristic_rerank(with_text(boosted, chunks), flags, "boost_rank", required, top_n).withColumn("final_rank", F.col("rerank"))
    else:
        raise ValueError(f"unknown reranker {semantic!r}")
    return out.withColumn("filter_active", F.size("filter_names") > 0)


