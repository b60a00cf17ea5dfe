"""Merkle manifest of a dataset: a SHA-256 tree over its rows whose parents keep hash states.

Rows become leaves (digest of chosen fields); per group (source) the leaves, in order, are hashed in
threes, level by level, up to a subroot; the groups' subroots, in order, likewise up to the root.  A parent
retains a copied hash state before each child slot.  Folding a replaced child resumes the state of its slot
with the replacement and the siblings to its right only; what stands left of it isn't hashed again.

The tree is cut into blocks of ``ARITY ** height`` consecutive nodes, each built in one task in memory of that
size; the tops of the blocks are the leaves of the next pass, so a group of any size is spread and the
passes are as many as its size has digits.  At last every block meets its own way to the root once,
hashes what stands left on it once, and folds its rows.

Digests are lower-case hex text, also where they are hashed.  Defined results: a null field counts as ``-``;
a null group is a group, the first one; null ids come first in a group; rows alike in group and id are
leaves of their own, ordered by digest; an empty table has no rows; a text of any length is hashed whole;
columns that are not named take no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.llm.order import numbered
from quire.llm.tables import keep, parts

ARITY = 3
#: Levels of a block.
HEIGHT = 6
PATH = "array<struct<left:string,right:string>>"
NO_PATH = f"cast(array() as {PATH}) as path"


def leaf(*fields: Column) -> Column:
    """Digest of a row: each field as ``-`` if null, else its UTF-8 length, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    stamped = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.encode(F.concat(*stamped), "utf-8"), 256)


class Parent:
    """A node of up to ARITY children that can be computed anew from any one of them."""

    __slots__ = ("children", "states", "digest")

    def __init__(self, children: Sequence[str]):
        self.children, self.states, state = children, [], sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def folded(self, slot: int, replacement: str) -> str:
        state = self.states[slot].copy()
        state.update("".join((replacement, *self.children[slot + 1 :])).encode())
        return state.hexdigest()

    def around(self, slot: int) -> tuple[str, str]:
        """What stands left and right of a child."""
        return "".join(self.children[:slot]), "".join(self.children[slot + 1 :])


class Block:
    """The levels of parents over some nodes: ``height`` of them if the tree (of n nodes) is larger than the
    block, else up to a single node."""

    def __init__(self, values: list[str], n: int, height: int):
        self.levels: list[list[Parent]] = []
        while len(self.levels) < height if n > ARITY**height else len(values) > 1:
            parents = [Parent(values[k : k + ARITY]) for k in range(0, len(values), ARITY)]
            self.levels.append(parents)
            values = [p.digest for p in parents]
        self.top = values[0]

    def way(self, k: int) -> Iterator[tuple[Parent, int]]:
        """The parents above node ``k`` and the slot it comes from, upwards."""
        for level in self.levels:
            k, slot = divmod(k, ARITY)
            yield level[k], slot


class Way:
    """The nodes above a block: the state left of the slot is hashed once, then resumed for each row."""

    def __init__(self, path: list[dict]):
        self.steps = []
        for step in path:
            state = sha256(step["left"].encode())
            self.steps.append((state, step["right"]))
        self.siblings = "".join(s["left"] + s["right"] for s in path)

    def folded(self, value: str) -> str:
        for before, right in self.steps:
            state = before.copy()
            state.update((value + right).encode())
            value = state.hexdigest()
        return value


def _rows(stream: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    return chain.from_iterable(batch.to_pylist() for batch in stream)


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("idx") / ARITY**height).cast("long"))


def tops(nodes: DataFrame, height: int) -> DataFrame:
    """The nodes (grp, idx, n, value) ``height`` levels above, or the only one of a group of one block."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (grp, block), rows in groupby(_rows(stream), key=lambda r: (r["grp"], r["block"])):
            rows = list(rows)
            n = rows[0]["n"]
            top = Block([r["value"] for r in rows], n, height).top
            yield pa.RecordBatch.from_pylist([{"grp": grp, "idx": block, "n": -(-n // ARITY**height), "value": top}], schema=out)

    kind = nodes.schema["grp"].dataType
    out = pa.schema([("grp", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("value", pa.string())])
    dealt = _blocks(nodes.select(F.col("grp").cast("string"), "idx", "n", "value"), height).repartition(parts(nodes.sparkSession), "grp", "block")
    return dealt.sortWithinPartitions("grp", "block", "idx").mapInArrow(run, "grp string, idx long, n long, value string").withColumn("grp", F.col("grp").cast(kind))


def _with_way(nodes: DataFrame, above: DataFrame, carried: Sequence[str], height: int) -> DataFrame:
    """Rows of ``nodes`` behind one row of ``above`` for each block, which has its path and ``carried``."""
    own = _blocks(nodes, height).withColumn("behind", F.lit(1))
    head = above.withColumn("block", F.col("idx")).withColumn("behind", F.lit(0)).drop("idx")
    return (
        own.unionByName(head.select("grp", "block", "behind", "path", *carried), allowMissingColumns=True)
        .repartition(parts(nodes.sparkSession), "grp", "block")
        .sortWithinPartitions("grp", "block", "behind", "idx")
    )


def paths(nodes: DataFrame, height: int) -> DataFrame:
    """Rows (grp, idx, path, root) of all ``nodes`` (grp, idx, n, value): what stands left and right on the way up."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_rows(stream), key=lambda r: (r["grp"], r["block"])):
            head = next(rows)
            own = list(rows)
            block = Block([r["value"] for r in own], own[0]["n"], height)
            found = []
            for k, r in enumerate(own):
                steps = [dict(zip(("left", "right"), parent.around(slot))) for parent, slot in block.way(k)]
                found.append({"grp": r["grp"], "idx": r["idx"], "path": steps + head["path"], "root": head["root"]})
            yield pa.RecordBatch.from_pylist(found, schema=out)

    out = pa.schema([("grp", pa.string()), ("idx", pa.int64()), ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), ("root", pa.string())])
    up = keep(tops(nodes, height), "tops")
    if up.where("n > 1").isEmpty():
        above = up.select("grp", "idx", F.expr(NO_PATH), F.col("value").alias("root"))
    else:
        above = paths(up, height)
    kind = nodes.schema["grp"].dataType
    text = lambda df: df.withColumn("grp", F.col("grp").cast("string"))
    dealt = _with_way(text(nodes.select("grp", "idx", "n", "value")), text(above), ["root"], height)
    found = dealt.mapInArrow(run, f"grp string, idx long, path {PATH}, root string")
    return keep(found.withColumn("grp", F.col("grp").cast(kind)), "paths")


def manifest(leaves: DataFrame, group: str = "source", doc_id: str = "doc_id", digest: str = "leaf", replaced: str | None = None, height: int = HEIGHT) -> DataFrame:
    """Per row of ``leaves``: its id, leaf, subroot, root, siblings, folded_root, verified.

    ``siblings`` holds the digests of the other children of each parent on the way to the root, one after the other, left to
    right and upwards.  ``folded_root`` is the root that follows from ``replaced`` (a column with the digest of the
    row as it is now; by default the leaf) and the siblings of the manifest, ``verified`` whether it is the root.
    """
    now = F.col(replaced) if replaced else F.col(digest)
    rows = leaves.select(F.col(group).cast("string").alias("grp"), F.col(doc_id).alias("id"), F.col(digest).alias("value"), now.alias("now"), F.monotonically_increasing_id().alias("at"))
    order = [F.col("id").asc_nulls_first(), F.col("value"), F.col("now"), F.col("at")]
    nodes = numbered(rows, ["grp"], order).select("grp", "idx", "n", "id", "value", "now")
    first = keep(tops(nodes, height), "tops")
    if first.where("n > 1").isEmpty():
        above = first.select("grp", "idx", F.expr(NO_PATH), F.col("value").alias("root"))
    else:
        above = paths(first, height)
    subroots = above.where("idx = 0").select(F.col("grp").alias("name"), F.col("root").alias("value"))
    placed = keep(numbered(subroots, [], [F.col("name").asc_nulls_first()]).withColumn("grp", F.lit("")), "subroots")
    over = paths(placed, height).select("idx", F.col("path").alias("more"), F.col("root").alias("whole"))
    over = placed.select("name", "idx", F.col("value").alias("subroot")).join(over, "idx").drop("idx")
    above = above.join(over, F.col("grp").eqNullSafe(F.col("name")))
    above = above.select("grp", "idx", F.concat("path", "more").alias("path"), "subroot", F.col("whole").alias("root"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_rows(stream), key=lambda r: (r["grp"], r["block"])):
            head = next(rows)
            own = list(rows)
            block, way = Block([r["value"] for r in own], own[0]["n"], height), Way(head["path"])
            siblings, folded = [], []
            for k, r in enumerate(own):
                value, others = r["now"], []
                for parent, slot in block.way(k):
                    value = parent.folded(slot, value)
                    others += parent.around(slot)
                siblings.append("".join(others) + way.siblings)
                folded.append(way.folded(value))
            columns = [
                pa.array([r["id"] for r in own], kind),
                pa.array([r["value"] for r in own]),
                pa.array([head["subroot"]] * len(own)),
                pa.array([head["root"]] * len(own)),
                pa.array(siblings),
                pa.array(folded),
                pa.array([f == head["root"] for f in folded]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = to_arrow_type(leaves.schema[doc_id].dataType)
    names = [doc_id, "leaf", "subroot", "root", "siblings", "folded_root", "verified"]
    schema = f"`{doc_id}` {leaves.schema[doc_id].dataType.simpleString()}, leaf string, subroot string, root string, siblings string, folded_root string, verified boolean"
    return _with_way(nodes, above, ["subroot", "root"], height).mapInArrow(run, schema)
