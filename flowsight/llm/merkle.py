"""Merkle manifest of a dataset, and proofs folded through retained hash states.

A leaf is the SHA-256 of a row's fields; per group (language) the leaves in
order of their id form a tree of fan-out 8, and the groups' roots form one more
tree.  A parent's hash is computed by one running SHA-256; a copy of its state
is kept before each child slot.  Folding a changed child resumes the copy at its
slot with the new digest and the siblings right of it only; what stands left of
it is never hashed again.

Trees are worked in blocks of ``8**BLOCK_LEVELS`` nodes (512).  Upwards, every
round turns blocks into one node each and writes them; downwards, every block
hands each of its nodes the path above it: per level the siblings left and
right.  A task that folds leaves of a block rebuilds the states of the levels
above once per block and resumes them for each leaf.

Memory: a task holds one block and one path (at most 7 digests a level).  A
group of a third of all rows is as many blocks as its rows need; positions come
from range partitions.  Rounds: one per three levels.

Cases: null fields are ``-``; a null group is a group of its own, the first;
empty text is ``0:``; null ids come first, rows of one id are ordered by their
leaf and repeated rows are leaves of their own; a null id is never tampered
with; an empty table gives no rows; extra columns are ignored.
"""
from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsight.llm.common import LOWER, UPPER, materialise, prepare
from flowsight.operators.ordering import placed

FANOUT = 8
BLOCK_LEVELS = 3
#: Rows of one range partition when rows are numbered.
RANGE_ROWS = 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Per level, from the leaf up: (digests left, digests right) of the path's node.
Path = list[tuple[list[str], list[str]]]
NODE = "tree string, pos long, n long, digest string"
PATH = "array<struct<left: array<string>, right: array<string>>>"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Parent:
    """One run of siblings: the hash states before each slot, and the run's hash."""

    def __init__(self, children: list[str]):
        self.children, self.states = children, []
        h = hashlib.sha256()
        for c in children:
            self.states.append(h.copy())
            h.update(c.encode())
        self.digest = h.hexdigest()

    def fold(self, slot: int, replacement: str) -> str:
        """The run's hash with another digest in `slot`."""
        h = self.states[slot].copy()
        h.update((replacement + "".join(self.children[slot + 1:])).encode())
        return h.hexdigest()


def levels_in_block(n: int, levels: int = BLOCK_LEVELS) -> int:
    """Levels that a round builds over a tree of n nodes: `levels`, or fewer up to its root."""
    k = 0
    while n > 1 and k < levels:
        n, k = -(-n // FANOUT), k + 1
    return k


def build(nodes: list[str], levels: int) -> list[list[Parent]]:
    """The parents of `levels` levels over consecutive nodes, from the lowest up."""
    out = []
    for _ in range(levels):
        out.append([Parent(nodes[i:i + FANOUT]) for i in range(0, len(nodes), FANOUT)])
        nodes = [p.digest for p in out[-1]]
    return out


def path_in(tree: list[list[Parent]], i: int) -> Path:
    """The siblings of node i at each level of a built block."""
    out = []
    for parents in tree:
        i, slot = divmod(i, FANOUT)
        c = parents[i].children
        out.append((c[:slot], c[slot + 1:]))
    return out


def _blocks(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("block", F.floor(F.col("pos") / size).cast("long"))


def _pylist(t: pa.Table, name: str) -> list:
    return t.column(name).to_pylist()


def _up(nodes: DataFrame, size: int, levels: int) -> DataFrame:
    """One round: each block of nodes becomes one node; trees of one node stay."""
    def roots(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        n, block = t.column("n")[0].as_py(), t.column("block")[0].as_py()
        tree = build(_pylist(t, "digest"), levels_in_block(n, levels))
        top = tree[-1][0].digest if tree else t.column("digest")[0].as_py()
        return pa.table({"tree": t.column("tree").slice(0, 1), "pos": pa.array([block], pa.int64()),
                         "n": pa.array([-(-n // size)], pa.int64()), "digest": [top]})
    return _blocks(nodes, size).groupBy("tree", "block").applyInArrow(roots, NODE)


def _down(nodes: DataFrame, above: DataFrame, size: int, levels: int) -> DataFrame:
    """(tree, pos, path): each node's path to the root, from its block's path above."""
    def paths(t: pa.Table, up: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        tree = build(_pylist(t, "digest"), levels_in_block(t.column("n")[0].as_py(), levels))
        rest = [(p["left"], p["right"]) for p in up.column("path")[0].as_py()]
        out = [[{"left": a, "right": b} for a, b in path_in(tree, i) + rest] for i in range(t.num_rows)]
        side = pa.list_(pa.string())
        return pa.table({"tree": t.column("tree"), "pos": t.column("pos"),
                         "path": pa.array(out, pa.list_(pa.struct([("left", side), ("right", side)])))})
    return _cogroup(nodes, above, size).applyInArrow(paths, f"tree string, pos long, path {PATH}")


def _cogroup(nodes: DataFrame, above: DataFrame, size: int):
    up = above.select("tree", F.col("pos").alias("block"), "path")
    return _blocks(nodes, size).groupBy("tree", "block").cogroup(up.groupBy("tree", "block"))


def rounds_of(nodes: DataFrame, size: int, levels: int) -> list[DataFrame]:
    """The nodes given and, round by round, those above, until every tree is one node."""
    out = [nodes]
    while (nodes.agg(F.max("n")).first()[0] or 0) > 1:
        nodes = materialise(_up(nodes, size, levels), "merkle")
        out.append(nodes)
    return out


def paths_to(rounds: list[DataFrame], top: DataFrame, size: int, levels: int) -> DataFrame:
    """(tree, pos, path) of the nodes of rounds[0]; top: the same of the trees' roots."""
    for nodes in reversed(rounds[:-1]):
        top = materialise(_down(nodes, top, size, levels), "merkle-paths")
    return top


class Chain:
    """A path from a block's root to the tree's root: one state a level, kept before
    the path's slot, that every leaf of the block resumes."""

    def __init__(self, path: Path):
        self.parents = []
        for left, right in path:
            self.parents.append((hashlib.sha256("".join(left).encode()), "".join(right)))

    def fold(self, node: str) -> str:
        for state, right in self.parents:
            h = state.copy()
            h.update((node + right).encode())
            node = h.hexdigest()
        return node


def _fold(leaves: DataFrame, above: DataFrame, size: int, levels: int, id_type: str) -> DataFrame:
    """Per leaf its proof's hash, its group's root, and the root folded from its changed form."""
    def fold(t: pa.Table, up: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        tree = build(_pylist(t, "digest"), levels_in_block(t.column("n")[0].as_py(), levels))
        rest = [(p["left"], p["right"]) for p in up.column("path")[0].as_py()]
        chain, tail = Chain(rest), "".join(itertools.chain.from_iterable(a + b for a, b in rest))
        proof, folded = [], []
        for i, changed in enumerate(_pylist(t, "changed")):
            own = path_in(tree, i)
            proof.append(digest(["".join(a + b) for a, b in own] + [tail]))
            for parents in tree:
                i, slot = divmod(i, FANOUT)
                changed = parents[i].fold(slot, changed)
            folded.append(chain.fold(changed))
        return pa.table({"doc_id": t.column("doc_id"), "leaf": t.column("digest"), "tree": t.column("tree"),
                         "proof_sha256": proof, "folded_root": folded})
    return _cogroup(leaves, above, size).applyInArrow(
        fold, f"doc_id {id_type}, leaf string, tree string, proof_sha256 string, folded_root string")


def field_text(c: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def lower_text(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def every_third(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def manifest(docs: DataFrame, tamper: Callable[[Column], Column] = lower_text,
             tampered: Callable[[Column], Column] = every_third, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id",
             group_col: str = "lang", text_col: str = "text", levels: int = BLOCK_LEVELS) -> DataFrame:
    """Per row: doc_id, leaf, subroot (its group's), root, proof_sha256, folded_root
    (with the text changed by `tamper` where `tampered` says so) and verified."""
    spark, size = docs.sparkSession, FANOUT ** levels
    prepare(spark)
    id_type = dict(docs.dtypes)[id_col]
    leaf = F.sha2(F.concat(*[field_text(F.col(f)) for f in fields]).cast("binary"), 256)
    changed = F.sha2(F.concat(*[field_text(tamper(F.col(f)) if f == text_col else F.col(f)) for f in fields])
                     .cast("binary"), 256)
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # null first
    rows = materialise(docs.select(tree.alias("tree"), F.col(id_col).alias("doc_id"), leaf.alias("digest"),
                                   F.when(tampered(F.col(id_col)), changed).otherwise(leaf).alias("changed")), "leaves")
    leaves = materialise(_positions(rows, F.col("tree"), ["doc_id", "digest", "changed"]), "leaves-placed")
    rounds = rounds_of(leaves.select("tree", "pos", "n", "digest"), size, levels)

    subroots = rounds[-1].select("tree", "digest")
    over = _positions(subroots.withColumnRenamed("tree", "group"), F.lit("all"), ["group"])
    upper = rounds_of(over.select("tree", "pos", "n", "digest"), size, levels)
    root_path = upper[-1].select("tree", "pos", F.from_json(F.lit("[]"), PATH).alias("path"))
    up = paths_to(upper, root_path, size, levels)
    groups = over.join(up, ["tree", "pos"]).select(F.col("group").alias("tree"), F.lit(0).cast("long").alias("pos"), "path")

    # the leaves' own round folds instead of handing out paths
    rounds = rounds if len(rounds) > 1 else [rounds[0], rounds[0].select("tree", "pos", "n", "digest")]
    above = paths_to(rounds[1:], groups, size, levels)
    folded = _fold(leaves, above, size, levels, id_type)
    root = (upper[-1].select("digest").first() or [None])[0]
    return folded.join(subroots.select("tree", F.col("digest").alias("subroot")), "tree").select(
        "doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"))


def _positions(rows: DataFrame, tree: Column, order: list[str]) -> DataFrame:
    """rows with tree, pos (0-based place among its tree's rows in `order`) and n (their
    number): places in range partitions, whose row counts per tree give offsets."""
    x, _ = placed(rows.withColumn("tree", tree), ["tree", *[F.col(c).asc_nulls_first() for c in order]], RANGE_ROWS)
    part = x.groupBy("tree", "_pid").agg(F.count("*").alias("c"), F.min("_place").alias("first"))
    w = Window.partitionBy("tree")
    offs = part.select("tree", "_pid", (F.sum("c").over(w.orderBy("_pid")) - F.col("c") - F.col("first")).alias("off"),
                       F.sum("c").over(w).alias("n"))
    return x.join(offs, ["tree", "_pid"]).withColumn("pos", F.col("off") + F.col("_place")).drop("_pid", "_place", "off")
