"""Exact k-nearest neighbours (C10) and SMOTE oversampling.

Points are assigned to the nearest of about sqrt(n) pivots (cells, numbered so that near
ones follow each other), ordered by (group, cell) and packed in blocks of about
VISIT_DOUBLES numbers, each with its segments (runs of a group's cells: centre, radius)
and with a bound on every point's k-th neighbour distance, found inside its own segment.
Every block then meets every other of its group where the blocks are read, by a cartesian
product of their partitions: no point is copied per piece that it visits, so what is
written is a few times the points and does not grow with the number of pieces.  A task
holds one block of queries with the k best found so far, one block of members and
BLOCK x chunk products.  The triangle inequality (|x - centre| - radius <= bound) leaves out
the segments that cannot hold a closer point; of the others one matrix product in single
precision leaves the members that may be among the nearest, with a margin for its rounding,
and these are measured exactly.  The result equals brute force (ties broken by neighbour
id).  Where the inequality prunes little (many dimensions) the work is n^2 products: that
is the cost of exactness.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsight.operators.ordering import HASH_SPACE, hash32

PAIR_SCHEMA = "qid long, nid long, dist double"
BLOCK = 1024
#: Doubles of the vectors of a block, which meets all others as a whole.
VISIT_DOUBLES = 1 << 19
#: Rows of a segment of small cells, at least, and of a block where more would leave cores idle.
SEGMENT_ROWS, BUSY_ROWS = 256, 512
#: Bytes of the members that a task reads again for every block of its queries.
SIDE_BYTES = 64 << 20
#: Pairs measured exactly at a time.
EXACT_PAIRS = 1 << 14


def _squares(q: np.ndarray, x: np.ndarray, x2: np.ndarray) -> np.ndarray:
    return np.maximum((q * q).sum(axis=1)[:, None] + x2[None, :] - 2.0 * (q @ x.T), 0.0)


class Nearest:
    """k nearest members of one piece."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")   # candidates come out in id order
        self.ids, self.x, self.k = ids[order], x[order], k
        self.x2 = (self.x * self.x).sum(axis=1)

    def pairs(self, qid: np.ndarray, q: np.ndarray, bound: np.ndarray) -> pd.DataFrame:
        """Up to k nearest other members of each query within its bound."""
        found = [pd.DataFrame({"qid": np.zeros(0, np.int64), "nid": np.zeros(0, np.int64), "dist": np.zeros(0)})]
        for a in range(0, len(qid), BLOCK):
            i, v, b = qid[a:a + BLOCK], q[a:a + BLOCK], bound[a:a + BLOCK]
            d2 = _squares(v, self.x, self.x2)
            d2[i[:, None] == self.ids[None, :]] = np.inf          # no self edges
            # rounding of the product form: a margin of its size, exact distances after
            margin = 1e-9 * ((v * v).sum(axis=1) + (self.x2.max() if len(self.x2) else 0.0)) + 1e-12
            top = np.partition(d2, min(self.k, d2.shape[1]) - 1, axis=1)[:, min(self.k, d2.shape[1]) - 1]
            near = d2 <= (np.minimum(top, b * b) + margin)[:, None]
            r, c = np.nonzero(near & np.isfinite(d2))
            dist = np.sqrt(((v[r] - self.x[c]) ** 2).sum(axis=1))
            order = np.lexsort((self.ids[c], dist, r))
            r, c, dist = r[order], c[order], dist[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            keep = place < self.k
            found.append(pd.DataFrame({"qid": i[r[keep]], "nid": self.ids[c[keep]], "dist": dist[keep]}))
        return pd.concat(found)

    def reach(self, qid: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Per query a distance within which k other members are; infinite where there are none."""
        out = np.full(len(q), np.inf)
        if len(self.ids) < self.k:
            return out
        for a in range(0, len(q), BLOCK):
            v = q[a:a + BLOCK]
            d2 = _squares(v, self.x, self.x2)
            d2[qid[a:a + BLOCK, None] == self.ids[None, :]] = np.inf
            top = np.partition(d2, self.k - 1, axis=1)[:, self.k - 1]
            out[a:a + BLOCK] = np.sqrt(top + 1e-9 * ((v * v).sum(axis=1) + self.x2.max()) + 1e-12)
        return np.where(np.isnan(out), np.inf, out)


def _vectors(column: pa.Array) -> np.ndarray:
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float)
    return values.reshape(len(column), -1)


def _followed(pivots: np.ndarray) -> np.ndarray:
    """An order of the pivots in which near ones follow each other: halves by the widest
    coordinate, again and again."""
    out, stack = [], [np.arange(len(pivots))]
    while stack:
        at = stack.pop()
        if len(at) < 2:
            out.append(at)
            continue
        v = pivots[at]
        at = at[np.argsort(v[:, np.ptp(v, axis=0).argmax()], kind="stable")]
        stack += [at[len(at) // 2:], at[:len(at) // 2]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Block:
    """Points of one block, in the order of (group, cell).  named: has an id; member: may be
    a neighbour; starts, ends: segments, each of one group; bound: at most so far is a
    point's k-th neighbour."""
    FIELDS = {"ids": np.int64, "named": bool, "member": bool, "starts": np.int64, "ends": np.int64, "bound": float}

    def __init__(self, x: np.ndarray, groups: list[str], **arrays: np.ndarray):
        self.x, self.groups = x, groups   # a segment's group
        for f, a in arrays.items():
            setattr(self, f, a)

    @classmethod
    def of(cls, x: np.ndarray, group: np.ndarray, cell: np.ndarray, ids: np.ndarray, named: np.ndarray, k: int, chunk: int) -> Block:
        cuts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (cell[1:] != cell[:-1]), True])
        starts, ends = [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if starts and group[starts[-1]] == group[a] and max(ends[-1] - starts[-1], b - a) < SEGMENT_ROWS:
                ends[-1] = b      # small cells of a group together
                continue
            for o in range(a, b, chunk):
                starts.append(o)
                ends.append(min(b, o + chunk))
        self = cls(x, [group[a] for a in starts], ids=ids, named=named, member=np.isfinite(x).all(axis=1),
                   starts=np.array(starts, np.int64), ends=np.array(ends, np.int64), bound=np.full(len(x), np.inf))
        self.first_copies(k)
        shown = np.where(named, ids.astype(float), np.nan)
        for a, b in zip(starts, ends):
            here = a + np.flatnonzero(self.member[a:b])
            if len(here):
                self.bound[a:b] = Nearest(shown[here], x[here], k).reach(shown[a:b], x[a:b])
        return self

    def first_copies(self, k: int) -> None:
        """Of equal points in a segment only those of the smallest ids stay members, as many as can
        be among anyone's k nearest: one very common point costs no more than a rare one."""
        for a, b in zip(self.starts.tolist(), self.ends.tolist()):
            _, kind, count = np.unique(self.x[a:b], axis=0, return_inverse=True, return_counts=True)
            kind = kind.ravel()
            if count.max() <= k + 1:
                continue
            ids, named = self.ids[a:b], self.named[a:b]
            copies = int(np.unique(ids[named], return_counts=True)[1].max()) if named.any() else 0
            order = np.lexsort((ids, named, kind))
            place = np.arange(len(order)) - np.searchsorted(kind[order], kind[order])
            self.member[a + order[place >= k + copies]] = False

    def pack(self, kind: np.dtype) -> list[bytes]:
        return [self.x.astype(kind).tobytes(), "\n".join(self.groups).encode(), *[getattr(self, f).tobytes() for f in self.FIELDS]]

    @classmethod
    def unpack(cls, raw: list[bytes], kind: np.dtype) -> Block:
        arrays = {f: np.frombuffer(r, t) for (f, t), r in zip(cls.FIELDS.items(), raw[2:])}
        return cls(np.frombuffer(raw[0], kind).reshape(len(arrays["ids"]), -1).astype(float), bytes(raw[1]).decode().split("\n"), **arrays)

    def prepare(self) -> None:
        """As members: each segment's rows, centre and radius, and the block around its middle
        in single precision with half the squares."""
        at = np.flatnonzero(self.member)
        self.rows, self.cuts = at, np.searchsorted(at, np.append(self.starts, len(self.x)))
        x = self.x[at]
        self.middle = x.mean(axis=0) if len(at) else np.zeros(self.x.shape[1])
        moved = x - self.middle
        norm = np.sqrt((moved * moved).sum(axis=1))
        self.work, self.eps = (np.float32, 2.0 ** -23) if 1e-12 < norm.max(initial=0) < 1e12 else (float, 2.0 ** -52)
        self.wide = np.column_stack([moved, -0.5 * norm * norm]).astype(self.work)
        self.centre, self.radius, self.far = [], [], []
        for a, b in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist()):
            c = x[a:b].mean(axis=0) if b > a else np.zeros(x.shape[1])
            self.centre.append(c)
            self.radius.append(np.sqrt(((x[a:b] - c) ** 2).sum(axis=1)).max(initial=0) if b > a else -np.inf)
            self.far.append(norm[a:b].max(initial=0))
        self.copies = int(np.unique(self.ids[at][self.named[at]], return_counts=True)[1].max(initial=0))


class Search:
    """The k best of all members that a block's points have met."""

    def __init__(self, block: Block, k: int):
        self.b, self.k, self.bound = block, k, block.bound.copy()
        self.x2 = (block.x * block.x).sum(axis=1)
        self.asks = np.isfinite(self.x2)
        self.found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool), np.zeros(0, np.int64))]   # row, distance, named, id
        self.new = 0

    def meet(self, m: Block) -> None:
        m.prepare()
        spans: dict[str, list[int]] = {}
        for s, g in enumerate(m.groups):
            spans.setdefault(g, []).append(s)
        mine: dict[str, list[int]] = {}
        for s, g in enumerate(self.b.groups):
            mine.setdefault(g, []).append(s)
        q = None
        for g in mine.keys() & spans.keys():
            a, b = int(self.b.starts[mine[g][0]]), int(self.b.ends[mine[g][-1]])
            near = [s for s in spans[g] if m.cuts[s + 1] > m.cuts[s]]
            if not near:
                continue
            if q is None:
                q = self.b.x - m.middle
                q2 = (q * q).sum(axis=1)
                q = np.column_stack([q, np.ones(len(q))]).astype(m.work)
            for o in range(a, b, BLOCK):
                rows = np.arange(o, min(b, o + BLOCK))
                rows = rows[self.asks[rows]]
                c = np.array([m.centre[s] for s in near]) - m.middle
                away = np.sqrt(_squares(self.b.x[rows] - m.middle, c, (c * c).sum(axis=1)))
                size = 1e-6 * (np.sqrt(q2[rows])[:, None] + np.sqrt((c * c).sum(axis=1))[None, :])
                for i in np.argsort(away.min(axis=0, initial=np.inf), kind="stable").tolist():
                    s = near[i]
                    live = rows[away[:, i] - m.radius[s] <= self.bound[rows] + size[:, i]]
                    if len(live):
                        self.products(m, s, live, q, q2)
        if self.new > self.k * len(self.b.x):
            self.settle()

    def products(self, m: Block, s: int, rows: np.ndarray, q: np.ndarray, q2: np.ndarray) -> None:
        """Members of a segment that may be among the k nearest of these rows."""
        cols = m.rows[m.cuts[s]:m.cuts[s + 1]]
        part = m.wide[m.cuts[s]:m.cuts[s + 1]]
        near = q[rows] @ part.T                         # q.x - |x|^2 / 2 = (|q|^2 - distance^2) / 2
        far = m.far[s]
        margin = (part.shape[1] + 8) * m.eps * (q2[rows] + far * far)
        most = np.square(self.bound[rows]) * (1 + 1e-12)
        loose = np.flatnonzero(~np.isfinite(most))
        kk = self.k + m.copies
        if len(loose) and kk < near.shape[1]:           # the k-th of these members is a bound
            top = np.partition(near[loose], -kk, axis=1)[:, -kk].astype(float)
            most[loose] = q2[rows[loose]] - 2 * top + 2 * margin[loose]
        least = (q2[rows] - most) / 2 - margin
        least -= 4 * m.eps * np.abs(np.where(np.isfinite(least), least, 0.0))
        r, c = np.nonzero(near >= least.astype(m.work)[:, None])
        for o in range(0, len(r), EXACT_PAIRS):
            i, j = rows[r[o:o + EXACT_PAIRS]], cols[c[o:o + EXACT_PAIRS]]
            dist = np.sqrt(((self.b.x[i] - m.x[j]) ** 2).sum(axis=1))
            keep = (dist <= self.bound[i]) & ~((self.b.ids[i] == m.ids[j]) & self.b.named[i] & m.named[j])   # no self edges
            self.found.append((i[keep], dist[keep], m.named[j][keep], m.ids[j][keep]))
            self.new += int(keep.sum())
        if self.new > 4 * self.k * len(self.b.x):
            self.settle()

    def settle(self) -> None:
        """Keep each row's k nearest and bound it by the last of them."""
        r, d, named, ids = (np.concatenate(c) for c in zip(*self.found))
        order = np.lexsort((ids, named, d, r))
        r, d, named, ids = r[order], d[order], named[order], ids[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        last = place == self.k - 1
        self.bound[r[last]] = np.minimum(self.bound[r[last]], d[last])
        keep = place < self.k
        self.found, self.new = [(r[keep], d[keep], named[keep], ids[keep])], 0

    def edges(self) -> pa.RecordBatch:
        self.settle()
        r, d, named, ids = self.found[0]
        return pa.RecordBatch.from_arrays([pa.array(self.b.ids[r], mask=~self.b.named[r]), pa.array(ids, mask=~named), pa.array(d)],
                                          ["qid", "nid", "dist"])


def knn_edges(df: DataFrame, vec: str = "vec", key: str = "id", k: int = 5, part: list[str] = (),
              cell_rows: int | None = None, chunk: int = 2000, seed: int = 42) -> DataFrame:
    """(src, dst, dist, rank) for the k nearest other rows of every row
    (Euclidean), optionally only within groups `part` (e.g. a class).  `cell_rows` is
    the mean size of a cell (by default the square root of the row count), `chunk` the most
    rows of a segment."""
    part = list(part)
    spark = df.sparkSession
    kind = np.dtype(np.float32 if df.select(vec).schema[0].dataType.simpleString() == "array<float>" else float)
    x = df.select(*part, F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    n = x.count()
    c = max(1, math.ceil(n / (cell_rows or max(1, math.isqrt(n)))))
    piv = x.withColumn("_h", hash32("id", seed=seed)).orderBy("_h", "id").limit(c).select("vec").collect()
    pivots = np.asarray([r["vec"] for r in piv], dtype=float) if piv else np.zeros((0, 1))
    width = max(1, pivots.shape[1])
    bp = spark.sparkContext.broadcast(pivots[_followed(pivots)])   # about sqrt(n) x d

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = bp.value
        p2 = (p * p).sum(axis=1)
        for b in batches:
            v = _vectors(b.column(2))
            cell = [np.nan_to_num(_squares(v[a:a + BLOCK], p, p2), nan=np.inf).argmin(axis=1) for a in range(0, len(v), BLOCK)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(cell or [np.zeros(0, np.int64)]))], ["_g", "id", "vec", "cell"])

    rows = max(1, VISIT_DOUBLES // width)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            whole = t.num_rows if last else t.num_rows - t.num_rows % rows
            for o in range(0, whole, rows):
                p = t.slice(o, min(rows, whole - o))
                g, cell, id_ = p.column(0).to_numpy(), p.column(3).to_numpy(), p.column(1)
                named = ~id_.is_null().to_numpy().astype(bool)
                v = np.asarray(p.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(p.num_rows, -1)
                made = Block.of(v, g, cell, id_.fill_null(0).to_numpy(), named, k, chunk)
                yield pa.RecordBatch.from_arrays([pa.array([g[0]]), pa.array([g[-1]]), pa.array([made.pack(kind)], pa.list_(pa.binary()))],
                                                 ["lo", "hi", "raw"])
            held[:] = t.slice(whole).to_batches()
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size >= rows:
                yield from blocks(False)
                size %= rows
        if size:
            yield from blocks(True)

    group = F.to_json(F.struct(*part)) if part else F.lit("")
    some = F.lit(True)
    for p in part:   # a missing group has no neighbours
        some = some & F.col(p).isNotNull()
    cells = x.where(some).select(group.alias("_g"), "id", "vec").mapInArrow(assign, "_g string, id long, vec array<double>, cell long")
    parts = max(1, min(2 * spark.sparkContext.defaultParallelism, n // BUSY_ROWS), -(-n // (4 * rows)))
    blocks = cells.repartitionByRange(parts, "_g", "cell", "id").sortWithinPartitions("_g", "cell", "id") \
        .mapInArrow(pack, "lo string, hi string, raw array<binary>").withColumn("no", F.monotonically_increasing_id()).checkpoint()
    sides = max(1, min(parts, -(-n * width * kind.itemsize // SIDE_BYTES)))
    others = blocks.coalesce(sides).select(F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("raw").alias("members"))
    met = blocks.join(others.hint("shuffle_replicate_nl"), (F.col("lo") <= F.col("hi2")) & (F.col("lo2") <= F.col("hi")))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, search = None, None
        for b in batches:
            for i in range(b.num_rows):
                no = b.column(0)[i].as_py()
                if no != now:
                    if search is not None:
                        yield search.edges()
                    now, search = no, Search(Block.unpack(_blobs(b.column(1), i), kind), k)
                search.meet(Block.unpack(_blobs(b.column(2), i), kind))
        if search is not None:
            yield search.edges()
    w = Window.partitionBy("qid").orderBy("dist", "nid")
    pairs = met.select("no", "raw", "members").mapInArrow(visit, PAIR_SCHEMA)
    top = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.select(F.col("qid").alias("src"), F.col("nid").alias("dst"), "dist", "rank")


def _blobs(column: pa.Array, i: int) -> list[pa.Buffer]:
    """The byte strings of a row, not copied."""
    return [v.as_buffer() for v in column[i].values]


def smote(df: DataFrame, label: str, vec: str = "vec", key: str = "id", k: int = 5, seed: int = 42) -> DataFrame:
    """Synthesise points for every class up to the majority size:
    x + u (neighbour - x) with a neighbour among the k = min(5, n_min - 1)
    nearest same-class rows; base row, neighbour and u come from seeded hashes
    of the synthetic index (reproducible, independent of partitioning).  A class of one row
    has no neighbour and repeats its row; NULL is a class of its own."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    st = sizes.agg(F.max("_nc").alias("mx"), F.min("_nc").alias("mn")).first()
    kk = max(1, min(k, st["mn"] - 1))
    nn = knn_edges(df.select(label, key, vec), vec, key, kk, part=[label])
    from flowsight.operators.ordering import few, join_same, rank_within
    base = rank_within(df.select(label, F.col(key).alias("id"), F.col(vec).alias("vec"))
                       .withColumn("_h", hash32("id", seed=seed)), [label], "_h", "id", "_rk")
    base = join_same(base, few(sizes), [label])
    # synthetic j of a class uses base row (j mod n_c); rows with rank r own j = r, r + n_c, ...
    need = F.col("_mx") - F.col("_nc")
    base = base.withColumn("_mx", F.lit(st["mx"])).withColumn(
        "_copies", F.when(F.col("_rk") < need, ((need - 1 - F.col("_rk")) / F.col("_nc")).cast("long") + 1)
        .otherwise(F.lit(0)))
    syn = base.filter(F.col("_copies") > 0).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    syn = syn.withColumn("j", F.col("_rk") + F.col("_c") * F.col("_nc"))
    hj = hash32(label, "j", seed=seed + 5)
    syn = syn.withColumn("rank", (hj % kk + 1).cast("int")).withColumn("u", (hj.cast("double") / HASH_SPACE))
    nbr = nn.select(F.col("src").alias("id"), "rank", F.col("dst").alias("nbr"))
    vecs = df.select(F.col(key).alias("nbr"), F.col(vec).alias("nvec"))
    # a lone row is its own neighbour
    syn = syn.join(nbr, ["id", "rank"], "left").withColumn("nbr", F.coalesce("nbr", "id")).join(vecs, "nbr")
    out = syn.select(F.col(label), F.col("j").alias("synthetic_idx"), F.col("id").alias("base_id"), "nbr", "u",
                     F.zip_with("vec", "nvec", lambda a, b: a + F.col("u") * (b - a)).alias("vec"))
    return out
