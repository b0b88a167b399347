"""Node classifier of two learned neighbourhood aggregations.

    h = relu(x Ws1 + (A x) Wn1 + b1),   logits = h Ws2 + (A h) Wn2 + b2

A averages over in-neighbours ('mean') or is the symmetric normalisation with self loops
('sym'), as in ``graph.propagate``.  One full-batch round is three joins: A h along the
edges, A' (d logits) back along them, and the parts of a node together.  Messages are summed
map-side, so a hub receives partial sums; what a hub sends is split by AQE's skew join.  The
driver holds the weights and their gradients only, and every round starts from the same
checkpointed tables, so lineage does not grow.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.operators.ordering import HASH_SPACE, hash32

NAMES = ("self1", "near1", "bias1", "self2", "near2", "bias2")


def edge_weights(nodes: DataFrame, edges: DataFrame, norm: str = "mean") -> DataFrame:
    """(src, dst, w): the entries of A, without self loops of the input; NULL ends dropped."""
    e = edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct()
    deg = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("d"))
    if norm == "mean":
        return e.join(deg.withColumnRenamed("node", "dst"), "dst").select("src", "dst", (1.0 / F.col("d")).alias("w"))
    if norm != "sym":
        raise ValueError(norm)
    deg = nodes.select("node").join(deg, "node", "left").select("node", (F.coalesce("d", F.lit(0)) + 1.0).alias("d"))
    far = e.join(deg.select(F.col("node").alias("src"), F.col("d").alias("ds")), "src") \
        .join(deg.select(F.col("node").alias("dst"), F.col("d").alias("dd")), "dst")
    return far.select("src", "dst", (1.0 / F.sqrt(F.col("ds") * F.col("dd"))).alias("w")).unionByName(
        deg.select(F.col("node").alias("src"), F.col("node").alias("dst"), (1.0 / F.col("d")).alias("w")))


def _send(e: DataFrame, x: DataFrame, cols: list[str], to: str = "dst") -> DataFrame:
    """(node, cols): weighted sums of the columns over the edges, at their ``to`` end."""
    start = "src" if to == "dst" else "dst"
    return e.join(x.select(F.col("node").alias(start), *cols), start).groupBy(F.col(to).alias("node")).agg(
        *[F.sum(F.col("w") * F.col(c)).alias(c) for c in cols])


def first_weights(n_in: int, n_out: int, hidden: int = 16, seed: int = 42) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    glorot = lambda a, b: rng.uniform(-1, 1, (a, b)) * np.sqrt(6.0 / (a + b))
    return {"self1": glorot(n_in, hidden), "near1": glorot(n_in, hidden), "bias1": np.zeros(hidden),
            "self2": glorot(hidden, n_out), "near2": glorot(hidden, n_out), "bias2": np.zeros(n_out)}


def _matrix(b: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    cols = [b.column(i).fill_null(0.0).to_numpy(zero_copy_only=False) for i in range(first, first + n)]
    return np.stack(cols, axis=1) if cols else np.zeros((b.num_rows, 0))


def hidden_layer(x: np.ndarray, ax: np.ndarray, w: dict) -> np.ndarray:
    return np.maximum(x @ w["self1"] + ax @ w["near1"] + w["bias1"], 0.0)


def softmax(h: np.ndarray, ah: np.ndarray, w: dict) -> np.ndarray:
    z = h @ w["self2"] + ah @ w["near2"] + w["bias2"]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


class Graph:
    """Nodes and edges prepared once: standardised features (missing: 0), their neighbour
    sums, label numbers and the split.  ``labels``: (node, label); nodes without one only
    pass messages.  Splits 60/20/20 by a seeded hash, as the propagated model's."""

    def __init__(self, feats: DataFrame, edges: DataFrame, labels: DataFrame, cols: list[str], norm: str = "mean", seed: int = 42):
        self.classes = [r.label for r in labels.where("label is not null").select("label").distinct().orderBy("label").collect()]
        self.n_in = len(cols)
        s = feats.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        x = [F.coalesce((F.col(c) - F.lit(s[f"m{i}"])) / F.lit(s[f"s{i}"] or 1.0), F.lit(0.0)).cast("double").alias(f"x{i}")
             for i, c in enumerate(cols)]
        nodes = feats.select("node", *x)
        self.x = [f"x{i}" for i in range(self.n_in)]
        self.edges = edge_weights(nodes, edges, norm).checkpoint()
        near = _send(self.edges, nodes, self.x).select("node", *[F.col(c).alias(f"a{c}") for c in self.x])
        number = F.create_map(*[F.lit(v) for i, c in enumerate(self.classes) for v in (c, i)]) if self.classes else None
        h = hash32("node", seed=seed)
        split = F.when(h < F.lit(int(0.6 * HASH_SPACE)), "train").when(h < F.lit(int(0.8 * HASH_SPACE)), "val").otherwise("test")
        y = F.col("label") if number is None else F.try_element_at(number, F.col("label"))
        part = F.when(split == "train", 0).when(split == "val", 1).otherwise(2)
        self.nodes = nodes.join(near, "node", "left").join(labels, "node", "left").select(
            "node", *self.x, *[F.coalesce(f"a{c}", F.lit(0.0)).alias(f"a{c}") for c in self.x],
            F.coalesce(y.cast("int"), F.lit(-1)).alias("y"), part.alias("part"), split.alias("split"), "label").checkpoint()
        self.counts = {r.part: r.n for r in self.nodes.where("y >= 0").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}

    def _with_near_hidden(self, w: dict, keep: list[str]) -> DataFrame:
        """(node, x.., ax.., keep.., g0..): A h beside the node's own columns."""
        f, hid = self.n_in, len(w["bias1"])
        g = [f"g{i}" for i in range(hid)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = hidden_layer(_matrix(b, 1, f), _matrix(b, 1 + f, f), w)
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(h[:, i]) for i in range(hid)]], ["node", *g])
        own = self.nodes.select("node", *self.x, *[f"a{c}" for c in self.x], *keep)
        kind = dict(self.nodes.dtypes)["node"]
        h = own.select("node", *self.x, *[f"a{c}" for c in self.x]).mapInArrow(run, f"node {kind}, " + ", ".join(f"{c} double" for c in g))
        return own.join(_send(self.edges, h, g), "node", "left").fillna(0.0, g)

    def gradients(self, w: dict, l2: float = 1e-4) -> tuple[float, float, dict[str, np.ndarray]]:
        """Mean cross entropy of the training nodes (with l2 / 2 |W|^2) and of the validation
        nodes, and the gradient of the first."""
        f, hid, k = self.n_in, len(w["bias1"]), len(self.classes)
        n_train, n_val = max(1, self.counts.get(0, 0)), max(1, self.counts.get(1, 0))
        d = [f"d{i}" for i in range(k)]
        own = self._with_near_hidden(w, ["y", "part"]).persist()

        def error(b: pa.RecordBatch):
            x, ax = _matrix(b, 1, f), _matrix(b, 1 + f, f)
            y, part = (b.column(1 + 2 * f + i).to_numpy() for i in (0, 1))
            h, ah = hidden_layer(x, ax, w), _matrix(b, 3 + 2 * f, hid)
            p = softmax(h, ah, w)
            at = np.maximum(y, 0)
            like = -np.log(np.maximum(p[np.arange(len(p)), at], 1e-300)) * (y >= 0)
            use = (y >= 0) & (part == 0)
            p[np.arange(len(p)), at] -= 1.0
            return x, ax, h, ah, p * (use / n_train)[:, None], like[use].sum() / n_train, like[part == 1].sum() / n_val

        def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                e = error(b)[4]
                keep = np.flatnonzero((e != 0).any(axis=1))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), *[pa.array(e[keep, i]) for i in range(k)]], ["node", *d])

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                x, ax, h, ah, e, train, val = error(b)
                back = _matrix(b, 3 + 2 * f + hid, k)
                dz = (e @ w["self2"].T + back @ w["near2"].T) * (h > 0)
                parts = [x.T @ dz, ax.T @ dz, dz.sum(0), h.T @ e, ah.T @ e, e.sum(0), np.array([train, val])]
                flat = np.concatenate([p.ravel() for p in parts])
                total = flat if total is None else total + flat
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

        kind = dict(self.nodes.dtypes)["node"]
        err = own.mapInArrow(errors, f"node {kind}, " + ", ".join(f"{c} double" for c in d))
        full = own.join(_send(self.edges, err, d, to="src"), "node", "left").fillna(0.0, d)
        rows = full.mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        own.unpersist()
        flat = np.zeros(sum(w[n].size for n in NAMES) + 2)
        for r in rows:
            flat[r.i] = r.v
        grad, at = {}, 0
        for n in NAMES:
            grad[n] = flat[at:at + w[n].size].reshape(w[n].shape)
            at += w[n].size
            if not n.startswith("bias"):
                grad[n] = grad[n] + l2 * w[n]
        penalty = 0.5 * l2 * sum(float((w[n] ** 2).sum()) for n in NAMES if not n.startswith("bias"))
        return float(flat[-2]) + penalty, float(flat[-1]), grad

    def fit(self, hidden: int = 16, rounds: int = 60, rate: float = 0.05, l2: float = 1e-4, patience: int = 15,
            seed: int = 42) -> tuple[dict, list[tuple[float, float]]]:
        """Full-batch Adam; the weights of the least validation loss (training loss where no
        node validates) and (training, validation) loss per round."""
        w = first_weights(self.n_in, len(self.classes), hidden, seed)
        m, v = ({n: np.zeros_like(a) for n, a in w.items()} for _ in range(2))
        best, at, losses = w, -1, []
        for r in range(rounds if self.counts.get(0) else 0):
            train, val, g = self.gradients(w, l2)
            losses.append((train, val))
            of = lambda x: x[1] if self.counts.get(1) else x[0]
            if at < 0 or of(losses[-1]) < of(losses[at]):
                best, at = w, r
            elif r - at >= patience:
                break
            m = {n: 0.9 * m[n] + 0.1 * g[n] for n in w}
            v = {n: 0.999 * v[n] + 0.001 * g[n] ** 2 for n in w}
            w = {n: w[n] - rate * (m[n] / (1 - 0.9 ** (r + 1))) / (np.sqrt(v[n] / (1 - 0.999 ** (r + 1))) + 1e-8) for n in w}
        return best, losses

    def scored(self, w: dict, benign: str = "Normal") -> DataFrame:
        """node, split, label (NULL without one), predicted, node_risk = 100 (1 - P(benign))."""
        f, hid, classes = self.n_in, len(w["bias1"]), self.classes
        risk_of = classes.index(benign) if benign in classes else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = softmax(hidden_layer(_matrix(b, 1, f), _matrix(b, 1 + f, f), w), _matrix(b, 3 + 2 * f, hid), w)
                risk = 100.0 * (1.0 - p[:, risk_of]) if risk_of is not None else np.full(len(p), 100.0)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1 + 2 * f), b.column(2 + 2 * f), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(risk)],
                    ["node", "split", "label", "c", "node_risk"])
        kinds = dict(self.nodes.dtypes)
        out = self._with_near_hidden(w, ["split", "label"]).mapInArrow(
            run, f"node {kinds['node']}, split string, label {kinds['label']}, c int, node_risk double")
        return out.withColumn("predicted", F.array(*[F.lit(c) for c in classes])[F.col("c")]).select(
            "node", "split", "label", "predicted", "node_risk")
