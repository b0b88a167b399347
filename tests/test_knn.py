"""Exact kNN equals brute force for any cell / chunk sizing; SMOTE points lie
on the segment between a row and one of its same-class neighbours."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import SF01
from flowsight.operators.knn import knn_edges, smote


def _brute(pdf, k):
    X = np.stack(pdf.embedding.apply(lambda v: np.asarray(v, dtype=float)).values)
    ids = pdf.vec_id.to_numpy()
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(2))
    np.fill_diagonal(D, np.inf)
    return {ids[i]: list(ids[np.lexsort((ids, D[i]))[:k]]) for i in range(len(ids))}


@pytest.mark.parametrize("cell_rows,chunk", [(1000, 2000), (40, 30), (7, 5), (None, 2000)])
def test_knn_exact(spark, cell_rows, chunk):
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    want = _brute(e.toPandas(), 5)
    got = knn_edges(e, "embedding", "vec_id", 5, cell_rows=cell_rows, chunk=chunk).toPandas()
    g = {k: list(v.sort_values("rank").dst) for k, v in got.groupby("src")}
    assert g == want


def test_smote_points_between_parents(spark):
    e = spark.read.parquet(f"{SF01}/embeddings.parquet").filter(F.col("label") < 3)
    e = e.filter((F.col("label") != 2) | (F.col("vec_id") % 3 == 0))   # make class 2 a minority
    s = smote(e, "label", "embedding", "vec_id", k=5).toPandas()
    counts = e.groupBy("label").count().toPandas().set_index("label")["count"]
    assert (s.groupby("label").size().reindex(counts.index, fill_value=0) == counts.max() - counts).all()
    vecs = {r.vec_id: np.asarray(r.embedding, dtype=float) for r in e.toPandas().itertuples()}
    for r in s.itertuples():
        a, b = vecs[r.base_id], vecs[r.nbr]
        assert np.allclose(np.asarray(r.vec), a + r.u * (b - a))
        assert 0.0 <= r.u < 1.0


def test_piece_and_block_bound_the_memory():
    """A piece of 2,000 x 64 against 100,000 queries stays within one block of squares."""
    import tracemalloc

    from flowsight.operators import knn
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(2000, 64)), rng.normal(size=(100_000, 64))
    index = knn.Nearest(np.arange(2000), x, 5)
    tracemalloc.start()
    got = index.pairs(np.arange(10_000, 110_000), q, np.full(len(q), np.inf))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 500_000 and peak < 12 * knn.BLOCK * 2000 * 8
    some = rng.integers(0, len(q), 50)
    want = np.sort(np.sqrt(((q[some, None] - x[None]) ** 2).sum(2)), axis=1)[:, :5]
    dist = got.dist.to_numpy().reshape(-1, 5)[some]
    assert np.allclose(dist, want)


def test_equal_points_and_ties_by_id(spark):
    rows = [(i, [float(i // 4), 0.0]) for i in range(40)]
    got = knn_edges(spark.createDataFrame(rows, "id long, vec array<double>"), k=3, cell_rows=6, chunk=3).collect()
    for i, _ in rows:
        mine = sorted((r["rank"], r.dst, r.dist) for r in got if r.src == i)
        want = sorted((abs(j // 4 - i // 4), j) for j, _ in rows if j != i)[:3]
        assert [(d, j) for _, j, d in mine] == want
