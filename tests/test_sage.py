"""Learned neighbourhood aggregation: gradients by finite differences, quality against propagation."""
import numpy as np
import pytest

from flowsight.operators import graph as G
from flowsight.operators import metrics as M
from flowsight.operators import ml, sage


def dense(g, rows, edges, w, l2):
    """Training and validation loss by dense matrices over the collected tables."""
    at = {r.node: i for i, r in enumerate(rows)}
    a = np.zeros((len(rows),) * 2)
    for r in edges:
        a[at[r.dst], at[r.src]] = r.w
    x = np.array([[r[c] for c in g.x] for r in rows])
    h = sage.hidden_layer(x, a @ x, w)
    p = sage.softmax(h, a @ h, w)
    y, part = np.array([r.y for r in rows]), np.array([r.part for r in rows])
    loss = lambda k: -np.mean(np.log(p[np.arange(len(p)), y])[(y >= 0) & (part == k)])
    return loss(0) + 0.5 * l2 * sum((w[n] ** 2).sum() for n in sage.NAMES if "bias" not in n), loss(1)


@pytest.mark.parametrize("norm", ["mean", "sym"])
def test_gradients_equal_finite_differences(spark, norm):
    rng = np.random.default_rng(2)
    x = spark.createDataFrame([(i, float(rng.normal()), float(rng.normal())) for i in range(24)], "node long, a double, b double")
    e = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 24, (70, 2))] + [(None, 3)], "src long, dst long")
    labels = spark.createDataFrame([(i, "ABC"[i % 3]) for i in range(20)], "node long, label string")
    g = sage.Graph(x, e, labels, ["a", "b"], norm)
    w = sage.first_weights(2, 3, hidden=4)
    w["bias1"] = rng.normal(size=4) * 0.1
    train, val, grad = g.gradients(w, l2=0.01)
    rows, e = g.nodes.collect(), g.edges.collect()
    want = dense(g, rows, e, w, 0.01)
    assert abs(train - want[0]) < 1e-10 and abs(val - want[1]) < 1e-10

    def moved(n, i, by):
        c = {k: a.copy() for k, a in w.items()}
        c[n][i] += by
        return dense(g, rows, e, c, 0.01)[0]
    for n in sage.NAMES:
        for i in np.ndindex(w[n].shape):
            assert abs((moved(n, i, 1e-6) - moved(n, i, -1e-6)) / 2e-6 - grad[n][i]) < 1e-6, (n, i)


def test_beats_propagated_features_where_the_label_is_not_linear(spark):
    rng = np.random.default_rng(3)
    n = 400
    v = rng.normal(size=n)
    e = rng.integers(0, n, (4 * n, 2))
    near = np.zeros(n)
    for i in range(n):
        s = np.unique(e[(e[:, 1] == i) & (e[:, 0] != i), 0])
        near[i] = np.abs(v[s]).mean() if len(s) else 0.0
    y = np.where(near > np.median(near), "Attack", "Normal")
    x = spark.createDataFrame([(i, float(v[i])) for i in range(n)], "node long, v double")
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in e], "src long, dst long")
    labels = spark.createDataFrame([(i, str(y[i])) for i in range(n)], "node long, label string")
    g = sage.Graph(x, edges, labels, ["v"])
    w, losses = g.fit(hidden=8, rounds=30)
    assert losses[-1][0] < losses[0][0]
    got = g.scored(w)
    flat, _ = ml.train_node_classifier(G.propagate(x, edges, ["v"], 2).checkpoint(), labels, ["v", "v_h1", "v_h2"])
    f1 = [M.classification_metrics(M.confusion_matrix(s.where("split = 'test'"), "label", "predicted")).first().f1_macro
          for s in (got, flat)]
    assert f1[0] > 0.75 and f1[0] >= f1[1], f1
    assert got.count() == n


def test_no_labels_and_no_edges(spark):
    x = spark.createDataFrame([(1, 1.0), (2, None)], "node long, v double")
    e = spark.createDataFrame([], "src long, dst long")
    g = sage.Graph(x, e, spark.createDataFrame([(1, "Normal")], "node long, label string"), ["v"])
    w, _ = g.fit(hidden=2, rounds=2)
    assert {r.node: r.predicted for r in g.scored(w).collect()} == {1: "Normal", 2: "Normal"}
