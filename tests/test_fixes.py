"""Cases that once lost rows, misordered or failed; each against a plain computation."""
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cases import SF001
from flowsight.operators import graph as G
from flowsight.operators import metrics as M
from flowsight.operators import ml
from flowsight.operators import reports as R
from flowsight.operators import risk as K
from flowsight.operators import sliding as S
from flowsight.sources import flows_csv as C
from flowsight.streaming import detector as D


def scratch(spark, tag):
    from flowsight.session import ensure_checkpoint_dir, join_path
    return join_path(ensure_checkpoint_dir(spark), f"{tag}-{uuid.uuid4().hex}")


def test_null_labels_and_predictions_are_counted(spark):
    rows = [("a", "a"), ("a", None), (None, "b"), (None, None), ("b", "b")]
    df = spark.createDataFrame(rows, "label string, prediction string")
    cm = {(r.actual, r.predicted): r.n for r in M.confusion_matrix(df).collect()}
    assert len(cm) == 9 and {k: v for k, v in cm.items() if v} == dict(Counter(rows))
    assert M.classification_metrics(M.confusion_matrix(df)).first().accuracy == 3 / 5
    fixed = M.confusion_matrix(df, labels=["a", "b"]).collect()
    assert sum(r.n for r in fixed) == 2 and len(fixed) == 4


def test_an_update_may_set_null(spark):
    base = spark.createDataFrame([(1, "s", 1, "d", 2, "x", 5.0), (2, "s", 1, "d", 2, "y", 6.0)],
                                 "id long, src_ip string, src_port int, dst_ip string, dst_port int, predicted_attack string, risk_score double")
    upd = spark.createDataFrame([(9, "s", 1, "d", 2, None, 7.0)], base.schema)
    got = {r.id: (r.predicted_attack, r.risk_score, r.updated) for r in R.update_latest(base, upd, ["predicted_attack", "risk_score"]).collect()}
    assert got == {1: ("x", 5.0, False), 2: (None, 7.0, True)}


def test_sliding_counts_before_1970(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), rng.randrange(-200, 200) * 1_000_000 - 1) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, us long")
    got = {r.id: r.n for r in S.sliding_counts(df, ["k"], "us", 30, count_col="n", bucket_secs=40).collect()}
    assert got == {i: sum(k2 == k and us - 30_000_000 < u2 <= us for _, k2, u2 in rows) for i, k, us in rows}


def test_header_groups_with_different_types(spark):
    path = scratch(spark, "mixed")
    a = spark.createDataFrame([(1, "7", "2.5")], "id long, port string, rate string")
    b = spark.createDataFrame([(2, "n/a", "3")], "id long, port string, rate string").withColumn("more", F.lit("x"))
    for i, df in enumerate((a, b)):
        df.coalesce(1).write.option("header", True).csv(f"{path}/w{i}")
    from flowsight.session import fs_list, fs_move
    for i in range(2):
        for p in fs_list(spark, f"{path}/w{i}"):
            if p.endswith(".csv"):
                fs_move(spark, p, f"{path}/all/{i}.csv")
    df = C.read_flow_dir(spark, f"{path}/all")
    assert dict(df.dtypes) == {"id": "bigint", "port": "string", "rate": "double", "more": "string"}
    assert sorted((r.id, r.port, r.rate, r.more) for r in df.collect()) == [(1, "7", 2.5, None), (2, "n/a", 3.0, "x")]
    cast = C.read_flow_dir(spark, f"{path}/all", schema={"port": "int"})
    assert sorted((r.id, r.port) for r in cast.collect()) == [("1", 7), ("2", None)]


def test_long_header_line_is_read_whole(spark):
    path = scratch(spark, "header")
    names = [f"column_{i:06d}" for i in range(100_000)]
    spark.createDataFrame([(",".join(names),)], "value string").coalesce(1).write.text(path)
    from flowsight.session import fs_list
    file = next(p for p in fs_list(spark, path) if p.endswith(".txt"))
    assert C.first_line(spark, file).split(",") == names


def test_no_column_is_cut(spark):
    cols = [f"c{i}" for i in range(16)]
    df = spark.createDataFrame([(1, 2, *map(float, range(16)))], "src long, dst long, " + ", ".join(f"{c} double" for c in cols))
    for x, names in ((G.static_node_features(df, cols), [f"src_{c}_mean" for c in cols]),
                     (G.flow_edges(df, cols), cols), (G.node_matrix(df, cols), cols)):
        assert set(names) <= set(x.columns)


def test_index_of_string_addresses(spark):
    e = spark.createDataFrame([("10.0.0.9", "10.0.0.10"), ("1.1.1.1", "10.0.0.9")], "src string, dst string")
    idx, edges = G.index_nodes(e)
    assert {r.node: r.idx for r in idx.collect()} == {"1.1.1.1": 0, "10.0.0.10": 1, "10.0.0.9": 2}
    assert {(r.src_idx, r.dst_idx) for r in edges.collect()} == {(2, 1), (0, 2)}


def test_sequence_stream_takes_flows_in_any_order(spark):
    base = scratch(spark, "seqs")
    rng = random.Random(3)
    rows = [(i, i, float(i)) for i in range(900)]
    schema = D.FLOW_SCHEMA
    def frame(part):
        rng.shuffle(part)
        x = spark.createDataFrame(part, "id long, s long, value double").withColumn("ts", F.timestamp_seconds("s"))
        cols = [c.split()[0] for c in schema.split(", ")]
        kinds = dict(c.split() for c in schema.split(", "))
        given = {"id", "ts", "value"}
        return x.select(*[F.col(c) if c in given else F.lit("10.0.0.1" if c == "src_ip" else "10.0.0.2" if c == "dst_ip" else None)
                          .cast(kinds[c]).alias(c) for c in cols])
    for lo, hi in ((0, 500), (500, 900)):
        frame(rows[lo:hi]).write.mode("append").parquet(base + "/src")
        D.sequence_stream(D.flow_stream(spark, base + "/src"), ["value"], base + "/out", base + "/state", base + "/ck", 5).awaitTermination()
    got = {r.id: [v[0] for v in r.padded] for r in spark.read.parquet(base + "/out").collect()}
    assert got == {i: [0.0] * max(0, 4 - i) + [float(j) for j in range(max(0, i - 4), i + 1)] for i in range(900)}


def test_detector_marks_late_flows(spark):
    base = scratch(spark, "late")
    def flows(ids, at):
        x = spark.createDataFrame([(i, at) for i in ids], "id long, s long").withColumn("ts", F.timestamp_seconds("s"))
        kinds = dict(c.split() for c in D.FLOW_SCHEMA.split(", "))
        fixed = {"src_ip": "10.0.0.1", "dst_ip": "10.0.0.2", "predicted_attack": "Normal", "risk_label": "Low"}
        return x.select(*[F.col(c) if c in ("id", "ts") else F.lit(fixed.get(c, 0)).cast(k).alias(c) for c, k in kinds.items()])
    for ids, at in (([1, 2], 1000), ([3], 900), ([4], 1001)):
        flows(ids, at).write.mode("append").parquet(base + "/src")
        D.detect_stream(D.flow_stream(spark, base + "/src"), base + "/out", base + "/state", base + "/ck").awaitTermination()
    got = {r.id: r.late for r in spark.read.parquet(base + "/out/flows").collect()}
    assert got == {1: False, 2: False, 3: True, 4: False}
    from flowsight.session import fs_list
    assert len([p for p in fs_list(spark, base + "/state") if "tail_" in p]) <= 3


def test_batch_risk_uses_what_each_flow_has(spark):
    flows = spark.createDataFrame([(1, "s"), (2, "s"), (3, "t")], "id long, src string")
    part = lambda name, rows, key: spark.createDataFrame(rows, f"{key} {'long' if key == 'id' else 'string'}, {name} double")
    x = K.batch_risk(flows, {"classifier": (part("classifier", [(1, 0.5), (2, 1.0), (3, 0.0)], "id"), "id"),
                             "graph": (part("graph", [("s", 100.0)], "src"), "src"),
                             "sequence": (part("sequence", [(2, 1.0)], "id"), "id")})
    got = {r.id: (r.risk_score, r.risk_label) for r in x.collect()}
    from flowsight import dims
    w = dims.ENSEMBLE_WEIGHTS
    assert abs(got[1][0] - 100 * (0.5 * w["classifier"] + w["gnn"]) / (w["classifier"] + w["gnn"])) < 1e-9
    assert got[2] == (100.0, "Critical") and got[3] == (0.0, "Low")
    share = {r.risk_label: (r.n, r.share) for r in K.risk_distribution(x).collect()}
    assert share["Low"] == (1, 1 / 3)


def test_balance_methods(spark):
    df = spark.createDataFrame([(i, "a" if i < 9 else "b", [float(i), 1.0]) for i in range(12)], "id long, Label string, vec array<double>")
    size = lambda x: {r.Label: r["count"] for r in x.groupBy("Label").count().collect()}
    assert size(ml.balance(df, "none")) == {"a": 9, "b": 3}
    assert size(ml.balance(df, "oversample")) == {"a": 9, "b": 9} == size(ml.balance(df, "smote"))
    assert {r.Label: r.weight for r in ml.balance(df, "weight").collect()} == {"a": 12 / 18, "b": 2.0}
    with pytest.raises(ValueError):
        ml.balance(df, "other")


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from flowsight import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Conf(dict):
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())


def test_pagerank_stops_at_its_tolerance(spark):
    from flowsight.sources.tables import flows
    e = G.distinct_edges(flows(spark, SF001))
    a = {r.node: r.pr for r in G.pagerank(e, tol=1e-6).collect()}
    b = {r.node: r.pr for r in G.pagerank(e, tol=1e-12).collect()}
    assert abs(sum(a.values()) - 1) < 1e-9 and all(abs(a[k] - b[k]) < 1e-5 for k in b)


def test_weights_of_missing_labels(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(20)], "id long, Label string")
    got = {(r.id, r.weight) for r in ml.class_weight_column(df, "Label").collect()}
    assert got == {(i, 1.0) for i in range(20)}


def test_smote_of_a_lone_row_repeats_it(spark):
    from flowsight.operators.knn import smote
    rows = [(i, "a", [float(i), 1.0]) for i in range(8)] + [(100, None, [5.0, 6.0])]
    df = spark.createDataFrame(rows, "id long, label string, vec array<double>")
    new = smote(df, "label").collect()
    assert len(new) == 7 and all(r.label is None and r.base_id == 100 and r.vec == [5.0, 6.0] for r in new)
