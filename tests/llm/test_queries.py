"""Every registered query against its SQL, the pipeline against its parts."""
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm_cases import SF001, SF01, documents
from oracle_check import compare, duck
from flowsight.llm import decontaminate, exact_dedup, mixing, simhash, toxicity
from flowsight.llm.queries import ORACLE, QUERIES, held_out


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF01), duck(SF01), ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"op8_decontaminate", "op12_packing"}))
def test_query_without_sql_has_a_row_per_document(spark, name):
    out = QUERIES[name](spark, SF001)
    assert out.count() == documents(spark, SF001).count() and out.select("doc_id").distinct().count() == out.count()


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as cp
    docs = documents(spark, SF01)
    # the longest texts again, with a word more: near copies
    long = docs.orderBy(F.desc("n_chars")).limit(6)
    docs = docs.unionByName(long.withColumns({"doc_id": F.col("doc_id") + 1_000_000, "text": F.concat("text", F.lit(" once"))}))
    labels, bench = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: Counter(r[0] for r in df.select("doc_id").collect())
    frames, now = {}, docs
    for name, stage in cp.STAGES:
        now = stage(spark, now, SF01).cache()
        frames[name] = now
    assert all(frames[n].columns == docs.columns for n, _ in cp.STAGES[:-1])
    toxic = toxicity.score(docs, toxicity.train(docs, labels, ~held_out(3, 1))).where("predicted = 1")
    assert ids(frames["toxicity"]) == ids(docs) - ids(toxic)
    kept = exact_dedup.exact_dedup(frames["toxicity"], held_out(2, 1)).where("kept")
    assert ids(frames["exact_dedup"]) == ids(kept)
    near = simhash.near_duplicates(frames["exact_dedup"]).where("doc_id = component_id")
    assert ids(frames["simhash"]) == ids(near)
    leaked = decontaminate.contaminated(frames["simhash"], bench).select("doc_id").distinct()
    assert ids(frames["decontaminate"]) == ids(frames["simhash"]) - ids(leaked)
    assert sum(ids(toxic).values()) and sum(ids(leaked).values())
    assert len(frames["exact_dedup"].collect()) < len(frames["toxicity"].collect())
    assert len(frames["simhash"].collect()) < len(frames["exact_dedup"].collect())
    want = Counter(map(tuple, mixing.mix(frames["decontaminate"]).select(*frames["mixing"].columns).collect()))
    assert Counter(map(tuple, frames["mixing"].collect())) == want


def test_pipeline_runs_its_stages_in_order(spark):
    import corpus_pipeline as cp
    now = documents(spark, SF001)
    for _, stage in cp.STAGES:
        now = stage(spark, now, SF001)
    assert Counter(map(tuple, cp.run(spark, SF001).collect())) == Counter(map(tuple, now.collect()))


def test_pipeline_of_awkward_rows(spark, awkward, empty):
    import corpus_pipeline as cp
    for docs in (awkward, empty):
        now = docs
        for _, stage in cp.STAGES:
            now = stage(spark, now, SF001)
        assert now.count() <= docs.count()
    assert now.count() == 0
