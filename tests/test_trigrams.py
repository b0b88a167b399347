"""Trigram postings: equal to the scan for a thousand substrings, and only matching rows are read."""
import random

import pytest
from pyspark.sql import functions as F

from cases import SF001
from flowsight.operators import trigrams as T
from flowsight.operators.attack import search_techniques
from flowsight.sources.tables import table

AWKWARD = [("t1", "Ab", "x"), ("t2", None, None), ("t3", "", "ÄÖ€𝄞 ab"), ("t4", "aaaaaa", "AAAA"), ("t4", "a", "")]


@pytest.fixture(scope="module", params=[65_536, 7])
def index(spark, request, tmp_path_factory):
    """The index of documents and awkward rows; small blocks too."""
    d = table(spark, SF001, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("name"),
                                                F.col("text").alias("description"))
    kb = (d if request.param > 7 else d.where("doc_id < 60")).unionByName(
        spark.createDataFrame(AWKWARD, "id string, name string, description string")).checkpoint()
    path = str(tmp_path_factory.mktemp("kb"))
    T.build_index(kb, path, buckets=8, block=request.param)
    return kb, path


def test_a_thousand_substrings_equal_the_scan(spark, index):
    kb, path = index
    rows = [(r.id, [(x or "").lower() for x in (r.name, r.description)]) for r in kb.collect()]
    rng = random.Random(4)
    wanted = ["ab", "a", "€", "zzzzzzq", "aaaaaaa", "AAAA", "𝄞 a"]
    texts = [f for _, fs in rows for f in fs if f]
    while len(wanted) < 1000:
        t = rng.choice(texts)
        a = rng.randrange(len(t))
        wanted.append(t[a:a + rng.choice([1, 2, 3, 4, 6, 10, 20])])
    q = spark.createDataFrame(list(enumerate(wanted)), "key long, query string")
    got = sorted((r.key, r.id) for r in T.search_many(q, path).collect())
    want = sorted((k, i) for k, s in enumerate(wanted) for i, fs in rows if any(s.lower() in f for f in fs))
    assert got == want


@pytest.mark.parametrize("query", ["the", "A", "ab", "ÖÄ", "ÄÖ", "", "aaaaaa", "not to be found"])
def test_one_search_equals_the_scan(spark, index, query):
    kb, path = index
    assert [r.id for r in T.search(spark, path, query, None).collect()] == [r.id for r in search_techniques(kb, query, None).collect()]


def test_reads_only_matching_postings(spark, index, capsys):
    _, path = index
    rows, terms = T.postings(spark, path, "denial", 8)
    rows.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(", "") and "In(term" in plan
    assert {r.term for r in rows.select("term").distinct().collect()} <= set(terms)
    assert rows.groupBy("term", "blk").count().where("count > 1").count() == 0
