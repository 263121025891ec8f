import random

import pytest
from conftest_llm import docs_of
from pyspark.sql import functions as F

from cohortlens.llm import near_dedup as op


def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(2, 6))) for _ in range(n))


def changed(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = prose(rng, 1)
    return " ".join(words)


def check(spark, texts):
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op.near_duplicates(docs_of(spark, texts)).collect())
    assert got == brute(texts)


def test_against_all_pairs(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(30)]
    for base in texts[:12]:
        texts += [changed(rng, base, k) for k in (0, 1, 2, 3)]
    chain = prose(rng, 200)
    for _ in range(6):
        chain = changed(rng, chain, 3)
        texts.append(chain)
    texts += [None, "", "  \n ", "one", "One", "two words", "TWO\twords", "É x y z w v", "é x y z w v", texts[0].upper(), texts[1] + " end"]
    rng.shuffle(texts)
    check(spark, texts)


@pytest.mark.parametrize("crowded", [2, 5])
def test_crowded_regions(spark, monkeypatch, crowded):
    monkeypatch.setattr(op, "CROWDED", crowded)
    rng = random.Random(2)
    base, passage = prose(rng, 150), prose(rng, 40)
    texts = [changed(rng, base, rng.randint(0, 3)) for _ in range(40)] + [prose(rng, 40) + " " + passage for _ in range(15)]
    check(spark, texts)


def test_odd_tables(spark):
    assert op.near_duplicates(docs_of(spark, [])).count() == 0
    docs = docs_of(spark, ["a b c d e f", "a b c d e f", "q r s"]).unionByName(docs_of(spark, ["a b c d e f"]))
    docs = docs.withColumnsRenamed({"lang": "node", "source": "signature", "n_chars": "key"})
    rows = sorted((r.doc_id, r.component_id) for r in op.near_duplicates(docs).collect())
    assert rows == [(0, 0), (0, 0), (1, 0), (2, 2)]
    kept = op.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 0, 2]
    nulls = docs.selectExpr("cast(null as bigint) doc_id", "text")
    assert all(r.kept and r.component_id is None for r in op.near_duplicates(nulls).collect())


@pytest.mark.parametrize("block_rows", [100, 1024])
def test_pairs_in_a_large_family_that_its_first_node_does_not_link(spark, monkeypatch, block_rows):
    monkeypatch.setattr(op, "BLOCK_ROWS", block_rows)
    rng = random.Random(3)
    shared = prose(rng, 124)
    texts = [shared + " " + prose(rng, 26) for _ in range(500)]
    for text in texts[:60]:
        words = text.split(" ")
        texts.append(" ".join(words[:131] + prose(rng, 19).split(" ")))
    rng.shuffle(texts)
    assert sum(not kept for *_, kept in brute(texts)) == 60
    check(spark, texts)


def test_null_ids_do_not_name_a_component(spark):
    docs = docs_of(spark, ["a b c d e f"] * 3).selectExpr("nullif(doc_id, 0) doc_id", "text")
    assert {(r.doc_id, r.component_id, r.kept) for r in op.near_duplicates(docs).collect()} == {(None, 1, False), (1, 1, True), (2, 1, False)}


def test_pairs_of_blocks_are_dealt_apart(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_ROWS", 10)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(200).select((F.col("id") * 0).alias("tree"), (F.col("id") * 0).alias("region"), F.col("id").cast("string").cast("binary").alias("node"))
        found = op.in_blocks(rows, F.lit(1)).groupBy("tree", "region", "i", "j").count()
        dealt = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
        assert any(" i#" in x and " j#" in x for x in dealt)
        assert found.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
