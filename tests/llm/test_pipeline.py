import hashlib
import random

import numpy as np
import pytest
from conftest_llm import docs_of
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import mixing, packing
from cohortlens.llm.common import words_and_end

SF = "/root/testdata/sf0.001"


def test_rake_reaches_the_marginals():
    rng = np.random.default_rng(1)
    table = rng.integers(1, 50, (4, 3, 2)).astype(float)
    goals = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.25, 0.25]), np.array([0.7, 0.3])]
    got = mixing.rake(table, goals)
    for axis, goal in enumerate(goals):
        assert np.allclose(got.sum(axis=tuple(a for a in range(3) if a != axis)) / got.sum(), goal, atol=1e-7)
    assert np.isclose(got.sum(), table.sum()) and mixing.rake(np.zeros((2, 2)), [np.ones(2) / 2] * 2).sum() == 0
    table[0] = 0  # an empty slice has no share
    assert np.isfinite(mixing.rake(table, goals)).all()


def test_calibrated_keeps_the_share():
    weights, ratio = np.array([10.0, 5.0, 1.0, 0.0]), np.array([0.5, 2.0, 40.0, 0.0])
    for keep in (0.1, 0.5, 0.95):
        p = mixing.calibrated(ratio, weights, keep)
        assert (p <= 1).all() and np.isclose((p * weights).sum(), keep * weights.sum(), rtol=1e-6)


def test_mix_moves_towards_targets(spark):
    rng = random.Random(1)
    texts = ["word " * rng.randint(1, 30) for _ in range(4000)]
    docs = docs_of(spark, texts).withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("s"), F.col("doc_id") % 7)).otherwise("hot"))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 11 == 0, None).otherwise("en"))
    size = F.length("text") / 5
    targets = {"source": {"hot": 0.3, **{f"s{i}": 0.1 for i in range(7)}}}
    out = mixing.mix(docs, {"source": F.col("source"), "lang": F.col("lang")}, size, targets, keep=0.4)
    assert out.columns == docs.columns
    shares = {r.source: r.w for r in out.groupBy("source").agg(F.sum(size).alias("w")).collect()}
    assert abs(shares["hot"] / sum(shares.values()) - 0.3) < 0.04
    again = mixing.mix(docs, {"source": F.col("source"), "lang": F.col("lang")}, size, targets, keep=0.4)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in again.collect())
    assert mixing.mix(docs_of(spark, []), {"source": F.col("source")}, size).count() == 0
    assert mixing.mix(docs_of(spark, [None, ""]), {"topic": mixing.topic(F.col("text"))}, size, keep=1.0).count() == 2


def test_chances_equal_brute_force(spark):
    rng = random.Random(8)
    langs, sources = ["en", "de", None], ["hot", "a", "b", None]
    rows = [(None if i % 97 == 5 else i // 2 if i % 50 == 1 else i, rng.choice(["x y z ", "x ", "| a | b ", "! "]) * rng.randint(0, 9), rng.choice(langs),
             rng.choices(sources, [9, 3, 2, 1])[0]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    axes = {"source": F.col("source"), "lang": F.col("lang")}
    targets = {"lang": {"en": 0.5, "de": 0.25, "\0null": 0.25}}
    got = mixing.chances(docs, axes, words_and_end(F.col("text")), targets, keep=0.6).collect()
    weights = {}
    for _, text, lang, source in rows:
        weights[source, lang] = weights.get((source, lang), 0) + max(1, len(text.split()) + 1 if text.split() else 0)
    total = sum(weights.values())
    by = lambda axis, w: {v: sum(x for k, x in w.items() if k[axis] == v) for v in {k[axis] for k in w}}
    powered = {s: n**0.7 for s, n in by(0, weights).items()}
    goals = [{s: n / sum(powered.values()) for s, n in powered.items()}, {"en": 0.5, "de": 0.25, None: 0.25}]
    now = dict(weights)
    for _ in range(400):
        for axis in (0, 1):
            have = by(axis, now)
            now = {k: w * goals[axis][k[axis]] * total / have[k[axis]] for k, w in now.items()}
    ratio = {k: now[k] / weights[k] for k in now}
    low, high = 0.0, 1e6
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if sum(w * min(1, c * ratio[k]) for k, w in weights.items()) < 0.6 * total else (low, c)
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.probability - min(1, high * ratio[r.row.source, r.row.lang])) < 1e-6
        digest = hashlib.sha256(f"{chr(0) + 'null' if r.row.doc_id is None else r.row.doc_id}:17".encode()).hexdigest()
        assert r.kept == (int(digest[:13], 16) / 2**52 < r.probability)
    by_id = {}
    for r in got:
        by_id.setdefault((r.row.doc_id, r.cell), set()).add(r.kept)
    assert all(len(kept) == 1 for kept in by_id.values())


def test_best_fit():
    rng = random.Random(2)
    for capacities in ((8,), (4, 8, 16), (100, 1000)):
        lengths = [rng.randint(1, max(capacities)) for _ in range(500)] + [max(capacities)] * 3 + [1]
        found = packing.best_fit(lengths, capacities, 1)
        bins = {}
        for n, (b, offset, size) in zip(lengths, found):
            bins.setdefault(b, []).append((offset, n, size))
        for pieces in bins.values():
            pieces.sort()
            total = sum(n for _, n, _ in pieces)
            assert [o for o, _, _ in pieces] == [sum(n for _, n, _ in pieces[:i]) for i in range(len(pieces))]
            assert {s for _, _, s in pieces} == {min(c for c in capacities if c >= total)}
        assert sum(lengths) >= 0.9 * sum(p[0][2] for p in bins.values())
    assert packing.best_fit([], (8,)) == []


def total_cost(found, **parameters):
    return sum(packing.sequence_cost(c, **parameters) for c in {b: c for b, _, c in found}.values())


def test_sizes_are_chosen_by_cost():
    rng = random.Random(3)
    lengths = [min(8192, max(1, int(rng.lognormvariate(5.5, 1.2)))) for _ in range(4000)]
    capacities = (512, 1024, 2048, 4096, 8192)
    found = packing.best_fit(lengths, capacities)
    used = {c: len({b for b, _, x in found if x == c}) for c in capacities}
    assert sum(n > 10 for n in used.values()) >= 3 and used[8192] < sum(used.values()) / 2
    short = [n for n in lengths if n <= 512]
    for sizes, pieces in ((capacities, short), (capacities, lengths), ((512, 1024), short)):
        for attention in (1 << 12, 1 << 17, 1 << 30):
            best = total_cost(packing.best_fit(pieces, sizes, attention=attention), attention=attention)
            for c in sizes:
                if c >= max(pieces):
                    assert best <= total_cost(packing.best_fit(pieces, (c,), attention=attention), attention=attention)


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1:]]


def test_small_inputs_against_all_packings():
    rng, capacities, ratios = random.Random(5), (4, 8, 16), []
    for _ in range(60):
        lengths = [rng.randint(1, 16) for _ in range(rng.randint(1, 7))]
        held = lambda b: min(c for c in capacities if c >= sum(b))
        best = min(sum(packing.sequence_cost(held(b), 2, 64) for b in p) for p in partitions(lengths) if all(sum(b) <= 16 for b in p))
        got = total_cost(packing.best_fit(lengths, capacities, 2, 64), bin_cost=2, attention=64)
        ratios.append(got / best)
    assert min(ratios) >= 1 - 1e-12 and max(ratios) < 1.4 and sum(ratios) / len(ratios) < 1.06


def test_odd_rows_are_packed(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "c"), (3, "c"), (4, None)], "doc_id bigint, text string")
    rows = packing.pack(docs, words_and_end(F.col("text"))).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == [("3", 2), ("3", 2), ("None", 3), ("None", 3)]
    assert len({(r.bin, r.offset) for r in rows}) == 4


CLASHING = ("row", "cell", "tokens", "place", "probability", "kept", "id", "number", "digest", "spans", "quality", "dropped", "_quality", "_row", "_digest",
            "_p", "_axis0", "component_id", "n_shingles", "node", "key", "a.b")


@pytest.mark.parametrize("repeated", [False, True])
def test_columns_of_any_name_come_back(spark, repeated):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60)) for _ in range(12)]
    docs = docs_of(spark, [*texts, *texts[:3]])
    docs = docs.unionByName(docs.where("doc_id = 1")) if repeated else docs
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        found = out.collect()
        assert found and all(r[c] == f"{c}{r.doc_id}" for r in found for c in CLASHING), name
    assert packing.pack(docs, F.lit(3)).select("doc_id", "n_tokens").distinct().count() == 15


def test_stages_of_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs_of(spark, []), SF).count() == 0


def test_pack_covers_every_token(spark):
    docs = docs_of(spark, [None, "", "a", "bb " * 3000, *("word " * n for n in range(1, 60))]).withColumnsRenamed({"lang": "bin", "source": "piece"})
    rows = packing.pack(docs, corpus_pipeline.words(F.col("text")), capacities=(16, 64), group_rows=20).collect()
    sums = {}
    for r in rows:
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.n_tokens
        assert r.offset + r.n_tokens <= r.capacity
    assert sums == {2: 2, 3: 3001, **{3 + n: n + 1 for n in range(1, 60)}}
    assert packing.pack(docs_of(spark, []), F.lit(3)).count() == 0


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    last = len(corpus_pipeline.STAGES) - 1
    counts = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.saved(stage(spark, docs, SF), "test-stage")
        if i < last:
            assert out.columns == docs.columns
            docs = out
        counts.append(out.select("doc_id").distinct().count())
    assert counts[0] > counts[1] > counts[2] == counts[3] > counts[4] >= counts[5] > 0


def test_a_document_delivered_twice_stays_once(spark):
    rng = random.Random(4)
    text, other, unnamed = (" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(80)) for _ in range(3))
    docs = docs_of(spark, [text, other, unnamed, ""])
    docs = docs.unionByName(docs.where("doc_id = 0")).withColumn("doc_id", F.expr("nullif(doc_id, 2)"))
    docs = docs.unionByName(docs.where("doc_id is null"))
    kept = corpus_pipeline.saved(corpus_pipeline.near_duplicates(spark, docs, SF), "test-once")
    clean = corpus_pipeline.repeated_passages(spark, kept, SF)
    assert clean.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in clean.collect()) == sorted([("0", text), ("1", other), ("3", ""), ("None", unnamed)])
