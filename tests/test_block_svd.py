import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import block_svd as op, lsi
from cohortlens.session import cut_lineage
from cohortlens.sources import store


def table(spark, matrices):
    rows = [(name, f"p{i}", int(j), float(a[i, j])) for name, a in matrices.items() for i, j in zip(*np.nonzero(a))]
    return spark.createDataFrame(rows, "scope string, pid string, term_id int, w double")


def sparse(rng, n, m, share):
    return np.where(rng.random((n, m)) < share, rng.gamma(1.0, 1.0, (n, m)), 0.0)


def test_many_matrices_at_once(spark, monkeypatch):
    monkeypatch.setattr(op, "SLICE_TERMS", 37)
    monkeypatch.setattr(op, "BLOCK_ENTRIES", 900)
    monkeypatch.setattr(op, "CHUNK_ENTRIES", 64)
    monkeypatch.setattr(op, "TASK_NUMBERS", 1500)
    monkeypatch.setattr(op, "OVERSAMPLE", 4)
    rng = np.random.default_rng(1)
    low = rng.standard_normal((60, 3)) @ rng.standard_normal((3, 50))
    matrices = {"flat": sparse(rng, 300, 180, 0.1), "tall": sparse(rng, 400, 12, 0.3), "low": low, "one": np.array([[0.0, 0.0, 3.0]])}
    basis, values = lsi.fit_all_topics(table(spark, matrices), 8, ("scope",))
    for name, a in matrices.items():
        s = np.linalg.svd(a, compute_uv=False)
        want = s[:8][s[:8] > 1e-6 * s[0]]
        got = [r.s for r in values.where(F.col("scope") == name).orderBy("topic").collect()]
        assert np.allclose(got, want, rtol=1e-9, atol=1e-7), name
        v = np.zeros((a.shape[1], len(got)))
        for r in basis.where(F.col("scope") == name).collect():
            v[r.term_id, r.topic] = r.v
        assert np.allclose(v.T @ v, np.eye(len(got)), atol=1e-10)
        assert np.allclose(a.T @ (a @ v), v * want**2, atol=1e-6 * s[0] ** 2)
        assert (v[np.abs(v).argmax(axis=0), range(len(got))] > 0).all()


def test_no_entries(spark):
    basis, values = lsi.fit_topics(spark.createDataFrame([], "pid string, term_id int, w double"), 5)
    assert basis.columns == ["term_id", "topic", "v"] and values.columns == ["topic", "s"] and basis.count() + values.count() == 0


@pytest.mark.parametrize("times", [1, 3])
def test_repeated_runs_are_equal(spark, times):
    a = {"a": sparse(np.random.default_rng(7), 80 * times, 30, 0.2)}
    runs = [sorted(map(tuple, lsi.fit_all_topics(table(spark, a).repartition(n), 4, ("scope",))[0].collect())) for n in (2, 5)]
    assert [r[:3] for r in runs[0]] == [r[:3] for r in runs[1]]
    assert np.allclose([r[3] for r in runs[0]], [r[3] for r in runs[1]], atol=1e-7)


def test_a_small_matrix_has_a_block_for_each_core(spark, monkeypatch):
    monkeypatch.setattr(op, "LEAST_ENTRIES", 100)
    cut, made = [], op._row_blocks
    monkeypatch.setattr(op, "_row_blocks", lambda entries: cut.append(made(entries)) or cut[0])
    a = sparse(np.random.default_rng(3), 200, 30, 0.5)
    values = lsi.fit_topics(table(spark, {"a": a}).drop("scope"), 4)[1]
    assert cut[0].count() > 1
    assert np.allclose([r.s for r in values.orderBy("topic").collect()], np.linalg.svd(a, compute_uv=False)[:4], rtol=1e-9)


def test_matrices_of_shared_rows(spark, monkeypatch):
    monkeypatch.setattr(op, "SLICE_TERMS", 16)
    monkeypatch.setattr(op, "BLOCK_ENTRIES", 200)
    monkeypatch.setattr(op, "TASK_NUMBERS", 700)
    monkeypatch.setattr(op, "ROW_NUMBERS", 40)
    monkeypatch.setattr(op, "OVERSAMPLE", 4)
    a = sparse(np.random.default_rng(5), 120, 40, 0.2)
    rows = table(spark, {"a": a}).drop("scope")
    listed = {"all": list(range(120)), "odd": list(range(1, 120, 2)), "twice": [*range(30), *range(20)], "nobody": [500], None: [1]}
    members = spark.createDataFrame([(s, f"p{i}") for s, ids in listed.items() for i in ids] + [("odd", None)], "scope string, pid string")
    basis, values = lsi.fit_all_topics(rows, 3, ("scope",), members)
    found = {s: [r.s for r in values.where(F.col("scope") == s).orderBy("topic").collect()] for s in ("all", "odd", "twice")}
    assert {r.scope for r in values.collect()} == set(found) == {r.scope for r in basis.select("scope").distinct().collect()}
    for s, got in found.items():
        times = np.bincount(listed[s], minlength=120)
        v = np.zeros((40, 3))
        for r in basis.where(F.col("scope") == s).collect():
            v[r.term_id, r.topic] = r.v
        own = a * times[:, None]
        assert np.allclose(got, np.linalg.svd(own, compute_uv=False)[:3], rtol=1e-9), s
        assert np.allclose(own.T @ (own @ v), v * np.array(got) ** 2, atol=1e-6 * got[0] ** 2)


def test_products_move_sums_and_not_the_matrix(spark):
    a = sparse(np.random.default_rng(3), 200, 30, 0.5)
    plans, made = [], op._Kept.save

    def seen(self, df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return made(self, df)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(op._Kept, "save", seen)
        lsi.fit_topics(table(spark, {"a": a}).drop("scope"), 4)
    passes = [p for p in plans if "mapInArrow" in p or "MapInArrow" in p]
    assert passes and not any("CoGroup" in p for p in plans)


def test_shuffles_of_saved_results_are_freed(spark, tmp_path):
    def files():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("/shuffle_")

    def grown(make):
        before = files()
        make()
        for _ in range(50):
            if files() <= before:
                return 0
            time.sleep(0.2)
        return files() - before

    counts = spark.range(50_000).groupBy((F.col("id") % 20_011).alias("k")).count()
    assert grown(lambda: store.save(counts, str(tmp_path / "counts"))) == 0
    assert grown(lambda: cut_lineage(counts)) == 0
    assert sorted(r[0] for r in cut_lineage(counts).groupBy("count").count().collect()) == [2, 3]
