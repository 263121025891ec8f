import hashlib

import pytest
from conftest_llm import docs_of
from pyspark.sql import functions as F

from cohortlens.llm import merkle as op


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests):
    """The root, and for every leaf its siblings level by level as (left, right)."""
    ways, levels, at = [[] for _ in digests], [list(digests)], list(range(len(digests)))
    while len(levels[-1]) > 1:
        now = levels[-1]
        for i, a in enumerate(at):
            run = 3 * (a // 3)
            ways[i].append((now[run:a], now[a + 1:run + 3]))
        at = [a // 3 for a in at]
        levels.append([h(*now[i:i + 3]) for i in range(0, len(now), 3)])
    return (levels[-1] or [None])[0], ways


def manifest(rows):
    """By brute force: (doc_id, leaf, subroot, root, siblings) of rows (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for d, t, lang, s, n in rows:
        groups.setdefault(s, []).append((d is not None, d or 0, leaf((d, s, lang, n, t)), d))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([r[2] for r in sorted(groups[s], key=lambda r: r[:3])]) for s in names}
    root, upper = tree([trees[s][0] for s in names])
    return sorted((str(r[3]), r[2], trees[s][0], root, "".join("".join(a + b) for a, b in way + upper[i]))
                  for i, s in enumerate(names) for r, way in zip(sorted(groups[s], key=lambda r: r[:3]), trees[s][1]))


def rows_of(*sizes):
    sources = [None, "", "a", "é", "Z", "a\U0001F600", "￿"]
    return [(1000 * i + j, f"text {j}\nof {i}", None if j % 5 == 0 else "en", sources[i % 7] if i < 7 else f"s{i}", j)
            for i, size in enumerate(sizes) for j in range(size)]


@pytest.mark.parametrize("height,sizes", [(1, (1,)), (1, (2, 3, 4, 1, 9, 10, 28)), (2, (82, 1, 30)), (1, (1,) * 29), (6, (5, 40))])
def test_equal_to_brute_force(spark, monkeypatch, height, sizes):
    monkeypatch.setattr(op, "HEIGHT", height)
    rows = rows_of(*sizes)
    docs = spark.createDataFrame(rows[::-1], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = op.manifest(docs, altered={"text": F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})
    got = got.select("*", op.proof(F.col("path")).alias("proof")).collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof) for r in got) == manifest(rows)
    assert all(r.verified == (r.doc_id % 2 == 1) and (r.folded_root == r.root) == r.verified for r in got)
    assert all(op.folded(r.leaf, r.path) == r.root for r in got)


def test_odd_tables(spark):
    rows = [(None, None, None, None, None), (None, "x", None, None, None), (7, "", "", "", 0), (7, None, "", "", 0), (7, "", "", "", 0),
            (8, "same", "en", "s", 4), (8, "same", "en", "s", 4), (9, "long " * 200_000, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, 1, "p", "q") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                 "at int, tree string, path string")
    got = op.manifest(docs).select("*", op.proof(F.col("path")).alias("proof")).collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof) for r in got) == manifest(rows)
    assert all(r.verified for r in got)
    assert op.manifest(docs_of(spark, [])).count() == 0


def test_every_field_is_covered(spark):
    docs = docs_of(spark, ["one", "two\n", None])
    root = op.manifest(docs).first().root
    for change in ({"text": F.concat("text", F.lit(" "))}, {"lang": F.lit("de")}, {"n_chars": F.lit(None).cast("bigint")}, {"source": F.lit("t")}):
        got = op.manifest(docs, altered=change).collect()
        assert [r.verified for r in got if r.doc_id == 0] == [False]
        assert {r.root for r in got} == {root}


def test_a_large_group_spreads_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(op, "HEIGHT", 2)
    rows = [(i, str(i), "en", "hot" if i % 3 else f"s{i % 5}", 1) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    leaves = docs.select(F.col("source").alias("tree"), "doc_id").repartition(8)
    kept, save = [], op.saved
    monkeypatch.setattr(op, "saved", lambda df, name: kept.append(save(df, name)) or kept[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = op.placed(leaves, ["doc_id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, seen = {}, {}
    for i, _, _, s, _ in rows:
        want[i] = seen[s] = seen.get(s, -1) + 1
    assert {r.doc_id: r["at"] for r in got.collect()} == want
    assert {r.n for r in got.where("tree = 'hot'").collect()} == {1000}
    assert kept[0].where("tree = 'hot'").select("part").distinct().count() > 1
