import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions.keys import bucket, bucket_of, is_test
from cohortlens.functions.text import found_words, tokens
from cohortlens.operators import documents, lsi, terms, vectors

SCOPES = ["s1", "s2"]
RULES = terms.VocabularyRules(min_case_count=2, min_control_count=3, top_case_terms=4, total_terms=7)
WORDS = [f"{a}{b}word" for a in "abcd" for b in "xyz"]


@pytest.fixture(scope="module")
def world():
    rnd = random.Random(3)
    docs = {f"p{i}": [rnd.choice(WORDS[: 4 + i % 9]) for _ in range(rnd.randint(0, 25))] for i in range(80)}
    members = [("s1", p, int(i % 4 == 0)) for i, p in enumerate(docs) if i % 7] + [("s2", p, int(i % 3 == 0)) for i, p in enumerate(docs) if i % 2]
    return docs, members


def spec_counts(docs, members, scope):
    df, tf, people = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}, Counter()
    for s, pid, y in members:
        if s == scope and bucket_of(pid) < 8000 and pid in docs:
            people[y] += 1
            tf[y].update(docs[pid])
            df[y].update(set(docs[pid]))
    return df, tf, people


def spec_vocabulary(df, tf, people, odds, rules):
    out = set()
    ratios = {}
    for t in df[1]:
        a, o, A, O = df[1][t], df[0][t], people[1], people[0]
        if a > rules.case_share * A or o == 0 or o > rules.control_share * O or a == A or o == O:
            out.add(t)
            continue
        ratios[t] = (a / (A - a)) / (o / (O - o))
        if ratios[t] >= odds or ratios[t] <= 1 / odds:
            out.add(t)
    out |= {t for t in df[0] if df[0][t] > rules.control_share * people[0]}
    first = [(t, tf[1][t] + tf[0][t]) for t in sorted(tf[1], key=lambda t: (-tf[1][t], t))
             if t not in out and tf[1][t] >= rules.min_case_count and tf[0][t] >= rules.min_control_count][: rules.top_case_terms]
    rest = [(t, tf[0][t]) for t in sorted(tf[0], key=lambda t: (-tf[0][t], t))
            if t not in out and t not in tf[1] and tf[0][t] >= rules.min_control_count]
    return ratios, (first + rest)[: rules.total_terms]


@pytest.fixture(scope="module")
def frames(spark, world):
    docs, members = world
    rows = []
    for i, (pid, words) in enumerate(docs.items()):
        if i % 10 == 0 and len(words) > 3:  # held in pieces
            rows += [(pid, 0, 2, " ".join(words[:3]) + " "), (pid, 1, 2, " ".join(words[3:]))]
        else:
            rows.append((pid, 0, 1, " ".join(words)))
    d = spark.createDataFrame(rows, "pid string, part int, parts int, text string")
    masks = terms.membership_masks(spark.createDataFrame(members, "scope string, pid string, label int"), SCOPES)
    return d, masks


def test_counts_ratios_vocabulary(spark, world, frames):
    docs, members = world
    d, masks = frames
    counts, people = terms.term_counts(d, masks, SCOPES), terms.patient_counts(d, masks, SCOPES)
    got = {(r.scope, r.token): (r.case_df, r.case_tf, r.ctrl_df, r.ctrl_tf) for r in counts.collect()}
    vocab = [(r.scope, r.odds, r.term_id, r.token, r.cf) for r in terms.vocabulary(counts, people, (1.5, 3.5), RULES).collect()]
    ratios = {(r.scope, r.token): r.odds_ratio for r in terms.odds_ratios(counts, people, RULES).collect()}
    totals = {r.scope: (r.cases, r.controls) for r in people.collect()}
    want, want_vocab, want_ratios = {}, [], {}
    for scope in SCOPES:
        df, tf, n = spec_counts(docs, members, scope)
        assert totals[scope] == (n[1], n[0])
        want.update({(scope, t): (df[1][t], tf[1][t], df[0][t], tf[0][t]) for t in set(tf[0]) | set(tf[1])})
        for odds in (1.5, 3.5):
            r, v = spec_vocabulary(df, tf, n, odds, RULES)
            want_ratios.update({(scope, t): x for t, x in r.items()})
            want_vocab += [(scope, odds, i, t, c) for i, (t, c) in enumerate(v)]
    assert got == want
    assert ratios == pytest.approx(want_ratios)
    assert sorted(vocab) == sorted(want_vocab) and vocab


def test_ratio_bounds_are_exclusive_of_the_limit(spark):
    people = spark.createDataFrame([("s", 10, 20)], "scope string, cases long, controls long")
    rows = [("s", "exact", 7, 50, 8, 60), ("s", "inverse", 2, 50, 14, 60), ("s", "inside", 5, 50, 8, 60),
            ("s", "allcases", 10, 50, 8, 60), ("s", "onlycase", 3, 50, 0, 0), ("s", "common", 5, 50, 13, 60),
            ("s", "edge", 6, 50, 12, 60), ("s", "onlyctrl", 0, 0, 12, 60), ("s", "ctrlcommon", 0, 0, 13, 60)]
    counts = spark.createDataFrame(rows, "scope string, token string, case_df long, case_tf long, ctrl_df long, ctrl_tf long")
    kept = {r.token for r in terms.vocabulary(counts, people, (3.5,)).collect()}
    assert kept == {"exact", "inverse", "inside", "edge", "onlyctrl"} - {"exact"} - ({"inverse"} if (2 / 8) / (14 / 6) <= 1 / 3.5 else set())
    ratio = {r.token: r.odds_ratio for r in terms.odds_ratios(counts, people).collect()}
    assert ratio["exact"] == pytest.approx(3.5)


def test_bag_and_tfidf(spark, world, frames):
    docs, members = world
    d, masks = frames
    counts, people = terms.term_counts(d, masks, SCOPES), terms.patient_counts(d, masks, SCOPES)
    vocab = terms.vocabulary(counts, people, (3.5,), RULES)
    rows = vocab.collect()
    bag = vectors.bag_of_words(d, masks, SCOPES, vocab, 100)
    got = {(r.scope, r.pid, r.term_id): r.tf for r in bag.collect()}
    want = {}
    for s, pid, _ in members:
        ids = {r.token: r.term_id for r in rows if r.scope == s}
        for t, n in Counter(w for w in docs[pid] if w in ids).items():
            want[(s, pid, ids[t])] = n
    assert got == want
    weights = {(r.scope, r.pid, r.term_id): r.w for r in vectors.tfidf(bag, vocab).collect()}
    for s in SCOPES:
        total = sum(r.cf for r in rows if r.scope == s)
        idf = {r.term_id: math.log2(total / r.cf) for r in rows if r.scope == s}
        for pid in {p for (x, p, _) in want if x == s}:
            mine = {k[2]: v * idf[k[2]] for k, v in want.items() if k[0] == s and k[1] == pid}
            norm = math.sqrt(sum(x * x for x in mine.values()))
            if norm:
                assert {t: weights[(s, pid, t)] for t in mine} == pytest.approx({t: x / norm for t, x in mine.items()})
                assert sum(weights[(s, pid, t)] ** 2 for t in mine) == pytest.approx(1)


def test_topics_against_numpy(spark):
    rng = np.random.default_rng(0)
    a = rng.random((70, 12)) * (rng.random((70, 12)) < 0.5)
    cells = [("s", 1.0, f"p{i}", j, float(a[i, j])) for i in range(70) for j in range(12) if a[i, j]]
    weights = spark.createDataFrame(cells, "scope string, odds double, pid string, term_id int, w double")
    basis, values = lsi.fit_topics(weights.select("pid", "term_id", "w"), 5)
    v = np.zeros((12, 5))
    for r in basis.collect():
        v[r.term_id, r.topic] = r.v
    assert np.allclose(v.T @ v, np.eye(5), atol=1e-8)
    _, s, vt = np.linalg.svd(a)
    assert np.allclose([r.s for r in values.orderBy("topic").collect()], s[:5])
    assert all(v[np.abs(v[:, t]).argmax(), t] > 0 for t in range(5))
    assert np.allclose(np.abs(np.sum(v * vt[:5].T, axis=0)), 1, atol=1e-6)
    tagged = basis.select(F.lit("s").alias("scope"), F.lit(1.0).alias("odds"), "term_id", "topic", "v")
    dense = {r.pid: r.vec for r in vectors.project(weights, tagged, 7).collect()}
    for i in range(70):
        if a[i].any():
            assert np.allclose(dense[f"p{i}"], [*(a[i] @ v), 0, 0])
    vocab = spark.createDataFrame([(j, f"t{j}") for j in range(12)], "term_id int, token string")
    listing = lsi.topic_terms(basis, vocab, 3).where("topic = 0").orderBy("rank").collect()
    assert [r.token for r in listing] == [f"t{j}" for j in np.argsort(-np.abs(v[:, 0]))[:3]]


def test_assembly(spark):
    a = spark.createDataFrame([("x", [1.0, 2.0]), ("y", [3.0, 4.0])], "pid string, vec array<double>")
    b = spark.createDataFrame([("x", [5.0]), ("z", [6.0])], "pid string, vec array<double>")
    assert [(r.pid, r.features) for r in vectors.assemble_matrix({"a": a, "b": b}).collect()] == [("x", [1.0, 2.0, 5.0])]
    assert [(r.pid, r.features) for r in vectors.assemble_matrix({"a": a, "b": b}, ["b"]).collect()] == [("x", [5.0])]
    assert vectors.column_names("T", 2) == ["T_lsi_0", "T_lsi_1"]
    with pytest.raises(ValueError):
        vectors.column_names("T", 2, "lda")


def test_too_many_scopes(spark):
    with pytest.raises(ValueError):
        terms.membership_masks(spark.createDataFrame([("a", "p", 1)], "scope string, pid string, label int"), [str(i) for i in range(40)])


def test_documents_without_tokens_count_as_patients(spark):
    d = documents.whole(spark.createDataFrame([("p1", "")], "pid string, t string"), F.col("pid"), F.col("t"))
    masks = terms.membership_masks(spark.createDataFrame([("s", "p1", 1)], "scope string, pid string, label int"), ["s"])
    expected = [("s", 1, 0)] if bucket_of("p1") < 8000 else []
    assert [tuple(r) for r in terms.patient_counts(d, masks, ["s"]).collect()] == expected


def plan_of(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_words_are_counted_where_their_text_lies(spark, monkeypatch):
    monkeypatch.setattr(terms, "COUNTED_ROWS", 3)
    rows = [("1", "alpha beta alpha"), ("2", None), ("3", "of to"), ("4", "gamma gamma delta beta alpha"), (None, "beta beta")]
    docs = documents.whole(spark.createDataFrame(rows, "id string, text string"), F.col("id"), F.col("text"))
    found = terms.token_table(docs)
    assert "Exchange" not in plan_of(found, "executedPlan")
    want = {("1", "alpha", 2), ("1", "beta", 1), ("4", "gamma", 2), ("4", "delta", 1), ("4", "beta", 1), ("4", "alpha", 1), (None, "beta", 2)}
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    again = terms.token_table(docs.unionByName(docs.where("pid = '4' or pid is null")))
    doubled = {(p, t, n * (1 if p == "1" else 2)) for p, t, n in want}
    assert sorted(map(str, map(tuple, again.collect()))) == sorted(map(str, doubled))


def test_the_split_is_decided_per_patient_not_per_word(spark):
    words = spark.createDataFrame([(str(i), "alpha", 2) for i in range(50)], "pid string, token string, tf bigint")
    masks = spark.createDataFrame([(str(i), 1) for i in range(50)], "pid string, mask bigint")
    counts = terms.counts_of_tokens(words, masks, ["all"])
    # Where the condition is also inferred for the words, its digests are twice as many.
    assert plan_of(counts).count("sha2(") == plan_of(terms.training_masks(masks)).count("sha2(")
    want = sum(not bool(r[0]) for r in masks.select(is_test(bucket(F.col("pid")))).collect())
    assert [(r.ctrl_df, r.ctrl_tf, r.case_df) for r in counts.collect()] == [(want, 2 * want, 0)]


def test_a_basis_of_many_terms_is_cut_to_the_vocabulary(spark):
    keys = "scope string, odds double, term_id int"
    basis = spark.createDataFrame([("s1", 3.5, i, t, float(i + t)) for i in range(40) for t in range(2)], f"{keys}, topic int, v double")
    vocab = spark.createDataFrame([("s1", 3.5, i, f"w{i}", 1) for i in range(3)], f"{keys}, token string, cf bigint")
    weights = spark.createDataFrame([("s1", 3.5, "p", 0, 0.5), ("s1", 3.5, "p", 2, 1.0), ("s1", 3.5, "q", 1, 2.0)], "scope string, odds double, pid string, term_id int, w double")
    cut = vectors.basis_of_terms(basis, vocab)
    assert cut.count() == 6
    found = vectors.project(weights, cut, 2, 3)
    assert sorted((r.pid, r.vec) for r in found.collect()) == [("p", [2.0, 3.5]), ("q", [2.0, 4.0])]
    assert "BroadcastHashJoin" in plan_of(found, "executedPlan")


def test_lists_hold_their_masks_and_no_word_moves_to_one(spark):
    rows = [("1", "alpha beta alpha"), ("2", "alpha gamma"), ("2", "gamma"), ("3", None), (None, "beta"), ("4", "beta")]
    docs = documents.whole(spark.createDataFrame(rows, "id string, text string"), F.col("id"), F.col("text"))
    masks = spark.createDataFrame([("1", 1), ("2", 2), ("3", 1)], "pid string, mask bigint")
    lists, table = terms.token_lists(docs, masks).localCheckpoint(), terms.token_table(docs)
    words = terms.listed_tokens(lists)
    assert sorted(map(str, words.select("pid", "token", "tf").collect())) == sorted(map(str, table.collect()))
    assert {(r.pid, r.mask) for r in words.collect()} == {("1", 1), ("2", 2), (None, None), ("4", None)}
    vocab = spark.createDataFrame([("s", o, i, t) for o in (2.0, 3.5) for i, t in enumerate(("alpha", "gamma"))] + [("other", 2.0, 0, "beta")],
                                  "scope string, odds double, term_id int, token string")
    for f in (lambda t: terms.counts_of_tokens(t, masks, ["s"]), lambda t: vectors.bag_of_tokens(t, masks, ["s"], vocab, 10)):
        assert sorted(map(tuple, f(lists).collect())) == sorted(map(tuple, f(table).collect()))
        assert "Join" not in plan_of(f(lists)).replace("Join Inner, (token", "")
    assert ("s", 2.0, "2", 1, 2) in set(map(tuple, vectors.bag_of_tokens(lists, masks, ["s"], vocab, 10).collect()))


def test_words_found_in_a_task_are_those_of_the_column_function(spark):
    odd = ["", "  x", "See www.a.org/abc or Mail@Server.COM, Abc.org!", "http://x.y abcdef", "a" * 64 + " " + "b" * 65 + " ok fine", "\x85abc\x1cdef​ghi　jkl",
           "İstanbul KÅelvin Straße", "abc" + "\U0001F600" * 61 + " def", "abc" + "\U0001F600" * 62 + " def", "x.com\x0bcom.x"]
    got = spark.createDataFrame([(t,) for t in odd], "t string").select(F.lower("t").alias("low"), tokens(F.col("t")).alias("w")).collect()
    assert [found_words(r.low) for r in got] == [r.w for r in got]


def test_runs_of_a_patient_are_multiplied_before_they_are_added(spark):
    rng = np.random.default_rng(2)
    entries = [(s, o, f"p{i % 9}" if i % 13 else None, int(t), float(w)) for s, o in (("a", 1.0), ("a", 2.0), ("b", 1.0))
               for i, (t, w) in enumerate(zip(rng.integers(0, 30, 200), rng.standard_normal(200)))] + [("c", 1.0, "p1", 3, 1.0), ("a", 1.0, "p1", 4, None)]
    weights = spark.createDataFrame(entries, "scope string, odds double, pid string, term_id int, w double").repartition(3)
    loadings = [(s, o, t, k, float(rng.standard_normal())) for s, o in (("a", 1.0), ("a", 2.0), ("b", 1.0)) for t in range(0, 30, 2) for k in range(4) if (t + k) % 3]
    basis = spark.createDataFrame(loadings, "scope string, odds double, term_id int, topic int, v double")
    small, joined = ({(r.scope, r.odds, r.pid): r.vec for r in vectors.project(weights, basis, 4, limit).collect()} for limit in (30, None))
    assert small.keys() == joined.keys() and all(np.allclose(small[k], joined[k], atol=1e-12) for k in small) and len(small) > 27
    found = vectors.project(weights, basis, 4, 30)
    assert "MapInArrow" in plan_of(found, "executedPlan") and "sum((w" not in plan_of(found).split("MapInArrow")[1]
    assert vectors.project(weights, basis.limit(0), 4, 30).count() == 0


def test_the_split_is_worked_out_once_for_a_patient(spark):
    vecs = spark.createDataFrame([("s", 1.0, f"p{i}", [1.0, 0.0, float(i)]) for i in range(50)], "scope string, odds double, pid string, vec array<double>")
    plain, marked = (vectors.topic_weights(v) for v in (vecs, terms.with_split(vecs)))
    assert flat_rows(terms.training(marked).select("pid", "topic", "v")) == flat_rows(terms.training(plain).select("pid", "topic", "v"))
    plan = plan_of(terms.training(marked.localCheckpoint()))
    assert "sha2(" not in plan and plan_of(marked).index("Generate") < plan_of(marked).index("sha2(")
    lists = terms.token_lists(spark.createDataFrame([("p1", 0, 1, "abc abc xyz"), ("p2", 0, 1, "abc")], "pid string, part int, parts int, text string"),
                              spark.createDataFrame([("p1", 1), ("p2", 2)], "pid string, mask bigint"))
    vocab = spark.createDataFrame([("s", 2.0, 0, "abc", 3), ("s", 2.0, 1, "xyz", 1)], "scope string, odds double, term_id int, token string, cf bigint")
    weights = vectors.tfidf(vectors.bag_of_tokens(lists, None, ["s"], vocab, 10, ("training",)), vocab, 10, ("training",))
    assert flat_rows(terms.training(weights).drop("training")) == flat_rows(terms.training(weights.drop("training")))


def flat_rows(df):
    return sorted(map(tuple, df.collect()))
