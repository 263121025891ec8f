import itertools
import math
import random

import numpy as np
from conftest_llm import DOCS, docs_of

from cohortlens.llm import line_quality as op


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        e, a = rng.normal(size=n) * 2, rng.normal(size=(2, 2))
        weights = {y: math.exp(sum(e[t] * y[t] for t in range(n)) + sum(a[p, q] for p, q in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=n)}
        want = [sum(w for y, w in weights.items() if y[t]) / sum(weights.values()) for t in range(n)]
        assert np.allclose(op.marginals(e.tolist(), a.tolist()), want)


def test_gradient_leads_to_higher_likelihood():
    rng = np.random.default_rng(2)
    lines = [rng.normal(size=(k, len(op.FEATURES))) + (1.5 if i % 2 else -1.5) * (np.arange(len(op.FEATURES)) == 3) for i, k in enumerate([1, 3, 9, 2] * 20)]
    labels = np.arange(80) % 2
    model = op.fit(lines, labels)
    scores = []
    for x in lines:
        w = op.with_neighbours(x, model.mean, model.spread, np.zeros(1, dtype=int)) @ model.weights
        scores.append(np.mean(op.marginals(w.tolist(), model.transitions.tolist())))
    assert np.mean((np.array(scores) > 0.5) == labels) > 0.95


def corpus(spark, n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        lines = []
        for _ in range(rng.randint(1, 8)):
            words = ["".join(rng.choices("abcdefg", k=rng.randint(2, 8))) for _ in range(rng.randint(4, 25))]
            lines.append(" ".join(words).capitalize() + "." if good else rng.choice([" | ".join(words), "!! ".join(words).upper(), (words[0] + " ") * 20]))
        rows.append((i, "\n".join(lines), "en", "s", 1))
        labels.append((i, int(good), None))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy_and_filter(spark):
    docs, labels = corpus(spark, 400, 1)
    model = op.learn(docs, labels)
    test, truth = corpus(spark, 200, 2)
    rows = op.score_lines(test, model).join(truth, "doc_id").collect()
    assert np.mean([(r.score >= op.CAN_PASS) == r.quality for r in rows]) > 0.97
    kept = op.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0.6 < kept.count() / 400 < 0.8


def test_odd_rows(spark):
    docs, labels = corpus(spark, 100, 3)
    model = op.learn(docs, labels)
    odd = docs_of(spark, [None, "", "\n \n", "word", "a line.\n" * 20_000]).withColumnsRenamed({"lang": "score", "source": "n_lines"})
    rows = {r.doc_id: r for r in op.score_lines(odd.drop("score", "n_lines"), model).collect()}
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows.values())
    assert rows[0].score == rows[1].score == rows[2].score and rows[0].n_lines == 1 and rows[4].n_lines == 20_000
    assert op.keep_good(odd.withColumnRenamed("score", "_x"), labels).columns == ["doc_id", "text", "_x", "n_lines", "n_chars"]
    assert op.score_lines(docs_of(spark, []), model).count() == 0


def test_without_labels(spark):
    docs, labels = corpus(spark, 20, 4)
    model = op.learn(docs, labels.where("quality is null"))
    assert [r.score for r in op.score_lines(docs, model).collect()] == [0.5] * 20
