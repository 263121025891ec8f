import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import docs_of

from cohortlens.llm import ranked_search as op

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, most):
    """Every score of every pair; ``docs`` and ``items`` are lists of (id, text)."""
    counted = [(k, Counter(terms(t))) for k, t in docs]
    counted = [(k, c, sum(c.values())) for k, c in counted if c]
    n_all, l_all, df, out = len(counted), sum(n for *_, n in counted), Counter(t for _, c, _ in counted for t in c), []
    for item, text in items:
        scores = []
        for k, c, n in counted:
            m = 75 + 25 * n * n_all // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, k is not None, k or 0))
        out += [(item, r, k if named else None, -s) for r, (s, named, k) in enumerate(sorted(scores)[:most], 1)]
    return sorted(out, key=str)


def test_terms():
    for text in (None, "", "A-b c1_É…x\x00y\x7fZ`9", "ÀZ q İ"):
        assert [t.decode() for t in op.terms(text)] == terms(text)


@pytest.mark.parametrize("wide", [0, 1024])
def test_lists_are_read_until_all_is_settled(monkeypatch, wide):
    monkeypatch.setattr(op, "MOST_OPEN_TERMS", wide)
    monkeypatch.setattr(op, "FIRST_READ", 2)
    rng, fewer = np.random.default_rng(4), 0
    for trial in range(300):
        n, most = int(rng.integers(1, 120)), int(rng.integers(1, 8))
        keys = rng.permutation(n) // int(rng.integers(1, 3))
        lists, want = [], np.zeros(n, dtype=np.int64)
        for _ in range(int(rng.integers(1, 6))):
            docs = rng.choice(n, int(rng.integers(1, n + 1)), replace=False)
            gains = np.sort(rng.integers(1, int(rng.choice([3, 50, 5000])), len(docs)))[::-1]
            lists.append((docs.astype(np.int32), gains))
            want[docs] += gains
        best, scores, reads = op.resolved(lists, keys, most)
        order = [i for i in np.lexsort((keys, -want)) if want[i] > 0][:most]
        assert scores.tolist() == want[order].tolist() and keys[best].tolist() == keys[order].tolist() and (want[best] == scores).all()
        fewer += reads < sum(len(d) for d, _ in lists)
    assert wide == 0 or fewer > 20


def test_equal_to_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op, "SHARD_DOCS", 30)
    monkeypatch.setattr(op, "FIRST_READ", 4)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "X9"]
    text = lambda n: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=n))
    texts = [*(text(rng.randint(1, 40)) for _ in range(250)), None, "", "...", *["w5 w6 w7"] * 30, text(20_000)]
    asked = [*((i, text(rng.randint(1, 12))) for i in range(25)), (30, None), (31, "-"), (32, "absent"), (33, "w0 w0 w0"), (33, "w0 w0 w0"), (34, "w5")]
    docs, items = docs_of(spark, texts).repartition(4), spark.createDataFrame(asked, "item_id bigint, text string")
    want = brute(list(enumerate(texts)), dict.fromkeys(asked), 20)
    got = op.search(docs.withColumnsRenamed({"lang": "key", "source": "question", "n_chars": "rank"}), items)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    monkeypatch.setattr(op, "BLOCK_BYTES", 200)
    assert sorted((tuple(r) for r in op.search(docs, items).collect()), key=str) == want
    monkeypatch.setattr(op, "MOST_OPEN_TERMS", 3)
    assert sorted((tuple(r) for r in op.search(docs, items, most=3).collect()), key=str) == brute(list(enumerate(texts)), dict.fromkeys(asked), 3)


def test_odd_tables(spark):
    items = spark.createDataFrame([(1, "a b"), (None, "b")], "item_id int, text string")
    rows = [(None, "a x"), (5, "a x"), (5, "a x"), (4, "a x"), (9, "c"), (10, "d d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = op.search(docs, items)
    assert dict(got.dtypes)["item_id"] == "int"
    assert [(r.item_id, r["rank"], r.doc_id) for r in sorted(got.collect(), key=lambda r: r["rank"])] == [(1, 1, None), (1, 2, 4), (1, 3, 5), (1, 4, 5)]
    for d, i in ((docs_of(spark, []), items), (docs, items.limit(0)), (docs_of(spark, [None, ""]), items)):
        found = op.search(d, i)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0
