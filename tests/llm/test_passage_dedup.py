import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from conftest_llm import docs_of

from cohortlens.llm import passage_dedup as op


def brute(texts, length=op.LENGTH):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts):
    got = {r.doc_id: tuple(r)[1:] for r in op.removals(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdeéß ", k=rng.randint(2, 9))) for _ in range(n))


def test_against_every_window(spark):
    rng = random.Random(1)
    passage, other = prose(rng, 60), prose(rng, 45)
    base = prose(rng, 900)
    texts = [prose(rng, rng.randint(1, 300)) for _ in range(12)]
    texts += [prose(rng, 40) + passage + prose(rng, 30), passage + prose(rng, 80), prose(rng, 20) + passage[3:], passage[:201], passage[:200], passage[:199]]
    texts += [base, base[:700] + "X" + base[701:], base[:1500] + other + base[1500:], other + other, base[100:500], base[10:2000] + base[5:1500]]
    texts += [None, "", "short", "short", "a" * 199, "a" * 200, "b" * 1000, "ab" * 400, texts[0], texts[0], "c" * 200, "c" * 200]
    check(spark, texts)


def test_exact_lengths(spark):
    rng = random.Random(2)
    s = prose(rng, 200)[:400]
    check(spark, [s[:200] + "1", "2" + s[:200], s[100:299] + "3", "4" + s[100:299]])


def test_pieces_of_long_texts(spark, monkeypatch):
    rng = random.Random(3)
    s = prose(rng, 600)
    monkeypatch.setattr(op, "PIECE_BYTES", 300)
    check(spark, [s, prose(rng, 50) + s[333:1200], s[:900]])


def test_empty_table(spark):
    assert op.removals(docs_of(spark, [])).collect() == []


def test_repeated_ids_and_texts_without_repeats(spark):
    rng = random.Random(4)
    s, t = prose(rng, 100), prose(rng, 100)
    docs = docs_of(spark, [s, t]).unionByName(docs_of(spark, [s])).withColumnRenamed("lang", "digest").withColumnRenamed("source", "spans")
    rows = sorted(tuple(r)[:3] for r in op.removals(docs).collect())
    n = len(s.encode())
    assert rows == [(0, n, n), (0, n, n), (1, len(t.encode()), 0)]
    assert sorted((r.text, r.spans) for r in op.without_repeats(docs).collect()) == sorted([("", "s"), ("", "s"), (t, "s")])


def test_long_texts_are_in_blocks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_RUNS", 2)
    rng = random.Random(6)
    s, t = prose(rng, 300), prose(rng, 80)
    check(spark, [s, prose(rng, 50) + s[333:1200], s[:900], t, t + prose(rng, 10), prose(rng, 3), None])


def test_joined_places():
    rng = random.Random(1)
    places = [(rng.randint(0, 5), rng.randint(0, 900), rng.randint(1, 60)) for _ in range(40)] + [(9, 0, 1)]
    listed = [places[:7], [], places[7:30], places[30:]]
    kind = pa.list_(pa.struct([("uid", pa.int64()), ("lo", pa.int64()), ("size", pa.int32())]))
    group = pa.table({"block": [1] * 4, "places": pa.array([[dict(zip(("uid", "lo", "size"), p)) for p in ps] for ps in listed], kind)})
    got = {r["uid"]: [(s["start"], s["stop"]) for s in r["spans"]] for r in op.joined_places(group).to_pylist()}
    assert got == {u: op.merged([{"start": lo, "stop": lo + n + op.LENGTH - 1} for v, lo, n in places if v == u]) for u in {p[0] for p in places}}


def test_hot_grams(spark, monkeypatch):
    """Beyond HOT_ROWS runs of a gram the windows are narrowed down node by node, with the same result."""
    monkeypatch.setattr(op, "HOT_ROWS", 1)
    test_against_every_window(spark)


def test_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(op, "BATCH_ROWS", 3)
    test_against_every_window(spark)


@pytest.mark.parametrize("k", [1, 2, 7])
def test_runs_have_equal_anchors_in_equal_windows(k):
    import numpy as np

    rng = random.Random(k)
    s = prose(rng, 300).encode()
    for data in (s, b"xyz" * k + s):
        r = op.runs_of(np.frombuffer(data, dtype=np.uint8))
        assert r["size"].sum() == len(data) - op.LENGTH + 1 and (r["off"] >= r["size"] - 1).all()
