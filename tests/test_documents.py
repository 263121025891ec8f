import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions.text import row_text
from cohortlens.operators import documents, ordering, repeats
from test_keys_text import spec_tokens
from workload import queries


def spec_blank(text, span=30):
    """The repeat rule, stated sequentially."""
    first, keep = {}, [True] * len(text)
    for i in range(len(text)):
        piece = text[i:i + span]
        if piece not in first:
            first[piece] = i
        elif i >= first[piece] + span:
            keep[i:i + span] = [False] * span
    shown = "".join(c if k else " " for c, k in zip(text, keep))
    return re.sub(" +", " ", re.sub("\t+", " ", shown))


def sample_texts():
    rnd = random.Random(5)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(40))
    texts = ["", "a" * 29, "a" * 30, "a" * 59, "a" * 60, "a" * 200, base[:30] * 2, base[:29] * 2, base + base, base + "x" + base[:30],
             "abc def\n" * 40, ("x" * 10 + "\t\t y é") * 30, base + "\t\n\t" + base, "  lead  " + base, "\U0001F600" * 90]
    for _ in range(25):
        base = "".join(rnd.choice("ab c\té") for _ in range(rnd.randint(20, 120)))
        texts.append("".join(rnd.choice([base, base[rnd.randint(0, 15):], "".join(rnd.choice("abcdefg \n") for _ in range(rnd.randint(0, 40)))])
                             for _ in range(rnd.randint(1, 6))))
    return texts


def glue(df):
    parts = defaultdict(dict)
    for r in df.collect():
        assert r.part not in parts[r.pid]
        parts[r.pid][r.part] = r.text
    return {pid: "".join(p[i] for i in sorted(p)) for pid, p in parts.items()}


def test_blank_in_row(spark):
    texts = sample_texts()
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "pid string, text string")
    got = glue(documents.blank_repeats(documents.whole(df, F.col("pid"), F.col("text"))))
    assert got == {str(i): spec_blank(t) for i, t in enumerate(texts)}


def test_hash_collisions_do_not_matter(monkeypatch):
    monkeypatch.setattr(repeats, "_span_hashes", lambda codes, span: np.zeros(len(codes) - span + 1, dtype=np.uint64))
    for t in sample_texts()[:14]:
        assert repeats._blank(t, 30) == spec_blank(t)


def test_pieces_equal_rows(spark):
    texts = sample_texts()[:24]
    rows = [(str(i), k, line) for i, t in enumerate(texts) for k, line in enumerate(t.split("\n"))]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "pid string, k int, line string")
    raw, clean = documents.review_documents(df, F.col("pid"), F.col("line"), [F.col("k")], row_chars=50, piece_chars=37)
    assert glue(raw) == dict((str(i), t) for i, t in enumerate(texts))
    assert glue(clean) == {str(i): spec_blank(t) for i, t in enumerate(texts)}


def test_clean_documents(spark):
    rows = [("a", 2, "World's end http://x.y", "second"), ("a", 1, "Hello THERE", None), ("b", 1, "", ""),
            ("c", 1, "repeat this sentence about nothing please", "repeat this sentence about nothing please")]
    df = spark.createDataFrame(rows, "pid string, k int, t1 string, t2 string")
    want = {}
    for pid in "abc":
        mine = sorted(r for r in rows if r[0] == pid)
        raw = "\n".join(x or "" for r in mine for x in r[2:])
        want[pid] = spec_blank(" ".join(spec_tokens(raw)))
    for limits in ({}, dict(row_chars=10, piece_chars=31)):
        got = documents.clean_documents(df, F.col("pid"), row_text("t1", "t2"), [F.col("k")], **limits)
        assert glue(got) == want


def test_document_order_is_the_text_order_of_the_sort_column(spark):
    df = spark.createDataFrame([("a", "1/9/2010", "x"), ("a", "1/10/2010", "y")], "pid string, d string, t string")
    assert glue(documents.assemble(df, F.col("pid"), F.col("t"), [F.col("d")])) == {"a": "y\nx"}


def test_running_total_with_a_hot_key(spark):
    rows = [("hot", i % 97, i) for i in range(3000)] + [(f"k{i % 5}", i, i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(6)
    got = {(r.k, r.o, r.v): r.before for r in ordering.running_total(df, ["k"], ["o", "v"], F.col("v"), "before").collect()}
    want, seen = {}, defaultdict(int)
    for k, o, v in sorted(rows):
        want[(k, o, v)] = seen[k]
        seen[k] += v
    assert got == want


@pytest.mark.parametrize("n", [1, 60, 10_000])
def test_top_n(spark, n):
    rnd = random.Random(4)
    weights = [0.0, -0.0, 1.0, 1.0, 2.0, 5e-324, 1e308, -1e308, -3.0, float("inf"), float("-inf"), None, float("nan"), *(rnd.lognormvariate(0, 3) for _ in range(400))]
    rows = [(k, w, f"t{i:05d}{k}") for k in ("a", "b") for i, w in enumerate([*weights, *[7.0] * 150])]
    df = spark.createDataFrame(rows + [("few", 1.0, "x")], "k string, v double, t string").repartition(7)
    usual = [r for r in rows if r[1] is not None and r[1] == r[1]]
    got = sorted((r.k, r.rank, r.v, r.t) for r in ordering.top_n(df.where("v is not null and not isnan(v)"), ["k"], F.col("v"), [F.asc("t")], n, "rank").collect())
    want = [(k, i, v, t) for k in ("a", "b") for i, (_, v, t) in enumerate(sorted((r for r in usual if r[0] == k), key=lambda r: (-r[1], r[2]))[:n], 1)]
    assert got == sorted([*want, ("few", 1, 1.0, "x")])
    assert ordering.top_n(df, ["k"], F.col("v"), [F.asc("t")], n, "rank").where("k = 'a'").count() == min(n, len(rows) // 2)


def test_top_n_ranks_little_more_than_n(spark):
    df = spark.range(200_000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 199_999).alias("v"), "id")
    found = ordering.top_n(df, ["k"], F.col("v"), [F.asc("id")], 50, "rank")
    found.collect()
    bins = df.groupBy("k", ordering.weight_bin(F.col("v"))).count().agg(F.max("count")).first()[0]
    ranked = df.withColumn("b", ordering.weight_bin(F.col("v")))
    cut = ranked.groupBy("k").agg(F.max("b").alias("top"))
    assert found.count() == 150 and ranked.join(cut, "k").where("b >= top - 2").count() < 3 * (50 + 3 * bins)


def test_piece_size_guard(spark):
    df = spark.createDataFrame([("a", 0, 2, "x")], "pid string, part int, parts int, text string")
    with pytest.raises(ValueError):
        repeats.blank_pieces(df, 10)


def test_patient_document_takes_all_and_review_export_only_its_patients(spark, monkeypatch):
    sf, assembled, assemble = "/root/testdata/sf0.001", [], documents.assemble

    def watched(rows, pid, *rest, **named):
        assembled.append({r.pid for r in rows.select(pid.cast("string").alias("pid")).distinct().collect()})
        return assemble(rows, pid, *rest, **named)

    monkeypatch.setattr(documents, "assemble", watched)
    everyone = {r.pid for r in queries.table(spark, sf, "conversations").select(queries.as_id("conv_id").alias("pid")).distinct().collect()}
    chosen = {r.pid for r in queries.table(spark, sf, "labels").where("toxic = 1").select(queries.as_id("doc_id").alias("pid")).collect()}
    assert {r.pid for r in queries.patient_document(spark, sf).collect()} == everyone == assembled[0]
    queries.review_export(spark, sf)
    assert assembled[1] == everyone & chosen < everyone
