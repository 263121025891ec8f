"""Documents held in small pieces give what documents in one row give."""

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.text import ngrams, row_text, tokens
from cohortlens.operators import documents, ordering, terms, vectors

SF = "/root/testdata/sf0.001"


def flat(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module", params=["documents", "conversations"])
def forms(spark, request):
    rows = spark.read.parquet(f"{SF}/{request.param}.parquet")
    if request.param == "documents":
        of = (rows, F.col("doc_id"), F.col("text"), [F.col("doc_id")])
    else:
        of = (rows, F.col("conv_id"), row_text("role", "text"), [F.col("turn")])
    return documents.clean_documents(*of).cache(), documents.clean_documents(*of, row_chars=10, piece_chars=64).cache()


def test_counts_bags_and_pairs(spark, forms):
    whole, pieces = forms
    assert pieces.where("parts > 1").count() > pieces.where("parts = 1").count()
    masks = terms.membership_masks(whole.select(F.lit("all").alias("scope"), "pid", (F.col("pid") % 3 == 0).cast("int").alias("label")), ["all"])
    columns = ["token", "case_df", "case_tf", "ctrl_df", "ctrl_tf"]
    counts = [flat(terms.term_counts(d, masks, ["all"]), *columns) for d in forms]
    assert counts[0] == counts[1] and counts[0]
    words = spark.createDataFrame([("all", 3.5, i, t[0]) for i, t in enumerate(counts[0][:200])], "scope string, odds double, term_id int, token string")
    bags = [flat(vectors.bag_of_words(d, masks, ["all"], words), "pid", "term_id", "tf") for d in forms]
    assert bags[0] == bags[1] and bags[0]
    pairs = [flat(documents.document_bigrams(d).select("pid", F.explode("pairs").alias("pair")).groupBy("pid", "pair").count(), "pid", "pair", "count")
             for d in forms]
    direct = whole.select("pid", tokens(F.col("text")).alias("w")).select("pid", F.explode(ngrams(F.col("w"), 2)).alias("pair"))
    assert pairs[0] == pairs[1] == flat(direct.groupBy("pid", "pair").count(), "pid", "pair", "count")


def test_text_is_kept(forms):
    whole, pieces = forms
    joined = pieces.groupBy("pid").agg(F.array_join(F.sort_array(F.collect_list(F.struct("part", "text")))["text"], "").alias("text"))
    assert flat(joined, "pid", "text") == flat(whole, "pid", "text")


def test_token_table_serves_counts_and_bag(spark, forms):
    whole, _ = forms
    masks = terms.membership_masks(whole.select(F.lit("all").alias("scope"), "pid", (F.col("pid") % 3 == 0).cast("int").alias("label")), ["all"])
    words = terms.token_table(whole)
    columns = ["token", "case_df", "case_tf", "ctrl_df", "ctrl_tf"]
    assert flat(terms.counts_of_tokens(words, masks, ["all"]), *columns) == flat(terms.term_counts(whole, masks, ["all"]), *columns)
    known = words.select("token").distinct().orderBy("token").limit(100).select(
        F.lit("all").alias("scope"), F.lit(3.5).alias("odds"), F.length("token").alias("term_id"), "token")
    assert flat(vectors.bag_of_tokens(words, masks, ["all"], known), "pid", "term_id", "tf") == flat(
        vectors.bag_of_words(whole, masks, ["all"], known), "pid", "term_id", "tf")


def test_pieces_are_cut_in_one_pass_and_settled_before_words_move(spark):
    texts = {"a": ["x\U0001F600y" * 7, "", "é" * 9 + "\n" + "z"], "b": ["q" * 5, "rs"], "c": ["w" * 11], "d": [""]}
    rows = spark.createDataFrame([(p, i, t) for p, ts in texts.items() for i, t in enumerate(ts)], "id string, n int, t string")
    pieces = documents.assemble(rows, F.col("id"), F.col("t"), [F.col("n")], row_chars=3, piece_chars=4)
    found = {p: [(r.part, r.parts, r.text) for r in pieces.where(F.col("pid") == p).orderBy("part").collect()] for p in texts}
    for p, ts in texts.items():
        whole = "\n".join(ts)
        cut = [whole[i:i + 4] for i in range(0, len(whole), 4)] if len(whole) > 2 else [whole]
        assert found[p] == [(i, len(cut), c) for i, c in enumerate(cut)], p
    plan = documents.whole_words(pieces).where("parts > 1")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "array_join" not in plan


def test_pieces_are_settled_and_move_to_their_masks_once(spark, monkeypatch):
    texts = {"a": "abc def abc " * 9, "b": "def ghi", "c": "abc", "d": "", None: "abc jkl mno pqr"}
    rows = spark.createDataFrame([(p, t) for p, t in texts.items()] + [("c", "abcdefgh ijk")], "id string, t string")
    masks = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", 1)], "pid string, mask bigint")
    monkeypatch.setattr(terms, "training", lambda df: df)
    columns = ["scope", "token", "case_df", "case_tf", "ctrl_df", "ctrl_tf"]
    want = flat(terms.term_counts(documents.assemble(rows, F.col("id"), F.col("t"), [F.col("t")], separator=" "), masks, ["s"]), *columns)
    pieces = documents.whole_words(documents.assemble(rows, F.col("id"), F.col("t"), [F.col("t")], separator=" ", row_chars=8, piece_chars=12))
    assert {r.parts for r in pieces.collect()} > {1, 2} and [r.text for r in pieces.where("pid is null").collect()] == [texts[None]]
    for most in (1024, 2):
        monkeypatch.setattr(terms, "ROW_PARTS", most)
        counts = terms.term_counts(pieces, masks, ["s"])
        assert flat(counts, *columns) == want and want
        # The texts are not cut again for those of one piece.
        assert "(?s)." not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_totals_of_keys_in_several_slices(spark):
    rows = [("a", i, 2) for i in range(400)] + [("b", i, 0) for i in range(5)] + [(None, 1, 7)] + [("c", i, 1) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(7)
    found = ordering.running_total(df, ["k"], ["o"], F.col("v"), "before")
    assert sorted((r.k, r.o, r.before) for r in found.collect()) == sorted((k, o, {"a": 2, "b": 0, "c": 1}[k] * o) for k, o, _ in rows if k)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
