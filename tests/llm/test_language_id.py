import random
import re

import pytest
import zstandard
from conftest_llm import DOCS, docs_of
from pyspark.sql import functions as F

from cohortlens.llm import language_id as op
from cohortlens.llm.common import stretches

WORDS = {"xa": "shoren thing atble reath ondre", "yb": "queció ladoes miento arró uedos", "zc": "ßunge keitä schlich pfzu enver"}


def sentence(rng, lang, n):
    syllables = [w[i:i + 3] for w in WORDS[lang].split() for i in range(0, len(w) - 2)]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))


def corpus(spark, n, seed):
    rng = random.Random(seed)
    rows = [(i, sentence(rng, lang, rng.randint(8, 60)), lang, "s", 1) for i in range(n) for lang in [rng.choice(list(WORDS))]]
    return spark.createDataFrame(rows, DOCS)


def test_held_out_accuracy(spark):
    dictionaries = op.learn(corpus(spark, 300, 1))
    assert set(dictionaries) == set(WORDS) and all(len(d) <= op.DICTIONARY_BYTES for d in dictionaries.values())
    test = corpus(spark, 200, 2)
    rows = op.classify(test, dictionaries).join(test, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    dictionaries = op.learn(corpus(spark, 60, 3))
    docs = docs_of(spark, [None, "", "12 !? 34", "x", "thing " * 50_000]).withColumnsRenamed({"lang": "score", "source": "bits"})
    rows = {r.doc_id: r for r in op.classify(docs, dictionaries).collect()}
    assert [rows[i].lang_pred for i in range(3)] == ["und"] * 3 and rows[0].score == 0 and rows[1].rejected
    assert rows[3].lang_pred in WORDS and rows[4].lang_pred == "xa"
    assert op.classify(docs, {}).where("lang_pred <> 'und'").count() == 0
    assert op.learn(docs_of(spark, [])) == {} and op.classify(docs_of(spark, []), dictionaries).count() == 0


def test_narrow_margins_are_rejected(spark):
    same = {"a": b"one and the same words", "b": b"one and the same words"}
    row = op.classify(docs_of(spark, ["the same words again"]), same).first()
    assert row.rejected and row.lang_pred == "a" and abs(row.score - 0.5) < 1e-9


def test_null_labels_teach_nothing(spark):
    assert list(op.learn(corpus(spark, 30, 4).withColumn("lang", F.lit(None).cast("string")))) == []


def test_more_labels_than_can_be_learned_raise(spark, monkeypatch):
    monkeypatch.setattr(op, "MOST_LANGUAGES", 2)
    docs = docs_of(spark, ["abc"] * 3).withColumn("lang", F.col("doc_id").cast("string"))
    assert len(op.learn(docs.where("doc_id < 2"))) == 2
    with pytest.raises(ValueError, match="more than 2 labels"):
        op.learn(docs)


def test_long_texts_teach_from_all_over(spark):
    rng = random.Random(5)
    halves = [sentence(rng, "xa", 4000) + " " + "zebra quagga " * 8000, "short one"]
    docs = docs_of(spark, halves)
    learned = op.learn(docs, dictionary_bytes=1 << 14)["en"].decode()
    first = set(halves[0].split()[:3900])
    assert "zebra" in learned and first & set(learned.split()) and "short one" in learned
    found = docs.select(stretches(F.col("text"), 80, F.col("doc_id")).alias("s")).collect()
    assert [len(r.s) for r in found] == [8, 1] and all(len(s) == 10 and s in halves[0] for s in found[0].s)


def test_one_setting_for_texts_of_any_length(spark):
    """The smallest result wins, by the compressor alone."""
    dictionaries = op.learn(corpus(spark, 100, 6))
    rng = random.Random(7)
    texts = [sentence(rng, rng.choice(list(WORDS)), n) for n in (3, 30, 300, 700, 900, 5000)]
    parameters = zstandard.ZstdCompressionParameters(write_checksum=False, write_content_size=False, write_dict_id=False, **op.SEARCH)

    def size(text, content):
        kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        kept.precompute_compress(compression_params=parameters)
        letters = re.sub(r"[^a-zßäöüáéíóúñ]+", " ", text.lower())
        return len(zstandard.ZstdCompressor(compression_params=parameters, dict_data=kept).compress(letters.encode()))

    want = {i: min(dictionaries, key=lambda n: size(t, dictionaries[n])) for i, t in enumerate(texts)}
    assert {r.doc_id: r.lang_pred for r in op.classify(docs_of(spark, texts), dictionaries).collect()} == want
