import re

from conftest_llm import docs_of

from cohortlens.llm import license_scan as op

LONG_MIT = op.TEMPLATES[6][1]


def base(text):
    w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for label, before in op.BASE for i in range(len(w)) if tuple(w[i:i + len(before) + 1]) == (*before, "license")]
    places = [i for i, _ in found]
    return len(w), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def test_base_places_and_labels(spark):
    words = LONG_MIT.split()
    texts = [
        None, "", "license", "MIT License", "mit-license, MIT\nLICENSE and the Apache license!", "General Public License; general public mit license",
        "Éa mİt license K license apache", "x " * 50 + LONG_MIT + " y" * 30, " ".join(words[:30] + ["inserted", "words"] + words[30:]), " ".join(words[:12]),
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "apache license " * 500,
        "mitlicense", "license mit", "public license", "\x7fmit\x00license",
    ]
    docs = docs_of(spark, texts).withColumnsRenamed({"lang": "labels", "source": "hits", "n_chars": "row"})
    rows = {r.doc_id: r for r in op.scan(docs).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert rows[7].labels == "mit" and rows[7].score == 1 and rows[7].n_base == 0
    assert rows[8].labels == "mit" and rows[8].score > 0.9 and rows[9].labels == ""
    assert (rows[10].labels, rows[10].score) == ("gpl", 1) and rows[11].labels == "cc-by-nc" and rows[0].score == 0


def test_repeated_rows_and_empty_table(spark):
    docs = docs_of(spark, [LONG_MIT]).unionByName(docs_of(spark, [LONG_MIT, "MIT license"])).unionByName(docs_of(spark, ["other"]))
    assert sorted((r.doc_id, r.labels, r.n_words) for r in op.scan(docs).collect()) == sorted(
        [(0, "mit", len(LONG_MIT.split()))] * 2 + [(1, "mit", 2), (0, "", 1)])
    assert op.scan(docs_of(spark, [])).count() == 0
    assert [r.labels for r in op.scan(docs.selectExpr("cast(null as bigint) doc_id", "text").where("text like 'MIT%'")).collect()] == ["mit"]


def test_no_python_on_the_executors(spark):
    plan = op.scan(docs_of(spark, ["MIT license"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_copies_back_to_back(spark):
    short = [(label, text) for label, text in op.TEMPLATES if len(text.split()) <= 8]
    cases = [(label, between.join([text] * n)) for label, text in short for between in (" ", " so ") for n in (1, 2, 3, 4, 5, 10, 50)]
    docs = docs_of(spark, [t for _, t in cases])
    for r in op.scan(docs.unionByName(docs.where("doc_id % 5 = 0"))).collect():
        assert cases[r.doc_id][0] in r.labels.split(",") and r.score == 1, cases[r.doc_id]
