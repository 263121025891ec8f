import json
import random

import public_tokenizers
import pytest
from conftest_llm import docs_of
from tokenizers import Tokenizer

from cohortlens.llm import token_counts as op

FILE = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(FILE)


def content():
    with open(FILE, encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def counter():
    return op.Counter(content())


def whole(text):
    return len(TOKENIZER.encode(text, add_special_tokens=False).ids)


def test_random_texts(counter):
    rng = random.Random(3)
    parts = [*"abzxe AB.'’,!?-_<|>09é  \n\t\r\x1c\x85  İ中文ﬁ½𝔄ߊ՘࢏\U00010940\x00\x7f", "'s", "'LL", "<|endoftext|>", "<|endof", "th",
             " the ", "aaaa", "    ", "    \n", "1234", "ciónñ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(6000)]
    assert counter.counts(texts) == [whole(t) for t in texts]


def test_settled_characters_are_divided_alike():
    pieces, split = op.regex.compile(op.PIECES).findall, TOKENIZER.pre_tokenizer.pre_tokenize_str
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x11000)]):
        if not op.UNSETTLED.search(c):
            s = f"a{c}1{c}{c}! {c}"
            assert pieces(s) == [s[a:b] for _, (a, b) in split(s)], hex(ord(c))


@pytest.mark.parametrize("long", [2, 1024])
def test_long_pretokens(monkeypatch, long):
    monkeypatch.setattr(op, "LONG", long)
    rng = random.Random(5)
    counter = op.Counter(content())
    words = ["a" * 7, "=" * 5000, "ab" * 3000, "".join(rng.choices("etaoinshr", k=20_000)), "".join(rng.choices("的一是不了人我在有他", k=3000)),
             *("".join(rng.choices("aab", k=rng.randint(1, 30))) for _ in range(500))]
    assert counter.counts(words) == [whole(w) for w in words]


def test_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(op, "CACHED_PIECES", 10)
    counter = op.Counter(content())
    for text in ("one two three four five", "six seven eight nine ten eleven", "one two three"):
        assert counter.counts([text, ""]) == [whole(text), 0]


def test_tables(spark, monkeypatch):
    monkeypatch.setattr(op, "SLICE_CHARS", 100)
    texts = ["Hello there.", None, "", "word " * 2000, "x" * 30_000, "çé <|endoftext|> x", *(f"text {i}" for i in range(50))]
    docs = docs_of(spark, texts).unionByName(docs_of(spark, ["again", None]))
    docs = docs.withColumnsRenamed({"lang": "key", "source": "n_tokens", "n_chars": "n_bytes"})
    got = sorted(map(tuple, op.token_counts(docs, FILE, limit=1999).collect()))
    rows = [*enumerate(texts), (0, "again"), (1, None)]
    assert got == sorted((i, len((t or "").encode()), whole(t or ""), whole(t or "") > 1999) for i, t in rows)
    unnamed = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id bigint, text string")
    assert sorted(r.n_tokens for r in op.token_counts(unnamed, FILE).collect()) == [0, 2]
    assert op.token_counts(docs_of(spark, []), FILE).count() == 0


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: whole(r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op.op13_token_counts(spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_other_files_raise():
    with pytest.raises(ValueError):
        op.Counter(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    file = json.loads(content())
    file["model"]["merges"].reverse()
    with pytest.raises(ValueError):
        op.Counter(json.dumps(file))
