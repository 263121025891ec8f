import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from cohortlens.functions import dates, keys, text

SPACES = [c for c in map(chr, range(1, 0x3100)) if c.isspace()]


def spec_tokens(raw, low=3, high=64):
    """The tokeniser rule, stated sequentially."""
    out = []
    for chunk in raw.lower().split():
        if not low <= len(chunk) <= high:
            continue
        if chunk.startswith(("http", "www")) or chunk.endswith((".edu", ".com", ".org")):
            continue
        out += [w for w in re.split("[^a-z]+", chunk) if len(w) >= low]
    return out


def spark_tokens(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.w for r in df.select("i", text.tokens(F.col("t")).alias("w")).orderBy("i").collect()]


def test_bucket_matches_hashlib(spark):
    ids = [f"p{i}" for i in range(5000)]
    df = spark.createDataFrame([(i,) for i in ids], "pid string")
    for n in (7, 100, 10_000, 99_999):
        got = {r.pid: r.b for r in df.select("pid", keys.bucket(F.col("pid"), n).alias("b")).collect()}
        assert got == {i: int(hashlib.sha256(i.encode()).hexdigest(), 16) % n for i in ids}
        assert keys.bucket_of("p17", n) == got["p17"]
    assert keys.bucket_of("é") == int(hashlib.sha256("é".encode()).hexdigest(), 16) % 10_000


def test_labels_and_split(spark):
    df = spark.createDataFrame([(7999,), (8000,), (3,)], "b int")
    got = [(r.l, r.t) for r in df.select(keys.bucket_label(F.col("b")).alias("l"), keys.is_test(F.col("b")).alias("t")).collect()]
    assert got == [("g07999", False), ("g08000", True), ("g00003", False)]
    assert [keys.label_width(n) for n in (10, 99, 100, 999, 1000, 9999, 10_000, 99_999)] == [2, 2, 3, 3, 4, 4, 5, 5]
    with pytest.raises(NotImplementedError):
        keys.label_width(100_000)


def test_token_edges(spark):
    long64, long65 = "a" * 64, "a" * 65
    cases = ["", "   ", "covid-19", "don't", "naïveté", "ab abc", long64, long65, f"x.{long64}", "http://a www.x y.com z.edu q.org",
             "(http://zed)", "a.com.", "foo.community bar", "abc\x1cdef ghi jkl　mno", "HTTPS://UP Www.UP up.COM",
             "httpd wwwx", f"{'é' * 65}abc tail", f"{long65} abc", "xhttp://a.b/c", "İstanbul Kelvin", "tab\tnew\nline\rret",
             "x.com word", "a​bc def"]
    assert spark_tokens(spark, cases) == [spec_tokens(c) for c in cases]


def test_whitespace_set(spark):
    texts = [f"abc{c}def" for c in SPACES] + [f"abc{chr(c)}http" for c in (0x200B, 0x180E, 0xFEFF, 0x7F, 0x1B)]
    assert spark_tokens(spark, texts) == [spec_tokens(t) for t in texts]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abcHWTP.:/omedurg -'é \n\t1", max_size=120), min_size=20, max_size=40))
def test_tokens_property(spark, texts):
    assert spark_tokens(spark, texts) == [spec_tokens(t) for t in texts]


def test_bigrams_and_slug(spark):
    df = spark.createDataFrame([("one two xx three",), ("single",), ("",)], "t string").select(text.tokens(F.col("t")).alias("w"))
    assert [r[0] for r in df.select(text.ngrams(F.col("w"), 2)).collect()] == [["one_two", "two_three"], [], []]
    with pytest.raises(NotImplementedError):
        text.ngrams(F.col("w"), 3)
    names = spark.createDataFrame([("  Middle   EAST ",), ("a\tb",), ("",)], "n string")
    assert [r[0] for r in names.select(text.slug(F.col("n"))).collect()] == ["middle_east", "a_b", ""]


def test_dates(spark):
    df = spark.createDataFrame([("1/2/2010",), ("01/02/2010",), ("13/1/2010",), ("2/30/2011",), ("",), (None,)], "d string")
    assert [r[0] for r in df.select(dates.iso_date(F.col("d"))).collect()] == ["2010-01-02", "2010-01-02", "", "", "", ""]
    with pytest.raises(Exception, match="2/30/2011"):
        df.where("d = '2/30/2011'").select(dates.strict_date(F.col("d"))).collect()
