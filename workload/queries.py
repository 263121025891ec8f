"""Each operator on stand-in tables: ``name -> (spark, sf_dir) -> DataFrame``.

corpus = documents (one per patient, class = labels.toxic), notes = conversations, diagnoses =
lineitem x orders x part, note dates = orders, demographics = customer x nation x region.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohortlens.functions import dates, keys, text
from cohortlens.operators import (bitmaps, cohorts, demographics, documents, evaluate, history, lsi, quality, terms,
                                  vectors)
from cohortlens.plans import grid, reports, training
from cohortlens.session import work_folder
from cohortlens.sources import codes as code_source, delimited, store
from cohortlens.sources.catalog import TableSpec

SCOPES = ["all"]
VOCABULARY = terms.VocabularyRules()
# Chosen so that both vocabulary limits bite at the smallest scales.
TIGHT_VOCABULARY = terms.VocabularyRules(min_case_count=3, min_control_count=10, top_case_terms=200, total_terms=300)
HISTORY = history.HistoryRules(first_before="1995-07-01", last_after="2001-01-01", min_dates=8, min_days=1800)
CODE_RULES = {
    "one": {"icd10": ["Brand25"], "icd9": []},
    "two": {"icd10": ["Brand25", "Brand7"], "icd9": []},
    "mixed": {"icd10": ["Brand13"], "icd9": ["PROMO"]},
}
SCOPE_RULES = {
    "heartfailure": {"icd10": ["Brand25"], "icd9": []},
    "neuropathy": {"icd10": ["Brand7", "Brand13"], "icd9": []},
    "case": {"icd10": ["Brand1"], "icd9": ["PROMO"]},
}
# The numbers of a stored vector, and the topics fitted by default.
VECTOR_SIZE = 64
TOPICS = 100

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Written to a table of its own, which ``done`` deletes where no later step of the query reads it."""
    path = scratch(df.sparkSession, name)
    found = store.save(df, path)
    found.path = path
    return found


def done(*tables: DataFrame) -> None:
    for df in tables:
        store.drop(df.sparkSession, df.path)


def as_id(column: str):
    return F.col(column).cast("string")


# --- keys -------------------------------------------------------------------------------------


@query
def patient_bucket_split(spark, sf):
    ids = table(spark, sf, "customer").select(as_id("c_custkey").alias("pid"))
    return ids.withColumn("bucket", keys.bucket(F.col("pid"))).select(
        "pid", "bucket", keys.bucket_label(F.col("bucket")).alias("label"),
        keys.is_test(F.col("bucket")).cast("int").alias("is_test"),
    )


@query
def bucket_census(spark, sf):
    return quality.bucket_census(table(spark, sf, "customer"), F.col("c_custkey"), 100)


@query
def point_lookup(spark, sf):
    path = scratch(spark, "split")
    rows = table(spark, sf, "documents").select(as_id("doc_id").alias("pid"), "lang", "text")
    store.write_split(rows, path, "pid", ["text"])
    return store.lookup(spark, path, "7", "pid", ["pid", "bucket", "lang", "n_chars", "text"])


@query
def cohort_lookup(spark, sf):
    """A small cohort's rows, by a filter of the scan, and a larger one's, by a join."""
    path = scratch(spark, "split")
    rows = table(spark, sf, "documents").select(as_id("doc_id").alias("pid"), "lang", "text")
    store.write_split(rows, path, "pid", ["text"])
    cohorts_read = {name: table(spark, sf, "labels").where(cond).select(as_id("doc_id").alias("pid")) for name, cond in (("few", "doc_id % 40 = 3"), ("many", "true"))}
    found = [store.read_patients(spark, path, c, "pid", ["pid", "lang", "n_chars"]).select(F.lit(name).alias("cohort"), "*") for name, c in cohorts_read.items()]
    return found[0].union(found[1])


@query
def training_scan(spark, sf):
    path = scratch(spark, "split")
    rows = table(spark, sf, "orders").select(as_id("o_custkey").alias("pid"), "o_orderkey", "o_orderstatus", "o_totalprice")
    store.write_split(rows, path, "pid")
    return store.read_split(spark, path, ["pid", "o_orderkey", "bucket"], F.col("o_orderstatus") == "F", training_only=True)


@contextmanager
def in_blocks_of(spark, size):
    """Files are divided into blocks of ``size`` bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}
    try:
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@query
def row_limit(spark, sf):
    """The first rows of each of eight files."""
    spec = TableSpec("Orders", ("o_orderkey", "o_custkey", "o_orderstatus"), (32, 32, 1), id="o_orderkey")
    raw = scratch(spark, "raw")
    rows = table(spark, sf, "orders").select("o_orderkey", as_id("o_custkey").alias("o_custkey"), "o_orderstatus")
    dealt = rows.repartitionById(8, (F.col("o_orderkey") % 8).cast("int")).sortWithinPartitions("o_orderkey")
    delimited.write_delimited(dealt, f"{raw}/Orders.csv", header=True)
    return delimited.read_table(spark, f"{raw}/Orders.csv", spec, limit=500)


@query
def id_quality(spark, sf):
    return quality.id_report(table(spark, sf, "documents"), as_id("doc_id"), 3)


@query
def patient_index(spark, sf):
    return quality.patient_positions(table(spark, sf, "orders"), F.col("o_custkey"), ["o_orderkey"])


@query
def patient_list(spark, sf):
    return quality.patient_list(table(spark, sf, "orders"), F.col("o_custkey"))


@query
def num_patients(spark, sf):
    return quality.num_patients(table(spark, sf, "orders"), F.col("o_custkey"))


# --- sources ----------------------------------------------------------------------------------


@query
def fixed_width_codes(spark, sf):
    lines = table(spark, sf, "part").select(
        F.concat(F.rpad("p_brand", 8, " "), F.lit(" "), "p_name").alias("value"), "p_partkey")
    return code_source.parse_codes(lines, F.col("p_partkey"))


@query
def flag_table(spark, sf):
    path = scratch(spark, "flags")
    table(spark, sf, "labels").select("doc_id", "quality", "toxic").write.option("header", True).csv(path)
    return delimited.read_flags(spark, path)


@query
def ingest_roundtrip(spark, sf):
    spec = TableSpec("Notes", ("pid", "turn", "role", "text"), (32, 8, 16, 360_000), ("role", "text"), "turn", id="pid")
    raw, split = scratch(spark, "raw"), scratch(spark, "split")
    rows = table(spark, sf, "conversations").select(
        as_id("conv_id").alias("pid"), as_id("turn").alias("turn"), "role", "text")
    delimited.write_delimited(rows, f"{raw}/Notes.csv", header=True)
    store.write_split(delimited.read_table(spark, f"{raw}/Notes.csv", spec), split, "pid", spec.text)
    return store.read_split(spark, split, list(spec.columns))


@query
def divided_ingest(spark, sf):
    spec = TableSpec("Notes", ("pid", "turn", "role", "text"), (32, 8, 16, 360_000), ("role", "text"), "turn", id="pid")
    raw = scratch(spark, "raw")
    rows = table(spark, sf, "conversations").select(
        as_id("conv_id").alias("pid"), as_id("turn").alias("turn"), "role", F.concat(F.lit('"\n|'), F.coalesce("text", F.lit(""))).alias("text"))
    delimited.write_delimited(rows, f"{raw}/Notes.csv", header=True)
    with in_blocks_of(spark, 1 << 16):
        return store.save(delimited.read_table(spark, f"{raw}/Notes.csv", spec), scratch(spark, "rows"))


@query
def return_ingest(spark, sf):
    """Lines that end with carriage returns only, read block by block."""
    spec = TableSpec("Notes", ("pid", "turn", "text"), (32, 8, 360_000), ("text",), "turn", id="pid")
    raw = scratch(spark, "raw")
    text = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('\n"'))
    lines = table(spark, sf, "conversations").select(F.concat_ws("|", as_id("conv_id"), as_id("turn"), text).alias("value"))
    lines.write.option("lineSep", "\r").text(f"{raw}/Notes.csv")
    with in_blocks_of(spark, 1 << 16):
        return store.save(delimited.read_table(spark, f"{raw}/Notes.csv", spec, header=False), scratch(spark, "rows"))


@query
def header_ingest(spark, sf):
    """Files with their columns in different orders and a damaged id name, read by their headers."""
    spec = TableSpec("part", ("pid", "turn", "text"), (32, 8, 360_000), ("text",), "turn", id="pid")
    raw = scratch(spark, "raw")
    rows = table(spark, sf, "conversations").select(as_id("conv_id").alias("pid"), as_id("turn").alias("turn"), "text")
    delimited.write_delimited(rows.where("turn % 2 = 0"), f"{raw}/even", header=True)
    delimited.write_delimited(rows.where("turn % 2 = 1").select(F.col("pid").alias("#PID"), F.lit("x").alias("other"), "text", "turn"), f"{raw}/odd", header=True)
    return delimited.read_by_header(spark, f"{raw}/*", spec)


@query
def stray_quote_ingest(spark, sf):
    """Inch marks in fields that are not quoted, read block by block."""
    spec = TableSpec("Parts", ("pid", "size", "name"), (32, 60, 60), id="pid")
    raw = scratch(spark, "raw")
    lines = table(spark, sf, "part").select(F.concat_ws(
        "|", as_id("p_partkey"), F.concat(F.col("p_size").cast("string"), F.lit('" '), "p_type"), F.concat(F.lit('"a|""'), "p_name", F.lit('"'))))
    lines.write.text(f"{raw}/Parts.csv")
    with in_blocks_of(spark, 1 << 14):
        return store.save(delimited.read_table(spark, f"{raw}/Parts.csv", spec, header=False), scratch(spark, "rows"))


@query
def unclosed_quote_ingest(spark, sf):
    """A quote that is never closed takes the rest of its file, all other files stay as they are."""
    spec = TableSpec("Orders", ("o_orderkey", "rest"), (32, 1000), id="o_orderkey")
    raw = scratch(spark, "raw")
    rows = table(spark, sf, "orders").where("o_orderkey % 7 = 0")
    opened = F.col("o_orderkey") == rows.where("o_orderkey % 16 = 0 and o_orderkey > 100").agg(F.min("o_orderkey")).first()[0]
    lines = rows.select("o_orderkey", F.concat_ws("|", as_id("o_orderkey"), F.concat(F.when(opened, F.lit('"')).otherwise(F.lit("")), "o_orderstatus")).alias("value"))
    placed = lines.repartitionById(16, (F.col("o_orderkey") % 16).cast("int")).sortWithinPartitions("o_orderkey").select("value")
    placed.write.text(f"{raw}/Orders.csv")
    with in_blocks_of(spark, 1 << 10):
        found = store.save(delimited.read_table(spark, f"{raw}/Orders.csv", spec, header=False), scratch(spark, "rows"))
    return found.select("o_orderkey", F.length("rest").alias("n_rest"), F.regexp_count("rest", F.lit("\n")).alias("n_lines"))


@query
def count_list_roundtrip(spark, sf):
    path = scratch(spark, "counts")
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").cast("string").alias("token")) \
        .agg(F.count("*").alias("cnt"))
    store.write_counts(counts, path)
    return store.read_counts(spark, path)


# --- text -------------------------------------------------------------------------------------


@query
def tokenize(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("words"))
    return docs.select("doc_id", F.size("words").alias("n_tokens"), F.array_join("words", " ").alias("tokens"))


@query
def bigrams(spark, sf):
    notes = table(spark, sf, "conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("words"))
    return notes.select("conv_id", "turn", F.array_join(text.ngrams(F.col("words"), 2), " ").alias("pairs"))


@query
def slug(spark, sf):
    names = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("name")).union(
        table(spark, sf, "region").select("r_name")).union(table(spark, sf, "part").select("p_name"))
    return names.distinct().select("name", text.slug(F.col("name")).alias("slug"))


def notes_of(spark, sf):
    return table(spark, sf, "conversations")


@query
def patient_document(spark, sf):
    raw = documents.assemble(notes_of(spark, sf), F.col("conv_id"), text.row_text("role", "text"), [F.col("turn")])
    return raw.select("pid", "part", "text")


@query
def blank_repeats(spark, sf):
    docs = documents.whole(table(spark, sf, "documents").select("doc_id", "text"), F.col("doc_id"), F.col("text"))
    return documents.blank_repeats(docs).select("pid", "part", "text")


@query
def review_document(spark, sf):
    _, clean = documents.review_documents(notes_of(spark, sf), F.col("conv_id"), text.row_text("role", "text"), [F.col("turn")])
    return clean.select("pid", "part", "text")


@query
def clean_document(spark, sf):
    clean = documents.clean_documents(notes_of(spark, sf), F.col("conv_id"), text.row_text("role", "text"), [F.col("turn")])
    return clean.select("pid", "part", "text")


# --- terms ------------------------------------------------------------------------------------


def corpus(spark, sf):
    return documents.whole(table(spark, sf, "documents").select("doc_id", "text"), F.col("doc_id"), F.col("text"))


def corpus_labels(spark, sf):
    """``(pid, label)`` of every document: whoever is no case is a control, labelled or not."""
    cases = table(spark, sf, "labels").where("toxic = 1").select(as_id("doc_id").alias("pid"))
    return cohorts.label(table(spark, sf, "documents").select(as_id("doc_id").alias("pid")), cases)


def corpus_masks(spark, sf):
    membership = corpus_labels(spark, sf).select(F.lit("all").alias("scope"), "pid", "label")
    return terms.membership_masks(membership, SCOPES)


def counted(spark, sf):
    """The words of all texts, the counts and the class sizes, written once: later steps read them several
    times and must not repeat the text work."""
    docs, masks = corpus(spark, sf), corpus_masks(spark, sf)
    words = saved(terms.token_lists(docs, masks), "tokens")
    counts = saved(terms.counts_of_tokens(words, masks, SCOPES), "counts")
    return words, counts, saved(terms.patient_counts(docs, masks, SCOPES), "people")


@query
def term_counts(spark, sf):
    return terms.term_counts(corpus(spark, sf), corpus_masks(spark, sf), SCOPES).drop("scope")


@query
def term_counts_pieces(spark, sf):
    """The same counts with every text held in small pieces."""
    pieces = documents.assemble(table(spark, sf, "documents"), F.col("doc_id"), text.token_text(F.col("text")), [F.col("doc_id")],
                                separator=" ", skip_empty=True, row_chars=10, piece_chars=64)
    return terms.term_counts(documents.whole_words(pieces), corpus_masks(spark, sf), SCOPES).drop("scope")


@query
def scope_term_counts(spark, sf):
    docs = table(spark, sf, "documents").select(as_id("doc_id").alias("pid"), "lang")
    known = docs.join(corpus_labels(spark, sf), "pid").select(
        "pid", "label",
        F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("lang") == "en", F.lit("english")),
                                          F.when(F.col("lang") != "en", F.lit("other"))))).alias("scope"))
    scopes = ["all", "english", "other"]
    return terms.term_counts(corpus(spark, sf), terms.membership_masks(known, scopes), scopes)


@query
def training_patients(spark, sf):
    return terms.patient_counts(corpus(spark, sf), corpus_masks(spark, sf), SCOPES)


@query
def odds_ratio(spark, sf):
    docs, masks = corpus(spark, sf), corpus_masks(spark, sf)
    ratios = terms.odds_ratios(terms.term_counts(docs, masks, SCOPES), terms.patient_counts(docs, masks, SCOPES))
    return ratios.select("token", F.round("odds_ratio", 6).alias("odds_ratio"))


def words_and_vocabulary(spark, sf, odds=(3.5,)):
    words, counts, people = counted(spark, sf)
    vocab = saved(terms.vocabulary(counts, people, odds, VOCABULARY), "vocabulary")
    done(counts, people)
    return words, vocab


@query
def vocabulary(spark, sf):
    _, counts, people = counted(spark, sf)
    return terms.vocabulary(counts, people, (2.0, 3.5), VOCABULARY).drop("scope")


@query
def vocabulary_limits(spark, sf):
    _, counts, people = counted(spark, sf)
    return terms.vocabulary(counts, people, (2.0, 3.5), TIGHT_VOCABULARY).drop("scope")


def bag_of(spark, sf):
    words, vocab = words_and_vocabulary(spark, sf)
    bag = vectors.bag_of_tokens(words, corpus_masks(spark, sf), SCOPES, vocab, VOCABULARY.total_terms)
    return vocab, bag


@query
def bow(spark, sf):
    return bag_of(spark, sf)[1].select("pid", "term_id", "tf")


@query
def bow_nested(spark, sf):
    nested = vectors.nested_bag(bag_of(spark, sf)[1])
    pairs = F.transform("bow", lambda e: F.concat_ws(":", e["term_id"].cast("string"), e["tf"].cast("string")))
    return nested.select("pid", F.array_join(pairs, " ").alias("bow"))


def weights_of(spark, sf):
    vocab, bag = bag_of(spark, sf)
    return vocab, vectors.tfidf(bag, vocab, VOCABULARY.total_terms)


@query
def tfidf(spark, sf):
    return weights_of(spark, sf)[1].select("pid", "term_id", F.round("w", 6).alias("w"))


def fixed_basis(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.lit("all").alias("scope"), F.lit(3.5).alias("odds"), F.col("vec_id").cast("int").alias("term_id"),
        F.posexplode("embedding").alias("topic", "v"),
    ).withColumn("v", F.col("v").cast("double"))


@query
def lsi_project(spark, sf):
    vocab, weights = weights_of(spark, sf)
    vecs = vectors.project(weights, vectors.basis_of_terms(fixed_basis(spark, sf), vocab), VECTOR_SIZE, VOCABULARY.total_terms)
    return vecs.select("pid", F.posexplode("vec").alias("topic", "v")).select("pid", "topic", F.round("v", 6).alias("v"))


@query
def densify(spark, sf):
    # Turns are the topics: a conversation has as many as it has turns.
    sparse = table(spark, sf, "conversations").where("turn >= 0").groupBy(as_id("conv_id").alias("pid"), F.col("turn").cast("int").alias("topic")) \
        .agg(F.sum(F.length("text")).cast("double").alias("v"))
    return vectors.densify(sparse, VECTOR_SIZE).select("pid", F.posexplode("vec").alias("topic", "v")) \
        .select("pid", "topic", F.round("v", 6).alias("v"))


@query
def vector_gaps(spark, sf):
    vocab, weights = weights_of(spark, sf)
    basis = vectors.basis_of_terms(fixed_basis(spark, sf), vocab)
    vecs = store.save(vectors.project(weights, basis, VECTOR_SIZE, VOCABULARY.total_terms), scratch(spark, "vectors"))
    return vectors.vector_gaps(table(spark, sf, "documents").select(as_id("doc_id").alias("pid")), vecs)


def split_weights(spark, sf):
    """The vocabulary and all weights, written once, beside the split that was worked out for each patient."""
    words, vocab = words_and_vocabulary(spark, sf)
    split = (terms.TRAINING,)
    bag = vectors.bag_of_tokens(words, corpus_masks(spark, sf), SCOPES, vocab, VOCABULARY.total_terms, split)
    weights = saved(vectors.tfidf(bag, vocab, VOCABULARY.total_terms, split), "weights")
    done(words)
    return vocab, weights


def fitted(spark, sf):
    """The vocabulary, all weights, those of training patients, and the topics fitted on these."""
    vocab, weights = split_weights(spark, sf)
    train = terms.training(weights).select("pid", "term_id", "w")
    basis, values = lsi.fit_topics(train, TOPICS)
    return vocab, weights, train, basis, values


@query
def lsi_topics(spark, sf):
    return fitted(spark, sf)[4]


def topic_checks(train, basis, values, topics, scopes=1, keys=(), members=None):
    """For every fitted topic: whether the matrix stretches it by its singular value, and whether the
    topics are orthonormal. Patients are projected on all topics of a basis at once, never multiplied by their number; where
    scopes share their weights, on the topics of all scopes at once, of which they keep those of the scopes they are in."""
    topic = [*keys, "topic"]
    if members is not None:
        numbers = basis.select(*keys).distinct().select(*keys, (F.row_number().over(Window.orderBy(*keys)) - 1).alias("_at"))
        wide = basis.join(F.broadcast(numbers), list(keys)).withColumn("topic", F.col("topic") + F.col("_at") * topics).drop("_at", *keys)
    tagged = [df.withColumns({c: F.lit(v) for c, v in (("scope", "all"), ("odds", 3.5)) if members is not None or c not in keys})
              for df in (train, basis if members is None else wide)]
    vecs = vectors.project(*tagged, topics * (1 if members is None else scopes), VOCABULARY.total_terms * (scopes if members is None else 1))
    if members is not None:
        # As often as a patient is listed in a scope, its weights count.
        times = members.groupBy(*keys, "pid").agg(F.count("*").alias("_n")).join(F.broadcast(numbers), list(keys))
        vecs = vecs.drop("scope", "odds").join(times, "pid").select(*keys, F.transform(
            F.slice("vec", F.col("_at") * topics + 1, F.lit(topics)), lambda v: v * F.col("_n")).alias("vec"))
    squares = vecs.groupBy(*keys).agg(F.array(*[F.sum(F.get("vec", F.lit(t)) * F.get("vec", F.lit(t))) for t in range(topics)]).alias("norms"))
    stretched = squares.select(*keys, F.posexplode("norms").alias("topic", "norm"))
    other = basis.select(*keys, "term_id", F.col("topic").alias("_t"), F.col("v").alias("_v"))
    inner = basis.join(other, [*keys, "term_id"]).groupBy(*topic, "_t").agg(F.sum(F.col("v") * F.col("_v")).alias("p")) \
        .groupBy(*topic).agg(F.max(F.abs(F.col("p") - (F.col("topic") == F.col("_t")).cast("int"))).alias("off"))
    return values.join(stretched, topic).join(inner, topic).select(
        *topic, (F.abs(F.col("norm") - F.col("s") * F.col("s")) <= 1e-6 * (1 + F.col("norm"))).cast("int").alias("norm_ok"),
        (F.col("off") <= 1e-6).cast("int").alias("orthonormal"))


@query
def lsi_checks(spark, sf):
    _, _, train, basis, values = fitted(spark, sf)
    return topic_checks(train, basis, values, TOPICS)


@query
def lsi_scopes(spark, sf):
    """Eight scopes fitted in the same jobs, on the same weights."""
    _, weights = split_weights(spark, sf)
    docs = table(spark, sf, "documents")
    groups = {"everyone": F.lit(True), "english": F.col("lang") == "en", "other": F.col("lang") != "en", "long": F.col("n_chars") >= 1000}
    names = [F.when(cond & (F.col("source") != "src0" if far else F.lit(True)), F.lit(f"{'far_' if far else ''}{name}"))
             for name, cond in groups.items() for far in (False, True)]
    scopes = docs.select(as_id("doc_id").alias("pid"), F.explode(F.array_compact(F.array(*names))).alias("scope"))
    train = terms.training(weights).select("pid", "term_id", "w")
    basis, values = lsi.fit_all_topics(train, 5, ("scope",), scopes)
    return topic_checks(train, basis, values, 5, 2 * len(groups), ("scope",), scopes)


@query
def topic_terms(spark, sf):
    vocab, _, _, basis, _ = fitted(spark, sf)
    return lsi.topic_terms(basis, vocab)


@query
def lsi_vectors(spark, sf):
    _, weights, _, basis, _ = fitted(spark, sf)
    tagged = basis.select(F.lit("all").alias("scope"), F.lit(3.5).alias("odds"), "term_id", "topic", "v")
    return vectors.topic_weights(vectors.project(weights, tagged, TOPICS, VOCABULARY.total_terms)).select("pid", "topic", "v")


# --- history and cohorts ----------------------------------------------------------------------


def days_of(spark, sf):
    return history.note_days(table(spark, sf, "orders"), F.col("o_custkey"), F.col("o_orderdate"))


def flags_of(spark, sf):
    return history.history_flags(history.history(days_of(spark, sf)), HISTORY)


@query
def note_dates(spark, sf):
    as_text = F.date_format(F.col("o_orderdate"), "M/d/yyyy")
    days = history.note_days(table(spark, sf, "orders"), F.col("o_custkey"), dates.parse_date(as_text))
    return history.note_dates(days).select(
        "pid", F.array_join(F.transform("dates", lambda d: d.cast("string")), ",").alias("dates"))


@query
def date_text(spark, sf):
    shown = F.date_format(F.col("o_orderdate"), "M/d/yyyy")
    broken = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("13/"), shown)).otherwise(shown)
    return table(spark, sf, "orders").select("o_orderkey", dates.iso_date(broken).alias("iso"))


@query
def bad_dates(spark, sf):
    shown = F.date_format(F.col("o_orderdate"), "M/d/yyyy")
    broken = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("13/"), shown)).when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(shown)
    return history.date_report(table(spark, sf, "orders"), broken, dates.parse_date(broken))


@query
def history_flags(spark, sf):
    return flags_of(spark, sf).select(
        "pid", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"),
        "num_dates", "span_days", *[F.col(f).cast("int").alias(f) for f in history.FLAGS])


@query
def flag_overlap(spark, sf):
    return history.flag_overlap(flags_of(spark, sf))


@query
def flag_bitmaps(spark, sf):
    """The same counts from bitmaps of the flags."""
    flags = flags_of(spark, sf)
    sets = bitmaps.flag_bitmaps(flags, bitmaps.numbered(flags), history.FLAGS, "flag")
    return history.flag_overlap_of(store.save(sets, scratch(spark, "bitmaps")))


@query
def history_cohort(spark, sf):
    return history.history_cohort(flags_of(spark, sf))


def diagnoses_of(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def cohorts_of(spark, sf, rules):
    return cohorts.code_cohorts(diagnoses_of(spark, sf), F.col("o_custkey"), {"icd10": F.col("p_brand"), "icd9": F.col("p_type")}, rules)


@query
def code_cohorts(spark, sf):
    return cohorts_of(spark, sf, CODE_RULES)


@query
def prefix_cohorts(spark, sf):
    codes = diagnoses_of(spark, sf).select(as_id("o_custkey").alias("pid"), F.inline(F.array(
        F.struct(F.lit("icd10").alias("system"), F.col("p_brand").alias("code")),
        F.struct(F.lit("icd9").alias("system"), F.col("p_type").alias("code")))))
    # The rules are themselves a table: every brand of a large part names a cohort by type.
    rules = table(spark, sf, "part").select(F.inline(F.array(
        F.struct(F.col("p_type").alias("cohort"), F.lit("icd10").alias("system"), cohorts.normal_code(F.col("p_brand")).alias("prefix")),
        F.struct(F.col("p_brand").alias("cohort"), F.lit("icd9").alias("system"),
                 cohorts.normal_code(F.substring_index("p_type", " ", 2)).alias("prefix"))))).distinct()
    return cohorts.prefix_join(codes, rules)


@query
def cohort_algebra(spark, sf):
    named = cohorts_of(spark, sf, CODE_RULES)
    one, mixed = cohorts.members(named, "one"), cohorts.members(named, "mixed")
    seen = history.history_cohort(flags_of(spark, sf))
    return kinds_of(cohorts.union(one, mixed), cohorts.intersection(one, mixed, seen), cohorts.difference(mixed, one))


def kinds_of(*found):
    parts = [df.select(F.lit(name).alias("kind"), "pid") for name, df in zip(("union", "intersection", "difference"), found)]
    return parts[0].union(parts[1]).union(parts[2])


@query
def cohort_bitmaps(spark, sf):
    """The same algebra on bitmaps of all cohorts, made once."""
    named = cohorts_of(spark, sf, CODE_RULES).select("cohort", "pid").union(history.history_cohort(flags_of(spark, sf)).select(F.lit("seen"), "pid"))
    numbers = bitmaps.numbered(table(spark, sf, "customer").select(as_id("c_custkey").alias("pid")))
    sets = store.save(bitmaps.bitmaps(named, numbers, ["cohort"]), scratch(spark, "bitmaps"))
    one, mixed, seen = (sets.where(F.col("cohort") == name) for name in ("one", "mixed", "seen"))
    found = bitmaps.union(one, mixed), bitmaps.intersection(one, mixed, seen), bitmaps.difference(mixed, one)
    return kinds_of(*(bitmaps.members(f, numbers) for f in found))


@query
def scope_grid(spark, sf):
    disease = cohorts_of(spark, sf, SCOPE_RULES)
    patients = table(spark, sf, "orders").select(as_id("o_custkey").alias("pid"))
    membership = grid.scope_membership(patients, disease, history.history_cohort(flags_of(spark, sf)))
    return grid.scope_sizes(membership)


@query
def restricted_notes(spark, sf):
    chosen = table(spark, sf, "labels").where("quality = 1").select(as_id("doc_id").alias("pid"))
    notes = table(spark, sf, "conversations").select(as_id("conv_id").alias("pid"), "turn", "role")
    return cohorts.restrict(notes, chosen)


@query
def case_labels(spark, sf):
    seen = history.history_cohort(flags_of(spark, sf))
    return cohorts.label(table(spark, sf, "customer").select(as_id("c_custkey").alias("pid")), seen)


@query
def code_describe(spark, sf):
    parts = table(spark, sf, "part")
    known = parts.groupBy(cohorts.normal_code(F.upper("p_brand")).alias("code")).agg(F.max("p_name").alias("description")) \
        .where(F.col("code") != "BRAND25")
    dotted = parts.select("p_partkey", F.replace(F.lower("p_brand"), F.lit("#"), F.lit(".")).alias("code"))
    return code_source.describe(dotted, F.col("code"), known)


def code_table(spark, sf):
    return table(spark, sf, "part").select(
        F.concat_ws("-", "p_brand", as_id("p_partkey")).alias("code"), F.col("p_name").alias("description"))


@query
def code_prefix(spark, sf):
    return code_source.codes_like(code_table(spark, sf), "brand#1|BRAND#25")


@query
def code_search(spark, sf):
    return code_source.codes_about(code_table(spark, sf), "RING|blue")


# --- demographics and matrices ----------------------------------------------------------------


def people_of(spark, sf):
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.round("c_acctbal").cast("int").cast("string").alias("AGE"), F.col("c_mktsegment").alias("SEGMENT"),
        F.col("r_name").alias("REGION"))


@query
def one_hot(spark, sf):
    latest = demographics.latest(people_of(spark, sf), F.col("c_custkey"), ["AGE", "SEGMENT", "REGION"], [F.col("AGE")])
    return demographics.one_hot(latest, "AGE", ["SEGMENT", "REGION"])


@query
def one_hot_last_row(spark, sf):
    """The last of a customer's orders counts, and categories that only earlier ones have get columns too."""
    orders = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", F.dayofmonth("o_orderdate").cast("string").alias("AGE"), F.col("o_orderstatus").alias("STATUS"),
        F.col("o_orderpriority").alias("PRIORITY"))
    latest = demographics.latest(orders, F.col("o_custkey"), ["AGE", "STATUS", "PRIORITY"], [F.col("o_orderkey")])
    return demographics.one_hot(latest, "AGE", ["STATUS", "PRIORITY"], orders)


@query
def one_hot_long(spark, sf):
    people = people_of(spark, sf).withColumn("pid", as_id("c_custkey"))
    return demographics.one_hot_long(people, ["SEGMENT", "REGION"])


@query
def categories(spark, sf):
    return demographics.categories(people_of(spark, sf), ["SEGMENT", "REGION"])


def feature_tables(spark, sf):
    return {
        "documents": table(spark, sf, "documents").select(
            as_id("doc_id").alias("pid"), F.array(F.col("n_chars").cast("double"), F.length("lang").cast("double")).alias("vec")),
        "notes": table(spark, sf, "conversations").groupBy(as_id("conv_id").alias("pid")).agg(
            F.array(F.count("*").cast("double"), F.max("turn").cast("double")).alias("vec")),
        "vectors": table(spark, sf, "embeddings").select(
            as_id("vec_id").alias("pid"), F.col("embedding").cast("array<double>").alias("vec")),
    }


@query
def table_overlap(spark, sf):
    return vectors.overlap(list(feature_tables(spark, sf).values()))


@query
def assemble(spark, sf):
    both = vectors.assemble_matrix(feature_tables(spark, sf))
    only = vectors.assemble_matrix(feature_tables(spark, sf), ["notes"])
    rows = both.select(F.lit("all").alias("tables"), "pid", F.posexplode("features").alias("position", "value")).union(
        only.select(F.lit("notes"), "pid", F.posexplode("features")))
    return rows.select("tables", "pid", "position", F.round("value", 6).alias("value"))


# --- learning and evaluation ------------------------------------------------------------------


def predictions_of(spark, sf):
    return table(spark, sf, "labels").select(
        as_id("doc_id").alias("pid"), F.col("toxic").alias("label"), F.col("quality").alias("prediction"),
        keys.is_test(keys.bucket(as_id("doc_id"))).alias("is_test"))


@query
def confusion(spark, sf):
    return evaluate.confusion(predictions_of(spark, sf)).select(
        "tp", "fp", "tn", "fn", F.round("sensitivity", 6).alias("sensitivity"), F.round("specificity", 6).alias("specificity"))


@query
def report(spark, sf):
    return evaluate.report(predictions_of(spark, sf)).select(
        "class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query
def error_lists(spark, sf):
    return evaluate.error_lists(predictions_of(spark, sf))


@query
def fp_overlap(spark, sf):
    labels, docs = table(spark, sf, "labels"), table(spark, sf, "documents")
    lists = [
        labels.where("quality = 0").select(F.lit("low").alias("list"), as_id("doc_id").alias("pid")),
        labels.where("toxic = 1").select(F.lit("toxic"), as_id("doc_id")),
        docs.where("lang <> 'en'").select(F.lit("foreign"), as_id("doc_id")),
        docs.where("n_chars > 2000").select(F.lit("long"), as_id("doc_id")),
    ]
    lists = lists[0].union(lists[1]).union(lists[2]).union(lists[3])
    names = spark.range(1).select(F.lit("none").alias("list"))  # a list that nobody is on
    return evaluate.list_overlap(lists, names).select("list", "other", F.round("overlap_pct", 6).alias("overlap_pct"))


@query
def run_manifest(spark, sf):
    return reports.manifest(predictions_of(spark, sf), "run", ["boosted"], 400)


@query
def patient_lists(spark, sf):
    return reports.patient_lists(predictions_of(spark, sf), "run")


@query
def review_export(spark, sf):
    chosen = table(spark, sf, "labels").where("toxic = 1").select(as_id("doc_id").alias("pid"))
    # Records are cut down to the chosen patients before documents are put together.
    notes = notes_of(spark, sf).withColumn("pid", as_id("conv_id")).join(chosen, "pid", "left_semi")
    raw = documents.assemble(notes, F.col("pid"), text.row_text("role", "text"), [F.col("turn")])
    return reports.review_export(chosen, {"documents": corpus(spark, sf), "notes": raw})


def learning_matrix(spark, sf):
    vecs = table(spark, sf, "embeddings").select(
        as_id("vec_id").alias("pid"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    return vectors.assemble_matrix({"text": vecs}), vecs.where("label = 0").select("pid")


@query
def gbt_eval(spark, sf):
    matrix, cases = learning_matrix(spark, sf)
    result, _, _ = training.train_and_check(matrix, cases, vectors.column_names("text", 64), "run", "lsi_all",
                                            "boosted")
    return result


@query
def learner_tests(spark, sf):
    """The test patients of every learner by class; which of them are found is the learner's own affair."""
    matrix, cases = learning_matrix(spark, sf)
    names = vectors.column_names("text", VECTOR_SIZE)
    rows = [training.train_and_check(matrix, cases, names, "run", "lsi_all", kind, 10)[0] for kind in ("logistic", "svm")]
    return rows[0].union(rows[1]).select("model", "num_columns", (F.col("tp") + F.col("fn")).alias("cases"), (F.col("fp") + F.col("tn")).alias("controls"))


@query
def logreg_coef(spark, sf):
    matrix, cases = learning_matrix(spark, sf)
    names = vectors.column_names("text", 64)
    _, _, model = training.train_and_check(matrix, cases, names, "run", "lsi_all", "logistic", 10)
    return training.coefficients(model, names)


@query
def learner_results(spark, sf):
    matrix, cases = learning_matrix(spark, sf)
    names = vectors.column_names("text", 64)
    results = [training.train_and_check(matrix, cases, names, "run", "lsi_all", kind, 10)[0] for kind in ("forest", "svm", "lasso")]
    return results[0].union(results[1]).union(results[2])


# --- exact facts of what is fitted --------------------------------------------------------------


@query
def topic_term_facts(spark, sf):
    """For every topic: how many terms are listed, under ranks without gaps and in falling order, all of them from the vocabulary."""
    vocab, _, _, basis, _ = fitted(spark, sf)
    listing = store.save(lsi.topic_terms(basis, vocab), scratch(spark, "topics"))
    after = F.lead(F.abs("v")).over(Window.partitionBy("topic").orderBy("rank"))
    known = listing.withColumn("falls", F.coalesce(F.abs("v") >= after, F.lit(True))).join(vocab.select("token", F.lit(1).alias("known")), "token", "left")
    return known.groupBy("topic").agg(
        F.count("*").alias("n_terms"), F.max("rank").alias("last_rank"), F.count_distinct("rank").alias("n_ranks"),
        F.min(F.col("falls").cast("int")).alias("falling"), F.count("known").alias("n_known"))


@query
def vector_facts(spark, sf):
    """The training patients' vectors have the squares of the singular values as sums of squares, and nobody's vector is longer than 1."""
    _, weights, _, basis, values = fitted(spark, sf)
    tagged = basis.select(F.lit("all").alias("scope"), F.lit(3.5).alias("odds"), "term_id", "topic", "v")
    # The split is worked out for a patient, before it has a row for each topic.
    projected = terms.with_split(vectors.project(weights, tagged, TOPICS, VOCABULARY.total_terms))
    vecs = saved(vectors.topic_weights(projected), "vectors")
    done(weights)
    squares = terms.training(vecs).groupBy("topic").agg(F.sum(F.col("v") * F.col("v")).alias("sum"))
    longest = vecs.groupBy("pid").agg(F.sum(F.col("v") * F.col("v")).alias("size")).agg(F.max("size").alias("longest"))
    checked = values.join(squares, "topic").select("topic", (F.abs(F.col("sum") / (F.col("s") * F.col("s")) - 1) < 1e-6).cast("int").alias("sum_ok"))
    return checked.agg(F.count("*").alias("n_topics"), F.sum("sum_ok").alias("n_sums_ok")).join(
        F.broadcast(longest.select((F.col("longest") < 1 + 1e-9).cast("int").alias("within"))), F.lit(True))


@query
def learner_facts(spark, sf):
    """Of every learner: its test patients by class, and whether its lists have the sizes that the confusion counts say."""
    matrix, cases = learning_matrix(spark, sf)
    names, found = vectors.column_names("text", VECTOR_SIZE), None
    for kind, settings in (("boosted", {"maxIter": 5, "maxDepth": 3}), ("logistic", {}), ("forest", {"numTrees": 10}), ("lasso", {})):
        result, lists, _ = training.train_and_check(matrix, cases, names, "run", "lsi_all", kind, 10, predictions_path=scratch(spark, "said"), **settings)
        sizes = lists.groupBy("model").agg(*[F.count_if(F.col("kind") == k).alias(c) for k, c in (("true_positives", "l_tp"), ("false_positives", "l_fp"), ("false_negatives", "l_fn"))])
        row = result.join(sizes, "model").select(
            "model", (F.col("tp") + F.col("fn")).alias("cases"), (F.col("fp") + F.col("tn")).alias("controls"),
            ((F.col("tp") == F.col("l_tp")) & (F.col("fp") == F.col("l_fp")) & (F.col("fn") == F.col("l_fn"))).cast("int").alias("lists_ok"))
        found = row if found is None else found.union(row)
    return found


@query
def grid_facts(spark, sf):
    """What a small grid leaves behind when it has run twice under one name: results, manifest and patient lists, counted."""
    vecs = table(spark, sf, "embeddings").select(as_id("vec_id").alias("pid"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    cases, out, half = vecs.where("label = 0").select("pid"), scratch(spark, "grid"), VECTOR_SIZE // 2
    tables = {"low": (vecs.select("pid", F.slice("vec", 1, half).alias("vec")), vectors.column_names("low", half)),
              "high": (vecs.where("label <> 1").select("pid", F.slice("vec", half + 1, half).alias("vec")), vectors.column_names("high", half))}
    for learners in (("logistic", "forest"), ("logistic",)):
        grid.train_scope(tables, cases, "run", out, grid.GridConfig(learners=learners, case_weight=10, review=False, fits_at_once=3))
    results = store.load_all(spark, f"{out}/results").select(
        F.concat_ws(" ", F.lit("result"), "model", "tables").alias("what"), F.col("num_columns").cast("bigint").alias("a"),
        (F.col("tp") + F.col("fn")).alias("b"), (F.col("fp") + F.col("tn")).alias("c"))
    manifest = store.load_all(spark, f"{out}/manifest").select(
        F.concat_ws(" ", F.lit("manifest"), "models").alias("what"), "train_patients", "test_patients", F.col("case_weight").cast("bigint"))
    lists = store.load_all(spark, f"{out}/patient_lists").groupBy("kind").agg(F.count("*").alias("a"), F.count_distinct("pid").alias("b"))
    return results.union(manifest).union(lists.select(F.concat(F.lit("list "), "kind"), "a", "b", F.lit(0).cast("bigint")))
