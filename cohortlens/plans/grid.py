"""The experiment grid: scopes x odds ratios x topic counts x tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dates import parse_date
from ..functions.text import row_text
from ..operators import cohorts, demographics, documents, history, lsi, terms, vectors
from ..session import keep
from ..sources import delimited, store
from ..sources.catalog import CLINICAL_NOTES, DEFAULT_TABLES, DEMOGRAPHICS, DIAGNOSES, ID, TableSpec
from . import reports, training
from .parallel import side_by_side

# The population subgroups by disease cohort; None is everyone.
SUBGROUPS: dict[str, tuple[str, ...] | None] = {
    "all": None,
    "hfneuro": ("heartfailure", "neuropathy"),
    "hf": ("heartfailure",),
    "neuro": ("neuropathy",),
}
RESTRICTED = "restrict_"
# The age and the category columns of the demographics table, in feature order.
AGE = "CURR_AGE_YRS"
CATEGORIES = ("GENDER_NM", "NIH_ETHNCTY", "NIH_RACE")

# A table's vectors ``(pid, vec)`` with the names of their numbers.
Features = tuple[DataFrame, list[str]]


@dataclass(frozen=True)
class GridConfig:
    # The default run.
    tables: Sequence[TableSpec] = DEFAULT_TABLES
    topics: Sequence[int] = (100,)
    odds: Sequence[float] = (3.5,)
    rules: terms.VocabularyRules = field(default_factory=terms.VocabularyRules)
    history: history.HistoryRules = field(default_factory=history.HistoryRules)
    learners: Sequence[str] = ("boosted",)
    case_weight: float = training.CASE_WEIGHT
    # Further weights to train with, such as training.OTHER_CASE_WEIGHTS.
    other_case_weights: Sequence[float] = ()
    # Write the documents of misjudged test patients for reading.
    review: bool = True
    limit: int | None = None
    # Scopes that are trained, and fits of each that run, at the same time.
    scopes_at_once: int = 2
    fits_at_once: int = 4


def scope_names(subgroups: Mapping[str, object] = SUBGROUPS) -> list[str]:
    return [f"{prefix}{name}" for prefix in (RESTRICTED, "") for name in subgroups]


def scope_membership(patients: DataFrame, disease: DataFrame, restricted: DataFrame, case: str = "case",
                     subgroups: Mapping[str, tuple[str, ...] | None] = SUBGROUPS) -> DataFrame:
    """``(scope, pid, label)`` for the subgroups, once within the history cohort and once without.

    One row per patient carries its cohorts, and scopes are conditions on it: a single
    join of patient-level tables whatever the number of scopes.
    """
    on = disease.groupBy("pid").agg(F.collect_set("cohort").alias("_on"))
    seen = restricted.select("pid").distinct().withColumn("_history", F.lit(True))
    profile = patients.select("pid").distinct().join(on, "pid", "left").join(seen, "pid", "left").select(
        "pid", F.coalesce("_on", F.array().cast("array<string>")).alias("_on"),
        F.coalesce("_history", F.lit(False)).alias("_history"),
    )

    def belongs(wanted: tuple[str, ...] | None) -> Column:
        return F.lit(True) if wanted is None else F.arrays_overlap("_on", F.array(*[F.lit(w) for w in wanted]))

    cells = [
        F.when(belongs(wanted) & (F.col("_history") if prefix else F.lit(True)), F.lit(f"{prefix}{name}"))
        for prefix in (RESTRICTED, "") for name, wanted in subgroups.items()
    ]
    return profile.select(
        F.explode(F.array_compact(F.array(*cells))).alias("scope"), "pid",
        F.array_contains("_on", case).cast("int").alias("label"),
    )


def scope_sizes(membership: DataFrame) -> DataFrame:
    return membership.groupBy("scope").agg(F.count("*").alias("patients"), F.sum("label").alias("cases"))


def ingest(spark: SparkSession, raw: str, out: str, tables: Iterable[TableSpec], limit: int | None = None) -> None:
    """Source files to the patient-split store, then to clean documents."""
    for spec in tables:
        found, counts = delimited.scan(spark, raw, spec, limit=limit)
        rows, seen = delimited.watched(found, spec)
        # The place in its file tells which record of a patient is the last.
        rows = rows.drop(delimited.CORRUPT) if not spec.text else rows.select(*spec.columns)
        store.write_split(rows, f"{out}/{spec.name}", spec.id, spec.text)
        store.save(delimited.watched_report(found, counts, seen, spec), f"{out}/quality/ingest/{spec.name}")
        if spec.text:
            store.write_split(clean_table(spark, out, spec), f"{out}/{spec.name}_clean", "pid")


def clean_table(spark: SparkSession, out: str, spec: TableSpec) -> DataFrame:
    spec.require_text()
    rows = store.read_split(spark, f"{out}/{spec.name}")
    return documents.clean_documents(rows, F.col(spec.id), row_text(*spec.text), [F.col(spec.sort)],
                                     size=F.col(store.N_CHARS))


def clean_document(spark: SparkSession, out: str, spec: TableSpec, pid: str) -> DataFrame:
    """One patient's stored clean text, in reading order, from the one folder that can hold it."""
    return documents.document_of(store.lookup(spark, f"{out}/{spec.name}_clean", pid, "pid"), pid)


def review_table(spark: SparkSession, out: str, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """The raw and the repeat-blanked documents of a stored table."""
    spec.require_text()
    rows = store.read_split(spark, f"{out}/{spec.name}")
    return documents.review_documents(rows, F.col(spec.id), row_text(*spec.text), [F.col(spec.sort)],
                                      size=F.col(store.N_CHARS))


def build_cohorts(spark: SparkSession, out: str, config: GridConfig) -> tuple[DataFrame, DataFrame]:
    """Disease cohorts ``(cohort, pid)`` and the history cohort ``(pid)``, saved and read back."""
    diagnoses = store.read_split(spark, f"{out}/{DIAGNOSES.name}", [ID, "ICD10_CODE", "ICD9_CODE"])
    disease = cohorts.code_cohorts(diagnoses, F.col(ID), {"icd10": F.col("ICD10_CODE"), "icd9": F.col("ICD9_CODE")},
                                   cohorts.DISEASE_RULES)
    disease = store.save(disease, f"{out}/cohorts", ["cohort"])
    cohorts.require_members(disease, list(cohorts.DISEASE_RULES))
    notes = store.read_split(spark, f"{out}/{CLINICAL_NOTES.name}", [ID, "NOTE_DT"])
    store.save(history.date_report(notes, F.col("NOTE_DT"), parse_date(F.col("NOTE_DT"))), f"{out}/quality/dates/{CLINICAL_NOTES.name}")
    days = history.note_days(notes, F.col(ID), parse_date(F.col("NOTE_DT")))
    days = store.save(days, f"{out}/note_days")
    store.save(history.note_dates(days), f"{out}/note_dates")
    flags = keep(history.history_flags(history.history(days), config.history))
    store.save(history.flag_overlap(flags), f"{out}/date_statistics")
    restricted = store.save(history.history_cohort(flags), f"{out}/history_cohort")
    flags.unpersist()
    return disease, restricted


def build_features(docs: DataFrame, membership: DataFrame, scopes: Sequence[str], out: str,
                   config: GridConfig) -> DataFrame:
    """``(scope, odds, pid, vec)`` for one table, all scopes and odds in each job, at the largest topic
    count; a smaller count is a prefix of it."""
    masks = keep(terms.membership_masks(membership, scopes))
    # Each text is read once; the counts and the bag come from its words.
    words = store.save(terms.token_lists(docs, masks), f"{out}/tokens")
    counts = store.save(terms.counts_of_tokens(words, masks, scopes), f"{out}/term_counts")
    people = store.save(terms.patient_counts(docs, masks, scopes), f"{out}/patient_counts")
    store.save(terms.odds_ratios(counts, people, config.rules), f"{out}/odds_ratios")
    vocab = store.save(terms.vocabulary(counts, people, config.odds, config.rules), f"{out}/vocabulary")
    combos = len(scopes) * len(config.odds)
    rows = config.rules.total_terms * combos
    bag = store.save(vectors.bag_of_tokens(words, masks, scopes, vocab, rows), f"{out}/bow", ["scope", "odds"])
    weights = store.save(vectors.tfidf(bag, vocab, rows), f"{out}/tfidf", ["scope", "odds"])
    topics = max(config.topics)
    train = terms.training(weights.select(*lsi.KEYS, "pid", "term_id", "w"))
    basis, values = lsi.fit_all_topics(train, topics)
    store.save(values, f"{out}/singular_values")
    basis = store.save(basis, f"{out}/basis", ["scope", "odds"])
    store.save(lsi.topic_terms(basis, vocab, keys=lsi.KEYS), f"{out}/topics")
    vecs = vectors.project(weights, basis, topics, rows)
    result = store.save(vecs, f"{out}/vectors", ["scope", "odds"])
    masks.unpersist()
    return result


def demographic_features(spark: SparkSession, out: str, spec: TableSpec = DEMOGRAPHICS) -> Features:
    """Age and one-hot categories from a stored demographics table; the last record of a patient counts."""
    rows = store.read_split(spark, f"{out}/{spec.name}")
    store.save(demographics.age_report(rows, AGE), f"{out}/quality/ages/{spec.name}")
    order = [F.col(c) for c in (delimited.FILE, delimited.BLOCK, delimited.LINE)]
    wide = demographics.one_hot(demographics.latest(rows, F.col(spec.id), [AGE, *CATEGORIES], order), AGE, CATEGORIES, rows)
    return demographics.demographic_vector(wide, AGE)


def train_scope(tables: Mapping[str, Features], cases: DataFrame, run: str, out: str, config: GridConfig) -> DataFrame:
    """Train on all tables and on each alone, some fits at a time; returns the false-positive overlap of the run.

    All that a fit leaves behind stands under its run, model and tables, so a run that is repeated under its name, whole or in
    part, replaces its rows.
    """
    spark = cases.sparkSession
    # Joined once; the matrix of a single table is a part of each row. Every fit reads files through plans of its own, as
    # the expressions of one plan must not be sent out by several threads at the same time.
    matrix_path, cases_path = f"{out}/matrices/{run}/joined", f"{out}/matrices/{run}/cases"
    store.save(vectors.join_tables({name: df for name, (df, _) in tables.items()}), matrix_path)
    store.save(cases.select("pid").distinct(), cases_path)

    def fitted(only: tuple[str, ...], kind: str, weight: float) -> None:
        chosen = only or tuple(tables)
        columns, tag, name = [c for t in chosen for c in tables[t][1]], f"lsi_{only[0]}" if only else "lsi_all", f"{kind}{weight:g}"
        said_path = f"{out}/predictions/{run}/{name}_{tag}"
        result, lists, model = training.train_and_check(
            vectors.side_by_side(store.load(spark, matrix_path), chosen), store.load(spark, cases_path), columns, run, tag, kind, weight, f"{out}/models/{run}/{name}_{tag}", said_path)
        store.replace(result, f"{out}/results", run, name, tag)
        store.replace(lists, f"{out}/error_lists", run, name, tag)
        store.replace(reports.classification(store.load(spark, said_path), run, name, tag), f"{out}/reports", run, name, tag)
        if kind in ("logistic", "svm"):
            found = training.coefficients(model, columns).withColumn("run", F.lit(f"{run}/{name}/{tag}"))
            store.replace(found, f"{out}/coefficients", run, name, tag)

    def described() -> None:
        data = training.labelled(vectors.side_by_side(store.load(spark, matrix_path), tuple(tables)), store.load(spark, cases_path), config.case_weight)
        store.replace(reports.patient_lists(data, run), f"{out}/patient_lists", run)
        store.replace(reports.manifest(data, run, list(config.learners), config.case_weight), f"{out}/manifest", run)

    fits = [partial(fitted, only, kind, weight) for only in [(), *[(name,) for name in tables]] for kind in config.learners
            for weight in (config.case_weight, *config.other_case_weights)]
    side_by_side(spark, [*fits, described], config.fits_at_once)
    store.drop(spark, f"{out}/matrices/{run}")
    overlap = reports.false_positive_overlap(store.load_all(spark, f"{out}/error_lists").where(F.col("run") == run))
    store.replace(overlap.withColumn("run", F.lit(run)), f"{out}/fp_overlap", run)
    if config.review:
        review_errors(spark, out, config.tables, run)
    return overlap


def review_errors(spark: SparkSession, out: str, tables: Iterable[TableSpec], run: str) -> None:
    """The raw documents of the test patients that a run's model on all tables misjudged, as text files.

    Records are cut down to these patients before any document is put together.
    """
    lists = store.load_all(spark, f"{out}/error_lists").where(F.col("run") == run)
    chosen = lists.where((F.col("tables") == "lsi_all") & F.col("kind").isin("false_positives", "false_negatives")).select("pid").distinct()
    documents_of = {}
    for spec in tables:
        if spec.text:
            rows = store.read_patients(spark, f"{out}/{spec.name}", chosen, spec.id)
            documents_of[spec.name] = documents.assemble(rows, F.col(spec.id), row_text(*spec.text), [F.col(spec.sort)], size=F.col(store.N_CHARS))
    if documents_of:
        reports.write_review(reports.review_export(chosen, documents_of), f"{out}/review/{run}")


def run_grid(spark: SparkSession, raw: str, out: str, config: GridConfig = GridConfig(),
             generate: bool = True, name: str | None = None) -> DataFrame:
    """Everything from source files to the results table, which is returned. ``name`` begins the names of the runs; a
    new one is made up if it is not given, and an earlier grid of the same name is replaced run by run."""
    if generate:
        ingest(spark, raw, out, config.tables, config.limit)
    disease, restricted = build_cohorts(spark, out, config)
    scopes = scope_names()
    # Two runs never share a made-up name, even if started in the same second.
    stamp = name or f"{datetime.now():%Y_%m_%d_%H_%M_%S}_{uuid.uuid4().hex[:6]}"
    text_tables = [spec for spec in config.tables if spec.text]
    patients = None
    for spec in text_tables:
        ids = store.load(spark, f"{out}/{spec.name}_clean").select("pid")
        patients = ids if patients is None else patients.union(ids)
    membership = store.save(scope_membership(patients, disease, restricted), f"{out}/scopes")
    fitted = [spec.name for spec in text_tables]
    for spec in text_tables:
        build_features(store.load(spark, f"{out}/{spec.name}_clean"), membership, scopes, f"{out}/features/{spec.name}", config)
    others: dict[str, list[str]] = {}
    for spec in config.tables:
        if spec.name == DEMOGRAPHICS.name:
            found, others[spec.name] = demographic_features(spark, out, spec)
            store.save(found, f"{out}/features/{spec.name}/vectors")
    cases = store.save(cohorts.members(disease, "case"), f"{out}/cases")

    def trained(scope: str, odds: float, topics: int) -> DataFrame:
        here_cases = cohorts.restrict(store.load(spark, f"{out}/cases"), store.load(spark, f"{out}/history_cohort") if scope.startswith(RESTRICTED) else None)
        here = (F.col("scope") == scope) & (F.col("odds") == odds)
        # A smaller topic count is a prefix of the largest.
        tables: dict[str, Features] = {
            table: (store.load(spark, f"{out}/features/{table}/vectors").where(here).select("pid", F.slice("vec", 1, topics).alias("vec")), vectors.column_names(table, topics))
            for table in fitted
        } | {table: (store.load(spark, f"{out}/features/{table}/vectors"), names) for table, names in others.items()}
        run = f"{stamp}_{'-'.join(s.name for s in config.tables)}_{scope}_odds{odds:g}_topics{topics}"
        return train_scope(tables, here_cases, run, out, config)

    combinations = [partial(trained, scope, odds, topics) for scope in scopes for odds in config.odds for topics in config.topics]
    side_by_side(spark, combinations, config.scopes_at_once)
    return store.load_all(spark, f"{out}/results")
