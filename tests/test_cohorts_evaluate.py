import datetime as dt
import random

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from cohortlens.operators import bitmaps, cohorts, demographics, evaluate, history, quality
from cohortlens.plans import grid, reports, training
from cohortlens.sources import codes


def pids(df):
    return sorted(r.pid for r in df.collect())


def test_code_rules(spark):
    rows = [("a", "I09.81", ""), ("b", "i50", ""), ("c", "E85.4", None), ("d", "", "277.30"), ("e", "XI50", "1425"), ("f", None, "425.1"), ("g", "", "")]
    dx = spark.createDataFrame(rows, "pid string, c10 string, c9 string")
    got = cohorts.code_cohorts(dx, F.col("pid"), {"icd10": F.col("c10"), "icd9": F.col("c9")}, cohorts.DISEASE_RULES)
    assert sorted((r.cohort, r.pid) for r in got.collect()) == [("case", "c"), ("case", "d"), ("heartfailure", "a"), ("heartfailure", "f")]
    with pytest.raises(ValueError, match="neuropathy"):
        cohorts.require_members(got, list(cohorts.DISEASE_RULES))
    stacked = dx.select("pid", F.inline(F.array(F.struct(F.lit("icd10").alias("system"), F.col("c10").alias("code")),
                                                F.struct(F.lit("icd9").alias("system"), F.col("c9").alias("code")))))
    rules = spark.createDataFrame([(c, s, p) for c, r in cohorts.DISEASE_RULES.items() for s, ps in r.items() for p in ps],
                                  "cohort string, system string, prefix string")
    assert sorted(map(tuple, cohorts.prefix_join(stacked, rules).collect())) == sorted(map(tuple, got.collect()))


def test_sets_and_restriction(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "pid string") for s in ("xyz", "yzw"))
    assert pids(cohorts.union(a, b)) == list("wxyz")
    assert pids(cohorts.intersection(a, b)) == list("yz")
    assert pids(cohorts.difference(a, b)) == ["x"]
    assert pids(cohorts.restrict(a, None)) == list("xyz")
    assert pids(cohorts.restrict(a, b.limit(0))) == []
    assert sorted((r.pid, r.label) for r in cohorts.label(a, b).collect()) == [("x", 0), ("y", 1), ("z", 1)]


def test_history(spark):
    day = dt.date(2009, 1, 1)
    plans = {"short": [0, 50, 179], "enough": [1, 50, 181], "two": [1, 400], "early": [-400, -100, 0], "same": [1, 1, 300]}
    rows = [(p, day + dt.timedelta(days=d)) for p, ds in plans.items() for d in ds]
    days = history.note_days(spark.createDataFrame(rows, "p string, d date"), F.col("p"), F.col("d"))
    flags = history.history_flags(history.history(days))
    got = {r.pid: (r.num_dates, r.span_days, r.enough_dates, r.enough_days, r.last_after) for r in flags.collect()}
    assert got["short"] == (3, 179, True, False, True) and got["enough"] == (3, 180, True, True, True)
    assert got["two"][2:] == (False, True, True) and got["early"] == (3, 400, True, True, False) and got["same"][0] == 2
    assert pids(history.history_cohort(flags)) == ["enough"]
    cells = {(r.flag, r.other): r.patients for r in history.flag_overlap(flags).collect()}
    assert cells[("total", "")] == 5 and cells[("enough_dates", "enough_days")] == 2 and len(cells) == 15
    dates = {r.pid: r.dates for r in history.note_dates(days).collect()}
    assert dates["same"] == [day + dt.timedelta(days=1), day + dt.timedelta(days=300)]


def test_scopes(spark):
    patients = spark.createDataFrame([(f"p{i}",) for i in range(6)], "pid string")
    disease = spark.createDataFrame([("heartfailure", "p0"), ("neuropathy", "p1"), ("neuropathy", "p0"), ("case", "p1"), ("case", "p5")],
                                    "cohort string, pid string")
    seen = spark.createDataFrame([("p1",), ("p2",)], "pid string")
    sizes = {r.scope: (r.patients, r.cases) for r in grid.scope_sizes(grid.scope_membership(patients, disease, seen)).collect()}
    assert sizes == {"all": (6, 2), "hfneuro": (2, 1), "hf": (1, 0), "neuro": (2, 1), "restrict_all": (2, 1),
                     "restrict_hfneuro": (1, 1), "restrict_neuro": (1, 1)}
    assert len(grid.scope_names()) == 8


@pytest.mark.parametrize("rows,want", [
    ([(1, 1), (0, 0)], (1, 0, 1, 0, 1.0, 1.0)), ([(0, 1), (0, 0)], (0, 1, 1, 0, 0.0, 0.5)),
    ([(1, 0), (1, 1)], (1, 0, 0, 1, 0.5, 0.0)), ([], (0, 0, 0, 0, 0.0, 0.0)),
])
def test_confusion(spark, rows, want):
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "pid string, label int, prediction int")
    assert tuple(evaluate.confusion(df).first()) == want
    assert [r["class"] for r in evaluate.report(df).collect()] == ["0", "1", "accuracy", "macro avg", "weighted avg"]


def test_overlap_and_lists(spark):
    preds = spark.createDataFrame([("a", 1, 1, True), ("b", 0, 1, True), ("c", 1, 0, True), ("d", 0, 1, False), ("e", 1, 1, False), ("f", 0, 0, True)],
                                  "pid string, label int, prediction int, is_test boolean")
    lists = evaluate.error_lists(preds)
    assert sorted(map(tuple, lists.collect())) == [("false_negatives", "c"), ("false_positives", "b"), ("false_positives_train", "d"), ("true_positives", "a")]
    many = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "2"), ("y", "3"), ("y", "4"), ("y", "4")], "list string, pid string")
    got = {(r["list"], r.other): r.overlap_pct for r in evaluate.list_overlap(many, spark.createDataFrame([("empty",)], "list string")).collect()}
    assert got[("x", "x")] == 100 and got[("x", "y")] == 50 and got[("y", "x")] == pytest.approx(100 / 3)
    assert got[("empty", "x")] is None and got[("x", "empty")] == 0 and len(got) == 9
    docs = spark.createDataFrame([("a", 0, 1, "A"), ("b", 0, 1, "B")], "pid string, part int, parts int, text string")
    out = reports.review_export(preds.where("pid = 'a'"), {"one": docs, "two": docs})
    assert sorted((r.pid, r.table, r.text) for r in out.collect()) == [("a", "one", "A"), ("a", "two", "A")]


def test_demographics(spark):
    rows = [("p1", "61", " Male", "White"), ("p2", "x", "Female", "Not  Known"), ("p1", "62", "Male", "Asian")]
    df = spark.createDataFrame(rows, "id string, AGE string, SEX string, RACE string")
    latest = demographics.latest(df, F.col("id"), ["AGE", "SEX", "RACE"], [F.col("AGE")])
    wide = demographics.one_hot(latest, "AGE", ["SEX", "RACE"])
    assert wide.columns == ["pid", "AGE", "SEX_female", "SEX_male", "RACE_asian", "RACE_not_known"]
    assert sorted(map(tuple, wide.collect())) == [("p1", 62, 0, 1, 1, 0), ("p2", None, 1, 0, 0, 1)]
    vecs, names = demographics.demographic_vector(wide, "AGE")
    # A patient without a readable age stays, flagged.
    assert (names[0], names[-1]) == ("AGE", "AGE_missing")
    assert sorted((r.pid, r.vec) for r in vecs.collect()) == [("p1", [62.0, 0.0, 1.0, 1.0, 0.0, 0.0]), ("p2", [0.0, 1.0, 0.0, 0.0, 1.0, 1.0])]
    seen = demographics.one_hot(latest, "AGE", ["SEX", "RACE"], df)
    assert seen.columns == ["pid", "AGE", "SEX_female", "SEX_male", "RACE_asian", "RACE_not_known", "RACE_white"]
    assert demographics.age_report(df, "AGE").first().asDict() == {"num_rows": 3, "no_age": 0, "bad_ages": 1}


def test_codes_and_quality(spark):
    lines = spark.createDataFrame([("E854    Organ-limited",), ("E859    Unspecified thing",), ("I50     Heart failure",), ("E859    Second",)], "value string").coalesce(1)
    table = codes.parse_codes(lines)
    assert {r.code: r.description for r in table.collect()} == {"E854": "Organ-limited", "E859": "Second", "I50": "Heart failure"}
    asked = spark.createDataFrame([("e85.4",), ("Z",)], "c string")
    assert sorted(map(tuple, codes.describe(asked, F.col("c"), table).collect())) == [("Z", ""), ("e85.4", "Organ-limited")]
    assert sorted(r.code for r in codes.codes_like(table, "e85|xx").collect()) == ["E854", "E859"]
    assert [r.code for r in codes.codes_about(table, "HEART").collect()] == ["I50"]
    census = quality.bucket_census(spark.createDataFrame([("a",), ("a",)], "p string"), F.col("p"), 10)
    assert census.count() == 10 and census.agg(F.sum("patients")).first()[0] == 1


def test_report_against_mllib(spark):
    rows = [(str(i), int(i % 5 == 0), int(i % 3 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "pid string, label int, prediction int")
    both = df.select(F.col("prediction").cast("double"), F.col("label").cast("double"))
    got = {r["class"]: r for r in evaluate.report(df).collect()}
    for name, metric in (("precision", "weightedPrecision"), ("recall", "weightedRecall"), ("f1", "weightedFMeasure"), ("precision", "accuracy")):
        line = "accuracy" if metric == "accuracy" else "weighted avg"
        assert got[line][name] == pytest.approx(MulticlassClassificationEvaluator(metricName=metric).evaluate(both))


@pytest.mark.parametrize("kind,settings", [("boosted", {"maxIter": 3}), ("logistic", {}), ("forest", {"numTrees": 5}), ("svm", {}), ("lasso", {})])
def test_learners_separate_easy_classes(spark, tmp_path, kind, settings):
    rows = [(f"p{i}", [float(i % 10 == 0) * 3 + (i % 7) / 10, float(i % 3)]) for i in range(300)]
    matrix = spark.createDataFrame(rows, "pid string, features array<double>")
    cases = spark.createDataFrame([(f"p{i}",) for i in range(0, 300, 10)], "pid string")
    result, lists, model = training.train_and_check(matrix, cases, ["a", "b"], "run", "lsi_all", kind, 10, str(tmp_path / "m"), **settings)
    row = result.first()
    assert row.sensitivity == 1.0 and row.specificity == 1.0 and row.model == f"{kind}10" and row.tp + row.fp + row.tn + row.fn > 0
    assert {r.kind for r in lists.collect()} == {"true_positives"}
    again = training.predict(training.load_model(str(tmp_path / "m")), training.labelled(matrix, cases, 10))
    assert again.where("label <> prediction").isEmpty()
    with pytest.raises(ValueError):
        training.train_and_check(matrix, cases, ["a"], "", "t", kind)


def test_bitmaps_equal_sets(spark):
    rnd = random.Random(9)
    everyone = [f"p{i:06d}" for i in range(70_000)]
    sets = {"a": set(rnd.sample(everyone, 40_000)), "b": set(rnd.sample(everyone[:33_000], 900)), "c": set(rnd.sample(everyone[40_000:], 10)), "d": {everyone[32_768]}}
    rows = spark.createDataFrame([(s, p) for s, ps in sets.items() for p in [*ps, *list(ps)[:5]]] + [("a", "unknown"), ("e", None)], "cohort string, pid string")
    numbers = bitmaps.numbered(spark.createDataFrame([(p,) for p in everyone], "pid string"))
    made = bitmaps.bitmaps(rows, numbers, ["cohort"])
    made.cache()
    of = {s: made.where(F.col("cohort") == s) for s in sets}
    pids = lambda df: {r.pid for r in bitmaps.members(df, numbers).collect()}
    assert pids(bitmaps.union(of["a"], of["b"], of["d"])) == sets["a"] | sets["b"] | sets["d"]
    assert pids(bitmaps.intersection(of["a"], of["b"])) == sets["a"] & sets["b"]
    assert pids(bitmaps.intersection(of["b"], of["c"])) == set() and bitmaps.intersection(of["b"], of["c"]).count() == 0
    assert pids(bitmaps.difference(of["a"], of["b"])) == sets["a"] - sets["b"] and pids(bitmaps.difference(of["d"], of["c"])) == sets["d"]
    assert {r.cohort: r.patients for r in bitmaps.sizes(made, ["cohort"]).collect()} == {s: len(ps) for s, ps in sets.items()}
    listed = {(r.cohort, r.pid) for r in bitmaps.members(made, numbers, ["cohort"]).collect()}
    assert listed == {(s, p) for s, ps in sets.items() for p in ps}
    assert {(r.cohort, r.other): r.patients for r in bitmaps.overlaps(made, "cohort").collect()} == {
        (s, t): len(sets[s] & sets[t]) for s in sets for t in sets if sets[s] & sets[t]}
    made.unpersist()


def test_overlap_of_many_lists(spark, monkeypatch):
    monkeypatch.setattr(bitmaps, "LISTS_AT_ONCE", 300)
    lists = spark.range(1000).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(59))).alias("k")).select(
        F.format_string("l%04d", "n").alias("list"), ((F.col("n") * 7 + F.col("k") * 13) % 5000).cast("string").alias("pid"))
    found = evaluate.list_overlap(lists)
    rows = {(r["list"], r.other): r.overlap_pct for r in found.where("list in ('l0000', 'l0500', 'l0999')").collect()}
    on = {n: {(n * 7 + k * 13) % 5000 for k in range(60)} for n in range(1000)}
    assert len(rows) == 3000
    for n in (0, 500, 999):
        for m in range(1000):
            assert abs(rows[f"l{n:04d}", f"l{m:04d}"] - 100 * len(on[n] & on[m]) / 60) < 1e-9


def test_no_lists(spark):
    none = spark.createDataFrame([], "list string, pid string")
    assert evaluate.list_overlap(none).count() == 0
    assert [tuple(r) for r in evaluate.list_overlap(none, spark.createDataFrame([("x",)], "list string")).collect()] == [("x", "x", None)]


def test_cohorts_by_a_table_of_rules_are_found_where_the_patient_is(spark):
    rows = [(p, s, c) for p in ("1", "2", None) for s, c in (("a", "I5.0"), ("a", "I50"), ("a", "I6"), ("b", "I50"), (None, "I5"))] * 20
    codes = spark.createDataFrame(rows, "pid string, system string, code string")
    rules = spark.createDataFrame([(f"c{i}", "a", p) for i in range(30) for p in ("I5", "I")] + [("other", "b", "I5"), ("none", "b", "")], "cohort string, system string, prefix string")
    found = cohorts.prefix_join(codes, rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # The lists of cohorts are never shuffled: the only exchange of the result is the one by patient.
    assert plan.count("Exchange hashpartitioning(") == 1 and "hashpartitioning(cohort" not in plan
    want = {(c, p) for p in ("1", "2", None) for c in [f"c{i}" for i in range(30)] + ["other", "none"]}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want


def test_passes_over_training_rows_have_a_bounded_number_of_tasks(spark, monkeypatch):
    seen, kept = [], training.keep
    monkeypatch.setattr(training, "keep", lambda df: seen.append(df.rdd.getNumPartitions()) or kept(df))
    rows = spark.range(0, 300, numPartitions=100).select(
        F.col("id").cast("string").alias("pid"), F.array((F.col("id") % 2).cast("double"), F.col("id").cast("double")).alias("features"))
    flat = rows.withColumns({"label": F.element_at("features", 1).cast("int"), "weight": F.lit(1.0), "is_test": F.lit(False)}).withColumn("features", training.as_vector(F.col("features")))
    model = training.fit(flat, "logistic")
    assert seen == [training.PARTITIONS_PER_CORE * spark.sparkContext.defaultParallelism]
    assert training.predict(model, flat).where("label <> prediction").count() == 0
