import codecs
import csv
import io
import random
import threading
import time
from contextlib import contextmanager
from functools import partial

import pyarrow.parquet as pq
import pytest
from pyspark.sql import Observation, functions as F

from cohortlens.operators import documents, terms
from cohortlens.plans import grid, reports
from cohortlens.plans.parallel import side_by_side
from cohortlens.sources import catalog, delimited, store


def test_catalog():
    assert len(catalog.TABLES) == 12
    assert {n: len(t.columns) for n, t in catalog.TABLES.items()} == {
        "Clinical_Notes": 13, "Diagnoses": 23, "Hospital_Encounters": 49, "Administered_Medications": 13, "Ambulatory_Encounters": 12,
        "Current_Medications": 10, "Ordered_Medications": 21, "Demographics": 14, "Order_Narrative": 7, "Lab_Results": 14,
        "Result_Notes": 6, "Pathology": 14}
    assert all(t.columns[0] == "STUDY_PAT_ID" for t in catalog.TABLES.values())
    with pytest.raises(ValueError):
        catalog.DEMOGRAPHICS.require_text()


SPEC = catalog.TableSpec("Notes", ("STUDY_PAT_ID", "D", "T"), (32, 10, 100), ("T",), "D")


def test_read_table_edges(spark, tmp_path):
    pid = "p" * 32
    (tmp_path / "x_Notes_1.csv").write_bytes(codecs.BOM_UTF8 + (
        f'STUDY_PAT_ID|D|T\n{pid}|1/1/2010|"a ""q"" | x"\n{pid}|1/2/2010|"line one\nline two"\n\n{pid}|1/3/2010\nshortid||plain|extra\n{pid}||\n'
    ).encode())
    (tmp_path / "y_Notes_2.csv").write_text("h|h|h\n" + "".join(f"{pid}|d{i}|t{i}\n" for i in range(7)))
    (tmp_path / "Other.csv").write_text("a|b|c\n1|2|3\n")
    rows = delimited.read_table(spark, str(tmp_path), SPEC, report=True)
    got = [tuple(r) for r in rows.where(F.col("_file").contains("x_Notes")).select("D", "T").collect()]
    assert sorted(got) == sorted([("1/1/2010", 'a "q" | x'), ("1/2/2010", "line one\nline two"), ("1/3/2010", ""), ("", "plain"), ("", "")])
    told = lambda df: {r._file.rsplit("/", 1)[1]: (r.num_rows, r.malformed_rows, r.bad_ids) for r in df.collect()}
    assert told(delimited.ingest_report(rows, SPEC)) == {"x_Notes_1.csv": (5, 2, 1), "y_Notes_2.csv": (7, 0, 0)}
    (tmp_path / "z_Notes_3.csv").write_text("h|h|h\n")
    for limit in (None, 2):
        found, counts = delimited.scan(spark, str(tmp_path), SPEC, limit=limit)
        watched, seen = delimited.watched(found, SPEC)
        watched.write.format("noop").mode("overwrite").save()
        assert told(delimited.watched_report(found, counts, seen, SPEC)) == told(delimited.ingest_report(found, SPEC))
    (tmp_path / "x_Notes_1.csv").unlink()
    found, counts = delimited.scan(spark, str(tmp_path), SPEC)
    watched, seen = delimited.watched(found, SPEC)
    watched.write.format("noop").mode("overwrite").save()
    before = bytes_read(spark)
    assert told(delimited.watched_report(found, counts, seen, SPEC)) == {"y_Notes_2.csv": (7, 0, 0)}
    assert bytes_read(spark) - before < 3000  # of checkpointed counts, no raw file
    limited = delimited.read_table(spark, str(tmp_path), SPEC, limit=3, report=True)
    assert [r.D for r in limited.where(F.col("_file").contains("y_Notes")).orderBy("D").collect()] == ["d0", "d1", "d2"]
    assert limited.count() == 3


@contextmanager
def blocks_of(spark, size):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")
        yield
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


def sequential(path, encoding="utf-8-sig"):
    """The rows of one file by the rule, header left out, as (fields, whether malformed)."""
    text = path.read_bytes().decode(encoding).replace("\r\n", "\n").replace("\r", "\n")
    found = [r for r in csv.reader(io.StringIO(text.removesuffix("\n"), newline="\n"), delimiter="|") if r][1:]
    return sorted(((r + ["", "", ""])[:3], len(r) != 3) for r in found)


def read(spark, path):
    rows = delimited.read_table(spark, str(path), SPEC, report=True).collect()
    return sorted(([r[c] for c in SPEC.columns], r._corrupt is not None) for r in rows)


@pytest.mark.parametrize("end,size", [("\n", 7), ("\r\n", 20), ("\r", 41), *((e, n) for e in ("\n", "\r\n", "\r") for n in (3000, 1 << 27))])
def test_rows_do_not_depend_on_blocks(spark, tmp_path, end, size):
    rnd = random.Random(size)
    cell = lambda x: '"' + x.replace('"', '""') + '"' if any(c in x for c in '"|\n\r') else x
    lines = []
    for i in range(400 if size > 100 else 40):
        field = "".join(rnd.choice(["a", "é", " ", '"', "|", "\n", "\r\n", "\r", "word", ""]) for _ in range(rnd.randint(0, 30)))
        lines.append("|".join((f"{i:032d}", str(i), cell("long\n" * 500 if i % 150 == 7 and size > 100 else field))))
        if i % 9 == 0:
            lines += ["", "short|x", '5" stray|in"|z"', '"closed" after|q"|"', 'more"', "extra|b|c|d"]
    files = {"a": end.join(lines), "b": end.join([*lines, "last|x|"]) + end, "c": end.join([*lines, 'x|y|"open', "to|the|end"]) + end,
             "d": "", "e": "h|h|h", "f": 'h|h|h\n"only', "g": end * 5}
    for name, body in files.items():
        head = "" if name in "defg" else "STUDY_PAT_ID|D|T" + end
        (tmp_path / f"{name}_Notes.csv").write_bytes((codecs.BOM_UTF8 if name in "ab" else b"") + (head + body).encode())
    with blocks_of(spark, size):
        got = read(spark, tmp_path)
    assert got == sorted(r for name in files for r in sequential(tmp_path / f"{name}_Notes.csv"))


def test_whole_records_stay_in_place(spark, tmp_path):
    (tmp_path / "a_Notes.csv").write_text("h|h|h\n" + "".join(f"{i}|x|plain {i}\n" for i in range(3000)))
    with blocks_of(spark, 2000):
        rows = delimited.read_table(spark, str(tmp_path), SPEC)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
        assert rows.count() == 3000
        (tmp_path / "a_Notes.csv").write_text("h|h|h\n" + "".join(f'{i}|x|"plain\n{i}"\n' for i in range(3000)))
        rows = delimited.read_table(spark, str(tmp_path), SPEC)
        moved = [m for m in (rows._jdf.queryExecution().analyzed().toString()).splitlines() if "collect_list" in m]
        assert moved and rows.count() == 3000 and rows.where("T not like 'plain\n%'").count() == 0


def test_too_long_records_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delimited, "MOST_RECORD", 100)
    (tmp_path / "a_Notes.csv").write_text("h|h|h\n1|a|b\n2|a|\"" + "never closed\n" * 200)
    (tmp_path / "b_Notes.csv").write_text("h|h|h\n3|a|\"" + "much text\n" * 60 + '"\n4|a|"two\nlines"\n5|a|b\n')
    with blocks_of(spark, 50):
        rows = {r[0]: r for r in delimited.read_table(spark, str(tmp_path), SPEC, report=True).collect()}
    assert sorted(rows) == list("12345") and {k for k, r in rows.items() if r._corrupt} == {"2", "3"}
    assert rows["4"].T == "two\nlines" and 50 <= len(rows["2"].T) <= 300


def bytes_read(spark):
    return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())


def test_limit_reads_no_further(spark, tmp_path):
    amounts = {}
    for name, rows in (("small", 30_000), ("large", 600_000)):
        folder = tmp_path / f"{name} é"
        folder.mkdir()
        for f in "xy":
            (folder / f"{f}_Notes.csv").write_text("h|h|h\n" + "".join(f'{f}{i}|"d\n{i}"|text of some length to fill the line\n' for i in range(rows)))
        before = bytes_read(spark)
        with blocks_of(spark, 1 << 16):
            got = delimited.read_table(spark, str(folder), SPEC, limit=300)
        amounts[name] = bytes_read(spark) - before
        assert sorted(r[0] for r in got.collect()) == sorted(f"{f}{i}" for f in "xy" for i in range(300))
        assert {r.D for r in got.collect()} == {f"d\n{i}" for i in range(300)}
    assert amounts["large"] < 1.5 * amounts["small"] and amounts["large"] < (tmp_path / "large é" / "x_Notes.csv").stat().st_size / 3
    assert delimited.read_table(spark, str(tmp_path / "small é"), SPEC, limit=10**6).count() == 60_000


def test_encodings(spark, tmp_path):
    latin = catalog.TableSpec("L", ("STUDY_PAT_ID", "T"), (32, 10), encoding="ISO-8859-1")
    (tmp_path / "L.csv").write_bytes('STUDY_PAT_ID|T\np|"ca\nfé"\n'.encode("latin-1"))
    assert delimited.read_table(spark, str(tmp_path / "L.csv"), latin).first().T == "ca\nfé"
    (tmp_path / "B_Notes.csv").write_bytes(b"h|h|h\n1|2|a\xff\xfeb\n2|3|c\n")
    assert [r.T for r in delimited.read_table(spark, str(tmp_path / "B_Notes.csv"), SPEC).orderBy("STUDY_PAT_ID").collect()] == ["a��b", "c"]
    with pytest.raises(ValueError):
        delimited.read_table(spark, str(tmp_path / "L.csv"), catalog.TableSpec("L", ("a",), (1,), encoding="UTF-16"))


def test_latin1_and_header(spark, tmp_path):
    spec = catalog.TableSpec("N", ("STUDY_PAT_ID", "T"), (32, 10), encoding="ISO-8859-1")
    (tmp_path / "N.csv").write_bytes("STUDY_PAT_ID|T\np|café\n".encode("latin-1"))
    assert delimited.read_table(spark, str(tmp_path / "N.csv"), spec).first().T == "café"
    assert delimited.repaired(["xxstudy_pat_id", "b"], "STUDY_PAT_ID") == ["STUDY_PAT_ID", "b"]
    assert delimited.repaired(["x", "STUDY_PAT_ID2"], "STUDY_PAT_ID") == ["x", "STUDY_PAT_ID2"] and delimited.repaired([], "a") == []


def test_columns_by_header(spark, tmp_path):
    (tmp_path / "a_Notes.csv").write_bytes(codecs.BOM_UTF8 + b'"#STUDY_PAT_ID"|T|D\n1|"t|1"|d1\n2|t2\n')
    (tmp_path / "b_Notes.csv").write_text("D|STUDY_PAT_ID|extra\nd3|3|x\n")
    (tmp_path / "c_Notes.csv").write_text("")
    got = sorted(tuple(r) for r in delimited.read_by_header(spark, str(tmp_path), SPEC).collect())
    assert got == [("1", "d1", "t|1"), ("2", "", "t2"), ("3", "d3", "")]
    assert delimited.read_by_header(spark, str(tmp_path), SPEC, limit=1).count() == 2
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x_Notes.csv").write_text("")
    assert delimited.read_by_header(spark, str(tmp_path / "none"), SPEC).columns == list(SPEC.columns)


def test_write_read_and_store(spark, tmp_path):
    rows = [(f"{i % 4:032d}", f"d{i}", t) for i, t in enumerate(['q " q', "a|b", "two\nlines", "", " pad ", "é", "\\back", '"', "x"])]
    df = spark.createDataFrame(rows, SPEC.schema)
    delimited.write_delimited(df, str(tmp_path / "Notes.csv"))
    back = delimited.read_plain(spark, str(tmp_path / "Notes.csv"), list(SPEC.columns))
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    path = str(tmp_path / "split")
    store.write_split(df, path, SPEC.id, SPEC.text)
    assert sorted(map(tuple, store.read_split(spark, path, list(SPEC.columns)).collect())) == sorted(rows)
    with pytest.raises(Exception, match="already exists"):
        store.write_split(df, path, SPEC.id)
    one = store.lookup(spark, path, rows[0][0])
    assert one.count() == 3
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan
    train = store.read_split(spark, path, training_only=True)
    assert {r[0] for r in train.select(SPEC.id).collect()} == {r[0] for r in terms.training(df.withColumn("pid", F.col(SPEC.id))).select("pid").collect()}
    counts = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "token string, cnt long")
    store.write_counts(counts, str(tmp_path / "counts"))
    assert [r.token for r in store.read_counts(spark, str(tmp_path / "counts")).collect()] == ["c", "a", "b"]
    assert store.exists(spark, path)
    store.drop(spark, path)
    assert not store.exists(spark, path)


def _world(folder):
    """Two small source tables in the declared layouts."""
    rnd = random.Random(11)
    common = [f"common{c}{d}" for c in "abcdefgh" for d in "xyz"]
    notes, dx = [], []
    for i in range(160):
        pid = f"{i:032d}"
        code = ["E85.4", "I50.1", "G60.0", "J10"][i % 4]
        dx.append((pid, code, "", "1/1/2015"))
        if i % 4 == 0:
            dx.append((pid, "I50.9" if i % 8 else "G54", "", "1/2/2015"))
        for k in range(4):
            words = [rnd.choice(common[(i % 4) * 3: (i % 4) * 3 + 12]) for _ in range(30)]
            notes.append((pid, f"{k + 1}/{k + 1}/201{k}", " ".join(words)))

    def write(spec, rows, fields):
        lines = ["|".join(spec.columns)]
        for row in rows:
            cells = dict(zip(fields, row))
            lines.append("|".join('"' + cells.get(c, "") + '"' for c in spec.columns))
        (folder / f"export_{spec.name}.csv").write_text("\n".join(lines) + "\n")

    write(catalog.CLINICAL_NOTES, notes, ("STUDY_PAT_ID", "NOTE_DT", "RPT_TEXT"))
    dx = [(p, c, n, d, " ".join(rnd.choice(common) for _ in range(12))) for p, c, n, d in dx]
    write(catalog.DEMOGRAPHICS, [(f"{i:032d}", str(30 + i % 50), "Male" if i % 2 else "Female") for i in range(160)],
          ("STUDY_PAT_ID", "CURR_AGE_YRS", "GENDER_NM"))
    write(catalog.DIAGNOSES, dx, ("STUDY_PAT_ID", "ICD10_CODE", "ICD9_CODE", "DIAGNOSIS_START_DATE", "DX_NAME"))


def test_run_grid(spark, tmp_path, monkeypatch):
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    _world(raw)
    monkeypatch.setattr(grid, "scope_names", lambda *a: ["restrict_all", "hfneuro"])
    config = grid.GridConfig(
        tables=(catalog.DIAGNOSES, catalog.CLINICAL_NOTES, catalog.DEMOGRAPHICS), topics=(3,), odds=(50.0,), learners=("logistic",), case_weight=10,
        rules=terms.VocabularyRules(case_share=1.0, control_share=1.0, min_case_count=1, min_control_count=1, top_case_terms=30, total_terms=40))
    results = grid.run_grid(spark, str(raw), str(out), config).collect()
    assert len(results) == 2 * 4
    assert {r.tables: r.num_columns for r in results} == {"lsi_all": 12, "lsi_Diagnoses": 3, "lsi_Clinical_Notes": 3, "lsi_Demographics": 6}
    info = {r.run: r for r in store.load_all(spark, f"{out}/manifest").collect()}
    assert len(info) == 2
    for r in results:
        assert r.tp + r.fp + r.tn + r.fn == info[r.run].test_patients
        assert info[r.run].case_weight == 10.0
    assert store.load(spark, f"{out}/quality/dates/Clinical_Notes").first().asDict() == {"num_rows": 640, "no_date": 0, "bad_dates": 0}
    assert store.load(spark, f"{out}/quality/ages/Demographics").first().num_rows == 160
    assert store.load(spark, f"{out}/quality/ingest/Demographics").first().malformed_rows == 0
    assert store.load_all(spark, f"{out}/reports").count() == 2 * 4 * 5 and store.load(spark, f"{out}/features/Clinical_Notes/singular_values").count() == 6
    assert all((out / "review" / run).exists() for run in info)
    lists = store.load_all(spark, f"{out}/patient_lists")
    assert lists.groupBy("run", "pid").count().where("count > 1").isEmpty()
    diagonal = store.load_all(spark, f"{out}/fp_overlap").where("list = other").collect()
    assert all(r.overlap_pct in (None, 100.0) for r in diagonal)
    sizes = {r.scope: r.patients for r in grid.scope_sizes(store.load(spark, f"{out}/scopes")).collect()}
    assert sizes["all"] == 160 and sizes["hfneuro"] == 120
    one = grid.clean_document(spark, str(out), catalog.CLINICAL_NOTES, f"{5:032d}").collect()
    assert len(one) == 1 and one[0].text.startswith("common")
    stored = store.load(spark, f"{out}/Clinical_Notes_clean")
    assert sorted(r.pid for r in terms.training(stored).collect()) == sorted(r.pid for r in terms.training(stored.drop("folder")).collect())
    docs = {"notes": grid.review_table(spark, str(out), catalog.CLINICAL_NOTES)[1]}
    export = reports.review_export(spark.createDataFrame([(f"{3:032d}",)], "pid string"), docs)
    reports.write_review(export, str(tmp_path / "review"))
    assert "===== patient" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "review")).collect())
    assert documents.document_of(docs["notes"], f"{3:032d}").count() == 1


def test_a_run_repeated_under_its_name_replaces_its_rows(spark, tmp_path):
    rnd = random.Random(3)
    people = [f"{i:032d}" for i in range(300)]
    vecs = spark.createDataFrame([(p, [rnd.gauss(i % 3 == 0, 1), rnd.gauss(0, 1)]) for i, p in enumerate(people)], "pid string, vec array<double>")
    cases = spark.createDataFrame([(p,) for i, p in enumerate(people) if i % 3 == 0], "pid string")
    tables = {"a": (vecs, ["a0", "a1"]), "b": (vecs.where("vec[0] > -3"), ["b0", "b1"])}
    seen = Observation()
    vecs.observe(seen, F.count("*").alias("n")).count()  # a session that has observed something still trains and predicts
    out, names = str(tmp_path), ("results", "error_lists", "reports", "coefficients", "patient_lists", "manifest", "fp_overlap")

    def config(*others):
        return grid.GridConfig(learners=("logistic",), case_weight=2, other_case_weights=others, review=False)

    def rows(*tables):
        return {t: sorted((tuple(str(v) for v in r) for r in store.load_all(spark, f"{out}/{t}").collect())) for t in tables or names}

    grid.train_scope(tables, cases, "first", out, config(3))
    grid.train_scope({"a": tables["a"]}, cases, "other", out, config())
    before = rows()
    assert len(before["results"]) == 8 and len(before["manifest"]) == 2
    # A half of the run with other data in between, then the whole run once more.
    grid.train_scope({"a": (vecs.where(F.col("pid") < people[150]), ["a0", "a1"]), "b": tables["b"]}, cases, "first", out, config())
    half = rows("results", "reports", "manifest")
    assert {t: len(r) for t, r in half.items()} == {t: len(before[t]) for t in half} and half["results"] != before["results"]
    grid.train_scope(tables, cases, "first", out, config(3))
    assert rows() == before
    store.replace(spark.createDataFrame([], "a string, b int"), f"{out}/kept", "10", "2020-01-01")
    store.replace(spark.createDataFrame([("10", 1)], "a string, b int"), f"{out}/kept", "10")
    store.replace(spark.createDataFrame([("10", 2)], "a string, b int"), f"{out}/kept", "10")
    assert [tuple(r) for r in store.load_all(spark, f"{out}/kept").collect()] == [("10", 2)]


def test_side_by_side(spark):
    began, lock, most = [], threading.Lock(), []

    def task(i):
        with lock:
            began.append(i)
            most.append(len(began))
        spark.sparkContext.setJobDescription(f"task {i}")
        n = spark.range(1000 + i).repartition(3).count()
        with lock:
            began.remove(i)
        return n, spark.sparkContext.getLocalProperty("spark.scheduler.pool")

    found = side_by_side(spark, [partial(task, i) for i in range(9)], 3)
    assert [n for n, _ in found] == [1000 + i for i in range(9)] and {p for _, p in found} == {"side-0", "side-1", "side-2"}
    assert 1 < max(most) <= 3
    ran = []
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, [lambda: 1 // 0, *[partial(lambda i: (time.sleep(0.2), ran.append(i)), i) for i in range(30)]], 2)
    assert len(ran) < 30
    assert side_by_side(spark, [], 4) == [] and side_by_side(spark, [lambda: 5], 4) == [5]


def scanned_rows(df):
    """Rows that the scans of an executed plan handed on, after leaving out row groups."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numOutputRows"))


def test_lookups_read_the_row_groups_of_their_patients(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "ROW_GROUP_BYTES", 1 << 12)
    pids = [f"{i:032d}" for i in range(6000)]
    df = spark.createDataFrame([(p, f"text of {p} " * 5) for p in pids for _ in range(2)], "STUDY_PAT_ID string, T string")
    path = str(tmp_path / "split")
    store.write_split(df, path, text=["T"])
    one = store.lookup(spark, path, pids[77])
    assert one.count() == 2 and scanned_rows(one) < 600
    few = [pids[i] for i in (3, 500, 501, 5999)]
    cohort = spark.createDataFrame([(p,) for p in [*few, few[0], "absent", None]], "pid string")
    rows = store.read_patients(spark, path, cohort)
    assert sorted(r[0] for r in rows.collect()) == sorted(few * 2) and scanned_rows(rows) < 2500
    many = spark.createDataFrame([(p,) for p in pids[:700]], "pid string")
    assert sorted(r[0] for r in store.read_patients(spark, path, many, columns=["STUDY_PAT_ID"]).collect()) == sorted(pids[:700] * 2)
    assert store.read_patients(spark, path, cohort.limit(0)).count() == 0
    # The Bloom filter alone: an id that would lie among those of the files is found to be absent.
    unpruned = spark.read.parquet(path).where(F.col("STUDY_PAT_ID") == pids[5] + "x")
    assert scanned_rows(unpruned) < 3000
    footer = spark.read.parquet(path).inputFiles()[0].removeprefix("file://").removeprefix("file:")
    assert pq.ParquetFile(footer).metadata.num_row_groups >= 1


def test_small_blocks_are_read_several_by_one_task(spark, tmp_path):
    from cohortlens.sources import delimited
    from cohortlens.sources.catalog import TableSpec
    from workload.queries import in_blocks_of

    spec = TableSpec("T", ("id", "x"), (8, 8), id="id")
    (tmp_path / "T.csv").write_text("".join(f'{i}|"{"a" * (i % 50)}\n|"\n' for i in range(3000)))
    with in_blocks_of(spark, 512):
        lines = delimited._lines(spark, str(tmp_path / "T.csv"), spec)
        shared = delimited._in_few_tasks(lines)
        assert shared.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism < lines.rdd.getNumPartitions()
        rows = delimited.read_table(spark, str(tmp_path / "T.csv"), spec, header=False, report=True).collect()
    assert sorted((int(r.id), r.x) for r in rows) == [(i, "a" * (i % 50) + "\n|") for i in range(3000)]
    assert sorted(r._line for r in rows) == list(range(1, 3001)) and len({r._block_start for r in rows}) > 100
