"""The registered questions in SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from cohortlens.operators.history import FLAGS
from cohortlens.plans.grid import RESTRICTED, SUBGROUPS

from .queries import CODE_RULES, SCOPE_RULES, TIGHT_VOCABULARY, TOPICS, VECTOR_SIZE, VOCABULARY


def bucket(expr: str, n: int = 10_000) -> str:
    shift = (1 << 32) % n
    total = "0::BIGINT"
    for word in range(8):
        total = f"(({total}) * {shift} + ('0x' || substr(sha256({expr}), {8 * word + 1}, 8))::BIGINT) % {n}"
    return f"({total})"


def words(expr: str) -> str:
    chunks = f"list_filter(regexp_split_to_array(lower({expr}), '\\s+'), lambda c: length(c) >= 3 AND length(c) <= 64 " \
             "AND NOT regexp_matches(c, '^http|^www|\\.edu$|\\.com$|\\.org$'))"
    return f"list_filter(flatten(list_transform({chunks}, lambda c: regexp_split_to_array(c, '[^a-z]+'))), lambda w: length(w) >= 3)"


def blanked(source: str) -> str:
    """``source`` yields (pid, part, text)."""
    return f"""
    WITH src AS ({source}),
    chars AS (SELECT pid, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS pos
              FROM src WHERE text <> ''),
    grams AS (SELECT s.pid, p.pos, substr(s.text, p.pos, 30) AS gram
              FROM src s, LATERAL (SELECT unnest(generate_series(1, length(s.text) - 29)) AS pos) p
              WHERE length(s.text) >= 60),
    firsts AS (SELECT pid, gram, min(pos) AS first FROM grams GROUP BY ALL HAVING count(*) > 1),
    dups AS (SELECT g.pid, g.pos, 1 AS dup FROM grams g JOIN firsts f ON g.pid = f.pid AND g.gram = f.gram
             WHERE g.pos >= f.first + 30),
    marked AS (SELECT c.pid, c.pos, c.ch,
                      max(coalesce(d.dup, 0)) OVER (PARTITION BY c.pid ORDER BY c.pos ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS hit
               FROM chars c LEFT JOIN dups d ON c.pid = d.pid AND c.pos = d.pos),
    glued AS (SELECT pid, string_agg(CASE WHEN hit = 1 THEN ' ' ELSE ch END, '' ORDER BY pos) AS text FROM marked GROUP BY pid)
    SELECT s.pid, s.part, regexp_replace(regexp_replace(coalesce(g.text, ''), '\\t+', ' ', 'g'), ' +', ' ', 'g') AS text
    FROM src s LEFT JOIN glued g ON s.pid = g.pid"""


NOTES = """SELECT conv_id::VARCHAR AS pid, 0 AS part,
    string_agg(coalesce(role, '') || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS text
    FROM conversations GROUP BY conv_id"""

IS_TEST = f"{bucket('pid')} >= 8000"

COUNTS = f"""
member AS (SELECT doc_id::VARCHAR AS pid, (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))::INTEGER AS label
           FROM (SELECT DISTINCT doc_id FROM documents)),
train AS (SELECT d.doc_id::VARCHAR AS pid, m.label, {words('d.text')} AS words
          FROM documents d JOIN member m ON d.doc_id::VARCHAR = m.pid WHERE NOT ({bucket('d.doc_id::VARCHAR')} >= 8000)),
people AS (SELECT count(*) FILTER (label = 1) AS cases, count(*) FILTER (label = 0) AS controls FROM train),
tok AS (SELECT pid, label, unnest(words) AS token FROM train),
per AS (SELECT pid, label, token, count(*) AS tf FROM tok GROUP BY ALL),
counts AS (SELECT token,
    count(*) FILTER (label = 1) AS case_df, coalesce(sum(tf) FILTER (label = 1), 0)::BIGINT AS case_tf,
    count(*) FILTER (label = 0) AS ctrl_df, coalesce(sum(tf) FILTER (label = 0), 0)::BIGINT AS ctrl_tf
    FROM per GROUP BY token),
ratios AS (SELECT c.*, p.*, CASE WHEN case_df > 0 AND ctrl_df > 0 AND cases <> case_df AND controls <> ctrl_df
    THEN (case_df::DOUBLE / (cases - case_df)) / (ctrl_df::DOUBLE / (controls - ctrl_df)) END AS ratio
    FROM counts c, people p),
kept AS (SELECT * FROM ratios WHERE case_df > 0 AND ctrl_df > 0 AND case_df <= 0.85::DOUBLE * cases
    AND ctrl_df <= 0.6::DOUBLE * controls AND ratio IS NOT NULL)"""


def vocab(odds: str, rules=VOCABULARY) -> str:
    return f"""{COUNTS},
odds AS (SELECT unnest([{odds}]::DOUBLE[]) AS odds),
first AS (SELECT odds, token, case_tf + ctrl_tf AS cf,
    row_number() OVER (PARTITION BY odds ORDER BY case_tf DESC, token) AS rn
    FROM kept, odds WHERE case_tf >= {rules.min_case_count} AND ctrl_tf >= {rules.min_control_count} AND ratio < odds AND ratio > 1.0::DOUBLE / odds),
top AS (SELECT * FROM first WHERE rn <= {rules.top_case_terms}),
rest AS (SELECT odds, token, ctrl_tf AS cf, row_number() OVER (PARTITION BY odds ORDER BY ctrl_tf DESC, token) AS rn
    FROM ratios, odds WHERE case_df = 0 AND ctrl_tf >= {rules.min_control_count} AND ctrl_df <= 0.6::DOUBLE * controls),
vocab AS (SELECT odds, (rn - 1)::INTEGER AS term_id, token, cf FROM top UNION ALL
    SELECT r.odds, (r.rn + coalesce(u.n, 0) - 1)::INTEGER, r.token, r.cf FROM rest r
    LEFT JOIN (SELECT odds, count(*) AS n FROM top GROUP BY odds) u ON r.odds = u.odds WHERE r.rn + coalesce(u.n, 0) <= {rules.total_terms})"""


BOW = f"""{vocab('3.5')},
alltok AS (SELECT d.doc_id::VARCHAR AS pid, unnest({words('d.text')}) AS token
           FROM documents d JOIN member m ON d.doc_id::VARCHAR = m.pid),
bow AS (SELECT a.pid, v.term_id, count(*) AS tf FROM alltok a JOIN vocab v ON a.token = v.token GROUP BY a.pid, v.term_id)"""

TFIDF = f"""{BOW},
raw AS (SELECT b.pid, b.term_id, b.tf * log2((SELECT sum(cf) FROM vocab)::DOUBLE / v.cf) AS w
        FROM bow b JOIN vocab v ON b.term_id = v.term_id),
tfidf AS (SELECT pid, term_id, w / sqrt(sum(w * w) OVER (PARTITION BY pid)) AS w FROM raw WHERE abs(w) > 1e-12)"""

PROJECT = f"""{TFIDF},
basis AS (SELECT vec_id AS term_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS topic FROM embeddings),
vecs AS (SELECT t.pid, b.topic::INTEGER AS topic, sum(t.w * b.v) AS v FROM tfidf t JOIN basis b ON t.term_id = b.term_id
         WHERE b.topic < {VECTOR_SIZE} GROUP BY t.pid, b.topic)"""

FLAG_SQL = """SELECT o_custkey::VARCHAR AS pid, min(o_orderdate::DATE) AS first_day, max(o_orderdate::DATE) AS last_day,
    count(DISTINCT o_orderdate::DATE) AS num_dates,
    date_diff('day', min(o_orderdate::DATE), max(o_orderdate::DATE))::INTEGER AS span_days FROM orders GROUP BY o_custkey"""
FLAGS_CTE = f"""h AS ({FLAG_SQL}),
flags AS (SELECT *, true AS total, first_day < DATE '1995-07-01' AS first_before, last_day > DATE '2001-01-01' AS last_after,
    num_dates >= 8 AS enough_dates, span_days >= 1800 AS enough_days FROM h)"""
SEEN = "SELECT pid FROM flags WHERE total AND enough_dates AND enough_days AND last_after"

DIAGNOSES = """SELECT o_custkey::VARCHAR AS pid, l_quantity, regexp_replace(p_brand, '[^0-9a-zA-Z]+', '', 'g') AS icd10,
    regexp_replace(p_type, '[^0-9a-zA-Z]+', '', 'g') AS icd9
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""


def rule_cohorts(rules: dict, where: str = "true") -> str:
    parts = []
    for cohort, systems in rules.items():
        tests = [f"starts_with({s}, '{p}')" for s, prefixes in systems.items() for p in prefixes]
        parts.append(f"SELECT '{cohort}' AS cohort, pid FROM dx WHERE {where} AND ({' OR '.join(tests)})")
    return f"dx AS ({DIAGNOSES}), cohorts AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)}))"


def overlap_cells() -> str:
    cells = [f"SELECT '{a}' AS flag, '' AS other, count(*) FILTER ({a}) AS patients FROM flags" for a in FLAGS]
    cells += [f"SELECT '{a}', '{b}', count(*) FILTER ({a} AND {b}) FROM flags"
              for i, a in enumerate(FLAGS) for b in FLAGS[i + 1:]]
    return " UNION ALL ".join(cells)


def scope_sql() -> str:
    parts = []
    for prefix in (RESTRICTED, ""):
        for name, wanted in SUBGROUPS.items():
            tests = []
            if prefix:
                tests.append("pid IN (SELECT pid FROM seen)")
            if wanted:
                tests.append(f"pid IN (SELECT pid FROM cohorts WHERE cohort IN ({', '.join(repr(w) for w in wanted)}))")
            parts.append(f"SELECT '{prefix}{name}' AS scope, pid FROM pats WHERE {' AND '.join(tests) or 'true'}")
    return f"""WITH {FLAGS_CTE}, seen AS ({SEEN}), {rule_cohorts(SCOPE_RULES)},
    pats AS (SELECT DISTINCT o_custkey::VARCHAR AS pid FROM orders)
    SELECT scope, count(*) AS patients, count(*) FILTER (pid IN (SELECT pid FROM cohorts WHERE cohort = 'case')) AS cases
    FROM ({' UNION ALL '.join(parts)}) GROUP BY scope"""


SLUG = "regexp_replace(regexp_replace(lower({0}), '^\\s+|\\s+$', '', 'g'), '\\s+', '_', 'g')"

PEOPLE = """people AS (SELECT c_custkey::VARCHAR AS pid, round(c_acctbal)::INTEGER AS age, c_mktsegment AS seg, r_name AS reg
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")

PRED = f"""pred AS (SELECT doc_id::VARCHAR AS pid, toxic AS label, quality AS prediction,
    {bucket('doc_id::VARCHAR')} >= 8000 AS is_test FROM labels)"""
CONF = f"""WITH {PRED}, c AS (SELECT count(*) FILTER (label = 1 AND prediction = 1)::DOUBLE AS tp,
    count(*) FILTER (label = 0 AND prediction = 1)::DOUBLE AS fp, count(*) FILTER (label = 0 AND prediction = 0)::DOUBLE AS tn,
    count(*) FILTER (label = 1 AND prediction = 0)::DOUBLE AS fn FROM pred)"""


def _ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0 END)"


def report_sql() -> str:
    f1 = "(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END)"
    return f"""{CONF}, cls AS (
      SELECT '0' AS class, {_ratio('tn', 'tn + fn')} AS p, {_ratio('tn', 'tn + fp')} AS r, tn + fp AS n FROM c UNION ALL
      SELECT '1', {_ratio('tp', 'tp + fp')}, {_ratio('tp', 'tp + fn')}, tp + fn FROM c),
    f AS (SELECT *, {f1} AS f1 FROM cls)
    SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, n::BIGINT AS support FROM f UNION ALL
    SELECT 'accuracy', round({_ratio('tp + tn', 'tp + tn + fp + fn')}, 6), round({_ratio('tp + tn', 'tp + tn + fp + fn')}, 6),
      round({_ratio('tp + tn', 'tp + tn + fp + fn')}, 6), (tp + tn + fp + fn)::BIGINT FROM c UNION ALL
    SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), sum(n)::BIGINT FROM f UNION ALL
    SELECT 'weighted avg', round(sum(p * n) / sum(n), 6), round(sum(r * n) / sum(n), 6), round(sum(f1 * n) / sum(n), 6),
      sum(n)::BIGINT FROM f"""


FEATURES = """docs AS (SELECT doc_id::VARCHAR AS pid, [n_chars::DOUBLE, length(lang)::DOUBLE] AS v FROM documents),
notes AS (SELECT conv_id::VARCHAR AS pid, [count(*)::DOUBLE, max(turn)::DOUBLE] AS v FROM conversations GROUP BY conv_id),
vecs AS (SELECT vec_id::VARCHAR AS pid, embedding::DOUBLE[] AS v FROM embeddings)"""

LISTS = """lists AS (SELECT 'low' AS list, doc_id::VARCHAR AS pid FROM labels WHERE quality = 0 UNION
    SELECT 'toxic', doc_id::VARCHAR FROM labels WHERE toxic = 1 UNION
    SELECT 'foreign', doc_id::VARCHAR FROM documents WHERE lang <> 'en' UNION
    SELECT 'long', doc_id::VARCHAR FROM documents WHERE n_chars > 2000)"""

ORACLE: dict[str, str] = {
    "patient_bucket_split": f"""SELECT pid, b::INTEGER AS bucket, 'g' || lpad(b::VARCHAR, 5, '0') AS label,
        (b >= 8000)::INTEGER AS is_test FROM (SELECT c_custkey::VARCHAR AS pid, {bucket('c_custkey::VARCHAR')} AS b FROM customer)""",
    "bucket_census": f"""SELECT 'g' || lpad(g.b::VARCHAR, 3, '0') AS label, count(c.b) AS patients FROM range(100) g(b)
        LEFT JOIN (SELECT {bucket('c_custkey::VARCHAR', 100)} AS b FROM customer) c ON g.b = c.b GROUP BY g.b""",
    "point_lookup": f"""SELECT doc_id::VARCHAR AS pid, {bucket('doc_id::VARCHAR')}::INTEGER AS bucket, lang,
        length(text)::BIGINT AS n_chars, text FROM documents WHERE doc_id::VARCHAR = '7'""",
    "training_scan": f"""SELECT pid, o_orderkey, b::INTEGER AS bucket FROM (SELECT o_custkey::VARCHAR AS pid, o_orderkey, o_orderstatus,
        {bucket('o_custkey::VARCHAR')} AS b FROM orders) WHERE b < 8000 AND o_orderstatus = 'F'""",
    "row_limit": """SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus FROM
        (SELECT *, row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 500""",
    "id_quality": "SELECT count(*) AS num_rows, count(*) FILTER (length(doc_id::VARCHAR) <> 3) AS bad_ids FROM documents",
    "patient_index": "SELECT o_custkey::VARCHAR AS pid, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_no FROM orders",
    "patient_list": """SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS position FROM
        (SELECT DISTINCT o_custkey::VARCHAR AS pid FROM orders)""",
    "num_patients": "SELECT count(DISTINCT o_custkey) AS num_patients FROM orders",
    "fixed_width_codes": """SELECT trim(p_brand) AS code, arg_max(trim(p_name), p_partkey) AS description FROM part GROUP BY p_brand""",
    "flag_table": "SELECT doc_id::VARCHAR AS doc_id, quality::INTEGER AS quality, toxic::INTEGER AS toxic FROM labels",
    "ingest_roundtrip": "SELECT conv_id::VARCHAR AS pid, turn::VARCHAR AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations",
    "divided_ingest": """SELECT conv_id::VARCHAR AS pid, turn::VARCHAR AS turn, coalesce(role, '') AS role,
        '"' || chr(10) || '|' || coalesce(text, '') AS text FROM conversations""",
    "return_ingest": "SELECT conv_id::VARCHAR AS pid, turn::VARCHAR AS turn, coalesce(text, '') || chr(10) AS text FROM conversations",
    "unclosed_quote_ingest": """WITH r AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 7 = 0),
        q AS (SELECT min(k) AS q FROM r WHERE k % 16 = 0 AND k > 100)
        SELECT k::VARCHAR AS o_orderkey, 1 AS n_rest, 0 AS n_lines FROM r, q WHERE k % 16 <> 0 OR k < q
        UNION ALL SELECT any_value(q)::VARCHAR, (sum(length(chr(10) || k::VARCHAR || '|' || s)) - any_value(length(chr(10) || q::VARCHAR || '|')))::INTEGER,
        count(*)::INTEGER - 1 FROM r, q WHERE k % 16 = 0 AND k >= q""",
    "stray_quote_ingest": """SELECT p_partkey::VARCHAR AS pid, p_size || '" ' || p_type AS size, 'a|"' || p_name AS name FROM part""",
    "count_list_roundtrip": "SELECT l_shipdate::DATE::VARCHAR AS token, count(*) AS cnt FROM lineitem GROUP BY 1",
    "tokenize": f"""SELECT doc_id, len(w)::INTEGER AS n_tokens, array_to_string(w, ' ') AS tokens
        FROM (SELECT doc_id, {words('text')} AS w FROM documents)""",
    "bigrams": f"""SELECT conv_id, turn, array_to_string(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || '_' || w[i + 1]), ' ') AS pairs
        FROM (SELECT conv_id, turn, {words('text')} AS w FROM conversations)""",
    "slug": f"""SELECT name, {SLUG.format('name')} AS slug FROM (SELECT DISTINCT c_mktsegment AS name FROM customer UNION
        SELECT r_name FROM region UNION SELECT p_name FROM part)""",
    "patient_document": NOTES,
    "blank_repeats": blanked("SELECT doc_id::VARCHAR AS pid, 0 AS part, text FROM documents"),
    "review_document": blanked(NOTES),
    "clean_document": blanked(f"SELECT pid, part, array_to_string({words('text')}, ' ') AS text FROM ({NOTES})"),
    "term_counts": f"WITH {COUNTS} SELECT token, case_df, case_tf, ctrl_df, ctrl_tf FROM counts",
    "term_counts_pieces": f"WITH {COUNTS} SELECT token, case_df, case_tf, ctrl_df, ctrl_tf FROM counts",
    "scope_term_counts": f"""WITH {COUNTS}, scoped AS (
        SELECT 'all' AS scope, p.* FROM per p UNION ALL
        SELECT CASE WHEN d.lang = 'en' THEN 'english' ELSE 'other' END, p.* FROM per p JOIN documents d ON d.doc_id::VARCHAR = p.pid)
        SELECT scope, token, count(*) FILTER (label = 1) AS case_df, coalesce(sum(tf) FILTER (label = 1), 0)::BIGINT AS case_tf,
        count(*) FILTER (label = 0) AS ctrl_df, coalesce(sum(tf) FILTER (label = 0), 0)::BIGINT AS ctrl_tf
        FROM scoped GROUP BY scope, token""",
    "training_patients": f"WITH {COUNTS} SELECT 'all' AS scope, cases, controls FROM people",
    "odds_ratio": f"WITH {COUNTS} SELECT token, round(ratio, 6) AS odds_ratio FROM kept",
    "vocabulary": f"WITH {vocab('2.0, 3.5')} SELECT odds, term_id, token, cf FROM vocab",
    "vocabulary_limits": f"WITH {vocab('2.0, 3.5', TIGHT_VOCABULARY)} SELECT odds, term_id, token, cf FROM vocab",
    "bow": f"WITH {BOW} SELECT pid, term_id, tf FROM bow",
    "bow_nested": f"WITH {BOW} SELECT pid, string_agg(term_id || ':' || tf, ' ' ORDER BY term_id) AS bow FROM bow GROUP BY pid",
    "tfidf": f"WITH {TFIDF} SELECT pid, term_id, round(w, 6) AS w FROM tfidf WHERE abs(w) > 1e-12",
    "lsi_project": f"WITH {PROJECT} SELECT pid, topic, round(v, 6) AS v FROM vecs",
    "vector_gaps": f"""WITH {PROJECT}, has AS (SELECT pid, min(abs(v)) AS low FROM vecs GROUP BY pid)
        SELECT (SELECT count(*) FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT pid FROM has)) AS no_vector,
        (SELECT count(*) FROM has WHERE low <= 1e-12) AS fewer_topics""",
    "densify": f"""WITH k AS (SELECT conv_id::VARCHAR AS pid, turn AS topic, sum(length(text))::DOUBLE AS v FROM conversations GROUP BY ALL)
        SELECT p.pid, t.topic::INTEGER AS topic, coalesce(round(k.v, 6), 0.0) AS v FROM (SELECT DISTINCT pid FROM k) p, range({VECTOR_SIZE}) t(topic)
        LEFT JOIN k ON k.pid = p.pid AND k.topic = t.topic""",
    "note_dates": """SELECT pid, string_agg(d, ',' ORDER BY d) AS dates FROM
        (SELECT DISTINCT o_custkey::VARCHAR AS pid, o_orderdate::DATE::VARCHAR AS d FROM orders) GROUP BY pid""",
    "date_text": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderdate::DATE::VARCHAR END AS iso FROM orders""",
    "bad_dates": """SELECT count(*) AS num_rows, count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P') AS no_date,
        count(*) FILTER (o_orderstatus = 'P') AS bad_dates FROM orders""",
    "lsi_checks": f"""WITH {vocab('3.5')} SELECT t::INTEGER AS topic, 1 AS norm_ok, 1 AS orthonormal
        FROM range(least({TOPICS}, (SELECT count(*) FROM vocab))) r(t)""",
    "lsi_scopes": """SELECT f || g AS scope, t::INTEGER AS topic, 1 AS norm_ok, 1 AS orthonormal
        FROM (SELECT unnest(['', 'far_']) AS f), (SELECT unnest(['everyone', 'english', 'other', 'long']) AS g), range(5) r(t)""",
    "learner_tests": f"""WITH t AS (SELECT label FROM embeddings WHERE {bucket('vec_id::VARCHAR')} >= 8000)
        SELECT m.model, {VECTOR_SIZE} AS num_columns, (SELECT count(*) FROM t WHERE label = 0) AS cases, (SELECT count(*) FROM t WHERE label <> 0) AS controls
        FROM (SELECT unnest(['logistic10', 'svm10']) AS model) m""",
    "history_flags": f"""WITH {FLAGS_CTE} SELECT pid, first_day::VARCHAR AS first_day, last_day::VARCHAR AS last_day, num_dates, span_days,
        {', '.join(f'{f}::INTEGER AS {f}' for f in FLAGS)} FROM flags""",
    "flag_overlap": f"WITH {FLAGS_CTE} {overlap_cells()}",
    "history_cohort": f"WITH {FLAGS_CTE} {SEEN}",
    "code_cohorts": f"WITH {rule_cohorts(CODE_RULES)} SELECT * FROM cohorts",
    "prefix_cohorts": f"""WITH dx AS (SELECT DISTINCT pid, icd10 FROM ({DIAGNOSES})),
        nine AS (SELECT DISTINCT pid, icd9 FROM ({DIAGNOSES})),
        rules AS (SELECT DISTINCT p_type AS cohort, regexp_replace(p_brand, '[^0-9a-zA-Z]+', '', 'g') AS prefix FROM part),
        rules9 AS (SELECT DISTINCT p_brand AS cohort,
            regexp_replace(split_part(p_type, ' ', 1) || ' ' || split_part(p_type, ' ', 2), '[^0-9a-zA-Z]+', '', 'g') AS prefix FROM part)
        SELECT cohort, pid FROM dx JOIN rules ON starts_with(icd10, prefix) UNION
        SELECT cohort, pid FROM nine JOIN rules9 ON starts_with(icd9, prefix)""",
    "cohort_algebra": f"""WITH {FLAGS_CTE}, seen AS ({SEEN}), {rule_cohorts(CODE_RULES)},
        one AS (SELECT pid FROM cohorts WHERE cohort = 'one'), mixed AS (SELECT pid FROM cohorts WHERE cohort = 'mixed')
        SELECT 'union' AS kind, pid FROM (SELECT pid FROM one UNION SELECT pid FROM mixed) UNION ALL
        SELECT 'intersection', pid FROM (SELECT pid FROM one INTERSECT SELECT pid FROM mixed INTERSECT SELECT pid FROM seen) UNION ALL
        SELECT 'difference', pid FROM (SELECT pid FROM mixed EXCEPT SELECT pid FROM one)""",
    "scope_grid": scope_sql(),
    "restricted_notes": """SELECT conv_id::VARCHAR AS pid, turn, role FROM conversations
        WHERE conv_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    "case_labels": f"""WITH {FLAGS_CTE}, seen AS ({SEEN}) SELECT c_custkey::VARCHAR AS pid,
        (c_custkey::VARCHAR IN (SELECT pid FROM seen))::INTEGER AS label FROM customer""",
    "code_describe": """WITH known AS (SELECT regexp_replace(upper(p_brand), '[^0-9A-Z]+', '', 'g') AS code, max(p_name) AS description FROM part GROUP BY 1)
        SELECT p_partkey, replace(lower(p_brand), '#', '.') AS code, coalesce(k.description, '') AS description FROM part
        LEFT JOIN known k ON k.code = upper(replace(p_brand, '#', '')) AND k.code <> 'BRAND25'""",
    "code_prefix": """SELECT p_brand || '-' || p_partkey AS code FROM part
        WHERE starts_with(lower(p_brand || '-' || p_partkey), 'brand#1') OR starts_with(lower(p_brand || '-' || p_partkey), 'brand#25')""",
    "code_search": "SELECT p_brand || '-' || p_partkey AS code FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_name), 'blue')",
    "one_hot": f"""WITH {PEOPLE} SELECT pid, age AS "AGE",
        {', '.join(f'''(seg = '{s}')::INTEGER AS "SEGMENT_{s.lower()}"''' for s in SEGMENTS)},
        {', '.join(f'''(reg = '{r}')::INTEGER AS "REGION_{r.lower().replace(' ', '_')}"''' for r in REGIONS)} FROM people""",
    "one_hot_last_row": f"""WITH o AS (SELECT o_custkey::VARCHAR AS pid, arg_max(day(o_orderdate), o_orderkey)::INTEGER AS age,
        arg_max(o_orderstatus, o_orderkey) AS s, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1)
        SELECT pid, age AS "AGE", {', '.join(f"""(s = '{x}')::INTEGER AS "STATUS_{x.lower()}\"""" for x in 'FOP')},
        {', '.join(f"""(p = '{x}')::INTEGER AS "PRIORITY_{x.lower().replace(" ", "_")}\"""" for x in PRIORITIES)} FROM o""",
    "one_hot_long": f"""WITH {PEOPLE} SELECT pid, 'SEGMENT_' || {SLUG.format('seg')} AS column_name FROM people UNION ALL
        SELECT pid, 'REGION_' || {SLUG.format('reg')} FROM people""",
    "categories": f"""WITH {PEOPLE} SELECT DISTINCT 'SEGMENT' AS "column", {SLUG.format('seg')} AS category FROM people UNION
        SELECT DISTINCT 'REGION', {SLUG.format('reg')} FROM people""",
    "table_overlap": f"WITH {FEATURES} SELECT docs.pid FROM docs JOIN notes USING (pid) JOIN vecs USING (pid)",
    "assemble": f"""WITH {FEATURES}, m AS (SELECT d.pid, list_concat(list_concat(d.v, n.v), e.v) AS f, n.v AS nv
        FROM docs d JOIN notes n USING (pid) JOIN vecs e USING (pid))
        SELECT 'all' AS tables, pid, (generate_subscripts(f, 1) - 1)::INTEGER AS position, round(unnest(f), 6) AS value FROM m UNION ALL
        SELECT 'notes', pid, (generate_subscripts(nv, 1) - 1)::INTEGER, round(unnest(nv), 6) FROM m""",
    "confusion": f"""{CONF} SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn,
        round({_ratio('tp', 'tp + fn')}, 6) AS sensitivity, round({_ratio('tn', 'tn + fp')}, 6) AS specificity FROM c""",
    "report": report_sql(),
    "error_lists": f"""WITH {PRED}, k AS (SELECT pid, CASE WHEN is_test AND label = 1 AND prediction = 1 THEN 'true_positives'
        WHEN is_test AND label = 0 AND prediction = 1 THEN 'false_positives'
        WHEN is_test AND label = 1 AND prediction = 0 THEN 'false_negatives'
        WHEN NOT is_test AND label = 0 AND prediction = 1 THEN 'false_positives_train' END AS kind FROM pred)
        SELECT kind, pid FROM k WHERE kind IS NOT NULL""",
    "fp_overlap": f"""WITH {LISTS}, names AS (SELECT DISTINCT list FROM lists UNION SELECT 'none'),
        sizes AS (SELECT list, count(*) AS n FROM lists GROUP BY list),
        pairs AS (SELECT a.list, b.list AS other, count(*) AS n FROM lists a JOIN lists b ON a.pid = b.pid GROUP BY ALL)
        SELECT x.list, y.list AS other, round(CASE WHEN s.n > 0 THEN coalesce(b.n, 0)::DOUBLE / s.n * 100 END, 6) AS overlap_pct
        FROM names x CROSS JOIN names y LEFT JOIN sizes s ON s.list = x.list LEFT JOIN pairs b ON b.list = x.list AND b.other = y.list""",
    "run_manifest": f"""WITH {PRED} SELECT 'run' AS run, count(*) FILTER (NOT is_test) AS train_patients, count(*) FILTER (is_test) AS test_patients,
        'boosted' AS models, 400.0::DOUBLE AS case_weight FROM pred""",
    "patient_lists": f"""WITH {PRED} SELECT 'run' AS run, CASE WHEN is_test THEN 'test' ELSE 'train' END AS kind, pid FROM pred""",
    "review_export": f"""WITH chosen AS (SELECT DISTINCT doc_id::VARCHAR AS pid FROM labels WHERE toxic = 1),
        d AS (SELECT doc_id::VARCHAR AS pid, 0 AS table_no, 'documents' AS "table", 0 AS part, text FROM documents UNION ALL
              SELECT pid, 1, 'notes', part, text FROM ({NOTES}))
        SELECT d.* FROM d JOIN chosen USING (pid)""",
}
# The same questions answered another way.
ORACLE["cohort_bitmaps"] = ORACLE["cohort_algebra"]
ORACLE["flag_bitmaps"] = ORACLE["flag_overlap"]

ORACLE |= {
    "topic_term_facts": f"""WITH {vocab('3.5')}, n AS (SELECT least(100, count(*)) AS n, least({TOPICS}, count(*)) AS k FROM vocab)
        SELECT t::INTEGER AS topic, n AS n_terms, n::INTEGER AS last_rank, n AS n_ranks, 1 AS falling, n AS n_known FROM n, range(k) r(t)""",
    "vector_facts": f"""WITH {vocab('3.5')} SELECT least({TOPICS}, count(*)) AS n_topics, least({TOPICS}, count(*)) AS n_sums_ok, 1 AS within FROM vocab""",
    "learner_facts": f"""WITH t AS (SELECT label FROM embeddings WHERE {bucket('vec_id::VARCHAR')} >= 8000)
        SELECT m.model, (SELECT count(*) FROM t WHERE label = 0) AS cases, (SELECT count(*) FROM t WHERE label <> 0) AS controls, 1 AS lists_ok
        FROM (SELECT unnest(['boosted10', 'logistic10', 'forest10', 'lasso10']) AS model) m""",
    "grid_facts": f"""WITH e AS (SELECT vec_id, label, {bucket('vec_id::VARCHAR')} >= 8000 AS test FROM embeddings),
        t AS (SELECT unnest(['lsi_all', 'lsi_low', 'lsi_high']) AS tables), m AS (SELECT unnest(['logistic10', 'forest10']) AS model), b AS (SELECT * FROM e WHERE label <> 1)
        SELECT 'result ' || model || ' ' || tables AS what, CASE tables WHEN 'lsi_all' THEN {VECTOR_SIZE} ELSE {VECTOR_SIZE // 2} END::BIGINT AS a,
          (SELECT count(*) FROM b WHERE test AND label = 0) AS b, (SELECT count(*) FROM b WHERE test AND label <> 0) AS c FROM t, m
        UNION ALL SELECT 'manifest logistic', count(*) FILTER (NOT test), count(*) FILTER (test), 10 FROM b
        UNION ALL SELECT 'list ' || CASE WHEN test THEN 'test' ELSE 'train' END, count(*), count(*), 0 FROM b GROUP BY test""",
}
ORACLE["cohort_lookup"] = """WITH c AS (SELECT DISTINCT 'many' AS cohort, doc_id FROM labels UNION ALL SELECT DISTINCT 'few', doc_id FROM labels WHERE doc_id % 40 = 3)
    SELECT cohort, doc_id::VARCHAR AS pid, lang, coalesce(length(text), 0) AS n_chars FROM c JOIN documents USING (doc_id)"""
ORACLE["header_ingest"] = "SELECT conv_id::VARCHAR AS pid, turn::VARCHAR AS turn, coalesce(text, '') AS text FROM conversations"
