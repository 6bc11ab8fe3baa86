"""The registered queries in plain SQL, for checking results on another engine."""

from __future__ import annotations

from cohortlane.studies import EVENT_TYPES, RETURN_FLAGS

ORDER_FLAGS = tuple(f"ret_{f}" for f in RETURN_FLAGS)
MISSING = "(NULLIF({0}, '') IS NULL OR lower({0}) IN ('none', 'unknown', 'missing', 'na'))"


def none_label(column: str) -> str:
    return f"CASE WHEN {MISSING.format(column)} THEN 'None' ELSE {column} END"


def number_text(column: str) -> str:
    return (
        f"CASE WHEN {column} IS NULL THEN 'NA' WHEN {column} = floor({column}) THEN CAST(CAST({column} AS BIGINT) AS VARCHAR) "
        f"ELSE printf('%.15g', {column}) END"
    )


def cells(study: str, keep: str, modalities, test: str = "{m} = 'Yes'", text: str = "{m}") -> str:
    return " UNION ALL ".join(
        f"SELECT {keep}, '{m}' AS modality, {text.format(m=m)} AS available FROM {study} WHERE {test.format(m=m)}" for m in modalities
    )


# Study tables

ORDERS = """
has AS (
  SELECT l_orderkey, bool_or(l_returnflag = 'A') AS has_a, bool_or(l_returnflag = 'N') AS has_n, bool_or(l_returnflag = 'R') AS has_r
  FROM lineitem GROUP BY l_orderkey
),
flagged AS (
  SELECT o.*, coalesce(has_a, false) AS has_a, coalesce(has_n, false) AS has_n, coalesce(has_r, false) AS has_r
  FROM orders o LEFT JOIN has ON o_orderkey = l_orderkey
),
study AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, CAST(o_custkey AS VARCHAR) AS subject, CAST(o_orderdate AS VARCHAR) AS time_raw, f.*,
    (epoch_us(o_orderdate) - min(epoch_us(o_orderdate)) OVER (PARTITION BY o_custkey)) / 86400000000.0 AS time,
    CASE WHEN has_a THEN 'Yes' ELSE 'No' END AS "ret_A",
    CASE WHEN has_n THEN 'Yes' ELSE 'No' END AS "ret_N",
    CASE WHEN has_r THEN 'Yes' ELSE 'No' END AS "ret_R",
    CASE WHEN o_custkey % 17 <> 0 THEN c_mktsegment END AS segment,
    c_mktsegment, c_acctbal, n_name
  FROM flagged f LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
)"""
ORDER_CELLS = ORDERS + f""",
cells AS ({cells("study", "sample_id, o_orderkey, subject, time_raw, time, segment, o_orderpriority", ORDER_FLAGS)})"""

NULL_SUBJECTS = """
has AS (
  SELECT l_orderkey, bool_or(l_returnflag = 'A') AS has_a, bool_or(l_returnflag = 'N') AS has_n, bool_or(l_returnflag = 'R') AS has_r
  FROM lineitem GROUP BY l_orderkey
),
known AS (
  SELECT o.*, CASE WHEN o_custkey % 13 <> 0 THEN o_custkey END AS who, c_mktsegment, coalesce(has_a, false) AS has_a,
    coalesce(has_n, false) AS has_n, coalesce(has_r, false) AS has_r
  FROM orders o LEFT JOIN has ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey
),
study AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, CAST(who AS VARCHAR) AS subject, c_mktsegment,
    (epoch_us(o_orderdate) - min(epoch_us(o_orderdate)) OVER (PARTITION BY who)) / 86400000000.0 AS time,
    CASE WHEN has_a THEN 'Yes' ELSE 'No' END AS "ret_A", CASE WHEN has_n THEN 'Yes' ELSE 'No' END AS "ret_N",
    CASE WHEN has_r THEN 'Yes' ELSE 'No' END AS "ret_R"
  FROM known
),
cells AS (""" + cells("study", "sample_id, subject, time, c_mktsegment", ORDER_FLAGS) + ")"

EVENTS = """
daily AS (
  SELECT user_id, CAST(date_diff('day', first_day, CAST(ts AS DATE)) AS INTEGER) AS day, """ + ", ".join(
    f"bool_or(event_type = '{e}') AS \"{e}\"" for e in EVENT_TYPES
) + """
  FROM events, (SELECT CAST(min(ts) AS DATE) AS first_day FROM events) GROUP BY user_id, date_diff('day', first_day, CAST(ts AS DATE))
),
study AS (
  SELECT user_id || '-' || day AS sample_id, CAST(user_id AS VARCHAR) AS subject, CAST(day AS DOUBLE) AS time, * FROM daily
)"""
EVENT_CELLS = EVENTS + f""",
cells AS ({cells("study", "sample_id, subject, time", EVENT_TYPES, '"{m}"', "'TRUE'")})"""

LABELS = """
study AS (
  SELECT CAST(l.doc_id AS VARCHAR) AS sample_id, source AS subject, CAST(n_chars AS DOUBLE) AS time, lang, quality, toxic
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)"""
LABEL_CELLS = LABELS + f""",
cells AS ({cells("study", "sample_id, subject, time, lang", ("quality", "toxic"), "{m} = 1", "'1'")})"""

WORDS = "['Yes', 'YES', 'yes', 'True', ' Yes', '1', 'TRUE', 'true']"
MIXED = ORDERS + f""",
mixed AS (
  SELECT sample_id, subject, o_orderkey, o_orderpriority, has_a AS as_boolean, CAST(has_n AS INTEGER) AS as_int,
    CAST(CAST(has_r AS INTEGER) AS DOUBLE) AS as_double,
    CASE WHEN has_a THEN ({WORDS})[CAST(o_orderkey % 8 AS INTEGER) + 1] WHEN has_n THEN 'No' END AS as_words
  FROM study
)"""


def mixed_cells(words: str) -> str:
    keep = "sample_id, subject, o_orderpriority"
    return MIXED + f""",
cells AS (
  SELECT {keep}, 'as_boolean' AS modality, 'TRUE' AS available FROM mixed WHERE as_boolean
  UNION ALL SELECT {keep}, 'as_int', '1' FROM mixed WHERE as_int = 1
  UNION ALL SELECT {keep}, 'as_double', '1' FROM mixed WHERE as_double = 1
  UNION ALL SELECT {keep}, 'as_words', as_words FROM mixed WHERE {words}
)"""


ANY_CASE = "lower(as_words) IN ('yes', '1', 'true')"
EXACT = "as_words IN ('1', 'TRUE', 'Yes', 'yes')"
MIXED_NAMES = ("as_boolean", "as_int", "as_double", "as_words")

RANGES = "SELECT subject, modality, {0} AS min_pts, {1} AS max_pts FROM cells GROUP BY subject, modality"
RANGES_ROUNDED = RANGES.format("round(min(time), 6)", "round(max(time), 6)")
RANGES_PLAIN = RANGES.format("min(time)", "max(time)")
COUNTS = "counts AS (SELECT modality, subject, count(*) AS n_samples FROM cells GROUP BY modality, subject)"
STATS = COUNTS + """,
edges AS (SELECT modality, min(n_samples) AS lo, max(n_samples) AS hi FROM counts GROUP BY modality),
stats AS (
  SELECT c.modality, lo AS min_samples, hi AS max_samples, count(*) FILTER (WHERE n_samples = lo) AS n_min,
    count(*) FILTER (WHERE n_samples = hi) AS n_max, count(*) AS total_subjects
  FROM counts c JOIN edges e ON c.modality = e.modality GROUP BY c.modality, lo, hi
)"""


def told(samples: str, subjects: str) -> str:
    return f"{samples} || ' (' || {subjects} || ' | ' || printf('%.1f%%', round_even({subjects} / total_subjects * 1000, 0) / 10) || ')'"


STATS_TEXT = f"""SELECT modality AS "Omics_Name", {told("min_samples", "n_min")} AS "Min_Samples_Per_Individual",
  {told("max_samples", "n_max")} AS "Max_Samples_Per_Individual" FROM stats"""
BY_POINTS = """SELECT subject, count(*) AS n_points, row_number() OVER (ORDER BY count(*) DESC, subject) AS subject_rank
FROM cells GROUP BY subject"""

# Times

TEXT_TIMES = """
visits AS (
  SELECT o_orderkey, o_custkey, CASE o_orderkey % 7
    WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y %H:%M') WHEN 1 THEN strftime(o_orderdate, '%-m/%-d/%Y %-H:%M:%S')
    WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%m/%d/%Y')
    WHEN 4 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 5 THEN strftime(o_orderdate, '%-m.%-d.%y') ELSE 'unknown' END AS visit
  FROM orders
),
parsed AS (
  SELECT *, coalesce(try_strptime(visit, '%m/%d/%Y %H:%M'), try_strptime(visit, '%m/%d/%Y %H:%M:%S'), try_strptime(visit, '%Y-%m-%d'),
    try_strptime(visit, '%m/%d/%Y'), try_strptime(visit, '%m.%d.%y'), try_strptime(visit, '%d/%m/%Y')) AS moment
  FROM visits
)"""
NUMBER_TIMES = EVENTS + """,
visits AS (SELECT sample_id, subject, CASE WHEN day % 10 = 3 THEN 'day-' || day ELSE CAST(day AS VARCHAR) END AS visit FROM study)"""

# Groups


def sums(counts: str, modalities) -> str:
    return ", ".join(f"CAST(sum(\"{m}\") AS INTEGER) AS \"{m}\"" for m in modalities)


TOTAL = '"Total_Subjects_with_Omics"'


def live(group: str, modalities) -> str:
    """The table as described: join every cell with the groups of its subject and time."""
    counts = ", ".join(
        f"CAST(count(DISTINCT subject) FILTER (WHERE modality = '{m}') AS INTEGER) AS \"{m}\"" for m in modalities
    )
    return f""",
groups AS (SELECT DISTINCT subject, time, {group} AS grp FROM cells),
joined AS (
  SELECT c.subject, c.modality, g.grp FROM cells c LEFT JOIN groups g
  ON c.subject = g.subject AND c.time IS NOT DISTINCT FROM g.time
),
counts AS (
  SELECT CAST(grp AS VARCHAR) AS "Group", {counts}, CAST(count(DISTINCT subject) AS INTEGER) AS {TOTAL} FROM joined GROUP BY grp
)
SELECT * FROM counts
UNION ALL SELECT 'Total', {sums("counts", modalities)}, CAST(sum({TOTAL}) AS INTEGER) FROM counts"""


def live_distinct(group: str, modalities) -> str:
    """The table where an unknown subject is a subject: it counts once beside the others."""
    counts = ", ".join(
        f"CAST(count(DISTINCT subject) FILTER (WHERE modality = '{m}') + max(CAST(subject IS NULL AND modality = '{m}' AS INTEGER)) AS INTEGER) AS \"{m}\""
        for m in modalities
    )
    return f""",
groups AS (SELECT DISTINCT subject, time, {group} AS grp FROM cells),
joined AS (
  SELECT c.subject, c.modality, g.grp FROM cells c LEFT JOIN groups g
  ON c.subject IS NOT DISTINCT FROM g.subject AND c.time IS NOT DISTINCT FROM g.time
),
counts AS (
  SELECT CAST(grp AS VARCHAR) AS "Group", {counts}, CAST(count(DISTINCT subject) + max(CAST(subject IS NULL AS INTEGER)) AS INTEGER) AS {TOTAL}
  FROM joined GROUP BY grp
)
SELECT * FROM counts
UNION ALL SELECT 'Total', {sums("counts", modalities)}, CAST(sum({TOTAL}) AS INTEGER) FROM counts"""


def variant(study: str, group: str, tests: dict[str, str], total: bool = True) -> str:
    counts = ", ".join(f"CAST(count(DISTINCT subject) FILTER (WHERE {t}) AS INTEGER) AS \"{m}\"" for m, t in tests.items())
    shown = " OR ".join(f'"{m}" > 0' for m in tests)
    last = f"""
UNION ALL SELECT 'Total', {sums("counts", tests)}, (SELECT CAST(count(DISTINCT subject) AS INTEGER) FROM {study}) FROM counts"""
    return f""",
counts AS (
  SELECT * FROM (
    SELECT coalesce({group}, 'Missing') AS "Group", {counts}, CAST(count(DISTINCT subject) AS INTEGER) AS {TOTAL}
    FROM {study} GROUP BY 1
  ) WHERE {shown}
)
SELECT * FROM counts""" + (last if total else "")


ORDER_TESTS = {m: f"\"{m}\" = 'Yes'" for m in ORDER_FLAGS}
MIXED_TESTS = dict(zip(MIXED_NAMES, ("as_boolean", "as_int = 1", "as_double = 1", EXACT)))


def eligible(columns) -> str:
    parts = " UNION ALL ".join(
        f"""SELECT {i} AS position, '{name}' AS covariate FROM study
        HAVING count(DISTINCT {c}) >= 2
          AND (SELECT max(n) FROM (SELECT count(DISTINCT {c}) AS n FROM study GROUP BY subject)) <= 1"""
        for i, (name, c) in enumerate(columns.items(), 1)
    )
    return f"SELECT 0 AS position, 'None' AS covariate UNION ALL {parts}"


def firsts(column: str) -> str:
    """First non-null value per subject by time and sample, for every subject."""
    return f"""(
  SELECT s.subject, v.value FROM (SELECT DISTINCT subject FROM study) s LEFT JOIN (
    SELECT subject, value FROM (
      SELECT subject, {column} AS value, row_number() OVER (PARTITION BY subject ORDER BY time NULLS FIRST, o_orderkey) AS rn
      FROM study WHERE {column} IS NOT NULL
    ) WHERE rn = 1
  ) v ON s.subject = v.subject
)"""


def pairs(primary: str, secondary: str | None = None) -> str:
    second = f", {none_label('f.value')} AS secondary" if secondary else ""
    join = f" JOIN {firsts(secondary)} f ON p.subject = f.subject" if secondary else ""
    return f"""
pairs AS (
  SELECT p.subject, p.label AS "primary"{second}
  FROM (SELECT DISTINCT subject, {none_label(primary)} AS label FROM study) p{join}
)"""


def ordered(with_secondary: bool) -> str:
    local = (
        """, local AS (SELECT "primary", secondary, count(*) AS n_local FROM pairs GROUP BY ALL)""" if with_secondary else ""
    )
    join = ' JOIN local l ON p."primary" = l."primary" AND p.secondary = l.secondary' if with_secondary else ""
    second = ", n_local, p.secondary" if with_secondary else ", 0 AS n_local, '' AS secondary"
    return f""",
sizes AS (SELECT "primary", count(*) AS n_primary FROM pairs GROUP BY 1){local},
placed AS (
  SELECT p.subject, p."primary", n_primary{second} FROM pairs p JOIN sizes s ON p."primary" = s."primary"{join}
),
best AS (
  SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n_primary DESC, "primary", n_local DESC, secondary) AS rn FROM placed
),
ranked AS (
  SELECT subject, "primary", secondary,
    row_number() OVER (ORDER BY n_primary DESC, "primary", n_local DESC, secondary, subject) AS subject_rank
  FROM best WHERE rn = 1
)"""


# Bins


def cuts(table: str, column: str) -> str:
    return f"""
spread AS (SELECT unnest(quantile_cont({column}, [0, 0.25, 0.5, 0.75, 1])) AS cut FROM {table}),
cuts AS (SELECT cut, row_number() OVER (ORDER BY cut) AS cut_no, count(*) OVER () AS n FROM (SELECT DISTINCT cut FROM spread))"""


BINS = """,
bins AS (
  SELECT a.cut AS lo, b.cut AS hi, CAST(a.cut_no AS INTEGER) AS bin, b.cut_no = b.n AS last,
    '[' || printf('%.4g', a.cut) || ',' || printf('%.4g', b.cut) || CASE WHEN b.cut_no = b.n THEN ']' ELSE ')' END AS label
  FROM cuts a JOIN cuts b ON b.cut_no = a.cut_no + 1
)"""
IN_BIN = "{0} >= lo AND ({0} < hi OR (last AND {0} = hi))"


def levels(covariate: str, table: str, text: str) -> str:
    return f"""
SELECT level, row_number() OVER (ORDER BY level) AS level_index,
  CASE WHEN (SELECT bool_and(regexp_matches(level, '^-?[0-9,.]+$')) AND count(*) > 15 FROM (SELECT DISTINCT {text} AS level FROM {table}))
    THEN 'continuous' WHEN count(*) OVER () <= 12 THEN 'qualitative' ELSE 'sequential' END AS scale_kind, '{covariate}' AS covariate
FROM (SELECT DISTINCT {text} AS level FROM {table})"""


# Charts

TIMELINE = ORDER_CELLS + "," + cuts("study", "c_acctbal") + BINS + f""",
colors AS (SELECT subject, value AS color_group FROM {firsts("segment")}),
balance AS (SELECT subject, value FROM {firsts("c_acctbal")}),
points_of AS (
  SELECT subject, coalesce((SELECT label FROM bins WHERE {IN_BIN.format("value")}), 'None') AS point_group FROM balance
),
pairs AS (
  SELECT p.subject, p.label AS "primary", g.point_group AS secondary
  FROM (SELECT DISTINCT subject, {none_label("segment")} AS label FROM study) p JOIN points_of g ON p.subject = g.subject
)""" + ordered(True) + """,
dims AS (
  SELECT r.subject, color_group, point_group, subject_rank
  FROM ranked r JOIN colors c ON r.subject = c.subject JOIN points_of p ON r.subject = p.subject
),
strip AS (
  SELECT modality, min(time) AS low, max(time) - min(time) AS span FROM cells
  WHERE modality = (SELECT min(modality) FROM cells) GROUP BY modality
),
place AS (
  SELECT modality, low - greatest(1, span * 0.05) AS strip_x, greatest(0.35, span * 0.05) AS strip_width FROM strip
)"""
TIMELINE_POINTS = f"""SELECT sample_id, c.subject, round(time, 6) AS time, color_group, point_group, subject_rank, modality, available,
  c.subject || ' <br> o_orderdate : ' || {number_text("time")} || ' <br> Omics Type: ' || modality || ' <br> segment : '
    || coalesce(color_group, 'NA') AS tooltip
FROM cells c JOIN dims d ON c.subject = d.subject"""
EVENT_RANKS = EVENT_CELLS + f""",
ranks AS ({BY_POINTS})"""
LANES = """,
appeared AS (
  SELECT modality, min(sample_id) AS first_sample, list_position(['click', 'error', 'purchase', 'signup', 'view'], modality) AS place
  FROM cells GROUP BY modality
),
lanes AS (
  SELECT modality, CAST(lane AS INTEGER) AS lane, CASE WHEN n > 1 THEN -0.3 + (lane - 1) * 0.6 / (n - 1) ELSE -0.3 END AS lane_offset
  FROM (SELECT modality, row_number() OVER (ORDER BY first_sample, place) AS lane, count(*) OVER () AS n FROM appeared)
)"""


def occurrences(text: str, mark: str) -> str:
    return f"length({text}) - length(replace({text}, {mark}, ''))"


MARKS = {",": "','", "tab": "chr(9)", ";": "';'", " ": "' '"}
COUNTED = ", ".join(f"{occurrences('line', mark)} AS n{i}" for i, mark in enumerate(MARKS.values()))

ORACLE: dict[str, str] = {
    "long_availability": f"WITH {ORDER_CELLS} SELECT sample_id, subject, time_raw, round(time, 6) AS time, modality, available FROM cells",
    "availability_mixed_flags": f"WITH {mixed_cells(ANY_CASE)} SELECT sample_id, subject, modality, available FROM cells",
    "availability_case_sensitive": f"WITH {mixed_cells(EXACT)} SELECT sample_id, subject, modality, available FROM cells",
    "availability_wide": f"WITH {mixed_cells(ANY_CASE)} SELECT subject, o_orderpriority AS \"group\", " + ", ".join(
        f"coalesce(array_to_string(list_sort(list(DISTINCT available) FILTER (WHERE modality = '{m}')), '|'), '') AS {m}"
        for m in MIXED_NAMES
    ) + ", " + ", ".join(
        f"CAST(count(*) FILTER (WHERE modality = '{m}') > 0 AS INTEGER) AS has_{m}" for m in MIXED_NAMES
    ) + " FROM cells GROUP BY subject, o_orderpriority",
    "modality_ranges_orders": f"WITH {ORDER_CELLS} {RANGES_ROUNDED}",
    "modality_ranges_events": f"WITH {EVENT_CELLS} {RANGES_PLAIN}",
    "samples_per_subject_orders": f"WITH {ORDER_CELLS}, {COUNTS} SELECT * FROM counts",
    "samples_per_subject_events": f"WITH {EVENT_CELLS}, {COUNTS} SELECT * FROM counts",
    "subject_totals_orders": f"WITH {ORDER_CELLS}, {COUNTS} SELECT *, count(*) OVER (PARTITION BY modality) AS total_subjects FROM counts",
    "timepoint_stats_orders": f"WITH {ORDER_CELLS}, {STATS} SELECT * FROM stats",
    "timepoint_stats_events": f"WITH {EVENT_CELLS}, {STATS} SELECT * FROM stats",
    "timepoint_stats_labels": f"WITH {LABEL_CELLS}, {STATS} SELECT * FROM stats",
    "timepoint_stats_text_orders": f"WITH {ORDER_CELLS}, {STATS} {STATS_TEXT}",
    "timepoint_stats_text_events": f"WITH {EVENT_CELLS}, {STATS} {STATS_TEXT}",
    "cohort_sizes": f"""WITH {ORDER_CELLS}
SELECT (SELECT count(DISTINCT subject) FROM cells) AS subjects_with_data, (SELECT count(DISTINCT subject) FROM study) AS subjects""",
    "subject_rank_by_points_orders": f"WITH {ORDER_CELLS} {BY_POINTS}",
    "subject_rank_by_points_events": f"WITH {EVENT_CELLS} {BY_POINTS}",
    "days_since_start_typed": f"WITH {ORDERS} SELECT sample_id, subject, time_raw, round(time, 6) AS time FROM study",
    "days_since_start_null_subjects": """WITH study AS (
  SELECT o_orderkey, o_orderdate, CASE WHEN o_custkey % 13 <> 0 THEN o_custkey END AS subject FROM orders
)
SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, CAST(subject AS VARCHAR) AS subject, CAST(o_orderdate AS VARCHAR) AS time_raw,
  round((epoch_us(o_orderdate) - min(epoch_us(o_orderdate)) OVER (PARTITION BY subject)) / 86400000000.0, 6) AS time FROM study""",
    "days_since_start_text": f"""WITH {TEXT_TIMES}
SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, CAST(o_custkey AS VARCHAR) AS subject, visit AS time_raw,
  round((epoch_us(moment) - min(epoch_us(moment)) OVER (PARTITION BY o_custkey)) / 86400000000.0, 6) AS time FROM parsed""",
    "days_since_start_trained": """WITH visits AS (
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN 'not seen' WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%Y')
    ELSE strftime(o_orderdate, '%-d.%-m.%y') END AS visit,
    CASE WHEN o_orderkey % 11 <> 0 THEN epoch_us(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) END AS moment
  FROM orders
)
SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, CAST(o_custkey AS VARCHAR) AS subject, visit AS time_raw,
  round((moment - min(moment) OVER (PARTITION BY o_custkey)) / 86400000000.0, 6) AS time FROM visits""",
    "days_since_start_numeric": f"WITH {NUMBER_TIMES} SELECT sample_id, subject, visit AS time_raw, TRY_CAST(visit AS DOUBLE) AS time FROM visits",
    "time_kind_facts": f"""WITH {TEXT_TIMES}, numbers AS (WITH {NUMBER_TIMES} SELECT * FROM visits), shares AS (
  SELECT 'text' AS column_name, bool_and(TRY_CAST(visit AS DOUBLE) IS NOT NULL) AS all_numeric, avg(CAST(moment IS NOT NULL AS INTEGER)) AS ratio FROM parsed
  UNION ALL SELECT 'words', bool_and(TRY_CAST(visit AS DOUBLE) IS NOT NULL), 0.0 FROM numbers
  UNION ALL SELECT 'number', true, 0.0 FROM (SELECT count(*) FROM numbers)
  UNION ALL SELECT 'typed', false, count(o_orderdate) / count(*) FROM orders
)
SELECT column_name, all_numeric, round(CAST(ratio AS DOUBLE), 6) AS parsed_ratio, CASE WHEN ratio > 0.5 THEN 'date' ELSE 'numeric' END AS time_kind FROM shares""",
    "contingency_live": f"WITH {ORDER_CELLS} {live('segment', ORDER_FLAGS)}",
    "contingency_live_changing_groups": f"WITH {ORDER_CELLS} {live('o_orderpriority', ORDER_FLAGS)}",
    "contingency_live_labels": f"WITH {LABEL_CELLS} {live('lang', ('quality', 'toxic'))}",
    "contingency_live_null_subjects": f"WITH {NULL_SUBJECTS} {live_distinct('c_mktsegment', ORDER_FLAGS)}",
    "timeline_points_null_subjects": f"""WITH {NULL_SUBJECTS}, ranks AS (
  SELECT subject, row_number() OVER (ORDER BY count(*) DESC, subject NULLS FIRST) AS subject_rank FROM cells GROUP BY subject
)
SELECT sample_id, c.subject, round(time, 6) AS time, 'None' AS color_group, 'None' AS point_group, subject_rank, modality, available,
  concat_ws(' ', c.subject, '<br> o_orderdate :', {number_text("time")}, '<br> Omics Type:', modality) AS tooltip
FROM cells c JOIN ranks r ON c.subject IS NOT DISTINCT FROM r.subject""",
    "cleaned_study": f"""WITH {ORDER_CELLS}, counted AS (WITH {live('segment', ORDER_FLAGS).lstrip().lstrip(',')})
SELECT "Group", "ret_A", "ret_N", "ret_R" AS "X2_ret", {TOTAL} FROM counted""",
    "samples_without_key": f'WITH {ORDERS} SELECT o_custkey, o_orderdate, o_orderstatus, o_orderpriority, "ret_A", "ret_N", "ret_R" FROM study',
    "contingency_variant": f"WITH {ORDERS} {variant('study', 'segment', ORDER_TESTS)}",
    "contingency_variant_mixed_flags": f"WITH {MIXED} {variant('mixed', 'o_orderpriority', MIXED_TESTS)}",
    "contingency_variant_joins": f"WITH {ORDERS} {variant('study', 'segment', ORDER_TESTS, total=False)}",
    "long_group_join": f"""WITH {ORDER_CELLS}, groups AS (SELECT DISTINCT subject, time, o_orderpriority FROM cells)
SELECT sample_id, c.subject, c.time_raw, round(c.time, 6) AS time, modality, available, g.o_orderpriority AS "Group"
FROM cells c LEFT JOIN groups g ON c.subject = g.subject AND c.time IS NOT DISTINCT FROM g.time""",
    "long_group_join_skewed": """WITH placed AS (
  SELECT o_orderkey AS sample_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS subject,
    CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE CAST(year(o_orderdate) AS INTEGER) END AS time, o_orderpriority || '/' || o_orderstatus AS grp
  FROM orders
), groups AS (SELECT DISTINCT subject, time, grp FROM placed)
SELECT p.sample_id, p.subject, p.time, g.grp AS "Group" FROM placed p LEFT JOIN groups g
  ON p.subject IS NOT DISTINCT FROM g.subject AND p.time IS NOT DISTINCT FROM g.time""",
    "group_collision": f"""WITH {ORDER_CELLS}, groups AS (SELECT DISTINCT subject, time, o_orderpriority FROM cells)
SELECT sample_id, c.subject, c.time_raw, round(c.time, 6) AS time, modality, available, g.o_orderpriority AS "Group"
FROM cells c LEFT JOIN groups g ON c.subject = g.subject AND c.time IS NOT DISTINCT FROM g.time""",
    "eligible_covariates": f"WITH {ORDERS} " + eligible(
        {c: c for c in ("o_orderpriority", "segment", "c_mktsegment", "n_name", "c_acctbal")} | {"unit": "'order'"}
    ),
    "subject_first_value": f"WITH {ORDERS} SELECT subject, value FROM {firsts('NULLIF(o_orderpriority, ' + chr(39) + '5-LOW' + chr(39) + ')')}",
    "group_sizes": f"WITH {ORDERS} SELECT {none_label('segment')} AS label, count(DISTINCT subject) AS n_subjects FROM study GROUP BY 1",
    "secondary_group_sizes": f"WITH {ORDERS} SELECT {none_label('value')} AS label, count(*) AS n_subjects FROM {firsts('n_name')} GROUP BY 1",
    "local_group_counts": f"""WITH {ORDERS}, {pairs('segment', 'n_name')}
SELECT "primary", secondary, count(*) AS n_subjects FROM pairs GROUP BY ALL""",
    "subject_order_primary": f'WITH {ORDERS}, {pairs("segment")} {ordered(False)} SELECT subject, "primary", subject_rank FROM ranked',
    "subject_order_primary_changing": f'WITH {ORDERS}, {pairs("o_orderstatus")} {ordered(False)} SELECT subject, "primary", subject_rank FROM ranked',
    "subject_order_primary_secondary": f"WITH {ORDERS}, {pairs('segment', 'n_name')} {ordered(True)} SELECT * FROM ranked",
    "subject_order_secondary": f"""WITH {ORDERS},
pairs AS (SELECT subject, {none_label('value')} AS "primary" FROM {firsts('n_name')}) {ordered(False)}
SELECT subject, "primary" AS secondary, subject_rank FROM ranked""",
    "subject_order_numeric_secondary": f'WITH {TIMELINE} SELECT subject, "primary", secondary, subject_rank FROM ranked',
    "subject_order_numeric_secondary_only": f"""WITH {ORDERS}, {cuts("study", "c_acctbal")} {BINS},
balance AS (SELECT subject, value FROM {firsts("c_acctbal")}),
pairs AS (
  SELECT subject, coalesce((SELECT label FROM bins WHERE {IN_BIN.format("value")}), 'None') AS "primary" FROM balance
) {ordered(False)}
SELECT subject, "primary" AS secondary, subject_rank FROM ranked""",
    "quartile_cuts": f"""WITH {cuts('customer', 'c_acctbal')}
SELECT CAST(cut_no AS INTEGER) AS cut_no, round(cut, 6) AS cut, (SELECT count(DISTINCT c_acctbal) FROM customer) AS n_distinct FROM cuts""",
    "quartile_cuts_with_ties": f"""WITH {cuts('lineitem', 'l_quantity')}
SELECT CAST(cut_no AS INTEGER) AS cut_no, round(cut, 6) AS cut, (SELECT count(DISTINCT l_quantity) FROM lineitem) AS n_distinct FROM cuts""",
    "quartile_cuts_merged": """SELECT CAST(cut_no AS INTEGER) AS cut_no, count(c_acctbal) AS n,
  CASE cut_no WHEN 1 THEN round(min(c_acctbal), 6) WHEN 5 THEN round(max(c_acctbal), 6) END AS "end", true AS within_error
FROM customer, range(1, 6) t(cut_no) GROUP BY cut_no""",
    "quartile_bins": f"""WITH {cuts('customer', 'c_acctbal')} {BINS}
SELECT c_custkey, c_acctbal, bin AS c_acctbal_bin, label AS c_acctbal_quartile
FROM customer LEFT JOIN bins ON {IN_BIN.format('c_acctbal')}""",
    "quartile_bins_few_values": """SELECT doc_id, quality, toxic, CAST(NULL AS INTEGER) AS quality_bin,
  CAST(quality AS VARCHAR) AS quality_quartile FROM labels""",
    "legacy_bin_labels": """WITH labelled AS (
  SELECT p_partkey, '[' || p_size || ',' || CASE WHEN p_size % 2 = 0 THEN CAST(p_size + 5 AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END
    || CASE WHEN p_size % 3 = 0 THEN ']' ELSE ')' END AS label FROM part
)
SELECT p_partkey, label, CASE WHEN label LIKE '%)' AND regexp_matches(label, ',[0-9]+[)]$')
  THEN '[' || regexp_extract(label, '[0-9]+') || ')' ELSE label END AS legacy_label FROM labelled""",
    "covariate_scale_kind": " UNION ALL ".join((
        levels("c_acctbal", "customer", "regexp_replace(CAST(c_acctbal AS VARCHAR), '\\.0$', '')"),
        levels("c_mktsegment", "customer", "c_mktsegment"),
        levels("n_name", "nation", "n_name"),
        levels("p_size", "part", "CAST(p_size AS VARCHAR)"),
    )),
    "timeline_points": f"WITH {TIMELINE} {TIMELINE_POINTS}",
    "timeline_segments": f"""WITH {TIMELINE}, ranges AS ({RANGES_PLAIN})
SELECT r.subject, subject_rank, r.modality, round(min_pts, 6) AS min_pts, round(max_pts, 6) AS max_pts
FROM ranges r JOIN dims d ON r.subject = d.subject WHERE EXISTS (SELECT 1 FROM cells c WHERE c.subject = r.subject AND c.modality = r.modality)""",
    "timeline_strip": f"""WITH {TIMELINE}
SELECT subject, color_group, subject_rank, modality, round(strip_x, 6) AS strip_x, round(strip_width, 6) AS strip_width FROM dims, place""",
    "timeline_anchored": f"""WITH {TIMELINE}, points AS ({TIMELINE_POINTS})
SELECT sample_id, subject, time, color_group, point_group, subject_rank, modality, available,
  CAST(NULL AS DOUBLE) AS min_pts, CAST(NULL AS DOUBLE) AS max_pts, tooltip FROM points
UNION ALL
SELECT NULL, d.subject, round(anchor_x, 6), color_group, point_group, subject_rank, modality, 'Anchor', NULL, NULL,
  d.subject || ' <br> o_orderdate : ' || {number_text("anchor_x")} || ' <br> Omics Type: ' || modality || ' <br> segment : ' || coalesce(color_group, 'NA')
FROM dims d, (SELECT *, CAST(strip_x - strip_width * 2 AS DOUBLE) AS anchor_x FROM place) WHERE EXISTS (SELECT 1 FROM cells c WHERE c.subject = d.subject)""",
    "timeline_facet": f"WITH {TIMELINE} SELECT * FROM ({TIMELINE_POINTS}) WHERE modality = 'ret_N'",
    "timeline_axis_labels": f"WITH {TIMELINE} SELECT subject, color_group, subject_rank FROM dims",
    "timeline_modality_levels": f"""WITH {ORDER_CELLS}
SELECT modality, CAST(dense_rank() OVER (ORDER BY modality) AS INTEGER) AS modality_index FROM (SELECT DISTINCT modality FROM cells)""",
    "timeline_events": f"""WITH {EVENT_RANKS}
SELECT sample_id, c.subject, time, 'None' AS color_group, 'None' AS point_group, subject_rank, modality, available,
  c.subject || ' <br> day : ' || {number_text("time")} || ' <br> Omics Type: ' || modality AS tooltip
FROM cells c JOIN ranks r ON c.subject = r.subject""",
    "ranges_semi_join": f"WITH {EVENT_CELLS}, ranges AS ({RANGES_PLAIN}) SELECT * FROM ranges WHERE modality <> 'error'",
    "strip_positions": f"""WITH {EVENT_CELLS}, strip AS (
  SELECT modality, min(time) AS min_time, max(time) - min(time) AS time_range FROM cells
  WHERE modality = (SELECT min(modality) FROM cells) GROUP BY modality
), sized AS (SELECT *, greatest(1, time_range * 0.05) AS strip_offset, greatest(0.35, time_range * 0.05) AS strip_width FROM strip)
SELECT modality, min_time, round(time_range, 6) AS time_range, round(strip_offset, 6) AS strip_offset, round(strip_width, 6) AS strip_width,
  round(min_time - strip_offset, 6) AS strip_x, round(min_time - strip_offset - 2 * strip_width, 6) AS anchor_x FROM sized""",
    "overlap_points": f"""WITH {EVENT_RANKS} {LANES}
SELECT c.modality, sample_id, c.subject, time, subject_rank, available, round(CAST(subject_rank + lane_offset AS DOUBLE), 6) AS y_offset,
  'Subject ID: ' || c.subject || ' ' || chr(10) || ' Omics Type: ' || c.modality || ' ' || chr(10) || ' Timepoint: ' || {number_text("time")}
    || ' ' || chr(10) || ' Available: ' || available AS tooltip
FROM cells c JOIN ranks r ON c.subject = r.subject JOIN lanes l ON c.modality = l.modality""",
    "overlap_segments": f"""WITH {EVENT_RANKS} {LANES}, ranges AS ({RANGES_PLAIN})
SELECT c.modality, c.subject, subject_rank, min_pts, max_pts, round(CAST(subject_rank + lane_offset AS DOUBLE), 6) AS y_offset,
  'Subject ID: ' || c.subject || ' ' || chr(10) || ' Omics Type: ' || c.modality || ' ' || chr(10) || ' Time Range: ' || {number_text("min_pts")}
    || ' to ' || {number_text("max_pts")} AS tooltip
FROM ranges c JOIN ranks r ON c.subject = r.subject JOIN lanes l ON c.modality = l.modality""",
    "overlap_limits": f"""WITH {EVENT_CELLS}, span AS (SELECT min(time) AS min_time, max(time) AS max_time FROM cells)
SELECT min_time, max_time, round((max_time - min_time) * 0.1, 6) AS padding, round(min_time - (max_time - min_time) * 0.1, 6) AS x_min,
  round(max_time + (max_time - min_time) * 0.1, 6) AS x_max FROM span""",
    "modality_lanes": f"WITH {EVENT_CELLS} {LANES} SELECT modality, lane, round(CAST(lane_offset AS DOUBLE), 6) AS lane_offset FROM lanes",
    "key_violations_lineitem": "SELECT l_orderkey, count(*) AS n_rows FROM lineitem GROUP BY 1 HAVING count(*) > 1 OR l_orderkey IS NULL",
    "key_violations_orders": "SELECT o_orderkey, count(*) AS n_rows FROM orders GROUP BY 1 HAVING count(*) > 1 OR o_orderkey IS NULL",
    "delimiter_sniff": f"""WITH lines AS (SELECT doc_id, regexp_extract(text, '^[^\\r\\n]*') AS line FROM documents),
counted AS (SELECT doc_id, line, {COUNTED} FROM lines), topped AS (SELECT *, greatest(n0, n1, n2, n3) AS top FROM counted)
SELECT doc_id, CASE top WHEN n0 THEN ',' WHEN n1 THEN chr(9) WHEN n2 THEN ';' ELSE ' ' END AS delimiter,
  CASE WHEN n1 > 0 THEN chr(9) WHEN n0 > 0 THEN ',' ELSE '' END AS simple_delimiter FROM topped""",
    "folder_delimiters": f"""WITH firsts AS (SELECT lang || '-' || source AS name, arg_min(text, doc_id) AS text FROM documents GROUP BY 1),
lines AS (SELECT name, regexp_extract(text, '^[^\\r\\n]*') AS line FROM firsts),
counted AS (SELECT name, line, {COUNTED} FROM lines), topped AS (SELECT *, greatest(n0, n1, n2, n3) AS top FROM counted)
SELECT name, line, CASE top WHEN n0 THEN ',' WHEN n1 THEN chr(9) WHEN n2 THEN ';' ELSE ' ' END AS delimiter FROM topped""",
    "file_preview": """WITH placed AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS row_no FROM customer)
SELECT c_mktsegment AS segment, CAST(row_no AS INTEGER) AS row_no, 'c_custkey|c_name|c_nationkey|c_acctbal|c_mktsegment' AS names,
  c_custkey || '|' || c_name || '|' || c_nationkey || '|' || CAST(c_acctbal AS VARCHAR) || '|' || c_mktsegment AS cells
FROM placed WHERE row_no <= 5""",
    "mixed_folder_read": """SELECT CASE WHEN c_custkey % 3 = 2 THEN 'K' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') ELSE CAST(c_custkey AS VARCHAR) END AS c_custkey, c_name,
  CASE c_custkey % 3 WHEN 0 THEN c_acctbal WHEN 1 THEN floor(c_acctbal) END AS c_acctbal,
  CASE WHEN c_custkey % 3 < 2 THEN c_mktsegment END AS c_mktsegment FROM customer""",
    "names_from_files": """SELECT p_name AS name FROM part UNION ALL SELECT p_type FROM part WHERE p_size > 25""",
    "name_list_parse": """SELECT p_partkey, name FROM (
  SELECT p_partkey, unnest(list_append(string_split(p_name, ' '), p_type)) AS name FROM part
) WHERE name <> ''""",
    "name_table_flatten": "SELECT p_name AS name FROM part UNION ALL SELECT p_type FROM part WHERE p_size > 25",
    "preview": "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 10",
    "dataset_profile": 'SELECT count(*) AS "rows", 11 AS "columns" FROM lineitem',
    "feature_matrix_long": """SELECT 'embeddings' AS dataset, CAST(vec_id AS VARCHAR) AS sample_id, 'f' || (place - 1) AS feature,
  round(CAST(embedding[place] AS DOUBLE), 6) AS value
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS place FROM embeddings)""",
    "feature_matrix_unnamed": """SELECT lpad(CAST(vec_id AS VARCHAR), 8, '0') AS sample_id, ['f0', 'NA', 'V4', 'f3'][place] AS feature,
  round(CAST(embedding[place] AS DOUBLE), 6) AS value FROM (SELECT vec_id, embedding, unnest([1, 2, 3, 4]) AS place FROM embeddings)""",
    "feature_matrix_blocks": """SELECT 'embeddings' AS dataset, CAST(vec_id AS VARCHAR) AS sample_id, 'f' || (place - 1) AS feature,
  round(CAST(embedding[place] AS DOUBLE), 6) AS value FROM (SELECT vec_id, embedding, unnest([1, 8, 32]) AS place FROM embeddings)""",
    "new_files_only": """WITH named AS (SELECT doc_id, lang || '-' || source AS name FROM documents)
SELECT name, min(name || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt') AS path FROM named
WHERE name NOT IN (SELECT n.name FROM named n JOIN labels l ON n.doc_id = l.doc_id WHERE toxic = 1) GROUP BY name""",
    "table_search": """SELECT * FROM customer WHERE (
  SELECT bool_and(contains(lower(concat_ws(' ', c_custkey, c_name, c_nationkey,
    regexp_replace(CAST(c_acctbal AS VARCHAR), '\\.0$', ''), c_mktsegment)), word))
  FROM (SELECT unnest(['house', '00', '4']) AS word))""",
    "table_search_indexed": """SELECT * FROM customer WHERE (
  SELECT bool_and(contains(lower(concat_ws(' ', c_custkey, c_name, c_nationkey,
    regexp_replace(CAST(c_acctbal AS VARCHAR), '\\.0$', ''), c_mktsegment)), word))
  FROM (SELECT unnest(['house', '00', '4']) AS word))""",
    "csv_roundtrip": "SELECT * FROM customer",
    "stored_dataset": "SELECT * FROM orders",
    "matrix_key_violations": """SELECT 'documents' AS dataset, lpad(CAST(n_chars AS VARCHAR), 6, '0') AS sample_id
FROM documents GROUP BY 2 HAVING count(*) > 1""",
    "feature_matrix_files": """SELECT lpad(CAST(vec_id AS VARCHAR), 8, '0') AS sample_id, 'f' || (place - 1) AS feature,
  round(CAST(embedding[place] AS DOUBLE), 6) AS value
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS place FROM embeddings)""",
    "streamed_files": "SELECT * FROM customer",
    "streamed_files_two_runs": "SELECT * FROM customer",
    "streamed_files_refused": """SELECT * FROM customer WHERE c_custkey % 10 = 0
UNION ALL SELECT customer.* FROM customer, range(2) WHERE c_custkey % 2 = 1 AND c_custkey % 7 = 3
UNION ALL SELECT NULL, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 11 = 0""",
    "running_ranges_events": """SELECT CAST(user_id AS VARCHAR) AS subject, event_type AS modality, count(*) AS n_samples,
  min(epoch_us(ts)) AS min_time, max(epoch_us(ts)) AS max_time FROM events GROUP BY 1, 2""",
    "running_ranges_batches": """SELECT CAST(user_id AS VARCHAR) AS subject, event_type AS modality, count(*) AS n_samples,
  min(epoch_us(ts)) AS min_time, max(epoch_us(ts)) AS max_time FROM events GROUP BY 1, 2""",}
