"""Checks of run state: rules, progress, reports, backlog, streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.logs import run_number, status_text
from ..operators.ordered import last_wins
from ..operators.report_tree import rollup_tree
from ..operators.status import (
    adcirc_progress,
    collect_issues,
    detect_model,
    epilogue_seen,
    group_issues,
    last_error_per_file,
    merge_reports,
    outermost_runs,
    prune_empty_categories,
    report_rank,
    run_records,
    run_status,
    schism_progress,
    severity_name,
    sort_report,
    status_from_issues,
    undersized_outputs,
    unqueued_runs,
    verbose_record,
)
from ..session import ensure_checkpoint_dir
from ..sources.text import latest_jobs, number_lines, number_text_lines, parse_job_queue
from ..streaming.live_status import latest_states, stream_run_status, write_states
from .inputs import FLEET_CTE, SCHISM_CTE, fleet, fleet_lines, schism_fleet
from .registry import check, table

_NAMES = "['completed', 'running', 'error', 'failed', 'not_started', 'not_configured']"


def _status_sql(cut: str) -> str:
    """Status of the ADCIRC fleet; ``cut`` is the condition of lines that count in out-logs."""
    return f"""
WITH {FLEET_CTE},
lines AS (SELECT *, max(CASE WHEN regexp_matches(line, '^(?i)error') THEN line_no END)
                    OVER (PARTITION BY run_path, file_name) AS cut
          FROM fleet_lines WHERE line IS NOT NULL),
read AS (SELECT * FROM lines WHERE file_name NOT LIKE 'ADCIRC%out.log' OR {cut}),
per_file AS (SELECT run_path, file_name, bool_or(line LIKE '%End Epilogue%') AS ended,
                    bool_or(regexp_matches(line, '^(?i)error')) AS err,
                    arg_max(CAST(nullif(regexp_extract(line, '([0-9.]+)% COMPLETE', 1), '') AS DOUBLE), line_no)
                      FILTER (WHERE line LIKE '%\\% COMPLETE' ESCAPE '\\'
                              AND CAST(nullif(regexp_extract(line, '([0-9.]+)% COMPLETE', 1), '') AS DOUBLE) <> 0) AS pct
             FROM read GROUP BY ALL),
runs AS (SELECT run_path FROM fleet_files WHERE rel_path IN ('fort.14', 'fort.15') GROUP BY 1 HAVING count(DISTINCT rel_path) = 2),
facts AS (SELECT f.run_path,
                 count(*) FILTER (WHERE rel_path LIKE '%.out.log') AS outs,
                 count(*) FILTER (WHERE rel_path LIKE '%.out.log' AND coalesce(p.ended, false)) AS ended,
                 bool_or(rel_path LIKE '%.out.log' AND coalesce(p.err, false)) AS out_err,
                 bool_or(rel_path LIKE '%ESMF%' AND coalesce(p.err, false)) AS pet_err,
                 bool_or(rel_path LIKE '%.err.log' AND f.length > 0) AS err_log,
                 bool_or(rel_path LIKE '%ESMF%' AND f.length = 0) AS pet_empty,
                 bool_or(rel_path = 'fort.16') AS has_16,
                 bool_or(rel_path = 'fort.63.nc' AND f.length <= 43081) AS small,
                 arg_min(p.pct, rel_path) FILTER (WHERE rel_path LIKE '%.out.log' AND p.pct IS NOT NULL) AS pct
          FROM fleet_files f JOIN runs USING (run_path)
          LEFT JOIN per_file p ON p.run_path = f.run_path AND p.file_name = f.rel_path GROUP BY 1),
rated AS (SELECT *, CASE WHEN outs = 0 OR small THEN 4 WHEN NOT has_16 OR pet_empty THEN 3
                         WHEN out_err OR pet_err OR err_log THEN 2 WHEN ended < outs THEN 1 ELSE 0 END AS severity FROM facts)
SELECT run_path, split_part(run_path, '/', 3) AS run_name, 'ADCIRC' AS model,
       {_NAMES}[severity + 1] AS status, CAST(severity AS INTEGER) AS severity,
       coalesce(pct, 0.0) AS progress, coalesce(CAST(pct AS VARCHAR), '0') AS progress_text,
       {_NAMES}[severity + 1] || ' - ' || coalesce(CAST(pct AS VARCHAR), '0') || '%' AS status_text
FROM rated"""


@check(_status_sql("cut IS NULL OR line_no >= cut"))
def run_status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_report(run_status(*fleet(spark, sf_dir)))


@check(_status_sql("true"))
def run_status_verbose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_status(*fleet(spark, sf_dir), verbose=True)


_SCHISM_FILE_SQL = f"""
WITH {SCHISM_CTE},
steps AS (SELECT run_path, bool_or(regexp_matches(line, '^Run completed successfully')) AS done,
                 max(CAST(nullif(regexp_extract(line, '^TIME STEP=\\s+(\\d+);', 1), '') AS BIGINT)) AS step,
                 arg_min(CAST(nullif(regexp_extract(line, '^\\stime stepping begins\\.\\.\\.\\s+\\d+\\s+(\\d+)', 1), '') AS BIGINT), line_no)
                   FILTER (WHERE line LIKE ' time stepping begins%') AS total
          FROM schism_lines WHERE file_name = 'outputs/mirror.out' GROUP BY 1),
share AS (SELECT run_path, done,
                 CASE WHEN step IS NULL OR total IS NULL OR total = 0 THEN NULL
                      ELSE CAST(printf('%.2f', CAST(100 * step AS DOUBLE) / CAST(total AS DOUBLE)) AS DOUBLE) END AS part FROM steps)
"""


@check(_SCHISM_FILE_SQL + "SELECT run_path, CASE WHEN done THEN 100.0::DOUBLE ELSE coalesce(part, 0.0) END AS progress FROM share")
def schism_step_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lines = schism_fleet(spark, sf_dir)
    return schism_progress(lines)


@check(
    _SCHISM_FILE_SQL
    + f""",
runs AS (SELECT run_path FROM schism_files WHERE rel_path IN ('hgrid.gr3', 'vgrid.in', 'param.nml', 'outputs', 'bctides.in')
         GROUP BY 1 HAVING count(DISTINCT rel_path) = 5),
logs AS (SELECT run_path, bool_or(line LIKE '%End Epilogue%') AS ended FROM schism_lines WHERE file_name LIKE 'SCHISM%' GROUP BY 1),
facts AS (SELECT f.run_path, bool_or(rel_path LIKE 'SCHISM%') AS has_log, bool_or(rel_path = 'outputs/mirror.out') AS has_mirror,
                 bool_or(rel_path = 'outputs/out2d_1.nc' AND length <= 43081) AS small
          FROM schism_files f JOIN runs USING (run_path) GROUP BY 1),
rated AS (SELECT facts.run_path, CASE WHEN NOT has_log OR small THEN 4 WHEN NOT has_mirror THEN 3
                 WHEN NOT coalesce(ended, false) THEN 1 ELSE 0 END AS severity,
                 CASE WHEN coalesce(done, false) THEN '100' ELSE coalesce(CAST(part AS VARCHAR), '0') END AS pct,
                 CASE WHEN coalesce(done, false) THEN 100.0::DOUBLE ELSE coalesce(part, 0.0) END AS progress
          FROM facts LEFT JOIN logs USING (run_path) LEFT JOIN share USING (run_path))
SELECT run_path, 'SCHISM' AS model, {_NAMES}[severity + 1] AS status, progress,
       {_NAMES}[severity + 1] || ' - ' || pct || '%' AS status_text FROM rated"""
)
def schism_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_status(*schism_fleet(spark, sf_dir)).select("run_path", "model", "status", "progress", "status_text")


_ISSUES_SQL = f"""
WITH {FLEET_CTE},
lines AS (SELECT *, max(CASE WHEN regexp_matches(line, '^(?i)error') THEN line_no END)
                    OVER (PARTITION BY run_path, file_name) AS cut
          FROM fleet_lines WHERE line IS NOT NULL),
runs AS (SELECT run_path FROM fleet_files WHERE rel_path IN ('fort.14', 'fort.15') GROUP BY 1 HAVING count(DISTINCT rel_path) = 2),
files AS (SELECT * FROM fleet_files JOIN runs USING (run_path)),
issues AS (
  SELECT run_path, 'not_started' AS category, 'ADCIRC_*_*.out.log' AS file_name, CAST(NULL AS BIGINT) AS line_no,
         'Slurm output log files `ADCIRC_*_*.out.log` not found' AS message
  FROM runs WHERE run_path NOT IN (SELECT run_path FROM files WHERE rel_path LIKE '%.out.log')
  UNION ALL
  SELECT run_path, 'failed', 'fort.16', NULL, 'ADCIRC output file `fort.16` not found'
  FROM runs WHERE run_path NOT IN (SELECT run_path FROM files WHERE rel_path = 'fort.16')
  UNION ALL
  SELECT run_path, 'failed', rel_path, NULL, 'empty ESMF log file `' || rel_path || '`' FROM files
  WHERE rel_path LIKE 'PET%' AND length = 0
  UNION ALL
  SELECT run_path, 'not_started', rel_path, NULL,
         'file size (' || length || ') does not exceed the minimum file size (43081)' FROM files
  WHERE rel_path = 'fort.63.nc' AND length <= 43081
  UNION ALL
  SELECT f.run_path, 'running', f.rel_path, NULL, 'job is still running (no `Epilogue`)' FROM files f
  WHERE f.rel_path LIKE '%.out.log' AND NOT EXISTS (
    SELECT 1 FROM lines l WHERE l.run_path = f.run_path AND l.file_name = f.rel_path
                            AND l.line LIKE '%End Epilogue%' AND @CUT@)
  UNION ALL
  SELECT run_path, 'error', file_name, line_no, line FROM lines l JOIN runs USING (run_path)
  WHERE file_name LIKE '%.err.log' OR (file_name LIKE 'PET%' AND regexp_matches(line, '^(?i)error'))
     OR (file_name LIKE '%.out.log' AND regexp_matches(line, '^(?i)error') AND @LAST@)),
rated AS (SELECT run_path, category,
                 CAST(CASE category WHEN 'not_started' THEN 4 WHEN 'failed' THEN 3 WHEN 'error' THEN 2 ELSE 1 END AS INTEGER) AS severity,
                 file_name, line_no, message FROM issues)
"""
_ISSUES_SHORT = _ISSUES_SQL.replace("@CUT@", "(l.cut IS NULL OR l.line_no >= l.cut)").replace("@LAST@", "line_no = cut")
_ISSUES_VERBOSE = _ISSUES_SQL.replace("@CUT@", "true").replace("@LAST@", "true")


@check(_ISSUES_SHORT + "SELECT * FROM rated")
def run_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect_issues(*fleet(spark, sf_dir))


@check(_ISSUES_VERBOSE + "SELECT * FROM rated")
def run_issues_verbose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect_issues(*fleet(spark, sf_dir), verbose=True)


@check(
    _ISSUES_VERBOSE
    + """SELECT run_path, category, severity, file_name, (place - 1) // 50 AS part,
                string_agg(message, '|' ORDER BY line_no, message) AS messages
         FROM (SELECT *, row_number() OVER (PARTITION BY run_path, category, severity, file_name ORDER BY line_no, message) AS place FROM rated) GROUP BY ALL"""
)
def grouped_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = group_issues(collect_issues(*fleet(spark, sf_dir), verbose=True), lines_per_part=50)
    return grouped.withColumn("messages", F.array_join("messages", "|"))


@check(
    _ISSUES_SHORT
    + f""", worst AS (SELECT run_path, max(severity) AS severity FROM rated GROUP BY 1)
SELECT run_path, CAST(coalesce(severity, 0) AS INTEGER) AS severity, {_NAMES}[coalesce(severity, 0) + 1] AS status
FROM runs LEFT JOIN worst USING (run_path)"""
)
def status_of_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, lines = fleet(spark, sf_dir)
    runs = detect_model(files).select("run_path")
    return status_from_issues(runs, collect_issues(files, lines)).select("run_path", "severity", "status")


@check(
    _ISSUES_VERBOSE
    + f""", full_status AS ({_status_sql("true").replace("WITH ", "WITH ", 1)}),
grouped AS (SELECT run_path, category, file_name, CAST(0 AS BIGINT) AS part,
                   list(message ORDER BY line_no, message) AS messages FROM rated GROUP BY ALL)
SELECT run_path, run_name, status, progress, category, file_name, part,
       '{{"status":"' || status || '","progress":"' || progress_text || '%"' ||
       coalesce(',"' || category || '":{{"' || file_name || '":' || CAST(to_json(messages) AS VARCHAR) || '}}', '') || '}}' AS record
FROM full_status LEFT JOIN grouped USING (run_path)"""
)
def verbose_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, lines = fleet(spark, sf_dir)
    return verbose_record(run_status(files, lines, verbose=True), collect_issues(files, lines, verbose=True))


@check(
    _ISSUES_VERBOSE
    + f""", full_status AS ({_status_sql("true").replace("WITH ", "WITH ", 1)}),
placed AS (SELECT *, (row_number() OVER (PARTITION BY run_path
                      ORDER BY severity DESC, category, file_name, line_no NULLS FIRST, message) - 1) // 50 AS piece FROM rated),
file_parts AS (SELECT run_path, piece, severity, category, file_name, list(message ORDER BY line_no NULLS FIRST, message) AS messages
               FROM placed GROUP BY ALL),
file_texts AS (SELECT *, '"' || file_name || '":' || CAST(to_json(messages) AS VARCHAR) AS text FROM file_parts),
category_parts AS (SELECT run_path, piece, severity, category, string_agg(text, ',' ORDER BY file_name) AS files FROM file_texts GROUP BY ALL),
category_texts AS (SELECT *, ',"' || category || '":{{' || files || '}}' AS text FROM category_parts),
record_parts AS (SELECT run_path, piece, string_agg(text, '' ORDER BY severity DESC, category) AS found FROM category_texts GROUP BY ALL)
SELECT run_path, run_name, status, progress, coalesce(piece, 0) AS piece,
       '{{"status":"' || status || '","progress":"' || progress_text || '%"' || coalesce(found, '') || '}}' AS record
FROM full_status LEFT JOIN record_parts USING (run_path)"""
)
def records_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records, with few messages each so that long runs go on in further records."""
    files, lines = fleet(spark, sf_dir)
    return run_records(run_status(files, lines, verbose=True), collect_issues(files, lines, verbose=True), messages_per_record=50)


@check(
    f"""WITH {FLEET_CTE},
lines AS (SELECT *, max(CASE WHEN regexp_matches(line, '^(?i)error') THEN line_no END)
                    OVER (PARTITION BY run_path, file_name) AS cut
          FROM fleet_lines WHERE file_name LIKE '%.out.log')
SELECT run_path, file_name, bool_or(line LIKE '%End Epilogue%' AND (cut IS NULL OR line_no >= cut)) AS ended
FROM lines GROUP BY ALL"""
)
def log_end_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lines = fleet(spark, sf_dir)
    return epilogue_seen(lines)


@check(
    f"""WITH {FLEET_CTE},
pct AS (SELECT run_path, file_name, arg_max(CAST(regexp_extract(line, '([0-9.]+)% COMPLETE', 1) AS DOUBLE), line_no) AS p
        FROM fleet_lines WHERE line LIKE '%COMPLETE' GROUP BY ALL)
SELECT r.run_path, coalesce(arg_min(p, file_name), 0.0) AS progress
FROM (SELECT DISTINCT run_path FROM fleet_lines WHERE line IS NOT NULL) r LEFT JOIN pct ON pct.run_path = r.run_path GROUP BY 1"""
)
def percent_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lines = fleet(spark, sf_dir)
    return adcirc_progress(lines, verbose=True)


@check(
    f"""WITH {FLEET_CTE}
SELECT run_path, file_name, max(line_no) AS line_no, arg_max(line, line_no) AS line FROM fleet_lines
WHERE regexp_matches(line, '^(?i)error') GROUP BY ALL"""
)
def last_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lines = fleet(spark, sf_dir)
    return last_error_per_file(lines.where(F.col("line").rlike("^(?i)error")))


_MARKERS = ["fort.14", "fort.15", "hgrid.gr3", "vgrid.in", "param.nml", "outputs", "bctides.in", "fort.63.nc", "notes"]


@check(
    f"""WITH files AS (SELECT '/d/' || o_custkey AS run_path, {_MARKERS}[(o_orderkey % 9) + 1] AS rel_path FROM orders),
found AS (SELECT run_path, list(DISTINCT rel_path) AS names FROM files GROUP BY 1)
SELECT run_path, CASE WHEN list_has_all(names, ['fort.14', 'fort.15']) THEN 'ADCIRC' ELSE 'SCHISM' END AS model FROM found
WHERE list_has_all(names, ['fort.14', 'fort.15'])
   OR list_has_all(names, ['hgrid.gr3', 'vgrid.in', 'param.nml', 'outputs', 'bctides.in'])"""
)
def model_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(name) for name in _MARKERS])
    files = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("/d/"), F.col("o_custkey")).alias("run_path"),
        F.element_at(names, (F.col("o_orderkey") % 9 + 1).cast("int")).alias("rel_path"),
    )
    return detect_model(files)


@check(
    """WITH runs AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN '/f/c' ELSE '/f/d' END || c_custkey AS run_path FROM customer
              UNION ALL SELECT '/f/c' || o_custkey || '/o' || o_orderkey FROM orders)
SELECT run_path FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs p WHERE r.run_path LIKE p.run_path || '/%')"""
)
def outermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    above = table(spark, sf_dir, "customer").select(
        F.concat(F.when(F.col("c_mktsegment") == "BUILDING", F.lit("/f/c")).otherwise(F.lit("/f/d")), F.col("c_custkey")).alias("run_path")
    )
    below = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("/f/c"), F.col("o_custkey"), F.lit("/o"), F.col("o_orderkey")).alias("run_path")
    )
    return outermost_runs(above.unionByName(below))


_OUTPUTS = ["fort.63.nc", "outputs/schout_1.nc", "outputs/out2d_1.nc", "fort.16", "outputs/out2d_2.nc"]


@check(
    f"""WITH files AS (SELECT '/d/' || o_custkey AS run_path, {_OUTPUTS}[(o_orderkey % 5) + 1] AS rel_path,
                             CAST(floor(o_totalprice) AS BIGINT) AS length FROM orders)
SELECT * FROM files WHERE length <= 43081 AND rel_path IN ('fort.63.nc', 'outputs/schout_1.nc', 'outputs/out2d_1.nc')"""
)
def undersized(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(name) for name in _OUTPUTS])
    files = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("/d/"), F.col("o_custkey")).alias("run_path"),
        F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("rel_path"),
        F.floor("o_totalprice").cast("bigint").alias("length"),
    )
    return undersized_outputs(files)


def _customer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs, two of them under one name."""
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("run_"), F.floor(F.col("c_custkey") / 2)).alias("run_name"),
        F.concat(F.lit("/r/"), F.col("c_nationkey"), F.lit("/"), F.lpad(F.col("c_custkey").cast("string"), 12, "0")).alias("run_path"),
        severity_name((F.col("c_custkey") % 6).cast("int")).alias("status"),
        (F.col("c_custkey") % 6).cast("int").alias("severity"),
        (F.col("c_custkey") % 4 * 25).cast("double").alias("progress"),
        F.concat(F.lit("/r/"), F.col("c_nationkey")).alias("parent"),
        "c_custkey",
    )


_CUSTOMER_RUNS = f"""runs AS (SELECT 'run_' || (c_custkey // 2) AS run_name,
       '/r/' || c_nationkey || '/' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS run_path,
       {_NAMES}[(c_custkey % 6) + 1] AS status, CAST(c_custkey % 6 AS INTEGER) AS severity,
       CAST(c_custkey % 4 * 25 AS DOUBLE) AS progress, '/r/' || c_nationkey AS parent, c_custkey FROM customer)"""


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as the lines of a queue snapshot, most names several times; a third of the customers has none of them."""
    name = F.concat(F.lit("run_"), F.col("o_custkey") * 2)
    workdir = F.concat(F.lit("/r/"), F.col("o_orderkey") % 25, F.lit("/"), F.lpad(F.col("o_custkey").cast("string"), 12, "0"))
    lines = table(spark, sf_dir, "orders").select(
        F.lit("queue").alias("path"), (F.col("o_orderkey") + 2).alias("line_no"), F.concat(F.lit("  "), name, F.lit("   "), workdir, F.lit(" "), F.col("o_orderkey")).alias("line")
    )
    header = spark.range(1).select(F.lit("queue").alias("path"), F.lit(-1).cast("bigint").alias("line_no"), F.lit("NAME WORK_DIR JOBID").alias("line"))
    return parse_job_queue(lines.unionByName(header))


_QUEUE = """queue AS (SELECT 'run_' || (o_custkey * 2) AS job_name, o_orderkey AS line_no, CAST(o_orderkey AS VARCHAR) AS job_id,
       '/r/' || (o_orderkey % 25) || '/' || lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS workdir FROM orders)"""


@check(
    f"""WITH {_QUEUE} SELECT job_name, arg_max(workdir, line_no) AS workdir, arg_max(job_id, line_no) AS job_id FROM queue GROUP BY 1"""
)
def queue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_jobs(_queue(spark, sf_dir)).select("job_name", "workdir", "job_id")


@check(
    f"""WITH files AS (SELECT '/d/' || o_custkey AS run_path, {_MARKERS}[(o_orderkey % 9) + 1] AS rel_path FROM orders),
found AS (SELECT run_path, list(DISTINCT rel_path) AS names FROM files GROUP BY 1)
SELECT run_path, 'SCHISM' AS model FROM found WHERE list_has_all(names, ['hgrid.gr3', 'vgrid.in', 'param.nml', 'outputs', 'bctides.in'])"""
)
def model_detect_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories may hold the marker files of both models."""
    names = F.array(*[F.lit(name) for name in _MARKERS])
    files = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("/d/"), F.col("o_custkey")).alias("run_path"),
        F.element_at(names, (F.col("o_orderkey") % 9 + 1).cast("int")).alias("rel_path"),
    )
    return detect_model(files, "SCHISM")


@check(
    f"""WITH {_CUSTOMER_RUNS}, {_QUEUE}, named AS (SELECT run_name, max(run_path) AS run_path FROM runs GROUP BY 1)
SELECT n.run_name, n.run_path FROM named n JOIN runs r USING (run_path)
WHERE r.status = 'not_started' AND NOT EXISTS (SELECT 1 FROM queue q WHERE q.job_name = n.run_name)"""
)
def unqueued(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _customer_runs(spark, sf_dir)
    return unqueued_runs(runs, _queue(spark, sf_dir), runs)


@check(
    f"""WITH {_CUSTOMER_RUNS}, {_QUEUE}
SELECT run_name, run_path FROM runs r
WHERE status = 'not_started' AND NOT EXISTS (SELECT 1 FROM queue q WHERE q.workdir = r.run_path)"""
)
def unqueued_by_workdir(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _customer_runs(spark, sf_dir)
    return unqueued_runs(runs, _queue(spark, sf_dir), runs, match="workdir")


@check(
    f"""WITH {_CUSTOMER_RUNS}
SELECT parent, run_path, run_name, CAST(row_number() OVER (PARTITION BY parent ORDER BY progress DESC, severity,
       CAST(split_part(run_name, '_', 2) AS DOUBLE), run_name, run_path) AS BIGINT) AS position FROM runs"""
)
def report_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ordered import rank_within
    from ..operators.status import report_order

    runs = _customer_runs(spark, sf_dir).select("parent", "run_path", "run_name", "progress", "severity")
    ranked = rank_within(runs, ["parent"], [*report_order(), F.col("run_path").asc()], "position")
    return ranked.select("parent", "run_path", "run_name", "position")


@check(
    f"""WITH {_CUSTOMER_RUNS}, unique_runs AS (SELECT * EXCLUDE (run_name), run_name || '_' || c_custkey AS run_name FROM runs)
SELECT run_name, row_number() OVER (PARTITION BY parent ORDER BY progress DESC, severity, c_custkey, run_name) AS position
FROM unique_runs"""
)
def report_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _customer_runs(spark, sf_dir).withColumn("run_name", F.concat("run_name", F.lit("_"), F.col("c_custkey")))
    return report_rank(runs.select("parent", "run_name", "progress", "severity")).select("run_name", "position")


@check(
    f"""WITH {_CUSTOMER_RUNS}, later AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE '/later' END
    || '/r/' || c_nationkey || '/' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS run_path FROM customer)
SELECT run_path, CASE WHEN l.run_path IS NULL THEN status ELSE 'completed' END AS status,
       CASE WHEN l.run_path IS NULL THEN progress ELSE 100.0 END AS progress FROM runs FULL JOIN later l USING (run_path)"""
)
def merged_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of every run and a later one of some of them and of new runs."""
    first = _customer_runs(spark, sf_dir).select("run_path", "status", "progress", "c_custkey")
    again = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_mktsegment") == "BUILDING").alias("known"))
    path = F.when(F.col("known"), F.col("run_path")).otherwise(F.concat(F.lit("/later"), F.col("run_path")))
    second = first.join(again, "c_custkey").select(
        path.alias("run_path"), F.lit("completed").alias("status"), F.lit(100.0).alias("progress")
    )
    return merge_reports([first.drop("c_custkey"), second], key="run_path")


@check(
    """SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority,
       max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1"""
)
def last_row_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey")
    return last_wins(orders, ["o_custkey"], "o_orderkey")


@check(
    """SELECT o_orderkey, CASE WHEN regexp_matches(o_orderpriority || '_' || o_custkey, '_(\\d+)$')
              THEN CAST(o_custkey AS DOUBLE) END AS number,
       CASE WHEN regexp_matches(o_orderpriority, '_(\\d+)$') THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS none FROM orders"""
)
def run_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        run_number(F.concat("o_orderpriority", F.lit("_"), F.col("o_custkey"))).alias("number"),
        run_number("o_orderpriority").alias("none"),
    )


@check(
    """WITH t AS (SELECT c_custkey, c_custkey % 3 AS a, c_custkey % 2 AS b FROM customer)
SELECT c_custkey, concat_ws(',', CASE WHEN a > 0 THEN 'error' END, CASE WHEN b > 0 THEN 'failed' END) AS categories FROM t"""
)
def pruned_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    several = lambda n: F.array_repeat(F.lit("message"), n.cast("int"))
    record = F.create_map(
        F.lit("error"), several(F.col("c_custkey") % 3), F.lit("failed"), several(F.col("c_custkey") % 2)
    )
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.array_join(F.map_keys(prune_empty_categories(record)), ",").alias("categories")
    )


_TREE = """WITH leaves AS (SELECT '/w/fleet/' || r_name || '/' || n_name || '/runs/c_' || c_custkey AS run_path, r_name, n_name,
       'c_' || c_custkey AS name,
       CASE WHEN n_regionkey = 1 THEN 'completed - 100.0%' WHEN n_nationkey % 2 = 0 THEN 'running - 15.0%'
            WHEN c_custkey % 3 = 0 THEN 'error - 0%' ELSE 'running - 15.0%' END AS text
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
nations AS (SELECT r_name, n_name, string_agg(name || '=' || text, ',' ORDER BY name) AS content,
                CASE WHEN min(text) = max(text) THEN min(text) END AS text, arg_min(run_path, name) AS run_path FROM leaves GROUP BY ALL),
regions AS (SELECT r_name, count(DISTINCT coalesce(text, content)) = 1 AS same, min(text) AS first_text, arg_min(run_path, n_name) AS first_run
            FROM nations GROUP BY 1),
region_value AS (SELECT r_name, same, CASE WHEN same THEN first_text END AS text, CASE WHEN same THEN first_run END AS run_path FROM regions),
"""
_TREE_PLACED = """,
mixed AS (SELECT *, bool_or(text IS NULL) OVER (PARTITION BY parent) AS is_mixed,
                 CAST(regexp_extract(text, '([0-9.]+)%', 1) AS DOUBLE) AS progress FROM entries)
SELECT path, parent, name, level, text, CASE WHEN text IS NOT NULL THEN run_path END AS run_path,
       row_number() OVER (PARTITION BY parent ORDER BY CASE WHEN NOT is_mixed THEN -progress END,
           CASE WHEN NOT is_mixed THEN coalesce(TRY_CAST(regexp_extract(name, '_([0-9]+)$', 1) AS DOUBLE), -1) END, name) AS position FROM mixed"""


def _tree_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    status = (
        F.when(F.col("n_regionkey") == 1, "completed")
        .when((F.col("n_nationkey") % 2 != 0) & (F.col("c_custkey") % 3 == 0), "error")
        .otherwise("running")
    )
    shown = F.when(status == "completed", "100.0").when(status == "error", "0").otherwise("15.0")
    return customers.select(
        F.concat_ws("/", F.lit("/w/fleet"), "r_name", "n_name", F.lit("runs"), F.concat(F.lit("c_"), F.col("c_custkey"))).alias("run_path"),
        status.alias("status"),
        shown.cast("double").alias("progress"),
        F.lit(0).alias("severity"),
        status_text(status, shown).alias("status_text"),
    )


@check(
    _TREE
    + """entries AS (
SELECT '/w/fleet' AS path, CAST(NULL AS VARCHAR) AS parent, 'fleet' AS name, 0 AS level, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS VARCHAR) AS run_path
UNION ALL SELECT '/w/fleet/' || r_name, '/w/fleet', r_name, 1, text, run_path FROM region_value
UNION ALL SELECT '/w/fleet/' || r_name || '/' || n_name, '/w/fleet/' || r_name, n_name, 2, n.text, n.run_path
          FROM nations n JOIN region_value v USING (r_name) WHERE NOT v.same
UNION ALL SELECT '/w/fleet/' || r_name || '/' || n_name || '/' || name, '/w/fleet/' || r_name || '/' || n_name, name, 3, l.text, l.run_path
          FROM leaves l JOIN nations n USING (r_name, n_name) JOIN region_value v USING (r_name) WHERE NOT v.same AND n.text IS NULL)"""
    + _TREE_PLACED
)
def tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_tree(_tree_runs(spark, sf_dir), "/w/fleet")


@check(
    _TREE
    + """entries AS (
SELECT '/w/fleet/' || r_name AS path, CAST(NULL AS VARCHAR) AS parent, r_name AS name, 0 AS level, text, run_path FROM region_value
UNION ALL SELECT '/w/fleet/' || r_name || '/' || n_name, '/w/fleet/' || r_name, n_name, 1, n.text, n.run_path
          FROM nations n JOIN region_value v USING (r_name) WHERE NOT v.same
UNION ALL SELECT '/w/fleet/' || r_name || '/' || n_name || '/' || name, '/w/fleet/' || r_name || '/' || n_name, name, 2, l.text, l.run_path
          FROM leaves l JOIN nations n USING (r_name, n_name) JOIN region_value v USING (r_name) WHERE NOT v.same AND n.text IS NULL)"""
    + _TREE_PLACED
)
def tree_of_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report over a directory per region."""
    names = [r.r_name for r in table(spark, sf_dir, "region").select("r_name").collect()]
    return rollup_tree(_tree_runs(spark, sf_dir), [f"/w/fleet/{name}" for name in names])


@check(
    """SELECT doc_id, CAST(generate_subscripts(parts, 1) AS BIGINT) AS line_no, unnest(parts) AS line
FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS parts FROM documents)"""
)
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_text_lines(table(spark, sf_dir, "documents"), ["doc_id"])


@check("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line_no FROM events")
def placed_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the lines of a file per user, in blocks of a thousand; rows of a block have consecutive ids."""
    place = F.row_number().over(Window.partitionBy("user_id", "block").orderBy("event_id")).cast("bigint")
    events = table(spark, sf_dir, "events").withColumn("block", F.floor(F.col("event_id") / 1000)).withColumn("row", place + F.col("user_id") * 7)
    placed = events.select(F.col("user_id").cast("string").alias("path"), "block", "row", F.col("event_id").cast("string").alias("line"))
    return number_lines(placed).select(F.col("path").cast("bigint").alias("user_id"), F.col("line").cast("bigint").alias("event_id"), "line_no")


@check(
    """WITH l AS (SELECT '/fleet/' || user_id || '_' || (event_id % 10) AS run_path, event_type, floor(value)::BIGINT AS n,
                  CASE event_id // 10 % 5 WHEN 0 THEN 'setup' WHEN 1 THEN 'run' WHEN 2 THEN 'err' WHEN 3 THEN 'mirror' ELSE 'pet' END AS part,
                  user_id % 2 = 1 AS schism FROM events),
r AS (SELECT run_path, schism,
             bool_or(part IN ('setup', 'run')) AS started,
             (bool_or(part = 'setup') AND NOT bool_or(part = 'setup' AND event_type = 'signup'))
             OR (bool_or(part = 'run') AND NOT bool_or(part = 'run' AND event_type = 'signup')) AS open,
             bool_or(part = 'err' OR (part = 'pet' AND event_type = 'error' AND NOT schism) OR (part IN ('setup', 'run') AND NOT schism AND event_type = 'error')) AS bad,
             max(CASE WHEN part = 'run' AND event_type = 'purchase' AND n <> 0 THEN n END) AS of_run,
             max(CASE WHEN part = 'setup' AND event_type = 'purchase' AND n <> 0 THEN n END) AS of_setup,
             max(CASE WHEN part = 'mirror' AND event_type = 'purchase' THEN 400 + n END) AS total,
             max(CASE WHEN part = 'mirror' AND event_type IN ('view', 'click') THEN n END) AS step,
             bool_or(part = 'mirror' AND event_type = 'error' AND n % 7 = 0) AS done
      FROM l WHERE NOT (schism AND part = 'pet') AND NOT (NOT schism AND part = 'mirror') GROUP BY ALL)
SELECT run_path, CASE WHEN schism THEN 'SCHISM' ELSE 'ADCIRC' END AS model,
       CASE WHEN schism AND done THEN 100.0 WHEN schism THEN coalesce(round_even(100.0 * step / total, 2), 0.0)
            ELSE coalesce(of_run, of_setup, 0)::DOUBLE END::DOUBLE AS progress,
       started AND NOT open AS ended, bad AS has_error,
       CASE WHEN NOT started THEN 'not_started' WHEN bad THEN 'error' WHEN NOT open THEN 'completed' ELSE 'running' END AS status
FROM r"""
)
def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of lines of setup, run, error and stepping logs, run to its end in update mode."""
    import uuid

    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    n, kind = F.floor("value").cast("bigint"), F.col("event_type")
    schism = F.col("user_id") % 2 == 1
    part = F.element_at(F.array(*[F.lit(p) for p in ("setup", "run", "err", "mirror", "pet")]), (F.floor(F.col("event_id") / 10) % 5 + 1).cast("int"))
    name = F.when(schism, F.lit("SCHISM_")).otherwise(F.lit("ADCIRC_"))
    out_line = (
        F.when((kind == "error") & ~schism, F.concat(F.lit("ERROR "), n))
        .when((kind == "purchase") & ~schism, F.concat(n, F.lit("% COMPLETE")))
        .when(kind == "signup", F.lit("End Epilogue"))
        .otherwise(F.concat(F.lit("step "), n))
    )
    stepping = (
        F.when(kind == "purchase", F.concat(F.lit(" time stepping begins...   1   "), n + 400))
        .when(kind.isin("view", "click"), F.concat(F.lit("TIME STEP= "), n, F.lit("; x")))
        .when((kind == "error") & (n % 7 == 0), F.lit("Run completed successfully at t"))
        .otherwise(F.concat(F.lit("it "), n))
    )
    lines = events.where(~(schism & (part == "pet")) & ~(~schism & (part == "mirror"))).select(
        F.concat(F.lit("/fleet/"), F.col("user_id"), F.lit("_"), F.col("event_id") % 10).alias("run_path"),
        F.when(part == "setup", F.concat(name, F.lit("SETUP_x.out.log")))
        .when(part == "run", F.concat(name, F.lit("HOTSTART_x.out.log")))
        .when(part == "err", F.concat(name, F.lit("HOTSTART_x.err.log")))
        .when(part == "mirror", F.lit("outputs/mirror.out"))
        .otherwise(F.lit("PET0.ESMF_LogFile"))
        .alias("file_name"),
        F.when(part.isin("setup", "run"), out_line)
        .when(part == "mirror", stepping)
        .when(kind == "error", F.concat(F.lit("ERROR "), n))
        .otherwise(F.concat(F.lit("info "), n))
        .alias("line"),
    )
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    write_states(stream_run_status(lines), folder).trigger(availableNow=True).start().awaitTermination()
    return latest_states(spark, folder)


@check(
    """WITH lines AS (SELECT user_id % 40 AS run, event_id % 3 AS log, event_id AS place, event_type AS kind, floor(value)::BIGINT AS n FROM events),
    logs AS (SELECT run, log, max(place) FILTER (kind = 'error') AS err, arg_max(n, place) FILTER (kind = 'purchase' AND n <> 0) AS n,
                    max(place) FILTER (kind = 'purchase' AND n <> 0) AS n_at, max(place) FILTER (kind = 'signup') AS end_at
             FROM lines WHERE kind IN ('error', 'signup') OR kind = 'purchase' AND n IS NOT NULL OR place = 0 GROUP BY run, log),
    counted AS (SELECT run, log, err IS NOT NULL AS failed, CASE WHEN err IS NULL OR n_at >= err THEN n END AS n,
                       end_at IS NOT NULL AND (err IS NULL OR end_at >= err) AS ended FROM logs)
    SELECT '/fleet/' || run AS run_path, 'ADCIRC' AS model, coalesce(arg_min(n, log) FILTER (n IS NOT NULL), 0)::DOUBLE AS progress,
           bool_and(ended) AS ended, bool_or(failed) AS has_error,
           CASE WHEN bool_or(failed) THEN 'error' WHEN bool_and(ended) THEN 'completed' ELSE 'running' END AS status
    FROM counted GROUP BY run"""
)
def live_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of lines of three logs a run, with live state kept by log: only lines from the last error on count."""
    import uuid

    from ..streaming.live_runs import ROCKSDB, live_run_status

    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    n, kind = F.floor("value").cast("bigint"), F.col("event_type")
    lines = events.select(
        F.concat(F.lit("/fleet/"), F.col("user_id") % 40).alias("run_path"),
        F.concat(F.lit("ADCIRC_RUN_"), F.col("event_id") % 3, F.lit(".out.log")).alias("file_name"),
        F.col("event_id").alias("line_no"),
        F.when(kind == "error", F.lit("ERROR: lost"))
        .when(kind == "purchase", F.concat(n, F.lit("% COMPLETE")))
        .when(kind == "signup", F.lit("End Epilogue"))
        .otherwise(F.lit("step"))
        .alias("line"),
    )
    folder = f"{ensure_checkpoint_dir(spark)}/live-{uuid.uuid4().hex}"
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    had = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        write_states(live_run_status(lines), folder).trigger(availableNow=True).start().awaitTermination()
    finally:
        for key, value in had.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return latest_states(spark, folder)
