"""Run state from directory listings and logs: detection, rules, progress, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logs import classify_lines, file_role, round_percent, run_number, status_text
from ..functions.paths import base_name
from ..schemas import MINIMUM_OUTPUT_BYTES, MODEL_MARKERS, SEVERITY
from .ordered import earlier_max, last_wins, rank_within

# Fixed values here and in ``collect_issues``: the texts of the messages.
_STATUS_NAMES = sorted(SEVERITY, key=SEVERITY.get)
_NO_END = "job is still running (no `Epilogue`)"
_OUT_LOG_PATTERN = {"ADCIRC": "ADCIRC_*_*.out.log", "SCHISM": "SCHISM_*_*.out.log"}
_MARKER_KEY = {"ADCIRC": "fort.14,fort.15", "SCHISM": "hgrid.gr3,vgrid.in"}
_OUTPUT_LOG = {"ADCIRC": "fort.16", "SCHISM": "mirror.out"}


def severity_name(severity: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in _STATUS_NAMES]), severity + 1)


def _has(rel_path: str) -> Column:
    return F.coalesce(F.bool_or(F.col("rel_path") == rel_path), F.lit(False))


def _has_all(model: str) -> Column:
    return F.forall(F.array(*[_has(m) for m in MODEL_MARKERS[model]]), lambda there: there)


def _model_of(adcirc: Column, schism: Column) -> Column:
    return F.when(adcirc, "ADCIRC").when(schism, "SCHISM")


def detect_model(run_files: DataFrame, model: str | None = None) -> DataFrame:
    """``(run_path, model)`` of every directory that holds all marker files of a model; with ``model``, of that one."""
    markers = [m for names in MODEL_MARKERS.values() for m in names]
    found = _model_of(F.col("_adcirc"), F.col("_schism"))
    if model is not None:
        found = F.when(F.col(f"_{model.lower()}"), F.lit(model))
    return (
        run_files.where(F.col("rel_path").isin(*markers))
        .groupBy("run_path")
        .agg(_has_all("ADCIRC").alias("_adcirc"), _has_all("SCHISM").alias("_schism"))
        .select("run_path", found.alias("model"))
        .where(F.col("model").isNotNull())
    )


def outermost_runs(runs: DataFrame) -> DataFrame:
    """Runs that do not lie inside another run's directory (a run directory is not searched further).

    In the order of path parts a run is followed by all runs inside it, so the ends of these stretches nest, and a run lies inside
    another one if an earlier end is beyond its own. That needs no row per directory above a run, and no task gets all runs of a directory.
    """
    # a separator sorts before all other characters, so the lowest two are written as two each
    parts = F.replace(F.replace("run_path", F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))
    parts = F.replace(parts, F.lit("/"), F.lit("\x00"))
    placed = runs.select("run_path", *[c for c in runs.columns if c != "run_path"], F.concat(parts, F.lit("\x00")).alias("_begin"), F.concat(parts, F.lit("\x01")).alias("_end"))
    ends = earlier_max(placed, [F.col("_begin")], "_end", "_beyond")
    return ends.where(~F.coalesce(F.col("_beyond") > F.col("_end"), F.lit(False))).drop("_begin", "_end", "_beyond")


def undersized_outputs(run_files: DataFrame, minimum: int = MINIMUM_OUTPUT_BYTES) -> DataFrame:
    """Output files not above the minimum size."""
    role = file_role("rel_path")
    return run_files.where(role.isin("adcirc_nc", "schism_nc") & (F.col("length") <= minimum))


def summarize_logs(log_lines: DataFrame, verbose: bool = False, anywhere: bool = False) -> DataFrame:
    """One row per log file, by one aggregation of fixed-width values that combines before the shuffle.

    Without ``verbose`` only the lines from the last error line on count for progress and end
    mark. As the latest percentage and end mark are kept with their line numbers, comparing
    those to the last error's line number is enough; the lines need no second pass.
    """
    lines = classify_lines(log_lines, anywhere)
    percent_line = F.when(F.col("percent") != 0, F.col("line_no"))
    per_file = (
        lines.where(F.col("role").isNotNull())
        .groupBy("run_path", "file_name", "role")
        .agg(
            F.max(F.when(F.col("is_error"), F.col("line_no"))).alias("last_error_line"),
            F.count_if("is_error").alias("errors"),
            F.max_by(F.col("percent"), percent_line).alias("percent"),
            F.max(percent_line).alias("percent_line"),
            F.max(F.when(F.col("is_end"), F.col("line_no"))).alias("end_line"),
            F.min_by("total_steps", F.when(F.col("total_steps").isNotNull(), F.col("line_no"))).alias("total_steps"),
            F.max("step").alias("step"),
            F.bool_or("is_finished").alias("is_finished"),
        )
    )
    if verbose:
        cut = F.lit(None).cast("bigint")
    else:
        cut = F.when(F.col("role") == "adcirc_out", F.col("last_error_line"))
    return per_file.select(
        "run_path",
        "file_name",
        "role",
        "last_error_line",
        "errors",
        F.when(cut.isNull() | (F.col("percent_line") >= cut), F.col("percent")).alias("percent"),
        (F.col("end_line").isNotNull() & (cut.isNull() | (F.col("end_line") >= cut))).alias("ended"),
        "total_steps",
        "step",
        "is_finished",
    )


def epilogue_seen(log_lines: DataFrame, verbose: bool = False) -> DataFrame:
    """Per out-log: whether its end mark was seen in the lines that count."""
    return (
        summarize_logs(log_lines, verbose)
        .where(F.col("role").isin("adcirc_out", "schism_out"))
        .select("run_path", "file_name", "ended")
    )


def _adcirc_percent() -> Column:
    found = (F.col("role") == "adcirc_out") & (F.col("percent") != 0)
    return F.min_by(F.when(found, F.col("percent")), F.when(found, F.col("file_name")))


def adcirc_progress(log_lines: DataFrame, verbose: bool = False) -> DataFrame:
    """Last non-zero percentage of the first log (by name) that has one."""
    return (
        summarize_logs(log_lines, verbose)
        .groupBy("run_path")
        .agg(F.coalesce(_adcirc_percent(), F.lit(0.0)).alias("progress"))
    )


def _schism_percent(finished: Column, step: Column, total: Column) -> Column:
    share = round_percent(F.try_divide((F.lit(100) * step).cast("double"), total.cast("double")))
    return F.when(finished, F.lit(100.0)).otherwise(F.coalesce(share, F.lit(0.0)))


def schism_progress(log_lines: DataFrame) -> DataFrame:
    """100 when finished, else the share of steps reached, 0 when either number is missing."""
    return (
        summarize_logs(log_lines)
        .where(F.col("role") == "schism_output")
        .select(
            "run_path",
            _schism_percent(F.col("is_finished"), F.col("step"), F.col("total_steps")).alias("progress"),
        )
    )


def _file_facts(run_files: DataFrame) -> DataFrame:
    """One row per run directory from its listing."""
    role = file_role("rel_path")
    small = F.col("length") <= MINIMUM_OUTPUT_BYTES
    files = run_files.withColumn("role", role)
    return files.groupBy("run_path").agg(
        _has_all("ADCIRC").alias("is_adcirc"),
        _has_all("SCHISM").alias("is_schism"),
        *[
            F.count_if((F.col("role") == f"{model}_out")).alias(f"{model}_out_logs")
            for model in ("adcirc", "schism")
        ],
        *[
            F.coalesce(F.bool_or((F.col("role") == f"{model}_err") & (F.col("length") > 0)), F.lit(False)).alias(
                f"{model}_err_lines"
            )
            for model in ("adcirc", "schism")
        ],
        *[
            F.coalesce(F.bool_or((F.col("role") == f"{model}_nc") & small), F.lit(False)).alias(f"{model}_small")
            for model in ("adcirc", "schism")
        ],
        *[
            F.coalesce(F.bool_or(F.col("role") == f"{model}_output"), F.lit(False)).alias(f"{model}_output")
            for model in ("adcirc", "schism")
        ],
        F.coalesce(F.bool_or((F.col("role") == "esmf") & (F.col("length") == 0)), F.lit(False)).alias("esmf_empty"),
    )


def _log_facts(log_lines: DataFrame, verbose: bool, anywhere: bool) -> DataFrame:
    """One row per run from its logs."""
    per_file = summarize_logs(log_lines, verbose, anywhere)
    stepping = F.col("role") == "schism_output"
    return per_file.groupBy("run_path").agg(
        *[
            F.count_if((F.col("role") == f"{model}_out") & F.col("ended")).alias(f"{model}_ended")
            for model in ("adcirc", "schism")
        ],
        F.coalesce(F.bool_or((F.col("role") == "adcirc_out") & (F.col("errors") > 0)), F.lit(False)).alias("adcirc_error"),
        F.coalesce(F.bool_or((F.col("role") == "esmf") & (F.col("errors") > 0)), F.lit(False)).alias("esmf_error"),
        _adcirc_percent().alias("adcirc_percent"),
        F.coalesce(F.bool_or(stepping & F.col("is_finished")), F.lit(False)).alias("finished"),
        F.max(F.when(stepping, F.col("step"))).alias("step"),
        F.max(F.when(stepping, F.col("total_steps"))).alias("total_steps"),
    )


def run_status(
    run_files: DataFrame,
    log_lines: DataFrame,
    model: str | None = None,
    verbose: bool = False,
    anywhere: bool = False,
) -> DataFrame:
    """``(run_path, run_name, model, status, severity, progress, progress_text, status_text)`` per run.

    Runs are the directories with a model's markers; with ``model`` every listed directory is
    checked as a run of it and may come out as ``not_configured``. The status is the rule hit
    with the highest severity. Lines meet the listing only after both are down to a row per run.
    """
    facts = _file_facts(run_files)
    if model is None:
        facts = facts.withColumn("model", _model_of(F.col("is_adcirc"), F.col("is_schism"))).where("model is not null")
    else:
        facts = facts.withColumn("model", F.lit(model))
    runs = facts.join(_log_facts(log_lines, verbose, anywhere), "run_path", "left")
    adcirc = F.col("model") == "ADCIRC"

    def pick(name: str) -> Column:
        return F.when(adcirc, F.col(f"adcirc_{name}")).otherwise(F.col(f"schism_{name}"))

    def hit(rule: Column, status: str) -> Column:
        return F.when(rule, F.lit(SEVERITY[status])).otherwise(F.lit(0))

    configured = F.when(adcirc, F.col("is_adcirc")).otherwise(F.col("is_schism"))
    severity = F.greatest(
        hit(~configured, "not_configured"),
        hit((pick("out_logs") == 0) | pick("small"), "not_started"),
        hit(~pick("output") | F.col("esmf_empty"), "failed"),
        hit(
            pick("err_lines")
            | F.coalesce(F.col("esmf_error"), F.lit(False))
            | (adcirc & F.coalesce(F.col("adcirc_error"), F.lit(False))),
            "error",
        ),
        hit(pick("out_logs") > F.coalesce(pick("ended"), F.lit(0)), "running"),
    )
    finished = ~adcirc & F.coalesce(F.col("finished"), F.lit(False)) & F.col("schism_output")
    share = round_percent(
        F.when(
            ~adcirc & F.col("schism_output"),
            F.try_divide((F.lit(100) * F.col("step")).cast("double"), F.col("total_steps").cast("double")),
        )
    )
    known = F.when(adcirc, F.col("adcirc_percent")).otherwise(F.col("_share"))
    return (
        runs.withColumn("_share", share)
        .select(
            "run_path",
            base_name("run_path").alias("run_name"),
            "model",
            severity.alias("severity"),
            F.when(finished, F.lit(100.0)).otherwise(F.coalesce(known, F.lit(0.0))).alias("progress"),
            F.when(finished, F.lit("100")).otherwise(F.coalesce(known.cast("string"), F.lit("0"))).alias("progress_text"),
        )
        .select(
            "run_path",
            "run_name",
            "model",
            severity_name(F.col("severity")).alias("status"),
            "severity",
            "progress",
            "progress_text",
            status_text(severity_name(F.col("severity"))).alias("status_text"),
        )
    )


def collect_issues(
    run_files: DataFrame,
    log_lines: DataFrame,
    model: str | None = None,
    verbose: bool = False,
    anywhere: bool = False,
) -> DataFrame:
    """Every problem found, one row per message (see ``group_issues`` for messages per file).

    Rows stay long so that a log of any size spreads over tasks. Without ``verbose`` an out-log
    gives its last error line only; err-logs give every line either way.
    """
    role = file_role("rel_path")
    facts = _file_facts(run_files)
    if model is None:
        facts = facts.withColumn("model", _model_of(F.col("is_adcirc"), F.col("is_schism"))).where("model is not null")
    else:
        facts = facts.withColumn("model", F.lit(model))
    runs = facts.select("run_path", "model")
    adcirc = F.col("model") == "ADCIRC"
    nothing = F.lit(None).cast("bigint")

    def by_model(texts: dict[str, str]) -> Column:
        return F.when(adcirc, F.lit(texts["ADCIRC"])).otherwise(F.lit(texts["SCHISM"]))

    def row(when: Column, status: str, key: Column, message: Column) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(status).alias("category"),
                F.lit(SEVERITY[status]).alias("severity"),
                key.alias("file_name"),
                nothing.alias("line_no"),
                message.alias("message"),
            ),
        )

    per_run = facts.select(
        "run_path",
        F.explode(
            F.filter(
                F.array(
                    row(
                        ~F.when(adcirc, F.col("is_adcirc")).otherwise(F.col("is_schism")),
                        "not_configured",
                        by_model(_MARKER_KEY),
                        F.concat(F.col("model"), F.lit(" configuration files not found")),
                    ),
                    row(
                        F.when(adcirc, F.col("adcirc_out_logs")).otherwise(F.col("schism_out_logs")) == 0,
                        "not_started",
                        by_model(_OUT_LOG_PATTERN),
                        F.concat(F.lit("Slurm output log files `"), by_model(_OUT_LOG_PATTERN), F.lit("` not found")),
                    ),
                    row(
                        ~F.when(adcirc, F.col("adcirc_output")).otherwise(F.col("schism_output")),
                        "failed",
                        by_model(_OUTPUT_LOG),
                        F.concat(F.col("model"), F.lit(" output file `"), by_model(_OUTPUT_LOG), F.lit("` not found")),
                    ),
                ),
                lambda issue: issue.isNotNull(),
            )
        ).alias("i"),
    ).select("run_path", "i.*")

    mine = F.when(adcirc, F.lit("adcirc")).otherwise(F.lit("schism"))
    files = run_files.withColumn("role", role).where("role is not null").join(runs, "run_path")
    name = base_name("rel_path")
    empty_esmf = (F.col("role") == "esmf") & (F.col("length") == 0)
    small = (F.col("role") == F.concat(mine, F.lit("_nc"))) & (F.col("length") <= MINIMUM_OUTPUT_BYTES)
    size_text = F.concat(
        F.lit("file size ("), F.col("length").cast("string"),
        F.lit(f") does not exceed the minimum file size ({MINIMUM_OUTPUT_BYTES})"),
    )
    per_file = files.where(empty_esmf | small).select(
        "run_path",
        F.when(empty_esmf, "failed").otherwise("not_started").alias("category"),
        F.when(empty_esmf, SEVERITY["failed"]).otherwise(SEVERITY["not_started"]).alias("severity"),
        name.alias("file_name"),
        nothing.alias("line_no"),
        F.when(empty_esmf, F.concat(F.lit("empty ESMF log file `"), name, F.lit("`"))).otherwise(size_text).alias("message"),
    )

    ended = summarize_logs(log_lines, verbose, anywhere).where("ended").select("run_path", F.col("file_name").alias("rel_path"))
    running = (
        files.where(F.col("role") == F.concat(mine, F.lit("_out")))
        .join(ended, ["run_path", "rel_path"], "left_anti")
        .select(
            "run_path",
            F.lit("running").alias("category"),
            F.lit(SEVERITY["running"]).alias("severity"),
            name.alias("file_name"),
            nothing.alias("line_no"),
            F.lit(_NO_END).alias("message"),
        )
    )

    def error_row(source: DataFrame) -> DataFrame:
        return source.select(
            "run_path",
            F.lit("error").alias("category"),
            F.lit(SEVERITY["error"]).alias("severity"),
            base_name("file_name").alias("file_name"),
            F.col("line_no").cast("bigint").alias("line_no"),
            F.col("line").alias("message"),
        )

    lines = classify_lines(log_lines, anywhere)
    flagged = lines.where(F.col("role").isin("adcirc_err", "schism_err") | F.col("is_error")).join(runs, "run_path")
    flagged = flagged.where((F.col("role") == "esmf") | F.startswith(F.col("role"), mine))
    if not verbose:
        # of an out-log the last error line stays; every other line is a group of its own, so that one branch serves both
        own = F.when(F.col("role") != "adcirc_out", F.col("line_no"))
        flagged = flagged.groupBy("run_path", "file_name", own.alias("_own")).agg(
            F.max("line_no").alias("line_no"), F.max_by("line", "line_no").alias("line")
        )
    errors = error_row(flagged)
    return per_run.unionByName(per_file).unionByName(running).unionByName(errors)


def last_error_per_file(error_lines: DataFrame) -> DataFrame:
    """The last of the given error lines per file, combined before the shuffle."""
    return error_lines.groupBy("run_path", "file_name").agg(
        F.max("line_no").alias("line_no"), F.max_by("line", "line_no").alias("line")
    )


def group_issues(issues: DataFrame, lines_per_part: int = 10_000) -> DataFrame:
    """Messages of each run, category and file in line order, in parts of ``lines_per_part`` messages.

    ``part`` counts messages, not line numbers, so a log has the same parts however it was split when read, and an
    endless log makes more rows, not a longer one.
    """
    keys = ["run_path", "category", "severity", "file_name"]
    numbered = rank_within(issues, keys, [F.col("line_no"), F.col("message")], "_rank")
    part = F.floor((F.col("_rank") - 1) / lines_per_part).cast("bigint")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "message")))
    return (
        numbered.groupBy(*keys, part.alias("part"))
        .agg(ordered.alias("_m"))
        .select("run_path", "category", "severity", "file_name", "part", F.col("_m.message").alias("messages"))
    )


def status_from_issues(runs: DataFrame, issues: DataFrame) -> DataFrame:
    """Status of each run as the category of its worst issue; none means completed."""
    worst = issues.groupBy("run_path").agg(F.max("severity").alias("severity"))
    return (
        runs.join(worst, "run_path", "left")
        .withColumn("severity", F.coalesce(F.col("severity"), F.lit(0)))
        .withColumn("status", severity_name(F.col("severity")))
    )


def verbose_record(status: DataFrame, issues: DataFrame, lines_per_part: int = 10_000) -> DataFrame:
    """JSON records per run: its status and progress, and its problems by category and file.

    A run with no problem has one record; one with problems has a record per category, file and
    part, so the records of a run together hold the whole nested report.
    """
    grouped = group_issues(issues, lines_per_part)
    joined = status.join(grouped.drop("severity"), "run_path", "left")
    head = F.concat(
        F.lit('"status":'), _quoted(F.col("status")), F.lit(',"progress":'),
        _quoted(F.concat(F.col("progress_text"), F.lit("%"))),
    )
    detail = F.concat(
        F.lit(","), _quoted(F.col("category")), F.lit(":{"), _quoted(F.col("file_name")), F.lit(":"),
        F.to_json("messages"), F.lit("}"),
    )
    return joined.select(
        "run_path", "run_name", "status", "progress", "category", "file_name", "part",
        F.concat(F.lit("{"), head, F.coalesce(detail, F.lit("")), F.lit("}")).alias("record"),
    )


def run_records(status: DataFrame, issues: DataFrame, messages_per_record: int = 10_000) -> DataFrame:
    """``run_path, run_name, status, progress, piece, record``: a nested JSON record per run.

    A record holds status and progress and, under each category with problems, the messages of each file; the worst category
    comes first. A run with more than ``messages_per_record`` messages goes on in further records, counted by ``piece`` from 0,
    so no row grows without bound; together they hold every message once, in order.
    """
    order = [F.col("severity").desc(), F.col("category"), F.col("file_name"), F.col("line_no"), F.col("message")]
    numbered = rank_within(issues, ["run_path"], order, "_rank")
    numbered = numbered.withColumn("piece", F.floor((F.col("_rank") - 1) / messages_per_record).cast("bigint"))
    inner = lambda key, text, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, text))), lambda e: e["_text"]), sep)
    messages = F.to_json(F.array_sort(F.collect_list(F.struct("line_no", "message")))["message"])
    named = lambda name, text: F.concat(_quoted(F.col(name)), F.lit(":"), text).alias("_text")
    files = numbered.groupBy("run_path", "piece", "severity", "category", "file_name").agg(named("file_name", messages))
    found = F.concat(F.lit("{"), inner(["file_name"], "_text", ","), F.lit("}"))
    categories = files.groupBy("run_path", "piece", "severity", "category").agg(named("category", found))
    worst = [(-F.col("severity")).alias("_place"), "category"]
    pieces = categories.groupBy("run_path", "piece").agg(inner(worst, "_text", ",").alias("_found"))
    head = F.concat(
        F.lit('{"status":'), _quoted(F.col("status")), F.lit(',"progress":'),
        _quoted(F.concat(F.col("progress_text"), F.lit("%"))),
    )
    return status.join(pieces, "run_path", "left").select(
        "run_path", "run_name", "status", "progress",
        F.coalesce("piece", F.lit(0).cast("bigint")).alias("piece"),
        F.concat(head, F.coalesce(F.concat(F.lit(","), "_found"), F.lit("")), F.lit("}")).alias("record"),
    )


def _quoted(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def prune_empty_categories(record: Column | str) -> Column:
    """Map of category to problems without the empty categories."""
    return F.map_filter(record, lambda _, problems: F.size(problems) > 0)


def report_order() -> list[Column]:
    """Most progress first, then status, run number and name."""
    return [F.col("progress").desc(), F.col("severity").asc(), run_number("run_name").asc(), F.col("run_name").asc()]


def sort_report(status: DataFrame) -> DataFrame:
    return status.orderBy(*report_order())


def report_rank(status: DataFrame, parent: str = "parent") -> DataFrame:
    """Position of each run inside its parent directory, safe for directories of any size."""
    return rank_within(status, [parent], report_order(), "position")


def merge_reports(reports: list[DataFrame], key: str = "run_name") -> DataFrame:
    """Union of reports; a later report replaces an earlier one's rows of the same key."""
    stacked = None
    for position, report in enumerate(reports):
        placed = report.withColumn("_at", F.lit(position))
        stacked = placed if stacked is None else stacked.unionByName(placed)
    return last_wins(stacked, [key], "_at").drop("_at")


def unqueued_runs(runs: DataFrame, queue: DataFrame, status: DataFrame, match: str = "name") -> DataFrame:
    """Runs that are neither in the job queue nor started, by name.

    ``match='name'`` compares run names to job names, one run per name (the latest path);
    ``match='workdir'`` compares run directories to the queue's working directories.
    """
    if match == "name":
        candidates = last_wins(runs.select("run_name", "run_path"), ["run_name"], "run_path")
        open_runs = candidates.join(queue.select(F.col("job_name").alias("run_name")), "run_name", "left_anti")
    elif match == "workdir":
        open_runs = runs.select("run_name", "run_path").join(
            queue.select(F.col("workdir").alias("run_path")), "run_path", "left_anti"
        )
    else:
        raise ValueError("match is 'name' or 'workdir'")
    waiting = status.where(F.col("status") == "not_started").select("run_path")
    return open_runs.join(waiting, "run_path", "left_semi").select("run_name", "run_path").orderBy("run_name", "run_path")
