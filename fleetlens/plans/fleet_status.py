"""What is the state of every run below these directories?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.report_tree import rollup_tree
from ..operators.status import collect_issues, group_issues, outermost_runs, run_records, run_status, sort_report, verbose_record
from ..session import pin
from ..sources.run_files import scan_run_files
from ..sources.text import listed_log_lines


def _outermost_status(files: DataFrame, lines: DataFrame, model: str | None, verbose: bool) -> DataFrame:
    status = run_status(files, lines, model, verbose)
    if model is not None:  # every directory was asked for the model
        status = status.where("status <> 'not_configured'")
    return status.join(outermost_runs(status.select("run_path")), "run_path", "left_semi")


def fleet_status(spark: SparkSession, roots: list[str], model: str | None = None, verbose: bool = False) -> DataFrame:
    """Status of every run, in report order."""
    files = scan_run_files(spark, roots)
    return sort_report(_outermost_status(files, listed_log_lines(files), model, verbose))


def fleet_report(spark: SparkSession, root: str | list[str], model: str | None = None) -> DataFrame:
    """The status report of one directory, or of several, as a tree."""
    roots = [root] if isinstance(root, str) else root
    files = scan_run_files(spark, roots)
    return rollup_tree(_outermost_status(files, listed_log_lines(files), model, False), root)


def fleet_problem_tree(spark: SparkSession, root: str | list[str], model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The verbose report: the tree, folding only what agrees in every problem, and the problems ``(run_path, ...)`` of its entries."""
    roots = [root] if isinstance(root, str) else root
    files = scan_run_files(spark, roots)
    lines = listed_log_lines(files)
    problems = pin(group_issues(collect_issues(files, lines, model, verbose=True)))
    tree = rollup_tree(_outermost_status(files, lines, model, True), root, details=problems)
    return tree, problems.join(tree.select("run_path"), "run_path", "left_semi")


def fleet_problems(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Verbose records of every run."""
    files = scan_run_files(spark, roots)
    lines = listed_log_lines(files)
    return verbose_record(run_status(files, lines, verbose=True), collect_issues(files, lines, verbose=True))


def fleet_records(spark: SparkSession, roots: list[str]) -> DataFrame:
    """One nested record per run with all its problems."""
    files = scan_run_files(spark, roots)
    lines = listed_log_lines(files)
    return run_records(run_status(files, lines, verbose=True), collect_issues(files, lines, verbose=True))
