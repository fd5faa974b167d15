"""Queries over the driver's tables, each with the SQL that must give the same rows."""


def load_checks():
    """The registry with every module of checks imported."""
    from . import config_checks, file_checks, geo_checks, plan_checks, planning_checks, registry, status_checks  # noqa: F401

    return registry
