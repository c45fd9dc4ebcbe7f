"""All registered queries and their SQL twins."""

from __future__ import annotations

from loadloom.queries import base, calendars, diagnostics, files, foreseen, models, relational, scalars, sequences, time  # noqa: F401  they register themselves


def flagship(spark, sf_dir):
    return calendars.day_role_profile(spark, sf_dir)


def queries():
    return dict(base.QUERIES)


def oracle_sql():
    return dict(base.ORACLES)
