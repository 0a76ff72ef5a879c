"""Every registered query and the SQL stating its result."""

from . import protection, restoration, shaping, texts  # noqa: F401
from .registry import QUERIES, SQL, runner


def queries():
    return {name: runner(name) for name in QUERIES}


def oracle_sql():
    return dict(SQL)
