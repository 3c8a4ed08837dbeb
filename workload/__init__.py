"""Registered queries over the given tables, each with its SQL where SQL can say it."""

from workload import ann, evaluation, exact, ingest, text  # noqa: F401
from workload.registry import ORACLE, QUERIES  # noqa: F401
