"""Imports every module that registers queries."""

from workload import basics, gold, ledger, linking, models, parsing, tables_io  # noqa: F401
