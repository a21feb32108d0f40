"""Registered queries over the test tables, each with its SQL twin where SQL can state it."""

from fairtender.checks import basics, groups, models, scans, texts, yearly_tables  # noqa: F401
from fairtender.checks.registry import ORACLES, QUERIES  # noqa: F401
