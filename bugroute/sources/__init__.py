"""Scans: driver tables, the bug CSV, and the word-vector / model formats."""

from bugroute.sources.tables import bugs_table, load_table, preds_table  # noqa: F401
from bugroute.sources.bugs_csv import read_bugs  # noqa: F401
