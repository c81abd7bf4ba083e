"""Declared schemas and fixed state lists of the bug table."""

from __future__ import annotations

from pyspark.sql import types as T

# These must equal the reference's declared states, in this order.
SEVERITY_STATES = ["normal", "enhancement", "major", "trivial", "critical", "minor", "blocker"]
STATUS_STATES = ["CLOSED", "RESOLVED", "VERIFIED", "trivial", "critical", "minor"]
RESOLUTION_STATES = ["FIXED"]

# The 14 columns of the header-less bug CSV, in file order.
BUG_COLUMNS = [
    ("row_id", T.IntegerType()),
    ("assigned_to", T.IntegerType()),
    ("bug_id", T.IntegerType()),
    ("bug_severity", T.StringType()),
    ("bug_status", T.StringType()),
    ("component_id", T.IntegerType()),
    ("creation_ts", T.TimestampNTZType()),
    ("delta_ts", T.TimestampNTZType()),
    ("product_id", T.IntegerType()),
    ("resolution", T.StringType()),
    ("short_desc", T.StringType()),
    ("original_text", T.StringType()),
    ("text", T.StringType()),
    ("class", T.IntegerType()),
]

BUG_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in BUG_COLUMNS])

# Columns kept by the text job and by the no-text job, in their output order.
TEXT_JOB_COLUMNS = ["text", "bug_severity", "component_id", "product_id", "class"]
LIGHT_JOB_COLUMNS = ["bug_severity", "component_id", "product_id", "class"]

VECTOR_SCHEMA = "word string, vector array<float>"
