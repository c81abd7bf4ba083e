"""Bug CSV scan (SRC1) and restricted-column scan (SRC2).

Header-less, comma separated, 14 columns in the declared order, one record
per line.  The schema is given, never inferred, so the scan is one pass and
Catalyst prunes unread columns inside the CSV parser.  Malformed cells give
null in PERMISSIVE mode and the raw line is kept in ``_corrupt_record`` (only
when that column is selected); ``mode='DROPMALFORMED'`` or ``'FAILFAST'``
are passed through.

Note: empty unquoted cells are read as null (Spark's CSV default), so text
filters must treat null as empty (``drop_empty_text`` does).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bugroute.schema import BUG_SCHEMA

CORRUPT = "_corrupt_record"
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSS]"


def read_bugs(spark: SparkSession, path: str, mode: str = "PERMISSIVE",
              columns: Sequence[int | str] | None = None, keep_corrupt: bool = False,
              schema: T.StructType = BUG_SCHEMA) -> DataFrame:
    """Read the bug CSV.  ``columns`` keeps only some columns, by name or by
    0-based position in the file (the restricted reader)."""
    full = T.StructType(list(schema.fields) + ([T.StructField(CORRUPT, T.StringType(), True)]
                                               if keep_corrupt and mode == "PERMISSIVE" else []))
    reader = (spark.read.schema(full)
              .option("header", False)
              .option("sep", ",")
              .option("multiLine", False)
              .option("mode", mode)
              .option("timestampNTZFormat", TIMESTAMP_FORMAT))
    if keep_corrupt and mode == "PERMISSIVE":
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    df = reader.csv(path)
    if columns is None:
        return df
    names = [schema.fields[c].name if isinstance(c, int) else c for c in columns]
    extra = [CORRUPT] if keep_corrupt and mode == "PERMISSIVE" else []
    return df.select(*[F.col(n) for n in names + extra])


def rejected(df: DataFrame) -> DataFrame:
    """Rows the CSV parser could not convert (needs ``keep_corrupt=True``).

    Read whole rows from it: Spark refuses a scan whose only required column
    is the corrupt-record column (e.g. a bare ``count()``)."""
    return df.where(F.col(CORRUPT).isNotNull())
