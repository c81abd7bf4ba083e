"""Write a bug table as the header-less CSV the scan reads (test fixtures).

Line breaks, commas and quotes inside text cells are replaced by spaces
first, because the reader is line based (one record per line).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugroute.schema import BUG_SCHEMA
from bugroute.sources.bugs_csv import TIMESTAMP_FORMAT

TEXT_COLUMNS = ("short_desc", "original_text", "text")


def flatten_text(df: DataFrame) -> DataFrame:
    out = df
    for c in TEXT_COLUMNS:
        if c in df.columns:
            out = out.withColumn(c, F.regexp_replace(F.col(c), r"[\r\n,\"]", " "))
    return out


def write_bugs_csv(df: DataFrame, path: str) -> None:
    cols = [f.name for f in BUG_SCHEMA.fields]
    (flatten_text(df).select(*cols).write.mode("overwrite")
     .option("header", False).option("timestampNTZFormat", TIMESTAMP_FORMAT)
     # keep cell text exactly (the CSV writer trims white space by default)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))
