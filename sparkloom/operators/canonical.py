"""Canonical values of assertions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.ship import ship

#: Text below the first combining mark is composed as it stands.
MARKED = "[^\\x{0000}-\\x{02FF}]"


@F.pandas_udf(StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def canonical_values(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` composed (NFC) and trimmed; null where nothing is
    left. No built-in function composes text, so rows that may need it go through
    Arrow; all others, and nulls, stay in the JVM. Rows are kept, repeats too, and
    other columns are as they were; the order of rows is not."""
    ship(rows.sparkSession)
    c = F.col(column)
    needs = F.coalesce(c.rlike(MARKED), F.lit(False))
    trimmed = F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    both = rows.where(~needs).unionByName(rows.where(needs).withColumn(column, _composed(c)))
    return both.withColumn(column, F.when(trimmed != "", trimmed))
