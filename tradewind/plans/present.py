"""Output presentation for cross-engine comparison.

Operators return exact types (money as decimal(18,2), dates as DateType).  Reports handed to other
tools are presented with money as double and dates as ISO ``yyyy-MM-dd`` text, which every engine and
dataframe library renders identically; the oracle SQL presents its results the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def present(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def respelled(df: DataFrame, spellings: dict[str, DataFrame]) -> DataFrame:
    """A folded report with the codes of its columns as the source spells them (code, spelling); a code that
    the source lacks stays as it is.  Rows and their number do not change."""
    out = df
    for column, told in spellings.items():
        known = told.select(F.col("code").alias("_code"), F.col("spelling").alias("_spelling"))
        out = out.join(known, F.col(f"`{column}`") == F.col("_code"), "left").withColumn(column, F.coalesce("_spelling", F.col(f"`{column}`")))
        out = out.drop("_code", "_spelling")
    return out.select(*df.columns)
