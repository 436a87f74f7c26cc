"""Monthly sheet roll-up: UPC rows of a forecast sheet summed to material with INLINE/DISCO status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import safe_int


def inline_status(material: DataFrame, line_list: DataFrame, season: str) -> DataFrame:
    """INLINE when the material is in the line list of ``season``, else DISCO (NULL -> DISCO).

    The membership test is a left join to the season's distinct materials (an existence join).
    """
    inl = line_list.where(F.col("season") == season).select(F.col("material").alias("_inl")).distinct()
    j = material.join(inl, material["material"] == inl["_inl"], "left")
    stat = F.when(F.col("_inl").isNotNull(), F.lit("INLINE")).otherwise(F.lit("DISCO"))
    return j.select(*[material[c] for c in material.columns], stat.alias("inline_stat"))


def sheet_rollup(sheet: DataFrame, bridge: DataFrame, material: DataFrame, line_list: DataFrame, *,
                 months: Sequence[str], season: str, upc_col: str = "upc") -> DataFrame:
    """Sum the sheet's month columns per (material, description, status), largest first month first.

    Rows are first made distinct at UPC grain (a UPC listed twice with the same numbers counts once).  A
    material's UPC rows are the same for each of its descriptions and statuses, so they are made distinct and
    summed per material before these are joined: the rows of a material do not meet in one task.
    """
    status = inline_status(material.select("material", "material_description"), line_list, season).distinct()
    u = bridge.select(F.col("upc").alias("_upc"), F.col("material").alias("_material"))
    grain = u.join(sheet, u["_upc"] == sheet[upc_col]).select("_material", F.col(upc_col), *months).distinct()
    total = grain.groupBy("_material").agg(*[F.sum(m).cast("bigint").alias(m) for m in months])
    out = total.join(status, F.col("_material") == status["material"])
    return (out.select(safe_int("material").alias("material"), "material_description", "inline_stat", *months)
               .orderBy(F.col(months[0]).desc_nulls_last()))
