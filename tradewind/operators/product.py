"""Product branch: season span, season numbering, life-cycle class, exclusivity, classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import (historic_season, is_blank, like_any, season_half_fall_first, season_half_spring_first,
                         season_year, starts_with)

# Intents that do not make a product exclusive (besides NULL and empty text).
DOMESTIC_INTENTS = ("US", "US, Canada", "Canada")


def season_span(line_list: DataFrame, material_prefix: str = "1") -> DataFrame:
    """First year, last year and number of distinct seasons per material of the prefix."""
    ll = line_list.where(starts_with("material", material_prefix))
    yr = season_year("season")
    return ll.groupBy("material").agg(F.min(yr).alias("earliest_year"), F.max(yr).alias("latest_year"),
                                      F.count_distinct("season").cast("bigint").alias("total_seasons"))


def number_rows(df: DataFrame, part: str, order_key: str, tiebreak: Sequence[str],
                out: str = "season_number") -> DataFrame:
    """``row_number() over (partition by part order by order_key, *tiebreak)`` without putting a
    whole ``part`` group into one task.

    Rows are counted per (part, order_key) with map-side partial aggregation; a running sum over those
    small counts gives each order key its offset; rows are then numbered only inside their
    (part, order_key) group.  A part with many seasons is spread over as many tasks as it has seasons.
    NULL is a part or key like any other (NULL keys first), as in a window.
    """
    # every column is read here too, so that a shuffle below (a DISTINCT, say) is the same for both reads
    counts = df.groupBy(part, order_key).agg(F.count(F.lit(1)).alias("_c"), F.max(F.hash(*df.columns)).alias("_h"))
    w = Window.partitionBy(part).orderBy(order_key)
    offsets = counts.select(F.col(part).alias("_part"), F.col(order_key).alias("_key"),
                            (F.sum("_c").over(w) - F.col("_c") + F.col("_h") * 0).alias("_offset"))
    w2 = Window.partitionBy(part, order_key).orderBy(*[F.col(c).asc_nulls_first() for c in tiebreak])
    numbered = df.join(offsets, df[part].eqNullSafe(F.col("_part")) & df[order_key].eqNullSafe(F.col("_key")))
    return (numbered.withColumn(out, (F.col("_offset") + F.row_number().over(w2)).cast("int"))
                    .drop("_offset", "_part", "_key"))


#: attributes of a line, in the order that numbers the lines of a season
LINE = ("inl_or_smu", "smu_intent", "model", "msrp", "whsl", "gender")


def line_summary(line_list: DataFrame, material_prefix: str | None = None) -> DataFrame:
    """(material, season, lines): the distinct lines of each material and season, from one pass.

    Spans, numbers and prices of the seasons all come from it (``span_of``, ``numbers_of``, ``prices_of``).
    They read the same single aggregate, whose columns cannot be pruned apart, so that one plan that uses
    several of them reads the line list once and shuffles it once.  Equal lines are merged before the
    shuffle; a group holds the different lines of one material in one season.
    """
    ll = line_list if material_prefix is None else line_list.where(starts_with("material", material_prefix))
    return ll.groupBy("material", "season").agg(F.collect_set(F.struct(*LINE, "material", "season")).alias("lines"))


def _told(summary: DataFrame) -> DataFrame:
    """``summary`` with material and season as its lines tell them: a condition on those (a join key's, say)
    stays above the aggregate, where the keys' would go below it and part this read from the others."""
    return summary.select("material", *[F.get(f"lines.{c}", F.lit(0)).alias(f"line_{c}") for c in ("material", "season")], "lines")


def span_of(summary: DataFrame) -> DataFrame:
    """:func:`season_span` from a summary of the prefix's materials."""
    yr = season_year("line_season")
    spans = _told(summary).groupBy(F.col("material").alias("_key")).agg(
        F.max("line_material").alias("material"), F.min(yr).alias("earliest_year"), F.max(yr).alias("latest_year"),
        F.count("line_season").cast("bigint").alias("total_seasons"))
    return spans.drop("_key")


def numbers_of(summary: DataFrame, detail: Sequence[str] = ("model", "msrp", "whsl")) -> DataFrame:
    """:func:`season_number` from a summary of the prefix's materials.

    The seasons of a material get running offsets over their line counts, which are joined back, so the
    lines of a material are not brought into one task.
    """
    told = _told(summary)
    order = [historic_season("line_season"), F.col("line_season")]
    before = F.sum(F.size("lines")).over(Window.partitionBy("material").orderBy(*order)) - F.size("lines")
    offsets = told.select(F.col("line_material").alias("_m"), F.col("line_season").alias("_s"), before.alias("_before"))
    rows = told.join(offsets, (F.col("line_material") == F.col("_m")) & F.col("line_season").eqNullSafe(F.col("_s")))
    rows = rows.select("_before", F.posexplode(F.sort_array("lines")).alias("_at", "line")).select("_before", "_at", "line.*")
    return rows.select("material", season_year("season").alias("year"), season_half_spring_first("season").alias("calendar_season"),
                       (F.col("_before") + F.col("_at") + 1).cast("int").alias("season_number"), "season",
                       "inl_or_smu", "smu_intent", *detail)


def prices_of(summary: DataFrame) -> DataFrame:
    """Highest wholesale and retail price per (season, material, gender); the half-year defaults to
    Spring-Summer unless the season label says Fall."""
    lines = F.col("lines")

    def highest(price: str, gender):
        return F.array_max(F.transform(F.filter(lines, lambda l: l["gender"].eqNullSafe(gender)), lambda l: l[price]))
    genders = F.array_distinct(F.transform(lines, lambda l: l["gender"]))
    each = F.transform(genders, lambda g: F.struct(g.alias("gender"), highest("whsl", g).alias("whsl"), highest("msrp", g).alias("msrp")))
    rows = _told(summary).select("line_material", "line_season", F.inline(each))
    return rows.select(season_half_fall_first("line_season").alias("calendar_season"), season_year("line_season").alias("calendar_year"),
                       F.col("line_material").alias("material"), "gender", "whsl", "msrp")


PRODUCT_DETAIL = ("model", "msrp", "whsl")


def season_number(line_list: DataFrame, detail: Sequence[str] = PRODUCT_DETAIL, material_prefix: str = "1") -> DataFrame:
    """Line-list rows (materials of the prefix) numbered by season per material: 1 = the first season.

    Ties within a season (several rows per material-season) are ordered by the remaining columns,
    NULLs first.  ``detail`` are the extra line-list columns carried through.
    """
    ll = line_list.where(starts_with("material", material_prefix))
    pre = ll.select("material", "season", season_year("season").alias("year"),
                    season_half_spring_first("season").alias("calendar_season"),
                    historic_season("season").alias("historic_season"),
                    "inl_or_smu", "smu_intent", *detail)
    numbered = number_rows(pre, "material", "historic_season",
                           ["season", "inl_or_smu", "smu_intent", *detail])
    return numbered.select("material", "year", "calendar_season", "season_number", "season", "inl_or_smu",
                           "smu_intent", *detail)


def lifecycle_expr(text: Column, accessory_patterns: Sequence[str], season_no: Column, intent: Column,
                   year: Column, earliest: Column, latest: Column) -> Column:
    """First match wins: accessory text, first season, intent given, last year, first year, else."""
    no_intent = intent.isNull()
    return (F.when(like_any(text, accessory_patterns), F.lit("Accessories"))
             .when(season_no == 1, F.lit("New"))
             .when(~no_intent, F.lit("Inline"))
             .when(year >= latest, F.lit("Discontinued"))
             .when(year <= earliest, F.lit("Early Release"))
             .otherwise(F.lit("Leap-Style")))


def _domestic(intent: Column, domestic: Sequence[str]) -> Column:
    return intent.isNull() | is_blank(intent) | intent.isin(list(domestic))


def exclusive_product_expr(inl_or_smu: Column, intent: Column, domestic: Sequence[str] = DOMESTIC_INTENTS) -> Column:
    """UTY: exclusive unless the intent is domestic; INL: never; anything else (incl. NULL): yes."""
    kind = F.upper(inl_or_smu)
    return (F.when(kind == "UTY", F.when(_domestic(intent, domestic), F.lit("No")).otherwise(F.lit("Yes")))
             .when(kind == "INL", F.lit("No"))
             .otherwise(F.lit("Yes")))


def exclusive_account_expr(inl_or_smu: Column, intent: Column, domestic: Sequence[str] = DOMESTIC_INTENTS) -> Column:
    """SMU: exclusive; otherwise exclusive unless the intent is domestic."""
    return (F.when(F.upper(inl_or_smu) == "SMU", F.lit("Yes"))
             .when(_domestic(intent, domestic), F.lit("No"))
             .otherwise(F.lit("Yes")))


def lifecycle_class(numbered: DataFrame, span: DataFrame, *, accessory_patterns: Sequence[str],
                    text_col: str = "model") -> DataFrame:
    """Life-cycle class per numbered line-list row (product variant: text test on the model)."""
    j = numbered.join(span.select("material", "earliest_year", "latest_year"), "material")
    cls = lifecycle_expr(F.col(text_col), accessory_patterns, F.col("season_number"), F.col("smu_intent"),
                         F.col("year"), F.col("earliest_year"), F.col("latest_year"))
    return j.select("material", "calendar_season", "year", cls.alias("classification"), "smu_intent",
                    "inl_or_smu", "season_number", "msrp", "whsl")


def exclusivity_product(numbered: DataFrame, domestic: Sequence[str] = DOMESTIC_INTENTS) -> DataFrame:
    return numbered.select("material", "season", "inl_or_smu", "smu_intent",
                           exclusive_product_expr(F.col("inl_or_smu"), F.col("smu_intent"), domestic).alias("exclusive"))


def exclusivity_account(numbered: DataFrame, domestic: Sequence[str] = DOMESTIC_INTENTS) -> DataFrame:
    return numbered.select("material", "season", "inl_or_smu", "smu_intent",
                           exclusive_account_expr(F.col("inl_or_smu"), F.col("smu_intent"), domestic).alias("exclusive"))


def product_classification(classes: DataFrame, style: DataFrame, domestic: Sequence[str] = DOMESTIC_INTENTS) -> DataFrame:
    """Classification rows with description and category from the style master."""
    st = style.select("material", "material_description", "category")
    j = classes.join(st, "material")
    return j.select("material", "material_description", "year", "calendar_season", "category",
                    "classification", "inl_or_smu", "smu_intent",
                    exclusive_product_expr(F.col("inl_or_smu"), F.col("smu_intent"), domestic).alias("exclusive"),
                    "msrp", "whsl")
