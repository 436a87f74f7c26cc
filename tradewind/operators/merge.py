"""Marketing dashboard: the anchored outer merge of six per-material branches and its reduction."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import row_sum, safe_int
from .buckets import MAX_BULK_COLUMNS, OPEN_COLUMNS, inbound_columns


def _merged_by_key(tagged: DataFrame, keys: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Rows of the anchored merge from ``tagged``: a ``_key`` and one nullable struct column per part, the
    anchor's first.  ``keys`` are the anchor's keys, one row each.

    A row whose key the anchor lacks (NULL among them) stands alone.  It meets nothing and is in no list: a
    left join with the anchor's keys, which adaptive execution divides where a key is hot, tells it from
    the others, and its group is made of its own values and its task.  The other rows are brought together
    by key: a key that has anchor rows gives the product of its parts (a part without rows gives NULLs), so
    its lists are never larger than the merged rows that it gives.
    """
    known = keys.select(F.col("_key").alias("_anchor"))
    flagged = tagged.join(known, F.col("_key") == F.col("_anchor"), "left")
    # the task's number parts equal lonely rows; it is that of a shuffled or read partition, the same when it runs again
    alone = F.when(F.col("_anchor").isNull(), F.xxhash64(F.struct(*parts), F.spark_partition_id()))
    lists = (flagged.withColumn("_alone", alone).groupBy("_anchor", "_alone")
                    .agg(*[F.collect_list(p).alias(p) for p in parts]))
    product = lists.where(F.col("_anchor").isNotNull())
    for p in parts:
        product = product.withColumn(p, F.explode_outer(p))
    types = {p: tagged.schema[p].dataType for p in parts}

    def single_rows(part: str):
        return F.transform(part, lambda row: F.struct(*[(row if p == part else F.lit(None).cast(types[p])).alias(p) for p in parts]))
    single = lists.where(F.col("_anchor").isNull()).select(F.explode(F.concat(*[single_rows(p) for p in parts])).alias("_row")).select("_row.*")
    return product.select(*parts).unionAll(single.select(*parts))


def _tagged(df: DataFrame, key: str, own: dict, types: dict) -> DataFrame:
    """``df`` as tagged rows: ``own`` gives the struct columns of its parts, the others are NULL."""
    return df.select(df[key].alias("_key"), *[own[p].alias(p) if p in own else F.lit(None).cast(t).alias(p) for p, t in types.items()])


def anchored_outer_merge(anchor: DataFrame, anchor_key: str,
                         others: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Rows of ``anchor FULL JOIN o1 ON o1.k1 = anchor.k FULL JOIN o2 ON o2.k2 = anchor.k ...``.

    Every join compares with the *anchor's* key, so a key missing from the anchor yields one separate
    row per source rather than one merged row.  The sources are tagged, united and shuffled by key, so each is
    computed once (the anchor's keys once more).  All column names across inputs must be distinct.
    """
    sources = [(f"_{i}", df, key) for i, (df, key) in enumerate([(anchor, anchor_key), *others])]
    types = {tag: df.select(F.struct(*df.columns).alias("r")).schema["r"].dataType for tag, df, _ in sources}
    rows = [_tagged(df, key, {tag: F.struct(*df.columns)}, types) for tag, df, key in sources]
    keys = anchor.select(anchor[anchor_key].alias("_key")).where("_key IS NOT NULL").distinct()
    merged = _merged_by_key(reduce(DataFrame.unionAll, rows), keys, list(types))
    return merged.select(*[F.col(f"{tag}.{c}").alias(c) for tag, df, _ in sources for c in df.columns])


SELL_COLUMNS = ("t4w_sellthru_units", "t4w_sellin_units", "t4w_retailer_onhand")
FORECAST_COLUMNS = ("current_month_forecast", "forecast_1m", "forecast_2m")


def merge_columns(weeks: Sequence[int] = (1, 2, 4, 8, 16)) -> list[str]:
    return [*SELL_COLUMNS, *OPEN_COLUMNS, "current_inv", *MAX_BULK_COLUMNS, *inbound_columns(weeks),
            *FORECAST_COLUMNS]


def _merge_rows(df: DataFrame, part: int, measures: Sequence[str], category: str | None = None, copies: str | None = None) -> DataFrame:
    """``df`` as rows of one form: its number, material, category, copies and measures in order."""
    return df.select(F.lit(part).alias("part"), "material", (F.col(category) if category else F.lit(None).cast("string")).alias("category"),
                       (F.col(copies) if copies else F.lit(1)).cast("bigint").alias("copies"),
                       F.array(*[F.col(m).cast("bigint") for m in measures]).alias("measures"))


def _sales_rows(sales: DataFrame) -> DataFrame:
    """Both branches of a sales row: part 2 is the trailing sell-in, part 3 the open orders."""
    sell_in = F.when(F.col("has_sell_in"), F.struct(F.lit(2).alias("part"), F.array("t4w_sellin_units").alias("measures")))
    opened = F.when(F.col("has_open"), F.struct(F.lit(3).alias("part"), F.array(*OPEN_COLUMNS).alias("measures")))
    each = sales.select("material", F.explode(F.filter(F.array(sell_in, opened), lambda r: r.isNotNull())).alias("r"))
    return each.select("r.part", "material", F.lit(None).cast("string").alias("category"), F.lit(1).cast("bigint").alias("copies"), "r.measures")


def marketing_merge(bulk: DataFrame, ats: DataFrame, sales: DataFrame, sell_thru: DataFrame, forecast: DataFrame,
                    style: DataFrame, weeks: Sequence[int] = (1, 2, 4, 8, 16), with_copies: bool = True) -> DataFrame:
    """Merged branch rows with description/model/gender from the style master, as a bag: distinct
    rows with their number of ``copies``.

    ``bulk`` is the anchor.  ``sales`` carries two branches, trailing sell-in and open orders, see
    :func:`~tradewind.operators.buckets.sales_branches`.  Category comes from the inventory branch, else
    from the style master.  Missing measures become 0; rows without any material are dropped.
    ``sell_thru`` is a bag (rows with ``copies``, see :func:`~tradewind.operators.sellthrough.sell_through`);
    its copies are carried as the multiplicity of every merged row it takes part in instead of repeating
    rows.  ``with_copies=False`` skips counting (one grouping shuffle less) for callers that only reduce
    with MAX, which ignores multiplicity.

    It is the anchored merge (:func:`anchored_outer_merge`) on rows of one form: the branches are united
    and shuffled once by material, each is computed once.
    """
    own = [list(MAX_BULK_COLUMNS), ["current_inv", *inbound_columns(weeks)], ["t4w_sellin_units"], list(OPEN_COLUMNS),
           ["t4w_sellthru_units", "retailer_onhand"], list(FORECAST_COLUMNS)]
    bulk, ats, sales, forecast = (df.where("material IS NOT NULL") for df in (bulk, ats, sales, forecast))
    # sell-through rows have a material by themselves; a filter on it would part the two reads of their weeks
    united = reduce(DataFrame.unionAll, [
        _merge_rows(bulk, 0, own[0]), _merge_rows(ats, 1, own[1], category="category"), _sales_rows(sales),
        _merge_rows(sell_thru, 4, own[4], copies="copies"), _merge_rows(forecast, 5, own[5])])
    row = F.struct("part", "category", "copies", "measures")
    lists = (united.groupBy("material")
                   .agg(*[F.collect_list(F.when(F.col("part") == i, row)).alias(f"p{i}") for i in range(len(own))]))
    parts = [f"p{i}" for i in range(len(own))]
    product = lists.where(F.size("p0") > 0)
    for p in parts:
        product = product.withColumn(p, F.explode_outer(p))
    single = lists.where(F.size("p0") == 0).select("material", F.explode(F.concat(*parts[1:])).alias("r"))
    single = single.select("material", *[F.when(F.col("r.part") == i, F.col("r")).alias(p) for i, p in enumerate(parts)])
    named = {m: F.coalesce(F.get(F.col(f"p{i}.measures"), F.lit(k)), F.lit(0).cast("bigint")) for i, ms in enumerate(own) for k, m in enumerate(ms)}
    named["t4w_retailer_onhand"] = named.pop("retailer_onhand")
    flat = product.unionAll(single).select(
        "material", F.col("p1.category").alias("a_category"), F.coalesce("p4.copies", F.lit(1).cast("bigint")).alias("_copies"),
        *[named[m].alias(m) for m in merge_columns(weeks)])
    c = (style.select(F.col("material").alias("c_m"), F.col("material_description").alias("c_description"),
                      F.col("category").alias("c_category"), "model", "gender").distinct())
    out = flat.join(c, flat["material"] == c["c_m"], "left")
    rows = out.select("material", F.col("c_description").alias("material_description"),
                      F.coalesce("a_category", "c_category").alias("category"), "model", "gender", *merge_columns(weeks), "_copies")
    keys = [c for c in rows.columns if c != "_copies"]
    if not with_copies:
        return rows.select(*keys)
    return rows.groupBy(*keys).agg(F.sum("_copies").cast("bigint").alias("copies"))


DASHBOARD_RENAMES = (
    ("t4w_sellin_units", "t4w_sellin"), ("current_month_open", "current_month_open"),
    ("open_1m", "open_1m"), ("open_2m", "open_2m"),
    ("current_month_forecast", "current_month_forecast"), ("forecast_1m", "forecast_1m"),
    ("forecast_2m", "forecast_2m"), ("t4w_sellthru_units", "t4w_sellthru"),
    ("t4w_retailer_onhand", "retailer_onhand"), ("current_inv", "current_ats"),
)


def marketing_dashboard(merged: DataFrame, weeks: Sequence[int] = (1, 2, 4, 8, 16),
                        excluded_material: str = "Other") -> DataFrame:
    """Final dashboard: drop the placeholder material and all-zero rows, then MAX per material/style.

    Grouping is on the material text; the output shows it as an integer (non-numeric -> NULL).
    A material whose category differs between inventory and style master yields two rows.
    """
    total = row_sum(merge_columns(weeks))
    pairs = [*DASHBOARD_RENAMES, *[(c, c) for c in inbound_columns(weeks)],
             *[(c, c) for c in MAX_BULK_COLUMNS]]
    # all-zero rows are left out inside the aggregate: as a filter, the sum over so many columns would be
    # rewritten for every set of their aliases when the plan is optimised
    agg = (merged.where(F.col("material") != excluded_material)
                 .groupBy("material", "material_description", "category", "model", "gender")
                 .agg(F.max(total).alias("_total"), *[F.max(F.when(total > 0, F.col(src))).cast("bigint").alias(dst) for src, dst in pairs]))
    return agg.where("_total > 0").select(safe_int("material").alias("material"), "material_description", "category",
                                          "model", "gender", *[dst for _, dst in pairs])
