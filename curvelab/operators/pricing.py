"""Canonical daily pricing table: universe, normalisation, upsert and series metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelab.functions import dates as D
from curvelab.functions import tokens as K
from curvelab.functions.units import curve_mode, finite, unit_name
from curvelab.operators.ingest import parse_date
from curvelab.scale import keep_last

PRECISION = 5


def pricing_universe(roots: DataFrame, first_year: int, last_year: int, as_of: Column, history_start: Column, history_months: int) -> DataFrame:
    """Dated contracts of monthly roots and one security per flat root.

    Short year texts that collide within a root grow digit by digit until they differ.
    Collisions are counted per root and ticker; a root has twelve contracts a year.
    """
    monthly = roots.filter(F.col("curve_mode") != "flat").withColumn(
        "contract_year", F.explode(F.sequence(F.lit(first_year), F.lit(last_year)))
    ).withColumn("month_number", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("_extra", F.lit(0))
    flat = roots.filter(F.col("curve_mode") == "flat").withColumns(
        {"contract_year": F.lit(None).cast("int"), "month_number": F.lit(0), "_extra": F.lit(0)}
    )

    def render(df: DataFrame) -> DataFrame:
        year = F.coalesce("contract_year", F.year(as_of)).cast("string")
        short = lambda width: F.right(year, F.least(F.length(year), F.greatest(F.lit(2), F.lit(width) + F.col("_extra"))))
        code = F.when(F.col("month_number") > 0, F.substring(F.lit(D.MONTH_CODES), F.col("month_number"), F.lit(1))).otherwise("")
        return df.withColumn("month_code", code).withColumn(
            "security", K.ticker(F.col("ticker_template"), F.col("root"), F.col("month_code"), year, F.col("yellow_key"), short(1), short(2))
        )

    for _ in range(3):
        group = Window.partitionBy("root", F.lower("security"))
        monthly = render(monthly).withColumn("_extra", F.col("_extra") + F.when(F.count(F.lit(1)).over(group) > 1, 1).otherwise(0))
    both = render(monthly).unionByName(render(flat))
    delivery = F.make_date("contract_year", "month_number", F.lit(1))
    is_flat = F.col("curve_mode") == "flat"
    return both.select(
        "root", "security", "common_name", "yellow_key", "native_unit", "bbl_per_mt", "gal_per_bbl", "curve_mode",
        "month_number", "month_code", "contract_year", "default_price_field",
        F.when(is_flat, "").otherwise(D.month_name(F.nullif("month_number", F.lit(0)))).alias("month"),
        F.when(is_flat, "").otherwise(F.concat("month_code", F.right(F.col("contract_year").cast("string"), F.lit(2)))).alias("contract_month_yr"),
        F.when(is_flat, history_start).otherwise(F.greatest(history_start, F.add_months(delivery, -history_months))).alias("start_date"),
        F.when(is_flat, as_of).otherwise(F.least(as_of, F.date_sub(delivery, 1))).alias("end_date"),
    )


def normalize_pricing(raw: DataFrame, universe: DataFrame, fields: Sequence[str], depth: int) -> tuple[DataFrame, DataFrame]:
    """Canonical rows and the counts of what was left out.

    Known securities only (any case), inside their observation dates and reference
    depth; a root's preferred field replaces PX_LAST where it has a value.
    """
    frame = raw.withColumns({"_key": F.lower(F.trim("security")), "date": parse_date(F.col("date"))})
    known = universe.withColumn("_key", F.lower("security")).withColumnRenamed("security", "security_str")
    joined = frame.drop("security").join(known, "_key", "left")
    inside = F.col("security_str").isNotNull() & F.col("date").between(F.col("start_date"), F.col("end_date"))
    reference = F.when(F.col("curve_mode") == "flat", 1).otherwise(D.nearest_reference(F.col("date"), F.col("month_number"), F.col("contract_year")))
    preferred = F.when(F.lit(False), F.lit(0.0))
    for f in fields:
        preferred = preferred.when(F.col("default_price_field") == f, finite(F.col(f)))
    values = {f: F.round(finite(F.col(f)), PRECISION) for f in fields}
    values["PX_LAST"] = F.round(F.coalesce(preferred, finite(F.col("PX_LAST"))), PRECISION)
    shaped = joined.withColumns({"_inside": inside, "reference": reference}).withColumns({f"_n_{f}": v for f, v in values.items()}).drop(*fields)
    shaped = shaped.withColumnsRenamed({f"_n_{f}": f for f in fields})
    in_depth = F.col("reference").between(1, depth)
    skipped = shaped.agg(
        F.count_distinct(F.when(F.col("security_str").isNull(), F.col("_key"))).alias("unknown_securities"),
        F.count_if(F.col("_inside") & ~in_depth).alias("outside_depth"),
        F.count_if(F.col("_inside") & in_depth & F.col("PX_LAST").isNull()).alias("missing_last"),
    )
    kept = shaped.filter(F.col("_inside") & in_depth & F.col("PX_LAST").isNotNull())
    rows = keep_last(kept, ["date", "security_str"], "ingest_seq").withColumns(
        {"frequency": F.when(F.col("curve_mode") == "flat", "Flat").otherwise("Monthly"), "year": F.year("date")}
    )
    return rows, skipped


def upsert_pricing(existing: DataFrame, pulled: DataFrame, universe: DataFrame) -> DataFrame:
    """Pulled rows over stored ones by (date, security); metadata comes from the universe again."""
    from curvelab.operators.ingest import upsert

    merged = upsert(existing, pulled, ["date", "security_str"])
    metadata = universe.select(F.col("security").alias("security_str"), "root", "contract_year", "month", "contract_month_yr", "native_unit")
    return merged.drop("root", "contract_year", "month", "contract_month_yr", "native_unit").join(metadata, "security_str")


def root_statistics(rows: DataFrame, root: str = "root", security: str = "security_str", day: str = "date") -> DataFrame:
    """Rows, securities and date range per root; counted per security first."""
    per_security = rows.groupBy(root, security).agg(F.count(F.lit(1)).alias("_n"), F.min(day).alias("_a"), F.max(day).alias("_b"))
    return per_security.groupBy(root).agg(
        F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("securities"), F.min("_a").alias("min_date"), F.max("_b").alias("max_date")
    )


def series_catalog(rows: DataFrame) -> DataFrame:
    """One row per series key with its year range and first known factors."""
    return rows.groupBy(
        F.concat_ws("::", "root", "month", F.col("reference").cast("string")).alias("series_key"), "root", "month", "reference"
    ).agg(
        F.min("plot_year").alias("first_year"),
        F.max("plot_year").alias("last_year"),
        F.count(F.lit(1)).alias("points"),
        F.min_by("bbl_per_mt", F.when(F.col("bbl_per_mt").isNotNull(), F.col("date"))).alias("bbl_per_mt"),
    )


def resolve_aliases(values: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """Root of a code or one of its aliases."""
    names = roots.select(
        "root", F.explode(F.array_union(F.array("root"), F.split(F.coalesce("aliases", F.lit("")), r"\|"))).alias("_name")
    ).select("root", F.upper(F.trim("_name")).alias("_name")).filter(F.col("_name") != "").distinct()
    return values.withColumn("_name", F.upper(F.trim(column))).join(names, "_name", "left").drop("_name")


def apply_root_config(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Configured names and factors win over the data; a root nobody configured is an error."""
    known = roots.select(
        F.col("root").alias("_root"), "enabled", "common_name", F.col("bbl_per_mt").alias("_bbl"), F.col("gal_per_bbl").alias("_gal")
    )
    joined = rows.join(known, F.upper(F.trim("root")) == F.col("_root"), "left")
    message = F.concat(F.lit("root is not configured: "), F.coalesce("root", F.lit("null")))
    checked = joined.filter(F.when(F.col("_root").isNotNull(), F.col("enabled")).otherwise(F.raise_error(message).cast("boolean")))
    return checked.withColumns(
        {"bbl_per_mt": F.coalesce("_bbl", "bbl_per_mt"), "gal_per_bbl": F.coalesce("_gal", "gal_per_bbl")}
    ).drop("_root", "_bbl", "_gal", "enabled")


def root_config_issues(roots: DataFrame) -> DataFrame:
    """(row, issue) for a root table; the table is configuration, a few rows."""
    c = F.col
    root = F.upper(F.trim(F.coalesce("root", F.lit(""))))
    template = F.coalesce("ticker_template", F.lit(""))
    flat = curve_mode(c("curve_mode")) == "flat"
    year_token = template.rlike(r"\{(y|year_1d|year_digit|yy|year_2d|year|yyyy)\}")
    positive = lambda name: finite(c(name)) > 0
    tests = {
        "root is required": root == "",
        "root contains unsupported characters": (root != "") & ~root.rlike(r"^[A-Z0-9]+$"),
        "common_name is required": F.trim(F.coalesce("common_name", F.lit(""))) == "",
        "yellow_key must be Comdty or Index": ~F.lower(F.trim(F.coalesce("yellow_key", F.lit("")))).isin("comdty", "index"),
        "native_unit is not known": unit_name(c("native_unit")) == "",
        "bbl_per_mt must be positive": ~F.coalesce(positive("bbl_per_mt"), F.lit(False)),
        "gal_per_bbl must be positive": ~F.coalesce(positive("gal_per_bbl"), F.lit(False)),
        "ticker_template misses {root}": ~template.contains("{root}"),
        "ticker_template misses {yellow_key}": ~template.contains("{yellow_key}"),
        "ticker_template misses {month_code}": ~flat & ~template.contains("{month_code}"),
        "ticker_template misses a year token": ~flat & ~year_token,
        "default_price_field and time_zone_override go together": (F.coalesce("default_price_field", F.lit("")) != "") != c("time_zone_override").isNotNull(),
    }
    checks = F.array(*[F.when(test, F.lit(issue)) for issue, test in tests.items()])
    rows = roots.select("row_number", F.explode(F.array_compact(checks)).alias("issue"))
    first = Window.partitionBy("_root").orderBy("row_number")
    duplicates = (
        roots.withColumn("_root", root).filter(c("_root") != "").withColumn("_n", F.row_number().over(first)).filter(c("_n") > 1)
        .select("row_number", F.lit("duplicate root").alias("issue"))
    )
    owned = roots.select("row_number", root.alias("_root"), F.explode(F.split(F.coalesce("aliases", F.lit("")), r"\|")).alias("_alias")).select(
        "row_number", "_root", F.upper(F.trim("_alias")).alias("_alias")
    ).filter((c("_alias") != "") & (c("_alias") != c("_root")))
    first_owner = owned.groupBy("_alias").agg(F.min_by("_root", "row_number").alias("_owner"))
    shared = owned.join(first_owner, "_alias").filter(c("_root") != c("_owner")).select("row_number", F.lit("alias is already assigned").alias("issue"))
    codes = roots.select(root.alias("_alias")).distinct()
    clash = owned.join(codes, "_alias", "left_semi").select("row_number", F.lit("alias collides with a root").alias("issue"))
    nobody = roots.agg(F.count_if(F.coalesce("enabled", F.lit(False))).alias("_n")).filter(c("_n") == 0).select(F.lit(0).alias("row_number"), F.lit("no enabled roots").alias("issue"))
    return rows.unionByName(duplicates).unionByName(shared).unionByName(clash).unionByName(nobody)


def contract_fingerprint(roots: DataFrame, settings: Column) -> DataFrame:
    """One hash over the pull settings and the enabled roots, order-independent."""
    shown = ["root", "yellow_key", "ticker_template", "curve_mode", "default_price_field"]
    row = F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in shown])
    return roots.filter("enabled").agg(F.sha2(F.concat_ws("|", settings, F.array_join(F.sort_array(F.collect_list(row)), "|")), 256).alias("fingerprint"))


def full_refresh_reason(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Why everything must be pulled again; empty text where nothing changed."""
    old = previous.select("fingerprint").scalar()
    return current.select(
        "fingerprint",
        F.when(old.isNull(), "update manifest is missing")
        .when(F.col("fingerprint") != old, "pull configuration changed")
        .otherwise("")
        .alias("reason")
    )
