"""Seasonal curves, units, tokens and value at risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelab.edge import settle, settle_sql
from curvelab.functions import dates as D
from curvelab.functions import tokens as K
from curvelab.functions import units as U
from curvelab.operators import curves as CV
from curvelab.operators import risk as R
from curvelab.queries.ctes import CURVE, DBARS
from curvelab.registry import query
from curvelab.sources import views

_LEAP = "(year(day) % 4 = 0 AND (year(day) % 100 <> 0 OR year(day) % 400 = 0))"
_X = f"(dayofyear(day) + CASE WHEN NOT {_LEAP} AND month(day) > 2 THEN 1 ELSE 0 END)::INT"
_CV = f"{CURVE}, cv AS (SELECT series, year(day) AS year, {_X} AS x, value, n FROM curve)"
#: Years that the order table spans; an export has one column for each.
_YEARS = tuple(range(1995, 2002))
_SERIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
#: One structure per series: it, twice the next one against it, and the one after.
_LEGS = tuple((name, _SERIES[(i + k) % 5], r) for i, name in enumerate(_SERIES) for k, r in enumerate((1.0, -2.0, 1.0)))
_LEG_VALUES = "l(structure, leg, ratio) AS (VALUES " + ", ".join(f"('{s}', '{g}', {r})" for s, g, r in _LEGS) + ")"
#: Month in which a structure's contract rolls; none for the last two.
_ROLL = {"1-URGENT": 7, "2-HIGH": 1, "3-MEDIUM": 3}


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.curve(spark, sf_dir).select(
        "series", F.year("day").alias("year"), D.leap_axis_day(F.col("day")).alias("x"), "value", "n"
    )


def _legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The legs of all structures: (structure, leg, ratio, year, x, value, n)."""
    legs = spark.createDataFrame(_LEGS, "structure string, leg string, ratio double")
    return legs.join(yearly(spark, sf_dir).withColumnRenamed("series", "leg"), "leg")


@query(
    "season_axis_days",
    f"""WITH q AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, ascii(o_orderpriority) - 48 AS m FROM orders), a AS (SELECT *, {_X} AS x FROM q),
      p AS (SELECT *, year(day) + 1 + CASE WHEN month(day) >= m THEN 1 ELSE 0 END AS py FROM a)
      SELECT strftime(day, '%Y-%m-%d') AS day, m AS roll_month, x AS leap_day, py AS plot_year, x + CASE WHEN m > 1 AND year(day) = py - 1 THEN 366 ELSE 0 END AS season_day,
        1999 - (year(day) + CASE WHEN month(day) >= m THEN 1 ELSE 0 END) + 1 AS reference FROM p""",
)
def season_axis_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leap axis, plot year, cycle day and reference of every order day."""
    days = views.table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("day"), F.substring("o_orderpriority", 1, 1).cast("int").alias("roll_month")
    ).distinct()
    year = D.plot_year(F.col("day"), F.lit(2), F.col("roll_month"))
    return settle(days.select(
        "day", "roll_month", D.leap_axis_day(F.col("day")).alias("leap_day"), year.alias("plot_year"),
        D.season_axis_day(F.col("day"), year, F.lit(2), F.col("roll_month")).alias("season_day"),
        D.nearest_reference(F.col("day"), F.col("roll_month"), F.lit(1999)).alias("reference"),
    ))


def _fill_sql(source: str, keys: str, span: int) -> str:
    """Bounded interpolation of a CTE with an ``asked`` flag."""
    return f"""{source}_n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER b AS bx, last_value(v IGNORE NULLS) OVER b AS bv,
   first_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER a AS ax, first_value(v IGNORE NULLS) OVER a AS av FROM {source}
   WINDOW b AS (PARTITION BY {keys} ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY {keys} ORDER BY x ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
{source}_f AS (SELECT *, coalesce(v, CASE WHEN ax - bx <= {span} THEN round(bv + (av - bv) * ((x - bx) / (ax - bx)), 5) END) AS y, v IS NULL AND ax - bx <= {span} AS ip FROM {source}_n)"""


@query(
    "interpolate_bounded",
    f"""WITH {_CV}, e AS (SELECT series, year, min(x) AS lo, max(x) AS hi FROM cv GROUP BY ALL), g AS (SELECT series, year, unnest(range(lo, hi + 1))::INT AS x FROM e),
      j AS (SELECT g.*, value AS v FROM g LEFT JOIN cv USING (series, year, x)), {_fill_sql('j', 'series, year', 7)}
      SELECT series, year, x, round(y, 5) + 0.0 AS value, CAST(coalesce(ip, false) AS BIGINT) AS interpolated FROM j_f""",
)
def interpolate_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day of each yearly series, gaps up to a week bridged."""
    return settle(CV.densify(yearly(spark, sf_dir), ["series", "year"]), dp=5)


_COMBINED = f"""{_CV}, {_LEG_VALUES}, o AS (SELECT structure, series AS leg, year, x, value, ratio FROM cv JOIN l ON series = leg),
  t AS (SELECT DISTINCT structure, year, x FROM o), j AS (SELECT l.structure, l.leg, l.ratio, t.year, t.x, o.value AS v FROM t JOIN l ON l.structure = t.structure LEFT JOIN o ON o.structure = l.structure AND o.leg = l.leg AND o.year = t.year AND o.x = t.x),
  {_fill_sql('j', 'structure, leg, year', 7)}, cw AS (SELECT structure, year, x, round(sum(ratio * y), 5) AS value, count(*) FILTER (ip) AS interpolated_legs FROM j_f GROUP BY structure, year, x HAVING count(y) = 3)"""


@query("weighted_legs", f"WITH {_COMBINED} SELECT structure, year, x, value + 0.0 AS value, interpolated_legs FROM cw")
def weighted_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three weighted legs of every structure on the union of their days."""
    return settle(CV.combine_weighted(_legs(spark, sf_dir), 3, ["structure", "year"]), dp=5)


_STARTS = "(0, 1), (1, 32), (2, 61), (3, 92), (4, 122), (5, 153), (6, 183), (7, 214), (8, 245), (9, 275), (10, 306), (11, 336)"
_CYCLE = f"""{_COMBINED}, rm(structure, roll) AS (VALUES {', '.join(f"('{s}', {_ROLL.get(s, 'NULL')})" for s in _SERIES)}), st(m, start) AS (VALUES {_STARTS}),
  cc AS (SELECT cw.*, roll FROM cw JOIN rm USING (structure) LEFT JOIN st ON m = roll - 1 WHERE roll IS NULL OR x BETWEEN start AND start + 365),
  pa AS (SELECT *, CASE WHEN (x - 1) % 366 + 1 <> 60 THEN (x - 1) // 366 * 365 + (x - 1) % 366 + 1 - ((x - 1) % 366 + 1 > 60)::INT END AS pd FROM cc),
  ae AS (SELECT structure, year, (max(pd) - 1) % 365 + 1 AS end_day FROM pa GROUP BY ALL)"""


def _cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = spark.createDataFrame([(s, _ROLL.get(s)) for s in _SERIES], "structure string, roll_month int")
    return CV.combine_weighted(_legs(spark, sf_dir), 3, ["structure", "year"]).join(months, "structure")


@query(
    "combined_cycle",
    f"WITH {_CYCLE} SELECT structure, year, x, value + 0.0 AS value, end_day FROM cc JOIN ae USING (structure, year)",
)
def combined_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined legs clipped to their contract's cycle, with the axis end of each year."""
    clipped = CV.clip_cycle(_cycles(spark, sf_dir), F.col("roll_month"))
    ends = CV.axis_end(clipped, ["structure", "year"])
    return settle(clipped.join(ends, ["structure", "year"]).select("structure", "year", "x", "value", "end_day"), dp=5)


@query(
    "season_anchor",
    f"""WITH {_CYCLE}, e2 AS (SELECT series AS structure, year, (max(CASE WHEN x <> 60 THEN x - (x > 60)::INT END) - 1) % 365 + 1 AS end_day FROM cv GROUP BY ALL),
      a AS (SELECT structure, arg_max(end_day, year) AS ax FROM ae WHERE structure <> '5-LOW' GROUP BY 1), z AS (SELECT structure, arg_max(end_day, year) AS sx FROM e2 GROUP BY 1),
      k AS (SELECT structure, CASE roll WHEN 1 THEN 365 WHEN 3 THEN 59 WHEN 7 THEN 181 END AS ca FROM rm),
      n AS (SELECT structure, coalesce(ca, ax, sx) AS anchor, CASE WHEN ca IS NOT NULL THEN 'CONTRACT' WHEN ax IS NOT NULL THEN 'AXIS_END' ELSE 'SERIES_END' END AS source FROM k LEFT JOIN a USING (structure) LEFT JOIN z USING (structure)),
      p AS (SELECT series, year, value, anchor, source, CASE WHEN x <> 60 THEN x - (x > 60)::INT END AS pd FROM cv JOIN n ON structure = series), r AS (SELECT *, CASE WHEN pd - anchor <= 0 THEN pd - anchor + 365 ELSE pd - anchor END AS dd FROM p WHERE pd IS NOT NULL),
      b AS (SELECT *, CASE WHEN lag(dd) OVER w IS NULL OR dd - lag(dd) OVER w > 7 THEN 1 ELSE 0 END AS brk FROM r WINDOW w AS (PARTITION BY series, year ORDER BY dd)),
      u AS (SELECT *, sum(brk) OVER (PARTITION BY series, year ORDER BY dd) AS run FROM b), s AS (SELECT series, year, run, count(*) AS n, min(dd) AS st FROM u GROUP BY ALL),
      g AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY series, year ORDER BY n DESC, st) = 1)
      SELECT u.series, u.year, anchor::BIGINT AS anchor, source, u.dd AS day, round(u.value, 4) AS value FROM u JOIN g USING (series, year, run)""",
)
def season_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The season axis on the anchor that comes first: contract, axis end, series end."""
    rows = yearly(spark, sf_dir).drop("n")
    months = spark.createDataFrame([(s, _ROLL.get(s)) for s in _SERIES], "series string, roll_month int")
    clipped = CV.clip_cycle(_cycles(spark, sf_dir), F.col("roll_month")).filter(F.col("structure") != "5-LOW")
    ends = CV.axis_end(clipped, ["structure", "year"]).withColumnRenamed("structure", "series")
    anchored = rows.join(CV.season_anchor(rows, months, ends), "series")
    out = CV.season_axis(anchored, ["series", "year", "anchor", "source"], F.col("anchor"))
    return settle(out.select("series", "year", "anchor", "source", "day", "value"), dp=4)


_MONTHS = "['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun']"


@query(
    "derived_legs",
    f"""WITH m AS (SELECT o_orderpriority AS series, {_MONTHS}[o_orderkey % 6 + 1] AS month, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) / 1.07 AS value FROM orders GROUP BY ALL),
      c AS (SELECT series, month, year(day) AS year, {_X} AS x, value FROM m), p AS (SELECT *, unnest([CASE WHEN month IN ('Jan', 'Feb', 'Mar') THEN 'Q1' ELSE 'Q2' END, 'Half 1']) AS period, unnest([3, 6]) AS need FROM c),
      t AS (SELECT DISTINCT series, year, period, need, x FROM p), g AS (SELECT DISTINCT series, year, period, need, month FROM p),
      j AS (SELECT t.*, g.month, p.value AS v FROM t JOIN g USING (series, year, period, need) LEFT JOIN p ON p.series = t.series AND p.year = t.year AND p.period = t.period AND p.month = g.month AND p.x = t.x),
      {_fill_sql('j', 'series, period, month, year', 7)}
      SELECT series, year, period, x, round(sum(y / need), 5) + 0.0 AS value, count(*) FILTER (ip) AS interpolated_legs FROM j_f GROUP BY series, year, period, need, x HAVING count(y) = need""",
)
def derived_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter and half legs as means of interpolated months."""
    month = F.get(F.array(*[F.lit(m) for m in ("Jan", "Feb", "Mar", "Apr", "May", "Jun")]), (F.col("o_orderkey") % 6).cast("int"))
    daily = views.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), month.alias("month"), F.to_date("o_orderdate").alias("day")).agg((F.avg("o_totalprice") / 1.07).alias("value"))
    monthly = daily.select("series", "month", F.year("day").alias("year"), D.leap_axis_day(F.col("day")).alias("x"), "value")
    return settle(CV.derived_legs(monthly, ["series", "year"]), dp=5)


@query(
    "price_fields",
    f"""WITH {DBARS}, f AS (SELECT entity, session_date, close AS px_last, CASE WHEN day(session_date) % 7 <> 0 THEN close * 0.99 END AS px_settle FROM dbars)
      SELECT entity, strftime(session_date, '%Y-%m-%d') AS session_date, field, round(CASE field WHEN 'PX_LAST' THEN px_last WHEN 'PX_SETTLE' THEN px_settle END, 6) AS value FROM f, (VALUES ('PX_LAST'), ('PX_SETTLE'), ('PX_FAIR_1430')) v(field)""",
)
def price_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each price field as its own series: a missing settle, or a field that was never delivered, stays missing."""
    rows = views.day_bars(spark, sf_dir).select("entity", "session_date", F.col("close").alias("PX_LAST"), F.when(F.dayofmonth("session_date") % 7 != 0, F.col("close") * 0.99).alias("PX_SETTLE"))
    out = None
    for field in ("PX_LAST", "PX_SETTLE", "PX_FAIR_1430"):
        one = CV.field_series(rows, field, ["PX_LAST", "PX_SETTLE"]).select("entity", "session_date", F.lit(field).alias("field"), "value")
        out = one if out is None else out.unionByName(one)
    return settle(out)


_MIXED = "CASE a WHEN 'cpg' THEN v / 100 WHEN '$/gal' THEN v WHEN '$/bbl' THEN v / 42 WHEN '$/MT' THEN v / (mt * 42) END"


@query(
    "mixed_unit_sum",
    f"""WITH u AS (SELECT p_brand AS structure, p_partkey AS leg, p_retailprice AS v, CASE WHEN p_partkey % 97 = 0 THEN 'EUR/t' ELSE ['cpg', '$/gal', '$/bbl', '$/MT'][p_partkey % 4 + 1] END AS a, p_size % 3 - 1 AS ratio, 7.0 + (p_size % 9) / 10.0 AS mt, p_size AS grp FROM part),
      g AS (SELECT structure, grp, CASE WHEN ratio = 0 THEN 0.0::DOUBLE ELSE ratio * CASE WHEN a = '$/bbl' THEN v ELSE round(({_MIXED}) * 42, 5) END END AS part FROM u)
      SELECT structure, grp, count(*) AS legs, CASE WHEN count(part) = count(*) THEN round(round(sum(part), 5), 3) + 0.0 END AS value FROM g GROUP BY ALL""",
)
def mixed_unit_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs in four units summed in $/bbl; ratio 0 is skipped, and an unknown unit leaves no sum."""
    names = F.array(*[F.lit(u) for u in ("cpg", "$/gal", "$/bbl", "$/MT")])
    unit = F.when(F.col("p_partkey") % 97 == 0, "EUR/t").otherwise(F.get(names, (F.col("p_partkey") % 4).cast("int")))
    legs = views.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("structure"), F.col("p_size").alias("grp"), F.col("p_retailprice").alias("value"), unit.alias("native_unit"), (F.col("p_size") % 3 - 1).cast("double").alias("ratio"),
        (7.0 + (F.col("p_size") % 9) / 10.0).alias("bbl_per_mt"), F.lit(42.0).alias("gal_per_bbl"),
    )
    counts = legs.groupBy("structure", "grp").agg(F.count(F.lit(1)).alias("legs"))
    return settle(CV.weighted_sum(legs, ["structure", "grp"], "$/bbl").join(counts, ["structure", "grp"]), dp=3)


@query(
    "raw_periods_dropped",
    """WITH r AS (SELECT p_brand AS root, year(l_shipdate) AS reference, CASE WHEN l_linenumber = 7 THEN 'Quarterly' WHEN l_linenumber = 6 THEN 'Half' WHEN p_size % 4 <> 0 THEN 'Monthly' ELSE 'Quarterly' END AS frequency, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey WHERE true),
      s AS (SELECT root || CASE WHEN q > 45 THEN 'x' ELSE '' END AS root, reference, frequency, q FROM r), m AS (SELECT DISTINCT root, reference FROM s WHERE frequency = 'Monthly')
      SELECT root, reference, frequency, count(*) AS rows FROM s LEFT JOIN m USING (root, reference) WHERE frequency = 'Monthly' OR m.root IS NULL GROUP BY ALL""".replace("LEFT JOIN m USING (root, reference) WHERE frequency = 'Monthly' OR m.root IS NULL", "WHERE frequency = 'Monthly' OR (root, reference) NOT IN (SELECT (root, reference) FROM m)"),
)
def raw_periods_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered quarter and half rows give way where the root has monthly rows of the reference."""
    part = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    number = F.col("l_linenumber")
    rows = views.table(spark, sf_dir, "lineitem").join(part, "l_partkey").select(
        F.concat("p_brand", F.when(F.col("l_quantity") > 45, "x").otherwise("")).alias("root"), F.year("l_shipdate").alias("reference"),
        F.when(number == 7, "Quarterly").when(number == 6, "Half").when(F.col("p_size") % 4 != 0, "Monthly").otherwise("Quarterly").alias("frequency"),
    )
    return settle(CV.drop_raw_periods(rows, ["root", "reference"]).groupBy("root", "reference", "frequency").agg(F.count(F.lit(1)).alias("rows")))


@query("volume_shared", f"WITH {_CV}, {_LEG_VALUES} SELECT structure, year, x, sum(n)::DOUBLE AS n FROM cv JOIN l ON leg = series GROUP BY ALL HAVING count(*) = 3")
def volume_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order counts where all legs of a structure have the day."""
    return settle(CV.sum_on_shared(_legs(spark, sf_dir), 3, ["structure", "year"], value="n"))


@query(
    "longest_run",
    f"""WITH {_CV}, b AS (SELECT *, CASE WHEN lag(x) OVER w IS NULL OR x - lag(x) OVER w > 1 THEN 1 ELSE 0 END AS brk FROM cv WINDOW w AS (PARTITION BY series, year ORDER BY x)),
      r AS (SELECT *, sum(brk) OVER (PARTITION BY series, year ORDER BY x) AS run FROM b), s AS (SELECT series, year, run, count(*) AS n, min(x) AS st, max(x) AS en FROM r GROUP BY ALL)
      SELECT series, year, st AS first_x, en AS last_x, n AS points FROM s QUALIFY row_number() OVER (PARTITION BY series, year ORDER BY n DESC, st) = 1""",
)
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest unbroken stretch of days per yearly series."""
    run = CV.longest_run(yearly(spark, sf_dir), ["series", "year"], max_span=1)
    return settle(run.groupBy("series", "year").agg(F.min("x").alias("first_x"), F.max("x").alias("last_x"), F.count(F.lit(1)).alias("points")))


@query(
    "quarter_half_strips",
    """WITH m AS (SELECT p_brand AS root, l_returnflag AS flag, year(l_shipdate) AS y, month(l_shipdate) AS mo, avg(l_extendedprice) / 1.01 AS px, sum(l_quantity) AS vol FROM lineitem JOIN part ON l_partkey = p_partkey
        GROUP BY ALL),
      q AS (SELECT root, flag, y, 'Q' || ((mo + 2) // 3) AS period, 'Quarterly' AS frequency, sum(px) / 3 AS px, sum(vol) / 3 AS vol FROM m GROUP BY ALL HAVING count(*) = 3),
      h AS (SELECT root, flag, y, 'Half ' || ((mo + 5) // 6) AS period, 'Half' AS frequency, sum(px) / 6 AS px, sum(vol) / 6 AS vol FROM m GROUP BY ALL HAVING count(*) = 6)
      SELECT root, flag, y, period, frequency, round(px, 6) AS px, round(vol, 6) AS vol FROM (SELECT * FROM q UNION ALL SELECT * FROM h)""",
)
def quarter_half_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips from complete months only."""
    part = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("root"))
    monthly = (
        views.table(spark, sf_dir, "lineitem").join(part, "l_partkey")
        .groupBy("root", F.col("l_returnflag").alias("flag"), F.year("l_shipdate").alias("y"), D.month_name(F.month("l_shipdate")).alias("month"))
        .agg((F.avg("l_extendedprice") / 1.01).alias("px"), F.sum("l_quantity").alias("vol"))
    )
    return settle(CV.strips(monthly, ["root", "flag", "y"], ["px", "vol"]))


_UNITS = "['cpg', '$/gal', '$/bbl', '$/MT']"


@query(
    "unit_convert",
    f"""WITH p AS (SELECT p_partkey, p_retailprice AS v, {_UNITS}[p_partkey % 4 + 1] AS a, {_UNITS}[p_size % 4 + 1] AS b, 7.0 + (p_size % 9) / 10.0 AS mt FROM part),
      g AS (SELECT *, CASE a WHEN 'cpg' THEN v / 100 WHEN '$/gal' THEN v WHEN '$/bbl' THEN v / 42 ELSE v / (mt * 42) END AS gal FROM p)
      SELECT p_partkey, a AS source_unit, b AS target_unit, round(CASE WHEN a = b THEN v WHEN b = 'cpg' THEN gal * 100 WHEN b = '$/gal' THEN gal WHEN b = '$/bbl' THEN gal * 42 ELSE gal * 42 * mt END, 5) + 0.0 AS converted FROM g""",
)
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices moved between cpg, $/gal, $/bbl and $/MT."""
    names = F.array(*[F.lit(u) for u in U.UNITS])
    parts = views.table(spark, sf_dir, "part").select(
        "p_partkey", F.get(names, (F.col("p_partkey") % 4).cast("int")).alias("source_unit"), F.get(names, F.col("p_size") % 4).alias("target_unit"),
        "p_retailprice", (7.0 + (F.col("p_size") % 9) / 10.0).alias("mt"),
    )
    return settle(parts.select("p_partkey", "source_unit", "target_unit", U.convert(
        F.col("p_retailprice"), F.col("source_unit"), F.col("target_unit"), F.col("mt"), F.lit(42.0)
    ).alias("converted")), dp=5)


@query(
    "token_parse",
    """WITH t AS (SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN 'HO' || substr('FGHJKMNQUVXZ', p_size % 12 + 1, 1) || lpad((p_size * 2 % 100)::VARCHAR, 2, '0') || ' Comdty'
         WHEN 1 THEN ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][p_size % 12 + 1] || ' ' || lpad((p_size * 2 % 100)::VARCHAR, 2, '0')
         WHEN 2 THEN substr('FGHJKMNQUVXZ', p_size % 12 + 1, 1) || lpad((p_size * 2 % 100)::VARCHAR, 2, '0') ELSE 'SPOT Index' END AS token FROM part)
      SELECT p_partkey, token, CASE WHEN p_partkey % 4 < 3 THEN ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][p_size % 12 + 1] END AS month,
        CASE WHEN p_partkey % 4 < 3 THEN p_size * 2 % 100 + CASE WHEN p_size * 2 % 100 < 70 THEN 2000 ELSE 1900 END END AS year,
        CASE p_partkey % 4 WHEN 0 THEN 'HO' WHEN 1 THEN upper(token[1:3]) WHEN 2 THEN token[1:1] ELSE 'SPOT' END AS root FROM t""",
)
def token_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month, year and root read from contract texts built on parts."""
    code = F.substring(F.lit(D.MONTH_CODES), F.col("p_size") % 12 + 1, F.lit(1))
    name = D.month_name(F.col("p_size") % 12 + 1)
    two = F.lpad((F.col("p_size") * 2 % 100).cast("string"), 2, "0")
    kind = F.col("p_partkey") % 4
    token = F.when(kind == 0, F.concat(F.lit("HO"), code, two, F.lit(" Comdty"))).when(kind == 1, F.concat_ws(" ", name, two)).when(kind == 2, F.concat(code, two)).otherwise("SPOT Index")
    rows = views.table(spark, sf_dir, "part").select("p_partkey", token.alias("token"))
    return settle(rows.select("p_partkey", "token", K.contract_month(F.col("token")).alias("month"), K.contract_year(F.col("token")).alias("year"), K.root_code(F.col("token")).alias("root")))


@query(
    "merge_references",
    f"""WITH {_CV}, s AS (SELECT year, x + (2 - r) * 366 AS x, value, r FROM (SELECT *, ascii(series) - 48 AS r FROM cv))
      SELECT year, x, round(arg_max(value, r), 4) AS value FROM s GROUP BY ALL""",
)
def merge_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sibling references on one axis."""
    segments = yearly(spark, sf_dir).withColumn("reference", F.substring("series", 1, 1).cast("int"))
    return settle(CV.merge_references(segments, F.lit(2), ["year"]), dp=4)


@query(
    "flat_curve_align",
    f"""WITH {_CV}, y AS (SELECT DISTINCT series AS leg, year, ascii(series) - 48 AS step FROM cv), c AS (SELECT cv.*, s.b FROM cv, (VALUES (1, 1), (4, 92), (7, 183), (10, 275)) s(m, b)),
      a AS (SELECT series AS flat, b, year + 1 AS year, x, value FROM c WHERE x >= b UNION ALL SELECT series, b, year, x + 366, value FROM c WHERE x < b AND b > 1)
      SELECT flat, b AS boundary, year, count(*) AS points, round(sum(value), 2) AS total FROM a WHERE year IN (SELECT year FROM y WHERE leg = flat) GROUP BY ALL""",
)
def flat_curve_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every curve, as a monthless one, cut into its own years at four roll months."""
    rows = yearly(spark, sf_dir)
    flat = rows.select(F.col("series").alias("flat"), "year", "x", "value")
    years = flat.select("flat", "year").distinct()
    out = None
    for month, boundary in ((1, 1), (4, 92), (7, 183), (10, 275)):
        cut = CV.align_flat_curve(flat, years, month, keys=["flat"]).withColumn("boundary", F.lit(boundary))
        out = cut if out is None else out.unionByName(cut)
    return settle(out.groupBy("flat", "boundary", "year").agg(F.count(F.lit(1)).alias("points"), F.sum("value").alias("total")), dp=2)


@query(
    "flat_curve_align_all",
    f"""WITH {_CV}, y AS (SELECT DISTINCT series AS leg, year FROM cv),
      a AS (SELECT series AS flat, year + 1 AS year, x, value FROM cv WHERE x >= 183 UNION ALL SELECT series, year, x + 366, value FROM cv WHERE x < 183)
      SELECT flat, leg, year, x, round(value, 4) AS value FROM a JOIN y USING (year) WHERE flat <> leg""",
)
def flat_curve_align_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every curve, as a monthless one, cut at July into the years of every other leg."""
    rows = yearly(spark, sf_dir)
    flat = rows.select(F.col("series").alias("flat"), "year", "x", "value")
    years = rows.select(F.col("series").alias("leg"), "year").distinct()
    # Which curve stands beside which leg is configuration, as in a user's leg table.
    pairs = spark.createDataFrame([(a, b) for a in _SERIES for b in _SERIES if a != b], "flat string, leg string")
    aligned = CV.align_flat_curve(flat.join(pairs, "flat"), years, 7, keys=["leg"])
    return settle(aligned.select("flat", "leg", "year", "x", "value"), dp=4)


@query(
    "season_axis",
    f"""WITH {_CV}, p AS (SELECT *, CASE WHEN x <> 60 THEN x - (x > 60)::INT END AS pd FROM cv), r AS (SELECT *, CASE WHEN pd - 181 <= 0 THEN pd - 181 + 365 ELSE pd - 181 END AS dd FROM p WHERE pd IS NOT NULL),
      b AS (SELECT *, CASE WHEN lag(dd) OVER w IS NULL OR dd - lag(dd) OVER w > 7 THEN 1 ELSE 0 END AS brk FROM r WINDOW w AS (PARTITION BY series, year ORDER BY dd)),
      u AS (SELECT *, sum(brk) OVER (PARTITION BY series, year ORDER BY dd) AS run FROM b), s AS (SELECT series, year, run, count(*) AS n, min(dd) AS st FROM u GROUP BY ALL),
      k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY series, year ORDER BY n DESC, st) = 1)
      SELECT u.series, u.year, u.dd AS day, round(u.value, 4) AS value FROM u JOIN k USING (series, year, run)""",
)
def season_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotated 365-day display axis with its longest run."""
    out = CV.season_axis(yearly(spark, sf_dir).drop("n"), ["series", "year"], CV.anchor_day(F.lit(7)))
    return settle(out.select("series", "year", "day", "value"), dp=4)


@query(
    "derived_window",
    """WITH k AS (SELECT DISTINCT o_orderpriority AS key, 'Q' || ((month(o_orderdate) + 2) // 3) AS p FROM orders WHERE month(o_orderdate) BETWEEN 1 AND 3 UNION SELECT DISTINCT o_orderpriority, 'H1' FROM orders)
      SELECT DISTINCT key, 1 AS start_day, 91 AS days, 91 AS end_day FROM k""",
)
def derived_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days shared by the first quarter and the first half on the ring."""
    orders = views.table(spark, sf_dir, "orders")
    quarter = orders.filter(F.month("o_orderdate") <= 3).select(F.col("o_orderpriority").alias("key"), F.lit("Quarter 1").alias("period"))
    half = orders.select(F.col("o_orderpriority").alias("key"), F.lit("H1").alias("period"))
    return settle(CV.derived_window(quarter.unionByName(half)))


@query(
    "month_adjustment",
    f"WITH {_CV} SELECT series, year, x, round(value * (1 + (3 - 6.5) * 0.004) + avg(value) OVER (PARTITION BY series, year) * 0.01 * sin(3 / 12.0 * 2 * pi()), 5) AS value FROM cv",
)
def month_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series shifted to March by the month heuristic."""
    out = CV.month_adjustment(yearly(spark, sf_dir), ["series", "year"], F.lit(3))
    return settle(out.select("series", "year", "x", "value"), dp=5)


@query(
    "pivot_export",
    f"WITH {_CV} SELECT series, x, {', '.join(f'round(any_value(value) FILTER (year = {y}), 4) AS y{y}' for y in _YEARS)} FROM cv GROUP BY series, x",
)
def pivot_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day by year matrix of every series, all years of the order table."""
    out = CV.pivot_export(yearly(spark, sf_dir), _YEARS, ("series", "x"))
    return settle(out.select("series", "x", *[F.col(str(y)).alias(f"y{y}") for y in _YEARS]), dp=4)


@query(
    "var_parametric",
    settle_sql(
        f"""WITH {CURVE}, l AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS b FROM curve), r AS (SELECT *, ln(value / lag(value) OVER (PARTITION BY series ORDER BY day)) AS lr FROM l WHERE b <= 60),
        g AS (SELECT series, stddev_pop(lr) * arg_max(value, day) AS s FROM r GROUP BY 1 HAVING count(*) = 60) SELECT series, s * 1.645 AS p90, s * 1.96 AS p95, s * 2.576 AS p99 FROM g""",
        "series", "p90:4, p95:4, p99:4",
    ),
)
def var_parametric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VaR of the newest sixty values per series."""
    return settle(R.parametric_var(views.curve(spark, sf_dir), "series", "day", F.year("day")), dp=4)


@query(
    "var_rolling",
    f"""WITH {_CV}, r AS (SELECT *, ln(value / lag(value) OVER (PARTITION BY series, year ORDER BY x)) AS lr FROM cv),
      w AS (SELECT *, CASE WHEN count(lr) OVER f = 60 THEN stddev_pop(lr) OVER f * 1.645 * value END AS v FROM r WINDOW f AS (PARTITION BY series, year ORDER BY x ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
      SELECT series, year, x, round(v / value, 5) AS var_share FROM w""",
)
def var_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p90 VaR along each yearly series."""
    return settle(R.rolling_var(yearly(spark, sf_dir), ["series", "year"]).select("series", "year", "x", (F.col("var") / F.col("value")).alias("var_share")), dp=5)


@query(
    "var_multi_leg",
    settle_sql(
        f"""WITH {_CV}, {_LEG_VALUES}, o AS (SELECT structure, year, x, ratio * value * CASE WHEN 5.0 + n > 1 THEN (5.0 + n) / 100 END AS s FROM cv JOIN l ON series = leg),
        p AS (SELECT structure, year, x, sqrt(sum(s * s)) AS sg FROM o GROUP BY ALL HAVING count(*) = 3) SELECT structure || '|' || year AS structure_year, max(x) AS x, arg_max(sg, x) * 1.645 AS p90, arg_max(sg, x) * 1.96 AS p95, arg_max(sg, x) * 2.576 AS p99 FROM p GROUP BY structure, year""",
        "structure_year, x", "p90:4, p95:4, p99:4",
    ),
)
def var_multi_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-correlation VaR at the newest shared day per structure and year."""
    legs = _legs(spark, sf_dir).withColumns({"price": F.col("value"), "vol": 5.0 + F.col("n"), "structure_year": F.concat_ws("|", "structure", F.col("year").cast("string"))})
    return settle(R.multi_leg_var(legs, "structure_year", 3), dp=4)


@query(
    "change_histogram",
    f"""WITH {CURVE}, p AS (SELECT series, floor(((value - lag(value) OVER w) / abs(lag(value) OVER w) * 100 + 2.5) / 5) AS b FROM curve WINDOW w AS (PARTITION BY series, year(day) ORDER BY day)),
      c AS (SELECT series, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY ALL), s AS (SELECT series, unnest(range(min(b)::BIGINT, max(b)::BIGINT + 1)) AS b, sum(n)::BIGINT AS total FROM c GROUP BY 1)
      SELECT series, b * 5.0::DOUBLE AS bin_start, round(coalesce(n, 0) / total * 100, 6) AS share, total FROM s LEFT JOIN c USING (series, b)""",
)
def change_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-percent bins of daily changes."""
    return settle(R.change_histogram(views.curve(spark, sf_dir), "series", "day"))


@query(
    "annualised_vol",
    f"""WITH {DBARS}, r AS (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY entity ORDER BY session_date)) AS lr FROM dbars),
      v AS (SELECT *, CASE WHEN count(lr) OVER f >= 20 THEN stddev_samp(lr) OVER f * sqrt(252) END AS vol FROM r WINDOW f AS (PARTITION BY entity ORDER BY session_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
      SELECT entity, strftime(session_date, '%Y-%m-%d') AS session_date, round(greatest(0.05, least(1.5, coalesce(last_value(vol IGNORE NULLS) OVER (PARTITION BY entity ORDER BY session_date), 0.26))), 5) AS vol_30d FROM v""",
)
def annualised_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty-day volatility a year, filled and clipped."""
    out = R.annualised_vol(views.day_bars(spark, sf_dir), ["entity"], "session_date", "close")
    return settle(out.select("entity", "session_date", "vol_30d"))


@query(
    "var_precedence",
    settle_sql(
        f"""WITH {CURVE}, l AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS b FROM curve), r AS (SELECT *, ln(value / lag(value) OVER (PARTITION BY series ORDER BY day)) AS lr FROM l WHERE b <= 60),
        g AS (SELECT series, stddev_pop(lr) * arg_max(value, day) AS s FROM r WHERE series <> '1-URGENT' GROUP BY 1 HAVING count(*) = 60),
        v AS (SELECT series, arg_max(value, day) * CASE WHEN 5.0 + arg_max(n, day) > 1 THEN (5.0 + arg_max(n, day)) / 100 END AS s FROM curve GROUP BY 1),
        a AS (SELECT v.series, coalesce(g.s, v.s) AS s FROM v LEFT JOIN g USING (series))
        SELECT series, s * 1.645 AS p90, s * 1.96 AS p95, s * 2.576 AS p99 FROM a""",
        "series", "p90:4, p95:4, p99:4",
    ),
)
def var_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VaR from the history where there is one, else from the quoted volatility."""
    curve = views.curve(spark, sf_dir)
    fitted = R.parametric_var(curve.filter(F.col("series") != "1-URGENT"), "series", "day", F.year("day"))
    latest = curve.groupBy("series").agg(F.max_by("value", "day").alias("price"), (F.max_by("n", "day") + 5.0).alias("vol"))
    quoted = R.var_from_vol(latest, F.col("price"), F.col("vol")).select("series", "p90", "p95", "p99")
    return settle(R.first_available(fitted, quoted, key="series"), dp=4)


@query(
    "var_plotted",
    f"""WITH {_CV}, r AS (SELECT *, ln(value / lag(value) OVER (PARTITION BY series, year ORDER BY x)) AS lr FROM cv),
      w AS (SELECT *, CASE WHEN count(lr) OVER f = 60 THEN stddev_pop(lr) OVER f * 1.645 * value END AS v FROM r WINDOW f AS (PARTITION BY series, year ORDER BY x ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
      SELECT series, year, x, round(v / value, 5) AS var_share FROM w WHERE x % 7 = 0""",
)
def var_plotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling VaR fitted on the full history, shown where the plot has points."""
    series = yearly(spark, sf_dir)
    full = R.rolling_var(series, ["series", "year"])
    shown = R.restrict_to(full, series.filter(F.col("x") % 7 == 0), ["series", "year"])
    return settle(shown.select("series", "year", "x", (F.col("var") / F.col("value")).alias("var_share")), dp=5)
