"""Registry of multi-leg structures: templates rolled along the curve, merged with a user's own."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelab.config import RootSpec


@dataclass(frozen=True)
class Leg:
    root: str
    offset: int
    sign: int
    contracts: int = 1
    price_weight: float = 1.0
    mode: str = "delivery"
    rank: int = 1


@dataclass(frozen=True)
class Structure:
    spread_id: str
    name: str
    family: str
    anchor_root: str
    anchor_rank: int
    tier: int
    group: str
    legs: tuple[Leg, ...]
    core: bool = False
    model_enabled: bool = True
    unit: str = "USD/bbl"

    @property
    def signature(self) -> str:
        """Structures with the same legs up to weights share one alignment."""
        parts = [f"{g.root}:{g.mode}:{g.offset}:{g.rank if g.mode == 'rank' else 0}" for g in self.legs]
        return f"{self.anchor_root}>" + ",".join(parts)

    @property
    def tenor_bucket(self) -> str:
        limits = ((4, "FRONT"), (8, "MID"), (12, "DEFERRED"))
        return next((name for limit, name in limits if self.anchor_rank <= limit), "FAR")


@dataclass(frozen=True)
class Template:
    """A leg pattern that is rolled along the curve: rank 1, 2, ... ``horizon - span``."""

    prefix: str
    label: str
    family: str
    tier: int
    legs: tuple[Leg, ...]
    front_groups: tuple[str, ...]
    core_roots: tuple[str, ...]

    @property
    def span(self) -> int:
        return max(g.offset for g in self.legs)

    def at(self, rank: int) -> Structure:
        anchor = self.legs[0].root
        spread_id = self.prefix + ".M" + "_M".join(f"{rank + k:02d}" for k in range(self.span + 1))
        front = rank <= len(self.front_groups)
        return Structure(
            spread_id=spread_id,
            name=self.label.format(a=rank, m=rank + 1, b=rank + self.span),
            family=self.family,
            anchor_root=anchor,
            anchor_rank=rank,
            tier=self.tier,
            group=self.front_groups[rank - 1] if front else spread_id.replace(".", "_"),
            legs=self.legs,
            core=rank <= 2 and anchor in self.core_roots,
        )


def _pair(a: str, b: str, lots: tuple[int, int], offsets: tuple[int, ...], signs: tuple[int, ...]) -> tuple[Leg, ...]:
    """A product and its counterpart side by side at each offset."""
    out = []
    for offset, sign in zip(offsets, signs, strict=True):
        out += [Leg(a, offset, sign, lots[0]), Leg(b, offset, -sign, lots[1])]
    return tuple(out)


def curve_templates(roots: Iterable[str] = ("HO", "CL", "CO", "QS")) -> tuple[Template, ...]:
    """The canonical relative-value basis; adjacent tenors only, the rest is linear in them."""
    roots = tuple(roots)
    out: list[Template] = []
    distillates = ("HO", "QS")
    for r in roots:
        out += [
            Template(f"CAL.{r}", r + " M{a}-M{b} Calendar", "Calendar", 1, (Leg(r, 0, 1), Leg(r, 1, -1)), (f"{r}_CAL_12",), distillates),
            Template(
                f"FLY.{r}", r + " M{a}-M{m}-M{b} Fly", "Fly", 2, (Leg(r, 0, 1), Leg(r, 1, -1, 2, 2.0), Leg(r, 2, 1)),
                (f"{r}_FLY_123",), distillates,
            ),
            Template(
                f"CDR.{r}", r + " M{a}-M{b} Condor", "Condor", 3, (Leg(r, 0, 1), Leg(r, 1, -1), Leg(r, 2, -1), Leg(r, 3, 1)),
                (f"{r}_CONDOR_1234",), distillates,
            ),
        ]
    # Pair templates, package lots and front-month group names.
    pairs = (
        Template("CRK.HO_CL", "HO/WTI Same-Month Crack M{a}", "Crack", 1, _pair("HO", "CL", (1, 1), (0,), (1,)),
                 ("HO_WTI_M1", "HO_WTI_M2"), ("HO",)),
        Template("CRK.QS_CO", "Gasoil/Brent Same-Month Crack M{a}", "Crack", 1, _pair("QS", "CO", (4, 3), (0,), (1,)),
                 ("QS_BRENT_M1", "QS_BRENT_M2"), ("QS",)),
        Template("RV.HO_QS", "HO/Gasoil Relative Value M{a}", "Relative Value", 1, _pair("HO", "QS", (3, 4), (0,), (1,)),
                 ("HOGO_M1",), ("HO",)),
        Template("RV.CO_CL", "Brent/WTI Relative Value M{a}", "Relative Value", 1, _pair("CO", "CL", (1, 1), (0,), (1,)),
                 ("CRUDE_BASIS_M1",), ()),
        Template("BOX.CRACK.TRANSATL", "US-Europe Crack Relative Box M{a}", "Relative Box", 3,
                 (Leg("HO", 0, 1, 3), Leg("CL", 0, -1, 3), Leg("QS", 0, -1, 4), Leg("CO", 0, 1, 3)),
                 ("REL_MARGIN_M1",), ("HO",)),
        Template("BOX.CRKCAL.HO_CL", "HO/WTI Crack Calendar Box M{a}-M{b}", "Crack Curve", 2,
                 _pair("HO", "CL", (1, 1), (0, 1), (1, -1)), ("HO_WTI_CRACK_CAL",), ("HO",)),
        Template("BOX.CRKCAL.QS_CO", "Gasoil/Brent Crack Calendar Box M{a}-M{b}", "Crack Curve", 2,
                 _pair("QS", "CO", (4, 3), (0, 1), (1, -1)), ("QS_BRENT_CRACK_CAL",), ("QS",)),
        Template("BOX.CURVE.HO_QS", "HO-Gasoil Curve Box M{a}-M{b}", "Relative Box", 2,
                 _pair("HO", "QS", (3, 4), (0, 1), (1, -1)), ("HOGO_CAL_BOX",), ("HO",)),
        Template("BOX.CURVE.CO_CL", "Brent-WTI Curve Box M{a}-M{b}", "Relative Box", 2,
                 _pair("CO", "CL", (1, 1), (0, 1), (1, -1)), ("CRUDE_BASIS_BOX",), ()),
        Template("FLY.HOGO", "HOGO Relative Fly M{a}-M{b}", "HOGO Fly", 3,
                 (Leg("HO", 0, 1, 3), Leg("HO", 1, -1, 6), Leg("HO", 2, 1, 3),
                  Leg("QS", 0, -1, 4), Leg("QS", 1, 1, 8), Leg("QS", 2, -1, 4)),
                 ("HOGO_FLY_BOX",), ("HO",)),
    )
    known = set(roots)
    return tuple(out) + tuple(t for t in pairs if {g.root for g in t.legs} <= known)


def curve_structures(horizon: int = 16, roots: Iterable[str] = ("HO", "CL", "CO", "QS")) -> tuple[Structure, ...]:
    return tuple(t.at(rank) for t in curve_templates(roots) for rank in range(1, horizon - t.span + 1))


def by_rank(spread_id: str, name: str, legs: Iterable[tuple[str, int, int]]) -> Structure:
    """Legs (root, rank, sign) by their place on the curve, whatever their delivery."""
    made = tuple(Leg(root, 0, sign, mode="rank", rank=rank) for root, rank, sign in legs)
    return Structure(spread_id, name, "Ranked", made[0].root, 1, 1, spread_id.replace(".", "_"), made)


#: Four deliveries of four roots: packages of two, three, four and six legs, and two by rank.
CURVE_STRUCTURES = curve_structures(4) + (
    by_rank("RNK.HO1_CL2", "HO first, WTI second", (("HO", 1, 1), ("CL", 2, -1))),
    by_rank("RNK.QS1_CO1_QS3", "Gasoil and Brent by rank", (("QS", 1, 1), ("CO", 1, -1), ("QS", 3, -1))),
)


def merge_structures(own: Iterable[Structure], generated: Iterable[Structure]) -> tuple[Structure, ...]:
    """A user's structures first; a generated one is skipped where its group exists already."""
    own = tuple(own)
    groups = {s.group for s in own}
    return own + tuple(s for s in generated if s.group not in groups)


def merged_library(own: DataFrame, generated: DataFrame, group: str = "algebra_group") -> DataFrame:
    """The same for tables: all rows of a user's registry, and generated ones of other groups."""
    return own.withColumn("origin", F.lit("USER")).unionByName(
        generated.join(own.select(group).distinct(), group, "left_anti").withColumn("origin", F.lit("GENERATED"))
    )


def structure_table(spark: SparkSession, structures: Iterable[Structure], roots: tuple[RootSpec, ...]) -> DataFrame:
    """One row per structure.  Its size is the registry's, known before Spark sees it."""
    barrels = {r.root: r.contract_barrels for r in roots}
    rows = []
    for s in structures:
        long = float(sum(g.contracts * barrels[g.root] for g in s.legs if g.sign > 0))
        short = float(sum(g.contracts * barrels[g.root] for g in s.legs if g.sign < 0))
        used = {g.root for g in s.legs}
        rows.append(
            (
                s.spread_id, s.name, s.family, s.anchor_root, s.anchor_rank,
                s.anchor_rank + max(g.offset for g in s.legs), s.tenor_bucket, s.unit, s.core, s.model_enabled,
                s.tier, s.group, s.signature, len(s.legs), "|".join(sorted(used)),
                min(long, short) or max(long, short),
                "CROSS_MARKET_ASYNC_SETTLE" if {"QS", "CO"} <= used
                else "DEFERRED_SETTLE_RELATIONSHIP" if s.anchor_rank > 6 else "EXCHANGE_SETTLE",
            )
        )
    return spark.createDataFrame(
        rows,
        "spread_id string, spread_name string, spread_family string, anchor_root string, anchor_rank int,"
        " tenor_end int, tenor_bucket string, spread_unit string, core_spread boolean, model_enabled boolean,"
        " complexity_tier int, algebra_group string, signature string, n_legs int, economic_roots string,"
        " package_barrels double, settlement_quality string",
    )


def leg_table(spark: SparkSession, structures: Iterable[Structure]) -> DataFrame:
    rows = [
        (s.spread_id, s.signature, s.anchor_root, len(s.legs), i, g.root, g.mode, g.offset, g.rank, g.sign, g.contracts,
         float(g.price_weight))
        for s in structures
        for i, g in enumerate(s.legs, start=1)
    ]
    return spark.createDataFrame(
        rows,
        "spread_id string, signature string, anchor_root string, n_legs int, leg_order int, root string, mode string,"
        " delivery_offset int, rank int, sign int, contracts int, price_weight double",
    )


def user_registry(library: DataFrame, legs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A user's own registry: the enabled structures, and their legs in the layout of ``leg_table``.

    Both stay DataFrames, whatever their size.
    """
    kept = library.filter("enabled").withColumnRenamed("display_name", "spread_name").withColumnRenamed("family", "spread_family")
    keyed = legs.join(kept.select("spread_id", "anchor_root"), "spread_id").withColumnRenamed("selection_mode", "mode")
    shape = F.array_join(
        F.transform(
            F.sort_array(F.collect_list(F.struct("leg_order", F.concat_ws(":", "root", "mode", F.col("delivery_offset").cast("string"), F.col("rank").cast("string"), F.col("sign").cast("string"), F.col("contracts").cast("string")).alias("text")))),
            lambda leg: leg["text"],
        ),
        "|",
    )
    told = keyed.groupBy("spread_id").agg(shape.alias("signature"), F.count(F.lit(1)).cast("int").alias("n_legs"))
    return kept, keyed.join(told, "spread_id")


def _signed(value: str) -> "F.Column":
    return F.concat(
        F.when(F.col("sign") > 0, "+").otherwise("-"),
        F.expr(value),
        F.lit(" "),
        F.col("root"),
        F.when(F.col("delivery_offset") < 0, "[M-").otherwise("[M+"),
        F.abs("delivery_offset").cast("string"),
        F.lit("]"),
    )


def formula_table(legs: DataFrame) -> DataFrame:
    """Price formula and executable package per structure, as text."""
    weight = "CASE WHEN price_weight = floor(price_weight) THEN CAST(CAST(price_weight AS BIGINT) AS STRING) ELSE CAST(price_weight AS STRING) END"

    def joined(value: str):
        parts = F.sort_array(F.collect_list(F.struct("leg_order", _signed(value).alias("text"))))
        return F.ltrim(F.array_join(F.transform(parts, lambda p: p["text"]), " "), F.lit("+"))

    return legs.groupBy("spread_id").agg(
        joined(weight).alias("normalized_price_formula"),
        joined("CAST(contracts AS STRING)").alias("executable_package"),
    )


def leg_library(legs: DataFrame, structures: DataFrame, roots: DataFrame) -> DataFrame:
    """Legs with the economics of their root."""
    return (
        legs.drop("signature", "anchor_root", "n_legs")
        .join(structures.select("spread_id", "spread_name", "spread_family", "model_enabled", "complexity_tier"), "spread_id")
        .join(roots.drop("ticker_template", "generic_template"), "root")
        .withColumn(
            "description",
            F.concat_ws(
                " ", F.when(F.col("sign") > 0, "Long").otherwise("Short"), F.col("contracts").cast("string"), F.col("root"),
                F.lit("delivery offset"), F.concat(F.when(F.col("delivery_offset") < 0, "-").otherwise("+"), F.abs("delivery_offset")),
            ),
        )
    )
