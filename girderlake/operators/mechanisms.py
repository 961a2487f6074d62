"""Damage mechanisms of every structure (R9): points, band and confidence of four kinds, from findings, climate and inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girderlake.functions.policies import SCOUR_WORDS, points, zero
from girderlake.functions.text import any_of, contains_any, first_of, folded
from girderlake.operators.portfolio import ACTIVE, WATER

#: Words of a finding, accents folded, by what they show.
WORDS = {
    "crack": ["riss"],
    "bare": ["freilieg", "abplatz", "bewehrung", "exposed"],
    "cover": ["deckung", "c <", "c<"],
    "coating": ["korrosion", "beschichtung", "angerostet", "rost", "duplex", "verwitter"],
    "drain": ["entwasser", "ablauf", "blasen", "verstopf", "wasserstau", "durchfeucht"],
    "joint": ["fuge", "kappenfuge", "fahrbahnanschluss"],
    "plants": ["bewuchs", "vegetation"],
    "scour": SCOUR_WORDS,
}
STEEL_MATERIAL, STEEL_TYPES = ["stahl"], ["schutz", "gelander"]


def signs(findings: DataFrame) -> DataFrame:
    """For each structure the worst durability of its active findings of each kind (null: none), and how many it has."""
    active = findings.where(F.col("status").isin(*ACTIVE)).withColumn("_low", folded(F.col("description")))
    worst = [F.max(F.when(F.rlike("_low", any_of(words)), F.coalesce("durability", F.lit(0)))).alias(kind) for kind, words in WORDS.items()]
    return active.groupBy("structure_id").agg(*worst, F.count("*").alias("n_active"))


def steel(components: DataFrame) -> DataFrame:
    """For each structure with steel or coated parts the oldest year among them (null: unknown)."""
    own = components.where(contains_any(F.col("material"), STEEL_MATERIAL) | contains_any(F.col("type"), STEEL_TYPES))
    return own.groupBy("structure_id").agg(F.min("install_year").alias("coated_in"), F.count("*").alias("n_steel"))


def mechanisms(structures: DataFrame, parts: DataFrame, findings: DataFrame, components: DataFrame, climates: DataFrame, traffic: DataFrame, gauges: DataFrame, unmatched: DataFrame, as_of_year: int) -> DataFrame:
    """(structure_id, kind, points, band, confidence). gauges: above_trigger where a gauge is known; unmatched: floods without inspection."""
    c = F.col
    built = parts.groupBy("structure_id").agg(F.min("construction_year").alias("construction_year"))
    df = structures.select(c("id").alias("structure_id"), "crossed")
    for part in (built, signs(findings), steel(components), climates, traffic, gauges.withColumn("gauged", F.lit(True)), unmatched.select("structure_id").distinct().withColumn("unmatched", F.lit(True))):
        df = df.join(part, "structure_id", "left")
    age = lambda year: F.greatest(F.lit(as_of_year) - c(year), F.lit(0))
    found = lambda kind: c(kind).isNotNull()
    graded = lambda kind: points(c(kind), [(2, 2), (0, 1)])
    one = lambda condition, weight=1: F.when(F.coalesce(condition, F.lit(False)), weight).otherwise(0)
    gauged, open_flood = F.coalesce("gauged", F.lit(False)), F.coalesce("gauged", F.lit(False)) & F.coalesce("unmatched", F.lit(False))
    rc = points(age("construction_year"), [(50, 2), (40, 1)]) + points(c("freeze_days"), [(60, 2), (40, 1)]) + points(c("wet_dry_cycles"), [(80, 1)]) + one((c("deicing_days") >= 20) & (c("daily_traffic") >= 30_000)) + graded("crack") + one(found("bare"), 2) + one(found("cover"))
    metal = points(c("humidity"), [(78, 1)]) + points(c("wet_hours"), [(1_400, 1)]) + graded("coating") + points(age("coated_in"), [(20, 1)])
    water = points(c("rain_days"), [(12, 2), (8, 1)]) + graded("drain") + graded("joint") + one(found("plants"))
    scour = one(F.rlike("crossed", F.lit(WATER))) + one(~gauged & (c("rain_days") >= 8)) + one(open_flood | (gauged & c("above_trigger")), 2) + one(found("scour"), 2)
    df = df.withColumns({"_rc": rc, "_metal": metal, "_water": water, "_scour": scour})
    rc, metal, water, scour = (c(f"_{x}") for x in ("rc", "metal", "water", "scour"))
    by_points = lambda p: first_of((p >= 4, "HIGH"), (p >= 2, "MEDIUM")).otherwise("LOW")

    def row(kind: str, score: Column, band: Column, confidence: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), score.cast("long").alias("points"), band.alias("band"), confidence.alias("confidence"))

    rows = [
        row("RC_CORROSION", rc, by_points(rc), F.when(zero("n_active") > 0, "HIGH").otherwise("MEDIUM")),
        row("STEEL_CORROSION", metal, by_points(metal), first_of((found("coating"), "HIGH"), (zero("n_steel") > 0, "MEDIUM")).otherwise("LOW")),
        row("WATER_INGRESS", water, by_points(water), F.when(found("drain") | found("joint"), "HIGH").otherwise("MEDIUM")),
        row("SCOUR", scour, first_of((found("scour") | open_flood, "HIGH"), (scour >= 2, "MEDIUM")).otherwise("LOW"), F.when(found("scour") | gauged, "MEDIUM").otherwise("LOW")),
    ]
    return df.select("structure_id", F.inline(F.array(*rows)))
