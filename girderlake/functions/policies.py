"""Ranking and rating rules as Column expressions (R1 to R12); thresholds are the rules' own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from girderlake.functions.text import contains_any, first_of

#: Words of a finding or component, accents folded.
SCOUR_WORDS = ["kolk", "scour", "unterspul"]
URGENCY_RANKS = {
    4: ("SOFORT", "UNVERZUEGLICH", "UNVERZÜGLICH", "DRINGEND", "IMMEDIATE"),
    3: ("KURZFRISTIG", "SHORT_TERM"),
    2: ("MITTELFRISTIG", "MEDIUM_TERM"),
    1: ("LANGFRISTIG", "LONG_TERM"),
}


def zero(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(0))


def points(value: Column, ladder: list[tuple[float, int]]) -> Column:
    """M5: the points of the first threshold reached, 0 for none and for null."""
    return F.coalesce(first_of(*[(value >= t, p) for t, p in ladder]), F.lit(0))


def urgency_rank(urgency: Column) -> Column:
    """4 to 1 by the whole word, 0 for any other."""
    u = F.upper(urgency)
    return F.coalesce(first_of(*[(u.isin(*words), rank) for rank, words in URGENCY_RANKS.items()]), F.lit(0))


def heavy_vehicles(recorded: Column, daily: Column, share: Column) -> Column:
    """M3: as recorded, else the share of daily traffic, rounded."""
    return F.coalesce(recorded, F.round(daily * share / F.lit(100)).cast("long"))


def network_points(daily: Column, heavy: Column, extra_tenths_km: Column, alternatives: Column, road_class: Column) -> Column:
    """Volume, heavy vehicles, detour, redundancy and road class."""
    redundancy = F.coalesce(first_of((alternatives == 0, 2), (alternatives == 1, 1)), F.lit(0))
    motorway = F.coalesce((road_class == "AUTOBAHN").cast("int"), F.lit(0))
    return points(daily, [(50_000, 3), (30_000, 2), (10_000, 1)]) + points(heavy, [(8_000, 3), (6_000, 2), (3_000, 1)]) + points(extra_tenths_km, [(300, 3), (150, 2), (50, 1)]) + redundancy + motorway


def network_band(score: Column) -> Column:
    return first_of((score >= 8, "HIGH"), (score >= 4, "MEDIUM")).otherwise("LOW")


def flood_band(level: Column, mhw: Column, hsw: Column, hhw: Column, mark_one: Column | None = None, mark_two: Column | None = None) -> Column:
    """The highest mark that the level reaches; a missing mark reaches nothing."""
    high, middle = (F.coalesce(hsw, mark_two) if mark_two is not None else hsw), (F.coalesce(mhw, mark_one) if mark_one is not None else mhw)
    return first_of((level >= hhw, "EXTREME"), (level >= high, "HIGH"), (level >= middle, "MODERATE")).otherwise("BELOW_TRIGGER")


def environmental_exposure(durability: Column, freeze: Column, rain: Column, deicing: Column) -> Column:
    """R6"""
    return (zero(durability) >= 2) & ((zero(freeze) >= 40) | (zero(rain) >= 8) | (zero(deicing) >= 25))


def trend(delta: Column) -> Column:
    return first_of((delta > 0, "DETERIORATING"), (delta < 0, "IMPROVING"), (delta == 0, "STABLE")).otherwise("UNKNOWN")


def attention_level(status: Column, tenths: Column, stability: Column, safety: Column, durability: Column, way: Column, urgency: Column, findings: Column, recommendations: Column, environment: Column, network: Column, flood: Column, scour: Column) -> Column:
    """5 CRITICAL, 4 HIGH, 3 MEDIUM, 2 LOW, 1 ROUTINE."""
    worst = F.greatest(zero(stability), zero(safety))
    return first_of(
        ((status == "OVERDUE") | (worst >= 3), 5),
        ((worst >= 2) | network | (flood & scour), 4),
        (status.isin("DUE_SOON", "UNKNOWN") | tenths.isNull() | (zero(durability) >= 2) | environment | flood | (way == "DETERIORATING") | (zero(urgency) >= 2), 3),
        ((findings > 0) | (recommendations > 0), 2),
    ).otherwise(1)


def attention_reasons(status: Column, tenths: Column, stability: Column, safety: Column, durability: Column, way: Column, urgency: Column, findings: Column, recommendations: Column, environment: Column, network: Column, flood: Column) -> Column:
    """Codes of all reasons, in the rule's order."""
    s, v, d = zero(stability), zero(safety), zero(durability)
    cases = [
        (status == "OVERDUE", "OVERDUE_INSPECTION"),
        (status == "DUE_SOON", "INSPECTION_DUE_SOON"),
        (v >= 2, "TRAFFIC_SAFETY_FINDING"),
        (s >= 2, "STABILITY_FINDING"),
        (d >= 2, "DURABILITY_FINDING"),
        (environment, "ENVIRONMENTAL_EXPOSURE"),
        (network, "NETWORK_CRITICALITY"),
        (flood, "FLOOD_EXPOSURE"),
        (way == "DETERIORATING", "DETERIORATING_CONDITION"),
        (zero(urgency) >= 2, "MEDIUM_OR_HIGHER_RECOMMENDATION"),
        ((zero(urgency) < 2) & (recommendations > 0), "OPEN_RECOMMENDATION"),
        ((findings > 0) & (s < 2) & (v < 2) & (d < 2), "OPEN_FINDING"),
        ((status == "UNKNOWN") | tenths.isNull(), "MISSING_CRITICAL_DATA"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in cases]))


#: Reason codes in their order among equals.
PRIORITY_ORDER = ("STABILITY_RATING", "TRAFFIC_SAFETY_RATING", "INSPECTION_OVERDUE", "IMMEDIATE_URGENCY", "DURABILITY_RATING", "SHORT_TERM_URGENCY", "CONDITION_DETERIORATING", "LONG_UNRESOLVED", "INSPECTION_DUE_SOON", "MEDIUM_TERM_URGENCY", "NETWORK_CRITICALITY", "POST_FLOOD_INSPECTION", "HIGH_ENVIRONMENTAL_EXPOSURE")


def priority_reasons(stability: Column, safety: Column, durability: Column, urgency: Column, age_years: Column, status: Column, delta_tenths: Column, band: Column, flood: Column, environment: Column) -> Column:
    """Structs (severity 1 to 4, code), most severe first, then in the rule's order."""
    at_once = contains_any(urgency, ["sofort", "umgehend", "unverzuglich", "immediate"])
    shortly = contains_any(urgency, ["kurzfristig", "dringend", "short term", "short-term"])
    later = contains_any(urgency, ["mittelfristig", "medium term", "medium-term"])
    age = zero(age_years)
    severity = {
        "STABILITY_RATING": first_of((stability >= 3, 4), (stability >= 2, 3)),
        "TRAFFIC_SAFETY_RATING": first_of((safety >= 3, 4), (safety >= 2, 3)),
        "INSPECTION_OVERDUE": F.when(status == "OVERDUE", 4),
        "IMMEDIATE_URGENCY": F.when(at_once, 4),
        "DURABILITY_RATING": first_of((durability >= 3, 3), (durability >= 2, 2)),
        "SHORT_TERM_URGENCY": F.when(~at_once & shortly, 3),
        "CONDITION_DETERIORATING": F.when(delta_tenths >= 1, 3),
        "LONG_UNRESOLVED": first_of((age >= 5, 3), (age >= 2, 2)),
        "INSPECTION_DUE_SOON": F.when(status == "DUE_SOON", 2),
        "MEDIUM_TERM_URGENCY": F.when(~at_once & ~shortly & later, 2),
        "NETWORK_CRITICALITY": first_of((band == "HIGH", 3), (band == "MEDIUM", 2)),
        "POST_FLOOD_INSPECTION": F.when(flood, 3),
        "HIGH_ENVIRONMENTAL_EXPOSURE": F.when(environment, 2),
    }
    rows = [F.when(severity[c].isNotNull(), F.struct((-severity[c]).alias("rank"), F.lit(i).alias("place"), F.lit(c).alias("code"))) for i, c in enumerate(PRIORITY_ORDER)]
    ordered = F.array_sort(F.array_compact(F.array(*rows)))
    return F.transform(ordered, lambda r: F.struct((-r["rank"]).alias("severity"), r["code"].alias("code")))


LEVELS = {4: "CRITICAL", 3: "HIGH", 2: "MEDIUM", 1: "LOW"}


def priority_rank(reasons: Column) -> Column:
    """The severity of the first reason, 1 (LOW) without any."""
    return F.coalesce(F.get(reasons, F.lit(0))["severity"], F.lit(1))


def level_name(rank: Column) -> Column:
    return first_of(*[(rank == k, v) for k, v in LEVELS.items()])
