"""Comparing scorecards, and audits over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rounded
from ..schema import PILLARS
from .scoring import PILLAR_WEIGHTS, global_scores, is_measured, scorecards

C = F.col
# What a difference in a field of the measurement profile means.
COSMETIC = ("tool_version",)
NARROWING = ("active_connectors", "criteria_overrides")
BREAKING = ("pillar_weights", "rule_catalog_digest", "signal_schema_version", "thresholds")
MODES = ("strict", "intersection", "descriptive")


class NotComparable(ValueError):
    """The mode asks for more than the two profiles allow."""


def differences(left: str, right: str) -> Column:
    """Sorted names of the fields in which two profile structs differ. Maps are compared as sorted entries."""
    def same(f: str) -> Column:
        a, b = C(f"{left}.{f}"), C(f"{right}.{f}")
        return F.to_json(F.struct(a)).eqNullSafe(F.to_json(F.struct(b)))

    return F.array_sort(F.filter(F.array(*(F.when(~same(f), F.lit(f)) for f in (*COSMETIC, *NARROWING, *BREAKING))), lambda x: x.isNotNull()))


def comparability(left: str, right: str) -> Column:
    """exact, compatible, intersection or incompatible, from two profile columns (structs with a digest)."""
    diff = differences(left, right)
    among = lambda names: F.exists(diff, lambda d: d.isin(*names))
    return (
        F.when(C(f"{left}.digest") == C(f"{right}.digest"), "exact")
        .when(among(BREAKING), "incompatible")
        .when(among(NARROWING), "intersection")
        .when(F.size(diff) > 0, "compatible")
        .otherwise("intersection")  # the digests differ by a field that isn't looked at
    )


def allowed_modes(kind: Column) -> Column:
    of = lambda *m: F.array(*map(F.lit, m))
    return F.when(kind.isin("exact", "compatible"), of(*MODES)).when(kind == "intersection", of(*MODES[1:])).otherwise(of(MODES[2]))


def sided(results: DataFrame, pairs: DataFrame, common_only: bool = False) -> DataFrame:
    """Results of both sides under (pair_id, side); pairs(pair_id, left_id, right_id). The results are read once.

    common_only: of rules that both sides measured.
    """
    ends = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit("left").alias("side"), C("left_id").alias("audit_id")), F.struct(F.lit("right").alias("side"), C("right_id").alias("audit_id")))).alias("e")).select("pair_id", "e.*")
    rows = ends.join(results, "audit_id").drop("audit_id")
    if not common_only:
        return rows
    both = F.count_if(is_measured()).over(Window.partitionBy("pair_id", "key"))
    return rows.withColumn("both", both).where("both = 2").drop("both")


def criterion_deltas(results: DataFrame, pairs: DataFrame, common_only: bool = False) -> DataFrame:
    """(pair_id, key, left_score, right_score, delta, left_status, right_status): right minus left, by rule.

    A rule that one side lacks has no delta; a rule that wasn't measured still carries its zero. common_only: rules that
    both sides measured.
    """
    of = lambda c: [F.max(F.when(C("side") == s, C(c))).alias(f"{s}_{c}") for s in ("left", "right")]
    both = sided(results, pairs, common_only).groupBy("pair_id", "key").agg(*of("score"), *of("status"))
    return both.select("pair_id", "key", "left_score", "right_score", rounded(C("right_score") - C("left_score")).alias("delta"), "left_status", "right_status")


def compare(results: DataFrame, pairs: DataFrame, recompute: bool, weights: dict[str, float] | None = None, deltas: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, pillars, criteria) of many pairs at once.

    recompute: both sides are scored again over the rules that both measured (intersection mode). deltas=False puts the
    scores side by side only (descriptive mode over incompatible profiles) and returns no criteria. Both sides of all
    pairs are scored in one grouping.
    """
    weights = PILLAR_WEIGHTS if weights is None else weights
    scored = scorecards(sided(results, pairs, recompute).withColumn("audit_id", F.struct("pair_id", "side")), weights)
    of = lambda s, c: F.max_by(c, F.when(C("audit_id.side") == s, 1)).alias(f"{s}_{c}")
    wide = scored.groupBy(C("audit_id.pair_id").alias("pair_id")).agg(*(F.max(F.when(C("audit_id.side") == s, C("score"))).alias(f"{s}_global") for s in ("left", "right")), of("left", "scores"), of("right", "scores"))
    # A pair without common rules has no rows to score; it is compared at zero.
    both = pairs.select("pair_id").join(wide, "pair_id", "left").fillna(0.0, ["left_global", "right_global"])
    delta = lambda a, b: (rounded(b - a) if deltas else F.lit(None).cast("double"))
    totals = both.select("pair_id", "left_global", "right_global", delta(C("left_global"), C("right_global")).alias("global_delta"), F.lit(recompute).alias("recomputed"))
    side = lambda s, k: F.coalesce(F.get(f"{s}_scores", F.lit(k))["score"], F.lit(0.0))
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("pillar"), side("left", k).alias("left_score"), side("right", k).alias("right_score")) for k, p in enumerate(PILLARS))))
    pillars = both.select("pair_id", each.alias("p")).select("pair_id", "p.*", delta(C("p.left_score"), C("p.right_score")).alias("delta"))
    criteria = criterion_deltas(results, pairs, recompute)
    return totals, pillars, criteria if deltas else criteria.limit(0)


def gates(audits: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, comparability, differences, allowed_modes): what may be asked of each pair; audits(audit_id, measurement_profile)."""
    side = lambda s: audits.select(C("audit_id").alias(f"{s}_id"), C("measurement_profile").alias(s))
    both = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    return both.select("pair_id", comparability("left", "right").alias("comparability"), differences("left", "right").alias("differences"), allowed_modes(comparability("left", "right")).alias("allowed_modes"))


def compare_scorecards(results: DataFrame, audits: DataFrame, left_id: str, right_id: str, mode: str = "strict") -> dict[str, object]:
    """Two audits (rows of audits: audit_id, measurement_profile) under a mode; raises NotComparable if it asks too much."""
    pair = audits.where(C("audit_id") == left_id).select(C("measurement_profile").alias("l")).crossJoin(audits.where(C("audit_id") == right_id).select(C("measurement_profile").alias("r")))
    row = pair.select(comparability("l", "r").alias("kind"), differences("l", "r").alias("diff"), allowed_modes(comparability("l", "r")).alias("modes"), C("l").isNotNull() & C("r").isNotNull()).first()
    if row is None or not row[3]:
        raise NotComparable("both audits need a measurement profile; allowed: descriptive")
    if mode not in row["modes"]:
        raise NotComparable(f"{mode} over {row['kind']} profiles ({', '.join(row['diff'])}); allowed: {', '.join(row['modes'])}")
    pairs = results.sparkSession.createDataFrame([(f"{left_id}|{right_id}", left_id, right_id)], "pair_id string, left_id string, right_id string")
    recompute = mode == "intersection" or row["kind"] == "intersection"
    totals, pillars, criteria = compare(results, pairs, recompute, deltas=not (mode == "descriptive" and row["kind"] == "incompatible"))
    return {"comparability": row["kind"], "profile_differences": row["diff"], "allowed_modes": row["modes"], "totals": totals, "pillars": pillars, "criteria": criteria}


def changes(criteria: DataFrame, top: int = 15) -> DataFrame:
    """A pair's rules whose score changed, largest change first."""
    order = Window.partitionBy("pair_id").orderBy(F.desc(F.abs("delta")), "key")
    return criteria.where("delta <> 0").withColumn("rank", F.row_number().over(order)).where(C("rank") <= top)


def successive(audits: DataFrame) -> DataFrame:
    """pairs(pair_id, left_id, right_id) of each audit and the one before it on the same host."""
    order = Window.partitionBy("host").orderBy("started_at", "audit_id")
    before = audits.withColumn("left_id", F.lag("audit_id").over(order)).where("left_id is not null")
    return before.select(F.concat_ws("|", "left_id", "audit_id").alias("pair_id"), "left_id", C("audit_id").alias("right_id"))


def audits_of(audits: DataFrame, results: DataFrame, host: str) -> DataFrame:
    """A host's audits, latest first, with how many results each has."""
    counts = results.groupBy("audit_id").agg(F.count("*").alias("criteria"))
    return audits.where(C("host") == host).join(counts, "audit_id", "left").withColumn("criteria", F.coalesce("criteria", F.lit(0))).orderBy(F.desc("started_at"), F.desc("audit_id"))


def latest_audits(audits: DataFrame) -> DataFrame:
    """Each host's latest audit (ties to the larger id) and how many it has."""
    order = Window.partitionBy("host").orderBy(F.desc("started_at"), F.desc("audit_id"))
    counts = audits.groupBy("host").agg(F.count("*").alias("audits"))
    return audits.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n").join(counts, "host")


def recalculated(results: DataFrame, audits: DataFrame) -> DataFrame:
    """audits with their global score computed anew from stored results, under default weights; coverage stays."""
    fresh = global_scores(results).withColumnRenamed("score", "__score")
    return audits.join(fresh, "audit_id", "left").withColumn("score_global", F.coalesce("__score", "score_global")).drop("__score")
