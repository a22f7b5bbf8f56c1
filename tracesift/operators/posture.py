"""Control coverage: stage assessments and defence scenarios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesift.functions import fixed_values as fv
from tracesift.functions import network as nw

DEFENSE_LAYERS = ("perimeter", "network", "endpoint", "application", "data", "identity", "monitoring")
CONTROL_STATUSES = ("implemented", "partial", "planned", "missing")
TESTED_EVIDENCE = ("tested", "benchmark")


def stage_requirements(spark: SparkSession) -> DataFrame:
    """The fixed table (attack_type, stage, relevance), about 70 rows."""
    rows = [
        (attack, stage, relevance)
        for attack, kinds in fv.STAGE_REQUIREMENTS.items()
        for relevance, stages in kinds.items()
        for stage in stages
    ]
    return spark.createDataFrame(rows, "attack_type string, stage string, relevance string")


def _required(attack_type: Column) -> Column:
    table = {a: F.array(*[F.lit(s) for s in k["required"]]) for a, k in fv.STAGE_REQUIREMENTS.items()}
    pairs = [x for a, stages in table.items() for x in (F.lit(a), stages)]
    return F.try_element_at(F.create_map(*pairs), F.coalesce(attack_type, F.lit("generic")))


def relevance(attack_type: Column | str, stage: Column | str) -> Column:
    """``required``, ``not_applicable`` or ``optional`` (the default)."""
    table = {
        f"{attack}|{name}": kind
        for attack, kinds in fv.STAGE_REQUIREMENTS.items()
        for kind in ("not_applicable", "required")
        for name in kinds[kind]
    }
    return nw.lookup(F.concat_ws("|", nw.col(attack_type), nw.col(stage)), table, F.lit("optional"))


def _present() -> Column:
    return F.coalesce("stage_present", F.lit(True))


def stage_relevance(stages: DataFrame) -> DataFrame:
    return stages.select(
        "assessment_id", "attack_type", "stage_no", "name", _present().alias("stage_present"),
        relevance("attack_type", "name").alias("relevance"),
    )


def missing_required(stages: DataFrame) -> DataFrame:
    """Required stages that no present stage of the assessment covers."""
    wanted = stages.select("assessment_id", "attack_type").distinct().select(
        "assessment_id", F.explode(_required(F.col("attack_type"))).alias("name")
    )
    present = stages.where(_present()).select("assessment_id", "name").distinct()
    return wanted.join(present, ["assessment_id", "name"], "left_anti")


def assessment_metrics(stages: DataFrame) -> DataFrame:
    """Structural completeness, evidence strength and assumption density.

    One aggregate per assessment: required stages are few, so the covered ones
    are a set of at most that size.
    """
    required = F.array_contains(_required(F.col("attack_type")), F.col("name"))
    tested = F.size(F.filter(F.coalesce("controls", _no_controls()), lambda c: c["evidence_basis"].isin(*TESTED_EVIDENCE)))
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    totals = stages.groupBy("assessment_id", "attack_type").agg(
        F.size(F.collect_set(F.when(required & _present(), F.col("name")))).alias("covered"),
        F.sum(size("controls")).alias("controls"),
        F.sum(tested).alias("tested"),
        F.sum(size("assumptions")).alias("assumptions"),
    )
    needed = F.size(_required(F.col("attack_type")))
    items = F.col("controls") + F.col("assumptions")
    return totals.select(
        "assessment_id", "attack_type",
        F.round(F.when(needed > 0, F.col("covered") / needed).otherwise(1.0), 2).alias("structural_completeness"),
        F.round(F.when(F.col("controls") > 0, F.col("tested") / F.col("controls")).otherwise(0.0), 2).alias("evidence_strength"),
        F.round(F.when(items > 0, F.col("assumptions") / items).otherwise(0.0), 2).alias("assumption_density"),
    )


def _no_controls() -> Column:
    return F.array().cast(
        "array<struct<control_name:string,control_type:string,effectiveness_rating:string,"
        "evidence_basis:string,independence_flag:boolean>>"
    )


def stage_controls(stages: DataFrame) -> DataFrame:
    return stages.select(
        "assessment_id", "stage_no", F.col("name").alias("stage"), F.posexplode("controls").alias("control_no", "_control")
    ).select("assessment_id", "stage_no", "stage", "control_no", "_control.*")


def duplicate_controls(stages: DataFrame) -> DataFrame:
    """Controls that an assessment lists more than once."""
    counted = stage_controls(stages).where(F.coalesce("control_name", F.lit("")) != "").groupBy(
        "assessment_id", "control_name"
    ).agg(F.count(F.lit(1)).alias("uses"))
    return counted.where(F.col("uses") > 1)


def independence_violations(stages: DataFrame) -> DataFrame:
    flagged = stage_controls(stages).where(F.coalesce("independence_flag", F.lit(False)))
    return flagged.select("assessment_id", "stage_no", "stage", "control_name")


def control_coverage(stages: DataFrame) -> DataFrame:
    """Stages each control appears in; effectiveness as first stated."""
    named = stage_controls(stages).withColumn("control_name", F.coalesce("control_name", F.lit("Unknown")))
    return named.groupBy("assessment_id", "control_name").agg(
        F.min_by(
            F.coalesce("effectiveness_rating", F.lit("unknown")),
            F.struct("stage_no", "control_no", "effectiveness_rating"),
        ).alias("effectiveness"),
        F.count(F.lit(1)).alias("stages"),
    )


def presence_counts(stages: DataFrame) -> DataFrame:
    """Stages present, and required stages stated as absent."""
    absent_required = ~_present() & (relevance("attack_type", "name") == "required")
    return stages.groupBy("assessment_id").agg(
        F.sum(_present().cast("bigint")).alias("stages_present"),
        F.sum(absent_required.cast("bigint")).alias("required_missing"),
    )


# --- scenarios -------------------------------------------------------------------------------


def _listed(c: str) -> Column:
    return F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))


def unprotected_events(events: DataFrame) -> DataFrame:
    return events.where(_listed("blocking_controls") == 0).select("scenario_id", "event_id", "name", "sequence_order")


def weak_controls(controls: DataFrame) -> DataFrame:
    weak = controls.where(F.col("implementation_status").isin("partial", "planned", "missing"))
    return weak.select("scenario_id", "control_id", "name", F.col("implementation_status").alias("status"))


def easy_bypass(controls: DataFrame) -> DataFrame:
    easy = controls.where(F.col("bypass_difficulty").isin("trivial", "low"))
    return easy.select("scenario_id", "control_id", "name", F.col("bypass_difficulty").alias("difficulty"))


def event_protection(events: DataFrame) -> DataFrame:
    label = (
        F.when(_listed("blocking_controls") > 0, "PROTECTED")
        .when(_listed("detecting_controls") > 0, "DETECT ONLY")
        .otherwise("UNPROTECTED")
    )
    return events.select("scenario_id", "event_id", "sequence_order", label.alias("protection"))


def gap_totals(controls: DataFrame, events: DataFrame) -> DataFrame:
    """Issues per scenario and the least protected event (earliest on a tie)."""
    guards = _listed("blocking_controls") + _listed("detecting_controls")
    weakest = F.min_by("event_id", F.struct(guards, F.col("sequence_order"), F.col("event_id")))
    zero = F.lit(0).cast("bigint")
    from_events = events.groupBy("scenario_id").agg(
        F.sum((_listed("blocking_controls") == 0).cast("bigint")).alias("unprotected_events"), weakest.alias("weakest_event")
    ).select("scenario_id", "unprotected_events", "weakest_event", zero.alias("weak_controls"), zero.alias("easy_bypass"))
    from_controls = controls.groupBy("scenario_id").agg(
        F.sum(F.col("implementation_status").isin("partial", "planned", "missing").cast("bigint")).alias("weak_controls"),
        F.sum(F.col("bypass_difficulty").isin("trivial", "low").cast("bigint")).alias("easy_bypass"),
    ).select(
        "scenario_id", zero.alias("unprotected_events"), F.lit(None).cast("string").alias("weakest_event"),
        "weak_controls", "easy_bypass",
    )
    both = from_events.unionByName(from_controls).groupBy("scenario_id").agg(
        *[F.sum(c).alias(c) for c in ("unprotected_events", "weak_controls", "easy_bypass")],
        F.max("weakest_event").alias("weakest_event"),
    )
    return both.withColumn("total_issues", F.col("unprotected_events") + F.col("weak_controls") + F.col("easy_bypass"))


def defense_coverage(controls: DataFrame) -> DataFrame:
    """Controls per scenario, layer and status; all seven layers are present."""
    counted = controls.groupBy("scenario_id", "control_type").agg(
        F.count(F.lit(1)).alias("control_count"),
        *[F.sum((F.col("implementation_status") == s).cast("bigint")).alias(s) for s in CONTROL_STATUSES],
    )
    layers = F.explode(F.array(*[F.lit(x) for x in DEFENSE_LAYERS])).alias("control_type")
    grid = controls.select("scenario_id").distinct().select("scenario_id", layers)
    joined = grid.join(counted, ["scenario_id", "control_type"], "left")
    return joined.select(
        "scenario_id", F.col("control_type").alias("layer"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("control_count", *CONTROL_STATUSES)],
    )


def scenario_overview(scenarios: DataFrame, controls: DataFrame, events: DataFrame) -> DataFrame:
    """Controls, events and unprotected events of every scenario."""
    zero = F.lit(0).cast("bigint")
    parts = [
        scenarios.select("scenario_id", zero.alias("controls"), zero.alias("events"), zero.alias("unprotected")),
        controls.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("controls")).select(
            "scenario_id", "controls", zero.alias("events"), zero.alias("unprotected")
        ),
        events.groupBy("scenario_id").agg(
            F.count(F.lit(1)).alias("events"),
            F.sum((_listed("blocking_controls") == 0).cast("bigint")).alias("unprotected"),
        ).select("scenario_id", zero.alias("controls"), "events", "unprotected"),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("scenario_id").agg(
        *[F.sum(c).alias(c) for c in ("controls", "events", "unprotected")]
    )
