"""The X + Y > Z timeline: exposure window, urgency and deadlines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.dims import policy
from keystrata.functions.binding import bind
from keystrata.functions.naming import is_pqc
from keystrata.functions.text import lookup


@dataclass(frozen=True)
class TimelineConfig:
    """Defaults where an asset has no inputs of its own. There is deliberately no default
    lifetime X: without one the inequality stays undecided."""

    quantum_arrival_years: float = policy.QUANTUM_ARRIVAL_YEARS["BASELINE"]
    protected_lifetime_years: float | None = None
    migration_time_years: float | None = None
    use_primitive_defaults: bool = True


INPUT_COLUMNS = ["migration_time_years", "quantum_arrival_years", "protected_lifetime_years"]


def invalid_durations(inputs: DataFrame) -> DataFrame:
    """(asset_id, field, value, problem) for every given duration that is not a finite,
    non-negative number."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in INPUT_COLUMNS
    ])
    v = F.col("value")
    problem = (
        F.when(F.isnan(v), "not a number")
        .when(F.abs(v) == float("inf"), "infinite")
        .when(v < 0, "negative")
    )
    return (
        inputs.select("asset_id", F.inline(cells))
        .where(v.isNotNull())
        .withColumn("problem", problem)
        .where(F.col("problem").isNotNull())
    )


def applicable() -> Column:
    return ~(F.col("primitive_type").isin(policy.NO_TIMELINE_PRIMITIVES) | is_pqc(F.col("algorithm")))


def migration_years(primitive: Column) -> Column:
    return F.coalesce(lookup(primitive, policy.MIGRATION_YEARS), F.lit(policy.MIGRATION_YEARS_OTHER))


def exposure(vulnerable: Column, threat: Column, sensitive: Column, x: Column, z: Column) -> Column:
    """Harvest-now-decrypt-later exposure tier."""
    flagged = F.coalesce(sensitive, F.lit(False))
    cleared = F.coalesce(~sensitive, F.lit(False))
    margin = x - z
    return (
        F.when(vulnerable.isNull(), "UNKNOWN")
        .when(~vulnerable, "NONE")
        .when(threat == "GROVER_BIT_HALVING", F.when(flagged, "MEDIUM").otherwise("LOW"))
        .when(threat.isNull() | (threat != "SHOR_POLYNOMIAL_BREAK"), "UNKNOWN")
        .when(x.isNull(), F.when(flagged, "HIGH").otherwise("UNKNOWN"))
        .when(x < policy.EXPOSURE_MIN_LIFETIME, "LOW")
        .when(margin > policy.EXPOSURE_CRITICAL, F.when(cleared, "HIGH").otherwise("CRITICAL"))
        .when(margin > policy.EXPOSURE_HIGH, "HIGH")
        .when(margin > policy.EXPOSURE_MEDIUM, "MEDIUM")
        .otherwise("LOW")
    )


def urgency(
    is_applicable: Column, vulnerable: Column, triggered: Column, tier: Column, gap: Column, z: Column, y: Column
) -> Column:
    pressing = (tier == "CRITICAL") | (gap <= policy.IMMEDIATE_GAP_YEARS)
    close = (z - y <= policy.PLANNED_BUFFER_YEARS) | tier.isin("HIGH", "CRITICAL")
    return (
        F.when(~is_applicable, "NOT_REQUIRED")
        .when(triggered.isNull(), "UNKNOWN")
        .when(triggered, F.when(pressing, "IMMEDIATE").otherwise("URGENT"))
        .when(vulnerable, F.when(close, "PLANNED").otherwise("MONITOR"))
        .when(~vulnerable, "NOT_REQUIRED")
        .otherwise("UNKNOWN")
    )


def assess_timeline(
    assets: DataFrame, inputs: DataFrame | None = None, config: TimelineConfig = TimelineConfig(), explain: bool = True,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Timeline assessment per asset; the columns in ``keep`` pass through.

    ``inputs`` (asset_id, X, Y, Z, hndl_sensitive, assessment_date) are optional and may
    cover only some assets; what they leave open comes from ``config``. Durations are
    expected to be valid (see ``invalid_durations``). asset_id must be unique in the inputs;
    assets that share an id share its inputs.
    """
    columns = ["asset_id", "algorithm", "primitive_type", "quantum_vulnerable", "quantum_threat_type"]
    df = assets.select(*columns, *keep)
    if inputs is not None:
        given = inputs.select("asset_id", *INPUT_COLUMNS, "hndl_sensitive", "assessment_date")
        df = df.join(given, "asset_id", "left")
    else:
        df = df.select(
            "*", *[F.lit(None).cast("double").alias(c) for c in INPUT_COLUMNS],
            F.lit(None).cast("boolean").alias("hndl_sensitive"), F.lit(None).cast("date").alias("assessment_date"),
        )
    derived = migration_years(F.col("primitive_type")) if config.use_primitive_defaults else F.lit(None).cast("double")
    df = bind(
        df,
        applicable=applicable(),
        x=F.coalesce("protected_lifetime_years", F.lit(config.protected_lifetime_years).cast("double")),
        y=F.coalesce("migration_time_years", F.lit(config.migration_time_years).cast("double"), derived),
        _y_set=F.lit(config.migration_time_years is not None),
        z=F.coalesce("quantum_arrival_years", F.lit(config.quantum_arrival_years).cast("double")),
    )
    return _assess(df, explain, keep)


def _assess(df: DataFrame, explain: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    on, x, y, z = F.col("applicable"), F.col("x"), F.col("y"), F.col("z")
    both = on & x.isNotNull() & y.isNotNull()
    df = bind(
        df,
        x_plus_y=F.when(both, x + y),
        inequality_triggered=F.when(both, x + y > z),
        exposure_gap_years=F.when(both, F.greatest(F.lit(0.0), x + y - z)),
        migration_deadline_years=F.when(both, z - y),
        hndl_exposure=F.when(~on, "NONE").otherwise(
            exposure(F.col("quantum_vulnerable"), F.col("quantum_threat_type"), F.col("hndl_sensitive"), x, z)
        ),
    )
    df = bind(
        df,
        urgency=urgency(
            on, F.col("quantum_vulnerable"), F.col("inequality_triggered"), F.col("hndl_exposure"),
            F.col("exposure_gap_years"), z, y,
        ),
    )
    passed = [c for c in ("scenario_x", "scenario_z") if c in df.columns]
    return df.select(
        "asset_id", *passed, *keep,
        F.when(on, x).alias("x_data_lifetime_years"),
        F.when(on, y).alias("y_migration_time_years"),
        F.when(on, z).alias("z_quantum_arrival_years"),
        "x_plus_y", "inequality_triggered", "exposure_gap_years", "urgency", "hndl_exposure",
        "migration_deadline_years", "assessment_date", F.col("applicable"),
        *(_explanations() if explain else []),
    )


def _explanations() -> list[Column]:
    on, x, y, z = F.col("applicable"), F.col("x"), F.col("y"), F.col("z")
    lines = lambda *cells: F.array_compact(F.array(*cells))
    assumptions = F.when(~on, F.array(F.lit("the timeline does not apply to this kind of asset"))).otherwise(lines(
        F.when(F.col("quantum_arrival_years").isNull(), F.format_string("Z = %.1f years is the configured default", z)),
        F.when(F.col("migration_time_years").isNull() & y.isNotNull(),
               F.when(F.col("_y_set"), F.format_string("Y = %.1f years is the configured default", y))
               .otherwise(F.format_string("Y = %.1f years is the default for %s", y, "primitive_type"))),
        F.when(y.isNull(), F.lit("Y is not known")),
        F.when(F.col("protected_lifetime_years").isNull() & x.isNotNull(),
               F.format_string("X = %.1f years is the configured default", x)),
        F.when(x.isNull(), F.lit("X is not known; the inequality stays undecided")),
        F.when(F.col("hndl_sensitive").isNull(), F.lit("sensitivity to later decryption is not stated")),
        F.when(F.col("quantum_threat_type") == "GROVER_BIT_HALVING",
               F.lit("quantum search weakens but does not break this asset")),
    ))
    rationale = F.when(~on, F.array(F.lit("no migration is required"))).otherwise(lines(
        F.when(F.col("x_plus_y").isNotNull(), F.format_string(
            "X + Y = %.1f years against Z = %.1f years: %s", "x_plus_y", z,
            F.when(F.col("inequality_triggered"), "exposed").otherwise("in time"))),
        F.when(F.col("x_plus_y").isNull(), F.lit("X + Y cannot be computed")),
        F.concat(F.lit("exposure "), F.col("hndl_exposure")),
        F.concat(F.lit("urgency "), F.col("urgency")),
    ))
    return [assumptions.alias("assumptions"), rationale.alias("rationale")]


def scenario_grid(
    assets: DataFrame, xs: list[float], zs: list[float], inputs: DataFrame | None = None, explain: bool = False
) -> DataFrame:
    """The assessment of every asset under every given X and Z, in one pass: the short
    list of scenarios is a constant array expanded per row, so nothing is shuffled."""
    grid = F.array(*[
        F.struct(F.lit(float(x)).alias("scenario_x"), F.lit(float(z)).alias("scenario_z")) for x in xs for z in zs
    ])
    df = assets.select("asset_id", "algorithm", "primitive_type", "quantum_vulnerable", "quantum_threat_type")
    if inputs is not None:
        df = df.join(inputs.select("asset_id", "migration_time_years", "hndl_sensitive", "assessment_date"), "asset_id", "left")
    else:
        df = df.select("*", F.lit(None).cast("double").alias("migration_time_years"),
                       F.lit(None).cast("boolean").alias("hndl_sensitive"),
                       F.lit(None).cast("date").alias("assessment_date"))
    df = bind(df, applicable=applicable(), y=F.coalesce("migration_time_years", migration_years(F.col("primitive_type"))), _y_set=F.lit(False))
    df = df.select("*", F.inline(grid)).select(
        "*", F.col("scenario_x").alias("x"), F.col("scenario_z").alias("z"),
        F.col("scenario_x").alias("protected_lifetime_years"), F.col("scenario_z").alias("quantum_arrival_years"),
    )
    return _assess(df, explain)


def scenario_index(assets: DataFrame, xs: list[float], zs: list[float]) -> DataFrame:
    """Triggered assets per (X, Z). Only Y varies between assets here, so assets are counted
    per Y first and the grid is laid over those few counts."""
    counts = (
        assets.where(applicable())
        .groupBy(migration_years(F.col("primitive_type")).alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = F.array(*[
        F.struct(F.lit(float(x)).alias("scenario_x"), F.lit(float(z)).alias("scenario_z")) for x in xs for z in zs
    ])
    hit = F.col("scenario_x") + F.col("y") > F.col("scenario_z")
    return (
        counts.select("y", "n", F.inline(grid))
        .groupBy("scenario_x", "scenario_z")
        .agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("triggered"))
    )


_CLASS = ["applicable", "quantum_vulnerable", "quantum_threat_type", "hndl_sensitive"]
RANKS = 4096  #: migration times of a row of the rank table


def scenario_ranks(assets: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """The table from which ``scenario_counts`` answers any list of scenarios: for each class
    of assets that X and Z treat alike, its migration times in order, ``RANKS`` in a row,
    and how many assets have each and all up to it. Its size hangs on the number of distinct
    migration times. Inputs (asset_id, migration_time_years, hndl_sensitive) are optional."""
    df = assets.select("asset_id", "algorithm", "primitive_type", "quantum_vulnerable", "quantum_threat_type")
    if inputs is not None:
        df = df.join(inputs.select("asset_id", "migration_time_years", "hndl_sensitive"), "asset_id", "left")
    else:
        df = df.select("*", F.lit(None).cast("double").alias("migration_time_years"), F.lit(None).cast("boolean").alias("hndl_sensitive"))
    y = F.coalesce("migration_time_years", migration_years(F.col("primitive_type")).cast("double")).alias("y")
    counts = df.select(applicable().alias("applicable"), *_CLASS[1:], y).groupBy(*_CLASS, "y").agg(F.count("*").alias("n"))
    # Times are dealt to rows by whole years, of which there are few, and then by rank.
    year = F.floor("y").alias("year")
    place = F.row_number().over(Window.partitionBy(*_CLASS, "year").orderBy("y"))
    rows = counts.select("*", year).withColumn("part", F.floor((place - 1) / RANKS))
    held = rows.groupBy(*_CLASS, "year", "part").agg(F.array_sort(F.collect_list(F.struct("y", "n"))).alias("held"))
    upto = lambda held: F.aggregate(
        held, F.array(F.lit(0).cast("long")), lambda a, h: F.concat(a, F.array(F.element_at(a, -1) + h["n"])))
    return bind(held, ys=F.transform("held", lambda h: h["y"]), upto=upto(F.col("held"))).drop("held", "year", "part")


def scenario_counts(ranks: DataFrame, xs: list[float], zs: list[float]) -> DataFrame:
    """(scenario_x, scenario_z, urgency, hndl_exposure, n): assets by outcome under every given
    X and Z. Urgency changes at three migration times of a class; how many assets lie below
    each is read off the rank table, so no scenario ever meets an asset, and what is shuffled
    are counts by outcome."""
    grid = F.array(*[F.struct(F.lit(float(x)).alias("scenario_x"), F.lit(float(z)).alias("scenario_z")) for x in xs for z in zs])
    df = ranks.select("*", F.inline(grid))
    x, z, ys = F.col("scenario_x"), F.col("scenario_z"), F.col("ys")

    def below(test) -> Column:
        """How many of a row's times pass a test that holds up to some time only."""
        first, last, n = F.get(ys, F.lit(0)), F.element_at(ys, -1), F.size(ys)
        return F.when(test(last), n).when(~test(first), 0).otherwise(F.size(F.filter(ys, test)))

    df = bind(
        df, _calm=below(lambda y: ~(x + y > z)), _pressing=below(lambda y: F.greatest(F.lit(0.0), x + y - z) <= policy.IMMEDIATE_GAP_YEARS),
        _far=below(lambda y: ~(z - y <= policy.PLANNED_BUFFER_YEARS)),
        hndl_exposure=F.when(~F.col("applicable"), "NONE").otherwise(exposure(F.col("quantum_vulnerable"), F.col("quantum_threat_type"), F.col("hndl_sensitive"), x, z)))
    end, calm, tier = F.size(ys), F.col("_calm"), F.col("hndl_exposure")
    between = lambda a, b: F.get(F.col("upto"), F.greatest(a, b)) - F.get(F.col("upto"), a)
    soon = F.when(tier == "CRITICAL", end).otherwise(F.greatest(F.col("_pressing"), calm))
    near = F.when(tier.isin("HIGH", "CRITICAL"), 0).otherwise(F.least(F.col("_far"), calm))
    on, vulnerable = F.col("applicable"), F.col("quantum_vulnerable")
    outcome = lambda name, n: F.struct(F.lit(name).alias("urgency"), n.cast("long").alias("n"))
    rest = F.when(~vulnerable, F.array(outcome("NOT_REQUIRED", between(F.lit(0), calm)))).when(vulnerable, F.array(
        outcome("MONITOR", between(F.lit(0), near)), outcome("PLANNED", between(near, calm)))).otherwise(F.array(outcome("UNKNOWN", between(F.lit(0), calm))))
    outcomes = F.when(~on, F.array(outcome("NOT_REQUIRED", between(F.lit(0), end)))).otherwise(
        F.concat(F.array(outcome("IMMEDIATE", between(calm, soon)), outcome("URGENT", between(soon, end))), rest))
    df = df.select("scenario_x", "scenario_z", "hndl_exposure", F.inline(outcomes)).where("n > 0")
    return df.groupBy("scenario_x", "scenario_z", "urgency", "hndl_exposure").agg(F.sum("n").alias("n"))


def timeline_report(timeline: DataFrame) -> DataFrame:
    """Counts and zero-filled distributions in one row."""
    return timeline.agg(
        F.count(F.lit(1)).alias("total_assets"),
        F.count_if("applicable").alias("applicable_assets"),
        F.count_if(F.coalesce("inequality_triggered", F.lit(False))).alias("triggered_assets"),
        F.count_if(~F.col("hndl_exposure").isin("NONE", "UNKNOWN")).alias("exposed_assets"),
        *[F.count_if(F.col("urgency") == u).alias(f"urgency_{u.lower()}") for u in policy.URGENCIES],
        *[F.count_if(F.col("hndl_exposure") == e).alias(f"hndl_{e.lower()}") for e in policy.EXPOSURES],
    )


def urgency_rank(c: Column) -> Column:
    return F.coalesce(lookup(c, {u: i for i, u in enumerate(policy.URGENCIES)}), F.lit(99))


def highest_urgency(timeline: DataFrame, n: int = 10) -> DataFrame:
    """The n most urgent assets; those that need nothing are removed after the cut."""
    top = timeline.orderBy(urgency_rank(F.col("urgency")), "asset_id").limit(n)
    return top.where(F.col("urgency") != "NOT_REQUIRED").select(
        "asset_id", "urgency", "hndl_exposure", "inequality_triggered", "applicable"
    )
