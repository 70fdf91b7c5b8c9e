"""Operational summaries, alerts and fingerprints over ledger tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolume.contract import SOURCE_KEY
from cargolume.functions.exprs import seconds_between
from cargolume.plans.publication import consecutive_failures, latest_successful_build
from cargolume.session import scratch_dir


def _metric(frame: DataFrame, name: str, value: Column, label: Column | None = None) -> DataFrame:
    return frame.select(
        F.lit(name).alias("metric"),
        (F.lit(None).cast("string") if label is None else label).alias("label"),
        value.cast("double").alias("value"),
    )


def ops_summary(
    builds: DataFrame,
    quality_runs: DataFrame,
    events: DataFrame,
    batches: DataFrame,
    detector_runs: DataFrame,
    incidents: DataFrame,
) -> DataFrame:
    """(metric, label, value) rows; a metric without data is absent."""
    newest = builds.orderBy(F.desc("started_at"), F.desc("build_id")).limit(1)
    published = latest_successful_build(builds)
    quality = published.select("build_id").join(quality_runs, "build_id")
    finished = detector_runs.filter("completed_at is not null")
    last = finished.orderBy(F.desc("completed_at")).limit(1)
    stored = events.agg(
        F.count("*").alias("rows"), F.max("ingested_at").alias("ingested")
    )
    ledger = batches.agg(
        F.count("*").alias("batches"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("inserted")
    )
    epoch = lambda c: F.unix_micros(c) / F.lit(1e6)
    zero = F.lit(0.0)
    parts = [
        _metric(builds.groupBy("status").count(), "builds", F.col("count"), F.col("status")),
        _metric(newest, "latest_attempt_failed", (F.col("status") == "failed").cast("int")),
        _metric(
            newest.filter("completed_at is not null"),
            "last_build_seconds",
            F.greatest(zero, seconds_between("completed_at", "started_at")),
        ),
        _metric(consecutive_failures(builds), "consecutive_failures", F.col("consecutive_failures")),
        _metric(published.agg(F.count("*").alias("n")), "publication_present", F.col("n")),
        _metric(published, "last_success_epoch", epoch("published_at")),
        _metric(
            published.filter("source_max_ingested_at is not null"),
            "published_ingested_epoch",
            epoch("source_max_ingested_at"),
        ),
        _metric(published, "published_events", F.col("source_event_count")),
        _metric(quality, "quality_results", F.col("pass_count"), F.lit("pass")),
        _metric(quality, "quality_results", F.col("success_count"), F.lit("success")),
        _metric(stored, "committed_rows", F.col("rows")),
        _metric(stored.filter("ingested is not null"), "warehouse_ingested_epoch", epoch("ingested")),
        _metric(ledger, "committed_batches", F.col("batches")),
        _metric(ledger, "inserted_rows", F.col("inserted")),
        _metric(
            detector_runs.groupBy("status", F.coalesce("skip_reason", F.lit("none")).alias("reason")).count(),
            "detector_evaluations",
            F.col("count"),
            F.concat_ws("/", "status", "reason"),
        ),
        _metric(incidents.agg(F.count("*").alias("n")), "incidents_created", F.col("n")),
        _metric(last, "last_evaluation_epoch", epoch("completed_at")),
        _metric(
            last,
            "last_detector_seconds",
            F.greatest(zero, seconds_between("completed_at", "started_at")),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def publication_gap(builds: DataFrame, events: DataFrame) -> DataFrame:
    """Seconds of ingested data the latest publication does not hold yet."""
    newest = latest_successful_build(builds).select("source_max_ingested_at").scalar()
    return events.agg(F.max("ingested_at").alias("warehouse_max_ingested_at")).select(
        "warehouse_max_ingested_at",
        newest.alias("published_max_ingested_at"),
        seconds_between("warehouse_max_ingested_at", newest).alias("gap_seconds"),
    )


# Thresholds of the alert rules, in seconds and counts.
PUBLICATION_AGE = 3600
SILENT_PROGRESS = 120
REPEATED_FAILURES = 2


def ops_alerts(summary: DataFrame, now: Column, raw_progress_at: Column | None = None) -> DataFrame:
    """(alert, firing) over the summary rows; a missing metric never fires by itself."""
    wide = summary.agg(
        *[
            F.max(F.when(F.col("metric") == name, F.col("value"))).alias(name)
            for name in (
                "latest_attempt_failed",
                "consecutive_failures",
                "last_success_epoch",
                "published_ingested_epoch",
                "warehouse_ingested_epoch",
                "publication_present",
                "committed_rows",
            )
        ]
    )
    clock = F.unix_micros(now) / F.lit(1e6)
    silent = (
        F.lit(None).cast("boolean")
        if raw_progress_at is None
        else seconds_between(now, raw_progress_at) > SILENT_PROGRESS
    )
    rules = {
        "latest_attempt_failed": F.col("latest_attempt_failed") == 1,
        "repeated_failures": F.col("consecutive_failures") >= REPEATED_FAILURES,
        "publication_behind_ingestion": (clock - F.col("last_success_epoch") > PUBLICATION_AGE)
        & (F.col("warehouse_ingested_epoch") > F.col("published_ingested_epoch")),
        "publication_missing_with_data": (F.col("publication_present") == 0)
        & (F.col("committed_rows") > 0),
        "raw_progress_silent": silent,
    }
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("alert"), F.coalesce(rule, F.lit(False)).alias("firing"))
            for name, rule in rules.items()
        ]
    )
    return wide.select(F.inline(rows))


def snapshot_fingerprint(events: DataFrame) -> DataFrame:
    """Counts, distinct identities and amount of a stored event set.

    Distinct identities are groups counted on their own, so no row is expanded per identity.
    """
    totals = events.agg(
        F.count("*").alias("event_count"),
        F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(24,2)").alias("total_amount"),
    )
    known = lambda keys: events.select(*keys).dropna().distinct()
    ids = known(["event_id"]).agg(F.count("*").alias("distinct_ids"))
    sources = known(list(SOURCE_KEY)).agg(F.count("*").alias("distinct_sources"))
    both = totals.join(F.broadcast(ids)).join(F.broadcast(sources))  # one row each
    return both.select("event_count", "distinct_ids", "distinct_sources", "total_amount").withColumn(
        "has_duplicates",
        (F.col("event_count") != F.col("distinct_ids"))
        | (F.col("event_count") != F.col("distinct_sources")),
    )


def exact_percentiles(
    frame: DataFrame, group: str, value: str, fractions: dict[str, float], interpolate: bool = True
) -> DataFrame:
    """Exact percentiles per group without collecting a group anywhere; a null group is a group.

    Values are counted per (group, value), so a hot value is one row, and laid out in ranges of (group,
    value) of even size whatever the groups. Sums per range tell where each wanted place lies, and only
    those ranges are read again and ranked. No join or window has a whole group's values.
    """
    spark = frame.sparkSession
    rows = frame.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    counted = rows.groupBy("g", "v").agg(F.count("*").alias("m")).repartitionByRange("g", "v")
    ranged = counted.withColumn("part", F.spark_partition_id())
    path = scratch_dir(spark, "ranges")
    ranged.write.partitionBy("part").parquet(path)
    stored = spark.read.schema(ranged.schema).parquet(path)
    parts = stored.groupBy("g", "part").agg(F.sum("m").alias("in_part"), F.sum(F.col("v") * F.col("m")).alias("total"))
    whole = Window.partitionBy("g")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.select(
        F.col("g").alias("of"),
        F.col("part").alias("at"),
        "in_part",
        F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("base"),
        F.sum("in_part").over(whole).alias("n"),
        F.sum("total").over(whole).alias("total"),
    )
    steps = [rounded((F.col("n") - 1) * F.lit(float(f))) for f in fractions.values() for rounded in (F.floor, F.ceil)]
    lies_here = [(F.col("base") <= place) & (place < F.col("base") + F.col("in_part")) for place in steps]
    wanted = placed.filter(reduce(or_, lies_here))
    inside = Window.partitionBy("g", "part").orderBy("v")
    ranked = (
        stored.join(wanted, (F.col("part") == F.col("at")) & F.col("g").eqNullSafe(F.col("of")))
        .withColumn("last", F.col("base") + F.sum("m").over(inside) - 1)
        .withColumn("first", F.col("last") - F.col("m") + 1)
    )
    picks = []
    for name, fraction in fractions.items():
        place = (F.col("n") - 1) * F.lit(float(fraction))
        low = F.floor(place)
        high = F.ceil(place) if interpolate else low

        def at(position: Column) -> Column:
            return F.max(F.when((F.col("first") <= position) & (position <= F.col("last")), F.col("v")))

        picks += [at(low).alias(f"{name}_lo"), at(high).alias(f"{name}_hi")]
    found = ranked.groupBy("g").agg(F.max("n").alias("n"), (F.max("total") / F.max("n")).alias("mean"), *picks)
    out = []
    for name, fraction in fractions.items():
        place = (F.col("n") - 1) * F.lit(float(fraction))
        weight = place - F.floor(place)
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out.append((low + (high - low) * weight if interpolate else low).alias(name))
    return found.select(F.col("g").alias(group), F.col("n").alias("samples"), "mean", *out)
