"""Data-quality checks over the faulty derived log."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolume import contract as c
from cargolume.catalog.logs import with_log
from cargolume.catalog.models import HOURLY, PROCESSED, a_sql, marts_sql, operations_mart
from cargolume.catalog.registry import query
from cargolume.operators import metrics, quality
from cargolume.plans import facts
from cargolume.sources.derived_log import event_log, faulty_log, processed_log

_LEGAL = " ".join(f"when '{k}' then '{v}'" for k, v in c.STATUS_OF_TYPE.items())


def _words(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query(
    "check_unique",
    with_log("select product_id, region, count(*) occurrences from f group by 1, 2 having count(*) > 1", "f"),
)
def _(spark, sf):
    return quality.check_unique(faulty_log(spark, sf), "product_id", "region")


@query(
    "check_unique_combination",
    a_sql("select metric_hour, region, count(*) occurrences from (select * from pay_a union all select * from pay_a where region = 'us-east') group by 1, 2 having count(*) > 1"),
)
def _(spark, sf):
    mart = PROCESSED["payments"](spark, sf)
    doubled = mart.unionByName(mart.filter("region = 'us-east'"))
    return quality.check_unique(doubled, "metric_hour", "region")


_NOT_NULL = ("event_id", "customer_id", "order_id", "region", "ingested_at")
_ACCEPTED = {"status": tuple(c.STATUS_OF_TYPE.values()), "region": c.REGIONS, "payment_provider": c.PAYMENT_PROVIDERS}


@query(
    "check_columns",
    with_log(
        " union all ".join(
            [f"select 'not_null' \"check\", '{n}' column_name, count(*) filter (where {n} is null) violations from f" for n in _NOT_NULL]
            + [f"select 'accepted_values', '{n}', count(*) filter (where {n} not in {_words(v)}) from f" for n, v in _ACCEPTED.items()]
        ),
        "f",
    ),
)
def _(spark, sf):
    return quality.check_columns(faulty_log(spark, sf), _NOT_NULL, _ACCEPTED)


@query(
    "check_relationships",
    with_log(
        """select order_id, count(*) "rows" from f where event_type like 'payment%'
        and order_id is not null and order_id not in
        (select order_id from f where event_type = 'order_created') group by 1""",
        "f",
    ),
)
def _(spark, sf):
    log = faulty_log(spark, sf)
    return quality.check_relationships(
        log.filter("event_type like 'payment%'"),
        "order_id",
        log.filter("event_type = 'order_created'"),
        "order_id",
    )


@query(
    "fact_order_orphans",
    with_log(
        """select fact, order_id, count(*) "rows" from (select case when event_type like 'payment%'
        then 'payments' when event_type like 'shipment%' then 'shipments' else 'refunds' end fact,
        order_id from f where event_type not in ('order_created', 'customer_login',
        'inventory_updated') and order_id is not null) t where order_id not in
        (select order_id from f where event_type = 'order_created') group by 1, 2""",
        "f",
    ),
)
def _(spark, sf):
    log = faulty_log(spark, sf)
    orders = log.filter("event_type = 'order_created'")
    parts = []
    for fact, kinds in (
        ("payments", c.PAYMENT_TYPES),
        ("shipments", c.SHIPMENT_TYPES),
        ("refunds", ("refund_requested",)),
    ):
        child = log.filter(F.col("event_type").isin(*kinds))
        orphans = quality.check_relationships(child, "order_id", orders, "order_id")
        parts.append(orphans.withColumn("fact", F.lit(fact)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "check_lineage_unique",
    with_log(
        """select source_topic, source_partition::bigint source_partition, source_offset,
        count(*) duplicate_count from f group by all having count(*) > 1""",
        "f",
    ),
)
def _(spark, sf):
    return quality.check_lineage_unique(faulty_log(spark, sf))


@query(
    "check_status_matches_type",
    with_log(f"select event_id, event_type, status from f where status <> case event_type {_LEGAL} end", "f"),
)
def _(spark, sf):
    return quality.check_status_matches_type(faulty_log(spark, sf))


@query(
    "check_payment_status",
    with_log(
        """select event_id source_event_id, event_type, status,
        event_type = 'payment_processed' payment_succeeded from f
        where (event_type = 'payment_processed' and status <> 'paid')
          or (event_type = 'payment_failed' and status <> 'failed')""",
        "f",
    ),
)
def _(spark, sf):
    return quality.check_payment_status(facts.fct_payment_attempts(faulty_log(spark, sf)))


@query(
    "check_amounts_nonnegative",
    with_log(
        """select case when event_type = 'order_created' then 'orders' when event_type like
        'payment%' then 'payment_attempts' else 'refund_requests' end fact_name,
        event_id source_event_id, amount::double amount from f where amount < 0""",
        "f",
    ),
)
def _(spark, sf):
    log = faulty_log(spark, sf)
    return quality.check_amounts_nonnegative(
        facts.fct_orders(log), facts.fct_payment_attempts(log), facts.fct_refund_requests(log)
    )


@query(
    "check_rates_bounded",
    marts_sql(
        """select 'payment_health' model_name, failure_rate - 0.95 rate from payments
        where failure_rate - 0.95 not between 0 and 1
        union all select 'shipment_health', delayed_shipment_rate from shipments
        where delayed_shipment_rate not between 0 and 1
        union all select 'operations_payment', payment_failure_rate from health
        where payment_failure_rate not between 0 and 1
        union all select 'operations_shipment', delayed_shipment_rate from health
        where delayed_shipment_rate not between 0 and 1""".replace(
            "failure_rate - 0.95 rate", "(round((failure_rate - 0.95) * 1000000) / 1000000)::double rate"
        )
    ),
)
def _(spark, sf):
    # Payment rates are shifted down by 0.95 so that most leave the legal range.
    shifted = HOURLY["payments"](spark, sf).withColumn(
        "failure_rate", F.expr("cast(failure_rate - 0.95 as decimal(12,6))")
    )
    return quality.check_rates_bounded(
        shifted, HOURLY["shipments"](spark, sf), operations_mart(spark, sf)
    )


@query(
    "check_minute_windows",
    with_log(
        """select window_start, window_end, event_type, event_count, total_amount from (
        select date_trunc('minute', event_ts) window_start, date_trunc('minute', event_ts) +
        case when event_type = 'refund_requested' then interval 2 minute else interval 1 minute end
        window_end, event_type, count(*) event_count, coalesce(sum(amount), 0)::double total_amount
        from f group by 1, 2, 3) where event_type = 'refund_requested' or total_amount < 0""",
        "f",
    ),
)
def _(spark, sf):
    totals = metrics.minute_totals(faulty_log(spark, sf)).drop("updated_at")
    late = F.col("window_end") + F.make_dt_interval(mins=F.lit(1))
    stretched = totals.withColumn(
        "window_end",
        F.when(F.col("event_type") == "refund_requested", late).otherwise(F.col("window_end")),
    )
    return quality.check_minute_windows(stretched)


@query(
    "check_single_shipment_per_order",
    with_log(
        """select order_id, count(*) creation_count from f where event_type = 'shipment_created'
        group by 1 having count(*) > 1""",
        "f",
    ),
)
def _(spark, sf):
    return quality.check_single_shipment_per_order(faulty_log(spark, sf))


@query(
    "check_counts_reconcile",
    a_sql(
        """select metric_hour, region, event_count - 20 event_count, order_count from ops_a
        where event_count - 20 < order_count or event_count - 20 < payment_attempt_count
          or failed_payment_count > payment_attempt_count"""
    ),
)
def _(spark, sf):
    # Twenty events are taken off every hour, so thin hours no longer reconcile.
    mart = PROCESSED["operations"](spark, sf).withColumn("event_count", F.col("event_count") - 20)
    return quality.check_counts_reconcile(mart).select(
        "metric_hour", "region", "event_count", "order_count"
    )


@query(
    "check_failure_rate_a",
    a_sql("""select metric_hour, region, payment_failure_rate * 20 payment_failure_rate from pay_a
    where payment_failure_rate * 20 > 1"""),
)
def _(spark, sf):
    # Rates are scaled by twenty to leave the legal range in bad hours.
    mart = PROCESSED["payments"](spark, sf).withColumn(
        "payment_failure_rate", F.col("payment_failure_rate") * 20
    )
    return quality.check_failure_rate(mart).select("metric_hour", "region", "payment_failure_rate")


@query(
    "check_revenue_nonnegative_a",
    a_sql("""select metric_hour, region, (successful_revenue - 5000000)::double successful_revenue
    from rev_a where successful_revenue < 5000000"""),
)
def _(spark, sf):
    # Five million is taken off each hour, so small hours turn negative.
    mart = PROCESSED["revenue"](spark, sf).withColumn(
        "successful_revenue", F.col("successful_revenue") - 5_000_000
    )
    return quality.check_revenue_nonnegative(mart).select(
        "metric_hour", "region", "successful_revenue"
    )


@query(
    "source_freshness",
    with_log(
        """select max(processed_at) newest, (epoch(timestamp '2026-09-06 12:00:00')
        - epoch(max(processed_at)))::double age_seconds, case
        when epoch(timestamp '2026-09-06 12:00:00') - epoch(max(processed_at)) > 86400 then 'error'
        when epoch(timestamp '2026-09-06 12:00:00') - epoch(max(processed_at)) > 1800 then 'warn'
        else 'pass' end status from p""",
        "p",
    ),
)
def _(spark, sf):
    now = F.lit("2026-09-06 12:00:00Z").cast("timestamp")
    return quality.source_freshness(processed_log(spark, sf), "processed_at", now)


@query(
    "quality_summary",
    with_log(
        """select status, count(*) results, status not in ('pass', 'success') failed from (
        select case when status = 'failed' then 'fail' when status = 'delayed' then 'warn'
        when status = 'paid' then 'success' else 'pass' end status from e) group by 1"""
    ),
)
def _(spark, sf):
    results = event_log(spark, sf).selectExpr(
        "event_id unique_id",
        "case status when 'failed' then 'fail' when 'delayed' then 'warn' when 'paid' "
        "then 'success' else 'pass' end status",
    )
    return quality.quality_summary(results)
