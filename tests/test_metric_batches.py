"""Minute metrics of a batch come from stored events, classified once for all batches."""

from cargolume.catalog import QUERIES
from cargolume.streaming import sinks

SMALL = "/root/testdata/sf0.001"


def test_batches_do_not_classify_again(spark, monkeypatch):
    plans, write = [], sinks.write_metric_batch_a

    def seen(frame, batch_id, path):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        write(frame, batch_id, path)

    monkeypatch.setattr(sinks, "write_metric_batch_a", seen)
    assert QUERIES["write_metric_batch_a"](spark, SMALL).count() > 0
    assert len(plans) == 2 and not any("json" in plan.lower() for plan in plans)
