import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from cargolume.contract import ENVELOPE_SCHEMA, RAW_SCHEMA
from cargolume.operators import validate
from cargolume.operators.classify import classify_events, valid_events
from cargolume.operators.envelope import accepted_events, dead_letters_a, dead_letters_b
from cargolume.operators.validate import validate_events

NOW = datetime(2026, 9, 8, 12, tzinfo=UTC)
ID = "12345678-1234-4234-8234-123456789abc"
GOOD = {
    "schema_version": 1, "event_id": ID, "event_type": "order_created",
    "timestamp": "2026-09-08T11:59:00+00:00", "customer_id": "c-1", "order_id": "o-1",
    "product_id": "p-1", "amount": "10.50", "currency": "USD", "region": "us-east",
    "status": "created", "metadata": {"b": 1, "a": {"z": 1, "c": 2}},
}
STOCK = {
    "event_id": ID, "event_type": "inventory_updated", "timestamp": "2026-09-08T11:59:00Z",
    "product_id": "p-1", "region": "us-east", "status": "updated", "metadata": {"quantity": 3},
}


def change(base=GOOD, **fields):
    return json.dumps({**base, **fields}).encode()


def without(*names, base=GOOD):
    return json.dumps({k: v for k, v in base.items() if k not in names}).encode()


CASES = [
    (b"{broken", "malformed_json"),
    (b"\xff", "malformed_json"),
    (b'{"metadata":{"bad":NaN}}', "malformed_json"),
    (b"", "malformed_json"),
    (change() + b" x", "malformed_json"),
    (change() + b"}", "malformed_json"),
    (change() + b",{}", "malformed_json"),
    (None, "other_validation"),
    (b"[]", "other_validation"),
    (b"null", "other_validation"),
    (b"{}", "missing_event_id"),
    (change(event_id=None), "missing_event_id"),
    (change(event_type="bad"), "invalid_event_type"),
    (change(event_type=[]), "invalid_event_type"),
    (change(schema_version=99), "schema_validation"),
    (change(schema_version="1"), "schema_validation"),
    (change(event_id="private-untrusted-value"), "schema_validation"),
    (change(extra=1), "schema_validation"),
    (change(extra=1, amount=-1), "invalid_business_fields"),
    (change(status="wrong"), "invalid_business_fields"),
    (change(timestamp="2026-09-08T12:05:01Z"), "invalid_business_fields"),
    (change(timestamp="2026-09-08T11:00:00"), "invalid_business_fields"),
    (change(timestamp="2019-12-31T23:59:59Z"), "invalid_business_fields"),
    (change(amount=12.345), "invalid_business_fields"),
    (change(amount=True), "invalid_business_fields"),
    (change(customer_id="a b"), "invalid_business_fields"),
    (change(customer_id="x" * 101), "invalid_business_fields"),
    (change(currency=None), "invalid_business_fields"),
    (change(metadata=[]), "invalid_business_fields"),
    (change(payment_provider="cash"), "invalid_business_fields"),
    (without("customer_id"), "invalid_business_fields"),
    (without("amount"), "invalid_business_fields"),
    (without("region"), "invalid_business_fields"),
    (change(STOCK, metadata={"quantity": True}), "invalid_business_fields"),
    (change(STOCK, metadata={"quantity": 5.0}), "invalid_business_fields"),
    (change(STOCK, metadata={"quantity": -1}), "invalid_business_fields"),
    (without("metadata", base=STOCK), "invalid_business_fields"),
    (change(), None),
    (b"\xef\xbb\xbf" + change(), None),
    (b"  " + change() + b"\n", None),
    (without("schema_version", "currency", "metadata"), None),
    (change(amount=10), None),
    (change(amount="010.500"), None),
    (change(timestamp="2026-09-08T17:44:00+05:45"), None),
    (change(timestamp="2026-09-08T12:05:00Z"), None),
    (change(event_id=ID.upper().replace("-", "")), None),
    (change(payment_provider=None), None),
    (change(STOCK), None),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [("t", 0, n, NOW, b"k", payload, NOW, NOW.date()) for n, (payload, _) in enumerate(CASES)]
    return validate_events(spark.createDataFrame(rows, RAW_SCHEMA))


def test_codes(verdicts):
    got = {r[0]: r[1] for r in verdicts.select("source_offset", "validation.error_code").collect()}
    wrong = [(CASES[n], got[n]) for n in range(len(CASES)) if got[n] != CASES[n][1]]
    assert wrong == []


def test_accepted_is_normalised(verdicts):
    rows = accepted_events(verdicts).collect()
    assert {r["event_id"] for r in rows} == {ID}
    event = next(r for r in rows if r["source_offset"] == [i for i, c in enumerate(CASES) if c[1] is None][0])
    assert str(event["amount"]) == "10.50"
    assert event["metadata"] == '{"a":{"c":2,"z":1},"b":1}'


TWICE = change()[:-1] + b', "region": "us-east"}'
PLAIN = [
    (change(metadata={"b": 1, "a": "x"}), True),
    (change(STOCK), True),
    (change(amount=10, metadata={}), True),
    (TWICE, False),
    (change(), False),  # nested metadata
    (change(metadata={}).replace(b"{}", b'{"a": 1, "a": 1}'), False),
    (change(customer_id="\u00e9", metadata={}), False),  # written as an escape
    (change(metadata={}, status="paid"), False),
    (change(metadata={}, timestamp="2026-02-30T00:00:00Z"), False),
    (change(STOCK, metadata={"quantity": "3"}), False),
]


def test_plain_records_are_not_parsed_as_variants(spark, monkeypatch):
    rows = [("t", 0, n, NOW, b"k", p, NOW, NOW.date()) for n, p in enumerate([p for p, _ in PLAIN] + [p for p, _ in CASES])]
    raw = spark.createDataFrame(rows, RAW_SCHEMA)
    plain = validate._plain_events(raw.withColumn("_text", F.col("raw_payload").cast("string")))
    told = {r[0]: r[1] for r in plain.select("source_offset", F.col("plain").isNotNull()).collect()}
    assert [told[n] for n in range(len(PLAIN))] == [is_plain for _, is_plain in PLAIN]
    fast = validate_events(raw).select("source_offset", "validation").collect()
    monkeypatch.setattr(validate, "PLAIN_BYTES", 0)  # every record takes the general way
    general = validate_events(raw).select("source_offset", "validation").collect()
    assert dict(map(tuple, fast)) == dict(map(tuple, general))


def test_dead_letters_keep_bytes(verdicts):
    letters = {r["key"]: json.loads(r["value"]) for r in dead_letters_b(verdicts).collect()}
    assert letters["t:0:1"]["payload_base64"] == "/w=="
    assert "private-untrusted-value" not in letters["t:0:16"]["error_detail"]
    assert "payload_base64" not in letters["t:0:7"]


def envelopes(spark, *payloads):
    rows = [("t", 0, n, NOW, b"k", p) for n, p in enumerate(payloads)]
    return spark.createDataFrame(rows, ENVELOPE_SCHEMA)


def test_classifier_codes_and_bytes(spark):
    odd = b"\xff\xfe\x00\x01"
    frame = classify_events(
        envelopes(spark, change(), b'{"event_id":', change(event_id=None), change(extra=1), odd,
                  without("region"), change(amount=12.345)),
        F.lit(NOW),
    )
    rows = {r["source_offset"]: r for r in frame.collect()}
    errors = {n: r["validation_errors"] for n, r in rows.items()}
    assert errors[0] == [] and rows[0]["is_valid"]
    assert errors[1][0] == "malformed_json"
    assert errors[2] == ["invalid_event_id"]
    assert errors[3] == ["unknown_field"]
    assert bytes(rows[4]["raw_bytes"]) == odd
    assert errors[5] == []  # absent region passes the literal rules
    assert errors[6] == ["invalid_amount"]
    strict = classify_events(envelopes(spark, without("region")), F.lit(NOW), strict=True).first()
    assert strict["validation_errors"] == ["invalid_region"]
    assert dead_letters_a(frame).count() == 5


def test_bad_timestamp_is_classified_not_thrown(spark):
    frame = classify_events(envelopes(spark, change(timestamp="not a time"), change(timestamp="10:00")), F.lit(NOW))
    assert [r["validation_errors"] for r in frame.collect()] == [["invalid_timestamp"]] * 2


def test_batch_dedup(spark):
    frame = classify_events(envelopes(spark, change(), change()), F.lit(NOW))
    assert valid_events(frame).count() == 1


def test_classifier_reports_every_code_in_order(spark):
    login = {**GOOD, "event_type": "customer_login", "status": "authenticated"}
    cases = [
        (change(region="x", status="paid", amount="1.234", extra=1), ["unknown_field", "invalid_region", "invalid_status", "invalid_amount"]),
        (without("amount"), ["invalid_amount"]),
        (without("amount", base=login), []),
        (change(STOCK, metadata={"quantity": "-3"}), ["invalid_inventory_quantity"]),
        (change(metadata={"quantity": "-3"}), []),
        (without("event_type", "amount"), []),
        (change(event_type="odd", amount="x"), ["malformed_json", "invalid_event_type"]),
    ]
    frame = classify_events(envelopes(spark, *[p for p, _ in cases]), F.lit(NOW))
    told = {r["source_offset"]: r for r in frame.collect()}
    errors = [told[n]["validation_errors"] for n in range(len(cases))]
    assert errors[:6] == [e for _, e in cases[:6]] and "invalid_event_type" in errors[6]
    assert [told[n]["is_valid"] for n in range(6)] == [not e for _, e in cases[:6]]
    # A lambda would have all conditions inside it interpreted.
    assert "lambda" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_stage_methods_are_small_enough_to_be_compiled(spark, tmp_path):
    spark.createDataFrame([], RAW_SCHEMA).write.parquet(str(tmp_path / "raw"))
    raw = spark.read.schema(RAW_SCHEMA).parquet(str(tmp_path / "raw"))
    plan = accepted_events(validate_events(raw))._jdf.queryExecution().executedPlan()
    stages = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package").codegenStringSeq(plan)
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert len(sizes) > 2 and max(sizes) < 8000, sizes


def test_a_second_key_is_seen_whatever_the_record_leaves(spark, tmp_path):
    body = (
        b'{"schema_version":1,"event_id":"00000000-0000-4000-a000-000000000001","event_type":"payment_failed",'
        b'"timestamp":"2026-09-08T10:00:00Z","customer_id":"c","order_id":"o","product_id":"p","amount":%b,'
        b'"payment_provider":"stripe","region":"us-east","status":"failed","metadata":%b}'
    )
    plain = body % (b"100000000.10", b'{"k":":x"}')
    payloads = [plain, plain.replace(b":", b": ").replace(b",", b", "), body % (b"0,\"amount\":0", b"{}"), body % (b"1.50", b'{"k":-0}')]
    payloads += [body % (b"1", meta) for meta in (b'{"a":1,"a":1}', b'{"b":1, "a":"/"}', b'{"\xff":1}', b'{"\xc3\xa9":1}')]
    payloads += [b"\xef\xbb\xbf" + plain, b"\xef\xbb\xbf" + plain[:-1], plain + b"}"]
    spark.createDataFrame([("t", 0, i, NOW, None, p, NOW, NOW.date()) for i, p in enumerate(payloads)], RAW_SCHEMA).write.parquet(str(tmp_path / "raw"))
    rows = validate_events(spark.read.schema(RAW_SCHEMA).parquet(str(tmp_path / "raw"))).orderBy("source_offset").collect()
    got = [r["validation"]["error_code"] or r["validation"]["event"]["metadata"] for r in rows]
    bad = "malformed_json"
    assert got[:1] == ['{"k":":x"}'] and got[2:] == [bad, '{"k":0}', bad, '{"a":"/","b":1}', bad, '{"é":1}', '{"k":":x"}', bad, bad], got
