"""Single-code contract validator as one native expression per record.

A plain record (contract fields only, no escapes, flat metadata, every field sound by itself) is told by
one pattern, parsed once as texts and accepted if the rules across fields hold. Any other payload, and
every rejected one, is parsed twice, both times wrapped, because a variant parse stops at the end of the
first JSON value: text that is valid both as `{"r":<text>}` and as the only element of `[<text>]` is
exactly one JSON value with nothing after it. Duplicate keys are rejected as malformed, as are UTF-16/32
payloads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolume import contract as c
from cargolume.functions.exprs import computed_once

_ISO_OFFSET = (
    r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?([Zz]|[+-]\d{2}:?\d{2})$"
)
_UUID = r"^[0-9a-fA-F]{8}(-?)[0-9a-fA-F]{4}\1[0-9a-fA-F]{4}\1[0-9a-fA-F]{4}\1[0-9a-fA-F]{12}$"
_IDENTIFIER = r"(?U)\A\S{1,100}\z"
_QUANTITY = (
    "if(schema_of_variant(try_variant_get({0}, '$.quantity', 'variant')) = 'BIGINT', "
    "try_variant_get({0}, '$.quantity', 'bigint'), null)"
)
# Every contract field as an untyped value, so an explicit null differs from absence.
_ANY_FIELDS = ", ".join(f"{name} variant" for name in c.PAYLOAD_FIELDS)
_AMOUNT = r"^[+-]?0*[0-9]{1,12}(\.[0-9]{1,2}0*)?$"


def _one_of(values) -> str:
    return "(?:" + "|".join(values) + ")"


def _any_of(first: int, last: int, but: str = "") -> str:
    """A character class, each character by itself: one table, where ranges are a chain of tests."""
    return "[" + "".join(f"\\x{n:02x}" for n in range(first, last + 1) if chr(n) not in but) + "]"


_HEX = "[0123456789abcdefABCDEF]"
# Printable ASCII that stands for itself in a JSON text. Other texts are no plain ones.
_PRINTED, _UNSPACED = (_any_of(first, 0x7E, '"\\') for first in (0x20, 0x21))
# The plain record. Possessive groups are matched in a loop, without backtracking or recursion.
_PLAIN_AMOUNT = r"(?:0|[1-9][0-9]{0,11}+)(?:\.[0-9]{1,2}+)?+"
_PLAIN_TEXTS = {
    "event_id": f"{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}",
    "event_type": _one_of(c.EVENT_TYPES),
    "timestamp": r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?+(?:Z|[+-]\d{2}:\d{2})",
    **{name: f"{_UNSPACED}{{1,100}}+" for name in ("customer_id", "order_id", "product_id")},
    "currency": c.CURRENCY,
    "payment_provider": _one_of(c.PAYMENT_PROVIDERS),
    "shipment_provider": _one_of(c.SHIPMENT_PROVIDERS),
    "region": _one_of(c.REGIONS),
    "status": _one_of(c.STATUS_OF_TYPE.values()),
}
_TEXT = f'"{_PRINTED}*+"'
_FLAT = rf"{_TEXT}: ?(?:{_TEXT}|-?(?:0|[1-9][0-9]{{0,14}}+)|true|false|null)"
_PAIR = _one_of(
    [
        *[rf'"{name}": ?"{text}"' for name, text in _PLAIN_TEXTS.items()],
        f'"schema_version": ?{c.SCHEMA_VERSION}',
        rf'"amount": ?(?:"{_PLAIN_AMOUNT}"|{_PLAIN_AMOUNT})',
        rf'"metadata": ?\{{(?:{_FLAT}(?:, ?{_FLAT})*+)?+\}}',
    ]
)
_PLAIN = rf"\A\{{{_PAIR}(?:, ?{_PAIR})*+\}}\z"
# Metadata of one pair, written as the variant of it would be.
_ONE_PAIR = rf"\A\{{{_TEXT}:(?:{_TEXT}|0|-?[1-9][0-9]{{0,14}}+|true|false|null)\}}\z"
#: Bytes of a record that may be read as a plain one.
PLAIN_BYTES = 16_384


def _field(name: str) -> Column:
    return F.col(f"json.{name}")


def _kind(name: str) -> Column:
    """JSON type of a field; VOID for an explicit null, NULL when absent."""
    return F.col(f"kinds.{name}")


def _string(name: str) -> Column:
    """Text of a field that is a JSON string, else NULL."""
    return F.col(f"texts.{name}")


def _given(name: str) -> Column:
    return F.coalesce(_kind(name) != "VOID", F.lit(False))


def _bad_optional(name: str, ok: Column) -> Column:
    return _given(name) & ~F.coalesce(ok, F.lit(False))


def _canonical_uuid(text: Column) -> Column:
    plain = F.lower(F.regexp_replace(text, "-", ""))
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(plain, start, size) for start, size in parts])


def _instant(text: Column) -> Column:
    tidy = F.regexp_replace(F.upper(text), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(
        text.rlike(_ISO_OFFSET), F.regexp_replace(tidy, ",", ".").try_cast("timestamp")
    )


def _amount_text() -> Column:
    """Decimal text of the amount with its value unchanged (no rounding to two places)."""
    kind, value = _kind("amount"), _field("amount")
    plain = value.cast("string")
    exponent = F.expr("cast(try_variant_get(json.amount, '$', 'decimal(30,8)') as string)")
    return (
        F.when(kind == "DOUBLE", exponent)
        .when(kind.isin("BIGINT", "STRING") | kind.startswith("DECIMAL"), plain)
    )


def _colons(text: Column) -> Column:
    """Number of quotes followed by a colon: one per key, and one more per text that begins so."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit('":'), F.lit('"')))


def _taken() -> Column:
    """Bytes that the fields found in a plain record take at least; amounts are re-written when read."""
    taken = F.lit(1)
    for name in c.PAYLOAD_FIELDS:
        around = len(name) + (6 if name in _PLAIN_TEXTS else 4)
        inside = F.lit(1) if name in ("amount", "schema_version") else F.octet_length(_text(name))
        taken += F.when(_text(name).isNotNull(), inside + around).otherwise(0)
    return taken


def _no_key_twice() -> Column:
    """No field of a plain record comes twice.

    A second one leaves bytes beyond what the fields found take: where too few are left, keys need no
    counting.
    """
    shortest = min(len(name) for name in c.PAYLOAD_FIELDS) + len(',"":1')
    keys = _colons(F.col("_text")) - F.coalesce(_colons(_text("metadata")), F.lit(0))
    return F.when(F.octet_length("_text") - F.col("_taken") < shortest, True).otherwise(keys == F.bit_count("_given"))


def _plain_events(texts: DataFrame) -> DataFrame:
    """`plain`: the event of a record that is plain and keeps the rules across fields, else NULL.

    A key that comes twice leaves more colons than fields, and metadata in which one does has no
    variant parse; neither is plain. Metadata of one pair stands as it is, unless its quantity is asked for.
    """
    shaped = (F.octet_length("raw_payload") <= PLAIN_BYTES) & F.col("_text").rlike(_PLAIN)
    columns = ", ".join(f"{name} string" for name in c.PAYLOAD_FIELDS)
    found = texts.withColumn("_f", F.from_json(F.when(shaped, F.col("_text")), columns))
    as_it_is = (_text("event_type") != "inventory_updated") & _text("metadata").rlike(_ONE_PAIR)
    found = found.withColumn("_kept", F.when(as_it_is, _text("metadata"))).withColumns(
        {
            "_metadata": F.try_parse_json(F.when(F.col("_kept").isNull(), _apart(_text("metadata")))),
            "_taken": _taken(),
            "_ts": F.col("_f.timestamp").try_cast("timestamp"),
            "_given": sum((F.when(_text(name).isNotNull(), 1 << n).otherwise(0) for n, name in enumerate(c.PAYLOAD_FIELDS)), F.lit(0)),
        }
    )
    kind, quantity = _text("event_type"), F.expr(_QUANTITY.format("_metadata"))
    legal = F.create_map(*[F.lit(x) for pair in c.STATUS_OF_TYPE.items() for x in pair])
    needed = F.create_map(*[F.lit(x) for kind_ in c.EVENT_TYPES for x in (kind_, _needed(kind_))])
    whole = (
        (_text("status") == legal[kind])
        & (F.bitwise_not("_given").bitwiseAND(needed[kind]) == 0)
        & _no_key_twice()
        & F.col("_ts").between(*_time_bounds())
        & (_text("metadata").isNull() | F.col("_kept").isNotNull() | F.col("_metadata").isNotNull())
        & ((kind != "inventory_updated") | (quantity >= 0))
    )
    typed = {
        "schema_version": F.lit(c.SCHEMA_VERSION),
        "event_id": F.lower(_text("event_id")),
        "event_ts": F.col("_ts"),
        "amount": _text("amount").try_cast("decimal(14,2)"),
        "currency": F.lit(c.CURRENCY),
        "metadata": F.coalesce("_kept", F.to_json("_metadata"), F.lit("{}")),
    }
    event = F.struct(*[typed.get(name, _text(name)).alias(name) for name in c.BUSINESS_COLUMNS])
    return found.withColumn("plain", computed_once(F.when(whole, event))).drop("_f", "_kept", "_metadata", "_taken", "_ts", "_given")


def _text(name: str) -> Column:
    """Text of a field of a plain record."""
    return F.col(f"_f.{name}")


def _needed(kind: str) -> int:
    """Fields an event type asks for, as bits of their places in the contract."""
    names = {"event_id", "event_type", "timestamp", "region", "status"}
    names |= {"customer_id"} if kind != "inventory_updated" else set()
    names |= {"order_id"} if kind not in ("inventory_updated", "customer_login") else set()
    names |= {"product_id"} if kind != "customer_login" else set()
    names |= {"amount"} if kind in c.MONEY_TYPES else set()
    names |= {"payment_provider"} if kind in c.PAYMENT_TYPES else set()
    names |= {"shipment_provider"} if kind in c.SHIPMENT_TYPES else set()
    return sum(1 << c.PAYLOAD_FIELDS.index(name) for name in names)


def _time_bounds() -> tuple[Column, Column]:
    earliest = F.expr("timestamp_seconds(unix_seconds(timestamp'2020-01-01 00:00:00Z'))")
    return earliest, F.col("ingested_at") + F.make_dt_interval(mins=F.lit(c.CLOCK_LEAD_MINUTES))


def validate_events(raw: DataFrame) -> DataFrame:
    """Archive rows plus `validation`: struct<event, error_code, error_detail>."""
    payload = F.col("raw_payload").cast("string")
    text = F.when(payload.startswith("\ufeff"), F.expr("substring(cast(raw_payload as string), 2)")).otherwise(payload)
    # Texts of accepted plain records are NULL from here on, so that the parses below skip them.
    staged = _plain_events(raw.withColumn("_text", text)).withColumn(
        "_text", F.when(F.col("plain").isNull(), F.col("_text"))
    )
    staged = staged.withColumns(
        {
            "_wrapped": F.try_parse_json(F.concat(F.lit('{"r":'), "_text", F.lit("}"))),
            "_listed": F.try_parse_json(F.concat(F.lit("["), "_text", F.lit("]"))),
        }
    )
    single = F.expr("try_variant_get(_listed, '$[1]', 'variant') is null")
    staged = staged.select(
        *raw.columns,
        "plain",
        (
            F.col("_wrapped").isNotNull()
            & F.col("_listed").isNotNull()
            & single
            & (F.length(F.trim("_text")) > 0)
            & F.is_valid_utf8(F.col("raw_payload").cast("string"))
        ).alias("is_json"),
        F.expr("schema_of_variant(try_variant_get(_wrapped, '$.r', 'variant'))")
        .startswith("OBJECT")
        .alias("is_object"),
        F.from_json("_text", _ANY_FIELDS).alias("json"),
        F.json_object_keys("_text").alias("names"),
    )
    # Structs that are NULL for accepted plain records, whose fields are then never computed.
    other = F.col("plain").isNull()
    kinds = [F.schema_of_variant(_field(name)).alias(name) for name in c.PAYLOAD_FIELDS]
    staged = staged.withColumn("kinds", F.when(other, _apart(F.struct(*kinds))))
    texts = [F.when(_kind(name) == "STRING", _field(name).cast("string")).alias(name) for name in c.PAYLOAD_FIELDS]
    staged = staged.withColumn("texts", F.when(other, _apart(F.struct(*texts))))
    values = [
        _instant(_string("timestamp")).alias("ts"),
        _amount_text().alias("amount"),
        F.expr(_QUANTITY.format("json.metadata")).alias("quantity"),
    ]
    staged = staged.withColumn("values", F.when(other, F.struct(*values)))
    verdict = _verdict()
    detail = F.create_map(
        *[F.lit(x) for pair in c.REJECTION_DETAIL.items() for x in pair]
    )
    return (
        staged.withColumn("error_code", computed_once(F.when(F.col("plain").isNull(), F.get(verdict, 0))))
        .select(
            *raw.columns,
            F.struct(
                F.when(F.col("plain").isNotNull(), F.col("plain"))
                .when(F.col("error_code").isNull(), _event())
                .alias("event"),
                F.col("error_code"),
                detail[F.col("error_code")].alias("error_detail"),
            ).alias("validation"),
        )
    )


def _apart(value: Column) -> Column:
    """The same value, kept out of the fused stage method: one of more than 8,000 bytes is never compiled."""
    return F.get(F.filter(F.array(value), lambda _: F.lit(True)), 0)


def _verdict() -> Column:
    kind = _string("event_type")
    type_ok = F.coalesce(kind.isin(*c.EVENT_TYPES), F.lit(False))
    unknown = F.size(
        F.array_except("names", F.array(*[F.lit(n) for n in c.PAYLOAD_FIELDS]))
    ) > 0
    version_bad = _kind("schema_version").isNotNull() & ~F.coalesce(
        (_kind("schema_version") == "BIGINT")
        & (_field("schema_version").cast("string") == str(c.SCHEMA_VERSION)),
        F.lit(False),
    )
    id_bad = ~F.coalesce(_string("event_id").rlike(_UUID), F.lit(False))
    ordered = [
        (F.col("raw_payload").isNull(), "other_validation"),
        (~F.col("is_json"), "malformed_json"),
        (~F.col("is_object"), "other_validation"),
        (~_given("event_id"), "missing_event_id"),
        (~type_ok, "invalid_event_type"),
        *[(failing, "invalid_business_fields") for failing in _field_errors()],
        (unknown, "schema_validation"),
        (version_bad, "schema_validation"),
        (id_bad, "schema_validation"),
        *[(failing, "invalid_business_fields") for failing in _rule_errors()],
    ]
    # The filter keeps this long list out of the fused stage method, which would otherwise
    # outgrow what the JIT compiles.
    codes = F.array(*[F.when(failing, F.lit(code)) for failing, code in ordered])
    return F.filter(codes, lambda code: code.isNotNull())


def _field_errors() -> list[Column]:
    """Type and range errors of single business fields."""
    failing = [
        _bad_optional(name, _string(name).rlike(_IDENTIFIER))
        for name in ("customer_id", "order_id", "product_id")
    ]
    failing += [
        _bad_optional("payment_provider", _string("payment_provider").isin(*c.PAYMENT_PROVIDERS)),
        _bad_optional("shipment_provider", _string("shipment_provider").isin(*c.SHIPMENT_PROVIDERS)),
        _bad_optional(
            "amount",
            F.col("values.amount").rlike(_AMOUNT)
            & (F.col("values.amount").try_cast("decimal(30,8)") >= F.lit(0)),
        ),
        # Defaulted fields may be absent, but an explicit null is an error.
        _kind("currency").isNotNull() & ~F.coalesce(_string("currency") == c.CURRENCY, F.lit(False)),
        _kind("metadata").isNotNull() & ~_kind("metadata").startswith("OBJECT"),
        ~F.coalesce(_string("region").isin(*c.REGIONS), F.lit(False)),
        _string("status").isNull(),
        F.col("values.ts").isNull(),
    ]
    return failing


def _rule_errors() -> list[Column]:
    """Rules across fields; only judged when every single field is sound."""
    kind = _string("event_type")
    status_of = F.create_map(*[F.lit(x) for pair in c.STATUS_OF_TYPE.items() for x in pair])
    earliest, latest = _time_bounds()

    def lacking(applies: Column, name: str) -> Column:
        return applies & ~_given(name)

    stock = kind == "inventory_updated"
    ordered = ~kind.isin("inventory_updated", "customer_login")
    return [
        F.col("values.ts") < earliest,
        F.col("values.ts") > latest,
        _string("status") != status_of[kind],
        lacking(~stock, "customer_id"),
        lacking(ordered, "order_id"),
        lacking(ordered | stock, "product_id"),
        stock & ~F.coalesce(F.col("values.quantity") >= 0, F.lit(False)),
        lacking(kind.isin(*c.MONEY_TYPES), "amount"),
        lacking(kind.isin(*c.PAYMENT_TYPES), "payment_provider"),
        lacking(kind.isin(*c.SHIPMENT_TYPES), "shipment_provider"),
    ]


def _event() -> Column:
    typed = {
        "schema_version": F.lit(c.SCHEMA_VERSION),
        "event_id": _canonical_uuid(_string("event_id")),
        "event_type": _string("event_type"),
        "event_ts": F.col("values.ts"),
        "amount": F.col("values.amount").try_cast("decimal(14,2)"),
        "currency": F.lit(c.CURRENCY),
        "metadata": F.coalesce(F.to_json(_field("metadata")), F.lit("{}")),
    }
    return F.struct(
        *[typed.get(name, _string(name)).alias(name) for name in c.BUSINESS_COLUMNS]
    )
