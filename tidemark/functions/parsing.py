"""Parsers of wire text into typed columns; what cannot be parsed drops or falls back as documented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CDC, ORDER_ITEM, PATTERN, PRODUCT, SHOPPING_EVENT, VEHICLE


def products(lines: DataFrame, value: str = "value", validate: bool = True) -> DataFrame:
    """Product rows from JSON texts, each one object or an array; blank, other and broken texts drop.

    validate: also drop rows with a blank id or name.
    """
    text = F.trim(F.col(value))
    many = F.from_json(text, f"array<struct<{PRODUCT}>>", {"mode": "PERMISSIVE"})
    one = F.array(F.from_json(text, PRODUCT))
    # from_json gives a row of nulls for broken objects, so the text must be valid JSON as a whole.
    sound = F.try_parse_json(text).isNotNull()
    rows = lines.filter(sound).select(F.explode(F.when(text.startswith("["), many).when(text.startswith("{"), one)).alias("p")).select("p.*")
    return rows.filter((F.trim("productId") != "") & (F.trim("name") != "")) if validate else rows


def order_items(lines: DataFrame, value: str = "value") -> DataFrame:
    """Order items with both ids and a positive quantity; a missing number is 0."""
    rows = lines.select(F.from_json(value, ORDER_ITEM).alias("o")).select("o.orderId", "o.productId", F.coalesce("o.quantity", F.lit(0)).alias("quantity"), F.coalesce("o.timestamp", F.lit(0)).alias("timestamp"))
    return rows.filter((F.coalesce("orderId", F.lit("")) != "") & (F.coalesce("productId", F.lit("")) != "") & (F.col("quantity") > 0))


def shopping_events(lines: DataFrame, value: str = "value", mode: str = "refactored") -> DataFrame:
    """Shopping events, taken out of an {eventType, payload} envelope if both keys are there.

    original: an envelope without payload drops; refactored: it is read as an event itself.
    """
    text = F.col(value)
    wrapped = text.contains('"eventType"') & text.contains('"payload"')
    inner = F.get_json_object(text, "$.payload")
    body = F.when(wrapped, inner if mode == "original" else F.coalesce(inner, text)).otherwise(text)
    return lines.select(F.from_json(body, SHOPPING_EVENT).alias("e")).select("e.*").filter("eventType is not null AND sessionId is not null")


def patterns(lines: DataFrame, value: str = "value") -> DataFrame:
    """Patterns from JSON, or from `a,b->c:confidence` texts; defaults fill zero measures."""
    text = F.trim(F.col(value))
    j = F.from_json(text, PATTERN)
    conf = F.regexp_extract(text, r":([0-9.]+)\s*$", 1).try_cast("double")
    left = F.transform(F.split(F.substring_index(text, "->", 1), ","), lambda x: F.trim(x))
    right = F.trim(F.regexp_extract(text, r"->(.*):[0-9.]+\s*$", 1))
    is_json = text.startswith("{")
    c = F.coalesce(j["confidence"], F.lit(0.0))
    c = F.when(c == 0, 0.5).otherwise(c)
    measured = F.struct(
        F.when(is_json, j["antecedents"]).otherwise(left).alias("antecedents"),
        F.when(is_json, j["consequent"]).otherwise(right).alias("consequent"),
        F.when(is_json, F.when(F.coalesce(j["support"], F.lit(0.0)) == 0, 0.01).otherwise(j["support"])).otherwise(conf * 0.3).alias("support"),
        F.when(is_json, c).otherwise(conf).alias("confidence"),
        F.when(is_json, F.when(F.coalesce(j["lift"], F.lit(0.0)) == 0, c / 0.2).otherwise(j["lift"])).otherwise(conf / 0.2).alias("lift"),
    )
    return lines.select(measured.alias("p")).select("p.*").filter("size(antecedents) > 0 AND consequent <> '' AND confidence is not null")


def cdc(lines: DataFrame, value: str = "value") -> DataFrame:
    """Change rows: op, table, before, after (JSON texts)."""
    return lines.select(F.from_json(value, CDC).alias("c")).select("c.op", F.col("c.source.table").alias("table"), "c.before", "c.after").filter("op is not null")


def records(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Rows of a schema from JSON objects (chat messages, basket updates, recommendations); what is none drops."""
    text = F.trim(F.col(value))
    return lines.filter(F.try_parse_json(text).isNotNull() & text.startswith("{")).select(F.from_json(text, schema).alias("r")).select("r.*")


def current_products(lines: DataFrame, value: str = "value") -> DataFrame:
    """The product inside each inventory event's currentProduct; events without one, and broken texts, drop."""
    return records(lines, f"currentProduct struct<{PRODUCT}>", value).filter("currentProduct is not null").select("currentProduct.*")


def vehicles(lines: DataFrame, value: str = "value") -> DataFrame:
    """Vehicle positions; unknown fields are ignored and `long` becomes `lng`."""
    return lines.select(F.from_json(value, VEHICLE).alias("v")).filter("v.VP is not null").select("v.VP.*").withColumnRenamed("long", "lng")


def envelope(kind: Column | str, payload: Column, timestamp: Column, to_user: Column | None = None) -> Column:
    """{id, eventType, toUserId, payload, timestamp} as JSON; the id is a digest of the rest, so runs repeat."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    to_user = F.lit(None).cast("string") if to_user is None else to_user
    body = F.to_json(payload)
    return F.to_json(F.struct(F.sha2(F.concat_ws("|", kind, to_user, body, timestamp.cast("string")), 256).alias("id"), kind.alias("eventType"), to_user.alias("toUserId"), payload.alias("payload"), timestamp.alias("timestamp")))


#: Fixed values of the message: field, first bit, end, signed.
AIS_FIELDS = [("type", 0, 6, False), ("repeat", 6, 8, False), ("mmsi", 8, 38, False), ("nav_status", 38, 42, False), ("rot", 42, 50, True), ("sog", 50, 60, False), ("accuracy", 60, 61, False), ("lon", 61, 89, True), ("lat", 89, 116, True), ("cog", 116, 128, False), ("heading", 128, 137, False), ("second", 137, 143, False)]


def ais(payload: Column) -> Column:
    """Fields of an armoured AIS payload; null if it has under 168 bits."""
    code = lambda c: F.ascii(c) - 48 - F.when(F.ascii(c) - 48 > 40, 8).otherwise(0)
    text = F.array_join(F.transform(F.split(payload, "(?!^)"), lambda c: F.lpad(F.bin(code(c)), 6, "0")), "")

    def fields(bits: Column) -> Column:
        def field(a: int, b: int, signed: bool) -> Column:
            value = F.conv(F.substring(bits, a + 1, b - a), 2, 10).cast("long")
            return F.when(F.substring(bits, a + 1, 1) == "1", value - (1 << (b - a))).otherwise(value) if signed else value

        out = [(field(a, b, s) / 600000.0 if n in ("lon", "lat") else field(a, b, s)).alias(n) for n, a, b, s in AIS_FIELDS]
        return F.when(F.length(bits) >= 168, F.struct(*out))

    # The variable of a lambda is computed once, a column would be once a field.
    return F.transform(F.array(text), fields)[0]


def geo(lines: DataFrame, value: str = "value") -> DataFrame:
    """Coordinates of a feed of JSON lines that may end in a comma."""
    text = F.rtrim(F.trim(F.col(value)), F.lit(","))
    xy = F.from_json(F.get_json_object(text, "$.geometry.coordinates"), "array<double>")
    return lines.select(xy[0].alias("lng"), xy[1].alias("lat")).filter("lng is not null AND lat is not null")
