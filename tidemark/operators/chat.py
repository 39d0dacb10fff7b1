"""Chat and assistant: enrichment, localisation, intents, context and prompts, and who may see a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ordered intent rules; the first that has a keyword in the lower-cased text holds.
INTENTS = [
    ("RECOMMENDATION", ["recommend", "suggest"]),
    ("CART_INQUIRY", ["cart", "basket"]),
    ("PRICE_INQUIRY", ["price", "cost"]),
    ("PRODUCT_SEARCH", ["find", "search", "looking for"]),
    ("HELP", ["help", "support"]),
]


def intent(text: Column) -> Column:
    low, out = F.lower(text), F.lit("GENERAL")
    for name, words in reversed(INTENTS):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def enrich(raw: DataFrame, languages: str = "languages") -> DataFrame:
    """Raw messages with a repeatable id and a map of requested languages to no translation yet."""
    ident = F.sha2(F.concat_ws("|", "userId", "toUserId", "type", "message", F.col("timestamp").cast("string")), 256)
    return raw.withColumn("id", ident).withColumn("translations", F.map_from_arrays(F.array_distinct(F.coalesce(languages, F.array().cast("array<string>"))), F.transform(F.array_distinct(F.coalesce(languages, F.array().cast("array<string>"))), lambda _: F.lit(None).cast("string"))))


def localised(rows: DataFrame, language: str) -> DataFrame:
    """text in a language, and whether it is a translation; DEFAULT is the original."""
    got = F.try_element_at("translations", F.lit(language)) if language != "DEFAULT" else F.lit(None).cast("string")
    return rows.withColumn("text", F.coalesce(got, "message")).withColumn("translated", got.isNotNull())


def languages(rows: DataFrame, user: str = "user_id", language: str = "language", order: tuple = ("us",)) -> DataFrame:
    """Each user's language, the last one told."""
    return rows.filter(F.col(language).isNotNull()).groupBy(user).agg(F.max_by(language, F.struct(*order)).alias(language))


def translated(rows: DataFrame, client, kind: str = "CHAT_MESSAGE", workers: int = 100, timeout: float = 60.0) -> DataFrame:
    """rows with translations filled by client(text, languages) -> {language: text}; other kinds, and failed or late calls, keep theirs.

    Up to `workers` calls are in flight, over Arrow batches; rows stay in order.
    """

    def ask(item):
        what, text, old = item
        if what != kind or not old or text is None:
            return {}
        try:
            return {k: v for k, v in client(text, list(old)).items() if k in old}
        except Exception:  # the original text stands in
            return {}

    def run(parts):
        from collections import deque

        held: deque = deque()

        def items():
            for pdf in parts:
                if len(pdf):
                    held.append(pdf)
                    yield from ((what, text, dict(old) if old is not None else {}) for what, text, old in zip(pdf["type"], pdf["message"], pdf["translations"], strict=True))

        made: list = []
        for (_, _, old), new in in_order(items(), ask, workers, timeout, {}):
            made.append(old | new)
            if len(made) == len(held[0]):
                yield held.popleft().assign(translations=made)
                made = []

    return rows.mapInPandas(run, rows.schema)


def visible_to(user: Column, kind: Column, sender: Column, receiver: Column) -> Column:
    """Anyone sees what is no chat message or has no receiver; else sender and receiver do."""
    return receiver.isNull() | (kind != "CHAT_MESSAGE") | (user == sender) | (user == receiver)


def history(messages: DataFrame, n: int = 10) -> DataFrame:
    """Each user message with the number and a digest of the whole texts of up to n user messages before it, oldest first."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    users = messages.filter("role = 'user'")
    return users.withColumn("__h", F.collect_list("text").over(w)).select("conv_id", "turn", F.size("__h").cast("long").alias("n_before"), F.sha2(F.array_join("__h", "|"), 256).alias("history_sha256"))


def last_n(messages: DataFrame, n: int = 10, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n rows of each key."""
    return messages.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("place") <= n)


def basket_context(messages: DataFrame, events: DataFrame) -> DataFrame:
    """Each message with its key's cart at its time: count, value and products of adds since the last order.

    messages: key, us, msg_id. events: key, us, event_id, event_type, product_id, value. At equal times events
    come first. A repeated add raises the quantity and keeps the first price; a removal takes the product out, so that a later
    add of it begins anew.
    """
    tag = messages.select("key", "us", F.lit(1).alias("src"), F.col("msg_id").alias("id"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("string").alias("product_id"), F.lit(None).cast("double").alias("value"))
    both = tag.unionByName(events.select("key", "us", F.lit(0).alias("src"), F.col("event_id").alias("id"), "event_type", "product_id", "value"))
    order, kind = ("us", "src", "id"), F.col("event_type")
    add, gone = kind == "ADD_TO_CART", kind == "REMOVE_FROM_CART"
    up_to_here = lambda *by: W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = both.withColumn("seg", F.coalesce(F.count_if(kind == "ORDER_PLACED").over(up_to_here("key")), F.lit(0)))
    # A product's stay in the cart ends with its removal; the removing row is the last of the stay.
    removed = F.count_if(gone).over(W.partitionBy("key", "seg", "product_id").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("__stay", F.coalesce(removed, F.lit(0)))
    stay = up_to_here("key", "seg", "product_id", "__stay")
    rows = rows.withColumn("__n", F.count_if(add).over(stay)).withColumn("__price", F.first(F.when(add, F.col("value")), ignorenulls=True).over(stay))
    some = gone & (F.col("__n") > 0)
    change = lambda one, all_: F.when(add, one).when(some, -all_).otherwise(0)
    so_far = up_to_here("key", "seg")
    out = (
        rows.withColumn("item_count", F.sum(change(F.lit(1), F.col("__n"))).over(so_far))
        .withColumn("total_value", F.sum(change(F.coalesce("__price", F.lit(0.0)), F.col("__n") * F.coalesce("__price", F.lit(0.0))).cast("double")).over(so_far))
        .withColumn("products", F.sum(change((F.col("__n") == 1).cast("int"), F.lit(1))).over(so_far))
    )
    return out.filter("src = 1").select("key", F.col("id").alias("msg_id"), "item_count", "total_value", "products")


def prompt(role: str, cart: Column, past: Column, recs: Column, query: Column) -> Column:
    """The assistant's prompt; parts that are null are left out."""
    part = lambda name, x: F.when(x.isNotNull(), F.concat(F.lit(f"{name}: "), x))
    return F.concat_ws("\n", F.lit(role), part("Cart", cart), part("History", past), part("Recommendations", recs), part("Customer", query))


#: What stands for an answer that failed, and for one that is late.
FAILED = "I'm sorry, I'm having trouble understanding. Could you please rephrase?"
LATE = "I'm taking a bit longer to respond. Please wait a moment."


def in_order(items, call, workers: int, timeout: float, late):
    """(item, call(item)) in the order of items, with up to `workers` calls under way; call must not raise.

    A window of calls slides over the items: a slow call holds back what is behind it in the output, while calls behind it go on up to
    the window's end. A call that takes longer than timeout seconds gives `late` and no longer counts.
    """
    import threading
    import time
    from collections import deque

    window: deque = deque()

    def begin(item):
        got, done = [], threading.Event()

        def work():
            got.append(call(item))
            done.set()

        threading.Thread(target=work, daemon=True).start()  # its own, so that hung calls hold up no later ones
        window.append((item, got, done, time.monotonic() + timeout))

    def end():
        item, got, done, until = window.popleft()
        return (item, got[0]) if done.wait(max(0.0, until - time.monotonic())) else (item, late)

    for item in items:
        if len(window) >= workers:
            yield end()
        begin(item)
    while window:
        yield end()


def answered(rows: DataFrame, client, column: str = "prompt", workers: int = 100, retries: int = 3, pause: float = 1.0, fallback: str = FAILED, timeout: float = 60.0, late: str = LATE) -> DataFrame:
    """rows with `answer` by client(text), in order, up to `workers` in flight; fallback after the retries, `late` after timeout seconds.

    The window of calls slides over Arrow batches. client is called on the executors and must be serialisable; tests pass a
    function without network.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("answer", T.StringType())])

    def ask(text: str) -> str:
        import time

        for i in range(retries + 1):
            try:
                return client(text)
            except Exception:
                if i < retries:
                    time.sleep(pause)
        return fallback

    def run(parts):
        from collections import deque

        held: deque = deque()  # batches whose answers are not complete

        def texts():
            for pdf in parts:
                if len(pdf):
                    held.append(pdf)
                    yield from pdf[column].tolist()

        answers: list = []
        for _, answer in in_order(texts(), ask, workers, timeout, late):
            answers.append(answer)
            if len(answers) == len(held[0]):
                yield held.popleft().assign(answer=answers)
                answers = []

    return rows.mapInPandas(run, schema)


def with_recommendations(rows: DataFrame, intent_: str = "intent", available: str = "available") -> DataFrame:
    """rows with `recommended_products`: what is available, if the customer asked for a recommendation."""
    return rows.withColumn("recommended_products", F.when(F.col(intent_) == "RECOMMENDATION", F.col(available)))
