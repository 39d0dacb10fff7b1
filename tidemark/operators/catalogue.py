"""Read models over the product catalogue, carts, orders and change rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def search(products: DataFrame, query: str, tags: bool = True, brand: bool = False, description: str | None = None) -> DataFrame:
    """Case-insensitive containment in name, in the named column of descriptions, and in tags and brand if wanted."""
    q = query.lower()
    hit = F.lower("name").contains(q)
    if description:
        hit = hit | F.coalesce(F.lower(description).contains(q), F.lit(False))
    if tags:
        hit = hit | F.exists("tags", lambda t: F.lower(t).contains(q))
    if brand:
        hit = hit | F.lower("brand").contains(q)
    return products.filter(hit)


def in_category(products: DataFrame, category: str) -> DataFrame:
    return products.filter(F.lower("category") == category.lower())


SORTS = {"price_asc": [F.asc, "price"], "price_desc": [F.desc, "price"], "rating": [F.desc, "rating"], "newest": [F.desc, "product_id"], "popularity": [F.desc, "review_count"]}


def listing(products: DataFrame, sort: str, k: int, category: str | None = None, query: str | None = None, price: tuple[float, float] | None = None) -> DataFrame:
    """The first k of a filtered and sorted list; the id breaks ties."""
    rows = in_category(products, category) if category else products
    rows = search(rows, query, brand=True) if query else rows
    rows = rows.filter(F.col("price").between(*price)) if price else rows
    way, column = SORTS[sort]
    return rows.orderBy(way(column), "product_id").limit(k)


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def cart_totals(items: DataFrame, cart: str) -> DataFrame:
    return items.groupBy(cart).agg(F.sum("quantity").alias("items"), F.round(F.sum(F.col("price") * F.col("quantity")), 2).alias("total"))


def order_total(subtotal: Column, tax: float = 0.08, shipping: float = 5.99) -> Column:
    return subtotal + subtotal * tax + shipping


def apply_changes(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The table that change rows (op c/u/d/r) leave: the last row of each key that was not deleted."""
    return latest(changes, key, order).filter("op <> 'd'").drop("op")


def at_version(rows: DataFrame, version: int, column: str = "version") -> DataFrame:
    """Rows that were there at a version; stands in for time travel."""
    return rows.filter(F.col(column) <= version)


def deduplicated(rows: DataFrame, key: str, order: list) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")
