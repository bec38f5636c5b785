"""Ordered selections (uri, position) and ordered assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def move(selection: DataFrame, by: list[str], position: int, up: bool) -> DataFrame:
    """Swaps a position with the one before (up) or after it; nothing happens at the ends."""
    other = position - 1 if up else position + 1
    last = F.count(F.lit(1)).over(Window.partitionBy(*by)) - 1
    p, inside = F.col("position"), (F.lit(other) >= 0) & (F.greatest(F.lit(position), F.lit(other)) <= last)
    return selection.withColumn("position", F.when(inside & (p == position), other).when(inside & (p == other), position).otherwise(p).cast("int"))


def remove_at(selection: DataFrame, position: int) -> DataFrame:
    p = F.col("position")
    return selection.where(p != position).withColumn("position", F.when(p > position, p - 1).otherwise(p).cast("int"))


def append(selection: DataFrame, more: DataFrame) -> DataFrame:
    n = selection.agg(F.coalesce(F.max("position") + 1, F.lit(0)).alias("n"))
    return selection.unionByName(more.crossJoin(F.broadcast(n)).withColumn("position", (F.col("position") + F.col("n")).cast("int")).drop("n"))  # one row


def joined(order: Column, value: Column, between: str = "") -> Column:
    """Aggregate: values in order, as one string."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"]), between)


def flattened_cell(paragraphs: Column) -> Column:
    """A cell's paragraphs as one text: a new line only where text stands before."""
    return F.aggregate(paragraphs, F.lit(""), lambda acc, p: F.concat(acc, F.when(acc != "", F.lit("\n")).otherwise(""), p))


def distinct_in_order(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """by, and values: each distinct value once, in the order of its first occurrence. Values merge before they are gathered."""
    first = rows.groupBy(*by, value).agg(F.min(order).alias("__o"))
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("__o").alias("o"), F.col(value).alias("v")))), lambda s: s["v"]).alias("values"))


def first_row(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group."""
    first = rows.groupBy(*by).agg(F.min(F.struct(*order, *(c for c in rows.columns if c not in {*by, *order}))).alias("r"))
    return first.select(*by, "r.*")


def span_table(runs: DataFrame, by: str, order: str) -> DataFrame:
    """runs with start and stop of their text in the whole of it, in UTF-16 units; empty runs drop out."""
    n = T.utf16_length(F.col("text")).cast("long")
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("start", F.coalesce(F.sum(n).over(before), F.lit(0)))
    return placed.withColumn("stop", F.col("start") + n).where("stop > start")
