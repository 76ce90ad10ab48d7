"""Joins of rows with a table of their classes, where one class may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_CLASSES = 10_000  # classes that are broadcast, at most
LEAST = 10_000  # rows of a class up to which it is never a task's burden


def hot_join(rows: DataFrame, classes: DataFrame, on: list[str], many: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left, null-safe or not as Spark does) with classes, which are distinct by ``on`` and
    say in ``many`` how many of the rows they have. Classes with more than a HOT_CLASSES-th of all rows are no
    more than HOT_CLASSES; they are broadcast, so their rows stay where they are. The others are dealt by key."""
    total = rows.count()
    least = max(LEAST, total // HOT_CLASSES)
    if not classes.filter(F.col(many) > least).limit(1).count():
        return rows.join(classes, on, how)
    hot = classes.filter(F.col(many) > least)
    with_hot = rows.join(F.broadcast(hot), on)
    others = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(classes.filter(F.col(many) <= least), on, how)
    return with_hot.unionByName(others)
