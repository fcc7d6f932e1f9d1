"""Connected components of an edge table: least labels along edges and pointer jumping.

Labels spread to neighbours by an aggregate (combined before the shuffle, so a
hub costs its task no more than others) and then jump to their label's label,
which halves what is left of a chain. Every round's labels are written to the
shared folder and read again; those of earlier rounds are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): the least id that can be reached. Null ends are ignored."""
    e = edges.filter("a is not null and b is not null and a <> b").select("a", "b")
    e = written(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    moved = written(e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("x")).select("id", F.least("id", "x").alias("component")), "labels")
    while True:
        labels = moved.select("id", "component")
        spread = e.join(labels, e["a"] == labels["id"]).groupBy(F.col("b").alias("id")).agg(F.min("component").alias("near"))
        near = written(labels.join(spread, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component")), "near")
        up = near.select(F.col("id").alias("root"), F.col("component").alias("above"))
        jumped = near.join(up, near["component"] == up["root"], "left").select("id", "was", F.coalesce("above", "component").alias("component"))
        before, moved = moved, written(jumped, "labels")
        forget(before, near)
        if not moved.filter("was <> component").head(1):
            forget(e)
            return moved.select("id", "component")
