"""Helpers shared by the corpus operators: the shared folder, written tables and the fold of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..tables import forget, fresh_path, shared_dir, written

__all__ = ["fold", "forget", "fresh_path", "shared_dir", "table", "text_bytes", "without", "written"]


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: the fold that decides what a model may learn from. Null ids have no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; the package goes to the workers with the first one read."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of text in all rows, by one aggregate over one column."""
    got = df.agg(F.sum(F.octet_length(F.col(text)).cast("long")).alias("n")).first()
    return int(got["n"] or 0)


#: Ids that are broadcast at most (16 bytes each in a hash table's terms: some tens of MB); more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not in ``ids`` (a column of the same name). Rows with a null id stay."""
    gone = written(ids.select(id_col).filter(F.col(id_col).isNotNull()).distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, id_col, "left_anti").select(docs.columns)
