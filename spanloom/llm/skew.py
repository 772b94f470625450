"""Joins of rows to one row for each key, when a few keys may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than 1 / HOT_SHARE of the rows is joined by broadcast: at most HOT_SHARE such keys can exist.
HOT_SHARE = 1000


def join_unique(rows: DataFrame, by_key: DataFrame, keys: list[str], size_column: str, total: int) -> DataFrame:
    """Inner join of rows to by_key, which has one row for each key and in size_column how many of the total rows hold it."""
    hot = F.col(size_column) > total // HOT_SHARE + 1
    few = F.broadcast(by_key.filter(hot))
    cold = rows.join(F.broadcast(by_key.filter(hot).select(*keys)), keys, "left_anti").join(by_key.filter(~hot), keys)
    return rows.join(few, keys).unionByName(cold)
