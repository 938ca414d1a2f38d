"""How many partitions a table takes, by its rows.

Shuffles are merged into about as many partitions as the cluster has cores, so a task's rows grow with the table. A plan that
deals its tables by one key into a number of parts that follows their rows keeps a task as large as it is on a small one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a part.
PART_ROWS = 250_000


def parts(table: DataFrame) -> int:
    """Parts for the rows of ``table``, counted; for a file that is read from its footer."""
    return 1 + table.count() // PART_ROWS


def deal(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """``df`` by ``keys``, in ``n`` parts (None: as Spark sees fit)."""
    return df.repartition(*keys) if n is None else df.repartition(n, *keys)
