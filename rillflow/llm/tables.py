"""Reading the given tables and cutting lineage through written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import drop, new_path, saved, saved_few, saved_parts, shared_dir
from ..shipping import ship

__all__ = ["drop", "join_hot", "map_arrow", "new_path", "read", "saved", "saved_few", "saved_parts", "shared_dir", "small", "unused"]

#: Rows of (at most a few hundred bytes) up to which a side is broadcast, once counted.
BROADCAST_ROWS = 100_000
#: Rows of a key from which a join deals them to several tasks, and hot keys that there can be at most.
HOT_ROWS, HOT_KEYS = 1_000, 1_000_000
#: Rows of a batch that goes to a Python worker.
ARROW_ROWS = 1_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow, with this package on the executors and batches of at most ARROW_ROWS rows, as texts can be long."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, ARROW_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count proves that it has at most that many rows; as it is beyond."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores behind it until no column is called so (in either case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_hot(rows: DataFrame, sized: DataFrame, on: list[str], by: list[str], count: str) -> DataFrame:
    """rows joined to sized, a written table with one row a key and the number of the key's rows in count.

    The rows of a hot key are dealt to several tasks by a hash of the columns by, and its row of sized goes to each of
    them. Hot is what holds more than a HOT_KEYS-th of all rows (and more than HOT_ROWS), so there are at most
    HOT_KEYS hot keys, which are broadcast.
    """
    total = sized.agg(F.sum(count).alias("n")).first().n or 0
    most = max(HOT_ROWS, total // HOT_KEYS)
    names = [*rows.columns, *sized.columns]
    salt, salts = unused("salt", names), unused("salts", names)
    tasks = F.greatest(F.ceil(F.col(count) / F.lit(most)), F.lit(1)).cast("int")
    hot = sized.where(F.col(count) > most).select(*[F.col(c).alias(unused(f"hot_{c}", names)) for c in on], tasks.alias(salts))
    if not hot.limit(1).count():
        return rows.join(sized, on)
    same = [rows[c] == hot[unused(f"hot_{c}", names)] for c in on]
    dealt = rows.join(F.broadcast(hot), same, "left").select(*rows.columns, F.coalesce(F.pmod(F.xxhash64(*by), F.col(salts)), F.lit(0)).cast("int").alias(salt))
    each = sized.select("*", F.explode(F.sequence(F.lit(0), tasks - 1)).alias(salt))
    return dealt.join(each, [*on, salt]).drop(salt)
