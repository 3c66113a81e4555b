"""Storage layouts for large tables: range-clustered, with key filters, and co-located.

*Range-clustered* (:func:`write_clustered`).
Range partitioning on the clustering columns (then a sort inside each
partition) gives every output file a narrow, non-overlapping range of those
columns.  Parquet keeps min/max statistics per row group, so the literal
bounds the plans push to the scan (``order_date >= ...``) then skip whole row
groups and files instead of filtering rows.  Range partitioning samples the
data, so a hot value is spread over as many files as its share needs, unlike
``repartition(col)``, which puts every row of a value in one task.
``key_filters`` adds Parquet bloom filters for columns by which single rows are
looked up, and :func:`lookup_keys` reads by them: row groups that can't hold
any of the keys are not read.

*Co-located* (:func:`write_colocated`).  Orders, items and payments are
bucketed and sorted by ``order_id``, so that joins on it need no exchange (each
bucket is sorted where it is read).  Buckets are files of a table in the session's catalog; a new session
names them again with :func:`open_colocated`.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

# Clustering used for the shop tables at scale: orders by their clock column,
# the detail tables by the key they are joined on.
CLUSTERING = {
    "orders": ["order_date", "order_id"],
    "order_items": ["order_id"],
    "transactions": ["order_id"],
    "inventory": ["product_id"],
    "customers": ["customer_id"],
    "products": ["product_id"],
}


def write_clustered(df: DataFrame, path: str, cluster_by: list[str], num_files: int,
                    mode: str = "errorifexists", key_filters: Iterable[str] = (), row_group_bytes: int | None = None) -> None:
    """Write ``df`` as ``num_files`` parquet files, range-clustered on ``cluster_by``, with bloom filters on ``key_filters``."""
    w = df.repartitionByRange(num_files, *cluster_by).sortWithinPartitions(*cluster_by).write.mode(mode)
    for c in key_filters:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    if row_group_bytes:
        w = w.option("parquet.block.size", str(row_group_bytes))
    w.parquet(path)


#: Keys that go to the scan as one list (the scan tests every row group's statistics and bloom filter with each).
PUSHED_KEYS = 200


def lookup_keys(spark: SparkSession, path: str, schema, key: str, keys: DataFrame) -> DataFrame:
    """Rows of a clustered table whose ``key`` is among ``keys`` (one column of that name).

    Up to ``PUSHED_KEYS`` keys are pushed to the scan as equalities, which row
    groups answer from their statistics and bloom filters (a list of more than
    a few values would be pushed as a range only).  With more keys the table
    is joined with them, as reading single row groups no longer pays; the
    rows are the same.
    """
    rows = spark.read.schema(schema).parquet(path)
    wanted = materialize(keys.select(F.col(key)).where(F.col(key).isNotNull()).distinct(), "lookup-keys")
    few = [r[0] for r in wanted.limit(PUSHED_KEYS + 1).collect()]
    if len(few) > PUSHED_KEYS:
        return rows.join(wanted, key, "left_semi")
    if not few:
        return rows.where("false")
    return rows.where(_any_of(key, sorted(few)))


def _any_of(key: str, values: list):
    """The equalities as a balanced OR: a list is pushed as its range beyond ten values, a chain would nest too deep."""
    if len(values) == 1:
        return F.col(key) == F.lit(values[0])
    half = len(values) // 2
    return _any_of(key, values[:half]) | _any_of(key, values[half:])


# Co-located tables by their join key.
COLOCATED_BY = "order_id"


def write_colocated(tables: dict[str, DataFrame], root: str, database: str, buckets: int, by: str = COLOCATED_BY) -> None:
    """Store the tables bucketed and sorted by ``by``, one file a bucket, as ``<database>.<name>`` under ``root``."""
    for name, df in tables.items():
        spark = df.sparkSession
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        (df.repartition(buckets, by).write.mode("overwrite").format("parquet").bucketBy(buckets, by).sortBy(by)
         .option("path", f"{root.rstrip('/')}/{name}").saveAsTable(f"`{database}`.`{name}`"))


def open_colocated(spark: SparkSession, schemas: dict, root: str, database: str, buckets: int, by: str = COLOCATED_BY) -> dict[str, DataFrame]:
    """The stored tables, named in this session's catalog if they aren't yet."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    out = {}
    for name, schema in schemas.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet "
                  f"CLUSTERED BY (`{by}`) SORTED BY (`{by}`) INTO {buckets} BUCKETS LOCATION '{root.rstrip('/')}/{name}'")
        out[name] = spark.table(f"`{database}`.`{name}`")
    return out
