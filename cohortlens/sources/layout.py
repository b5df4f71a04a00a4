"""Facts laid out by person (JON-01, WIN-01): written once, read many times without moving them.

Each fact table becomes a bucketed table: a person's rows lie in one bucket,
sorted by person. Joins, windows and aggregates on the person then read bucket
by bucket without an exchange of the facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a bucket to aim at.
BUCKET_BYTES = 256 * 1024 * 1024


def bucket_count(total_bytes: int, least: int = 8) -> int:
    """A power of two, so that tables of different sizes still meet bucket by bucket."""
    n = least
    while n * BUCKET_BYTES < total_bytes:
        n *= 2
    return n


def lay_out(spark: SparkSession, tables: dict[str, DataFrame], names: list[str], buckets: int, prefix: str,
            key: str = "person_id") -> dict[str, DataFrame]:
    """``tables`` with the tables in ``names`` replaced by bucketed copies, saved as ``<prefix>_<name>``.

    Rows without a key share a bucket; they belong to nobody's history. All
    tables should have one number of buckets (``bucket_count`` of the largest).
    """
    out = dict(tables)
    for name in names:
        saved = f"{prefix}_{name}"
        # Dealt by the bucket's own hash first, so that a bucket is one file and one sorted run.
        (tables[name].repartition(buckets, key).write.mode("overwrite").format("parquet")
         .bucketBy(buckets, key).sortBy(key).saveAsTable(saved))
        out[name] = spark.table(saved)
    return out


def laid_out(spark: SparkSession, tables: dict[str, DataFrame], names: list[str], prefix: str) -> dict[str, DataFrame]:
    """``tables`` with the copies that ``lay_out`` has saved."""
    return dict(tables) | {name: spark.table(f"{prefix}_{name}") for name in names}
