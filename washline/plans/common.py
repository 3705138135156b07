"""Small helpers shared by the plans and the query catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def round_doubles(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Round every DOUBLE column (stable value hashes across engines)."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(F.col(c), decimals).alias(c) if kinds[c] in ("double", "float") else F.col(c)
                       for c in df.columns])


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage between the stages of a plan: one parquet write to the shared folder, read back.

    Later stages neither re-plan nor recompute the upstream joins, and prune columns.
    """
    return write_table(df, "stage")


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as parquet under the shared checkpoint folder and scan it back.

    Unlike ``checkpoint()`` the result is columnar: later queries get column
    pruning and filter pushdown on it, as on any stored table.
    """
    import uuid

    from washline.session import shared_dir
    path = shared_dir(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
