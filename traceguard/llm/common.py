"""Reading tables and cutting lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(names: Iterable[str], *results: str) -> list[str]:
    """Those of ``names`` that no result is named like; Spark tells names apart without case."""
    taken = {x.lower() for x in results}
    return [x for x in names if x.lower() not in taken]


def carried(docs: DataFrame, keep: Iterable[str], *results: str) -> tuple[list[str], DataFrame, StructField]:
    """What goes through a Python function beside the text: names, ``docs`` with these columns in ``own``, its type.

    ``own`` is a struct, so that no name of a column can clash with another on the way.
    """
    kept = others(keep, *results)
    own = F.struct(*map(column, kept)) if kept else F.struct(F.lit(None).cast("string").alias("none"))
    packed = docs.select(*map(column, others(docs.columns, "own")), own.alias("own"))
    return kept, packed, StructField("own", packed.select("own").schema["own"].dataType)


def released(df: DataFrame, kept: Iterable[str], *results: str | Column) -> DataFrame:
    """The columns held in ``own``, and results."""
    return df.select(*(F.col("own")[c].alias(c) for c in kept), *results)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Where the setting is absent, a local session gets a temporary folder, as in tests; a cluster raises, because
    its executors could not see a folder of the driver's machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="traceguard-"))
    return spark.sparkContext.getCheckpointDir()


#: Tables written since the outermost ``scratch`` began.
_written: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and nothing is computed twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Of the tables written inside only the last stays: it must hold all that is needed afterwards."""
    start = len(_written)
    try:
        yield
    finally:
        for path in _written[start:-1]:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        del _written[start:-1]


def fold_rows(column: str, modulus: int) -> F.Column:
    """crc32 of an integer id as text, modulo ``modulus``: which rows are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def held_out(column: str, modulus: int, rest: int) -> F.Column:
    """False, not null, for a null id."""
    return F.coalesce(fold_rows(column, modulus) == rest, F.lit(False))
