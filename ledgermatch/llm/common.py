"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but ASCII white space: the words of several operators.
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


BATCH, DEFAULT_ROWS, ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "500"
_SHIPPED: set[str] = set()


def ship() -> None:
    """Send this package's code to the workers of the active session, once: their Python
    functions import it.  Spark serves the archive from the driver to every executor.  Also
    makes Arrow batches smaller, unless the session has its own setting."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="ledgermatch-code-"), "ledgermatch.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    # texts are long: smaller Arrow batches keep workers and buffers small
    if spark.conf.get(BATCH, DEFAULT_ROWS) == DEFAULT_ROWS:
        spark.conf.set(BATCH, ROWS_PER_BATCH)
    _SHIPPED.add(spark.sparkContext.applicationId)


def words(text) -> Column:
    """The words of a text as an array (no empty strings; null text: no words)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE_RE), lambda w: w != "")


def replace_columns(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` without columns that clash (case aside) with ``cols``, then ``cols``."""
    new = {c.lower() for c in cols}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in new]
    return df.select(*kept, *[v.alias(k) for k, v in cols.items()])


def key_of(col) -> Column:
    """A never-null text key of a nullable column (null sorts apart from every value)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), c.cast("string")))


def pieces(items: list, size, limit: int):
    """Consecutive (start, end) ranges of ``items`` whose summed ``size`` stays near ``limit``."""
    start = total = 0
    for i, x in enumerate(items):
        if i > start and total + size(x) > limit:
            yield start, i
            start, total = i, 0
        total += size(x)
    if items:
        yield start, len(items)


def utf8_lists(col: pa.Array) -> list[str]:
    """Python strings of an Arrow text column, null as empty text."""
    return [x or "" for x in col.to_pylist()]
