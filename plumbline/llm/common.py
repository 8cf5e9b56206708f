"""What the corpus operators share: tables, the shared folder, shipping of code."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python
    stages can import it there wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="plumbline-code-")
    atexit.register(shutil.rmtree, folder, True)
    out = f"{folder}/plumbline_code.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(out)
    _shipped[app] = out


def shared_dir(spark: SparkSession) -> str:
    """A new folder that all executors share: below ``spark.checkpoint.dir`` as
    the session has it. Only where that is unset and Spark runs in one process
    (tests) is a local folder made and set; on a cluster that is an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="plumbline-shared-")
        atexit.register(shutil.rmtree, base, True)
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/plumbline-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, folder: str) -> DataFrame:
    """``df`` written as parquet to ``folder`` and read again: what follows no
    longer depends on the executors that made it."""
    df.write.mode("overwrite").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def local_path(folder: str) -> str:
    """The path of a shared folder as the executors' own file system has it."""
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    if "://" in folder:
        raise ValueError(f"this operator writes its own files and needs a mounted shared folder, not {folder}")
    return folder


def text_bytes(col: str | Column = "text") -> Column:
    """UTF-8 bytes of a text; of a null text none."""
    return F.coalesce(F.encode(F.col(col) if isinstance(col, str) else col, "UTF-8"), F.lit(b""))


def width(spark: SparkSession) -> int:
    """Partitions for stages whose rows are small but whose work isn't: as many
    as the session shuffles to, which adaptive execution won't merge."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def aside(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "text", "lang")) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but ``keep`` under names that nothing else has,
    and a function that selects the columns of ``docs`` as they were."""
    names = {c: c if c in keep else f"_column_{i}" for i, c in enumerate(docs.columns)}
    hidden = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return hidden, lambda df: df.select(*[F.col(n).alias(c) for c, n in names.items()])


def marked(docs: DataFrame, *cols: str | Column) -> DataFrame:
    """``doc_id`` as a long that is never null (0 for null), ``no_id``, and ``cols``:
    pandas holds longs beside nulls as floats, which would change large ids."""
    key = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(key, F.lit(0)).alias("doc_id"), key.isNull().alias("no_id"), *cols)


def unmarked(df: DataFrame) -> DataFrame:
    """What ``marked`` made, with null ids again."""
    return df.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
