"""Shared helpers: table access, the shared working folder, stable hashes.

Nothing here reads ``open()`` paths of inputs: tables come through Spark's readers, and the files
that operators write go to the folder that ``spark.checkpoint.dir`` names, through pyarrow's
filesystems.
"""

from __future__ import annotations

import os
import posixpath
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; workers learn where this package lives."""
    make_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def make_importable(spark: SparkSession) -> None:
    """Python workers find this package even if only the driver's sys.path has it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a local one where that is unset and Spark is local (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='hushframe-')}"
        spark.sparkContext.setCheckpointDir(base)
    return posixpath.join(base, f"hushframe-{name}-{uuid.uuid4().hex[:12]}")


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table written to the shared folder: cuts lineage, survives lost executors."""
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def in_one(docs: DataFrame, **named: Column) -> DataFrame:
    """All columns of ``docs`` as one, ``row``, beside columns that an operator works with: so none can clash, whatever its name or type."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in named.items()])


def as_they_were(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` out of ``row``."""
    return rows.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])


def tie_break(row: str = "row") -> Column:
    """Tells rows apart whose other keys are equal, whatever types they hold."""
    return F.xxhash64(F.to_json(row))


def file_system(uri: str):
    """pyarrow's filesystem and the path in it for a folder or file URI."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def put_file(uri: str, write) -> int:
    """Write a file under a name of its own, then move it into place: a repeated task replaces it whole."""
    files, path = file_system(uri)
    files.create_dir(posixpath.dirname(path), recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(temporary, compression=None) as out:
        write(out)
    size = files.get_file_info(temporary).size
    files.move(temporary, path)
    return size


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_of_id(c: Column) -> Column:
    """crc32 of the id's decimal text; null ids count as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def uniform(*cols: Column, seed: int) -> Column:
    """A repeatable number strictly between 0 and 1 for the values of some columns."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)

