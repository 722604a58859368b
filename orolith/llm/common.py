"""Helpers that several corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _listed(chars: str) -> str:
    """The characters one by one: a class of single characters is one table lookup, each range in it one test more."""
    return "".join(f"\\x{ord(c):02X}" for c in chars)


#: Separators and words of the word-level contracts: ASCII letters and digits, and everything outside ASCII.
_SEPARATORS = _listed("".join(c for c in map(chr, range(128)) if not c.isalnum()))
SEPARATOR, WORD = f"[{_SEPARATORS}]", f"[^{_SEPARATORS}]+"
#: Runs of anything but ASCII white space.
TOKEN = f"[^{_listed(' ' + chr(9) + chr(10) + chr(11) + chr(12) + chr(13))}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset, the session's checkpoint
    folder or a temporary one, the latter in local mode only: on a cluster its executors would write elsewhere."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured is None and sc.getCheckpointDir() is None and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="orolith-checkpoints-"))
    return configured or sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it, for inner columns beside a user's."""
    taken, out = {x.lower() for x in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def stable(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Hadoop's local file system starts a chmod process for each file and its checksum file; while it forks, the JVM's memory shows
#: twice. The raw one starts none. Other file systems are not touched.
RAW_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def tabled(df: DataFrame, path: str) -> DataFrame:
    """The rows of df as a Parquet table at path, computed once; its files start no processes where the path is local."""
    df.write.options(**RAW_FILES).parquet(path)
    return df.sparkSession.read.parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int, read: int | None = None) -> Iterator[None]:
    """What runs within hands workers so many rows at a time, and decodes so many of a Parquet file (None: as the session says),
    or fewer if the session says so."""
    sizes = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows} | ({"spark.sql.parquet.columnarReaderBatchSize": read} if read else {})
    before = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, n in sizes.items():
            spark.conf.set(k, n if int(before[k]) <= 0 else min(n, int(before[k])))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def token_count(text: Column) -> Column:
    """Words between ASCII white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What a Python worker holds for the tasks of one operator. Workers outlive stages, so what was held for another
    operator goes first, and its memory back to the system."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def claim(operator: str) -> None:
    """For operators that hold nothing: what another one left in the worker goes."""
    held(operator, object)


def release() -> None:
    if _HELD:
        for key in list(_HELD):
            del _HELD[key]
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library may have no such call
        ctypes.CDLL(None).malloc_trim(0)
