"""What the operators of this subpackage share: folders, code shipping, text folding.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``, so they survive the loss of any executor and cut the
lineage of what follows.  Where that setting is absent the session must be a
local one (tests), and a folder of our own is used.
"""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.shipping import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters outside ASCII that lower-casing could change; those that the regex engine does not know may be newer capitals.
FOREIGN_CAPITAL = r"[[^\x00-\x7F]&&[\p{IsUppercase}\p{Lt}\p{Cn}]]"

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of a filter of hashed keys, by the number of keys up to the larger one (8 MB).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26

_libc = ctypes.CDLL(None)
_scratch_roots: dict[str, SparkSession] = {}
_opened: dict[tuple[str, str], list[str]] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches and make this package importable on every executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    ship(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints/intervale"


class Scratch:
    """A folder of intermediate tables of one operator call, deleted when the driver exits."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        base = f"{shared_folder(spark)}/intervale/{spark.sparkContext.applicationId}"
        if base not in _scratch_roots:
            _scratch_roots[base] = spark
            atexit.register(_drop, base)
        self.root = f"{base}/{label}-{uuid.uuid4().hex[:12]}"
        _opened.setdefault((base, label), []).append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, frame: DataFrame, name: str) -> DataFrame:
        """Write once, then read what was written."""
        with dropping_shuffles(self.spark):
            frame.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def free(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))


def drop_finished(spark: SparkSession, label: str) -> None:
    """Delete the tables of all earlier calls under this label.

    Only for callers that write each result before they ask for the next one,
    as the stages of the pipeline do: a result that is still to be read is lost.
    """
    base = f"{shared_folder(spark)}/intervale/{spark.sparkContext.applicationId}"
    for root in _opened.pop((base, label), []):
        _delete(spark, root)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop(base: str) -> None:
    spark = _scratch_roots.pop(base, None)
    try:
        if spark is not None and spark.sparkContext._jsc is not None:
            _delete(spark, base)
    except Exception:  # the session may be gone at exit
        pass


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files on the executors."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def new_name(stem: str, *taken: list[str]) -> str:
    """A column name that clashes with none of those given, in any case."""
    used = {c.lower() for cols in taken for c in cols}
    name = f"_iv_{stem}"
    while name.lower() in used:
        name += "_"
    return name


def bit_filter(keys: DataFrame) -> Callable[[Column], Column]:
    """A condition that holds for every key of the one column of ``keys``, and for few others.

    One bit a hashed key, of 16 to 32 bits a key and 8 MB at most, so that rows
    without a match need no shuffle.  Beyond that size the filter lets more rows
    through; what follows it has to be exact.
    """
    bits, wanted = LEAST_BITS, 16 * keys.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2

    def place(key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(bits))

    words = keys.select(place(F.col(keys.columns[0])).alias("place")).groupBy(F.expr("place div 32").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place % 32 as int))")).alias("bits")
    )
    whole = keys.sparkSession.range(bits // 32).select(F.col("id").alias("word")).join(words, "word", "left")
    # Two levels, so that one task gathers rows of arrays instead of single words.
    chunks = whole.groupBy(F.expr("word div 1024").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("words"))
    filled = chunks.agg(F.flatten(F.expr("transform(array_sort(collect_list(struct(chunk, words))), c -> transform(c.words, w -> w.bits))")).alias("bits"))

    def holds(key: Column) -> Column:
        at = place(key)
        word = F.get(filled.scalar(), (at / 32).cast("int"))
        return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int"))) != 0

    return holds


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` is much faster than ``translate`` and equal to it unless the text
    holds a capital outside ASCII.
    """
    return F.when(text.rlike(FOREIGN_CAPITAL), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text, by a modulus; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def give_back() -> None:
    """Return this process's free memory to the system: an idle worker stays beside the ones of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc, "malloc_trim", None)
    if trim is not None:
        trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
