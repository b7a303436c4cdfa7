"""Running stages: what a run knows, its order, what failed, and one writer an input."""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from intervale.operators.validate import InvalidRows
from intervale.plans.clients import ClientError
from intervale.plans.config import Config, ConfigError
from intervale.sources.catalog import Catalog, MissingArtifact
from intervale.sources.media import MediaError

log = logging.getLogger(__name__)
#: The kind of failure that an error counts as, first match first.
KINDS = ((ConfigError, "Config"), (MissingArtifact, "Cache"), (MediaError, "Media"), (ClientError, "Model"), (InvalidRows, "Model"), (PySparkException, "Spark"))


class StageError(RuntimeError):
    """A stage failed; ``kind`` is one of the failures table's classes."""

    def __init__(self, stage: str, kind: str, message: str):
        super().__init__(f"{stage}: {message}")
        self.stage, self.kind = stage, kind


class Busy(RuntimeError):
    """Another run holds the input."""


def kind_of(error: BaseException) -> str:
    return next((name for t, name in KINDS if isinstance(error, t)), type(error).__name__)


@dataclass(frozen=True)
class Context:
    """What every stage of one input's run gets."""

    spark: SparkSession
    config: Config
    source_path: str
    input_hash: str
    mode: str = "audio_only"
    no_cache: bool = False
    debug: bool = False

    @property
    def run_dir(self) -> str:
        return f"{self.config['project.cache_dir']}/{self.input_hash}"

    @property
    def artifacts(self) -> Catalog:
        return Catalog(self.spark, self.run_dir)


def make_context(spark: SparkSession, config: Config, source: DataFrame, *, multimodal: bool = False, **flags: bool) -> Context:
    """From one row (path, input_hash, kind): multimodal where asked for and the source is a video."""
    row = source.select("path", "input_hash", "kind").first()
    return Context(spark, config, row.path, row.input_hash, "multimodal" if multimodal and row.kind == "video" else "audio_only", **flags)


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[Context], Any]


def run_stage(stage: Stage, context: Context) -> Any:
    """The stage's result; any error becomes a StageError of its kind."""
    log.info("%s: %s", stage.name, context.source_path)
    try:
        return stage.run(context)
    except StageError:
        raise
    except Exception as e:
        raise StageError(stage.name, kind_of(e), str(e)) from e


def together(*jobs: Callable[[], Any]) -> list[Any]:
    """Results of independent jobs that the scheduler may run side by side; the first error is raised when all have ended."""
    with ThreadPoolExecutor(len(jobs) or 1) as pool:
        running = [pool.submit(j) for j in jobs]
    return [r.result() for r in running]


def run_all(context: Context, audio: Iterable[Stage], visual: Iterable[Stage], merged: Iterable[Stage]) -> None:
    """Audio stages beside visual ones, which a run without video leaves out, and then those that need both."""
    line = lambda stages: [run_stage(s, context) for s in stages]
    together(lambda: line(audio), *([lambda: line(visual)] if context.mode == "multimodal" else []))
    line(merged)


def run_batch(inputs: Iterable[tuple[str, Callable[[], Any]]]) -> tuple[int, list[tuple[str, str, str, str]]]:
    """(exit code, failures (input, stage, kind, message)): every input runs, whatever became of the others."""
    failures = []
    for name, run in inputs:
        try:
            run()
        except StageError as e:
            failures.append((name, e.stage, e.kind, str(e)))
        except Exception as e:
            failures.append((name, "", kind_of(e), str(e)))
    return int(bool(failures)), failures


@contextmanager
def one_writer(spark: SparkSession, run_dir: str, *, stale_after: float = 600.0) -> Iterator[None]:
    """Hold an input's folder: a lock file that only one run can make, on any store that makes files atomically.

    The holder touches its lock while it runs.  One that nobody has touched for
    ``stale_after`` seconds is that of a killed run, and is taken over: it is
    moved away first, and moved back if it turns out to be another's by then.
    """
    jvm = spark.sparkContext._jvm
    lock = jvm.org.apache.hadoop.fs.Path(f"{run_dir.rstrip('/')}/.lock")
    store = lock.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(lock.getParent())
    owner = uuid.uuid4().hex

    def owner_of(path) -> str | None:
        try:
            opened = store.open(path)
            try:
                return bytes(opened.readNBytes(32)).decode()
            finally:
                opened.close()
        except Exception:  # it has gone
            return None

    def make() -> bool:
        try:
            out = store.create(lock, False)
        except Exception:
            return False
        out.write(bytearray(owner.encode()))
        out.close()
        return True

    def take_over() -> bool:
        try:
            old, touched = owner_of(lock), store.getFileStatus(lock).getModificationTime()
        except Exception:  # it has gone
            return make()
        if time.time() - touched / 1000 < stale_after:
            return False
        aside = jvm.org.apache.hadoop.fs.Path(f"{lock}.{owner}")
        if not store.rename(lock, aside):
            return False
        if owner_of(aside) != old:
            store.rename(aside, lock)
            return False
        store.delete(aside, False)
        return make()

    if not (make() or take_over()):
        raise Busy(f"another run holds {run_dir}")
    ended = threading.Event()

    def touch() -> None:
        while not ended.wait(stale_after / 4):
            store.setTimes(lock, int(time.time() * 1000), -1)

    threading.Thread(target=touch, daemon=True).start()
    try:
        yield
    finally:
        ended.set()
        if owner_of(lock) == owner:
            store.delete(lock, False)
