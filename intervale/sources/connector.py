"""Files with exact names as a Spark sink, and artifacts below a cache folder as a Spark source.

Both are Python data sources.  They reach what pyarrow reaches: local and mounted
folders, and stores by URI; run folders are read in parallel, and files are
written where the rows are.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from intervale.functions.canonical import canonical_json
from intervale.shipping import ship
from intervale.sources.catalog import ARTIFACTS

KEY = "recording_id"
SINK, SOURCE = "intervale_files", "intervale_artifacts"
#: Bytes of a file that a copy holds at a time.
PIECE = 1 << 20
#: Times that a failed run's folder is deleted if tasks still write there.
TRIES = 10
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _store(path: str):
    """(file system, path in it)"""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _put(store, target: str, content: bytes) -> None:
    with store.open_output_stream(target) as out:
        out.write(content)


def _copy(store, target: str, source: str) -> tuple[str, int]:
    """(hash, size) of a file that is copied a piece at a time."""
    theirs, at = _store(source)
    digest, size = hashlib.sha256(), 0
    with theirs.open_input_stream(at) as pieces, store.open_output_stream(target) as out:
        while piece := pieces.read(PIECE):
            digest.update(piece)
            out.write(piece)
            size += len(piece)
    return digest.hexdigest(), size


# ---------------------------------------------------------------- sink


@dataclass
class Staged(WriterCommitMessage):
    """What a task wrote: (name, hash, size) of files below a folder of its own."""

    folder: str
    files: tuple[tuple[str, str, int], ...]


class FileWriter(DataSourceWriter):
    """Files wait in a folder of the run until all tasks are done, then move to their names, the manifest's row last.

    A task that failed or ran twice leaves only files that nothing names.  A run
    that is repeated writes the same names and the same row.
    """

    def __init__(self, root: str, run_id: str, stage: str):
        self.root, self.run_id, self.stage = root.rstrip("/"), run_id, stage

    @property
    def waiting(self) -> str:
        return f"{_store(self.root)[1]}/.staging/{self.run_id}"

    def open(self) -> FileWriter:
        """Make the run's folder, on the driver: a task that goes on after its run has failed finds none and fails too."""
        _store(self.root)[0].create_dir(self.waiting, recursive=True)
        return self

    def write(self, rows: Iterator) -> Staged:
        store, _ = _store(self.root)
        folder, files = f"{self.waiting}/{uuid.uuid4().hex}", {}
        store.create_dir(folder, recursive=False)
        for row in rows:
            name = PurePosixPath(row["path"])
            if name.is_absolute() or ".." in name.parts or not name.parts or name.parts[0] in (".staging", "manifest"):
                raise ValueError(f"{row['path']} is no name below the target")
            if str(name) in files:
                raise ValueError(f"{name} is written twice")
            for above in reversed(name.parents[:-1]):
                store.create_dir(f"{folder}/{above}", recursive=False)
            if "source" in row and row["source"] is not None:
                files[str(name)] = (str(name), *_copy(store, f"{folder}/{name}", row["source"]))
                continue
            content = row["content"].encode() if isinstance(row["content"], str) else bytes(row["content"] or b"")
            _put(store, f"{folder}/{name}", content)
            files[str(name)] = (str(name), hashlib.sha256(content).hexdigest(), len(content))
        return Staged(folder, tuple(files.values()))

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = _store(self.root)
        done = [m for m in messages if m is not None]
        files = sorted(f for m in done for f in m.files)
        names = [name for name, _, _ in files]
        if len(names) != len(set(names)):
            raise ValueError(f"{next(a for a, b in zip(names, names[1:], strict=False) if a == b)} is written twice")
        for folder in {str(PurePosixPath(f"{root}/{name}").parent) for name in names}:
            store.create_dir(folder, recursive=True)
        for m in done:
            for name, _, _ in m.files:
                store.move(f"{m.folder}/{name}", f"{root}/{name}")
        row = {"run_id": self.run_id, "stage_name": self.stage, "outputs": [{"path": n, "sha256": h, "size": s} for n, h, s in files]}
        _put(store, f"{self.waiting}/row", json.dumps(row, sort_keys=True).encode())
        store.create_dir(f"{root}/manifest", recursive=True)
        store.move(f"{self.waiting}/row", f"{root}/manifest/{self.run_id}.json")
        store.delete_dir(self.waiting)

    def abort(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        store, _ = _store(self.root)
        for left in reversed(range(TRIES)):
            try:
                if store.get_file_info(self.waiting).type == fs.FileType.Directory:
                    store.delete_dir(self.waiting)
                return
            except OSError:  # a task that isn't stopped yet has put a file there meanwhile
                if not left:
                    raise
                time.sleep(0.1)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return SINK

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], self.options["run_id"], self.options.get("stage", "")).open()


def write_files(files: DataFrame, root: str, *, run_id: str, stage: str = "") -> None:
    """Files (path below the root, content as text or binary), all of them or none, and one row of the run in the manifest.

    Rows with a ``source`` are copies of that file, made where the row is, so that
    only names are shuffled; one that isn't there fails the run.
    """
    spark = files.sparkSession
    ship(spark)
    spark.dataSource.register(Files)
    files.select("path", "content", *(["source"] if "source" in files.columns else [])).write.format(SINK).mode("append").option("path", root).option("run_id", run_id).option("stage", stage).save()


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, stage_name, outputs): a row a run."""
    return spark.read.schema("run_id string, stage_name string, outputs array<struct<path:string,sha256:string,size:long>>").json(f"{root.rstrip('/')}/manifest")


def segment_files(refined: DataFrame) -> DataFrame:
    """A JSON document for each refined segment: <recording>/refined/0001.json for id 1."""
    kind = refined.drop(KEY).schema
    body = canonical_json(F.struct(*[F.col(f"`{f.name}`") for f in kind.fields]), kind)
    return refined.select(F.concat(F.col(KEY).cast("string"), F.format_string("/refined/%04d.json", "id")).alias("path"), body.alias("content"))


def section_files(sections: DataFrame) -> DataFrame:
    """Markdown of (recording_id, chapter_id, text): <recording>/sections/001.md for chapter 1."""
    return sections.select(F.concat(F.col(KEY).cast("string"), F.format_string("/sections/%03d.md", F.col("chapter_id").cast("long"))).alias("path"), F.col("text").alias("content"))


def note_files(notes: DataFrame, *, stamp: str | None = None) -> DataFrame:
    """Notes (recording_id, stem, text): the cached one, the latest under its stem, and a stamped one beside it."""
    rec, stem = F.col(KEY).cast("string"), F.col("stem")
    names = [F.concat(rec, F.lit("/note.md")), F.concat(F.lit("out/"), stem, F.lit(".md")), *([F.concat(F.lit("out/"), stem, F.lit(f"-{stamp}.md"))] if stamp else [])]
    return notes.select(F.explode(F.array(*names)).alias("path"), F.col("text").alias("content"))


def asset_files(assets: DataFrame, *, below: str = "") -> DataFrame:
    """Copies of published images (``sinks.published_assets``), a row a file; ``below`` is the folder that their sources' names start from."""
    base = f"{below.rstrip('/')}/" if below else ""
    copies = assets.select(F.col("target").alias("path"), F.lit(None).cast("binary").alias("content"), F.concat(F.lit(base), "source").alias("source")).distinct()
    return copies.repartition(assets.sparkSession.sparkContext.defaultParallelism, "path")  # few light rows, much to copy


# ---------------------------------------------------------------- source


@dataclass
class RunFolder(InputPartition):
    folder: str


class ArtifactReader(DataSourceReader):
    """A partition for each run folder.  Filters on ``input_hash`` and ``artifact`` are the source's own: what they rule out is not opened."""

    def __init__(self, root: str, contents: bool):
        self.root, self.contents = root.rstrip("/"), contents
        self.runs: set[str] | None = None
        self.prefixes: list[str] = []
        self.artifacts = set(ARTIFACTS)

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, IsNotNull) and f.attribute in (("input_hash",), ("artifact",)):
                continue  # they never are
            values = {f.value} if isinstance(f, EqualTo | StringStartsWith) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("input_hash",), ("artifact",)) or (isinstance(f, StringStartsWith) and f.attribute != ("input_hash",)):
                yield f
            elif isinstance(f, StringStartsWith):
                self.prefixes.append(f.value)
            elif f.attribute == ("artifact",):
                self.artifacts &= values
            else:
                self.runs = values if self.runs is None else self.runs & values

    def partitions(self) -> list[RunFolder]:
        from pyarrow import fs

        if not self.artifacts:
            return []
        store, root = _store(self.root)
        if self.runs is not None:  # named folders are asked for, not looked up among all
            found = [x for x in store.get_file_info([f"{root}/{r}" for r in sorted(self.runs)]) if x.type == fs.FileType.Directory]
        else:
            found = [x for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.type == fs.FileType.Directory]
        names = [x.base_name for x in found]
        return [RunFolder(n) for n in sorted(names) if n not in (".staging", "manifest") and all(n.startswith(p) for p in self.prefixes)]

    def read(self, partition: RunFolder):
        from pyarrow import fs

        if partition is None:  # an empty listing is read as one empty partition
            return
        store, root = _store(self.root)
        at = f"{root}/{partition.folder}"
        for artifact in sorted(self.artifacts):
            info = store.get_file_info(f"{at}/{ARTIFACTS[artifact][0]}")
            files = [info] if info.type == fs.FileType.File else sorted(store.get_file_info(fs.FileSelector(info.path)), key=lambda x: x.path) if info.type == fs.FileType.Directory else []
            for x in files:
                if x.type == fs.FileType.File:
                    content = None
                    if self.contents:
                        with store.open_input_stream(x.path) as opened:
                            content = opened.read()
                    yield partition.folder, artifact, x.path.removeprefix(f"{at}/"), x.size, content


class Artifacts(DataSource):
    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return "input_hash string, artifact string, path string, length long, content binary"

    def reader(self, schema) -> ArtifactReader:
        return ArtifactReader(self.options["path"], self.options.get("contents", "true") == "true")


def read_artifacts(spark: SparkSession, root: str, *, contents: bool = True) -> DataFrame:
    """(input_hash, artifact, path, length, content) of the artifacts of all runs; a folder's files are rows each.

    Without ``contents`` no file is opened.  Unknown files are left out.
    """
    ship(spark)
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Artifacts)
    return spark.read.format(SOURCE).option("path", root).option("contents", str(contents).lower()).load()
