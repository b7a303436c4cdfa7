"""python -m intervale: list inputs, look at artifacts, tidy outputs, or run a catalogued query."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="intervale", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    inputs = commands.add_parser("inputs", help="media files that a run would take")
    inputs.add_argument("path")
    inputs.add_argument("--mm", action="store_true", help="multimodal where there is a video")
    inspect = commands.add_parser("inspect", help="artifacts below a folder: path, kind, size and what JSON and text hold")
    inspect.add_argument("path")
    tidy = commands.add_parser("tidy", help="move stamped notes that have a latest one to the archive")
    tidy.add_argument("path")
    tidy.add_argument("--apply", action="store_true", help="do it; else only show it")
    query = commands.add_parser("query", help="run a catalogued query over a folder of tables")
    query.add_argument("name")
    query.add_argument("folder")
    config = commands.add_parser("config", help="check a settings file")
    config.add_argument("path")
    return top


def show(rows: DataFrame) -> None:
    for row in rows.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Files and folders below a folder: path, is_dir, is_symlink."""
    from pathlib import Path

    base = Path(root)
    rows = [(p.relative_to(base).as_posix(), p.is_dir(), p.is_symlink()) for p in base.rglob("*")]
    return spark.createDataFrame(rows, "path string, is_dir boolean, is_symlink boolean")


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    from intervale.plans import config, every
    from intervale.sources import catalog, files

    if a.command == "config":
        try:
            made = config.load_config(a.path)
        except config.ConfigError as e:
            print(e, file=sys.stderr)
            return 1
        print(f"{len(made.profiles)} profiles, {len(made.settings)} settings")
        return 0
    spark = spark or SparkSession.builder.appName("intervale").getOrCreate()
    if a.command == "inputs":
        show(files.run_mode(files.resolve_inputs(spark, a.path), multimodal=a.mm).orderBy("path"))
    elif a.command == "inspect":
        show(catalog.inspect(files.read_files(spark, a.path, content=True)).orderBy("path"))
    elif a.command == "tidy":
        plan = files.tidy_plan(listing(spark, a.path))
        show(plan.orderBy("path"))
        if a.apply:
            print(files.apply_tidy(plan, f"file://{a.path}"), "moved")
        return int(plan.where(F.col("conflict").isNotNull()).limit(1).count() > 0)
    elif a.command == "query":
        show(every.queries()[a.name](spark, a.folder))
    return 0


if __name__ == "__main__":
    sys.exit(main())
