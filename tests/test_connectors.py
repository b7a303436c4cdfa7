"""Files with exact names, artifacts as a source, change scores and what a change makes stale."""

import json
import random

import pytest
from pyspark.sql import functions as F

from intervale.operators import memo, selection
from intervale.settling import settle
from intervale.sources import connector, sinks


def names(root):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file())


def refined(spark, n=12):
    return spark.range(n).select(F.lit("r").alias("recording_id"), (F.col("id") + 1).alias("id"), F.lit(1.5).alias("start"), F.concat(F.lit("tÜ"), "id").alias("topic"), F.array(F.col("id")).alias("cross_refs")).repartition(4)


def test_files_have_exact_names(spark, tmp_path):
    root = tmp_path / "out"
    connector.write_files(connector.segment_files(refined(spark)), str(root), run_id="run1", stage="refine")
    assert names(root) == ["manifest/run1.json", *(f"r/refined/{i:04d}.json" for i in range(1, 13))]
    assert json.loads((root / "r/refined/0003.json").read_text()) == {"id": 3, "start": 1.5, "topic": "tÜ2", "cross_refs": [2]}
    sections = spark.createDataFrame([("r", 1, "# Ä\n"), ("r", 2, "")], "recording_id string, chapter_id int, text string")
    connector.write_files(connector.section_files(sections), root.as_uri(), run_id="run2", stage="section")
    notes = spark.createDataFrame([("r", "talk", "note\n")], "recording_id string, stem string, text string")
    connector.write_files(connector.note_files(notes, stamp="20260101-000000"), str(root), run_id="run3", stage="assemble")
    assert (root / "r/sections/001.md").read_text() == "# Ä\n" and (root / "r/sections/002.md").read_text() == ""
    assert {p.read_text() for p in (root / "r/note.md", root / "out/talk.md", root / "out/talk-20260101-000000.md")} == {"note\n"}
    rows = {r.run_id: r for r in connector.manifest(spark, str(root)).collect()}
    assert sorted(rows) == ["run1", "run2", "run3"] and [o.path for o in rows["run2"].outputs] == ["r/sections/001.md", "r/sections/002.md"] and rows["run2"].outputs[1].size == 0


def test_a_repeated_run_adds_no_row(spark, tmp_path):
    for topic in ("a", "a", "b"):
        connector.write_files(connector.segment_files(refined(spark, 3).withColumn("topic", F.lit(topic))), str(tmp_path), run_id="run", stage="refine")
    assert connector.manifest(spark, str(tmp_path)).count() == 1
    assert names(tmp_path) == ["manifest/run.json", "r/refined/0001.json", "r/refined/0002.json", "r/refined/0003.json"]
    assert json.loads((tmp_path / "r/refined/0002.json").read_text())["topic"] == "b"


def test_images_are_copied_to_their_notes(spark, tmp_path):
    cache, root = tmp_path / "cache", tmp_path / "out"
    (cache / "f").mkdir(parents=True)
    for i in range(9):
        (cache / f"f/{i}.png").write_bytes(bytes([i]) * (connector.PIECE + i if i == 3 else i))
    seen = [("r", [f"f/{i}.png" for i in (0, 3, 3, 5)]), ("r", ["f/5.png"]), ("q", ["f/8.png"]), ("empty", [])]
    blocks = spark.createDataFrame([(r, [(x,) for x in v]) for r, v in seen], "recording_id string, visuals array<struct<image_path:string>>")
    note = F.concat(F.col("recording_id"), F.lit("/n.md"))
    assets = sinks.published_assets(blocks, note=note, latest=note, cache="cache", resolved=str(cache))
    connector.write_files(connector.asset_files(assets, below=str(tmp_path)), str(root), run_id="run", stage="publish")
    assert names(root) == ["manifest/run.json", "q/n_assets/8.png", "r/n_assets/0.png", "r/n_assets/3.png", "r/n_assets/5.png"]
    assert all((root / f"{r}/n_assets/{i}.png").read_bytes() == (cache / f"f/{i}.png").read_bytes() for r, i in (("r", 0), ("r", 3), ("r", 5), ("q", 8)))
    sizes = {o.path: o["size"] for o in connector.manifest(spark, str(root)).first().outputs}
    assert sizes["r/n_assets/3.png"] == connector.PIECE + 3 and sizes["r/n_assets/0.png"] == 0
    notes = spark.createDataFrame([("r", f"![x]({cache}/f/3.png) ![y](f/8.png)"), ("empty", "![x](f/3.png)"), ("none", None)], "recording_id string, text string")
    assert {r.recording_id: r.text for r in sinks.published_notes(notes, assets).collect()} == {"r": "![x](n_assets/3.png) ![y](f/8.png)", "empty": "![x](f/3.png)", "none": None}
    (cache / "f/5.png").unlink()
    with pytest.raises(Exception, match="5.png"):
        connector.write_files(connector.asset_files(assets, below=str(tmp_path)), str(root), run_id="again", stage="publish")
    assert names(root) == ["manifest/run.json", "q/n_assets/8.png", "r/n_assets/0.png", "r/n_assets/3.png", "r/n_assets/5.png"]


def test_a_failed_run_leaves_the_target_whole(spark, tmp_path):
    connector.write_files(connector.segment_files(refined(spark, 3)), str(tmp_path), run_id="good", stage="refine")
    before = {n: (tmp_path / n).read_bytes() for n in names(tmp_path)}
    fails = refined(spark).withColumn("topic", F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise("new"))
    doubled = refined(spark).withColumn("id", F.col("id") % 5).repartition(1)
    apart = refined(spark, 2).withColumn("id", F.lit(1).cast("long")).repartition(2, "topic")
    for bad in (fails, doubled, apart):
        with pytest.raises(Exception, match="broken|written twice"):
            connector.write_files(connector.segment_files(bad), str(tmp_path), run_id="bad", stage="refine")
        assert {n: (tmp_path / n).read_bytes() for n in names(tmp_path)} == before
    for path in ("../x", "/x", ".staging/x", "manifest/good.json", ""):
        with pytest.raises(Exception, match="no name below"):
            connector.write_files(spark.createDataFrame([(path, "x")], "path string, content string"), str(tmp_path), run_id="bad")
    assert {n: (tmp_path / n).read_bytes() for n in names(tmp_path)} == before


def test_artifacts_are_read_where_filters_let_them(spark, tmp_path):
    for run in ("h1", "h2", "x3"):
        (tmp_path / run / "sections").mkdir(parents=True)
        (tmp_path / run / "note.md").write_text(f"note of {run}")
        (tmp_path / run / "sections" / "001.md").write_text("one")
        (tmp_path / run / "sections" / "002.md").write_text("two")
        (tmp_path / run / "other.txt").write_text("not an artifact")
    found = connector.read_artifacts(spark, str(tmp_path))
    assert found.count() == 9 and found.rdd.getNumPartitions() == 3
    # A file that can't be read shows which ones are opened.
    (tmp_path / "h2" / "note.md").unlink()
    (tmp_path / "h2" / "note.md").symlink_to("/proc/self/mem")
    with pytest.raises(Exception, match="note.md|rror"):
        found.collect()
    one = found.where("input_hash = 'h1'")
    assert one.rdd.getNumPartitions() == 1 and {r.path for r in one.collect()} == {"note.md", "sections/001.md", "sections/002.md"}
    assert {(r.input_hash, r.path) for r in found.where("artifact = 'sections_dir' and input_hash like 'h%'").collect()} == {(h, f"sections/00{i}.md") for h in ("h1", "h2") for i in (1, 2)}
    assert found.where("input_hash in ('x3', 'gone')").count() == 3 and found.where("artifact = 'nothing'").count() == 0
    bare = connector.read_artifacts(spark, str(tmp_path), contents=False)
    assert bare.count() == 9 and bare.where("content is not null").count() == 0
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]
    assert connector.read_artifacts(spark, str(tmp_path / "nowhere")).count() == 0


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_change_scores_do_not_depend_on_blocks(spark, block):
    rng = random.Random(block)
    data = [(r, f, float(f), [rng.random() for _ in range(4 if f % 9 else 3)]) for r in "ab" for f in sorted(rng.sample(range(200), 40))] + [("c", 5, 5.0, []), ("c", 6, 6.0, []), ("c", 7, 7.0, None)]
    got = selection.change_scores(spark.createDataFrame(data, "recording_id string, frame long, ts double, feature array<double>"), block=block).collect()
    last, want = {}, {}
    for r, f, _, x in data:
        y, last[r] = last.get(r), x
        want[r, f] = sum(abs(a - b) for a, b in zip(x, y, strict=True)) / len(x) if x and y and len(x) == len(y) else 0.0
    assert {(r.recording_id, r.frame): round(r.score, 12) for r in got} == {k: round(v, 12) for k, v in want.items()} and len(got) == len(data)


def test_what_a_change_makes_stale(spark):
    """Shared inputs, other recordings, a circle, and what reads nothing that changed."""
    made = [("r", "a", [], ["1"]), ("r", "b", ["1"], ["2", "3"]), ("r", "c", ["1", "2"], ["4"]), ("r", "d", ["4", "3"], ["5"]), ("s", "e", ["5"], ["6"]), ("s", "f", ["9"], ["7"]), ("s", "g", ["6", "8"], ["8"])]
    frame = spark.createDataFrame(made, "recording_id string, stage_name string, inputs array<string>, outputs array<string>")
    closed = lambda *keys: {(r.recording_id, r.stage_name): r.depth for r in memo.stale_closure(frame, spark.createDataFrame(list(keys), "recording_id string, stage_name string"), settle=settle).collect()}
    assert closed(("r", "a")) == {("r", "a"): 0, ("r", "b"): 1, ("r", "c"): 1, ("r", "d"): 2, ("s", "e"): 3, ("s", "g"): 4}
    assert closed(("r", "d"), ("s", "f"), ("s", "f")) == {("r", "d"): 0, ("s", "f"): 0, ("s", "e"): 1, ("s", "g"): 2}
    assert memo.stale_closure(frame, frame.limit(0), settle=settle).count() == 0


def test_a_long_chain_ends(spark):
    chain = spark.range(30).select(F.lit("r").alias("recording_id"), F.concat(F.lit("s"), "id").alias("stage_name"), F.array(F.col("id").cast("string")).alias("inputs"), F.array((F.col("id") + 1).cast("string")).alias("outputs"))
    assert memo.stale_closure(chain, chain.where("stage_name = 's0'"), settle=settle).agg(F.max("depth")).first()[0] == 29
