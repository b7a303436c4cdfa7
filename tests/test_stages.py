"""Completions, settings, runs, artifacts, sinks, media and frames."""

import json
import math
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intervale.functions import canonical
from intervale.functions import frames as fr
from intervale.operators import memo, selection, validate
from intervale.plans import clients, completion, config, refine, runner, services
from intervale.plans.catalogue_stages import PROFILE, JsonScript, RefineScript
from intervale.sources import catalog, files, media, sinks

# ---------------------------------------------------------------- frames


def grey_rows(spark, frames):
    return spark.createDataFrame([(i, [int(x) for x in f.ravel()], f.shape[1]) for i, f in enumerate(frames)], "i int, g array<int>, w int")


def pictures():
    rng = np.random.default_rng(4)
    step = np.full((20, 30), 20, np.uint8)
    step[:, 15:] = 220
    return [rng.integers(0, 256, (12, 9)).astype(np.uint8), np.full((5, 7), 9, np.uint8), step, rng.integers(0, 256, (1, 6)).astype(np.uint8), rng.integers(0, 256, (6, 1)).astype(np.uint8)]


def test_statistics_of_frames(spark):
    frames = pictures()
    got = grey_rows(spark, frames).select("i", fr.entropy(F.col("g")).alias("e"), fr.contrast(F.col("g")).alias("c"), fr.sharpness(F.col("g"), F.col("w")).alias("s")).orderBy("i").collect()
    for r, f in zip(got, frames):
        p = np.bincount(f.ravel() // 4, minlength=64) / f.size
        p = p[p > 0]
        assert abs(r.e + (p * np.log2(p)).sum() / 6) < 1e-12 and abs(r.c - f.std() / 255) < 1e-12
        wide = np.pad(f.astype(int), [(1, 1) if n > 1 else (0, 0) for n in f.shape], mode="reflect")
        wide = np.pad(wide, [(0, 0) if n > 1 else (1, 1) for n in f.shape], mode="edge")
        lap = wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * f.astype(int)
        assert abs(r.s - lap.var()) < 1e-6


def test_densities_of_frames(spark):
    frames = pictures()
    got = grey_rows(spark, frames).select("i", fr.densities(F.col("g"), F.col("w")).alias("d")).orderBy("i").collect()
    assert got[1].d.edges == got[1].d.foreground == 0.0
    assert got[2].d.edges == 1 / 30  # one column of the step
    for r, f in zip(got, frames):
        if min(f.shape) > 1:
            k = np.exp(-(np.arange(-27, 28) ** 2) / 162)
            k /= k.sum()
            wide = np.pad(f.astype(float), 27, mode="reflect")
            rows = np.array([[sum(k[j] * wide[y, x + j] for j in range(55)) for x in range(f.shape[1])] for y in range(wide.shape[0])])
            blurred = np.rint([[sum(k[j] * rows[y + j, x] for j in range(55)) for x in range(f.shape[1])] for y in range(f.shape[0])])
            assert abs(r.d.foreground - (abs(f - blurred) > 12).mean()) <= 1 / f.size
    empty = spark.createDataFrame([([], 3), (None, 3)], "g array<int>, w int").select(fr.densities(F.col("g"), F.col("w")).alias("d")).collect()
    assert [tuple(r.d) for r in empty] == [(0.0, 0.0)] * 2


def test_resize_takes_means_of_areas():
    f = np.arange(24, dtype=np.uint8).reshape(4, 6)
    assert fr.resize_area(f, 6) is f
    assert fr.resize_area(f, 3).tolist() == [[round(f[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].mean()) for x in range(3)] for y in range(2)]
    assert fr.resize_area(np.full((7, 10), 50, np.uint8), 4).tolist() == [[50] * 4] * 2


def test_scenes_and_seeks(spark):
    scores = spark.createDataFrame([("r", i, i * 10, s) for i, s in enumerate([0.0, 90.0, 95.0, 0.0, 40.0, 99.0])] + [("q", 0, 5, 0.0)], "recording_id string, frame long, ts long, score double")
    got = sorted(tuple(r) for r in selection.scene_cuts(scores, thresholds=[50.0, 96.0], least_frames=2).collect())
    assert got == [("r", 50.0, 0, 20), ("r", 50.0, 20, 50), ("r", 96.0, 0, 50)]
    times = spark.createDataFrame([("r", 0, -1.0), ("r", 1, 1.5), ("r", 2, 99.0)], "recording_id string, time_id long, ts double")
    frames = spark.createDataFrame([("r", i, f"f{i}") for i in range(5)], "recording_id string, frame long, name string")
    assert [r.name for r in selection.frames_at(times, frames, fps=2.0).orderBy("time_id").collect()] == ["f0", "f3", None]


# ---------------------------------------------------------------- canonical JSON and caches


def test_canonical_json_is_that_of_sorted_keys(spark):
    kind = "b string, a struct<y: array<int>, x: double>, m map<string, boolean>, n array<struct<s: string, d: double>>"
    rng = random.Random(2)
    rows = [("".join(map(chr, range(40))) + '"\\é中\x7f', ([1, None], 1e10), {"z": True, "a": None}, [("x", 0.001), (None, None)]), (None, None, None, None), ("", ([], 1e-5), {}, [("t", rng.random() * 10**e) for e in range(-3, 9)])]
    frame = spark.createDataFrame(rows, kind)
    plain = lambda v: None if v is None else v.asDict(recursive=True) if hasattr(v, "asDict") else [plain(x) for x in v] if isinstance(v, list) else v
    for r in frame.select("*", canonical.canonical_json(F.struct("*"), T.StructType.fromDDL(kind)).alias("j")).collect():
        want = {k: plain(r[k]) for k in "bamn"}
        assert json.loads(r.j) == want
        if r.n is None or len(r.n) < 3:
            assert r.j == json.dumps(want, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def test_hits_need_their_files(spark):
    rows = spark.createDataFrame([("r", "s1", "k", ["a", "b"]), ("r", "s2", "k", ["c"])], "recording_id string, stage_name string, cache_key string, output_paths array<string>")
    there = spark.createDataFrame([("a",), ("b",)], "path string")
    assert [r.stage_name for r in memo.hits(rows, rows, there).collect()] == ["s1"]
    assert memo.hits(rows, rows.withColumn("output_paths", F.reverse("output_paths"))).count() == 1


def test_lookup_raises(spark):
    rows, table = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert sorted((r.k, r.v) for r in validate.lookup(rows, table, ["k"], ["v"], "thing").collect()) == [(1, "x"), (2, None)]
    with pytest.raises(Exception, match="no thing for 2"):
        validate.lookup(rows, table.where("k = 1"), ["k"], ["v"], "thing").select("v").collect()


# ---------------------------------------------------------------- completions


def test_failed_requests_are_not_asked_again(spark):
    rows = spark.createDataFrame([(4, "#4"), (2, "#2"), (3, "#3")], "id int, prompt string")
    good, bad = completion.complete_json(rows, JsonScript, PROFILE, "n bigint")
    assert [(r.id, r.record.n, r.attempt) for r in good.collect()] == [(2, 2, 2)]
    assert sorted((r.id, r.attempt, r.error_class) for r in bad.collect()) == [(2, 1, None), (3, 1, None), (3, 2, None), (4, 1, "Transport")]


def test_what_a_model_cannot_do_is_not_sent(spark):
    plain = config.Profile("p", "openai_chat", max_context=10)
    rows = spark.createDataFrame([("short",), ("x" * 60,)], "prompt string")
    got = completion.complete_text(rows, clients.EchoClient, plain).collect()
    assert [(r.answer, r.error_class) for r in got] == [("short", None), (None, "ContextLength")]
    refused = completion.complete_text(rows, clients.EchoClient, plain, config.Options(json_mode=True)).collect()
    assert [r.error_class for r in refused] == ["Model", "ContextLength"] and refused[0].message == "no json_mode"


@pytest.mark.parametrize("kind", ["openai_chat", "openai_responses", "anthropic_messages", "openai_compatible_chat"])
def test_services(kind):
    sent = []
    answers = {"/chat/completions": {"choices": [{"message": {"content": "yes"}}]}, "/responses": {"output": [{"type": "reasoning"}, {"type": "message", "content": [{"type": "output_text", "text": "yes"}]}]}, "/messages": {"content": [{"type": "thinking"}, {"type": "text", "text": "yes"}]}}

    def send(url, headers, body):
        sent.append((url, headers, body))
        return 200, next(v for k, v in answers.items() if url.endswith(k))

    profile = config.Profile("p", kind, model="m", base_url="http://localhost:1/v1/", api_key_env="K")
    client = services.connect(profile, {"K": "secret"}, send=send, system="be short", images=(services.Image("image/png", "AAAA"),), options=config.Options(temperature=0.2))
    assert client.complete("really?") == "yes"
    url, headers, body = sent[0]
    assert url.startswith("http://localhost:1/v1/") and "secret" in "".join(headers.values()) and body["model"] == "m" and body["temperature"] == 0.2
    assert "AAAA" in json.dumps(body) and "be short" in json.dumps(body) and "really?" in json.dumps(body) and None not in body.values()
    for status, error in ((401, clients.AuthError), (429, clients.RateLimitError), (503, clients.TransportError), (400, clients.ClientError)):
        with pytest.raises(error):
            services.connect(profile, {"K": "s"}, send=lambda *a: (status, {"error": "no"})).complete("x")  # noqa: B023
    with pytest.raises(clients.ClientError, match="no answer"):
        services.connect(profile, {"K": "s"}, send=lambda *a: (200, {})).complete("x")
    with pytest.raises(config.ConfigError):
        services.connect(config.Profile("p", "carrier_pigeon"))


@pytest.mark.parametrize(("mode", "want"), [("single_call", {}), ("batched", {4: "batch", 5: "batch"}), ("serial", dict.fromkeys(range(6), "segment")), ("adaptive", {0: "segment", 1: "segment", 2: "segment", 3: "segment", 4: "batch", 5: "batch"})])
def test_refine_modes(spark, mode, want):
    rows = spark.createDataFrame([("r", i, i, float(i), i + 1.0, "t") for i in range(6)], "recording_id string, seq long, id long, start double, stop double, text string")
    shown = lambda items: F.array_join(F.transform(items, lambda x: F.format_string("<%d %s %s>", x["id"], x["start"].cast("string"), x["stop"].cast("string"))), " ")
    good, left = refine.refine(rows, RefineScript, config.Profile("p", "openai_chat"), prompt=shown, mode=mode, batch_size=4)
    assert {r.id: r.unit for r in good.collect()} == want
    assert sorted(r.id for r in left.collect()) == [i for i in range(6) if i not in want]


# ---------------------------------------------------------------- settings and runs


def tree(**more):
    return {"llm": {"profiles": {"m": {"provider": "openai_chat", "model": "x"}}}, "tasks": dict.fromkeys(config.TASKS, "m")} | more


def test_settings(tmp_path):
    made = config.make_config(tree(merge={"assemble": {"include_toc": False}}))
    assert made["merge.assemble.include_toc"] is False and made["asr.language"] == "zh" and made.profile_of("refine").name == "m"
    for bad in ({"asr": {"speed": 1}}, {"audio_pipeline": {"refine": {"batch_size": 0}}}, {"visual_pipeline": {"filter": {"candidate_fps": float("nan")}}}, {"merge": {"assemble": {"timestamp_format": "{x}"}}}, {"tasks": {"cook": "m"}}):
        with pytest.raises(config.ConfigError):
            config.make_config(tree(**bad))
    path = tmp_path / "c.json"
    path.write_text(json.dumps(tree()))
    assert config.load_config(str(path)).profiles["m"].provider == "openai_chat"
    with pytest.raises(config.ConfigError):
        config.load_config(str(tmp_path / "none.json"))


def test_profiles():
    thinks = config.Profile("a", "anthropic_messages", capabilities=frozenset({"reasoning"}), thinking_budget_tokens=5)
    assert thinks.options(config.Options()).thinking_budget_tokens == 5 and thinks.refuses(thinks.options(config.Options())) is None
    assert thinks.refuses(config.Options(reasoning_effort="low")) == "takes a thinking budget, no reasoning effort"
    assert config.Profile("b", "openai_chat").refuses(config.Options(), images=True) == "no vision"
    with pytest.raises(config.ConfigError):
        config.Profile("b", "openai_chat").key({})
    assert config.Profile("c", "openai_compatible_chat", base_url="http://localhost:1/v").key({}) is None
    assert config.Profile("d", "openai_chat", api_key_env="K").key({"K": "s"}) == "s"


def test_runs(spark, tmp_path):
    made = config.make_config(tree(project={"cache_dir": str(tmp_path)}))
    source = spark.createDataFrame([("t.mp4", "h", "video")], "path string, input_hash string, kind string")
    context = runner.make_context(spark, made, source, multimodal=True)
    assert context.mode == "multimodal" and runner.make_context(spark, made, source).mode == "audio_only"
    seen = []
    note = lambda name: runner.Stage(name, lambda c: seen.append(name))
    runner.run_all(context, [note("a"), note("b")], [note("v")], [note("m")])
    assert seen[-1] == "m" and set(seen) == {"a", "b", "v", "m"} and seen.index("a") < seen.index("b")
    with pytest.raises(runner.StageError, match="segments.json is not there") as e:
        runner.run_stage(runner.Stage("read", lambda c: c.artifacts.table("segments_json")), context)
    assert e.value.kind == "Cache"
    code, failures = runner.run_batch([("one", lambda: None), ("two", lambda: 1 / 0), ("three", lambda: runner.run_stage(runner.Stage("s", lambda c: (_ for _ in ()).throw(media.MediaError("x"))), context))])
    assert code == 1 and [(f[0], f[1], f[2]) for f in failures] == [("two", "", "ZeroDivisionError"), ("three", "s", "Media")]
    with runner.one_writer(spark, f"file://{tmp_path}/run"):
        with pytest.raises(runner.Busy):
            with runner.one_writer(spark, f"file://{tmp_path}/run"):
                pass
    with runner.one_writer(spark, f"file://{tmp_path}/run"):
        pass


def test_artifacts_are_typed(spark, tmp_path):
    rows = spark.createDataFrame([("r", 0, 0, 0.0, 1.0, "h", "b")], "recording_id string, seq int, id int, start double, stop double, topic_hint string, boundary_reason string")
    rows.coalesce(1).write.json(f"file://{tmp_path}/segments.json")
    held = catalog.Catalog(spark, f"file://{tmp_path}")
    assert held.table("segments_json").collect() == rows.collect() and not held.audio_complete()
    rows.withColumn("extra", F.lit(1)).write.json(f"file://{tmp_path}/outline.json")
    with pytest.raises(Exception, match="unknown_field"):
        held.table("outline_json").collect()


# ---------------------------------------------------------------- sinks, media, command line


def test_sinks(spark, tmp_path):
    at = f"file://{tmp_path}"
    notes = spark.createDataFrame([("r", "# T\n\nx\n"), ("q", "# U\n")], "recording_id string, text string")
    sinks.write_notes(notes, f"{at}/notes", stamp="20260101-000000")
    assert {(r.recording_id, r.text) for r in sinks.cached_notes(spark, f"{at}/notes").collect()} == {("r", "# T\n\nx\n"), ("q", "# U\n")}
    sinks.write_notes(sinks.cached_notes(spark, f"{at}/notes"), f"{at}/again", from_cache=True)
    assert sorted(p.read_text() for p in tmp_path.glob("again/latest/*/part-*.txt")) == ["# T\n\nx\n", "# U\n"] and not (tmp_path / "again/cache").exists()
    frames = spark.createDataFrame([("r", 7, 2.0), ("r", 3, 1.0), ("q", 1, 0.0)], "recording_id string, frame_id int, ts double")
    sinks.write_frames(frames, f"{at}/frames")
    sinks.write_frames(frames.where("recording_id = 'r' and ts > 1"), f"{at}/frames")
    assert sorted((r.recording_id, r.frame_id, r.ts, r.image_path) for r in spark.read.parquet(f"{at}/frames").collect()) == [("q", 0, 0.0, "000001.png"), ("r", 0, 2.0, "000001.png")]
    made = sinks.write_sections(spark.createDataFrame([("r", 1, "one"), ("r", 2, "two")], "recording_id string, chapter_id int, text string"), f"{at}/sections")
    assert sorted(r.stage_name for r in made.collect()) == ["section_1", "section_2"]
    sinks.append_progress(spark.createDataFrame([("r", 1, 4)], "recording_id string, done int, total int"), f"{at}/progress", stage="refine")
    sinks.append_failures(spark.createDataFrame([("r", "outline", 1, "Model", "gap")], "recording_id string, stage_name string, attempt int, error_class string, message string"), f"{at}/failures")
    assert spark.read.parquet(f"{at}/progress").first().stage_name == "refine" and spark.read.parquet(f"{at}/failures").first().message == "gap"
    sinks.write_segments(spark.createDataFrame([("r", 0, "c"), ("r", 1, "d")], "recording_id string, id int, cleaned_text string"), f"{at}/refined")
    assert spark.read.json(f"{at}/refined").where("id = 1").first().cleaned_text == "d"


def test_media_tools(tmp_path):
    write = lambda text: lambda target: [sys.executable, "-c", f"open({target!r}, 'w').write({text!r})"]
    media.make_file(str(tmp_path / "a" / "x.wav"), write("sound"))
    assert (tmp_path / "a" / "x.wav").read_text() == "sound"
    with pytest.raises(media.MediaError, match="empty"):
        media.make_file(str(tmp_path / "a" / "x.wav"), write(""))
    assert (tmp_path / "a" / "x.wav").read_text() == "sound" and len(list((tmp_path / "a").iterdir())) == 1
    with pytest.raises(media.MediaError, match="failed"):
        media.run_tool([sys.executable, "-c", "raise SystemExit('no')"])
    with pytest.raises(media.MediaError, match="can't be run"):
        media.run_tool([str(tmp_path / "nothing")])
    assert media.wav_command("i", "o", sample_rate=16000, channels=1)[-1] == "o" and "150" in media.trim_command("i", "o", minutes=2.5)


def test_inputs_and_tidying(spark, tmp_path, capsys):
    from intervale.__main__ import main

    for name in ("w/a.mp4", "w/b.mp3", "w/n.md", "w/n-20250101-000000.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    assert sorted((r.path, r.kind) for r in files.resolve_inputs(spark, f"file://{tmp_path}").collect()) == [("w/a.mp4", "video"), ("w/b.mp3", "audio")]
    assert files.resolve_inputs(spark, f"file://{tmp_path}/w/b.mp3").first().kind == "audio"
    with pytest.raises(ValueError, match="no such input"):
        files.resolve_inputs(spark, f"file://{tmp_path}/none")
    (tmp_path / "e").mkdir()
    with pytest.raises(ValueError, match="no media"):
        files.resolve_inputs(spark, f"file://{tmp_path}/e")
    assert main(["tidy", str(tmp_path), "--apply"], spark) == 0 and "1 moved" in capsys.readouterr().out
    assert (tmp_path / "_archive/w/n-20250101-000000.md").read_text() == "w/n-20250101-000000.md"
    (tmp_path / "w/n-20250101-000000.md").write_text("again")
    assert main(["tidy", str(tmp_path)], spark) == 1
    assert main(["inspect", f"file://{tmp_path}/w"], spark) == 0 and "n.md\ttext" in capsys.readouterr().out


def test_paths(spark):
    from intervale.functions import text as fn

    cases = [("a/b/c", "a/d", "../b/c"), ("x", "a/b", "../../x"), ("a/b/c", "a/b", "c"), ("/r/a", "/r/b/c", "../../a")]
    rows = spark.createDataFrame(cases, "t string, f string, want string").select(fn.relative_path(F.col("t"), F.col("f")).alias("got"), "want").collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    with pytest.raises(Exception, match="image path must stay"):
        spark.range(1).select(fn.asset_path(F.lit("n.md"), F.lit("../x.png"))).collect()


def test_align_does_not_depend_on_blocks(spark, monkeypatch):
    from intervale.operators import intervals

    rng = random.Random(11)
    segments = [("r", i, i, s, s + rng.randrange(1, 9)) for i, s in enumerate(rng.sample(range(400), 30))]
    frames = [("r", i, rng.randrange(-20, 430)) for i in range(150)]
    f = spark.createDataFrame(frames, "recording_id string, frame_id long, ts long")
    s = spark.createDataFrame(segments, "recording_id string, segment_id long, seq long, start long, stop long")
    want = {}
    for _, i, t in frames:
        gap = lambda x: (0, -1) if x[3] <= t < x[4] else (1, x[3] - t if t < x[3] else t - x[4])  # noqa: B023, E731
        best = min(segments, key=lambda x: (*(gap(x) if gap(x)[0] else (0, 0)), x[2]))
        want[i] = (best[1], gap(best)[0] == 0 or gap(best)[1] <= 5)
    for block in (1, 64):
        monkeypatch.setattr(intervals, "BLOCK", block)
        got = {r.frame_id: (r.segment_id, r.has_audio_context) for r in intervals.align(f, s, max_gap=5, width=7).collect()}
        assert got == want


def test_before_is_the_next_double(spark):
    values = [2.0**k * m for k in range(-8, 20) for m in (1, 1.5, 1 + 2**-52, 2 - 2**-52)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", selection._before(F.col("v")).alias("b")).collect()
    assert all(r.b == math.nextafter(r.v, 0) for r in got)
