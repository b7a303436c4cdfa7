"""Selection, order, rules, text, admission, memo and files."""

import math
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from intervale.functions import text as fn
from intervale.operators import admission, memo, selection, sequence, validate
from intervale.plans import clients, config, notes
from intervale.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_greedy_dedupe(spark):
    def kept(items, threshold):
        frame = spark.createDataFrame([("r", i, i, s, f) for i, (s, f) in enumerate(items)], "recording_id string, seq long, item_id long, score double, feature array<double>")
        return sorted(r.item_id for r in selection.greedy_dedupe(frame, threshold=threshold).collect())

    assert kept([(0.6, [0.0]), (0.6, [0.0])], 0.1) == [0]
    assert kept([(0.6, [0.0]), (0.7, [1.0]), (0.8, [0.0])], 0.1) == [1, 2]
    assert kept([(0.1, [0.0]), (0.2, [0.5]), (0.9, [0.25])], 0.3) == [2]  # one replaces two


def test_content_filter_falls_back(spark):
    frame = spark.createDataFrame([("a", 0, 0.3), ("a", 1, 0.6), ("b", 0, 0.2), ("b", 1, 0.4), ("b", 2, 0.4)], "recording_id string, frame_id long, score double")
    assert sorted((r.recording_id, r.frame_id) for r in selection.content_filter(frame, least=0.5).collect()) == [("a", 1), ("b", 1)]


def test_scene_threshold(spark):
    counts = spark.createDataFrame([("r", 10.0, 20), ("r", 27.0, 9), ("r", 40.0, 3), ("q", 25.0, 15), ("q", 27.0, 15)], "recording_id string, threshold double, scenes long")
    lengths = spark.createDataFrame([("r", 570.0), ("q", 600.0)], "recording_id string, duration double")
    assert {r.recording_id: r.threshold for r in selection.scene_threshold(counts, lengths, per_minute=1.2).collect()} == {"r": 27.0, "q": 27.0}


def test_clamp_scenes_default(spark):
    scenes = spark.createDataFrame([("r", 10.0, -5.0, 3.0), ("r", 27.0, 70.0, 80.0)], "recording_id string, threshold double, start double, stop double")
    lengths = spark.createDataFrame([("r", 60.0)], "recording_id string, duration double")
    assert sorted(tuple(r)[1:] for r in selection.clamp_scenes(scenes, lengths).collect()) == [(10.0, 0.0, 3.0), (27.0, 0.0, 60.0)]


def test_candidate_times(spark):
    import math

    windows = spark.createDataFrame([("r", 0, 0.0, 2.0), ("r", 1, 1.0, 1.0000001)], "recording_id string, window_id long, start double, stop double")
    got = {r.window_id: r.times for r in selection.candidate_times(windows, fps=1.0).collect()}
    assert got[0] == [0.0, 1.0, math.nextafter(2.0, 0)]
    assert got[1][0] == 1.0 and all(t < 1.0000001 for t in got[1])
    for value in (0.1, 1.0, 2.0, 3.3, 1234.5678):
        assert one(spark, selection._before(F.lit(value))) == math.nextafter(value, 0)


def test_representative(spark):
    schema = "recording_id string, frame_id long, is_meaningful boolean, semantic_key string, quality_score int, visible_text string, sharpness double"
    def best(*rows):
        frame = spark.createDataFrame([("r", *x) for x in rows], schema)
        return sorted(r.frame_id for r in selection.representatives(frame).collect())

    assert best((1, True, "k", 3, "", 0.0), (2, True, " k ", 5, "", 0.0)) == [2]
    assert best((1, True, "k", 4, "AI", 0.0), (2, True, "k", 4, "AI Safety", 0.0)) == [2]
    assert best((1, True, "k", 4, "AI", 0.5), (2, True, "k", 4, "A I", 0.5)) == [1]
    assert best((1, True, "a", 4, "", 0.0), (2, True, "b", 4, "", 0.0), (3, False, "c", 4, "", 0.0)) == [1, 2]


@pytest.mark.parametrize(
    ("chapters", "n", "rule"),
    [([(1, 0, 1), (2, 2, 4)], 5, None), ([(0, 0, 1)], 2, "id"), ([(1, 0, 1), (2, 3, 2), (3, 3, 4)], 5, "id"), ([(1, 1, 2)], 3, "coverage"), ([(1, 0, 1)], 3, "coverage"), ([(1, 0, 1), (2, 3, 4)], 5, "contiguity"), ([(1, 0, 2), (2, 2, 4)], 5, "contiguity")],
)
def test_outline(spark, chapters, n, rule):
    rows = spark.createDataFrame([("r", i, *c) for i, c in enumerate(chapters)], "recording_id string, seq long, id long, block_id_start long, block_id_end long")
    found = validate.outline_violations(rows, spark.createDataFrame([("r", n)], "recording_id string, n long")).collect()
    assert [r.rule for r in found] == ([] if rule is None else [rule])


def test_assert_valid(spark):
    with pytest.raises(validate.InvalidRows):
        validate.assert_valid(spark.createDataFrame([("r", "id")], "recording_id string, rule string"))
    validate.assert_valid(spark.createDataFrame([], "recording_id string, rule string"))


def test_sequence(spark):
    rows = spark.createDataFrame([("r", i, i != 2) for i in range(5)], "recording_id string, seq long, is_valid boolean")
    assert sorted(r.seq for r in sequence.valid_prefix(rows).collect()) == [0, 1]
    assert [r.batch for r in sequence.batches(rows, size=2).orderBy("seq").collect()] == [0, 0, 1, 1, 2]
    assert [r.new_id for r in sequence.renumber(rows, "is_valid").orderBy("seq").collect()] == [0, 1, 2, 3]


def test_times_and_marks(spark):
    assert one(spark, fn.hms(F.lit(360_061.2))) == "100:01:01"
    assert one(spark, fn.mmss(F.lit(6000.9))) == "100:00"
    assert one(spark, fn.render_time(F.lit(59.9996), "<{mmss}|{seconds}|{seconds_int}>")) == "<01:00|60.000|60>"
    assert one(spark, fn.parse_time_mark(F.lit("[[TS:7.00049]]"))) == 7.0
    for bad in ("[[TS:1-2]]", "[[TS:1]] ", "[[ts:1]]", "x[[TS:1]]", "[[TS:.5]]"):
        with pytest.raises(Exception, match="not a time mark"):
            one(spark, fn.parse_time_mark(F.lit(bad)))
    assert one(spark, fn.render_time_marks(F.lit("é [[TS:3600-3700.5]][[TS:0]] z"))) == "é [01:00:00][00:00:00] z"
    assert one(spark, fn.render_time_marks(F.lit("no mark"))) == "no mark"
    assert one(spark, fn.render_time_marks(F.lit("[[TS:59.9996]]"), "[{hms}]", "v?{seconds_int}")) == "[[00:01:00]](v?59)"
    anchors = F.create_map(F.lit(4).cast("long"), F.lit("c-4"), F.lit(6).cast("long"), F.lit("c-6"))
    assert one(spark, fn.render_ref_marks(F.lit("a[[REF:6]]b[[REF:5]]"), anchors)) == "a[§7](#c-6)b§6"


def test_rounding_is_that_of_the_exact_value(spark):
    rng = random.Random(3)
    values = [k / 2000 for k in range(-50, 4000)] + [rng.uniform(-1e5, 1e5) for _ in range(2000)] + [0.0005, 2.6755, 1e18, -1e18, 5e-324, float("inf")]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", fn.round3(F.col("x")).alias("y")).collect()
    assert all(r.y == round(r.x, 3) for r in got)
    odd = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(fn.round3(F.col("x")).alias("y")).collect()
    assert odd[0].y is None and math.isnan(odd[1].y)


def test_slugs_and_headings(spark):
    assert one(spark, fn.output_stem(F.lit("in/a.b/ Ｔalk | 2; {x} .webm"))) == "Talk-2-x"
    assert one(spark, fn.output_stem(F.lit("*/..mp3"))) == "note"
    assert one(spark, fn.chapter_anchor(F.lit(12), F.lit("\u3000Ｅnde (gut)?"))) == "chapter-12-ende-gut"
    assert one(spark, fn.chapter_anchor(F.lit(1), F.lit("!!"))) == "chapter-1"
    for text in ("# Über uns\ny", "## 7 Über uns  \n\n y", "#### Über uns\ny", " \n\t\n# Über uns\ny"):
        assert one(spark, fn.strip_heading(F.lit(text), F.lit("Über uns"))).strip() == "y"
    for text in ("#### 7 Über uns\ny", "##### Über uns\ny", "#Über uns\ny", "Über uns\ny"):
        assert one(spark, fn.strip_heading(F.lit(text), F.lit("Über uns"))) == text
    assert one(spark, fn.strip_heading(F.lit(" \n\n"), F.lit("T"))) == ""


#: Worked out by hand from the rules.
SPACING = [
    ("", ""), ("one\n\n two ?", "one\n\n two?"), ("x ， y", "x， y"), ("tail \t\u3000", "tail"),
    # a lone time goes to the front, and no further
    ("[10:20:30]x;  ", "[10:20:30] x;"), ("end![10:20:30]", "[10:20:30] end!"), ("  [10:20:30]  ", "[10:20:30]"), ("x [10:20:30] ; y", "[10:20:30] x ; y".replace(" ;", ";")),
    ("see [10:20:30](u?t=1) there", "[10:20:30](u?t=1) see  there"),
    # of several, each stays; punctuation comes before a time, and a space after it
    ("a [10:20:30] b [11:20:30]c", "a [10:20:30] b [11:20:30] c"), ("a [10:20:30] , b [11:20:30]", "a,[10:20:30] b [11:20:30]"), ("a [10:20:30](l) b [11:20:30](m) . c", "a [10:20:30](l) b.[11:20:30](m) c"),
    # headings keep all but their end
    ("  ### [10:20:30]x .\t", "  ### [10:20:30]x ."), ("#a ,", "#a ,"),
    # a label of a link that is broken is no time
    ("a [10:20:30](b", "a [10:20:30](b"),
    # every kind of line end
    ("a ,\rb ,\r\nc ,\x0bd ,\x0ce ,\x1cf ,\x1dg ,\x1eh ,\x85i ,\u2028j ,\u2029k", "a,\nb,\nc,\nd,\ne,\nf,\ng,\nh,\ni,\nj,\nk"), ("a\r\n", "a"), ("a\n\n", "a\n"), ("\n", ""),
]


def test_spacing(spark):
    rows = spark.createDataFrame(list(enumerate(t for t, _ in SPACING)), "i int, t string").select("i", fn.normalise_spacing(F.col("t")).alias("got")).collect()
    for r in rows:
        assert r.got == SPACING[r.i][1], SPACING[r.i]


def test_notes_work_out_each_step_once(spark):
    """Steps don't repeat their inputs in the plan."""
    from intervale.plans.every import queries

    plan = queries()["assembled_notes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp") <= 40


@pytest.mark.parametrize(
    ("description", "visible", "evidence", "verdict"),
    [
        ("ein Balken", "42", ["axis"], None), ("--", "42", ["axis"], "content"), (None, "42", ["axis"], "content"), ("柱", "", ["\u3000", ""], "evidence"), ("柱", None, ["axis"], "visible_text"), ("柱", "Illegible", ["axis"], None),
        ("as the AUDIO context has it", "42", [], "audio"),
    ],
)
def test_descriptions(spark, description, visible, evidence, verdict):
    column = fn.description_verdict(F.lit(description).cast("string"), F.lit(visible).cast("string"), F.array(*map(F.lit, evidence)).cast("array<string>"), F.lit("table"), ("ppt", "chart", "table", "code"))
    assert one(spark, column) == verdict


def test_links_and_labels(spark):
    links = F.create_map(F.lit("a"), F.lit("1"), F.lit("a/b"), F.lit("2"))
    assert one(spark, fn.rewrite_links(F.lit("![x](a) ![y](a/b) a/b"), links)) == "![x](1) ![y](2) a/b"
    assert [one(spark, fn.trim_label(F.lit(m))) for m in (10.0, 2.5)] == ["10", "2.5"]
    assert [one(spark, fn.is_contained(F.lit(p))) for p in ("a/b", "/a", "a/../b", "..a")] == [True, False, False, True]
    assert one(spark, fn.fraction(F.lit("30000/1001"))) == 30000 / 1001 and one(spark, fn.fraction(F.lit("1/0"))) == 0.0
    assert one(spark, fn.fenced_json(F.lit('x ```json\n{"a":1}\n``` y'))) == '{"a":1}' and one(spark, fn.fenced_json(F.lit("{"))) is None
    assert one(spark, fn.is_local_endpoint(F.lit("http://localhost:8000/v1"))) and not one(spark, fn.is_local_endpoint(F.lit("https://x.org")))


def test_limiter():
    limiter = admission.Limiter(2, None, window=10)
    assert [limiter.admit(t, 1) for t in (0, 3, 4, 13.5)] == [0, 3, 10, 13.5]
    limiter = admission.Limiter(None, 9, window=10)
    assert [limiter.admit(0, 4), limiter.admit(1, 4), limiter.admit(2, 5)] == [0, 1, 10]
    assert admission.Limiter(None, 9).admit(7, 10) == 7  # more than the limit can ever give
    limiter = admission.Limiter(1, 9, window=10)
    assert [limiter.admit(0, 50), limiter.admit(1, 50)] == [0, 10]  # but not past the limit of requests


def test_a_gate_waits_before_every_attempt():
    now, asked = [0.0], []
    gate = clients.LocalGate(1, None, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))

    def call():
        asked.append(now[0])
        if len(asked) < 3:
            raise clients.RateLimitError
        return "ok"

    assert clients.with_retries(call, lambda s: now.__setitem__(0, now[0] + s), lambda: gate(1)) == "ok"
    assert asked == [0.0, 60.0, 120.0]


def test_schedule_matches_one_process(spark):
    log = [("a", i, float(i * 7 % 90), 1 + i % 5) for i in range(40)]
    got = admission.schedule(spark.createDataFrame(log, "profile string, seq long, t double, tokens long"), rpm=4, tpm=12).toPandas().sort_values(["t", "seq"])
    limiter, clock, want = admission.Limiter(4, 12), float("-inf"), []
    for _, _, t, n in sorted(log, key=lambda x: (x[2], x[1])):
        clock = limiter.admit(max(clock, t), n)
        want.append(clock)
    assert got.admitted.tolist() == want


def test_fallback_goes_on_with_what_is_left(spark):
    rows = spark.createDataFrame([(i,) for i in range(6)], "id long")
    even = lambda r: r.withColumn("is_valid", F.col("id") % 2 == 0)
    low = lambda r: r.withColumn("is_valid", F.col("id") < 4)
    accepted, left = memo.fallback(rows, [even, low], ["id"])
    assert sorted(r.id for r in accepted.collect()) == [0, 1, 2, 3, 4] and [r.id for r in left.collect()] == [5]


def test_listing_and_tidy(spark):
    def listing(*paths, folders=()):
        return spark.createDataFrame([(p, False, False) for p in paths] + [(p, True, False) for p in folders], "path string, is_dir boolean, is_symlink boolean")

    found = files.media_listing(listing("x/one.OGG", "x/one.head-2.5m.ogg", "x/two.head-.5.mp4", "x/three.header-1.mov", "x/readme.md", "x/.cache/four.mp4", ".five.mp4"))
    assert sorted((r.path, r.kind, r.folder) for r in found.collect()) == [("x/one.OGG", "audio", "x"), ("x/three.header-1.mov", "video", "x")]
    plan = files.tidy_plan(listing("n/p.md", "n/p-19991231-235959.md", "n/q-19991231-235959.md", "n/p-19991231-2359.md", folders=("n/p-19991231-235959_assets",)))
    assert sorted((r.path, r.target, r.conflict) for r in plan.collect()) == [
        ("n/p-19991231-235959.md", "_archive/n/p-19991231-235959.md", None), ("n/p-19991231-235959_assets", "_archive/n/p-19991231-235959_assets", None)
    ]
    linked = spark.createDataFrame([("p.md", False, False), ("p-19991231-235959.md", False, False), ("p-19991231-235959_assets", True, True)], "path string, is_dir boolean, is_symlink boolean")
    assert sorted((r.path, r.conflict) for r in files.tidy_plan(linked).collect()) == [("p-19991231-235959.md", None), ("p-19991231-235959_assets", "assets_not_folder")]
    blocked = files.tidy_plan(listing("d/l.md", "d/l-20260513-123456.md", "_archive/d/l-20260513-123456.md"))
    assert [r.conflict for r in blocked.collect()] == ["target_exists"]


def test_strict_json(spark):
    from pyspark.sql import types as T

    rows = spark.createDataFrame([('{"a":1,"b":"x"}',), ('{"a":1}',), ('{"a":1,"b":"x","c":2}',), ('{"a":"1","b":"x"}',), ("{",)], "value string")
    got = [r.error for r in files.strict_json(rows, "value", T.StructType.fromDDL("a int, b string")).collect()]
    assert got == [None, "missing_field", "unknown_field", "bad_value", "not_json"]
    deep = T.StructType.fromDDL("n double, xs array<struct<w: string, p: double>>, m map<string, boolean>")
    cases = [
        ('{"n":1,"xs":[{"w":"a","p":0.5}],"m":{"k":true}}', None), ('{"n":null,"xs":[],"m":null}', None), ('{"n":1e3,"xs":[null,{"w":null,"p":1}],"m":{}}', None), ('{"n":1,"xs":[{"w":"a","p":0.5,"q":1}],"m":{}}', "unknown_field"),
        ('{"n":1,"xs":[{"w":"a"}],"m":{}}', "missing_field"), ('{"n":true,"xs":[],"m":{}}', "bad_value"), ('{"n":1,"xs":{},"m":{}}', "bad_value"), ('{"n":1,"xs":[{"w":1,"p":1}],"m":{}}', "bad_value"), ('{"n":1,"xs":[],"m":{"k":"true"}}', "bad_value"), ("[]", "not_json"),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, value string")
    got = files.strict_json(rows, "value", deep).orderBy("i").collect()
    assert [r.error for r in got] == [e for _, e in cases]
    assert [r.record is None for r in got] == [e is not None for _, e in cases] and got[0].record.xs[0].p == 0.5


def test_retries_only_rate_limits():
    waits, calls = [], []

    def limited():
        calls.append(1)
        if len(calls) < 3:
            raise clients.RateLimitError
        return "ok"

    assert clients.with_retries(limited, waits.append) == "ok" and waits == [5, 10]
    with pytest.raises(clients.TransportError):
        clients.with_retries(lambda: (_ for _ in ()).throw(clients.TransportError()), waits.append)
    assert isinstance(clients.status_error(429), clients.RateLimitError) and isinstance(clients.status_error(503), clients.TransportError)


def test_complete_rows_keeps_failures_as_rows(spark):
    out = clients.complete_rows(spark.createDataFrame([("r", "hello")], "recording_id string, prompt string"), clients.EchoClient).first()
    assert out.answer == "hello" and out.error_class is None


def test_assemble(spark):
    recordings = spark.createDataFrame([("r", "in/Ein Tag.mp4", None, 61.0, "audio_only", "then")], "recording_id string, source_path string, title string, duration double, mode string, generated_at string")
    chapters = spark.createDataFrame([("r", 1, 0, "Früh", 0, 0), ("r", 2, 1, "Spät", 1, 2)], "recording_id string, chapter_id long, seq long, title string, block_id_start long, block_id_end long")
    sections = spark.createDataFrame([("r", 1, "## 1 Früh\n\n[[TS:1.5]]auf ."), ("r", 2, "ab [[TS:62.0]] [[REF:0]] [[REF:9]]\n\n")], "recording_id string, chapter_id long, text string")
    profiles = {t: f"p{i}" for i, t in enumerate(config.TASKS)}
    text = notes.assemble(recordings, chapters, sections, profiles=profiles).first().text
    assert text == (
        "---\nsource_path: in/Ein Tag.mp4\nduration: 00:01:01\ngenerated_at: then\nmode: audio_only\nllm_profiles:\n  segment: p0\n  refine: p1\n  outline: p2\n  section: p3\n  slide_judge: null\n  slide_describe: null\n---\n\n"
        "# Ein Tag\n\n- [Früh](#chapter-1-früh)\n- [Spät](#chapter-2-spät)\n\n"
        '<a id="chapter-1-früh"></a>\n## Früh\n[00:00:01] auf.\n\n<a id="chapter-2-spät"></a>\n## Spät\n[00:01:02] ab  [§1](#chapter-1-früh) §10\n'
    )
    bare = notes.assemble(recordings, chapters, sections, profiles=profiles, with_contents=False, with_metadata=False).first().text
    assert bare.startswith("# Ein Tag\n\n<a id=")
    with pytest.raises(Exception, match="no section for r, 2"):
        notes.assemble(recordings, chapters, sections.where("chapter_id = 1"), profiles=profiles).collect()


def test_unify_modes(spark):
    refined = spark.createDataFrame([("r", 0, 0, 0.0, 10.0, "t", "c", "s", [])], "recording_id string, seq int, id int, start double, stop double, topic string, cleaned_text string, summary string, cross_refs array<int>")
    seen = spark.createDataFrame([("r", 0, 0, 1, 2.0, 12.0, "p.png", "ppt", "d", "v", ["e"])], "recording_id string, seq int, segment_id int, frame_id int, start double, stop double, image_path string, medium string, description string, visible_text string, visible_evidence array<string>")
    both = notes.unify(refined, seen, mode="multimodal", width=5.0).first()
    assert [(v.start, v.stop, v.image_path) for v in both.visuals] == [(2.0, 10.0, "p.png")]
    assert notes.unify(refined, seen, mode="audio_only", width=5.0).first().visuals == []


def test_hash_is_independent_of_key_order(spark):
    assert files.canonical_json({"b": 1, "a": {3, 1}}) == files.canonical_json({"a": {1, 3}, "b": 1}) == '{"a":[1,3],"b":1}'
    a = one(spark, memo.cache_key("s", {"x": F.lit("1"), "y": F.lit("2")}))
    assert a == one(spark, memo.cache_key("s", {"y": F.lit("2"), "x": F.lit("1")}))


def test_streams(spark, tmp_path):
    from intervale.streaming import events

    requests = pd.DataFrame({"profile": ["a"] * 3, "seq": [0, 1, 2], "t": [0.0, 0.0, 1.0], "tokens": [1, 1, 1]})
    spark.createDataFrame(requests).write.parquet(str(tmp_path / "in"))
    schema = "profile string, seq long, t double, tokens long"
    stream = events.admission_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), rpm=1, tpm=None)
    q = stream.writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.seq, r.admitted) for r in spark.table("admitted").collect()) == [(0, 0.0), (1, 60.0), (2, 120.0)]
    frames = spark.createDataFrame([("r", 1, 5), ("r", 2, 50)], "recording_id string, frame_id long, ts long")
    frames.write.parquet(str(tmp_path / "f"))
    segments = spark.createDataFrame([("r", 0, 0, 10)], "recording_id string, segment_id long, start long, stop long")
    q = events.align_stream(spark.readStream.schema(frames.schema).parquet(str(tmp_path / "f")), segments, width=4).writeStream.format("memory").queryName("aligned").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.frame_id, r.segment_id) for r in spark.table("aligned").collect()] == [(1, 0)]
