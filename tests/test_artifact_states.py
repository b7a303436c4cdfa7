"""Artifacts of many inputs against a listing."""

from intervale.sources import catalog


def states_plainly(inputs, files, cache):
    listed = set(files)
    return [(path, h, n, s, h is not None and f"{cache}/{h}/{p}" in listed) for path, h, _ in inputs for n, (p, s) in catalog.ARTIFACTS.items()]


def test_states_of_odd_listings(spark):
    """Repeated and foreign paths, hashes of several parts, names that end like an artifact's, inputs of one content and of none."""
    hashes = ["h", "h", "deep/er", "", "two\nlines", "refined", None]
    inputs = [(f"in/{i}.mp4", h, "") for i, h in enumerate(hashes)]
    tails = [p for p, _ in catalog.ARTIFACTS.values()]
    files = [f"c/{h}/{p}" for i, h in enumerate(hashes) if h is not None for p in tails[i::3]] * 2
    files += ["c/h/xnote.md", "c/h/audio/audio.wav/more", "c/h/audioXwav", "c/h/segments.json\n", "note.md", "/note.md", "d/h/debug", "c/h/refined/1.json", None]
    got = catalog.artifact_states(
        spark.createDataFrame(inputs, "path string, input_hash string, folder string"), spark.createDataFrame([(f,) for f in files], "path string"), cache="c", output="out"
    )
    assert got.columns == ["path", "input_hash", "artifact", "stage", "there"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, states_plainly(inputs, files, "c")))


def test_a_listing_is_not_broadcast(spark):
    """The planner takes what an explode makes for small, whatever it makes; gathered in the driver it fills its memory."""
    from intervale.plans.bindings import Tables
    from intervale.plans.catalogue_stages import artifact_completeness, artifact_states

    for run in (artifact_states, artifact_completeness):
        frame = run(Tables(spark, "/root/testdata/sf0.001"))
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
