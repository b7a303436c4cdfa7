"""Operators that spread what used to be one group, or one row's many buckets."""

import random

import pytest
from pyspark.sql import functions as F

from intervale.operators import admission, graphs, selection
from intervale.operators import intervals as iv
from intervale.operators.admission import Limiter
from intervale.settling import settle

# ---------------------------------------------------------------- intervals of any length


def spans(spark, data, prefix=""):
    return spark.createDataFrame(data, f"recording_id string, {prefix or 'l'}_id long, {'start' if not prefix else prefix + '_start'} double, {'stop' if not prefix else prefix + '_stop'} double")


def unequal(rng, n, recordings="ab"):
    out = []
    for i in range(n):
        start = rng.choice([rng.uniform(-500, 500), float(rng.randrange(-64, 64))])
        out.append((rng.choice(recordings), i, start, start + rng.choice([0.0, 0.5, 1.0, 2.0, rng.uniform(0, 3), rng.uniform(0, 100), 1000.0, -1.0])))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_levels_meet_each_pair_once(spark, seed):
    rng = random.Random(seed)
    left, right = unequal(rng, 120), unequal(rng, 120)
    got = iv.meet(spans(spark, left), spans(spark, right, "r"), iv.Levels(0.7)).where("start <= r_stop and r_start <= stop").select("l_id", "r_id").collect()
    want = [(a[1], b[1]) for a in left for b in right if a[0] == b[0] and a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and b[2] <= a[3]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_levels_deal_few_buckets(spark):
    """An interval of ten hours beside ones of ten seconds: two buckets a level, not 3,600."""
    rng = random.Random(4)
    data = [("a", i, (s := rng.uniform(0, 36000)), s + 10) for i in range(500)] + [("a", 1000 + i, 0.0, 36000.0) for i in range(3)]
    width = iv.Levels(10.0)
    levels = F.array(F.lit(0), F.lit(12))
    for is_left in (True, False):
        dealt = iv._dealt_by_levels(spans(spark, data), ("start", "stop"), is_left, levels, width).groupBy("l_id").count()
        assert dealt.agg(F.max("count")).first()[0] <= 4
    assert spans(spark, data).select(F.explode(iv._buckets(F.col("start"), F.col("stop"), 10.0))).count() > 10_000
    pairs = iv.meet(spans(spark, data), spans(spark, data, "r"), width)
    assert pairs.where("l_id >= 1000 and r_id >= 1000").count() == 9


def test_operators_take_levels(spark):
    """The same rows as with buckets of one width."""
    rng = random.Random(5)
    blocks = spark.createDataFrame([(r, i, int(a * 10), int(b * 10)) for r, i, a, b in unequal(rng, 60)], "recording_id string, block_id long, start long, stop long")
    visuals = spark.createDataFrame([(r, i, int(a * 10), int(b * 10)) for r, i, a, b in unequal(rng, 60)], "recording_id string, ord long, v_start long, v_stop long")
    rows = lambda frame: sorted(map(str, frame.collect()))
    assert rows(iv.overlap_slots(blocks, visuals, width=iv.Levels(3))) == rows(iv.overlap_slots(blocks, visuals, width=50))
    words = visuals.select("recording_id", F.lit(1).alias("segment_id"), F.col("ord").alias("word_pos"), F.lit("w").alias("word"), F.col("v_start").alias("start"), F.col("v_stop").alias("stop")).where("start <= stop")
    markers = blocks.where("start < stop and stop - start < 500")
    assert rows(iv.uncovered_words(words, markers, width=iv.Levels(3))) == rows(iv.uncovered_words(words, markers, width=50))
    windows, lines = blocks.withColumnRenamed("block_id", "window_id"), words.select("recording_id", F.col("word_pos").alias("seq"), "start", "stop", F.concat(F.lit("t"), "word_pos").alias("text"))
    for strict in (False, True):
        assert rows(iv.text_at(windows, lines, width=iv.Levels(3), strict=strict)) == rows(iv.text_at(windows, lines, width=50, strict=strict))
    points = words.select("recording_id", F.col("word_pos").alias("point_id"), F.col("start").alias("ts"))
    segments = blocks.select("recording_id", F.col("block_id").alias("segment_id"), F.col("block_id").alias("seq"), "start", "stop")
    assert rows(iv.segment_at(points, segments, width=iv.Levels(3))) == rows(iv.segment_at(points, segments, width=50))
    frames = points.withColumnRenamed("point_id", "frame_id")
    assert rows(iv.align(frames, segments, max_gap=5, width=iv.Levels(3))) == rows(iv.align(frames, segments, max_gap=5, width=50))
    assert iv.meet(spans(spark, []), spans(spark, unequal(rng, 5), "r"), iv.Levels(1)).collect() == []


# ---------------------------------------------------------------- replays


def replayed(log, rpm, tpm, window):
    out, limiters, clocks = {}, {}, {}
    for profile, seq, t, tokens in sorted(log, key=lambda r: (r[0], r[2], r[1])):
        limiter = limiters.setdefault(profile, Limiter(rpm, tpm, window))
        clocks[profile] = limiter.admit(max(clocks.get(profile, float("-inf")), t), tokens)
        out[profile, seq] = clocks[profile]
    return out


@pytest.mark.parametrize(("rpm", "tpm"), [(3, None), (None, 50), (4, 60), (1, 10), (None, None)])
def test_pieces_replay_as_the_whole(spark, rpm, tpm):
    """Bursts, pauses, ties in time and requests over the limit."""
    rng = random.Random(7)
    log, seq = [], 0
    for profile in ("p", "q"):
        t = 0.0
        for _ in range(60):
            t += rng.choice([0.0, 1.0, 7.5, 30.0, 200.0, 2000.0])
            for _ in range(rng.choice([1, 1, 2, 12])):
                seq += 1
                log.append((profile, seq, t, rng.choice([0, 1, 5, 30, 49, 80])))
                t += rng.choice([0.0, 0.25])
    requests = spark.createDataFrame(log, "profile string, seq long, t double, tokens long")
    got = {(r.profile, r.seq): r.admitted for r in admission.schedule(requests, rpm=rpm, tpm=tpm, window=10.0).collect()}
    assert got == replayed(log, rpm, tpm, 10.0)
    pieces = admission.idle_pieces(requests, rpm=rpm, tpm=tpm, window=10.0).select("profile", "piece").distinct().count()
    assert pieces > 10


def test_a_busy_log_is_cut_where_it_rests(spark):
    """One profile of bursts an hour apart is many pieces, one that never rests is one."""
    hours = spark.range(2000).select(F.lit("p").alias("profile"), F.col("id").alias("seq"), (F.floor(F.col("id") / 20) * 3600.0).alias("t"), F.lit(10).cast("long").alias("tokens"))
    assert admission.idle_pieces(hours, rpm=10, tpm=None).select("piece").distinct().count() == 100
    steady = hours.withColumn("t", F.col("seq") * 1.0)
    assert admission.idle_pieces(steady, rpm=10, tpm=None).select("piece").distinct().count() == 1
    assert admission.schedule(hours.limit(0), rpm=1, tpm=1).collect() == []


# ---------------------------------------------------------------- greedy removal

ITEMS = "recording_id string, seq long, item_id long, score double, feature array<double>"


def both_ways(spark, data, threshold, **more):
    items = spark.createDataFrame(data, ITEMS).repartition(3)
    rows = lambda frame: sorted(map(str, frame.collect()))
    return rows(selection.spread_greedy(items, threshold=threshold, settle=settle, **more)), rows(selection.greedy_dedupe(items, threshold=threshold))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_regions_fold_as_the_whole(spark, seed):
    """Clouds, chains, copies, ties of scores, several recordings."""
    rng = random.Random(seed)
    data, seq = [], 0
    for recording in ("a", "b", None):
        centres = [[rng.uniform(0, 4) for _ in range(5)] for _ in range(6)]
        for _ in range(70):
            seq += 1
            base = rng.choice(centres)
            drift = rng.choice([0.0, 0.05, 0.3, 1.0])
            data.append((recording, seq, seq, float(rng.randrange(6)), [x + rng.uniform(-drift, drift) for x in base]))
    for threshold in (0.05, 0.4, 2.0, 0.0):
        spread, whole = both_ways(spark, data, threshold, pivots=2)
        assert spread == whole and (threshold == 0.0 or len(spread) < len(data))


def test_odd_items_are_near_nothing(spark):
    nan, inf = float("nan"), float("inf")
    data = [("a", i, i, s, f) for i, (s, f) in enumerate([(1.0, [0.0, 0.0]), (2.0, None), (3.0, []), (None, [0.0, 0.01]), (nan, [0.0, 0.02]), (5.0, [nan, 0.0]), (6.0, [inf, 0.0]), (7.0, [inf, 0.0]), (8.0, [None, 0.0]), (0.0, [0.0, 0.0, 0.0]), (4.0, [0.0, 0.0])])]
    spread = {r.item_id for r in selection.spread_greedy(spark.createDataFrame(data, ITEMS), threshold=0.1, settle=settle).collect()}
    assert spread == {1, 2, 4, 5, 6, 7, 8, 9}  # the one whose score is NaN takes the place of the first, and keeps it
    assert selection.spread_greedy(spark.createDataFrame([], ITEMS), threshold=0.1, settle=settle).collect() == []


def test_one_large_group_is_many_regions(spark):
    """200,000 items of one recording, a third of them copies of one: many tasks, and no pair of copies is met twice."""
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0
    centre = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 3000)
    at = lambda k: F.pmod(F.xxhash64(centre, F.lit(k)), F.lit(1000)) * 1.0
    near = F.when(F.col("id") % 3 == 0, 0.0).otherwise(1.0)
    items = spark.range(0, 200_000, 1, 4).select(F.lit("r").alias("recording_id"), F.col("id").alias("seq"), F.col("id").alias("item_id"), h(9).alias("score"), F.array(*[at(k) + near * h(k) * 0.2 for k in range(4)]).alias("feature"))
    kept = selection.spread_greedy(items, threshold=0.5, settle=settle)
    assert kept.withColumn("c", F.when(F.col("item_id") % 3 == 0, 0).otherwise(F.col("item_id") % 3000)).groupBy("c").count().agg(F.count("*"), F.max("count")).first() == (2001, 1)
    best = items.where("item_id % 3 = 0").agg(F.max("score")).first()[0]
    assert kept.where("item_id % 3 = 0").first().score == best


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 30)] + [(200, 200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = graphs.components(spark.createDataFrame(edges, "a long, b long"), settle=settle).collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in list(parent))
    assert graphs.components(spark.createDataFrame([], "a long, b long"), settle=settle).collect() == []
