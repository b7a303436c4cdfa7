"""Queries of model stages, caches, settings and artifacts over the driver's tables.

Models are scripts: what they answer follows from the number in the prompt, so
that SQL can tell the outcome.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervale.operators import admission, memo
from intervale.plans import bindings as b
from intervale.plans import clients, completion, config, envelopes, leases, refine
from intervale.plans.bindings import KEY, Tables
from intervale.plans.catalogue import query
from intervale.settling import fresh_folder, settle
from intervale.shipping import ship
from intervale.sources import catalog, connector

PROFILE = config.Profile("test", "openai_chat", capabilities=frozenset({"json_mode"}), max_context=400)
_number = re.compile(r"#(\d+)")


class JsonScript:
    """JSON of the number in a prompt: whole, fenced, wrong once, never right, or an error, by the number modulo 5."""

    def complete(self, prompt: str) -> str:
        n = int(_number.search(prompt).group(1))
        again = "Rejected answer" in prompt
        if n % 5 == 4:
            raise clients.TransportError("closed")
        if n % 5 == 3:
            return f"no idea about #{n}"
        if n % 5 == 2 and not again:
            return f'{{"n": "#{n}"}}'
        return f'{{"n": {n}}}' if n % 5 != 1 else f'here:\n```JSON\n{{"n": {n}}}\n```'


class OutlineScript:
    """Two chapters over the blocks in a prompt: right at once, after a repair, or never, by the number modulo 3."""

    def complete(self, prompt: str) -> str:
        n = int(_number.search(prompt).group(1))
        last = int(re.search(r"last (\d+)", prompt).group(1))
        gap = 2 if n % 3 == 2 or (n % 3 == 1 and "First request" not in prompt) else 1
        chapter = '{"id": %d, "title": "t", "summary": "s", "block_id_start": %d, "block_id_end": %d}'
        return f'{{"chapters": [{chapter % (1, 0, 0)}, {chapter % (2, gap, last)}]}}'


class DescribeScript:
    """A description that will do at the first, second, third or no attempt, by the number modulo 4."""

    def complete(self, prompt: str) -> str:
        n = int(_number.search(prompt).group(1))
        tried = 0 if "was refused" not in prompt else 1 if "refused: content" in prompt else 2
        if tried >= n % 4:
            return '{"visible_text": "seen", "visible_evidence": [" a ", ""], "description": "a chart"}'
        evidence = "[]" if tried else '["a"]'
        return f'{{"visible_text": "", "visible_evidence": {evidence}, "description": "{"a chart" if tried else "..."}"}}'


class JudgeScript:
    """A judgement of every frame in a prompt; none of the last one where the first is 3 modulo 5, a medium that isn't one where it is 4."""

    def complete(self, prompt: str) -> str:
        found = [int(x) for x in _number.findall(prompt)]
        kind = found[0] % 5
        one = '{"frame_id": %d, "medium": "%s", "is_meaningful": %s, "reason": "r", "semantic_key": %s, "quality_score": %s, "visible_text": "", "content_summary": "s"}'
        rows = [one % (n, "poster" if kind == 4 else "chart", *(("true", '"k"', "3") if n % 2 else ("false", "null", "null"))) for n in (found[:-1] if kind == 3 else found)]
        return '{"judgements": [' + ", ".join(rows) + "]}"


class RefineScript:
    """Every segment of a prompt, refined; one too few where several have one whose id is 3 modulo 7."""

    def complete(self, prompt: str) -> str:
        found = re.findall(r"<(\d+) (\S+) (\S+)>", prompt)
        if len(found) > 1 and any(int(i) % 7 == 3 for i, _, _ in found):
            found = found[:-1]
        one = '{"id": %s, "start": %s, "stop": %s, "topic": "t", "cleaned_text": "c", "summary": "s", "cross_refs": []}'
        return '{"segments": [' + ", ".join(one % x for x in found) + "]}"


class BusyScript:
    """Asks for patience as often as the number modulo 6 says, then answers."""

    def __init__(self):
        self.asked: dict[int, int] = {}

    def complete(self, prompt: str) -> str:
        n = int(_number.search(prompt).group(1))
        self.asked[n] = self.asked.get(n, 0) + 1
        if self.asked[n] <= n % 6:
            raise clients.RateLimitError("later")
        return f"{n} after {self.asked[n]}"


class Witness:
    """Tells what it was shown: every text, and every picture's media type and digest, in their order."""

    def complete_parts(self, parts: list[clients.Part]) -> str:
        return "\n".join(p.text if p.content is None else f"{p.mime} {hashlib.sha256(p.content).hexdigest()}" for p in parts)


def _numbered(rows: DataFrame, number: str, more: str = "") -> DataFrame:
    return rows.withColumn("prompt", F.concat(F.lit("about #"), F.col(number).cast("string"), F.lit(more)))


# ---------------------------------------------------------------- requests


@query("""
    SELECT doc_id, CASE WHEN size > 400 OR seen THEN NULL ELSE p END AS answer, CASE WHEN size > 400 THEN 'ContextLength' WHEN seen THEN 'Model' END AS error_class,
           CASE WHEN size > 400 THEN size || ' > 400' WHEN seen THEN 'no vision' END AS message
    FROM (SELECT doc_id, coalesce(text, '') AS p, (length(coalesce(text, '')) + 4) // 4 + CASE WHEN doc_id % 6 = 1 THEN 1024 ELSE 0 END + 20 AS size, doc_id % 6 = 1 AS seen FROM documents)
""")
def text_completions(t: Tables) -> DataFrame:
    """Every whole text as a prompt; every sixth one comes with a picture, which this model can't see."""
    ship(t.spark)
    rows = t.raw("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("prompt"))
    done = completion.complete_text(rows, clients.EchoClient, PROFILE, config.Options(max_output_tokens=20), images=F.when(F.col("doc_id") % 6 == 1, 1).otherwise(0))
    return done.select("doc_id", "answer", "error_class", "message")


#: Limits of a window of a quarter of a second.
LEASED_REQUESTS, LEASED_TOKENS, LEASED_WINDOW = 400, 200_000, 0.25


@query("SELECT conv_id AS recording_id, string_agg(text, chr(10) ORDER BY turn) AS answer, 0::BIGINT AS crowded FROM conversations GROUP BY conv_id")
def leased_requests(t: Tables) -> DataFrame:
    """A request a conversation, five at a time in each of four tasks under one limit of requests and tokens.

    ``crowded`` counts leases of the whole log that end a window with more than it may hold.
    """
    ship(t.spark)
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    rows = t.raw("conversations").groupBy(F.col("conv_id").alias(KEY)).agg(F.array_join(turns, "\n").alias("prompt")).withColumn("tokens", admission.token_estimate(F.length("prompt"), F.lit(0)))
    with leases.LeaseOffice(t.spark, {"shared": (LEASED_REQUESTS, LEASED_TOKENS)}, window=LEASED_WINDOW) as office:
        done = settle(clients.complete_rows(rows, clients.EchoClient, tokens="tokens", make_gate=office.desk("shared"), tasks=4, at_once=5, trace=True))
    log = admission.usage(leases.lease_log(done, "shared"), window_us=int(LEASED_WINDOW * leases.MICROS))
    over = (F.col("window_requests") > LEASED_REQUESTS) | ((F.col("window_tokens") > LEASED_TOKENS) & (F.col("tokens") <= LEASED_TOKENS))
    return done.select(KEY, "answer", log.agg(F.count_if(over)).scalar().alias("crowded"))


SHOWN, SHOWN_TOKENS = "Which pages are these?", 4_200


@query(f"""
    WITH f AS (SELECT page_id // 7 AS recording_id, page_id, html, 'page ' || page_id || ' of ' || coalesce(url, '') AS label FROM pages),
    c AS (SELECT *, length(label) // 4 + CASE WHEN html IS NULL THEN 0 ELSE 1024 END + 1 AS cost FROM f),
    p AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY recording_id ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                 greatest(1, {SHOWN_TOKENS} - ((length('{SHOWN}') + 4) // 4 + 1) - max(cost) OVER (PARTITION BY recording_id)) AS room FROM c)
    SELECT recording_id, (before // room)::BIGINT AS request, count(*) AS frames,
           '{SHOWN}' || chr(10) || string_agg(label || coalesce(chr(10) || 'text/html ' || sha256(html), ''), chr(10) ORDER BY page_id) AS answer, NULL::VARCHAR AS error_class
    FROM p GROUP BY 1, 2
""")
def picture_requests(t: Tables) -> DataFrame:
    """Pages as pictures, seven a recording, in requests of bounded size; answers tell the digests of what reached the model."""
    ship(t.spark)
    p = F.col("page_id")
    label = F.concat(F.lit("page "), p.cast("string"), F.lit(" of "), F.coalesce("url", F.lit("")))
    frames = t.raw("pages").select(F.floor(p / 7).alias(KEY), p.alias("frame_id"), (p * 90.0).alias("ts"), F.lit("text/html").alias("mime"), F.encode("html", "utf-8").alias("content"), label.alias("label"))
    made = envelopes.picture_envelopes(frames, prompt=F.lit(SHOWN), label=F.col("label"), most_tokens=SHOWN_TOKENS, block=200.0)
    seeing = config.Profile("seeing", "openai_chat", capabilities=frozenset({"vision"}), max_context=SHOWN_TOKENS)
    done = completion.complete_text(made.withColumn("prompt", F.lit("")), Witness, seeing, parts="parts")
    return done.select(KEY, "request", F.size("frame_ids").cast("long").alias("frames"), "answer", "error_class")


@query("""
    SELECT doc_id, CASE WHEN doc_id % 6 <= 3 THEN doc_id || ' after ' || (doc_id % 6 + 1) END AS answer, CASE WHEN doc_id % 6 > 3 THEN 'RateLimit' END AS error_class FROM documents
""")
def rate_limit_retries(t: Tables) -> DataFrame:
    ship(t.spark)
    rows = _numbered(t.raw("documents").select("doc_id"), "doc_id")
    return clients.complete_rows(rows, BusyScript, sleep=lambda seconds: None).select("doc_id", "answer", "error_class")


RECORD = "n bigint"


@query("""
    SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN doc_id END AS n, CASE WHEN doc_id % 5 IN (2, 3) THEN 2 ELSE 1 END AS attempt, CASE doc_id % 5 WHEN 3 THEN 'not_json' END AS reason, CASE doc_id % 5 WHEN 4 THEN 'Transport' END AS error_class FROM documents
    UNION ALL SELECT doc_id, NULL, 1, CASE doc_id % 5 WHEN 2 THEN 'bad_value' ELSE 'not_json' END, NULL FROM documents WHERE doc_id % 5 IN (2, 3)
""")
def json_repairs(t: Tables) -> DataFrame:
    ship(t.spark)
    good, bad = completion.complete_json(_numbered(t.raw("documents").select("doc_id"), "doc_id"), JsonScript, PROFILE, RECORD)
    shown = lambda x: x.select("doc_id", "record.n", "attempt", "reason", "error_class")
    return shown(good).unionByName(shown(bad))


OUTLINED = "SELECT c_custkey AS k, 3 + c_custkey % 5 AS n FROM customer"


def _outlines(t: Tables) -> tuple[DataFrame, DataFrame]:
    ship(t.spark)
    rows = t.raw("customer").select(F.col("c_custkey").alias(KEY), (3 + F.col("c_custkey") % 5).cast("long").alias("n_blocks"))
    asked = rows.withColumn("prompt", F.concat(F.lit("about #"), F.col(KEY).cast("string"), F.lit(" last "), (F.col("n_blocks") - 1).cast("string")))
    return completion.outlines(asked, OutlineScript, PROFILE)


@query(f"SELECT k AS recording_id, 2 AS chapters, n - 1 AS last_block, CASE WHEN k % 3 = 0 THEN 1 ELSE 2 END AS attempt FROM ({OUTLINED}) WHERE k % 3 < 2")
def outline_attempts(t: Tables) -> DataFrame:
    return _outlines(t)[0].select(KEY, F.size("chapters").alias("chapters"), F.element_at("chapters", -1)["block_id_end"].alias("last_block"), "attempt")


@query(f"""
    SELECT k AS recording_id, 'outline' AS stage_name, a AS attempt, 'Model' AS error_class, 'contiguity' AS message, CASE WHEN a = 1 THEN 'about #' || k || ' last ' || (n - 1) ELSE 'repair' END AS prompt
    FROM ({OUTLINED}), (SELECT unnest([1, 2]) AS a) WHERE k % 3 = 2 OR (k % 3 = 1 AND a = 1)
""")
def outline_failures(t: Tables) -> DataFrame:
    failed = _outlines(t)[1]
    return failed.select(KEY, "stage_name", "attempt", "error_class", "message", F.when(F.col("prompt").startswith(completion.OUTLINE_AGAIN), "repair").otherwise(F.col("prompt")).alias("prompt"))


@query("""
    SELECT doc_id AS frame_id, CASE WHEN doc_id % 4 < 3 THEN doc_id % 4 + 1 END AS attempt, CASE WHEN doc_id % 4 < 3 THEN 'a' END AS evidence FROM documents
""")
def describe_attempts(t: Tables) -> DataFrame:
    ship(t.spark)
    rows = _numbered(t.raw("documents").select(F.col("doc_id").alias("frame_id"), F.lit("ppt").alias("medium")), "frame_id")
    good, bad = completion.descriptions(rows, DescribeScript, PROFILE)
    left = bad.groupBy("frame_id").agg(F.count("*").alias("n")).join(good.select("frame_id"), "frame_id", "left_anti")
    return good.select("frame_id", "attempt", F.array_join("visible_evidence", "|").alias("evidence")).unionByName(left.select("frame_id"), allowMissingColumns=True)


@query(f"""
    WITH f AS (SELECT recording_id, frame_id, first_value(frame_id) OVER (PARTITION BY recording_id ORDER BY ts, frame_id) % 5 AS kind FROM ({b.FRAMES}))
    SELECT recording_id, frame_id, CASE WHEN frame_id % 2 = 1 THEN 'k' END AS semantic_key, NULL AS rule FROM f WHERE kind < 3
    UNION ALL SELECT DISTINCT recording_id, NULL, NULL, CASE WHEN kind = 3 THEN 'missing' ELSE 'medium' END FROM f WHERE kind >= 3
""")
def judged_recordings(t: Tables) -> DataFrame:
    ship(t.spark)
    wide = config.Profile("wide", "openai_chat", capabilities=frozenset({"json_mode"}))
    shown = lambda frames: F.array_join(F.transform(frames, lambda f: F.concat(F.lit("frame #"), f["frame_id"].cast("string"))), "\n")
    good, bad = completion.judgements(t.frames().select(KEY, "frame_id", "ts"), JudgeScript, wide, prompt=shown)
    return good.select(KEY, "frame_id", "semantic_key").unionByName(bad, allowMissingColumns=True)


@query(f"""
    WITH l AS (SELECT recording_id, seq, seq AS id, start / 8 AS start, stop / 8 AS stop, (row_number() OVER (PARTITION BY recording_id ORDER BY seq) - 1) // 4 AS batch FROM ({b.LINES})),
    w AS (SELECT *, count(*) OVER r AS rn, bool_or(id % 7 = 3) OVER r AS rp, count(*) OVER g AS bn, bool_or(id % 7 = 3) OVER g AS bp FROM l WINDOW r AS (PARTITION BY recording_id), g AS (PARTITION BY recording_id, batch))
    SELECT recording_id, id, start, stop, CASE WHEN rn = 1 OR NOT rp THEN 'recording' WHEN bn = 1 OR NOT bp THEN 'batch' ELSE 'segment' END AS unit FROM w
""")
def refine_ladder(t: Tables) -> DataFrame:
    ship(t.spark)
    lines = t.lines().select(KEY, "seq", F.col("seq").alias("id"), (F.col("start").cast("double") / 8).alias("start"), (F.col("stop").cast("double") / 8).alias("stop"), F.lit("x").alias("text"))
    shown = lambda items: F.array_join(F.transform(items, lambda x: F.format_string("<%d %s %s>", x["id"], x["start"].cast("string"), x["stop"].cast("string"))), "\n")
    wide = config.Profile("wide", "openai_chat", capabilities=frozenset({"json_mode"}))
    good, _ = refine.refine(lines, RefineScript, wide, prompt=shown, batch_size=4)
    return good.select(KEY, "id", "start", "stop", "unit")


# ---------------------------------------------------------------- caches


def _requests(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    paths = F.array(F.concat(F.lit("s/"), o.cast("string"), F.lit(".md")), F.concat(F.lit("s/"), o.cast("string"), F.lit(".json")))
    return t.raw("orders").select(F.col("o_custkey").alias(KEY), F.concat(F.lit("section_"), o.cast("string")).alias("stage_name"), F.sha2("o_orderstatus", 256).alias("cache_key"), paths.alias("output_paths"))


def _known(t: Tables) -> DataFrame:
    """What a manifest holds: no third order, other keys of status P, another order of paths for every fifth."""
    o = F.substring("stage_name", 9, 20).cast("long")
    key = F.when(F.col("cache_key") == F.sha2(F.lit("P"), 256), "old").otherwise(F.col("cache_key"))
    paths = F.when(o % 5 == 0, F.reverse("output_paths")).otherwise(F.col("output_paths"))
    return _requests(t).where(o % 3 != 0).withColumns({"cache_key": key, "output_paths": paths})


KNOWN = "o_orderkey % 3 <> 0 AND o_orderstatus <> 'P' AND o_orderkey % 5 <> 0"


@query(f"SELECT o_custkey AS recording_id, 'section_' || o_orderkey AS stage_name FROM orders WHERE {KNOWN} AND o_orderkey % 4 <> 1")
def hits_with_files(t: Tables) -> DataFrame:
    o = F.col("o_orderkey").cast("string")
    files = t.raw("orders").select(F.explode(F.array(F.concat(F.lit("s/"), o, F.lit(".md")), F.when(F.col("o_orderkey") % 4 != 1, F.concat(F.lit("s/"), o, F.lit(".json"))))).alias("path")).where("path is not null")
    return memo.hits(_requests(t), _known(t), files).select(KEY, "stage_name")


@query(f"SELECT o_custkey AS recording_id, 'section_' || o_orderkey AS stage_name FROM orders WHERE {KNOWN} AND o_orderkey % 7 <> 2")
def revalidated_hits(t: Tables) -> DataFrame:
    broken = t.raw("orders").where("o_orderkey % 7 = 2").select(F.col("o_custkey").alias(KEY), F.concat(F.lit("section_"), F.col("o_orderkey").cast("string")).alias("stage_name"), F.lit("blank").alias("rule"))
    return memo.still_valid(memo.hits(_requests(t), _known(t)), broken).select(KEY, "stage_name")


@query("""
    SELECT o_orderkey AS part_id, o_custkey % 4 <> 0 AND o_orderstatus = 'O' AS kept FROM orders
""")
def resumable_parts(t: Tables) -> DataFrame:
    partial = t.raw("orders").select(F.col("o_custkey").alias(KEY), F.col("o_orderstatus").alias("cache_key"), F.col("o_orderkey").alias("part_id"))
    asked = t.raw("orders").select(F.col("o_custkey").alias(KEY)).distinct().where(F.col(KEY) % 4 != 0).withColumn("cache_key", F.lit("O"))
    kept, purged = memo.resume(partial, asked)
    return kept.select("part_id", F.lit(True).alias("kept")).unionByName(purged.select("part_id", F.lit(False).alias("kept")))


@query(f"SELECT o_custkey AS recording_id, count(*) AS items, count(*) FILTER (WHERE {KNOWN}) AS cached, count(*) FILTER (WHERE NOT ({KNOWN})) AS jobs FROM orders GROUP BY o_custkey")
def section_counts(t: Tables) -> DataFrame:
    return memo.section_counts(_requests(t), memo.hits(_requests(t), _known(t)))


_LINE = "SELECT o_custkey AS r, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders"


@query(f"""
    WITH RECURSIVE l AS ({_LINE}), steps AS (SELECT a.r, a.n AS at, b.n AS next FROM l a JOIN l b ON a.r = b.r AND b.n > 1 AND a.n IN (b.n - 1, b.n // 2)),
    reach AS (SELECT r, n, 0 AS depth FROM l WHERE o % 11 = 0 UNION SELECT s.r, s.next, depth + 1 FROM reach JOIN steps s ON s.r = reach.r AND s.at = reach.n)
    SELECT reach.r AS recording_id, 'stage_' || o AS stage_name, min(depth) AS depth FROM reach JOIN l ON l.r = reach.r AND l.n = reach.n GROUP BY ALL
""")
def stale_stages(t: Tables) -> DataFrame:
    """A customer's orders as stages, each of which reads what the one before it made and what the one at half its place made."""
    n = F.col("n")
    line = t.raw("orders").select(F.col("o_custkey").alias(KEY), F.col("o_orderkey").alias("o"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("n"))
    path = lambda i: F.concat_ws("/", F.col(KEY).cast("string"), i.cast("int").cast("string"))
    made = line.select(KEY, F.concat(F.lit("stage_"), "o").alias("stage_name"), F.when(n > 1, F.array(path(n - 1), path(F.floor(n / 2)))).otherwise(F.array().cast("array<string>")).alias("inputs"), F.array(path(n)).alias("outputs"), "o")
    return memo.stale_closure(made, made.where("o % 11 = 0"), settle=settle)


# ---------------------------------------------------------------- artifacts


@query("""
    SELECT s_nationkey::VARCHAR AS input_hash, 'sections/' || printf('%03d', row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)) || '.md' AS path, '# ' || s_name || chr(10) AS text FROM suppliers_of
""".replace("suppliers_of", "supplier"))
def published_sections(t: Tables) -> DataFrame:
    """A file for each supplier as a chapter of its nation, written as a whole and read back from the run folders."""
    n = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    sections = t.raw("supplier").select(F.col("s_nationkey").alias(KEY), n.alias("chapter_id"), F.concat(F.lit("# "), "s_name", F.lit("\n")).alias("text"))
    root = fresh_folder(t.spark, "sections")
    connector.write_files(connector.section_files(sections), root, run_id="all", stage="section")
    found = connector.read_artifacts(t.spark, root).where("artifact = 'sections_dir'")
    return found.select("input_hash", "path", F.decode("content", "utf-8").alias("text"))


_NAMES = list(catalog.ARTIFACTS)
_STATES = " UNION ALL ".join(f"SELECT k, {i} AS i, '{n}' AS artifact, '{s}' AS stage FROM customer_keys" for i, (n, (_, s)) in enumerate(catalog.ARTIFACTS.items()))
_ORDER = {s: i for i, s in enumerate(dict.fromkeys(s for _, s in catalog.ARTIFACTS.values()))}
_RANK = "CASE stage " + " ".join(f"WHEN '{s}' THEN {i}" for s, i in _ORDER.items()) + " END"


def _states(t: Tables) -> DataFrame:
    """Each customer has the first so many artifacts."""
    k = F.col("c_custkey")
    inputs = t.raw("customer").select(F.concat(F.lit("in/"), k.cast("string"), F.lit(".mp4")).alias("path"), k.cast("string").alias("input_hash"), F.lit("").alias("folder"))
    there = F.explode(F.slice(F.array(*[F.lit(p) for p, _ in catalog.ARTIFACTS.values()]), 1, (k % (len(_NAMES) + 1)).cast("int")))
    files = t.raw("customer").select(k, there.alias("p")).select(F.concat(F.lit("c/"), k.cast("string"), F.lit("/"), "p").alias("path"))
    return catalog.artifact_states(inputs, files, cache="c", output="out")


@query(f"""
    WITH customer_keys AS (SELECT c_custkey AS k FROM customer)
    SELECT 'in/' || k || '.mp4' AS path, k::VARCHAR AS input_hash, artifact, stage, i < k % {len(_NAMES) + 1} AS there FROM ({_STATES})
""")
def artifact_states(t: Tables) -> DataFrame:
    return _states(t)


@query(f"""
    WITH customer_keys AS (SELECT c_custkey AS k FROM customer), s AS (SELECT *, i < k % {len(_NAMES) + 1} AS there, {_RANK} AS r FROM ({_STATES}))
    SELECT k::VARCHAR AS input_hash, bool_or(artifact = '{catalog.AUDIO_DONE}' AND there) AS audio_complete, bool_or(artifact = '{catalog.VISUAL_DONE}' AND there) AS visual_complete,
           arg_min(stage, r) FILTER (WHERE NOT there AND stage <> 'debug') AS next_stage
    FROM s GROUP BY k
""")
def artifact_completeness(t: Tables) -> DataFrame:
    return catalog.completeness(_states(t))


@query("""
    WITH f AS (SELECT page_id, 'r/' || page_id % 7 || '/' || CASE page_id % 4 WHEN 0 THEN 'refined/' || page_id || '.json' WHEN 1 THEN 'n' || page_id || '.md' WHEN 2 THEN 's' || page_id || '.json' ELSE 'f' || page_id || '.png' END AS path, strlen(html) AS size, html FROM pages)
    SELECT path, CASE WHEN page_id % 4 = 1 THEN 'text' WHEN page_id % 4 = 2 THEN 'json' ELSE 'binary' END AS kind, size, CASE WHEN page_id % 4 <> 3 THEN html END AS body FROM f WHERE page_id % 4 <> 0
    UNION ALL SELECT 'r/' || page_id % 7 || '/refined', 'json', sum(size)::BIGINT, '[' || string_agg(html, ',' ORDER BY page_id || '.json') || ']' FROM f WHERE page_id % 4 = 0 GROUP BY page_id % 7
""")
def artifact_inspection(t: Tables) -> DataFrame:
    p = F.col("page_id")
    s = p.cast("string")
    name = F.when(p % 4 == 0, F.concat(F.lit("refined/"), s, F.lit(".json"))).when(p % 4 == 1, F.concat(F.lit("n"), s, F.lit(".md"))).when(p % 4 == 2, F.concat(F.lit("s"), s, F.lit(".json"))).otherwise(F.concat(F.lit("f"), s, F.lit(".png")))
    path = F.concat(F.lit("r/"), (p % 7).cast("string"), F.lit("/"), name)
    return catalog.inspect(t.raw("pages").select(path.alias("path"), F.octet_length("html").cast("long").alias("length"), F.encode("html", "utf-8").alias("content")))


# ---------------------------------------------------------------- settings

_CASES = [
    ("audio_pipeline.extract.sample_rate", "16000", None), ("audio_pipeline.extract.sample_rate", "1000", "one"), ("audio_pipeline.refine.mode", "serial", None), ("audio_pipeline.refine.mode", "quick", "one"),
    ("audio_pipeline.refine.batch_size", "0", "above"), ("visual_pipeline.filter.threshold", "auto", None), ("visual_pipeline.filter.threshold", "-1", "auto_or_above"), ("visual_pipeline.filter.threshold", "27.5", None),
    ("visual_pipeline.filter.candidate_fps", "NaN", "above"), ("visual_pipeline.filter.candidate_fps", "Infinity", "above"), ("visual_pipeline.align.max_context_gap_seconds", "0", None), ("visual_pipeline.align.max_context_gap_seconds", "-0.5", "from"),
    ("visual_pipeline.filter.auto_threshold_candidates", "10, 15", None), ("visual_pipeline.filter.auto_threshold_candidates", "10,x", "all_above"), ("merge.assemble.timestamp_format", "[{hms}]", None),
    ("merge.assemble.timestamp_format", "{frame}", "fields"), ("merge.assemble.video_url_template", "u?t={seconds_int}", None), ("merge.assemble.video_url_template", "u?t={mmss}", "fields"), ("asr.vad", "maybe", "flag"),
    ("asr.speed", "2", "unknown_key"), ("asr.batch_size", None, None), ("merge.outline.target_chapter_count_hint", "5-12", None),
]
_RULES = " ".join(f"WHEN {i} THEN '{r}'" for i, (_, _, r) in enumerate(_CASES) if r)
_KEYS = " ".join(f"WHEN {i} THEN '{k}'" for i, (k, _, _) in enumerate(_CASES))


@query(f"SELECT event_id AS run_id, CASE event_id % {len(_CASES)} {_KEYS} END AS key, CASE event_id % {len(_CASES)} {_RULES} END AS rule FROM events WHERE CASE event_id % {len(_CASES)} {_RULES} END IS NOT NULL")
def setting_violations(t: Tables) -> DataFrame:
    cases = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).cast("string").alias("value")) for k, v, _ in _CASES])
    rows = t.events().select(F.col("event_id").alias("run_id"), F.get(cases, (F.col("event_id") % len(_CASES)).cast("int")).alias("c"))
    return config.setting_violations(rows.select("run_id", "c.key", "c.value"))


@query("""
    WITH p AS (SELECT event_id AS e, ['openai_chat', 'anthropic_messages', 'openai_compatible_chat', 'other'][event_id % 4 + 1] AS provider, event_id % 3 = 0 AS can, event_id % 5 = 1 AS strange,
                      CASE event_id % 7 WHEN 1 THEN 'low' WHEN 2 THEN 'most' END AS effort, CASE event_id % 11 WHEN 1 THEN 100 WHEN 2 THEN 0 END AS budget, CASE event_id % 13 WHEN 1 THEN 0 ELSE 10 END AS rpm FROM events)
    SELECT e AS profile, unnest(list_filter([CASE WHEN provider = 'other' THEN 'provider' END, CASE WHEN strange THEN 'capabilities' END, CASE WHEN effort = 'most' THEN 'effort' END, CASE WHEN budget <= 0 THEN 'budget' END, CASE WHEN rpm <= 0 THEN 'limits' END,
        CASE WHEN (effort IS NOT NULL OR budget IS NOT NULL) AND NOT can THEN 'reasoning' END,
        CASE WHEN (provider = 'anthropic_messages' AND effort IS NOT NULL) OR (provider IN ('openai_chat', 'openai_compatible_chat') AND budget IS NOT NULL) THEN 'options' END], lambda r: r IS NOT NULL)) AS rule FROM p
""")
def profile_violations(t: Tables) -> DataFrame:
    e = F.col("event_id")
    able = F.filter(F.array(F.lit("vision"), F.when(e % 3 == 0, "reasoning"), F.when(e % 5 == 1, "flight")), lambda c: c.isNotNull())
    rows = t.events().select(
        e.alias("profile"), F.get(F.array(*map(F.lit, ("openai_chat", "anthropic_messages", "openai_compatible_chat", "other"))), (e % 4).cast("int")).alias("provider"), able.alias("capabilities"),
        F.when(e % 7 == 1, "low").when(e % 7 == 2, "most").alias("reasoning_effort"), F.when(e % 11 == 1, 100).when(e % 11 == 2, 0).alias("thinking_budget_tokens"),
        F.when(e % 13 == 1, 0).otherwise(10).alias("rpm_limit"), F.lit(None).cast("int").alias("tpm_limit"),
    )
    return config.profile_violations(rows)


@query("""
    WITH r AS (SELECT DISTINCT o_custkey AS run_id FROM orders), n AS (SELECT unnest(['segment', 'refine', 'outline', 'section', 'slide_judge', 'slide_describe']) AS task, unnest(range(0, 6)) AS i),
    t AS (SELECT run_id, task, CASE WHEN run_id % 5 = i THEN 'nobody' ELSE 'main' END AS profile FROM r, n WHERE run_id % 7 <> i UNION ALL SELECT run_id, 'cook', 'main' FROM r WHERE run_id % 3 = 0)
    SELECT run_id, task, CASE WHEN task = 'cook' THEN 'unknown_task' ELSE 'unknown_profile' END AS rule FROM t WHERE task = 'cook' OR profile = 'nobody'
    UNION ALL SELECT run_id, task, 'missing' FROM r, n WHERE run_id % 7 = i
""")
def task_violations(t: Tables) -> DataFrame:
    runs = t.raw("orders").select(F.col("o_custkey").alias("run_id")).distinct()
    rows = runs.select("run_id", F.posexplode(F.array(*map(F.lit, config.TASKS))).alias("i", "task"))
    given = rows.where(F.col("run_id") % 7 != F.col("i")).select("run_id", "task", F.when(F.col("run_id") % 5 == F.col("i"), "nobody").otherwise("main").alias("profile"))
    given = given.unionByName(runs.where("run_id % 3 = 0").select("run_id", F.lit("cook").alias("task"), F.lit("main").alias("profile")))
    return config.task_violations(given, t.spark.createDataFrame([("main",)], "profile string"))
