"""Requests with pictures: what a model is shown, in what order and in how many requests."""

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from intervale.plans import clients, completion, config, envelopes, services

SCHEMA = "recording_id string, frame_id long, ts double, mime string, content binary"
SEEING = config.Profile("seeing", "openai_chat", capabilities=frozenset({"vision", "json_mode"}))


def label():
    return F.concat(F.lit("frame #"), F.col("frame_id").cast("string"))


def frames(spark, n=9, more=()):
    rows = [("r", i, float(7 * i % 10), "image/png", bytes([i]) * 50) for i in range(n)]
    return spark.createDataFrame([*rows, *more], SCHEMA)


def make_judge():  # a class of a function goes to the workers by value
    class Judge:
        """Judges frames by the bytes it is shown; at first no JSON where a picture starts with 200."""

        def complete_parts(self, parts):
            if len(parts) == 1:  # a repair
                shown = [int(x) for x in parts[0].text.split("ids ")[1].split(",")]
            else:
                assert parts[0] == clients.Part("judge") and all(p.content is None for p in parts[1::2])
                shown = [int(p.text.split("#")[1]) for p in parts[1::2]]
                assert [p.content for p in parts[2::2]] == [bytes([i]) * 50 for i in shown]
                if 200 in shown:
                    return "ids " + ",".join(map(str, shown))
                if 100 in shown:
                    shown.remove(100)
            one = {"medium": "chart", "is_meaningful": True, "reason": "r", "semantic_key": "k", "quality_score": 3, "visible_text": "", "content_summary": "s"}
            return json.dumps({"judgements": [{"frame_id": i} | one for i in shown]})

    return Judge


@pytest.mark.parametrize("most", [None, 3200])
def test_judges_see_every_picture_once_in_time_order(spark, most):
    other = [("broken", 100, 0.0, "image/png", bytes([100]) * 50), ("broken", 1, 1.0, "image/png", bytes([1]) * 50), ("mended", 200, 0.0, "image/png", bytes([200]) * 50)]
    good, bad = completion.judgements(frames(spark, 9, other), make_judge(), SEEING, prompt=F.lit("judge"), label=label(), most_tokens=most, block=3.0)
    assert sorted((r.recording_id, r.frame_id) for r in good.collect()) == [("mended", 200)] + [("r", i) for i in range(9)]
    assert [(r.recording_id, r.rule) for r in bad.collect()] == [("broken", "missing")]


def test_requests_keep_to_the_budget_and_to_time_order(spark):
    rows = frames(spark, 40)
    made = envelopes.picture_envelopes(rows, prompt=F.lit("judge"), label=label(), most_tokens=5000, block=2.0)
    got = made.select("request", "frame_ids", envelopes.pictures(F.col("parts")).alias("n"), envelopes.text_length(F.col("parts")).alias("chars")).orderBy("request").collect()
    assert all(r.n * envelopes.PICTURE_TOKENS + (r.chars + 4) // 4 <= 5000 for r in got) and len(got) <= 14
    assert [i for r in got for i in r.frame_ids] == sorted(range(40), key=lambda i: (7 * i % 10, i))
    one = envelopes.picture_envelopes(rows, prompt=F.lit("judge"), label=label(), most_tokens=5000, block=1e9)
    assert sorted((r.request, *r.frame_ids) for r in one.collect()) == [(r.request, *r.frame_ids) for r in got]  # blocks change nothing
    assert made.where("request = 0").selectExpr("max(size(parts)) = 2 * max(size(frame_ids)) + 1").first()[0]


def test_frames_without_picture_label_or_time(spark):
    rows = spark.createDataFrame([("r", 1, 1.0, None, None), ("r", 2, None, "image/png", b"x"), ("q", 3, 0.0, "image/png", b"")], SCHEMA)
    for most in (None, 10, 10_000):
        made = envelopes.picture_envelopes(rows, prompt=F.lit("p"), label=F.when(F.col("frame_id") != 2, label()), most_tokens=most)
        assert sorted(i for r in made.collect() for i in r.frame_ids) == [1, 2, 3]
    made = envelopes.picture_envelopes(rows, prompt=F.lit("p"), label=label()).where("recording_id = 'r'").first()
    assert made.frame_ids == [2, 1] and [(p.text, p.content) for p in made.parts] == [("p", None), ("frame #2", None), (None, b"x"), ("frame #1", None)]
    assert envelopes.picture_envelopes(rows.limit(0), prompt=F.lit("p"), label=label(), most_tokens=5000).count() == 0


def make_describer():  # a class of a function goes to the workers by value
    class Describer:
        """Says what it sees at the second attempt, and fails where it is shown nothing."""

        def complete_parts(self, parts):
            if len(parts) == 1:
                raise clients.ClientError("no picture")
            said = hashlib.sha256(parts[1].content).hexdigest() if "was refused" in parts[0].text else "..."
            return json.dumps({"visible_text": "t", "visible_evidence": ["e"], "description": said})

    return Describer


def test_a_picture_goes_with_every_attempt(spark):
    rows = spark.createDataFrame([(1, "ppt", "look", "image/png", b"one"), (2, "ppt", "look", None, None)], "frame_id long, medium string, prompt string, mime string, content binary")
    good, bad = completion.descriptions(rows, make_describer(), SEEING)
    assert [(r.frame_id, r.attempt, r.description) for r in good.collect()] == [(1, 2, hashlib.sha256(b"one").hexdigest())]
    assert sorted((r.frame_id, r.attempt, r.error_class) for r in bad.collect()) == [(1, 1, "Model"), (2, 1, "Client")]


def test_pictures_count_as_tokens_and_need_a_model_that_sees(spark):
    made = envelopes.picture_envelopes(frames(spark, 2), prompt=F.lit("p"), label=label()).withColumn("prompt", F.lit(""))
    blind = completion.complete_text(made, clients.EchoClient, config.Profile("b", "openai_chat"), parts="parts").first()
    small = completion.complete_text(made, clients.EchoClient, config.Profile("s", "openai_chat", capabilities=frozenset({"vision"}), max_context=2000), parts="parts").first()
    assert (blind.error_class, blind.message) == ("Model", "no vision")
    assert small.error_class == "ContextLength" and int(small.message.split(" ")[0]) == 2 * 1024 + (1 + 2 * 8 + 4) // 4


@pytest.mark.parametrize("kind", ["openai_chat", "openai_responses", "anthropic_messages"])
def test_services_keep_the_order_of_parts(kind):
    sent = []
    answers = {"openai_chat": {"choices": [{"message": {"content": "y"}}]}, "openai_responses": {"output": [{"type": "message", "content": [{"type": "output_text", "text": "y"}]}]}, "anthropic_messages": {"content": [{"type": "text", "text": "y"}]}}
    client = services.connect(config.Profile("p", kind, api_key_env="K"), {"K": "s"}, send=lambda url, headers, body: (sent.append(body), (200, answers[kind]))[1])
    assert client.complete_parts([clients.Part("first"), clients.Part(mime="image/jpeg", content=b"\xff\x00"), clients.Part("last")]) == "y"
    text = json.dumps(sent[0])
    assert text.index("first") < text.index(base64.b64encode(b"\xff\x00").decode()) < text.index("last") and "image/jpeg" in text
