"""Requests side by side under one limit."""

import http.server
import random
import threading
import time
from multiprocessing import AuthenticationError
from multiprocessing.connection import Client as Connect

import pytest
from pyspark.sql import functions as F

from intervale.operators import admission
from intervale.operators.admission import Limiter
from intervale.plans import clients, config, leases, services
from intervale.settling import settle


def slow_echo():
    """Made here, so that it travels to the workers by value."""

    class SlowEcho:
        def complete(self, prompt):
            time.sleep(0.004)
            if prompt.startswith("bad"):
                raise clients.AuthError(prompt)
            if prompt.startswith("worse"):
                raise clients.TransportError(prompt)
            return prompt

    return SlowEcho


def most_at_once(spans):
    ends = sorted([(a, 1) for a, _ in spans] + [(b, -1) for _, b in spans])
    now = best = 0
    for _, step in ends:
        now += step
        best = max(best, now)
    return best


def test_grouped_requests_share_one_limit(spark):
    """1,000 requests after a grouping: four tasks of up to five each, in order, and the limit holds over all of them."""
    grouped = spark.range(3000).groupBy((F.col("id") % 1000).alias("k")).agg(F.concat(F.lit("p"), F.min("id").cast("string")).alias("prompt"), F.sum("id").alias("s")).withColumn("tokens", (F.col("k") % 7 + 1).cast("long"))
    limit, most_tokens, window = 150, 450, 0.3
    with leases.LeaseOffice(spark, {"p": (limit, most_tokens)}, window=window) as office:
        rows = settle(clients.complete_rows(grouped, slow_echo(), tokens="tokens", make_gate=office.desk("p"), tasks=4, at_once=5, trace=True)).toPandas()
    assert len(rows) == 1000 and (rows.answer == "p" + rows.k.astype(str)).all()
    assert sorted(rows.task.unique()) == [0, 1, 2, 3] and rows.groupby("task").size().min() > 150
    for _, own in rows.groupby("task"):
        assert 1 < most_at_once(list(zip(own.began, own.ended, strict=True))) <= 5
    times = sorted((int(at), int(n)) for all_at, n in zip(rows.leases, rows.tokens, strict=True) for at in all_at)
    assert len(times) == 1000
    for i, (at, _) in enumerate(times):
        inside = [n for t, n in times[: i + 1] if t > at - window * 1e6]
        assert len(inside) <= limit and sum(inside) <= most_tokens
    log = admission.usage(leases.lease_log(spark.createDataFrame(rows[["leases", "tokens"]], "leases array<long>, tokens long"), "p"), window_us=int(window * 1e6))
    assert log.agg(F.max("window_requests"), F.max("window_tokens")).first()[0] <= limit


def test_leases_are_those_of_the_replay(spark):
    """At given times the office does what the sliding window does with one queue."""
    rng, now = random.Random(2), [0]
    office = leases.LeaseOffice(spark, {"p": (5, 40), "free": (None, None)}, window=1.0, clock=lambda: now[0])
    plain, clock = Limiter(5, 40, 1_000_000), 0
    for _ in range(200):
        now[0] += rng.randrange(0, 300_000)
        n = rng.choice([1, 5, 20, 60])  # the last one is over the limit, and passes when requests allow it
        clock = plain.admit(max(clock, now[0]), n)
        assert office.lease("p", n) == (clock, (clock - now[0]) / 1e6)
        assert office.lease("free", n) == (now[0], 0)
    with pytest.raises(KeyError):
        office.desk("other")
    office.close()


def test_strangers_are_not_served(spark):
    with leases.LeaseOffice(spark, {"p": (1, None)}, window=0.05) as office:
        for _ in range(2):
            with pytest.raises((AuthenticationError, EOFError, OSError)):
                Connect(office.address, authkey=b"guess")
        desk = leases.Desk(office.address, office.key, "p")
        first, second = desk(0), desk(0)
        assert second - first >= 50_000


def test_retries_take_new_leases(spark):
    class Busy:
        asked = 0

        def complete(self, prompt):
            Busy.asked += 1
            if Busy.asked < 3:
                raise clients.RateLimitError("later")
            return prompt

    with leases.LeaseOffice(spark, {"p": (None, None)}) as office:
        row = clients.complete_rows(spark.createDataFrame([("a",)], "prompt string"), Busy, make_gate=office.desk("p"), sleep=lambda s: None, tasks=1, trace=True).collect()[0]
    assert row.answer == "a" and len(row.leases) == 3


def test_first_error_in_order(spark):
    rows = spark.createDataFrame([(i, f"{'worse' if i == 7 else 'bad' if i == 3 else 'ok'} {i}") for i in range(20)], "seq int, prompt string")
    done = settle(clients.complete_rows(rows, slow_echo(), tasks=3, at_once=2))
    assert done.where("answer is not null").count() == 18
    with pytest.raises(clients.AuthError, match="bad 3"):
        clients.raise_first(done, "seq")
    with pytest.raises(clients.TransportError):
        clients.raise_first(done, F.desc("seq"))
    clients.raise_first(done.where("seq > 10"), "seq")


def test_rows_stay_where_they_are_if_asked_to(spark):
    rows = spark.range(0, 8, 1, 2).withColumn("prompt", F.col("id").cast("string"))
    got = clients.complete_rows(rows, clients.EchoClient, tasks=0, trace=True).collect()
    assert {r.task for r in got} == {0, 1} and [r.answer for r in got] == [str(r.id) for r in got]
    assert clients.complete_rows(rows.limit(0), clients.EchoClient).collect() == []


def test_settings_say_how_many_at_once():
    made = config.Config({}, {}, {"merge.section.concurrent_calls": 9})
    assert made.calls("section") == {"tasks": 1, "at_once": 9} and made.calls("slide_describe") == {"tasks": 1, "at_once": 5} and made.calls("outline") == {}


# ---------------------------------------------------------------- services


def messages_body(profile_options=None, **asked):
    sent = []
    profile = config.Profile("p", "anthropic_messages", model="m", api_key_env="K", capabilities=frozenset({"reasoning"}), **(profile_options or {}))
    services.connect(profile, {"K": "k"}, send=lambda u, h, b: sent.append(b) or (200, {"content": []}), options=config.Options(**asked)).complete("x")
    return sent[0]


def test_thinking_budget_and_output_limit():
    assert messages_body()["max_tokens"] == 1024 and "thinking" not in messages_body()
    assert messages_body(thinking_budget_tokens=2000)["max_tokens"] == 3024
    body = messages_body({"thinking_budget_tokens": 500}, max_output_tokens=501)
    assert body["max_tokens"] == 501 and body["thinking"] == {"type": "enabled", "budget_tokens": 500}
    assert messages_body(max_output_tokens=0)["max_tokens"] == 0
    for most in (500, 499, 0):
        with pytest.raises(clients.ClientError, match="thinking budget"):
            messages_body(thinking_budget_tokens=500, max_output_tokens=most)
        asked = config.Options(thinking_budget_tokens=500, max_output_tokens=most)
        assert "output limit" in config.Profile("p", "anthropic_messages", capabilities=frozenset({"reasoning"})).refuses(asked)


def test_a_service_that_hangs_is_given_up():
    class Hangs(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            time.sleep(3)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Hangs)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    began = time.time()
    for profile, options in ((config.Profile("p", "openai_compatible_chat", base_url=url, timeout_seconds=0.2), config.Options()), (config.Profile("p", "openai_compatible_chat", base_url=url, timeout_seconds=60), config.Options(timeout_seconds=0.2))):
        with pytest.raises(clients.TransportError):
            services.connect(profile, {}, options=options).complete("x")
    assert time.time() - began < 2.5
    server.shutdown()
