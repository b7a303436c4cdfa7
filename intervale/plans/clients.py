"""Model and media connectors behind one small protocol.

A client turns a batch of rows into rows, on the executors, in Arrow batches.
``EchoClient`` is deterministic and stands in where no model is to be had; an
adapter for a real service has the same shape and raises the errors below,
which ``with_retries`` understands.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from intervale.operators.admission import Limiter

#: Seconds before each attempt of a request that met a rate limit.
DELAYS = (0, 5, 10, 20)


class ClientError(RuntimeError):
    """A failed request."""


class RateLimitError(ClientError):
    """The service asks for patience; the only error that is tried again."""


class AuthError(ClientError):
    """The service refuses the key."""


class TransportError(ClientError):
    """The service can't be reached or is broken."""


@dataclass(frozen=True)
class Part:
    """A text, or a picture with its media type, of a request."""

    text: str | None = None
    mime: str | None = None
    content: bytes | None = None


class Client(Protocol):
    """Answers a prompt; one that takes pictures has ``complete_parts`` as well."""

    def complete(self, prompt: str) -> str: ...


class EchoClient:
    """Answers a prompt with itself."""

    def complete(self, prompt: str) -> str:
        return prompt


def status_error(status: int | None, message: str = "") -> ClientError:
    """The error of a response status; none means the connection failed."""
    kinds = {401: AuthError, 403: AuthError, 429: RateLimitError}
    return kinds.get(status, TransportError if status is None or status >= 500 else ClientError)(message)


class LocalGate:
    """Holds requests of one worker process to limits of requests and tokens a minute.

    Workers don't share memory, so each takes its part of a profile's limits; where
    the number of workers isn't known, ``leases.LeaseOffice`` shares one window.
    """

    def __init__(self, rpm: int | None, tpm: int | None, *, workers: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        part = lambda n: None if n is None else max(1, n // workers)
        self.limiter, self.clock, self.sleep = Limiter(part(rpm), part(tpm)), clock, sleep

    def __call__(self, tokens: int) -> None:
        while (wait := self.limiter.wait(now := self.clock(), tokens)) > 0:
            self.sleep(wait)
        self.limiter.note(now, tokens)


def with_retries(call: Callable[[], str], sleep: Callable[[float], None] = time.sleep, acquire: Callable[[], None] = lambda: None) -> str:
    """The answer of a call; each attempt takes its place in the limits anew."""
    for attempt, delay in enumerate(DELAYS):
        if delay:
            sleep(delay)
        acquire()
        try:
            return call()
        except RateLimitError:
            if attempt == len(DELAYS) - 1:
                raise
    raise AssertionError


def complete_rows(
    rows: DataFrame,
    make_client: Callable[[], Client],
    *,
    prompt: str = "prompt",
    parts: str | None = None,
    refused: str | None = None,
    tokens: str | None = None,
    make_gate: Callable[[], Callable[[int], int | None]] | None = None,
    sleep: Callable[[float], None] = time.sleep,
    tasks: int | None = None,
    at_once: int = 1,
    trace: bool = False,
) -> DataFrame:
    """rows plus ``answer``, ``error_class`` and ``message``; a failed request is a row with an error, not a failed job.

    Rows are dealt evenly to ``tasks`` tasks (as many as there are cores if none is
    named, since rows after a grouping are few and light, and would share one
    task; 0 leaves them where they are), each of which has up to ``at_once``
    requests under way.  Answers stay beside their rows, in the order in which the
    task got them.  Where a column ``parts`` (see ``envelopes``) is named, its texts
    and pictures are sent in their order instead of the prompt, and it is
    left out of what comes back.  A row with a text in ``refused`` (``class: message``) isn't
    sent.  The gate gets the row's ``tokens`` before each attempt; with ``trace``,
    the times that it gives come back as ``leases``, and the seconds at which
    the request began and ended as ``began`` and ``ended``, its task as ``task``.
    """

    unsent = [c for c in (refused, parts) if c]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        client, gate = make_client(), make_gate() if make_gate else lambda n: None
        place = TaskContext.get().partitionId()

        send = (lambda x: client.complete_parts([Part(*(p[k] for k in ("text", "mime", "content"))) for p in x])) if parts else client.complete

        def one(request: tuple) -> tuple:
            text, why, n = request
            began, leases = time.time(), []
            if why is not None:
                kind, _, said = why.partition(": ")
                return None, kind, said, leases, began, time.time()
            take = lambda: leases.extend(x for x in [gate(n)] if x is not None)
            try:
                return with_retries(lambda: send(text), sleep, take), None, None, leases, began, time.time()
            except ClientError as e:
                return None, type(e).__name__.removesuffix("Error"), str(e), leases, began, time.time()

        with ThreadPoolExecutor(max(1, at_once)) as pool:
            for batch in batches:
                whys = [x if isinstance(x, str) else None for x in batch[refused]] if refused else [None] * len(batch)
                sizes = batch[tokens].fillna(0).astype(int) if tokens else [0] * len(batch)
                done = list(pool.map(one, zip(batch[parts or prompt], whys, sizes, strict=True)))
                answer, error, message, leases, began, ended = zip(*done, strict=True) if done else ([],) * 6
                found = batch.drop(columns=unsent)
                found = found.assign(answer=pd.array(answer, dtype="string"), error_class=pd.array(error, dtype="string"), message=pd.array(message, dtype="string"))
                yield found.assign(leases=list(leases), began=list(began), ended=list(ended), task=place) if trace else found

    dealt = rows if tasks == 0 else rows.repartition(tasks or rows.sparkSession.sparkContext.defaultParallelism)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in unsent)
    traced = ", leases array<long>, began double, ended double, task int" if trace else ""
    return dealt.mapInPandas(run, f"{schema}, answer string, error_class string, message string{traced}")


ERRORS = {kind.__name__.removesuffix("Error"): kind for kind in (ClientError, RateLimitError, AuthError, TransportError)}


def raise_first(answered: DataFrame, *order: str) -> None:
    """Raise the error of the first failed row in the order given, if any failed.

    For callers that want a failed request to end the job: rows are asked first,
    all of them, and their answers should be kept (``settling.settle``) before.
    """
    first = answered.where("error_class is not null").orderBy(*order).select("error_class", "message").first()
    if first is not None:
        raise ERRORS.get(first.error_class, ClientError)(first.message)
