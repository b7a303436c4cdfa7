"""One limit for all workers: the driver leases the times at which requests may go out.

An office in the driver keeps one window of requests and tokens a profile.  A
task's worker asks it for each attempt of a request and gets the time at which
that one may go, so the window is right whatever the number of tasks, threads
and executors.  Leases are given in the order of asking and never taken back:
those of a lost worker count until their window has passed, so a limit is kept
even then.  Only numbers travel, one exchange an attempt, and no more attempts
can be asked for than the limits let through.

The leases come back with the answers, as data, so that a query over the log can
tell whether a limit was kept (see ``lease_log`` and ``admission.usage``).
"""

from __future__ import annotations

import os
import secrets
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.connection import Client as Connect
from multiprocessing.connection import Listener

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.operators.admission import WINDOW, Limiter

#: Microseconds of a second, in which leases are logged.
MICROS = 1_000_000


class LeaseOffice:
    """The windows of some profiles, each a pair of (requests, tokens) or of None for no limit.

    Use as a context, or ``close`` it; ``desk`` is what goes to the workers.  Times
    are whole microseconds, so that they add up exactly.
    """

    def __init__(self, spark: SparkSession, limits: dict[str, tuple[int | None, int | None]], *, window: float = WINDOW, clock: Callable[[], int] = lambda: time.time_ns() // 1000):
        self.clock, self.lock, self.key = clock, threading.Lock(), secrets.token_bytes(16)
        self.windows = {name: Limiter(*both, round(window * MICROS)) for name, both in limits.items()}
        self.last = dict.fromkeys(limits, 0)
        host = spark.conf.get("spark.driver.host")
        self.listener = Listener((spark.conf.get("spark.driver.bindAddress", host), 0), backlog=128, authkey=self.key)
        self.address = (host, self.listener.address[1])
        self.open = True
        threading.Thread(target=self._welcome, daemon=True).start()

    def lease(self, profile: str, tokens: int) -> tuple[int, float]:
        """(time of a request's lease, seconds until then); the latest one asked for goes out last."""
        with self.lock:
            now = self.clock()
            at = self.last[profile] = self.windows[profile].admit(max(now, self.last[profile]), max(0, tokens))
        return int(at), max(0, at - now) / MICROS

    def desk(self, profile: str) -> Callable[[], Desk]:
        """What makes a worker's way to this office, for ``complete_rows``."""
        if profile not in self.windows:
            raise KeyError(f"no limits are known for {profile}")
        address, key = self.address, self.key
        return lambda: Desk.of(address, key, profile)

    def _welcome(self) -> None:
        while self.open:
            try:
                line = self.listener.accept()
            except Exception:  # a stranger without the key, or the end
                continue
            threading.Thread(target=self._serve, args=(line,), daemon=True).start()

    def _serve(self, line) -> None:
        with line:
            try:
                while True:
                    line.send(self.lease(*line.recv()))
            except (EOFError, OSError):  # the worker has gone
                return

    def close(self) -> None:
        self.open = False
        self.listener.close()

    def __enter__(self) -> LeaseOffice:
        return self

    def __exit__(self, *_) -> None:
        self.close()


@dataclass
class Desk:
    """A worker process's line to the office, shared by its threads; a gate for ``with_retries``."""

    address: tuple[str, int]
    key: bytes
    profile: str
    sleep: Callable[[float], None] = time.sleep
    lock: threading.Lock = field(default_factory=threading.Lock)
    line: object = None

    @staticmethod
    def of(address: tuple[str, int], key: bytes, profile: str) -> Desk:
        name = (os.getpid(), address, profile)
        if name not in _desks:
            _desks[name] = Desk(address, key, profile)
        return _desks[name]

    def __call__(self, tokens: int) -> int:
        """Wait for a lease; its time by the office's clock."""
        with self.lock:
            self.line = self.line or Connect(self.address, authkey=self.key)
            self.line.send((self.profile, tokens))
            at, wait = self.line.recv()
        if wait > 0:
            self.sleep(wait)
        return at


_desks: dict[tuple, Desk] = {}


def lease_log(answered: DataFrame, profile: str, tokens: str = "tokens") -> DataFrame:
    """(profile, t_us, tokens) of every lease of answered rows, which carry ``leases``; the log that ``admission.usage`` takes."""
    return answered.select(F.lit(profile).alias("profile"), F.explode("leases").alias("t_us"), F.col(tokens).alias("tokens"))
