"""Verdicts from a model behind HTTP: one POST for each batch of asks.

Each task posts batches of its partition in a few threads, whose number follows the endpoint's rate limits. The endpoint
takes {"state", "questions": {tag: {"type", "instructions"}}} and answers {"answers": {tag: {field: probability}}}.
"""

from __future__ import annotations

import json
import math
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import DataFrame

from .. import params as P

SCHEMA = "qid long, tag string, probability double, problem string"
#: Status, headers (lower case) and decoded body of the answer to a request.
Transport = Callable[[dict], tuple[int, dict, dict]]


class ProviderError(RuntimeError):
    """code: auth, rate-limit, token-limit or provider."""

    def __init__(self, code: str, message: str, wait: float = 1.0, transient: bool = False) -> None:
        super().__init__(message)
        self.code, self.wait, self.transient = code, wait, transient


@dataclass(frozen=True)
class Endpoint:
    """Where to ask, and how often to try again. transport replaces the network in tests."""

    url: str = ""
    key: str = ""
    field: str = "probability"
    timeout: float = 30.0
    rate_attempts: int = 20
    transient_retries: int = 4
    pause: float = 1.0
    transport: Transport | None = None

    def send(self, request: dict) -> tuple[int, dict, dict]:
        if self.transport:
            return self.transport(request)
        post = urllib.request.Request(self.url, json.dumps(request).encode(), {"content-type": "application/json", "authorization": f"Bearer {self.key}"})
        try:
            with urllib.request.urlopen(post, timeout=self.timeout) as found:  # noqa: S310
                return found.status, {k.lower(): v for k, v in found.headers.items()}, json.load(found)
        except urllib.error.HTTPError as e:
            try:
                body = json.load(e)
            except ValueError:
                body = {}
            return e.code, {k.lower(): v for k, v in e.headers.items()}, body
        except (OSError, ValueError) as e:
            return 503, {}, {"message": str(e)}


def retry_after(value: str | None, pause: float) -> float:
    """Seconds to wait by a Retry-After header, which is a number or a date."""
    try:
        return max(0.0, float(value)) if value is not None else pause
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - time.time())
    except ValueError:
        return pause


def failure(status: int, headers: dict, body: dict, pause: float) -> ProviderError:
    """What a status other than 200 means."""
    error = body.get("error")
    message = body.get("detail") or (error.get("message") if isinstance(error, dict) else None) or body.get("message") or f"http {status}"
    if status in (401, 403):
        return ProviderError("auth", message)
    if status == 429:
        return ProviderError("rate-limit", message, retry_after(headers.get("retry-after"), pause))
    if status == 422 and "token" in message.lower():
        return ProviderError("token-limit", message)
    return ProviderError("provider", message, pause, transient=status == 408 or status >= 500)


def read_answers(body: dict, tags: list[str], field: str) -> list[float]:
    """The probability of each tag; all must be there, finite and from 0 to 1."""
    out = []
    for tag in tags:
        cell = (body.get("answers") or {}).get(tag) if isinstance(body, dict) else None
        p = cell.get(field) if isinstance(cell, dict) else None
        if isinstance(p, bool) or not isinstance(p, (int, float)) or not math.isfinite(p) or not 0 <= p <= 1:
            raise ProviderError("provider", f"no valid answer for {tag}")
        out.append(float(p))
    return out


class Slots:
    """How many requests of a task may be under way: halved once for each wave of rate limits, one more after as many good answers as there are slots.

    Only answers that came while all slots were taken count. Next to the number that last met a limit it takes 16 times as many.
    """

    def __init__(self, most: int, slow: int = 16, clock: Callable[[], float] = time.monotonic) -> None:
        self.most, self.slow, self.clock = most, slow, clock
        self.limit, self.ceiling, self.busy, self.good, self.calm = most, most + 1, 0, 0, 0.0
        self.free = threading.Condition()

    def take(self) -> None:
        with self.free:
            self.free.wait_for(lambda: self.busy < self.limit)
            self.busy += 1

    def give(self, limited: bool, good: bool, wait: float) -> None:
        with self.free:
            full, self.busy = self.busy >= self.limit, self.busy - 1
            if limited and self.clock() >= self.calm:
                self.ceiling, self.limit, self.good, self.calm = self.limit, max(1, self.limit // 2), 0, self.clock() + wait
            elif good and full and self.limit < self.most:
                self.good += 1
                if self.good >= self.limit * (self.slow if self.limit + 1 >= self.ceiling else 1):
                    self.limit, self.good = self.limit + 1, 0
            self.free.notify_all()


def sent(endpoint: Endpoint, request: dict, slots: Slots | None) -> tuple[int, dict, dict, ProviderError | None]:
    """The answer to one request, made in a slot, and what it means if it is none."""
    if slots:
        slots.take()
    error, status = None, 0
    try:
        status, headers, body = endpoint.send(request)
        error = None if status == 200 else failure(status, headers, body, endpoint.pause)
        return status, headers, body, error
    finally:
        if slots:
            slots.give(status == 429, status == 200, error.wait if error else 0.0)


def post(endpoint: Endpoint, asks: list[tuple[str, str, str]], slots: Slots | None = None) -> list[float]:
    """asks (tag, prompt, state) -> probabilities, tried again on rate limits and passing failures."""
    request = {"state": {"documents": sorted({s for _, _, s in asks})}, "questions": {t: {"type": endpoint.field, "instructions": p} for t, p, _ in asks}}
    limited = passing = 0
    while True:
        _, _, body, error = sent(endpoint, request, slots)
        if error is None:
            return read_answers(body, [t for t, _, _ in asks], endpoint.field)
        limited += error.code == "rate-limit"
        passing += error.transient
        if (error.code == "rate-limit" and limited < endpoint.rate_attempts) or (error.transient and passing <= endpoint.transient_retries):
            time.sleep(error.wait)
            continue
        raise error


def without_chosen(state: str) -> str:
    """A state without the passages chosen from other files: they go first where a request is too large."""
    try:
        found = json.loads(state)
    except ValueError:
        return state
    about = found.get("about") if isinstance(found, dict) else None
    if not isinstance(about, dict) or about.pop("chosen", None) is None:
        return state
    return json.dumps(found, ensure_ascii=False)


def ask(endpoint: Endpoint, asks: list[tuple[str, str, str]], cut: bool = False, slots: Slots | None = None) -> list[tuple[float | None, str | None]]:
    """(probability, problem) of each ask. Too large a batch loses the chosen passages, then is halved, and a single ask's state cut to half once; refused keys raise."""
    try:
        return [(p, None) for p in post(endpoint, asks, slots)]
    except ProviderError as e:
        if e.code == "auth":
            raise
        bare = [(tag, prompt, without_chosen(state)) for tag, prompt, state in asks]
        if e.code == "token-limit" and bare != asks:
            return ask(endpoint, bare, cut=cut, slots=slots)
        if e.code == "token-limit" and len(asks) > 1:
            mid = len(asks) // 2
            return ask(endpoint, asks[:mid], slots=slots) + ask(endpoint, asks[mid:], slots=slots)
        if e.code == "token-limit" and not cut and len(asks[0][2]) > 1:
            tag, prompt, state = asks[0]
            return ask(endpoint, [(tag, prompt, state[: len(state) // 2])], cut=True, slots=slots)
        return [(None, f"{e.code}: {e}")] * len(asks)


def http_verdicts(asks: DataFrame, endpoint: Endpoint, width: int = 16, most: int = P.ASK_CAP, size: int = P.ASK_BYTES, lanes: int = 4) -> DataFrame:
    """asks(qid, tag, prompt, state) -> verdicts(qid, tag, probability, problem); batches hold one question's asks, up to `most` and `size` bytes.

    Asks are dealt by question and tag, so no question's asks all meet in one task; a task posts in `lanes` threads at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(lanes)
        pool = ThreadPoolExecutor(lanes)
        try:
            yield from answers(batches, pool, slots)
        finally:
            pool.shutdown(cancel_futures=True)

    def answers(batches: Iterator[pa.RecordBatch], pool: ThreadPoolExecutor, slots: Slots) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(zip(*(batch.column(c).to_pylist() for c in ("qid", "tag", "prompt", "state")), strict=True))
            packed: list[list[tuple]] = []
            used = 0
            for row in rows:
                n = len((row[3] or "").encode())
                if not packed or packed[-1][-1][0] != row[0] or len(packed[-1]) >= most or used + n > size:
                    packed.append([])
                    used = 0
                packed[-1].append(row)
                used += n
            every = pool.map(lambda rows_: ask(endpoint, [(t, p, s or "") for _, t, p, s in rows_], slots=slots), packed)
            for rows_, found in zip(packed, every, strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows_], pa.int64()), pa.array([r[1] for r in rows_], pa.string()), pa.array([p for p, _ in found], pa.float64()), pa.array([x for _, x in found], pa.string())],
                    names=["qid", "tag", "probability", "problem"],
                )

    return asks.select("qid", "tag", "prompt", "state").repartition(width, "qid", "tag").mapInArrow(run, SCHEMA)
