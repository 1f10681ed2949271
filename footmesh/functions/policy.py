"""Rules of repeated requests as pure functions: in which order endpoints are tried, what ends a try, how long to wait."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

# Rounds, milliseconds of the first wait and of its random part, and statuses after which another try makes sense.
ROUNDS, BASE_MS, JITTER_MS = 2, 1_000, 500
RETRYABLE = (429, 502, 503, 504)


@dataclass(frozen=True)
class Reply:
    """What an endpoint gave: a payload, or a status (None where the network failed) and how long it asks to wait."""

    payload: object = None
    status: int | None = None
    retry_after_ms: float | None = None


@dataclass(frozen=True)
class Attempt:
    endpoint: str
    outcome: str
    status: int | None


def backoff_ms(round_no: int, asked: Sequence[float | None], jitter: float) -> float:
    """The wait after a round: twice as long each round, or as long as any endpoint asked, and a random part (``jitter`` from 0 to 1)."""
    return max(BASE_MS * 2**round_no, *(a or 0.0 for a in asked), 0.0) + jitter * JITTER_MS


def fetch(endpoints: Sequence[str], ask: Callable[[str], Reply], wait: Callable[[float], None], jitter: Callable[[], float] = lambda: 0.0, rounds: int = ROUNDS) -> tuple[object, list[Attempt]]:
    """(payload or None, attempts made). Endpoints are tried in order, in up to ``rounds`` rounds.

    The first payload ends it. A status that another try cannot mend ends it for all endpoints; failures of
    the network and the retryable statuses go on to the next endpoint, and after a round to the next round.
    """
    made: list[Attempt] = []
    for number in range(rounds):
        asked: list[float | None] = []
        for endpoint in endpoints:
            reply = ask(endpoint)
            if reply.payload is not None:
                made.append(Attempt(endpoint, "ok", 200))
                return reply.payload, made
            if reply.status is not None and reply.status not in RETRYABLE:
                made.append(Attempt(endpoint, "fatal-failure", reply.status))
                return None, made
            made.append(Attempt(endpoint, "retryable-failure", reply.status))
            asked.append(reply.retry_after_ms)
        if not asked or number == rounds - 1:
            break
        wait(backoff_ms(number, asked, jitter()))
    return None, made
