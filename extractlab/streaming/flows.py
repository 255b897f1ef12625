"""The event flows as streams: deduplication within a watermark, and sessions closed by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from extractlab.operators.admission import ADMITTED_JOBS, Places


def deduplicated(updates: DataFrame, time: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Each key once; keys are forgotten when the watermark has passed them."""
    return updates.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def inactivity_sessions(updates: DataFrame, owner: str, time: str, gap: int, delay: str = "1 hour") -> DataFrame:
    """(owner, start, end, events) of each session, when silence of ``gap`` seconds has ended it: an event just
    that long after the last begins a new one. State is one open session for each owner."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed = []
        if state.hasTimedOut:
            closed.append(state.get)
            state.remove()
        else:
            times = sorted(t.timestamp() for b in batches for t in b[time])
            start, end, n = state.get if state.exists else (times[0], times[0], 0)
            for t in times:
                if n and t - end >= gap:
                    closed.append((start, end, n))
                    start, n = t, 0
                end, n = max(end, t) if n else t, n + 1
            state.update((start, end, n))
            # A timer may not lie before the watermark; the session then ends with the next one.
            state.setTimeoutTimestamp(max(int((end + gap) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], s, e, n) for s, e, n in closed], columns=[owner, "start", "end", "events"])

    return updates.withWatermark(time, delay).groupBy(owner).applyInPandasWithState(
        step, f"{owner} long, start double, end double, events long", "start double, end double, events long", "append", GroupStateTimeout.EventTimeTimeout
    )


def preview_outcomes(events: DataFrame, owner: str, time: str, order: str, action: str, ttl: int, delay: str = "1 hour") -> DataFrame:
    """(owner, order, outcome) as :func:`extractlab.operators.flow.previews` gives it, while events arrive. State is the
    owner's one preview: its last activity and whether it is saved; a timer drops it when the watermark shows it expired."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told = []
        if state.hasTimedOut:
            state.remove()
        else:
            live = list(state.get) if state.exists else None
            for t, i, what in sorted((t.timestamp(), i, a) for b in batches for t, i, a in zip(b[time], b[order], b[action], strict=True)):
                if live and t - live[0] >= ttl:
                    live = None
                if what == "stage":
                    live, said = [t, False], "staged"
                elif live is None:
                    said = "expired"
                elif what == "cancel":
                    live, said = None, "cancelled"
                elif what == "show":
                    live, said = [t, live[1]], "shown"
                else:
                    live, said = [t, True], "repeated" if live[1] else "saved"
                told.append((key[0], i, said))
            if live:
                state.update(tuple(live))
                state.setTimeoutTimestamp(max(int((live[0] + ttl) * 1000), state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(told, columns=[owner, order, "outcome"])

    return events.withWatermark(time, delay).groupBy(owner).applyInPandasWithState(
        step, f"{owner} long, {order} long, outcome string", "activity double, saved boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


def admissions(requests: DataFrame, service: str, owner: str, start: str, end: str, jobs: int = ADMITTED_JOBS, delay: str = "1 hour") -> DataFrame:
    """(service, id, active, own, decision) as :func:`extractlab.operators.admission.admission` gives it, while requests arrive. State are the
    jobs that run in a service, at most ``jobs``; a timer drops it when the watermark shows that all of them are over."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told = []
        if state.hasTimedOut:
            state.remove()
        else:
            places = Places(list(zip(*state.get, strict=True)) if state.exists else [], jobs)
            rows = sorted((t.timestamp(), i, o, e.timestamp()) for b in batches for t, i, o, e in zip(b[start], b["id"], b[owner], b[end], strict=True))
            told = [(key[0], i, *places.decide(o, t, e)) for t, i, o, e in rows]
            if places.running:
                state.update(([e for e, _ in places.running], [int(o) for _, o in places.running]))
                state.setTimeoutTimestamp(max(int(max(e for e, _ in places.running) * 1000), state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(told, columns=[service, "id", "active", "own", "decision"])

    return requests.withWatermark(start, delay).groupBy(service).applyInPandasWithState(
        step, f"{service} long, id long, active int, own int, decision string", "ends array<double>, owners array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def late_fragments(fragments: DataFrame, owner: str, album: str, time: str, order: str, quiet: int, work: int, remember: int, delay: str = "1 hour") -> DataFrame:
    """(owner, album, order, effect, album_generation) as :func:`extractlab.operators.flow.late_fragments` gives it. A delivered
    album is remembered for ``remember`` seconds after its last fragment; what comes later begins a new one."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told = []
        if state.hasTimedOut:
            state.remove()
        else:
            last, generation, closed = state.get if state.exists else (None, 1, False)
            for t, i in sorted((t.timestamp(), i) for b in batches for t, i in zip(b[time], b[order], strict=True)):
                gap = 0 if last is None else t - last
                closed = closed or gap >= quiet + work
                again = not closed and gap >= quiet
                last, generation = t, generation + again
                told.append((*key, i, "refused" if closed else "restart" if again else "received", generation))
            state.update((last, generation, closed))
            state.setTimeoutTimestamp(max(int((last + remember) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(told, columns=[owner, album, order, "effect", "album_generation"])

    return fragments.withWatermark(time, delay).groupBy(owner, album).applyInPandasWithState(
        step, f"{owner} long, {album} long, {order} long, effect string, album_generation long", "last double, generation long, closed boolean", "append", GroupStateTimeout.EventTimeTimeout
    )
