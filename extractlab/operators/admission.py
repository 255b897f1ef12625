"""Decisions that depend on earlier decisions: places in a service, locked owners, alerts with a cool-down.

Each is a fold in order whose state is small and bounded. A long line is cut where the state is certainly empty
(nothing that came before can still matter), so that the pieces are folded apart, whatever their key. The cuts
come from running maxima in two steps, over blocks of time and within them, never from one window over the whole line.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from extractlab.operators.ordered import in_order

#: Jobs that run at once, and the codes of refusals.
ADMITTED_JOBS = 8
ACTIVE, BUSY = "active_document", "busy"
#: Failed sign-ins that lock an owner, failures in all that raise an alert, and the window of both.
LOCK_FAILURES, LOCK_WINDOW, GLOBAL_SURGE = 5, 900, 30
#: Seconds of a block; only a unit of work, results do not depend on it.
BLOCK = 86_400


def running_before(rows: DataFrame, line: str, time: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Column ``name``: the largest ``value`` of the rows before each one on its line, null for the first."""
    rows = rows.withColumn("_value", value).withColumn("_block", F.floor(F.col(time) / BLOCK))
    tops = rows.groupBy(line, "_block").agg(F.max("_value").alias("_top"))
    earlier = Window.partitionBy(line).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(F.col(line).alias("_line"), F.col("_block").alias("_at"), F.max("_top").over(earlier).alias("_top"))
    within = Window.partitionBy(line, "_block").orderBy(time, *order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(tops, (F.col(line).eqNullSafe(F.col("_line"))) & (F.col("_block") == F.col("_at")))
    found = joined.withColumn(name, F.greatest(F.max("_value").over(within), "_top"))  # greatest passes over nulls
    return found.drop("_value", "_block", "_line", "_at", "_top")


def pieces(rows: DataFrame, line: str, time: str, order: list[str], until: Column) -> DataFrame:
    """Column ``piece``: lines cut before each row that begins when all earlier rows' ``until`` is over."""
    rows = running_before(rows, line, time, order, until, "_reach")
    opens = F.col("_reach").isNull() | (F.col("_reach") <= F.col(time))
    rows = running_before(rows.withColumn("_opens", F.when(opens, F.col(time))), line, time, order, F.col("_opens"), "_opened")
    began = F.coalesce("_opens", "_opened").cast("string")
    return rows.withColumn("piece", F.concat_ws("/", F.coalesce(F.col(line).cast("string"), F.lit("")), began)).drop("_reach", "_opens", "_opened")


class Places:
    """The jobs that run, at most as many as there are places: (end, owner)."""

    def __init__(self, running: list[tuple[float, int]], jobs: int):
        self.running, self.jobs = running, jobs

    def decide(self, owner: int, start: float, end: float) -> tuple[int, int, str]:
        """How many run, how many of them are the owner's, and the decision. Only who is admitted takes a place."""
        self.running = [r for r in self.running if r[0] > start]
        own = sum(r[1] == owner for r in self.running)
        active = len(self.running)
        if own:
            return active, own, ACTIVE
        if active >= self.jobs:
            return active, own, BUSY
        self.running.append((end, owner))
        return active, own, "admitted"


def admission(requests: DataFrame, service: str, owner: str, start: str, end: str, jobs: int = ADMITTED_JOBS) -> DataFrame:
    """Requests (``id``, service, owner, start, end) with what runs in their service when they start, and the decision.
    A job that ends just then no longer runs; equal starts are taken in the order of ``id``. A service's line is cut
    where all earlier requests, also refused ones, would be over."""
    kinds = dict(requests.dtypes)

    def fold(group: Iterator[tuple]) -> Iterator[tuple]:
        places = Places([], jobs)
        for _, i, who, begin, until in group:
            yield (i, *places.decide(who, begin, until))

    cut = pieces(requests.select("id", service, owner, start, end), service, start, ["id"], F.col(end))
    return in_order(cut.select("piece", "id", owner, start, end), "piece", [start, "id"], fold, f"id {kinds['id']}, active int, own int, decision string")


def lockouts(attempts: DataFrame, failures: int = LOCK_FAILURES, window: int = LOCK_WINDOW) -> DataFrame:
    """Sign-in attempts (owner, t, event_id, correct) with what each comes to, and how long a locked owner must wait. An
    attempt while locked is not recorded. An owner's line is cut where ``window`` has passed since the last attempt."""

    def fold(group: Iterator[tuple]) -> Iterator[tuple]:
        held: deque[int] = deque()
        for _, owner, t, event, correct in group:
            while held and held[0] <= t - window:
                held.popleft()
            if len(held) >= failures:
                yield owner, t, event, "locked", held[0] + window - t, False
            elif correct:
                held.clear()
                yield owner, t, event, "accepted", None, False
            else:
                held.append(t)
                full = len(held) >= failures
                yield owner, t, event, "locked" if full else "refused", held[0] + window - t if full else None, True

    cut = pieces(attempts.select("owner", "t", "event_id", "correct"), "owner", "t", ["event_id"], F.col("t") + window)
    schema = "owner bigint, t bigint, event_id bigint, result string, retry_after bigint, recorded boolean"
    return in_order(cut.select("piece", "owner", "t", "event_id", "correct"), "piece", ["t", "event_id"], fold, schema)


def alerts(recorded: DataFrame, time: str, order: str, surge: int = GLOBAL_SURGE, window: int = LOCK_WINDOW) -> DataFrame:
    """(time, order): the recorded failures that raise an alert: at least ``surge`` of them, itself included, in the ``window``
    seconds up to it, and no alert in that time. Failures are counted in blocks of that length, each with
    a copy of the one before; the candidates are cut where the window has passed since the one before."""
    block = F.floor(F.col(time) / window)
    dealt = recorded.select(time, order).withColumn("_own", block).withColumn("_block", F.explode(F.array(block, block + 1)))
    # Of equal times those that come later in order aren't counted yet: ranks within the block tell them apart.
    by = Window.partitionBy("_block").orderBy(time, order)
    ranked = dealt.withColumn("_rank", F.row_number().over(by))
    old = F.coalesce(F.max("_rank").over(Window.partitionBy("_block").orderBy(time).rangeBetween(Window.unboundedPreceding, -window)), F.lit(0))
    full = ranked.withColumn("_recent", F.col("_rank") - old).where((F.col("_own") == F.col("_block")) & (F.col("_recent") >= surge))

    def fold(group: Iterator[tuple]) -> Iterator[tuple]:
        last = None
        for _, t, i in group:
            if last is None or last <= t - window:
                last = t
                yield t, i

    kinds = dict(recorded.dtypes)
    cut = pieces(full.select(time, order, F.lit(0).alias("line")), "line", time, [order], F.col(time) + window)
    return in_order(cut.select("piece", time, order), "piece", [time, order], fold, f"{time} {kinds[time]}, {order} {kinds[order]}")
