"""Event flows in batch form: deduplication, sessions, fences, admission, scheduling, limits."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from extractlab.operators.ordered import in_order

#: Fixed values, in seconds: silence that ends a session, the album's quiet time, the lock window.
INACTIVITY, ALBUM_QUIET, LOCK_WINDOW = 900, 2, 900
LOCK_FAILURES = 5


def first_of_each(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first event of each key; a repeated one is handled once."""
    return events.groupBy(*keys).agg(F.min(order).alias(order), F.count("*").alias("seen"))


def sessions(events: DataFrame, owner: str | list[str], time: str, order: str, gap: int) -> DataFrame:
    """Runs of an owner's (or several keys') events less than ``gap`` apart: silence of just the gap ends one."""
    owner = [owner] if isinstance(owner, str) else owner
    by = Window.partitionBy(*owner).orderBy(time, order)
    new = F.coalesce(F.col(time) - F.lag(time).over(by) >= gap, F.lit(True))
    rows = events.withColumn("_new", new).withColumn("session", F.sum(F.when(F.col("_new"), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*owner, "session").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("events"))


def stale(events: DataFrame, owner: str, time: str, started: Column) -> DataFrame:
    """Owners with events from before the start: how many are ignored; one notice goes to each."""
    return events.where(F.col(time) < started).groupBy(owner).agg(F.count("*").alias("ignored"), F.min(time).alias("notice"))


def current(events: DataFrame, generation: str, latest: str) -> DataFrame:
    """Events of the owner's present generation."""
    return events.where(F.col(generation) == F.col(latest))


def album_order(parts: DataFrame, set_key: str, album: str, arrival: str, message: str) -> DataFrame:
    """Members of one album sorted by message into the places that the album holds in its set."""
    by = Window.partitionBy(set_key, album)
    places = parts.select(set_key, album, F.col(arrival).alias("place"), F.row_number().over(by.orderBy(arrival)).alias("_n"))
    members = parts.select(set_key, album, message, F.row_number().over(by.orderBy(message, arrival)).alias("_n"))
    return places.join(members, [set_key, album, "_n"]).select(set_key, "place", album, message)


def remembered(uploads: DataFrame, closed: DataFrame, keys: list[str], ttl: int) -> DataFrame:
    """Uploads of an album that closed less than ``ttl`` before."""
    hit = uploads.join(closed.select(*keys, F.col("t").alias("_closed")), keys).where((F.col("t") > F.col("_closed")) & (F.col("t") < F.col("_closed") + ttl))
    return hit.select(*keys, "event_id").distinct()


def ring(requests: DataFrame, job: str, admission: str, order: str) -> DataFrame:
    """Turns when all calls are ready: every job's k-th call in round k, by admission."""
    turn = F.row_number().over(Window.partitionBy(job).orderBy(order))
    return requests.withColumn("round", turn.cast("long")).select(job, admission, order, "round")


def transitions(checks: DataFrame, component: str, order: str, status: str) -> DataFrame:
    """Checks that change a component's status; the first counts if it is bad."""
    before = F.coalesce(F.lag(status).over(Window.partitionBy(component).orderBy(order)), F.lit(True))
    return checks.withColumn("_before", before).where(F.col(status) != F.col("_before")).select(component, order, status)


def running_quota(chunks: DataFrame, key: str, order: str, size: str, limit: int) -> DataFrame:
    """The first chunk with which a file exceeds its limit."""
    total = F.sum(size).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    over = chunks.withColumn("total", total).where(F.col("total") > limit)
    return over.groupBy(key).agg(F.min(order).alias(order), F.min("total").alias("total"))


def settled(t: Column, part_attempt: Column, outcome: Column, retry_after: Column, ended: Column, deadline: Column, cancelled: Column, attempts: int) -> Column:
    """What one attempt to send a part settles for the whole delivery, null if nothing: a part that is confirmed, or refused
    with a pause after which there are an attempt and time left, lets it go on. ``cancelled``: when, or null."""
    out_of_time = (part_attempt >= attempts) | (ended + retry_after >= deadline)
    return (
        F.when(cancelled <= t, "cancelled").when(t >= deadline, "failed").when(outcome == "confirmed", F.lit(None))
        .when(outcome == "skipped", "cancelled").when(outcome == "forbidden", "blocked").when(outcome == "api_error", "failed")
        .when(outcome == "retry_after", F.when(out_of_time, "failed")).otherwise("uncertain")
    )


def delivered(log: DataFrame, key: str, parts: str, window: int, attempts: int) -> DataFrame:
    """How each delivery ends. ``log``: part and attempt (from 1), t and ended, outcome, retry_after, cancelled and the number of
    parts. The window runs from the first attempt. The first attempt that settles it decides and later ones don't
    count; with every part confirmed it is complete, else not finished. Partial sums only but for the deadline."""
    deadline = F.min("t").over(Window.partitionBy(key)) + window
    rows = log.withColumn("_deadline", deadline)
    c = F.col
    rows = rows.withColumn("_settled", settled(c("t"), c("attempt"), c("outcome"), c("retry_after"), c("ended"), c("_deadline"), c("cancelled"), attempts))
    place = F.struct("part", "attempt")
    first = F.min_by("_settled", F.when(c("_settled").isNotNull(), place))
    stop = F.min(F.when(c("_settled").isNotNull(), place))
    confirmed = F.count_distinct(F.when((c("outcome") == "confirmed") & c("_settled").isNull(), c("part")))
    found = rows.groupBy(key).agg(first.alias("_first"), stop.alias("_stop"), confirmed.alias("_confirmed"), F.max(parts).alias("_parts"))
    return found.select(key, F.coalesce("_first", F.when(c("_confirmed") >= c("_parts"), "complete").otherwise("unfinished")).alias("outcome"), c("_stop.part").alias("part"))


def admitted(files: DataFrame, page_times: DataFrame, budget: int, overhead: int) -> DataFrame:
    """Submissions whose pages fit the budget. ``page_times`` has a row for each file kind only."""
    cost = files.join(page_times, "kind").groupBy("submission").agg((F.sum(F.col("pages") * F.col("cost")) + overhead).alias("cost"))
    return cost.withColumn("admitted", F.col("cost") <= budget)


def busy_seconds(events: DataFrame, time: str, window: int) -> DataFrame:
    """For each second with events, how many fall in the ``window`` seconds that end with it. Seconds are dealt
    out in blocks of that length, each with a copy of the block before, so no task sees the whole line."""
    counts = events.groupBy(time).agg(F.count("*").alias("n"))
    block = F.floor(F.col(time) / window)
    dealt = counts.withColumn("_own", block).withColumn("_block", F.explode(F.array(block, block + 1)))
    by = Window.partitionBy("_block").orderBy(time).rangeBetween(-(window - 1), 0)
    return dealt.withColumn("recent", F.sum("n").over(by)).where(F.col("_own") == F.col("_block")).select(time, "n", "recent")


def retained(seen: DataFrame, owner: str, item: str, limit: int, keep: int) -> DataFrame:
    """Owners with more than ``limit`` items keep their ``keep`` largest, others all."""
    own = Window.partitionBy(owner)
    ranked = seen.withColumn("_rank", F.row_number().over(own.orderBy(F.col(item).desc()))).withColumn("_size", F.count("*").over(own))
    return ranked.where((F.col("_size") <= limit) | (F.col("_rank") <= keep)).select(owner, item)


def replayed(calls: DataFrame, budgets: DataFrame, case: str, order: str, seconds: str, rejects: Column) -> DataFrame:
    """How each case ends under each budget: timeout at the first call whose running total exceeds it, mixed at
    the first rejecting one if that comes first, else complete. Traces are scanned once for all budgets."""
    running = F.sum(seconds).over(Window.partitionBy(case).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = calls.withColumn("_spent", running).withColumn("_reject", rejects)
    # A handful of budgets: the policies to be replayed, not data.
    each = rows.crossJoin(F.broadcast(budgets)).groupBy(case, "budget").agg(
        F.min(F.when(F.col("_spent") > F.col("budget"), F.col(order))).alias("late"), F.min(F.when(F.col("_reject"), F.col(order))).alias("mixed")
    )
    late_first = F.col("late").isNotNull() & (F.col("mixed").isNull() | (F.col("late") <= F.col("mixed")))
    return each.select(case, "budget", F.when(late_first, "timeout").when(F.col("mixed").isNotNull(), "mixed").otherwise("complete").alias("state"))


def previews(events: DataFrame, owner: str, time: str, order: str, action: str, ttl: int = INACTIVITY) -> DataFrame:
    """(owner, order, outcome) of events that stage, show, confirm or cancel a preview. Staging replaces the owner's
    former preview. Silence of ``ttl`` or a cancellation ends it, and what then refers to it is ``expired``. The first
    confirmation is ``saved``, further ones are ``repeated`` and change nothing."""
    mine = Window.partitionBy(owner).orderBy(time, order)
    staged = F.col(action) == "stage"
    rows = events.withColumn("_n", F.sum(F.when(staged, 1).otherwise(0)).over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    one = Window.partitionBy(owner, "_n").orderBy(time, order)
    rows = rows.withColumn("_silent", F.coalesce(F.col(time) - F.lag(time).over(one) >= ttl, F.lit(False)))
    until, before = one.rowsBetween(Window.unboundedPreceding, 0), one.rowsBetween(Window.unboundedPreceding, -1)
    gone = (F.col("_n") == 0) | F.bool_or("_silent").over(until) | F.coalesce(F.bool_or(F.col(action) == "cancel").over(before), F.lit(False))
    confirms = F.when((F.col(action) == "confirm") & ~F.col("_gone"), 1).otherwise(0)
    rows = rows.withColumn("_gone", gone).withColumn("_saves", F.sum(confirms).over(until))
    outcome = (
        F.when(staged, "staged").when(F.col("_gone"), "expired").when(F.col(action) == "cancel", "cancelled")
        .when(F.col(action) == "show", "shown").when(F.col("_saves") == 1, "saved").otherwise("repeated")
    )
    return rows.select(owner, order, outcome.alias("outcome"))


def late_fragments(fragments: DataFrame, keys: list[str], time: str, order: str, quiet: int, work: int) -> DataFrame:
    """What each fragment of an album does to its job, and the job's generation. After ``quiet`` without a fragment the job
    starts, ``work`` later it delivers: a fragment between the two stops the pass and begins a new generation, one
    after the delivery is refused, and so is all that follows."""
    by = Window.partitionBy(*keys).orderBy(time, order)
    until = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = fragments.withColumn("_gap", F.coalesce(F.col(time) - F.lag(time).over(by), F.lit(0)))
    rows = rows.withColumn("_closed", F.bool_or(F.col("_gap") >= quiet + work).over(until))
    again = ~F.col("_closed") & (F.col("_gap") >= quiet)
    generation = F.sum(F.when(again, 1).otherwise(0)).over(until) + 1
    return rows.select(*keys, order, F.when(F.col("_closed"), "refused").when(again, "restart").otherwise("received").alias("effect"), generation.alias("album_generation"))
