"""Streams give what the batch operators give."""

import datetime as dt

import pandas as pd

from extractlab.operators import admission, flow
from extractlab.streaming import flows


def run(frame, folder):
    query = frame.writeStream.format("memory").queryName("out").option("checkpointLocation", str(folder)).trigger(availableNow=True).outputMode("append").start()
    assert query.awaitTermination(120)
    return frame.sparkSession.table("out").toPandas()


def source(spark, rows, folder):
    """One file for each row list, read in order of their names."""
    schema = "owner long, ts timestamp, event_id long"
    for i, part in enumerate(rows):
        frame = pd.DataFrame([(o, dt.datetime.fromtimestamp(t, dt.UTC), e) for o, t, e in part], columns=["owner", "ts", "event_id"])
        spark.createDataFrame(frame, schema).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_dedupe(spark, tmp_path):
    rows = [[(1, 100, 1), (1, 101, 1)], [(1, 102, 1), (2, 103, 1), (1, 104, 2)]]
    got = run(flows.deduplicated(source(spark, rows, tmp_path / "in"), "ts", ["owner", "event_id"]), tmp_path / "c")
    assert sorted(zip(got["owner"], got["event_id"], strict=True)) == [(1, 1), (1, 2), (2, 1)]


def test_sessions_match_the_batch_form(spark, tmp_path):
    rows = [[(1, 0, 1), (1, 899, 2), (2, 10, 3)], [(1, 1799, 4), (2, 500, 5)], [(1, 9000, 6), (2, 9000, 7)], [(3, 20_000, 8)]]
    rows = [[(o, t + 1_000_000, e) for o, t, e in part] for part in rows]  # the first watermark is at 0
    got = run(flows.inactivity_sessions(source(spark, rows, tmp_path / "in"), "owner", "ts", 900, "0 seconds"), tmp_path / "c")
    flat = spark.createDataFrame([x for part in rows for x in part], "owner long, t long, event_id long")
    wanted = {(r["owner"], r["start"], r["end"], r["events"]) for r in flow.sessions(flat, "owner", "t", "event_id", 900).collect()}
    found = {(int(r.owner), int(r.start), int(r.end), int(r.events)) for r in got.itertuples()}
    assert {w for w in wanted if w[1] < 1_009_000} <= found <= wanted


def events(spark, rows, folder):
    """Rows (owner, t, event_id, action), a file for each list of them."""
    schema = "owner long, ts timestamp, event_id long, action string"
    for i, part in enumerate(rows):
        frame = pd.DataFrame([(o, dt.datetime.fromtimestamp(t, dt.UTC), e, a) for o, t, e, a in part], columns=["owner", "ts", "event_id", "action"])
        spark.createDataFrame(frame, schema).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


STEPS = [
    [(1, 1_000_000, 1, "confirm"), (1, 1_000_010, 2, "stage"), (1, 1_000_909, 3, "show"), (2, 1_000_000, 4, "stage"), (2, 1_000_001, 5, "confirm")],
    [(1, 1_001_000, 6, "confirm"), (1, 1_001_000, 7, "confirm"), (2, 1_000_900, 8, "confirm"), (2, 1_001_800, 9, "confirm"), (2, 1_001_801, 10, "show")],
    [(1, 1_001_010, 11, "stage"), (1, 1_001_011, 12, "cancel"), (1, 1_001_012, 13, "show"), (2, 1_001_802, 14, "stage"), (2, 1_001_803, 15, "confirm")],
]
OUTCOMES = ["expired", "staged", "shown", "staged", "saved", "saved", "repeated", "repeated", "expired", "expired", "staged", "cancelled", "expired", "staged", "saved"]


def test_previews(spark, tmp_path):
    flat = spark.createDataFrame([x for part in STEPS for x in part], "owner long, t long, event_id long, action string")
    assert [r["outcome"] for r in flow.previews(flat, "owner", "t", "event_id", "action", 900).orderBy("event_id").collect()] == OUTCOMES
    got = run(flows.preview_outcomes(events(spark, STEPS, tmp_path / "in"), "owner", "ts", "event_id", "action", 900), tmp_path / "c")
    assert list(got.sort_values("event_id")["outcome"]) == OUTCOMES


def test_late_fragments(spark, tmp_path):
    times = [[(1, 1_000_000, 1), (1, 1_000_001, 2), (2, 1_000_000, 3)], [(1, 1_000_003, 4), (1, 1_000_004, 5), (2, 1_000_012, 6)], [(1, 1_000_015, 7), (1, 1_000_027, 8), (2, 1_000_013, 9)]]
    rows = [[(o, t, e, "x") for o, t, e in part] for part in times]
    flat = spark.createDataFrame([(o, 0, t, e) for part in times for o, t, e in part], "owner long, album long, t long, event_id long")
    wanted = [("received", 1), ("received", 1), ("received", 1), ("restart", 2), ("received", 2), ("refused", 1), ("restart", 3), ("refused", 3), ("refused", 1)]
    assert [r[3:] for r in flow.late_fragments(flat, ["owner", "album"], "t", "event_id", 2, 10).orderBy("event_id").collect()] == wanted
    stream = events(spark, rows, tmp_path / "in").selectExpr("owner", "0L AS album", "ts", "event_id")
    got = run(flows.late_fragments(stream, "owner", "album", "ts", "event_id", 2, 10, 900), tmp_path / "c").sort_values("event_id")
    assert list(zip(got["effect"], got["album_generation"], strict=True)) == wanted


def test_admissions(spark, tmp_path):
    """(service, id, owner, start, end): a refused request takes no place, in the batch and while requests arrive."""
    base = 1_000_000
    parts = [
        [(1, 1, 7, 0, 100), (1, 2, 7, 50, 150), (2, 3, 7, 0, 9000)], [(1, 4, 7, 120, 200), (1, 5, 8, 130, 400), (1, 6, 9, 140, 150), (2, 7, 7, 8000, 8100)],
        [(1, 8, 9, 150, 500), (1, 9, 6, 199, 210), (2, 10, 7, 9000, 9100)],
    ]
    flat = [x for part in parts for x in part]
    batch = spark.createDataFrame(flat, "service long, id long, owner long, t long, e long")
    wanted = {r["id"]: (r["active"], r["own"], r["decision"]) for r in admission.admission(batch, "service", "owner", "t", "e", jobs=2).collect()}
    assert {d for _, _, d in wanted.values()} == {"admitted", "busy", "active_document"}
    schema = "service long, id long, owner long, t timestamp, e timestamp"
    for i, part in enumerate(parts):
        rows = [(s, k, o, *(dt.datetime.fromtimestamp(base + x, dt.UTC) for x in (t, e))) for s, k, o, t, e in part]
        spark.createDataFrame(pd.DataFrame(rows, columns=["service", "id", "owner", "t", "e"]), schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = run(flows.admissions(stream, "service", "owner", "t", "e", jobs=2, delay="10 days"), tmp_path / "c")
    assert {r.id: (r.active, r.own, r.decision) for r in got.itertuples()} == wanted
