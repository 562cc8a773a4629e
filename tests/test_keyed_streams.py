"""Streams whose events come late, out of order, or not at all."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vistaframe.streaming import keyed, machines, sensors

END = 10**9


class Feed:
    """A folder that a stream reads a file at a time."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0
        (folder / "in").mkdir()

    def source(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")

    def run(self, make, name, *batches, mode="append"):
        for rows in batches:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in/")
            self.n += 1
        q = make(self.source()).writeStream.outputMode(mode).option("checkpointLocation", f"{self.folder}/cp")
        out = f"{self.folder}/out"
        q = q.foreachBatch(lambda df, i: df.write.mode("append").parquet(out)).start()
        q.processAllAvailable()
        q.stop()
        return self.spark.read.parquet(out).collect()


def walked(rows, machine, passed):
    """Events (k, t, fields) in order, with timers between them, up to the time passed."""
    timer, out = machines.TIMERS.get(machine), []
    for k in sorted({r["k"] for r in rows}):
        state = None

        def fire(until):
            nonlocal state
            while timer and state is not None and timer.due(state) is not None and timer.due(state) <= until:
                t = timer.due(state)
                state, given = timer.fire(state)
                out.append((k, t, *given.values(), True))

        for e in sorted((r for r in rows if r["k"] == k and r["t_ms"] <= passed), key=lambda r: r["t_ms"]):
            fire(e["t_ms"])
            state, given = machine(state, e)
            out.append((k, e["t_ms"], *given.values(), False))
        fire(passed)
    return sorted(out, key=str)


def shuffled(r, rows, spread):
    """Rows in files, each at most `spread` ms late."""
    late = sorted(rows, key=lambda x: x["t_ms"] + r.random() * spread)
    cut = len(late) // 3
    return late[:cut], late[cut : 2 * cut], late[2 * cut :]


def test_alerts_end_and_hints_come_by_the_watermark_alone(spark, tmp_path):
    feed = Feed(spark, tmp_path, "k long, t_ms long, correction double")
    big = [{"k": 1, "t_ms": 1_000_000, "correction": 20.0}, {"k": 1, "t_ms": 1_050_000, "correction": -30.0}]
    others = lambda t: [{"k": 2, "t_ms": t, "correction": 1.0}]
    made = lambda s: keyed.ordered(s, "k", machines.compass_disturbed)
    rows = feed.run(made, "alerts", big, others(1_150_000), others(1_300_000), others(1_310_000))
    got = [(x.t_ms, x.disturbed, x.timer) for x in rows if x.k == 1]
    assert sorted(got) == [(1_000_000, False, False), (1_050_000, True, False), (1_230_001, False, True)]


def test_a_hint_comes_once_and_a_restart_goes_on(spark, tmp_path):
    feed = Feed(spark, tmp_path, "k long, t_ms long, matched boolean, sun_alt double")
    event = lambda k, t, m, s: {"k": k, "t_ms": t, "matched": m, "sun_alt": s}
    made = lambda s: keyed.ordered(s, "k", machines.unverified_heading)
    feed.run(made, "hints", [event(1, 500_000, True, 20.0), event(3, 500_000, False, None)], [event(2, 540_000, True, 1.0)])
    rows = feed.run(made, "hints", [event(2, 600_000, True, 1.0)], [event(2, 720_000, True, 1.0)], [event(2, 730_000, True, 1.0)])
    got = sorted((x.k, x.t_ms, x.hint, x.timer) for x in rows if x.k != 2)
    assert got == [(1, 500_000, None, False), (1, 560_000, "sun", True), (3, 500_000, None, False), (3, 560_000, "pan", True)]


@pytest.mark.parametrize("machine", [machines.compass_disturbed, machines.sensor_profile_update, machines.tilt_calibration])
def test_shuffled_events_give_what_the_sorted_ones_do(spark, tmp_path, machine):
    r = random.Random(6)
    make = {
        machines.compass_disturbed: ("correction double", lambda: {"correction": r.choice([1.0, 10.0, 20.0, -30.0])}, 25_000),
        machines.sensor_profile_update: ("source string, heading double, pitch double", lambda: {"source": r.choice(["skyline", "tower", "sun"]), "heading": r.choice([None, 2.0, 12.0, 20.0]), "pitch": r.choice([None, 1.0])}, 3_000),
        machines.tilt_calibration: ("axis double, pitch double, fov double", lambda: (lambda a: {"axis": a, "pitch": 1 + 0.1 * a, "fov": 60.0})(r.uniform(-9, 9)), 4_000),
    }
    columns, fields, step = make[machine]
    rows = [{"k": k, "t_ms": 10**6 + i * step + r.randrange(step), **fields()} for k in (1, 2) for i in range(24)]
    feed = Feed(spark, tmp_path, f"k long, t_ms long, {columns}")
    last = max(x["t_ms"] for x in rows)
    blank = {c.split()[0]: None for c in columns.split(", ")} | ({"correction": 1.0} if "correction" in columns else {"axis": 0.0, "pitch": 0.0, "fov": 60.0} if "axis" in columns else {})
    ticks = [[{"k": 9, "t_ms": last + 400_000, **blank}], [{"k": 9, "t_ms": last + 401_000, **blank}]]
    found = feed.run(lambda s: keyed.ordered(s, "k", machine), "shuffled", *shuffled(r, rows, 10_000), *ticks)
    gives = [c.split()[0] for c in machines.OUTPUTS[machine].split(", ")]
    got = sorted(((x.k, x.t_ms, *(x[g] for g in gives), x.timer) for x in found if x.k < 9), key=str)
    assert got == walked(rows, machine, last + 390_000)
    table = machines.replay(spark.createDataFrame(rows, feed.schema), "k", machine).collect()
    assert sorted(((x.k, x.t_ms, *(x[g] for g in gives), False) for x in table), key=str) == [x for x in got if not x[-1]]
    assert len({x[2:] for x in got}) > 1


def test_learned_values_weigh_less_far_off():
    state, weeks = None, 21 * 86_400_000
    for i in range(4):
        state, out = machines.sensor_profile_update(state, {"t_ms": i, "source": "stars", "heading": 4.0, "pitch": None})
    assert abs(out["learned_heading"] - 4) < 1e-6 and abs(out["n"] - 4) < 1e-6 and out["learned_pitch"] is None
    far, out = machines.sensor_profile_update(state, {"t_ms": 4, "source": "skyline", "heading": 14.0, "pitch": None})
    assert abs(out["n"] - 4.2) < 1e-6
    near, out = machines.sensor_profile_update(state, {"t_ms": 4, "source": "tower", "heading": 10.0, "pitch": 2.0})
    assert abs(out["n"] - 4.8) < 1e-6
    _, out = machines.sensor_profile_update(state, {"t_ms": 4, "source": "sun", "heading": 15.5, "pitch": None})
    assert abs(out["n"] - 4) < 1e-6
    _, out = machines.sensor_profile_update(near, {"t_ms": 4 + weeks, "source": "sun", "heading": None, "pitch": 2.0})
    assert out["learned_heading"] is None and out["n"] < 3


def test_a_profile_on_a_stream_is_that_of_the_table(spark, tmp_path):
    r = random.Random(2)
    rows = [{"device_id": d, "t_ms": 10**6 + i * 2_000 + d, "az": r.choice([0.1, 10.2, 10.4, 200.0, 359.9]), "el": float(r.randrange(12))} for d in (1, 2) for i in range(90)]
    rows += [{"device_id": 1, "t_ms": 10**6 + 500, "az": 77.0, "el": 3.0}]  # a bin that falls silent
    feed = Feed(spark, tmp_path, "device_id long, t_ms long, az double, el double")
    found = feed.run(keyed.panorama_profile, "profile", *shuffled(r, rows, 9_000), mode="update")
    state = {}
    for x in sorted(found, key=lambda x: (x.as_of_ms, x.el is not None)):
        state[x.device_id, x.bin] = (x.el, x.az)
    for d in (1, 2):
        now = max(x["t_ms"] for x in rows if x["device_id"] == d)
        mine = spark.createDataFrame([x for x in rows if x["device_id"] == d], feed.schema)
        want = {(x.device_id, x.bin): (x.el, x.az) for x in sensors.panorama_profile(mine, F.lit(now)).collect()}
        assert {k: v for k, v in state.items() if k[0] == d and v[0] is not None} == want
    assert state[1, 154] == (None, None)
    # the devices fall silent; another one's events move the watermark
    ticks = [[{"device_id": 3, "t_ms": 2 * 10**6 + i, "az": 1.0, "el": 1.0}] for i in (0, 20_000)]
    found = feed.run(keyed.panorama_profile, "profile", *ticks, mode="update")
    last = {}
    for x in sorted(found, key=lambda x: (x.as_of_ms, x.el is not None)):
        last[x.device_id, x.bin] = x.el
    assert all(v is None for (d, _), v in last.items() if d < 3) and last[3, 2] == 1.0


def test_routes_of_a_table_and_of_a_stream_that_restarts_agree(spark, tmp_path):
    from vistaframe.streaming import fusion

    r = random.Random(12)
    schema = "device_id long, t_ms long, kind string, alpha double, heading double, pitch double, roll double, compass_heading double, accuracy double, held boolean"
    rows, t = [], 10**6
    for i in range(240):
        t += r.choice([20, 90, 250, 900]) if i % 40 else 3000
        absolute = r.random() < 0.25
        compass = None if absolute or r.random() < 0.8 else r.uniform(0, 360)
        rows.append((1 + i % 2, t, "absolute" if absolute else "relative", r.uniform(0, 360), r.choice([None, r.uniform(0, 360)]) if i % 9 == 0 else r.uniform(0, 360), 1.0, 2.0, compass, r.choice([None, -1.0, 5.0]), r.random() < 0.2))
    names = [c.split()[0] for c in schema.split(", ")]
    events = [dict(zip(names, x)) for x in rows]
    outs = ("route", "out_heading", "out_pitch", "out_roll")
    want = {}
    for d in (1, 2):
        state = None
        for e in (x for x in events if x["device_id"] == d):
            state, given = fusion.routed(state, e)
            want[d, e["t_ms"]] = tuple(given.values())
    assert {x[0] for x in want.values()} == {None, "absolute", "compass", "relative", "fused"}

    def same(found):
        for x in found:
            a, b = tuple(x[o] for o in outs), want[x.device_id, x.t_ms]
            assert a[0] == b[0] and a[2:] == b[2:] and (a[1] is None) == (b[1] is None)
            assert a[1] is None or abs((a[1] - b[1] + 180) % 360 - 180) < 1e-9

    table = fusion.orientation_route(spark.createDataFrame(events, schema)).collect()
    assert len(table) == len(events)
    same(table)
    feed = Feed(spark, tmp_path, schema)
    make = lambda s: fusion.orientation_route(s, streaming=True)
    one, two, three = shuffled(r, events, 8_000)
    feed.run(make, "routes", one, two)
    tick = lambda ms: [dict(events[0], device_id=3, t_ms=t + ms)]
    found = [x for x in feed.run(make, "routes", three, tick(50_000), tick(51_000)) if x.device_id < 3]
    assert len(found) == len(events)
    same(found)


def test_headings_fused_on_a_stream(spark, tmp_path):
    from vistaframe.streaming import fusion

    r = random.Random(1)
    schema = "device_id long, t_ms long, kind string, heading double"
    events = [{"device_id": 1, "t_ms": 10**6 + i * 70 + r.randrange(60), "kind": r.choice(["compass", "gyro"]), "heading": r.uniform(0, 360)} for i in range(150)]
    want = {x.t_ms: x.fused for x in fusion.heading_fusion(spark.createDataFrame(events, schema)).collect()}
    feed = Feed(spark, tmp_path, schema)
    ticks = [[{"device_id": 2, "t_ms": 2 * 10**6 + i, "kind": "compass", "heading": 1.0}] for i in (0, 10)]
    found = {x.t_ms: x.fused for x in feed.run(lambda s: fusion.heading_fusion(s, streaming=True), "fused", *shuffled(r, events, 5_000), *ticks)}
    assert found.keys() == want.keys() and all((v is None) == (found[t] is None) and (v is None or abs((v - found[t] + 180) % 360 - 180) < 1e-9) for t, v in want.items())
    assert sum(v is not None for v in want.values()) > 20
