"""Rules that depend on their own past, kept as state for each key: over tables and over streams alike.

A machine is a function (state, event) -> (state, outputs): state is None at first and else what JSON can hold;
event is a dict of the row. Events of a key are taken in the order of t_ms.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StructType

from vistaframe.streaming.sensors import HALF_LIFE_MS, LEAST_WEIGHT

Machine = Callable[[dict | None, dict], tuple[dict | None, dict]]

# fixed values, in degrees, metres and milliseconds
BAND_DEG, BAND_HOLD = 20, 3
BIG, SMALL, DISTURBED_MS = 15, 8, 180_000
SURE_DEG, AGREE_DEG, CONFIRM_MS = 1.5, 1.0, 15_000
PITCH_MOST, SHARE = 20.0, 0.5
SAMPLE_MS, SAMPLE_MOST_MS, SAMPLE_M, SAMPLE_DEG = 20_000, 120_000, 200, 8
MOVE_M, MOVE_MS, ACCURACY_M = 120, 15_000, 100
UNVERIFIED_MS = 60_000
TILT_MS, TILT_KEPT = 180_000, 40
LEARN_DEG, OFF_DEG, OFF_SHARE = 15, 8, 0.2
SOURCE_WEIGHT = {"skyline": 1.0, "stars": 1.0, "tower": 0.8, "pano": 0.7, "sun": 0.6, "moon": 0.6, "pitch": 0.5}


def turn(a: float, b: float) -> float:
    """Degrees from b to a, the shorter way, in (-180, 180]; with the operations of the SQL in their order, so that turns by half
    the ring go the same way."""
    x = a - b
    if not math.isfinite(x):
        return math.nan
    d = x - 360 * math.floor(x / 360)
    return d - 360 if d > 180 else d


def pitch_band(state, e):
    """band of a pitch: down, level or up; the last one holds within 3 degrees of a border."""
    p, was = e["pitch"], (state or {}).get("band")
    band = "down" if p < -BAND_DEG else "up" if p > BAND_DEG else "level"
    if was and band != was and any(abs(p - b) < BAND_HOLD for b in (-BAND_DEG, BAND_DEG)):
        near = {("down", "level"), ("level", "down")} if p < 0 else {("up", "level"), ("level", "up")}
        band = was if (was, band) in near else band
    return {"band": band}, {"band": band}


def compass_disturbed(state, e):
    """disturbed: two corrections over 15 degrees within 3 minutes, for 3 minutes or until one under 8."""
    s = state or {"big": [], "until": 0}
    t, size = e["t_ms"], abs(e["correction"])
    until = s["until"] if t <= s["until"] else 0
    if size > BIG:
        big = [x for x in s["big"] if t - x < DISTURBED_MS] + [t]
        s = {"big": big, "until": t + DISTURBED_MS if len(big) > 1 else until}
    else:
        s = {"big": [], "until": 0} if size < SMALL else {"big": s["big"], "until": until}
    return s, {"disturbed": s["until"] > 0}


def confirm_heading(state, e):
    """confirmed: small corrections at once, larger ones when the one before, up to 15 s ago, agreed."""
    if abs(e["d_heading"]) < SURE_DEG:
        return state, {"confirmed": True}
    t, target = e["t_ms"], e["offset"] + e["d_heading"]
    ok = state is not None and t - state["t"] < CONFIRM_MS and abs(turn(target, state["target"])) < AGREE_DEG
    return {"target": target, "t": t}, {"confirmed": ok}


def apply_correction(state, e):
    """offsets after half of each correction: heading round the ring, pitch within 20 degrees."""
    s = state or {"heading": 0.0, "pitch": 0.0}
    h = turn(s["heading"] + SHARE * e["d_heading"], 0)
    p = max(-PITCH_MOST, min(PITCH_MOST, s["pitch"] + SHARE * e["d_pitch"]))
    return {"heading": h, "pitch": p}, {"offset_heading": h, "offset_pitch": p}


def _metres(a: dict, b: dict) -> float:
    p, q = math.radians(a["lat"]), math.radians(b["lat"])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b["lon"] - a["lon"]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1.0, math.sqrt(x)))


def training_sampler(state, e):
    """kept: 20 s after the last one kept, if moved over 200 m, turned over 8 degrees or 2 minutes have passed."""
    keep = state is None or e["t_ms"] - state["t_ms"] >= SAMPLE_MS and (
        _metres(state, e) > SAMPLE_M or abs(turn(e["heading"], state["heading"])) > SAMPLE_DEG or e["t_ms"] - state["t_ms"] > SAMPLE_MOST_MS
    )
    return ({k: e[k] for k in ("t_ms", "lat", "lon", "heading")} if keep else state), {"kept": keep}


def recompute_trigger(state, e):
    """recompute: a place accurate to 100 m, 120 m or more from the last used one and 15 s or more later."""
    if e["accuracy"] is None or e["accuracy"] > ACCURACY_M:
        return state, {"recompute": False}
    go = state is None or e["t_ms"] - state["t_ms"] >= MOVE_MS and _metres(state, e) >= MOVE_M
    return ({k: e[k] for k in ("t_ms", "lat", "lon")} if go else state), {"recompute": go}


def unverified_heading(state, e):
    """hint where no heading has matched for 60 s: sun if it stands 3 to 60 degrees high, else pan."""
    fresh = state is None or e["matched"]
    now = {"since": e["t_ms"], "told": False} if fresh else dict(state)
    now["sun_alt"] = e["sun_alt"]
    late = not e["matched"] and e["t_ms"] - now["since"] >= UNVERIFIED_MS
    return now | {"told": now["told"] or late}, {"hint": _way(now["sun_alt"]) if late else None}


def _way(sun_alt: float | None) -> str:
    return "sun" if sun_alt is not None and 3 <= sun_alt <= 60 else "pan"


def sensor_profile_update(state, e):
    """learned_heading, learned_pitch and n after each correction (source, heading, pitch; null: none): means whose weights
    halve in 21 days, null below a weight of 3. Headings beyond 15 degrees don't count; one over 8 degrees off the
    learned one makes its correction count a fifth."""
    s = state or {"hs": 0.0, "hc": 0.0, "hw": 0.0, "ps": 0.0, "pw": 0.0, "t": e["t_ms"]}
    left = 0.5 ** (max(0, e["t_ms"] - s["t"]) / HALF_LIFE_MS)
    s = {k: v * left for k, v in s.items() if k != "t"} | {"t": e["t_ms"]}
    h, p, w = e["heading"], e["pitch"], SOURCE_WEIGHT.get(e["source"], 0.0)
    if h is not None and abs(h) > LEARN_DEG:
        h = None
    if h is not None and s["hw"] >= LEAST_WEIGHT and abs(turn(h, math.degrees(math.atan2(s["hs"], s["hc"])))) > OFF_DEG:
        w *= OFF_SHARE
    if h is not None:
        s |= {"hs": s["hs"] + w * math.sin(math.radians(h)), "hc": s["hc"] + w * math.cos(math.radians(h)), "hw": s["hw"] + w}
    if p is not None:
        s |= {"ps": s["ps"] + w * p, "pw": s["pw"] + w}
    known = {
        "learned_heading": math.degrees(math.atan2(s["hs"], s["hc"])) if s["hw"] >= LEAST_WEIGHT else None,
        "learned_pitch": s["ps"] / s["pw"] if s["pw"] >= LEAST_WEIGHT else None,
        "n": max(s["hw"], s["pw"]),
    }
    return s, known


def tilt_calibration(state, e):
    """fov (mean of up to ten calibrations) and tilt of a line through the last samples with the same fov; both
    null where there is none. tan(fov / 2) grows with the line's slope."""
    s = state or {"samples": [], "fov": e["fov"], "n": 0}
    samples = [x for x in s["samples"] if e["t_ms"] - x[0] < TILT_MS and x[3] == s["fov"]][-TILT_KEPT:]
    samples.append([float(e["t_ms"]), e["axis"], e["pitch"], s["fov"]])
    xs, ys = [x[1] for x in samples], [x[2] for x in samples]
    n = len(xs)
    if n >= 8 and max(xs) - min(xs) >= 8:
        mx, my = sum(xs) / n, sum(ys) / n
        k = sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / sum((x - mx) ** 2 for x in xs)
        c = my - k * mx
        rms = math.sqrt(sum((y - c - k * x) ** 2 for x, y in zip(xs, ys)) / n)
        if rms <= 0.25 and abs(k) <= 0.3:
            seen = min(120.0, max(30.0, math.degrees(2 * math.atan(math.tan(math.radians(s["fov"] / 2)) * (1 + k)))))
            weight = min(9, s["n"])
            fov = (s["fov"] * weight + seen) / (weight + 1)
            return {"samples": [], "fov": fov, "n": s["n"] + 1}, {"fov_fit": fov, "tilt": max(-PITCH_MOST, min(PITCH_MOST, c))}
    return {**s, "samples": samples}, {"fov_fit": None, "tilt": None}


#: Outputs of each machine, as SQL columns.
OUTPUTS = {
    pitch_band: "band string",
    compass_disturbed: "disturbed boolean",
    confirm_heading: "confirmed boolean",
    apply_correction: "offset_heading double, offset_pitch double",
    training_sampler: "kept boolean",
    recompute_trigger: "recompute boolean",
    unverified_heading: "hint string",
    tilt_calibration: "fov_fit double, tilt double",
    sensor_profile_update: "learned_heading double, learned_pitch double, n double",
}
#: What each machine remembers.
STATE = {
    pitch_band: "band string",
    compass_disturbed: "big array<long>, until long",
    confirm_heading: "target double, t long",
    apply_correction: "heading double, pitch double",
    training_sampler: "t_ms long, lat double, lon double, heading double",
    recompute_trigger: "t_ms long, lat double, lon double",
    unverified_heading: "since long, told boolean, sun_alt double",
    tilt_calibration: "samples array<array<double>>, fov double, n long",
    sensor_profile_update: "hs double, hc double, hw double, ps double, pw double, t long",
}


class Timer(NamedTuple):
    """What a state has due: at which time (None: nothing), and the state and outputs then."""

    due: Callable[[dict], int | None]
    fire: Callable[[dict], tuple[dict, dict]]


#: Alerts that end, and hints that come, when no event does.
TIMERS = {
    compass_disturbed: Timer(lambda s: s["until"] + 1 if s["until"] else None, lambda s: ({**s, "until": 0}, {"disturbed": False})),
    unverified_heading: Timer(lambda s: None if s["told"] else s["since"] + UNVERIFIED_MS, lambda s: ({**s, "told": True}, {"hint": _way(s["sun_alt"])})),
}


def replay(events: DataFrame, key: str, machine: Machine, gives: str | None = None) -> DataFrame:
    """events (key, t_ms and what the machine reads) with the machine's outputs (`gives`, DDL).

    Rows of equal time are taken in the order of their other columns. Partitions are sorted by Spark, which spills,
    and read batch by batch: a task holds a batch and the machine's state, however many rows a key has."""
    new = StructType.fromDDL(gives or OUTPUTS[machine]).fields
    order = [f.name for f in events.schema.fields if f.name not in (key, "t_ms") and not isinstance(f.dataType, MapType)]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        first, at, state = True, None, None
        for b in batches:
            out = []
            for e in b.to_pylist():
                if first or e[key] != at:
                    first, at, state = False, e[key], None
                state, given = machine(state, e)
                out.append(given)
            added = [pa.array([g[f.name] for g in out], to_arrow_type(f.dataType)) for f in new]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, *(f.name for f in new)])

    return events.repartition(key).sortWithinPartitions(key, "t_ms", *order).mapInArrow(run, StructType([*events.schema.fields, *new]))


def stream(events: DataFrame, key: str, machine: Machine, gives: str | None = None, ttl_ms: int | None = None) -> DataFrame:
    """The same on a stream; events not later than a key's last one are dropped. With ttl_ms, a key without events
    for so long (by the clock) is forgotten and starts anew."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    new = StructType.fromDDL(gives or OUTPUTS[machine]).fields
    # pandas would make doubles of long values beside nulls
    longs = [f.name for f in events.schema.fields if isinstance(f.dataType, LongType) and f.name not in (key, "t_ms")]
    x = events.withColumns({c: F.col(c).cast("string") for c in longs})
    schema = StructType([*x.schema.fields, *new])

    def step(_, batches, held):
        if held.hasTimedOut:
            held.remove()
            return
        last, state = json.loads(held.get[0]) if held.exists else (None, None)
        pdf = pd.concat(list(batches)).sort_values("t_ms", kind="stable")
        if last is not None:
            pdf = pdf[pdf.t_ms > last]
        if len(pdf):
            out = []
            for e in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                state, given = machine(state, {**e, **{c: None if e[c] is None else int(e[c]) for c in longs}})
                out.append(given)
            held.update((json.dumps([int(pdf.t_ms.max()), state]),))
            yield pd.concat([pdf, pd.DataFrame(out, index=pdf.index, columns=[f.name for f in new])], axis=1)
        if ttl_ms and held.exists:
            held.setTimeoutDuration(ttl_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    got = x.groupBy(key).applyInPandasWithState(step, schema, "held string", "append", timeout)
    return got.withColumns({c: F.col(c).cast("long") for c in longs})
