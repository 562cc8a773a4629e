"""Headings from gyroscope and compass, smoothed angles and postures, as windows and small states of each device."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistaframe.functions.geo import delta_deg
from vistaframe.streaming import keyed
from vistaframe.streaming.machines import Machine, replay, stream, turn

# fixed values: time constants of the compass offset (s; the slower one while held), oldest gyro value for a compass
# value, gyro silence after which the compass speaks, compass silence after which the gyro has no north (ms), share of
# a new constant
TAU_S, HELD_TAU_S, GYRO_STALE_MS, GYRO_SILENT_MS, NORTH_STALE_MS, NORTH_SHARE = 4.0, 60.0, 200, 300, 2000, 0.05
#: Least cut-off (Hz) of heading, pitch and roll and its rise (Hz per degree a second), by source; of the speed.
SMOOTHING, SPEED_CUT = {"compass": ((0.06, 0.15, 0.1), 0.01), "fused": ((1.2, 1.5, 1.5), 0.05)}, 0.3
# fixed values of postures: a match this recent (ms) wins over learned values; most heading and pitch of these
MATCH_HOLDS_MS, LEARNED_HEADING, LEARNED_PITCH = 30_000, 15, 20


def drawn(offset: float | None, at: float | None, seen: float, t: float, held: bool) -> float:
    """The offset of gyro to compass at time t: the one seen first, later drawn to what is seen by the share of time that
    has passed."""
    if offset is None:
        return seen
    passed = min(1.0, max(0.0, (t - at) / 1000))
    return offset + turn(seen, offset) * (1 - math.exp(-passed / (HELD_TAU_S if held else TAU_S)))


DRIFT_STATE, DRIFT = "offset double, offset_t long, cos double, sin double", "offset double, north double"


def drift(state, e):
    """offset (gyro to compass) and north (the turn of a relative heading) after each event: seen moves the one, and
    north_seen, in degrees, is a new vector in the slow mean of the other."""
    s = dict.fromkeys(("offset", "offset_t", "cos", "sin")) | (state or {})
    if e["seen"] is not None:
        s |= {"offset": drawn(s["offset"], s["offset_t"], e["seen"], e["t_ms"], bool(e["held"])), "offset_t": e["t_ms"]}
    if e["north_seen"] is not None:
        for name, f in (("cos", math.cos), ("sin", math.sin)):
            new = f(math.radians(e["north_seen"]))
            s[name] = new if s[name] is None else s[name] + (new - s[name]) * NORTH_SHARE
    return s, {"offset": s["offset"], "north": None if s["cos"] is None else math.degrees(math.atan2(s["sin"], s["cos"]))}


def _before(what, when) -> Column:
    """The last value of `what` in a device's earlier rows where `when` holds."""
    w = Window.partitionBy("device_id").orderBy("t_ms", "_order").rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(when, what), ignorenulls=True).over(w)


def heading_fusion(events: DataFrame, streaming: bool = False) -> DataFrame:
    """(device_id, t_ms, fused) for gyro events of (device_id, t_ms, kind, heading, if known held): kind compass or gyro;
    null until a compass value has come within 200 ms after a gyro one. Compass events count before gyro ones of
    the same time; a null heading is no event. On a stream, rows come once the watermark has passed them.

    Over a table, a window finds the gyro value before each compass value; only the offset is state."""
    held = F.col("held") if "held" in events.columns else F.lit(False)
    x = events.where("heading IS NOT NULL").select("device_id", "t_ms", "kind", "heading", held.alias("held"))
    if streaming:
        out = keyed.ordered(x, "device_id", fused, "offset double", FUSED_STATE)
    else:
        x = x.withColumn("_order", F.struct("kind", "heading"))
        gyro = _before(F.struct("t_ms", "heading"), F.col("kind") == "gyro")
        x = x.withColumn("gyro", gyro)
        fresh = (F.col("kind") == "compass") & (F.col("t_ms") - F.col("gyro.t_ms") <= GYRO_STALE_MS)
        x = x.select("device_id", "t_ms", "kind", "heading", F.when(fresh, delta_deg("heading", "gyro.heading")).alias("seen"), "held", F.lit(None).cast("double").alias("north_seen"))
        out = replay(x, "device_id", drift, DRIFT)
    shown = F.col("heading") + F.col("offset")
    # not pmod: it turns what lies a rounding error below 0 into 0, the SQL into 360
    return out.where("kind = 'gyro'").select("device_id", "t_ms", (shown - 360 * F.floor(shown / 360)).alias("fused"))


FUSED_STATE = "gyro_t long, gyro double, offset double, offset_t long"


def fused(state, e):
    """heading_fusion's offset, event by event."""
    s = dict.fromkeys(("gyro_t", "gyro", "offset", "offset_t")) | (state or {})
    if e["kind"] == "gyro":
        s |= {"gyro_t": e["t_ms"], "gyro": e["heading"]}
    elif s["gyro_t"] is not None and e["t_ms"] - s["gyro_t"] <= GYRO_STALE_MS:
        s |= {"offset": drawn(s["offset"], s["offset_t"], turn(e["heading"], s["gyro"]), e["t_ms"], bool(e["held"])), "offset_t": e["t_ms"]}
    return s, {"offset": s["offset"]}


ROUTE = "route string, out_heading double, out_pitch double, out_roll double"
ROUTE_STATE = f"absolute long, plain long, gyro_t long, gyro double, {DRIFT_STATE}"
_NAMES = [c.split()[0] for c in ROUTE_STATE.split(", ")]


def _kinds() -> tuple[Column, Column, Column]:
    """Absolute events; relative ones with a compass heading that is valid; other relative ones."""
    absolute = F.col("kind") == "absolute"
    compass = ~absolute & F.col("compass_heading").isNotNull() & (F.coalesce("accuracy", F.lit(0)) >= 0)
    return absolute, compass, ~absolute & ~compass


def orientation_route(events: DataFrame, streaming: bool = False) -> DataFrame:
    """events (device_id, t_ms, kind: absolute or relative, alpha, heading, pitch, roll as view_angles gives them,
    compass_heading, accuracy, held) with route and angles to show; all null where an event shows nothing.

    Absolute events teach the offset and are shown unless gyro events less than 300 ms old lead; relative ones with
    a valid compass heading are shown turned north by a slow mean; other ones are fused while the last absolute
    one is less than 2 s old, else shown raw. Events without a heading are passed over. On a stream, rows come once the
    watermark has passed them.

    Over a table, windows find what came last of each kind; only the offset and the mean turn are state."""
    if streaming:
        return keyed.ordered(events, "device_id", routed, ROUTE, ROUTE_STATE).drop("timer")
    names = events.columns
    rest = [c for c in names if c not in ("device_id", "t_ms")]
    x = events.withColumn("_order", F.struct(*rest))
    absolute, compass, plain = (F.col("heading").isNotNull() & k for k in _kinds())
    x = x.withColumns({"_absolute": _before(F.col("t_ms"), absolute), "_plain": _before(F.col("t_ms"), plain)})
    north = F.coalesce(F.col("t_ms") - F.col("_absolute") < NORTH_STALE_MS, F.lit(False))
    x = x.withColumn("_gyro", _before(F.struct("t_ms", "heading"), plain & north))
    fresh = absolute & (F.col("t_ms") - F.col("_gyro.t_ms") <= GYRO_STALE_MS)
    x = x.withColumns({"seen": F.when(fresh, delta_deg("heading", "_gyro.heading")), "north_seen": F.when(compass, -F.col("compass_heading") - F.col("alpha"))})
    x = replay(x.drop("_order"), "device_id", drift, DRIFT)
    led = F.coalesce(F.col("t_ms") - F.col("_plain") < GYRO_SILENT_MS, F.lit(False)) & F.col("offset").isNotNull()
    route = F.when(absolute & ~led, "absolute").when(compass, "compass").when(plain & ~north, "relative").when(plain & F.col("offset").isNotNull(), "fused")
    turned = F.col("heading") + F.when(route == "fused", F.col("offset")).when(route == "compass", -F.col("north")).otherwise(0.0)
    shown = route.isNotNull()
    return x.select(*names, route.alias("route"), F.when(shown, F.pmod(turned, F.lit(360.0))).alias("out_heading"), *[F.when(shown, F.col(c)).alias(f"out_{c}") for c in ("pitch", "roll")])


def routed(state, e):
    """orientation_route, event by event."""
    was = dict.fromkeys(_NAMES) | (state or {})
    if e["heading"] is None:
        return state, dict.fromkeys(("route", "out_heading", "out_pitch", "out_roll"))
    t, absolute = e["t_ms"], e["kind"] == "absolute"
    compass = not absolute and e["compass_heading"] is not None and (e["accuracy"] or 0) >= 0
    since = {k: math.inf if was[k] is None else t - was[k] for k in ("absolute", "plain", "gyro_t")}
    north = since["absolute"] < NORTH_STALE_MS
    seen = turn(e["heading"], was["gyro"]) if absolute and since["gyro_t"] <= GYRO_STALE_MS else None
    moved, now = drift({k: was[k] for k in ("offset", "offset_t", "cos", "sin")}, {"t_ms": t, "held": e["held"], "seen": seen, "north_seen": -e["compass_heading"] - e["alpha"] if compass else None})
    if absolute:
        route = None if since["plain"] < GYRO_SILENT_MS and now["offset"] is not None else "absolute"
        last = {"absolute": t}
    elif compass:
        route, last = "compass", {}
    else:
        route = "relative" if not north else "fused" if now["offset"] is not None else None
        last = {"plain": t} | ({"gyro_t": t, "gyro": e["heading"]} if north else {})
    by = {"fused": now["offset"], "compass": now["north"] and -now["north"]}.get(route) or 0.0
    shown = {"route": route, "out_heading": (e["heading"] + by) % 360, "out_pitch": e["pitch"], "out_roll": e["roll"]}
    return was | moved | last, shown if route else dict.fromkeys(shown)


def smoothing(source: str = "compass") -> Machine:
    """heading, pitch and roll, each drawn to its values at a rate that rises with its smoothed speed (Casiez, Roussel,
    Vogel 2012: the 1 euro filter). The heading is followed round the ring."""
    least, rise = SMOOTHING[source]

    def machine(state, e):
        seen = [e["heading"], e["pitch"], e["roll"]]
        if any(v is None for v in seen):
            return state, {"s_heading": None, "s_pitch": None, "s_roll": None}
        if state is None:
            state = {"t": e["t_ms"], "at": seen, "speed": [0.0, 0.0, 0.0], "turned": seen[0]}
        else:
            passed = min(0.2, max(1e-3, (e["t_ms"] - state["t"]) / 1000))
            seen[0] = state["turned"] + turn(seen[0], state["turned"])
            share = lambda cut: 1 - math.exp(-2 * math.pi * cut * passed)
            off = [a - b for a, b in zip(seen, state["at"])]
            speed = [v + share(SPEED_CUT) * (d / passed - v) for v, d in zip(state["speed"], off)]
            at = [x + share(cut + rise * abs(v)) * d for x, cut, v, d in zip(state["at"], least, speed, off)]
            state = {"t": e["t_ms"], "at": at, "speed": speed, "turned": seen[0]}
        h, p, r = state["at"]
        return state, {"s_heading": h % 360, "s_pitch": p, "s_roll": r}

    return machine


SMOOTHED = "s_heading double, s_pitch double, s_roll double"


def smooth_angles(angles: DataFrame, source: str = "compass", streaming: bool = False) -> DataFrame:
    """Smoothed angles (device_id, t_ms, heading, pitch, roll) of a table or a stream; null where an angle is."""
    x = (stream if streaming else replay)(angles.select("device_id", "t_ms", "heading", "pitch", "roll"), "device_id", smoothing(source), SMOOTHED)
    return x.select("device_id", "t_ms", *[F.col(f"s_{c}").alias(c) for c in ("heading", "pitch", "roll")])


def apply_posture(events: DataFrame, learned: DataFrame) -> DataFrame:
    """events (device_id, t_ms, posture, matched) with set_heading and set_pitch: the learned values (device_id,
    posture, heading, pitch) where the posture changes, null elsewhere, and where a picture has matched in the
    last 30 s, nothing is learned, or the heading learned is over 15 degrees. Times of a device are distinct."""
    w = Window.partitionBy("device_id").orderBy("t_ms")
    since = F.col("t_ms") - F.last(F.when(F.col("matched"), F.col("t_ms")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    go = ~F.col("posture").eqNullSafe(F.lag("posture").over(w)) & F.coalesce(since >= MATCH_HOLDS_MS, F.lit(True))
    x = events.withColumn("_go", go).join(learned.select("device_id", "posture", F.col("heading").alias("_h"), F.col("pitch").alias("_p")), ["device_id", "posture"], "left")
    most = F.lit(float(LEARNED_PITCH))
    p = F.when(F.col("_p").isNotNull(), F.greatest(-most, F.least(most, F.col("_p"))))
    return x.select(*events.columns, F.when(F.col("_go") & (F.abs("_h") <= LEARNED_HEADING), F.col("_h")).alias("set_heading"), F.when(F.col("_go"), p).alias("set_pitch"))
