"""Horizons meet other tables as a row of arrays for each place: a plan that broadcasts them fills the driver at size."""

import random

import pytest
from pyspark.sql import functions as F

from vistaframe.operators import panorama
from vistaframe.plans import queries

SMALL = "/root/testdata/sf0.001"
OVER_HORIZONS = ["above_terrain", "label_strip", "match_pitch", "prune_lines", "skyline_relief", "terrain_events", "match_landmarks", "match_skyline", "match_profile", "search_windows"]


def broadcast_bins(plan: str) -> list[str]:
    """The broadcasts of a plan whose input is exploded somewhere below."""
    lines, found = plan.splitlines(), []
    for i, line in enumerate(lines):
        depth = len(line) - len(line.lstrip(" :+-"))
        if "BroadcastExchange" in line:
            below = []
            for x in lines[i + 1 :]:
                if len(x) - len(x.lstrip(" :+-")) <= depth:
                    break
                below.append(x)
            found += [line for x in below if "Generate explode" in x][:1]
    return found


@pytest.mark.parametrize("name", OVER_HORIZONS)
def test_no_horizon_is_broadcast(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    assert not broadcast_bins(df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture(scope="module")
def places(spark):
    """A full ring, one with gaps and null angles, one of three bins, and targets over them and over no ring."""
    r = random.Random(5)
    rings = {1: range(3600), 2: [b for b in range(3600) if b % 7 and not 3590 <= b], 3: [0, 5, 3599]}
    h = {(o, b): None if (b + o) % 41 == 0 else r.uniform(-2, 5) for o, bins in rings.items() for b in bins}
    rows = list(h.items())
    r.shuffle(rows)
    horizon = spark.createDataFrame([(o, b, a) for (o, b), a in rows], "obs_id int, az_bin int, angle double")
    return h, rings, horizon, [(i, i % 5, r.choice([r.uniform(0, 360), r.randrange(3600) / 10, 359.97, 0.0])) for i in range(600)]


def test_angles_of_rings_with_gaps(spark, places):
    h, rings, horizon, targets = places
    got = panorama.horizon_at(spark.createDataFrame(targets, "id int, obs_id int, az double"), horizon, nearest=True).collect()
    assert {r.id: r.h for r in got} == {i: h.get((o, int(az / 0.1 + 0.5) % 3600)) for i, o, az in targets}


def test_bins_near_a_heading(spark, places):
    h, _, horizon, targets = places
    frames = spark.createDataFrame([(i, o, az) for i, o, az in targets[:60]], "frame_id int, obs_id int, heading double")
    got = {(r.frame_id, r.az_bin): r.angle for r in panorama.bins_near(frames, horizon, F.lit(33.05)).collect()}
    off = lambda a, b: abs((a - b + 180) % 360 - 180)
    assert got == {(i, b): a for i, o, az in targets[:60] for (p, b), a in h.items() if p == o and a is not None and off(b * 0.1, az) <= 33.05}


def test_relief_counts_existing_bins(spark, places):
    h, rings, horizon, targets = places
    t = spark.createDataFrame([(i, o, az, 3.0, i % 4 > 0) for i, o, az in targets], "id int, obs_id int, az double, angle double, visible boolean")
    got = {r.id: r.relief for r in panorama.skyline_relief(t, horizon).collect()}
    low = float("-inf")
    for i, o, az in targets:
        b, bins = int(az / 0.1 + 0.5) % 3600, sorted(rings.get(o, ()))
        want = 0.0
        if i % 4 and b in bins:
            wide = [(x - 3600) for x in bins if x >= 3585] + bins + [x + 3600 for x in bins if x < 15]
            k, a = wide.index(b), [low if (v := h[o, x % 3600]) is None else v for x in wide]
            sides = [min(s) for s in (a[max(0, k - 15) : k], a[k + 1 : k + 16]) if s]
            want = 0.0 if len(sides) == 2 and max(sides) == low else max(0.0, min((3.0 - s for s in sides), default=0.0))
        assert got[i] == pytest.approx(want, abs=1e-9), (i, o, b)
