"""Fused and smoothed headings use the operations of their SQL in their order: near half a turn and near north they'd differ else."""

import math
import random

from vistaframe.streaming import fusion
from vistaframe.streaming.machines import turn


def delta(a, b):
    d = (a - b) - 360 * math.floor((a - b) / 360)
    return d - 360 if d > 180 else d


def test_turns_by_half_the_ring_go_the_way_of_the_sql():
    r = random.Random(1)
    for _ in range(20000):
        b = r.randrange(-500000, 500000) * 0.073
        a = b + r.choice((-180, 180, 540)) + r.choice((0, 0, 2.8e-14, -2.8e-14, 1e-13))
        assert turn(a, b) == delta(a, b)


def test_the_share_drawn_is_that_of_the_sql():
    for t in range(17, 1400, 17):
        assert fusion.drawn(12.7, 0, 151.3, t, False) == 12.7 + delta(151.3, 12.7) * (1 - math.exp(-min(1, t / 1000) / 4))


def test_a_heading_just_below_north(spark):
    r = random.Random(2)
    while True:
        gyro, compass = r.randrange(100, 9000) / 100, r.randrange(100) / 100
        later, off = round(gyro - compass, 2), delta(compass, gyro)
        if -2e-14 < later + off < 0:
            break
    rows = [("a", 0, "gyro", gyro), ("a", 10, "compass", compass), ("a", 20, "gyro", later), ("a", 30, "gyro", 359.9)]
    got = {r.t_ms: r.fused for r in fusion.heading_fusion(spark.createDataFrame(rows, "device_id string, t_ms long, kind string, heading double")).collect()}
    assert got[0] is None and all(got[t] == (h + off) - 360 * math.floor((h + off) / 360) for t, h in ((20, later), (30, 359.9)))
    assert got[20] == 360
