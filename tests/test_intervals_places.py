"""Range joins in which many points share a place and many ranges are equal."""

import random

from docmill.operators import intervals
from tests.plans import most_joined


def test_points_in_one_place(spark):
    rng = random.Random(3)
    points = [(i, rng.choice(["a", "b", None]), rng.choice([*range(-6, 7), None])) for i in range(600)]
    ranges = [(i, rng.choice(["a", "b", None]), s, s + rng.randint(-2, 9)) for i, s in enumerate(rng.randint(-6, 4) for _ in range(300))]
    p = spark.createDataFrame(points, "id long, k string, at long")
    r = spark.createDataFrame(ranges, "range_id long, k string, start long, end long")
    holds = lambda p, r: p[1] is not None and p[1] == r[1] and p[2] is not None and r[2] <= p[2] <= r[3]
    first = intervals.first_range(p, r, ["k"], "id", ["range_id"], ["range_id"])
    assert sorted(tuple(x) for x in first.collect()) == [(q[0], min((x[0] for x in ranges if holds(q, x)), default=None)) for q in points]
    assert most_joined(first) <= 600
    counted = intervals.counted(p, r, ["k"], "id")
    want = [(x[0], len(held), min(held)) for x in ranges if (held := [q[0] for q in points if holds(q, x)])]
    assert sorted((x.range_id, x.n, x.least) for x in counted.collect()) == want
    assert most_joined(counted) <= 600
