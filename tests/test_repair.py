"""The older speed rule over blocks against a plain version over whole tracks."""

import random
from datetime import datetime, timedelta

import pytest

from trackmill.operators import repair as R
from trackmill.plans import catalog, crossings  # noqa: F401  crossings registers its queries
from trackmill.plans.tracks import tracks

SCHEMA = "trajectory int, obs int, time timestamp_ntz, lon double, lat double, part string"


def plain(rows, limit, max_gap, singles):
    """rows of one track (obs, time, lon, lat): a list that is mended in place, link by link, from its start again each time."""
    spot = lambda r: (r[2], r[3], None if r[1] is None else (r[1] - datetime(2020, 1, 1)) // timedelta(microseconds=1))
    fast = lambda a, b: (v := R.metres_a_second(spot(a), spot(b))) is not None and v > limit
    kept, marked = sorted(rows, key=lambda r: r[0]), set()
    while True:
        bad = next((i for i in range(len(kept) - 1) if (kept[i][0], kept[i + 1][0]) not in marked and fast(kept[i], kept[i + 1])), None)
        if bad is None:
            break
        if bad + 2 >= len(kept) or not fast(kept[bad], kept[bad + 2]) or fast(kept[bad + 1], kept[bad + 2]):
            del kept[bad + 1]
        else:
            marked.add((kept[bad][0], kept[bad + 1][0]))
    out, part = [], 0
    for i, r in enumerate(kept):
        if i and ((kept[i - 1][0], r[0]) in marked or (max_gap is not None and r[1] is not None and kept[i - 1][1] is not None and (r[1] - kept[i - 1][1]) / timedelta(days=1) > max_gap)):
            part += 1
        out.append((r[0], part))
    return [x for x in out if not singles or sum(p == x[1] for _, p in out) > 1]


def compare(df, rows, **options):
    got = {}
    for r in R.speed_repair(df, **options).collect():
        got.setdefault(r["trajectory"], []).append((r["obs"], r["part"]))
    tracks_of = {}
    for r in rows:
        tracks_of.setdefault(r[0], []).append(r[1:5])
    want = {k: plain(v, options["limit_m_s"], options.get("max_gap_days"), options.get("drop_singletons", True)) for k, v in tracks_of.items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    return got


@pytest.mark.parametrize("block", [1, 7, 20_000])
def test_made_up_tracks(spark, block):
    random.seed(11)
    rows = []
    for k in range(12):
        x, y, t = 0.0, 0.0, datetime(2021, 1, 1)
        for i in range(60):
            x, y, t = x + random.uniform(-0.3, 0.3), y + random.uniform(-0.3, 0.3), t + timedelta(hours=random.choice([0, 6, 6, 6, 90]))
            jump = random.choice([0, 0, 0, 3, -3]) * (k % 3 > 0)
            rows.append((k, i * 2, None if k == 5 and i % 9 == 0 else t, None if k == 4 and i % 7 == 0 else x + jump, y, "p"))
    rows += [(20, 0, datetime(2021, 1, 1), 0.0, 0.0, "p"), (21, 0, datetime(2021, 1, 1), 0.0, 0.0, "p"), (21, 1, datetime(2021, 1, 2), 50.0, 0.0, "p")]
    # Every second row is far off: a start at one of those keeps the wrong half until the end.
    rows += [(30, i, datetime(2021, 1, 1) + timedelta(hours=6 * i), 8.0 * (i % 2), 0.0, "p") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    compare(df, rows, limit_m_s=3.0, max_gap_days=3.0, block=block)
    got = compare(df, rows, limit_m_s=3.0, drop_singletons=False, block=block)
    assert len(got[30]) == 20 and max(p for _, p in got[4]) >= 0
    assert R.speed_repair(df.limit(0), 3.0).count() == 0


def test_given_events(spark):
    t = tracks(spark, "/root/testdata/sf0.001")
    rows = [(r["trajectory"], r["obs"], r["time"], r["lon"], r["lat"]) for r in t.collect()]
    got = {}
    for r in catalog.QUERIES["speed_repair"](spark, "/root/testdata/sf0.001").collect():
        got.setdefault(r["trajectory"], []).append((r["obs"], r["part"]))
    want = {}
    for k in {r[0] for r in rows}:
        want[k] = plain([r[1:] for r in rows if r[0] == k], crossings.SPEED, 5.0, True)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v} and 100 < sum(map(len, got.values())) < len(rows)
