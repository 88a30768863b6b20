"""Split operators whose queries have no SQL, against plain versions on small clips."""

import random

from pyspark.sql import functions as F

from lanepulse.operators import dataset as D


def clips(seed, n=12):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        frames = sorted(rng.sample(range(400), rng.randint(1, 40)))
        held = rng.random() < 0.6
        rows += [(f"c{c}", c * 1000 + i, f, held and rng.random() < 0.1, float(rng.randint(0, 5))) for i, f in enumerate(frames)]
    return rows


def test_leak_risk(spark):
    rows = clips(1)
    got = {r.image_id: r.risk for r in D.leak_risk(spark.createDataFrame(rows, "clip string, image_id long, frame int, held boolean, score double"), 3).collect()}
    for clip in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == clip]
        held = [i for i, r in enumerate(mine) if r[3]]
        for i, r in enumerate(mine):
            want = -1 if r[3] else 0 if not held else 2 if min(abs(i - h) for h in held) <= 3 else 1
            assert got[r[1]] == want


def test_even_pick(spark):
    rows = [(*r, k) for r, k in zip(clips(2), [5] * 10_000, strict=False)]
    df = spark.createDataFrame(rows, "clip string, image_id long, frame int, held boolean, score double, k int")
    got = {}
    for r in D.even_pick(df, "k").collect():
        got.setdefault(r.clip, {})[r.part] = r.image_id
    for clip in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == clip]
        n, parts = len(mine), {}
        for i, r in enumerate(mine):
            parts.setdefault(min(i * 5 // n, 4), []).append((-r[4], round(abs(i + 0.5 - (min(i * 5 // n, 4) + 0.5) * n / 5), 9), i, r[1]))
        assert got[clip] == {p: min(v)[3] for p, v in parts.items()}


def test_seeded_pick_and_diverse_sample(spark):
    rows = [(i, f"clip{i % 30}", f"site{i % 4}", "day" if i % 3 else "night") for i in range(300)]
    df = spark.createDataFrame(rows, "image_id long, clip string, site string, day_night string")
    picks = [[r[0] for r in D.seeded_pick(df.repartition(n), 20, seed, "image_id").collect()] for n, seed in ((1, 7), (5, 7), (5, 8))]
    assert picks[0] == picks[1] != picks[2] and len(set(picks[0])) == 20
    hashed = {r[0]: r[1] for r in df.select("image_id", F.xxhash64("image_id", F.lit(7))).collect()}
    assert picks[0] == sorted(hashed, key=lambda i: (hashed[i], i))[:20]
    out = D.diverse_sample(df, 6, 7).collect()
    for phase in ("day", "night"):
        mine = [r for r in out if r.day_night == phase]
        assert len(mine) == 6 and len({r.clip for r in mine}) == 6 and len({r.site for r in mine}) == 4
