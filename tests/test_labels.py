"""Label files and match keys against plain versions."""

import math

from pyspark.sql import functions as F

from lanepulse import registry
from lanepulse.functions.text import match_key
from lanepulse.operators import manifest as N


def clean(points, top, least):
    """Clamped points without repeats and the closing point, or None."""
    p = [(min(max(x, 0.0), top), min(max(y, 0.0), top)) for x, y in points]
    p = [q for k, q in enumerate(p) if not k or q != p[k - 1]]
    if len(p) > 1 and p[0] == p[-1]:
        p = p[:-1]
    if len(p) < 3:
        return None
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True))) / 2
    return p if area >= least else None


def test_label_lines_query(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    want = {}
    for r in sorted(rows, key=lambda r: r.vec_id):
        far = 0.5 if r.vec_id % 5 == 0 else 90.0
        points = [(float(r.embedding[2 * k]) * far + 50, float(r.embedding[2 * k + 1]) * far + 50) for k in range(8)]
        one = want.setdefault(r.vec_id // 4, {"lines": [], "n": [0, 0, 0], "unknown": 0, "degenerate": 0})
        kept = clean(points, 100.0, 1.0)
        if r.vec_id % 7 == 0:
            one["unknown"] += 1
        elif kept is None:
            one["degenerate"] += 1
        else:
            one["n"][r.label % 3] += 1
            one["lines"].append((r.label % 3, [v / 100 for p in kept for v in p]))
    got = registry.QUERIES["t9_t10_label_lines"](spark, data).collect()
    assert len(got) == len(want) and sum(r.degenerate for r in got) > 5 and sum(r.unknown_class for r in got) > 5
    for r in got:
        one = want[r.image_id]
        assert [r.n_car, r.n_bus, r.n_truck, r.unknown_class, r.degenerate] == [*one["n"], one["unknown"], one["degenerate"]]
        lines = r.text.split("\n") if r.text else []
        assert len(lines) == len(one["lines"])
        for line, (cls, values) in zip(lines, one["lines"], strict=True):
            head, *numbers = line.split(" ")
            assert head == str(cls) and all(len(v.split(".")[1]) == 6 for v in numbers)
            assert len(numbers) == len(values) and all(math.isclose(float(a), b, abs_tol=6e-7) for a, b in zip(numbers, values, strict=True))


def test_label_lines_odd_cases(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    rows = [(1, 1, "car", square), (1, 2, "car", square[:2]), (1, 3, None, square), (2, 1, "bus", None), (3, 1, "car", [(-5.0, -5.0), (20.0, -5.0), (20.0, 200.0)])]
    df = spark.createDataFrame(rows, "image_id int, ord int, label string, points array<struct<x: double, y: double>>")
    got = {r.image_id: (r.text, r.n_car, r.unknown_class, r.degenerate) for r in N.label_lines(df, ("car", "bus"), 20.0, 20.0, 1.0).collect()}
    assert got[1] == ("0 0.000000 0.000000 0.500000 0.000000 0.500000 0.500000 0.000000 0.500000", 1, 1, 1)
    assert got[2] == ("", 0, 0, 1) and got[3][1] == 1
    assert N.label_lines(df.limit(0), ("car",), 20.0, 20.0, 1.0).count() == 0


def test_match_keys_of_composed_and_decomposed_names(spark):
    names = ["dir\\Clip 005.png", "dir/clip_005.PNG", "a/Stra\u00dfe e\u0301.x.jpg", "b\\Stra\u00dfe \u00e9.x.png", None, ""]
    df = spark.createDataFrame(list(enumerate(names)), "k int, name string")
    assert [r.key for r in df.select("k", match_key(F.col("name")).alias("key")).orderBy("k").collect()] == ["clip_005", "clip_005", "stra\u00dfe_\u00e9.x", "stra\u00dfe_\u00e9.x", None, ""]
