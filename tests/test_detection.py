"""Average precision against a plain reckoning, with ties, empty sides and odd rows."""

import random

import pytest

from millrace.operators import detection

SCHEMA = "image long, label string, score double, key long, box array<double>"


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inner = max(w, 0.0) * max(h, 0.0)
    both = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inner
    return inner / both if both else 0.0


def plain(predictions, truths, thresholds, points):
    out = {}
    for label in sorted({t[1] for t in truths if None not in t}):
        n = sum(t[1] == label for t in truths if None not in t)
        for threshold in thresholds:
            free = {}
            for image, own, box in truths:
                if own == label and image is not None and box is not None:
                    free.setdefault(image, []).append(box)
            free = {k: sorted(v) for k, v in free.items()}
            hits = []
            for image, _, score, key, box in sorted((p for p in predictions if p[1] == label and None not in p), key=lambda p: (-p[2], p[0], p[3])):
                boxes = free.get(image, [])
                best = max(((overlap(box, b), -i) for i, b in enumerate(boxes) if b and overlap(box, b) >= threshold), default=None)
                hits.append(best is not None)
                if best:
                    boxes[-best[1]] = None
            found, curve = 0, []
            for place, hit in enumerate(hits, 1):
                found += hit
                curve.append((found, found / place, hit))
            at = lambda k: max((p for f, p, _ in curve if (points - 1) * f >= k * n), default=0.0)
            area = sum(max(p for _, p, _ in curve[i:]) for i, (_, _, hit) in enumerate(curve) if hit) / n
            out[label, threshold] = (n, len(hits), found, sum(map(at, range(points))) / points if points else area)
    return out


def made(seed, images=6, labels="abc", n=80):
    rng = random.Random(seed)
    box = lambda: (lambda x, y: [x, y, x + rng.choice([4.0, 6.0]), y + rng.choice([4.0, 6.0])])(float(rng.randint(0, 6)), float(rng.randint(0, 6)))
    truths = [(rng.randrange(images), rng.choice(labels), box()) for _ in range(n)]
    predictions = [(rng.randrange(images), rng.choice(labels + "z"), rng.choice([0.1, 0.2, 0.5, 0.9]), i, box()) for i in range(n)]
    return predictions, truths


@pytest.mark.parametrize("points", [101, 11, None])
def test_against_plain(spark, points):
    predictions, truths = made(points or 5)
    truths += [(1, "never predicted", [0.0, 0.0, 1.0, 1.0]), (None, "a", [0.0, 0.0, 1.0, 1.0]), (1, "b", None), (2, "a", [3.0, 3.0, 3.0, 3.0])]
    predictions += [(None, "a", 0.5, 900, [0.0, 0.0, 1.0, 1.0]), (1, "a", None, 901, [0.0, 0.0, 1.0, 1.0]), (1, None, 0.3, 902, [0.0, 0.0, 1.0, 1.0]), (1, "a", 0.3, 903, None)]
    ps, ts = spark.createDataFrame(predictions, SCHEMA).repartition(5), spark.createDataFrame(truths, "image long, label string, box array<double>").repartition(3)
    got = {(r["label"], r["threshold"]): (r["truths"], r["predictions"], r["found"], pytest.approx(r["ap"], abs=1e-12)) for r in detection.average_precision(ps, ts, [0.1, 0.5, 0.75], points=points).collect()}
    assert got == plain(predictions, truths, [0.1, 0.5, 0.75], points)


def test_greedy_takes_the_best_free_box(spark):
    """The surer prediction takes the box both overlap best; the other one takes what is left if it overlaps enough."""
    truths = spark.createDataFrame([(1, "a", [0.0, 0.0, 10.0, 10.0]), (1, "a", [4.0, 0.0, 14.0, 10.0])], "image long, label string, box array<double>")
    ps = spark.createDataFrame([(1, "a", 0.9, 1, [1.0, 0.0, 11.0, 10.0]), (1, "a", 0.8, 2, [0.0, 0.0, 10.0, 10.0])], SCHEMA)
    hits = {(r["key"], r["threshold"]): r["hit"] for r in detection.matched(ps, truths, [0.4, 0.5]).collect()}
    assert hits == {(1, 0.4): 1, (2, 0.4): 1, (1, 0.5): 1, (2, 0.5): 0}


def test_most_and_empty(spark):
    predictions, truths = made(3, images=2, labels="a", n=60)
    ps, ts = spark.createDataFrame(predictions, SCHEMA), spark.createDataFrame(truths, "image long, label string, box array<double>")
    assert detection.matched(ps, ts, [0.5], most=4).groupBy("image", "label").count().filter("count > 4").count() == 0
    none = detection.average_precision(ps.limit(0), ts, [0.5]).collect()
    assert [(r["predictions"], r["found"], r["ap"]) for r in none] == [(0, 0, 0.0)]
    assert detection.average_precision(ps, ts.limit(0), [0.5]).collect() == []
    perfect = ts.selectExpr("image", "label", "1.0D as score", "monotonically_increasing_id() as key", "box")
    one = detection.mean_average_precision(detection.average_precision(perfect, ts)).first()
    assert (one["map"], one["map_50"], one["mar"], one["labels"]) == (pytest.approx(1.0), pytest.approx(1.0), 1.0, 1)


def test_a_prediction_is_one_row_at_all_thresholds(spark, monkeypatch):
    predictions, truths = made(8)
    ps, ts = spark.createDataFrame(predictions, SCHEMA), spark.createDataFrame(truths, "image long, label string, box array<double>")
    placed, real = [], detection.running_within

    def watched(df, *args, **kwargs):
        placed.append(df.count())
        return real(df, *args, **kwargs)

    monkeypatch.setattr(detection, "running_within", watched)
    assert detection.average_precision(ps, ts, points=None).count() == 30
    assert placed == [80, 80]


def test_odd_corners(spark):
    """A box with a null corner overlaps nothing; one of NaN overlaps all, as it is the largest."""
    nan = float("nan")
    truths = spark.createDataFrame([(i, "a", b) for i, b in enumerate([[0.0, 0.0, 1.0, 1.0], [0.0, 0.0, None, 1.0], [0.0, 0.0, nan, 1.0], [1.0, 1.0, 1.0, 1.0]])], "image long, label string, box array<double>")
    ps = spark.createDataFrame([(i, "a", 0.5, i, b) for i, b in enumerate([[0.0, 0.0, None, 1.0], [0.0, 0.0, 1.0, 1.0], [0.0, 0.0, 1.0, 1.0], [1.0, 1.0, 1.0, 1.0]])], SCHEMA)
    assert {r["key"]: r["hit"] for r in detection.matched(ps, truths, [0.5]).collect()} == {0: 0, 1: 0, 2: 1, 3: 0}
