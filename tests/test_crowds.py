"""Overlaps and suppression in images with many boxes, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import boxes

KINDS = "image string, box_id long, cx double, cy double, w double, h double, score double"


def crowd(seed, n=220):
    rng = random.Random(seed)
    spots = [(rng.uniform(-3, 3), rng.uniform(-3, 3), 2 ** rng.uniform(-6, 2), 2 ** rng.uniform(-6, 2)) for _ in range(n // 6)]
    rows = []
    for i in range(n):
        x, y, w, h = rng.choice(spots)
        near = lambda v, s: v + rng.uniform(-0.3, 0.3) * s
        rows.append((rng.choice(["crowd"] * 8 + ["b", "c"]), i, near(x, w), near(y, h), w * rng.uniform(0.7, 1.4), h * rng.uniform(0.7, 1.4), round(rng.random(), 1)))
    return rows + [("crowd", n, 0.5, 0.5, 0.25, 0.25, 0.9), ("crowd", n + 1, 0.5, 0.5, 0.25, 0.25, 0.9), ("crowd", n + 2, 0.5, 0.5, 0.0, 0.25, 0.9), ("crowd", n + 3, 0.5, 0.5, 0.5, 0.25, 0.1)]


def overlap(a, b):
    inter = 1.0
    for c, s in ((2, 4), (3, 5)):
        inter *= max(min(a[c] + a[s] / 2, b[c] + b[s] / 2) - max(a[c] - a[s] / 2, b[c] - b[s] / 2), 0.0)
    whole = a[4] * a[5] + b[4] * b[5] - inter
    return inter / whole if whole > 0 else 0.0


def pairs(rows, threshold):
    rank = sorted(rows, key=lambda r: (-r[6], r[1]))
    return sorted((a[0], a[1], b[1]) for i, a in enumerate(rank) for b in rank[i + 1 :] if a[0] == b[0] and overlap(a, b) > threshold)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.12])
def test_tiles_find_the_same_pairs(spark, threshold):
    rows = crowd(3)
    df = spark.createDataFrame(rows, KINDS)
    want = pairs(rows, threshold)
    assert len(want) > 2
    for most in (0, 30, 10_000):
        assert sorted(map(tuple, boxes.iou_pairs(df, threshold, crowd=most).select("image", "keep", "drop").collect())) == want


@pytest.mark.parametrize("most", [0, 30])
def test_rounds_keep_what_greedy_keeps(spark, most):
    rows = crowd(5)
    df = spark.createDataFrame(rows, KINDS).withColumn("extra", F.lit("x"))
    lost, want = {}, []
    for a, b, c in pairs(rows, 0.5):
        lost.setdefault((a, c), []).append(b)
    kept = set()
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        if not any((r[0], k) in kept for k in lost.get((r[0], r[1]), [])):
            kept.add((r[0], r[1]))
            want.append((r[0], r[1], "x"))
    assert sorted(map(tuple, boxes.nms(df, crowd=most).select("image", "box_id", "extra").collect())) == sorted(want)
    assert len(want) < len(rows) - 10


def test_a_chain_and_no_boxes(spark):
    chain = [("i", i, i * 0.25, 0.0, 1.0, 1.0, 1 - i / 100) for i in range(14)]  # each overlaps the next
    got = boxes.nms(spark.createDataFrame(chain, KINDS), crowd=3)
    assert sorted(r.box_id for r in got.collect()) == [0, 2, 4, 6, 8, 10, 12]
    assert boxes.nms(spark.createDataFrame([], KINDS)).collect() == []
    with pytest.raises(ValueError, match="above 0"):
        boxes.iou_pairs(spark.createDataFrame(chain, KINDS), 0.0)


@pytest.mark.parametrize("size", [1, 3, 64])
def test_images_of_a_batch_are_suppressed_together(spark, size):
    """Images on both sides of batches' ends, of one box and of many, in bounded Python time."""
    import numpy as np

    rows = [(f"{r[0]}{r[1] % 5}" if r[1] % 3 else None, *r[1:]) for r in crowd(7)] + [(f"one{i}", i, 0.5, 0.5, 0.25, 0.25, 0.5) for i in range(50)]
    best = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", -r[6], r[1]))
    start = np.array([i for i, r in enumerate(best) if i == 0 or r[0] != best[i - 1][0]])
    box = np.array([r[2:6] for r in best])
    want = [a + i for a, b in zip(start.tolist(), [*start[1:].tolist(), len(best)], strict=True) for i in boxes._greedy(box[a:b], 0.5).tolist()]
    assert boxes._greedy_by_image(box, start, 0.5, small=size).tolist() == want
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = boxes.nms(spark.createDataFrame(rows, KINDS)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((str(r.image), r.box_id) for r in got) == sorted((str(best[i][0]), best[i][1]) for i in want)
