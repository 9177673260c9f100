"""Detection boxes: geometry, suppression, annotation tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import corner_box, iou
from tessera.shared import shared_dir, written


def annotations(boxes: DataFrame, sizes: DataFrame, width: int = 700, height: int = 600) -> DataFrame:
    """Boxes with pixel corner boxes; the size of an image without one is width x height."""
    b = boxes.join(sizes.select("image", "width", "height"), "image", "left").withColumns({"width": F.coalesce("width", F.lit(width)), "height": F.coalesce("height", F.lit(height))})
    return b.withColumn("bbox", corner_box(*map(F.col, ("cx", "cy", "w", "h", "width", "height")))).select("*", "bbox.area").withColumn("bbox", F.struct("bbox.x", "bbox.y", "bbox.w", "bbox.h"))


def with_fallback(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """All images' boxes; one without any gets the box of the whole image."""
    b = boxes.select("image", "cx", "cy", "w", "h", "score")
    return images.select("image").join(b, "image", "left").select("image", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in (("cx", 0.5), ("cy", 0.5), ("w", 1.0), ("h", 1.0))), "score")


def annotated(images: DataFrame, detect: Callable[[pd.DataFrame], pd.DataFrame], image: str = "image") -> DataFrame:
    """Boxes that a detector finds, image by image: image, cx, cy, w, h, score, fallback, error.

    ``detect`` gets a batch of rows and returns rows with the image, the box and a score.  An image that it cannot read
    it may say so of in a column ``error``, in a row without a box.  Where it raises, the batch is halved until the row
    it fails on is alone, which is for rare failures: many cost a call for each row.  An image that it fails on or finds
    nothing in gets the box of the whole image (fallback, score null), and ``error`` says why it failed.  A null image
    is passed on like any other.
    """
    columns = ["cx", "cy", "w", "h", "score"]
    whole = {"cx": 0.5, "cy": 0.5, "w": 1.0, "h": 1.0, "score": None, "fallback": True}

    def found(batch: pd.DataFrame, errors: dict) -> pd.DataFrame:
        try:
            got = detect(batch)
            failed = got["error"].notna() if "error" in got else pd.Series(False, got.index)
            said, got = dict(zip(got.loc[failed, image], got.loc[failed, "error"], strict=True)) if failed.any() else {}, got.loc[~failed, [image, *columns]]
        except Exception as e:  # noqa: BLE001 - a detector may raise anything; what it says is kept
            if len(batch) <= 1:
                errors.update({x: f"{type(e).__name__}: {e}"[:500] for x in batch[image]})
                return pd.DataFrame(columns=[image, *columns])
            half = len(batch) // 2
            parts = [x for x in (found(batch.iloc[:half], errors), found(batch.iloc[half:], errors)) if len(x)]
            return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=[image, *columns])
        errors.update({x: str(why)[:500] for x, why in said.items()})
        return got

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors: dict = {}
            got = found(batch, errors).assign(fallback=False, error=None)
            rest = batch.loc[~batch[image].isin(got[image]), [image]].assign(**whole)
            rest["error"] = [errors.get(x) for x in rest[image]]
            yield pd.concat([x for x in (got, rest) if len(x)], ignore_index=True) if len(got) + len(rest) else rest

    kind = images.schema[image].dataType.simpleString()
    return images.mapInPandas(run, f"{image} {kind}, cx double, cy double, w double, h double, score double, fallback boolean, error string")


def yolo_lines(boxes: DataFrame) -> DataFrame:
    """(image, line) with six decimals."""
    return boxes.select("image", F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "cx", "cy", "w", "h").alias("line"))


def reject_large(boxes: DataFrame, most: float = 0.90) -> DataFrame:
    return boxes.filter(F.col("w") * F.col("h") <= most)


def _crowds(boxes: DataFrame, most: int) -> DataFrame:
    """Images with more than ``most`` boxes."""
    return boxes.groupBy("image").agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(F.col("image").alias("_image"))


def _parted(boxes: DataFrame, crowds: DataFrame) -> tuple[DataFrame, DataFrame]:
    same = F.col("image").eqNullSafe(F.col("_image"))
    return boxes.join(crowds, same, "left_anti"), boxes.join(crowds, same, "left_semi")


def _crowded(boxes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Boxes of images with up to ``most`` of them, and those of the others."""
    return _parted(boxes, _crowds(boxes, most))


def _tiled(boxes: DataFrame, threshold: float) -> DataFrame:
    """Each box in the tiles that it touches on grids at least as wide and high as itself: _i and _j are the grid's steps.

    Boxes that overlap by more than the threshold differ in width and height by 1 / threshold at most, so both are on
    the grid of the wider one's width and the higher one's height.
    """
    more = math.ceil(math.log2(1 / threshold))
    own = boxes.filter("w > 0 and h > 0 and cx is not null and cy is not null and not isnan(cx) and not isnan(cy) and not isnan(w) and not isnan(h)")
    for i, size in (("_i", "w"), ("_j", "h")):
        own = own.withColumn(f"{i}own", F.ceil(F.log2(size)).cast("int")).withColumn(i, F.explode(F.sequence(f"{i}own", F.col(f"{i}own") + more)))
    for t, c, size, i in (("_x", "cx", "w", "_i"), ("_y", "cy", "h", "_j")):
        tile = lambda at, i=i: F.floor(at / F.pow(F.lit(2.0), i))
        own = own.withColumn(t, F.explode(F.sequence(tile(F.col(c) - F.col(size) / 2), tile(F.col(c) + F.col(size) / 2))))
    return own


def iou_pairs(boxes: DataFrame, threshold: float = 0.5, id_col: str = "box_id", crowd: int = 64) -> DataFrame:
    """Pairs of boxes of an image that overlap by more than the threshold (above 0): image, keep, drop, iou.

    keep is the one with the higher score (the lower id of equals).  Boxes of images with more than ``crowd`` of them
    meet in tiles (_tiled) and count in the one where their intersection begins, so no image makes all its pairs;
    those of other images meet by image.
    """
    if not threshold > 0:
        raise ValueError("overlaps are found for thresholds above 0")
    side = lambda t: {c: F.col(f"{t}.{c}") for c in ("cx", "cy", "w", "h")}
    better = (F.col("a.score") > F.col("b.score")) | ((F.col("a.score") == F.col("b.score")) & (F.col(f"a.{id_col}") < F.col(f"b.{id_col}")))
    named = [F.col("a.image").alias("image"), F.col(f"a.{id_col}").alias("keep"), F.col(f"b.{id_col}").alias("drop"), iou(side("a"), side("b")).alias("iou")]
    few, many = _crowded(boxes.select("image", id_col, "cx", "cy", "w", "h", "score"), crowd)
    found = few.alias("a").join(few.alias("b"), (F.col("a.image") == F.col("b.image")) & better).select(*named)
    tiles = _tiled(many, threshold)
    same = better & (F.col("a.image") == F.col("b.image"))
    for c in ("_i", "_j", "_x", "_y"):
        same &= F.col(f"a.{c}") == F.col(f"b.{c}")
    for i, t, c, size in (("_i", "_x", "cx", "w"), ("_j", "_y", "cy", "h")):
        begins = F.greatest(F.col(f"a.{c}") - F.col(f"a.{size}") / 2, F.col(f"b.{c}") - F.col(f"b.{size}") / 2)
        same &= (F.col(f"a.{i}") == F.greatest(F.col(f"a.{i}own"), F.col(f"b.{i}own"))) & (F.col(f"a.{t}") == F.floor(begins / F.pow(F.lit(2.0), F.col(f"a.{i}"))))
    return found.union(tiles.alias("a").join(tiles.alias("b"), same).select(*named)).filter(F.col("iou") > threshold)


def best_box(boxes: DataFrame, id_col: str = "box_id") -> DataFrame:
    """The box with the highest score of each image (the lower id of equals)."""
    rest = [c for c in boxes.columns if c != "image"]
    top = boxes.groupBy("image").agg(F.max_by(F.struct(*rest), F.struct("score", (-F.col(id_col)).alias("i"))).alias("_b"))
    return top.select(*(F.col(c if c == "image" else f"_b.{c}").alias(c) for c in boxes.columns))


def _greedy(box: np.ndarray, threshold: float) -> np.ndarray:
    """Places of the boxes (cx, cy, w, h; best first) that no kept one overlaps by more than the threshold."""
    cx, cy, w, h = box.T
    x1, y1, x2, y2, area = cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2, w * h
    left, kept = np.arange(len(box)), []
    while len(left):
        i, left = left[0], left[1:]
        kept.append(i)
        inter = np.maximum(np.minimum(x2[left], x2[i]) - np.maximum(x1[left], x1[i]), 0.0) * np.maximum(np.minimum(y2[left], y2[i]) - np.maximum(y1[left], y1[i]), 0.0)
        whole = area[left] + area[i] - inter
        left = left[~(np.divide(inter, whole, out=np.zeros_like(inter), where=whole > 0) > threshold)]
    return np.array(kept, np.int64)


def _starts(image: pa.Array) -> np.ndarray:
    """Places where a run of equal images begins; nulls are equal."""
    try:
        codes = image.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        new = codes[1:] != codes[:-1]
    except (pa.ArrowNotImplementedError, pa.ArrowInvalid):  # nested keys
        x = image.to_pylist()
        new = np.array([a != b for a, b in zip(x[1:], x, strict=False)], bool)
    return np.flatnonzero(np.r_[len(image) > 0, new])


def _greedy_by_image(box: np.ndarray, start: np.ndarray, threshold: float, small: int = 32) -> np.ndarray:
    """_greedy for many images at once, whose boxes begin at ``start``: places of the kept boxes, in their order.

    In turn k the k-th box of every image that is still there drops what it overlaps in its own; images with more
    than ``small`` boxes are taken one by one.
    """
    end = np.r_[start[1:], len(box)]
    large = end - start > small
    keep = np.ones(len(box), bool)
    for a, b in zip(start[large].tolist(), end[large].tolist(), strict=True):
        keep[a:b] = False
        keep[a + _greedy(box[a:b], threshold)] = True
    cx, cy, w, h = box.T
    x1, y1, x2, y2, area = cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2, w * h
    at, end = start[~large], end[~large]
    while len(at):
        more = at + 1 < end
        at, end = at[more], end[more]
        own = keep[at]
        n = (end - at - 1)[own]
        i = np.repeat(at[own], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        inter = np.maximum(np.minimum(x2[j], x2[i]) - np.maximum(x1[j], x1[i]), 0.0) * np.maximum(np.minimum(y2[j], y2[i]) - np.maximum(y1[j], y1[i]), 0.0)
        both = area[j] + area[i] - inter
        keep[j[np.divide(inter, both, out=np.zeros_like(inter), where=both > 0) > threshold]] = False
        at = at + 1
    return np.flatnonzero(keep)


def suppressed(boxes: DataFrame, threshold: float = 0.5, id_col: str = "box_id") -> DataFrame:
    """(image, id) that greedy suppression drops, without an image in one task: rounds over the graph of overlaps.

    Of the undecided boxes, those that no better undecided one overlaps are kept, and what they overlap is dropped.
    As many rounds as the longest chain of boxes, each overlapped by a better one, has undecided links; in crowds
    few.  Ids are unique in an image.  Every round is stored.
    """
    folder = shared_dir(boxes.sparkSession, "suppression")
    open_ = written(iou_pairs(boxes, threshold, id_col, crowd=0).select("image", "keep", "drop"), f"{folder}/round-0")
    gone, turn = open_.select("image", F.col("drop").alias(id_col)).limit(0), 0
    while not open_.isEmpty():
        turn += 1
        best = open_.select("image", F.col("keep").alias("_k")).distinct().join(open_.select("image", F.col("drop").alias("_k")).distinct(), ["image", "_k"], "left_anti")
        dropped = written(open_.join(best, (open_["image"] == best["image"]) & (open_["keep"] == best["_k"]), "left_semi").select("image", "drop").distinct(), f"{folder}/dropped-{turn}")
        for side in ("keep", "drop"):
            far = dropped.select(F.col("image").alias("_i"), F.col("drop").alias("_d"))
            open_ = open_.join(far, (F.col("image") == F.col("_i")) & (F.col(side) == F.col("_d")), "left_anti")
        open_ = written(open_, f"{folder}/round-{turn}")
        gone = gone.union(dropped)
    return gone


def nms(boxes: DataFrame, threshold: float = 0.5, id_col: str = "box_id", mode: str = "nms", crowd: int = 1000) -> DataFrame:
    """Greedy suppression per image: by score, drop what overlaps a kept box by more than the threshold.

    mode: 'nms', 'best' (one box) or 'all'.  Images with up to ``crowd`` boxes stream through partitions sorted by
    image, all images of a batch at once; those with more, whose names are stored first, go through rounds over their
    overlaps (``suppressed``).
    """
    if mode == "all":
        return boxes
    if mode == "best":
        return best_box(boxes, id_col)
    spark = boxes.sparkSession
    crowds = written(_crowds(boxes, crowd), f"{shared_dir(spark, 'crowds')}")
    none = crowds.isEmpty()
    few, many = (boxes, None) if none else _parted(boxes, crowds)
    columns = boxes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, start in whole_images(batches):
            box = np.stack([np.asarray(rows.column(c).to_numpy(), float) for c in ("cx", "cy", "w", "h")], 1)
            yield from rows.take(pa.array(_greedy_by_image(box, start, threshold))).combine_chunks().to_batches()

    def whole_images(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """Tables of whole images, with the places where these begin."""
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            start = _starts(rows.column(columns.index("image")).combine_chunks())
            if len(start) > 1:
                yield rows.slice(0, int(start[-1])), start[:-1]
            held = rows.slice(int(start[-1])) if len(start) else None
        if held is not None and len(held):
            yield held, np.zeros(1, np.int64)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = few.repartition(n, "image").sortWithinPartitions("image", F.desc("score"), id_col).mapInArrow(run, boxes.schema)
    if none:
        return kept
    gone = suppressed(many, threshold, id_col).select(F.col("image").alias("_image"), F.col(id_col).alias("_id"))
    return kept.union(many.join(gone, (F.col("image") == F.col("_image")) & (F.col(id_col) == F.col("_id")), "left_anti"))


def coco(images: DataFrame, boxes: DataFrame, categories: DataFrame) -> DataFrame:
    """One row per image with its annotations nested: image, annotations (array of id, category, bbox, area)."""
    b = boxes.join(categories, "class_id", "left")
    own = b.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("box_id", "slug", "bbox", "area"))).alias("annotations"))
    return images.join(own, "image", "left")
