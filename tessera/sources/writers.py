"""Writers: tables, lists, boxes, annotation documents, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources import json_document, named_files


def csv_table(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a header in the given order, nulls as blank cells. Write to a new path, never onto the input."""
    df.select(*(columns or df.columns)).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def json_records(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def box_files(lines: DataFrame, path: str, by: tuple[str, ...] = ("dataset", "slug")) -> None:
    """(image, line, *by): folders by dataset and slug, rows 'image<TAB>line'."""
    lines.select(F.concat_ws("\t", "image", "line").alias("value"), *by).write.mode("overwrite").partitionBy(*by).text(path)


def _part(name: Column) -> Column:
    """A text as a part of a file's name; null, empty texts and those that begin with . or _ have forms of their own."""
    coded = F.regexp_replace(F.regexp_replace(F.url_encode(name), r"^\.", "%2E"), "^_", "%5F")
    return F.when(name.isNull(), "%00").when(name == "", "%20").otherwise(coded)


def image_boxes(boxes: DataFrame, path: str) -> None:
    """A file <dataset>/<slug>/<image>.txt for each image with lines 'class cx cy w h' in order; see named_files.

    boxes: dataset, slug, image, class_id, cx, cy, w, h.  A row without a class gives a file without lines.  Images
    that are written again replace their files.
    """
    file = F.concat(_part(F.col("dataset")), F.lit("/"), _part(F.col("slug")), F.lit("/"), _part(F.col("image")), F.lit(".txt"))
    line = F.when(F.col("class_id").isNotNull(), F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "cx", "cy", "w", "h"))
    named_files.write_named(boxes.select(file.alias("file"), line.alias("line"), "class_id", "cx", "cy", "w", "h"), path, "class_id", "cx", "cy", "w", "h")


def class_list(classes: DataFrame, path: str) -> None:
    """Lines 'id slug' by id, one file: a class list is small."""
    classes.orderBy("class_id").coalesce(1).select(F.concat_ws(" ", F.col("class_id").cast("string"), "slug").alias("value")).write.mode("overwrite").text(path)


def split_lists(splits: DataFrame, path: str, name: str = "filename") -> None:
    """A folder for each split with its file names in order within each file."""
    splits.select("split", F.col(name).alias("value")).repartition("split", F.pmod(F.xxhash64("value"), F.lit(16))).sortWithinPartitions("split", "value").write.mode("overwrite").partitionBy("split").text(path)


def coco_tables(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str) -> None:
    """The three parts of an annotation document as JSON tables, which scale; see coco_document for one file."""
    for name, df in (("images", images), ("annotations", annotations), ("categories", categories)):
        df.write.mode("overwrite").json(f"{path}/{name}")


def coco_document(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str, most: int = 100_000) -> None:
    """One document. For small sets only: more than ``most`` annotations raise an error, use coco_tables then."""
    if annotations.limit(most + 1).count() > most or images.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows do not fit one document")
    part = lambda df, name: df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
    doc = part(images, "images").crossJoin(part(annotations, "annotations")).crossJoin(part(categories, "categories"))
    doc.select(F.to_json(F.struct("images", "annotations", "categories")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def coco_file(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str) -> None:
    """One document of any size in one file, rows by id; tasks write to their places in it."""
    json_document.write_sections(path, {"images": (images, ["id"]), "annotations": (annotations, ["id"]), "categories": (categories, ["id"])})


def registry_file(entries: DataFrame, path: str, key: str = "plant_key") -> None:
    """One JSON object of any size of the rows by key."""
    json_document.write_entries(path, entries, key)


def report(df: DataFrame, path: str) -> None:
    """A small frame of nested structs as JSON, one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Metrics rows, doubles at four decimals, appended."""
    rounded = [F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*rounded).write.mode("append").option("header", True).csv(path)


def manifest(df: DataFrame, group: str, status: str, path: str) -> None:
    """Counts of each status by folder, next to the data."""
    df.groupBy(group).pivot(status, ["processed", "skipped", "failed"]).count().na.fill(0).write.mode("overwrite").json(path)


def markdown(sections: dict[str, DataFrame], most: int = 100) -> str:
    """Sections as Markdown tables of at most ``most`` rows (a report's limit); a cut section says so."""
    out = []
    for title, df in sections.items():
        rows = df.limit(most + 1).collect()
        more = [f"*(the first {most} rows)*"] if len(rows) > most else []
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows[:most]] + [*more, ""]
    return "\n".join(out)
