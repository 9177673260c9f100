"""Readers of the file formats: tables, records, lists, boxes, annotations, inventories."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tessera import schema as S
from tessera.operators.tables import keep_last
from tessera.shared import shared_dir, written
from tessera.sources import json_document


def _optional(read, spark: SparkSession, schema: T.StructType) -> DataFrame:
    """The read's rows; an empty table of the schema when the path does not exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def csv_table(spark: SparkSession, path: str, schema: T.StructType, required: bool = False) -> DataFrame:
    """A CSV file with a header, by column names in the schema's order; blank cells are null."""
    read = lambda: spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True).schema(schema).csv(path)
    return read() if required else _optional(read, spark, schema)


def metadata(spark: SparkSession, base: str, datasets: dict[str, T.StructType] | None = None) -> DataFrame:
    """The metadata tables of all datasets (<base>/<name>/metadata.csv) in one frame with their name."""
    out = None
    for name, schema in (datasets or {"butterflies": S.ANIMAL_METADATA, "plants": S.PLANT_METADATA}).items():
        part = csv_table(spark, f"{base}/{name}/metadata.csv", schema).withColumn("dataset", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def json_records(spark: SparkSession, path: str, schema: T.StructType, key: str | None = None, strict: bool = False) -> DataFrame:
    """JSON lines; blank and malformed ones are dropped, or kept as _corrupt_record when strict.

    With a key, the last record of each key by file and place stays.
    """
    if strict:
        schema = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE" if strict else "DROPMALFORMED")
    rows = _optional(lambda: reader.json(path), spark, schema)
    if key is None or not rows.columns:
        return rows
    seq = F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    return keep_last(rows.withColumn("_seq", seq), key, "_seq").drop("_seq")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object of entries by key, as rows. The file is one value and a few thousand entries at most."""
    fields = [f for f in S.REGISTRY.fields if f.name != "plant_key"]
    kind = T.MapType(T.StringType(), T.StructType(fields))
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", kind)).alias("plant_key", "_v")).select("plant_key", "_v.*")


def line_list(spark: SparkSession, path: str, name: str = "key", label: str | None = None) -> DataFrame:
    """Non-blank trimmed lines; with a label column, the file's name without its extension."""
    schema = T.StructType([T.StructField("value", T.StringType())])
    rows = _optional(lambda: spark.read.text(path), spark, schema)
    cols = [F.trim("value").alias(name)]
    if label:
        file = F.input_file_name()
        cols.append(F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.[^.]*$", "").alias(label))
    return rows.select(*cols).filter(F.col(name) != "")


def inventory(spark: SparkSession, path: str, extensions: Sequence[str] = (".jpg", ".jpeg", ".png", ".webp")) -> DataFrame:
    """(path, size, modified) of files below a folder; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return files.filter(F.rlike(F.lower("path"), F.lit("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$")))


def box_files(spark: SparkSession, path: str) -> DataFrame:
    """Boxes from text files <slug>/<image>.txt with lines 'class cx cy w h'; lines that are not five numbers are dropped."""
    rows = spark.read.option("recursiveFileLookup", True).text(path).withColumn("_f", F.input_file_name())
    p = F.split(F.trim("value"), r"\s+")
    num = lambda i: F.try_element_at(p, F.lit(i)).try_cast("double")
    out = rows.select(
        F.regexp_replace(F.element_at(F.split("_f", "/"), -1), r"\.[^.]*$", "").alias("image"), F.element_at(F.split("_f", "/"), -2).alias("slug"), num(1).cast("int").alias("class_id"),
        num(2).alias("cx"), num(3).alias("cy"), num(4).alias("w"), num(5).alias("h"),
    )
    return out.dropna()


def _named(part: Column) -> Column:
    return F.when(part == "%00", None).when(part == "%20", "").otherwise(F.url_decode(part))


def image_names(files: DataFrame) -> DataFrame:
    """dataset, slug and image of the files' names, as named_files lists them."""
    f = F.split(F.regexp_replace("file", r"\.txt$", ""), "/")
    return files.select(*(_named(F.try_element_at(f, F.lit(i))).alias(c) for i, c in ((-3, "dataset"), (-2, "slug"), (-1, "image"))))


def image_boxes(lines: DataFrame) -> DataFrame:
    """Boxes of (file, line) rows, read by named_files as a batch or a stream: dataset, slug, image and the five numbers.

    Lines that are not five numbers are dropped.  A line is taken apart once: a filter on the numbers as columns would
    be pushed down and take it apart again for each of them.
    """
    f = F.split(F.regexp_replace("file", r"\.txt$", ""), "/")
    num = lambda p, i: F.try_element_at(p, F.lit(i)).try_cast("double")
    numbers = lambda p: F.struct(num(p, 1).try_cast("int").alias("class_id"), *(num(p, i).alias(c) for i, c in enumerate(("cx", "cy", "w", "h"), 2)))
    whole = lambda v: v["class_id"].isNotNull() & reduce(and_, (v[c].isNotNull() & ~F.isnan(v[c]) for c in ("cx", "cy", "w", "h")))
    boxes = F.filter(F.transform(F.array(F.split(F.trim("line"), r"\s+")), numbers), whole)
    return lines.select(*(_named(F.try_element_at(f, F.lit(i))).alias(c) for i, c in ((-3, "dataset"), (-2, "slug"), (-1, "image"))), F.inline(boxes))


def coco(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """images, annotations (bbox as x, y, w, h) and categories of an annotation document."""
    image = "array<struct<id:bigint,file_name:string,width:int,height:int>>"
    ann = "array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,area:double,iscrowd:int>>"
    cat = "array<struct<id:int,name:string,supercategory:string>>"
    doc = spark.read.schema(f"images {image}, annotations {ann}, categories {cat}").option("multiLine", True).json(path)
    boxes = doc.select(F.inline("annotations"))
    xywh = [F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate(("x", "y", "w", "h"))]
    return {"images": doc.select(F.inline("images")), "annotations": boxes.select(*(c for c in boxes.columns if c != "bbox"), *xywh), "categories": doc.select(F.inline("categories"))}


def _coco_kinds() -> dict[str, str]:
    return {
        "images": "id bigint, file_name string, width int, height int",
        "annotations": "id bigint, image_id bigint, category_id int, bbox array<double>, area double, iscrowd int",
        "categories": "id int, name string, supercategory string",
    }


def coco_ranges(spark: SparkSession, path: str, width: int = json_document.RANGE) -> dict[str, DataFrame]:
    """As coco, of one document of any size: byte ranges are read by different tasks, what they parse is stored once."""
    kinds = _coco_kinds()
    found = json_document.values(spark, path, 2, width).filter(F.col("section").isin(*kinds))
    parsed = found.select("section", *(F.when(F.col("section") == name, F.from_json("value", kind)).alias(name) for name, kind in kinds.items()))
    rows = written(parsed, shared_dir(spark, "document"))
    own = lambda name: rows.filter(F.col("section") == name).select(f"{name}.*")
    boxes = own("annotations")
    xywh = [F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate(("x", "y", "w", "h"))]
    return {"images": own("images"), "annotations": boxes.select(*(c for c in boxes.columns if c != "bbox"), *xywh), "categories": own("categories")}


def registry_ranges(spark: SparkSession, path: str, width: int = json_document.RANGE) -> DataFrame:
    """As registry, of one object of any size."""
    fields = T.StructType([f for f in S.REGISTRY.fields if f.name != "plant_key"])
    rows = json_document.values(spark, path, 1, width)
    return rows.select(F.col("section").alias("plant_key"), F.from_json("value", fields).alias("_v")).select("plant_key", "_v.*")


def class_list(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, slug) from lines 'id slug'."""
    p = F.split(F.trim("value"), " ", 2)
    return spark.read.text(path).select(F.try_element_at(p, F.lit(1)).try_cast("int").alias("class_id"), F.try_element_at(p, F.lit(2)).alias("slug")).dropna()


def run_metrics(spark: SparkSession, path: str) -> DataFrame:
    return csv_table(spark, path, S.RUN_METRICS, required=True)
