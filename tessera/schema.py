"""Schemas of the curated tables and look-up of columns by candidate names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _strings(names: str, **other: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, other.get(n, T.StringType())) for n in names.split()])


LONG, DOUBLE, INT = T.LongType(), T.DoubleType(), T.IntegerType()
TEXTS, TEXT_MAP = T.ArrayType(T.StringType()), T.MapType(T.StringType(), T.StringType())

ANIMAL_METADATA = _strings(
    "image_id filename raw_filename species common_name family subfamily genus order life_stage sex media_code location state date credit source_url source split", image_id=LONG
)
PLANT_METADATA = _strings("image_id filename raw_filename species family genus image_type media_code location state date credit butterfly_hosts source_url source split", image_id=LONG)
STATUS = T.StructType([T.StructField("description", TEXTS), T.StructField("sightings", T.ArrayType(TEXT_MAP))])
PAGE_RECORD = _strings(
    "file_name dataset_source source_url image_id life_stage page_title taxonomy early_text distribution status larval_host_plants", taxonomy=TEXT_MAP, early_text=TEXTS, status=STATUS
)
PLANT_RECORD = _strings(
    "file_name image_type alt plant_key plant_scientific plant_common plant_family plant_genus plant_species taxonomy source_url dataset_source butterfly_hosts", taxonomy=TEXT_MAP, butterfly_hosts=TEXTS
)
REGISTRY = _strings(
    "plant_key plant_scientific plant_common plant_family taxonomy common_names source_url butterfly_species images", taxonomy=TEXT_MAP, common_names=TEXT_MAP, butterfly_species=TEXTS, images=TEXTS
)
BOXES = _strings("dataset slug image class_id cx cy w h score", class_id=INT, cx=DOUBLE, cy=DOUBLE, w=DOUBLE, h=DOUBLE, score=DOUBLE)
CLASS_LIST = _strings("class_id slug", class_id=INT)
INVENTORY = _strings("path type size", size=LONG)
RUN_METRICS = T.StructType([T.StructField("epoch", INT), *(T.StructField(n, DOUBLE) for n in "train_loss val_loss train_acc val_acc val_f1 val_precision lr".split())])
ATTEMPTS = T.StructType([T.StructField("seq", LONG), T.StructField("key", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("ok", T.BooleanType())])


def resolve_column(df: DataFrame, candidates: Sequence[str], required: bool = False) -> str | None:
    """The first candidate that df has. Looks at names only; no job runs."""
    for name in candidates:
        if name in df.columns:
            return name
    if required:
        raise ValueError(f"none of {list(candidates)} is a column; there are {df.columns}")
    return None


def renamed(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Columns found by candidate names under their standard ones; the others stay."""
    for name, candidates in aliases.items():
        found = resolve_column(df, [name, *candidates])
        if found and found != name:
            df = df.withColumnRenamed(found, name)
    return df
