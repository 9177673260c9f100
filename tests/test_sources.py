"""Readers and writers, there and back."""

import pytest
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.operators import boxes
from tessera.sources import readers, writers


def test_csv_and_missing_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', None), (2, "x\ny", "z")], "image_id long, filename string, species string")
    wide = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in S.ANIMAL_METADATA.fields))
    writers.csv_table(wide, f"{tmp_path}/butterflies/metadata.csv")
    got = readers.metadata(spark, str(tmp_path))
    assert {(r.image_id, r.filename, r.species, r.dataset) for r in got.collect()} == {(1, 'a "q", b', None, "butterflies"), (2, "x\ny", "z", "butterflies")}
    assert "butterfly_hosts" in got.columns and "common_name" in got.columns
    assert readers.csv_table(spark, f"{tmp_path}/none.csv", S.RUN_METRICS).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.run_metrics(spark, f"{tmp_path}/none.csv").count()


def test_json_records(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.jsonl").write_text('{"file_name": "f1", "page_title": "old"}\n\n{bad\n{"file_name": "f1", "page_title": "new", "taxonomy": {"Family": "X"}}\n{"file_name": "f2"}\n')
    rows = {r.file_name: r for r in readers.json_records(spark, f"{tmp_path}/r", S.PAGE_RECORD, "file_name").collect()}
    assert set(rows) == {"f1", "f2"} and rows["f1"].page_title == "new" and rows["f1"].taxonomy == {"Family": "X"}
    strict = readers.json_records(spark, f"{tmp_path}/r", S.PAGE_RECORD, strict=True).cache()
    assert strict.filter("_corrupt_record is not null").count() == 1


def test_registry_lists_and_classes(spark, tmp_path):
    (tmp_path / "reg.json").write_text('{"A_b": {"plant_common": "x", "images": ["i"]}, "C": {"butterfly_species": ["s", "t"]}}')
    assert {(r.plant_key, r.plant_common, tuple(r.butterfly_species or ())) for r in readers.registry(spark, f"{tmp_path}/reg.json").collect()} == {("A_b", "x", ()), ("C", None, ("s", "t"))}
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "train.txt").write_text("a.jpg\n\n b.jpg \n")
    (tmp_path / "lists" / "val.txt").write_text("c.jpg\n")
    assert {tuple(r) for r in readers.line_list(spark, f"{tmp_path}/lists", "filename", "split").collect()} == {("a.jpg", "train"), ("b.jpg", "train"), ("c.jpg", "val")}
    assert readers.line_list(spark, f"{tmp_path}/no").count() == 0
    classes = spark.createDataFrame([(1, "b c"), (0, "a")], "class_id int, slug string")
    writers.class_list(classes, f"{tmp_path}/classes")
    assert {tuple(r) for r in readers.class_list(spark, f"{tmp_path}/classes").collect()} == {(0, "a"), (1, "b c")}


def test_inventory_and_boxes(spark, tmp_path):
    for p in ("x/a.jpg", "x/y/B.PNG", "x/c.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"1234")
    assert sorted(r.path.rsplit("/", 1)[1] for r in readers.inventory(spark, f"{tmp_path}/x").collect()) == ["B.PNG", "a.jpg"]
    (tmp_path / "lab" / "slug").mkdir(parents=True)
    (tmp_path / "lab" / "slug" / "im.txt").write_text("3 0.5 0.5 0.25 0.125\nbad line\n")
    assert [tuple(r) for r in readers.box_files(spark, f"{tmp_path}/lab").collect()] == [("im", "slug", 3, 0.5, 0.5, 0.25, 0.125)]
    b = spark.createDataFrame([("d", "s", "i", 3, 0.5, 0.5, 0.25, 0.125)], "dataset string, slug string, image string, class_id int, cx double, cy double, w double, h double")
    writers.box_files(boxes.yolo_lines(b).join(b.select("image", "dataset", "slug"), "image"), f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").first().value == "i\t3 0.500000 0.500000 0.250000 0.125000"


def test_annotation_document_and_small_outputs(spark, tmp_path):
    images = spark.createDataFrame([(1, "a.jpg", 10, 20)], "id long, file_name string, width int, height int")
    ann = spark.createDataFrame([(5, 1, 2, [1.0, 2.0, 3.0, 4.0], 12.0, 0)], "id long, image_id long, category_id int, bbox array<double>, area double, iscrowd int")
    cats = spark.createDataFrame([(2, "slug", "plants")], "id int, name string, supercategory string")
    writers.coco_document(images, ann, cats, f"{tmp_path}/coco")
    got = readers.coco(spark, f"{tmp_path}/coco")
    assert tuple(got["images"].first()) == (1, "a.jpg", 10, 20) and tuple(got["annotations"].select("x", "y", "w", "h").first()) == (1.0, 2.0, 3.0, 4.0) and got["categories"].first().name == "slug"
    with pytest.raises(ValueError, match="more than 0 rows"):
        writers.coco_document(images, ann, cats, f"{tmp_path}/no", 0)
    writers.coco_tables(images, ann, cats, f"{tmp_path}/tables")
    assert spark.read.json(f"{tmp_path}/tables/annotations").count() == 1
    run = spark.createDataFrame([(1, 0.123456)], "epoch int, train_loss double")
    for _ in range(2):
        writers.append_metrics(run, f"{tmp_path}/m")
    assert [r.train_loss for r in readers.run_metrics(spark, f"{tmp_path}/m").collect()] == [0.1235, 0.1235]
    splits = spark.createDataFrame([("b", "train"), ("a", "train"), ("c", "val")], "filename string, split string")
    writers.split_lists(splits, f"{tmp_path}/s")
    assert {(r.value, r.split) for r in spark.read.text(f"{tmp_path}/s").collect()} == {("a", "train"), ("b", "train"), ("c", "val")}
    writers.manifest(spark.createDataFrame([("x", "failed"), ("x", "processed")], "slug string, status string"), "slug", "status", f"{tmp_path}/man")
    assert spark.read.json(f"{tmp_path}/man").select("processed", "skipped", "failed").first() == (1, 0, 1)
    assert "| a | train |" in writers.markdown({"Splits": splits.orderBy("filename")})
    writers.report(splits.limit(1), f"{tmp_path}/r")
    writers.json_records(splits, f"{tmp_path}/j")
    writers.json_records(splits, f"{tmp_path}/j", append=True)
    assert spark.read.json(f"{tmp_path}/j").count() == 6
