"""Files whose names are a column: one for each name, none doubled, batch and stream."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.sources import named_files as N
from tessera.sources import readers, writers


def files(path):
    return {os.path.relpath(f"{d}/{f}", path): open(f"{d}/{f}", encoding="utf-8").read() for d, _, fs in os.walk(path) for f in fs if "_commits" not in d}


def frame(spark, rows):
    return spark.createDataFrame(rows, "file string, line string, i int")


def test_one_file_for_each_name(spark, tmp_path):
    rows = [(f"d{i % 3}/f{i % 40}.txt", f"line é {i}", -i) for i in range(200)] + [("top.txt", None, 0), ("d0/empty.txt", None, 1), ("d0/empty.txt", None, 2)]
    path = f"{tmp_path}/w"
    for _ in range(2):
        N.write_named(frame(spark, rows), path, "i")
    want = {}
    for f, line, _ in sorted(rows, key=lambda r: (r[0], r[2])):
        want[f] = want.get(f, "") + ("" if line is None else line + "\n")
    assert files(path) == want
    got = N.read_named(spark, path, 7)
    assert sorted(map(tuple, got.collect())) == sorted((f, x) for f, x, _ in rows if x is not None)
    assert got.rdd.getNumPartitions() > 5
    some = got.filter(F.startswith("file", F.lit("d1/")))
    assert {r.file for r in some.collect()} == {f for f in want if f.startswith("d1/")}
    assert [r.line for r in got.filter("file = 'd1/f1.txt'").collect()] == want["d1/f1.txt"].split("\n")[:-1]
    assert got.filter("file in ('d1/f1.txt', 'nowhere.txt')").count() == len(want["d1/f1.txt"].split("\n")) - 1


def test_folders_left_out_are_not_listed(tmp_path):
    reader = N.Reader(str(tmp_path), 10)
    for f in ("a/x.txt", "b/c/y.txt", "z.txt"):
        N.Store(str(tmp_path)).write(f, [b"1\n"])
    list(reader.pushFilters([N.EqualTo(("file",), "b/c/y.txt")]))
    assert {f for p in reader.partitions() for f, _, _ in p.parts} == {"", "b", "b/c"}
    assert [b.column(0).to_pylist() for p in reader.partitions() for b in reader.read(p) if len(b)] == [["b/c/y.txt"]]


def test_repeated_and_lost_tasks(tmp_path):
    batch = lambda rows: iter([pa.RecordBatch.from_pylist([{"file": f, "line": x} for f, x in rows], schema=pa.schema({"file": pa.string(), "line": pa.string()}))])
    one, two = [("a/1", "x"), ("a/2", "y"), ("a/2", "z")], [("b/1", "w")]
    writer = N.Writer(str(tmp_path))
    writer.write(batch(two))  # an attempt that is lost after it wrote
    messages = [writer.write(batch(rows)) for rows in (one, one, two)][1:]
    writer.commit([*messages, None, writer.write(batch([]))])
    assert files(tmp_path) == {"a/1": "x\n", "a/2": "y\nz\n", "b/1": "w\n"}
    stream = N.Writer(str(tmp_path), "q/0")
    for _ in range(2):  # a batch that is committed again
        stream.commit([stream.write(batch([("b/1", "new")]))])
    assert N.StreamReader(str(tmp_path)).latestOffset() == {"commit": 2}
    with pytest.raises(ValueError, match="come together"):
        writer.write(batch([("a/1", "x"), ("a/2", "y"), ("a/1", "z")]))
    for bad in ("", "../x", "a//b", ".h", "a/_b", None):
        with pytest.raises(ValueError, match="not a file"):
            writer.write(batch([(bad, "x")]))


def test_streams(spark, tmp_path):
    path, out = f"{tmp_path}/in", []
    for turn in range(3):
        N.write_named(frame(spark, [(f"t{turn}/{i}", str(turn), 0) for i in range(10)]), path)
        q = N.stream_named(spark, path).writeStream.foreachBatch(lambda df, _: out.append(df.count())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    assert out == [10, 10, 10]
    frame(spark, [("x/1", "a", 0), ("x/2", "b", 0)]).drop("i").write.parquet(f"{tmp_path}/p")
    lines = spark.readStream.schema("file string, line string").parquet(f"{tmp_path}/p")
    N.write_stream(lines, f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination()
    assert files(f"{tmp_path}/out") == {"x/1": "a\n", "x/2": "b\n"}


def test_boxes_of_images_with_odd_names(spark, tmp_path):
    names = ["im 1", "a/b", "..", "_x", ".h", "", None, "é%2F+", "x" * 100]
    rows = [("d", "s", n, i, 0.5, 0.25, 0.125, i / 64) for i, n in enumerate(names)] + [("d", None, "im 1", 3, 0.0, 0.0, 1.0, 1.0), ("d", "s", "none", None, None, None, None, None)]
    boxes = spark.createDataFrame(rows, "dataset string, slug string, image string, class_id int, cx double, cy double, w double, h double")
    writers.image_boxes(boxes, f"{tmp_path}/w")
    assert len(files(f"{tmp_path}/w")) == len(rows)
    got = readers.image_boxes(N.read_named(spark, f"{tmp_path}/w"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((r for r in rows if r[3] is not None), key=str)
    N.Store(f"{tmp_path}/w").write("d/s/none.txt", [b"1 2 bad\n", b"1 0 0 1 1\n"])
    assert got.filter("image = 'none'").collect()[0][3:] == (1, 0.0, 0.0, 1.0, 1.0)


def test_files_are_listed_by_a_bounded_number_of_tasks(spark, tmp_path):
    store = N.Store(str(tmp_path))
    for i in range(50):
        store.write(f"d/s/im {i}.txt", [b""] if i % 2 else [b"1 0 0 1 1\n"])
    N._Commits(str(tmp_path)).add([N.Written("x", {"d/s": 50_000_000})])
    reader = N.Reader(str(tmp_path), 10, 8, lines=False)
    parts = reader.partitions()
    assert len(parts) <= 9
    found = [f for p in parts for b in reader.read(p) for f in b.column(0).to_pylist()]
    assert sorted(found) == sorted(f"d/s/im {i}.txt" for i in range(50))
    got = readers.image_names(N.list_named(spark, str(tmp_path)))
    assert sorted(map(tuple, got.collect())) == sorted(("d", "s", f"im {i}") for i in range(50))


def test_a_line_is_taken_apart_once(spark):
    lines = spark.createDataFrame([("d/s/i.txt", x) for x in (" 1  0.5\t1 2e0 -3 x", "1.9 0 0 0 0", "1 0 0 0", "a 0 0 0 0", "1 NaN 0 0 0", "NaN 0 0 0 0", "1 Infinity 0 0 0", "", None)], "file string, line string")
    boxes = readers.image_boxes(lines)
    assert boxes.dtypes == [("dataset", "string"), ("slug", "string"), ("image", "string"), ("class_id", "int")] + [(c, "double") for c in ("cx", "cy", "w", "h")]
    got = sorted(tuple(r)[3:] for r in boxes.collect())
    assert {tuple(r)[:3] for r in boxes.collect()} == {("d", "s", "i")}
    assert got == [(1, 0, 0, 0, 0), (1, 0.5, 1, 2, -3), (1, float("inf"), 0, 0, 0)]
    assert boxes._jdf.queryExecution().optimizedPlan().toString().count("split(trim(line") == 1
