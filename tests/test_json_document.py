"""One document in byte ranges: the same values at any width, and there and back."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import json_document as J


def odd_document(seed):
    rng = random.Random(seed)
    texts = ['"', "\\", '\\"', "{", "]", "a" * 50, "é😀", '\\\\"}', "", ", ", ": "]
    text = lambda: "".join(rng.choice(texts) for _ in range(rng.randrange(6)))
    item = lambda d: {text(): item(d - 1) for _ in range(2)} if d and rng.random() < 0.6 else [item(d - 1)] if d and rng.random() < 0.5 else rng.choice([text(), 1.5, None, True])
    doc = {"first " + text(): [{"id": i, "x": item(3)} for i in range(20)], "n": 3, "s": text(), "empty": [], "o": {"k": [1], "l": {"id": 7}, "m": 2}, "k" * 400 + '\\" "': [[i, text()] for i in range(15)], "last": [{}]}
    return doc


@pytest.mark.parametrize("width", [7, 61, 1 << 20])
@pytest.mark.parametrize("indent", [None, 1])
def test_values_at_any_width(spark, tmp_path, width, indent):
    doc = odd_document(width)
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=width == 61), encoding="utf-8")
    whole = (tmp_path / "d.json").read_bytes()
    if len(whole) // width > 60:  # few tasks in a test: ranges of a long document are checked without Spark
        got = []
        state, section = J.Scan(), None
        for start in range(0, len(whole), width):
            end = min(len(whole), start + width)
            for place, key, text in J._events(f"{tmp_path}/d.json", 2, start, end, state.inside, state.depth, True):
                if text is None:
                    section = key
                else:
                    got.append((place, section, text.decode()))
            state.block(whole[start:end])
    else:
        got = sorted(map(tuple, J.values(spark, f"file://{tmp_path}/d.json", 2, width).collect()))
    want = [(k, x) for k, v in doc.items() if isinstance(v, (list, dict)) for x in (v if isinstance(v, list) else v.values()) if isinstance(x, (list, dict))]
    assert [(s, json.loads(v)) for _, s, v in sorted(got)] == want
    top = sorted(map(tuple, J.values(spark, f"{tmp_path}/d.json", 1, max(width, 300)).collect()))
    assert [(s, json.loads(v)) for _, s, v in top] == [(k, v) for k, v in doc.items() if isinstance(v, (list, dict))]


def test_states_at_the_start_of_ranges(spark, tmp_path):
    text = json.dumps({"a": ['\\' * 200 + '"', "{{{"], "b": {"c": '"' * 50}}).encode()
    (tmp_path / "d.json").write_bytes(text)
    for width in (13, 40):
        scan, want = J.Scan(), []
        for i in range(0, len(text), width):
            want.append((i // width, int(scan.inside), scan.depth))
            scan.block(text[i : i + width])
        got = J._entered(J._ranges(spark, len(text), width).coalesce(2), f"{tmp_path}/d.json").select("number", "inside", "depth")
        assert sorted(map(tuple, got.collect())) == want


def test_there_and_back(spark, tmp_path):
    rows = [(i, 'x"{' * (i % 5), None if i % 3 else [float(i)]) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, name string, v array<double>").repartition(6)
    path = f"{tmp_path}/x/doc.json"
    J.write_sections(path, {"rows": (df, ["id"]), "none": (df.limit(0), ["id"]), "few": (df.filter("id < 2"), ["id"])})
    doc = json.load(open(path, encoding="utf-8"))
    assert doc["rows"] == [{"id": i, "name": n} | ({"v": v} if v else {}) for i, n, v in rows] and doc["none"] == [] and len(doc["few"]) == 2
    back = J.values(spark, path, 2, 4096)
    assert [json.loads(r.value) for r in back.filter("section = 'rows'").orderBy("place").collect()] == doc["rows"]
    J.write_entries(f"{tmp_path}/e.json", df.select(F.concat(F.lit('k"é'), "id").alias("key"), "name"), "key")
    entries = json.load(open(f"{tmp_path}/e.json", encoding="utf-8"))
    assert entries == {f'k"é{i}': {"name": n} for i, n, _ in rows} and list(entries) == sorted(entries)
    assert {r.section: json.loads(r.value) for r in J.values(spark, f"{tmp_path}/e.json", 1, 1000).collect()} == entries
    J.write_entries(path, df.limit(0), "id")  # replaces the document
    assert json.load(open(path)) == {} and J.values(spark, path, 1).collect() == []


def test_rows_are_written_again_at_the_same_places(tmp_path):
    import pyarrow as pa

    file = f"{tmp_path}/f"
    open(file, "wb").write(b"........")
    batch = pa.RecordBatch.from_pydict({"at": [1, 3, 6], "text": [b"ab", b"c", b"d"]})
    for _ in range(2):
        list(J._at_places(file)(iter([batch])))
    assert open(file, "rb").read() == b".abc..d."


def test_a_long_document_makes_wide_ranges(spark, tmp_path):
    """Tasks follow the session's partitions, not the document's length; a range that no section can open in is not read for one."""
    doc = {"first": [{"id": i, "s": '}]"\\' * (i % 3)} for i in range(6000)], "second": {"k": [[i] for i in range(3000)]}}
    (tmp_path / "d.json").write_text(json.dumps(doc), encoding="utf-8")
    got = J.values(spark, f"{tmp_path}/d.json", 2, 100)
    most = J.RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert (tmp_path / "d.json").stat().st_size > 1000 * most and got.rdd.getNumPartitions() <= most
    assert [(r.section, json.loads(r.value)) for r in got.orderBy("place").collect()] == [("first", x) for x in doc["first"]] + [("second", doc["second"]["k"])]
    whole, want, scan = (tmp_path / "d.json").read_bytes(), [], J.Scan()
    for i in range(0, len(whole), 10_000):
        begin = scan.depth
        want.append(min([begin, *scan.block(whole[i : i + 10_000])[1].tolist()]))
    low = [r.low for r in J._entered(J._ranges(spark, len(whole), 10_000), f"{tmp_path}/d.json").orderBy("number").collect()]
    assert low == want and sum(x < 2 for x in low) <= 3
