"""Literal cases of every text and number function."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import numbers, text
from tessera.functions.dims import LONG_STATES, STATES, ZONES, month_name, state_zones
from tessera.schema import renamed, resolve_column

S = F.lit


def value(spark, c):
    r = spark.range(1).select(c.alias("v")).first().v
    return r.asDict() if hasattr(r, "asDict") else r


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: text.clean_text(S(" a  \n b ")), "a b"),
        (lambda: text.clean_noise(S("aaabbbb Foo")), "ab Foo"),
        (lambda: text.clean_noise(S("mmm emma Pune rstvwx 1.")), "m Pune"),
        (lambda: text.clean_noise(S("mmm emma Pune rstvwx 1."), words_first=True), "Pune"),
        (lambda: text.clean_noise(S("ab cd ef gh ij kl")), ""),
        (lambda: text.clean_noise(S(None).cast("string")), None),
        (lambda: text.clean_refined(S("..a.b. Pune")), "Pune"),
        (lambda: text.clean_refined(S("-- gemma {Pune@ x} te")), "(Pune x)"),
        (lambda: text.clean_media_code(S("MediaCode:AB-12!")), "AB-12"),
        (lambda: text.parse_top(S("Papilio paris\nParis Peacock    Media code: AB12")), {"scientific_name": "Papilio paris", "common_name": "Paris Peacock", "media_code": "AB12"}),
        (lambda: text.parse_top(S("A b\nA b")), {"scientific_name": "A b", "common_name": None, "media_code": None}),
        (lambda: text.parse_top(S("A b\nFabaceae media code AX9"), "family", False), {"scientific_name": "A b", "family": "Fabaceae", "media_code": "AX9"}),
        (lambda: text.parse_top(S(" \n")), {"scientific_name": None, "common_name": None, "media_code": None}),
        (lambda: text.parse_top_items(F.array(S("A b"), S("Media code: Q1"))), {"scientific_name": "A b", "common_name": None, "media_code": "Q1"}),
        (lambda: text.parse_bottom(S("Male. Goalpara, Assam. 2021/03/04. ©A. Person")), {"sex": "Male", "location": "Goalpara, Assam", "date": "2021/03/04", "credit": "A. Person"}),
        (lambda: text.parse_bottom(S("Femalex, Goa")), {"sex": None, "location": "Femalex, Goa", "date": None, "credit": None}),
        (lambda: text.parse_bottom_items(F.array(S("female. Pune"), S("2020/01/02"), S("© Me"))), {"sex": "Female", "location": "Pune", "date": "2020/01/02", "credit": "Me"}),
        (lambda: text.extract_state(S("Goalpara, Assam")), "Assam"),
        (lambda: text.extract_state(S("Andaman Islands")), "Daman"),
        (lambda: text.extract_state(S("Andaman Islands"), whole_words=True), None),
        (
            lambda: text.parse_polluted_location(S("Female, Pune, Maharashtra, India 2020-1-5 ©X"), *[S(None).cast("string")] * 4),
            {"location": "Pune, Maharashtra", "sex": "Female", "state": "Maharashtra", "date": "2020/1/5", "credit": "X"},
        ),
        (lambda: text.parse_polluted_location(S("Male Pune"), S("nan"), S("Goa"), S("d"), S("c"))["sex"], "Male"),
        (lambda: text.common_name_from_title(S("Genus species - Common Name | Site")), "Common Name"),
        (lambda: text.common_name_from_title(S("No dash")), None),
        (lambda: text.make_key(S(" Abutilon  indicum (L.)")), "Abutilon_indicum_L"),
        (lambda: text.make_key(S("??")), "Unknown_Plant"),
        (lambda: text.url_slug(S("https://x/a/Foo-bar//")), "Foo-bar"),
        (lambda: text.output_name(S("A/b c"), S("egg"), S(7), S("http://x/y.JPEG?z")), "A-bc_egg_007.JPEG"),
        (lambda: text.rewrite_path(S("data/Foo-bar/a.jpg")), "data/butterflies/raw/Foo-bar/a.jpg"),
        (lambda: text.rewrite_path(S("host_plants/X/b.jpg")), "data/plants/raw/X/b.jpg"),
        (lambda: text.rewrite_path(S("Y_z/c.jpg")), "data/plants/raw/Y_z/c.jpg"),
        (lambda: text.rewrite_path(S("data/plants/raw/q")), "data/plants/raw/q"),
        (lambda: text.rewrite_path(S("README.md")), "README.md"),
        (lambda: text.stem(S("a/b.c.jpg")), "b.c"),
        (lambda: text.extension(S("a.b/noext")), ""),
        (lambda: text.display_name(S(None).cast("string"), S(None).cast("string")), None),
        (lambda: text.display_name(S("Papilio"), S(None).cast("string")), "Papilio"),
        (lambda: text.digits_to_long(S("12a")), None),
        (lambda: text.digits_to_long(S("0012")), 12),
        (lambda: text.join_hosts(F.array(S("Papilio demoleus"), S("http://x"), S("Graphium"))), "Papilio demoleus, Graphium"),
        (lambda: text.map_get(F.create_map(S("a"), S("b")), "z"), "Unknown"),
        (lambda: text.merge_maps(F.create_map(S("a"), S("1"), S("b"), S("2")), F.create_map(S("b"), S("3"))), {"a": "1", "b": "3"}),
        (lambda: text.blank_to_null(S(" NaN ")), None),
        (lambda: numbers.month_text(S("2021/77/01")), "77"),
        (lambda: numbers.month_of(S("2021/77/01")), None),
        (lambda: numbers.month_of(S("2021/12/31")), 12),
        (lambda: numbers.month_of(S("2020/1/5")), 1),
        (lambda: month_name(S(3)), "March"),
        (lambda: month_name(S(13)), None),
        (lambda: F.transform(numbers.cyclic_month(S(12)), lambda x: F.round(x, 6) + 0.0), [0.0, 1.0]),
        (lambda: F.transform(numbers.cyclic_month(S(3)), lambda x: F.round(x, 6) + 0.0), [1.0, 0.0]),
        (lambda: numbers.cyclic_month(S(13)), [0.0, 0.0]),
        (lambda: numbers.cyclic_month(S(None).cast("int")), [0.0, 0.0]),
        (lambda: numbers.percent(S(1), S(0)), 0.0),
        (lambda: numbers.percent(S(1), S(3)), 33.3),
        (lambda: numbers.corner_box(*map(S, (0.5, 0.5, 0.5, 0.25, 1000, 800))), {"x": 250.0, "y": 300.0, "w": 500.0, "h": 200.0, "area": 100000.0}),
        (lambda: numbers.crop_rows(S(601)), {"top": 72, "bottom": 540, "ok": True}),
        (lambda: numbers.crop_rows(S(100), 0.6, 0.4)["ok"], False),
        (lambda: numbers.arg_max(F.array(*map(S, (1.0, 3.0, 3.0)))), 1),
        (lambda: numbers.top_indices(F.array(*map(S, (1.0, 3.0, 2.0, 3.0))), 3), [1, 3, 2]),
        (lambda: numbers.is_recent(S(dt.datetime(2024, 1, 1, 0, 0)), S(dt.datetime(2024, 1, 1, 0, 9, 59))), True),
        (lambda: numbers.is_recent(S(dt.datetime(2024, 1, 1, 0, 0)), S(dt.datetime(2024, 1, 1, 0, 10))), False),
        (lambda: numbers.is_recent(S(dt.datetime(2024, 1, 1, 0, 0, 0, 1)), S(dt.datetime(2024, 1, 1, 0, 10))), True),
        (lambda: numbers.is_recent(S(dt.datetime(2024, 1, 1, 0, 0)), S(dt.datetime(2024, 1, 1, 0, 9, 59, 999_999))), True),
    ],
)
def test_literal_cases(spark, make, want):
    assert value(spark, make()) == want


def test_dimensions(spark):
    zones = {r.state: (r.zone, r.zone_idx) for r in state_zones(spark).collect()}
    assert zones["Kerala"] == ("Western Ghats", 0) and zones["Dadar"] == zones["Dadra"] == ("Deccan Plateau", 1) and "Lakshadweep" not in zones
    assert len(STATES) == len(LONG_STATES) == 37 and len(ZONES) == 9


def test_columns_by_candidates(spark):
    df = spark.createDataFrame([(1, 2)], "taxon int, file int")
    assert resolve_column(df, ["species", "taxon"]) == "taxon" and resolve_column(df, ["x"]) is None
    assert renamed(df, {"species": ["taxon"], "none": ["q"]}).columns == ["species", "file"]
    with pytest.raises(ValueError, match="none of"):
        resolve_column(df, ["x"], required=True)
