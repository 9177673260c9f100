"""Filters, look-up joins, key-wise choice of rows, numbering and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import blank_to_null
from tessera.schema import resolve_column
from tessera.shared import shared_dir, unused, written

#: Fixed value: how file names mark early stages.
EARLY = r"_[Ee]arly[Ss]tage_|_[Ee]arly[-_][Ss]tage|Early.?Stage"


# filters


def keep_category(df: DataFrame, candidates: Sequence[str], token: str) -> DataFrame:
    """Rows whose category holds the token in any case; null is no. All rows when there is no such column."""
    name = resolve_column(df, candidates)
    return df.filter(F.coalesce(F.contains(F.lower(F.col(name)), F.lit(token.lower())), F.lit(False))) if name else df


def drop_early(df: DataFrame, file_col: str | None, stage_col: str | None, pattern: str = EARLY, word: str = "early") -> DataFrame:
    """Rows not of an early stage, by the file name or the stage column; null is no match."""
    bad = F.lit(False)
    if file_col:
        bad = bad | F.coalesce(F.rlike(F.col(file_col), F.lit(pattern)), F.lit(False))
    if stage_col:
        bad = bad | F.coalesce(F.contains(F.lower(F.col(stage_col)), F.lit(word)), F.lit(False))
    return df.filter(~bad)


def require(df: DataFrame, *cols: str) -> DataFrame:
    """Rows in which none of the columns is null or blank."""
    for c in cols:
        df = df.filter(F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)))
    return df


def overwrite_from(df: DataFrame, target: str, refined: str, clean=lambda c: c) -> DataFrame:
    """The target takes the cleaned refined value where there is one; the refined column goes."""
    return df.withColumn(target, F.when(F.nullif(F.trim(F.col(refined)), F.lit("")).isNotNull(), clean(F.col(refined))).otherwise(F.col(target))).drop(refined)


def by_cardinality(df: DataFrame, key: str, many: int = 3, one: int = 2) -> DataFrame:
    """Sample of keys with more than one row and of keys with one, least keys first: key, n."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return n.filter("n > 1").orderBy(key).limit(many).unionByName(n.filter("n = 1").orderBy(key).limit(one))


def keyword_sample(df: DataFrame, col: str, token: str, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows, in an order, whose text holds the token in any case."""
    return df.filter(F.contains(F.lower(F.col(col)), F.lit(token.lower()))).orderBy(*order).limit(n)


def first_existing(df: DataFrame, found: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by key whose key exists."""
    return df.join(found.select(key), key, "left_semi").orderBy(key).limit(n)


def present_count(df: DataFrame, col: str) -> DataFrame:
    """One row: rows in which the column is neither null nor blank, and all rows."""
    return df.agg(F.count_if(F.trim(F.col(col).cast("string")) != "").alias("present"), F.count("*").alias("n"))


def children(df: DataFrame, path: str, prefix: str) -> DataFrame:
    """Rows whose path starts with the prefix, with its depth in parts and its first part."""
    parts = F.split(F.col(path), "/")
    return df.filter(F.startswith(F.col(path), F.lit(prefix))).select("*", F.size(parts).alias("depth"), parts[0].alias("name"))


def required_present(required: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Each required key with status PASS or FAIL."""
    have = found.select(key).distinct().withColumn("_have", F.lit(True))
    return required.select(key).distinct().join(have, key, "left").select(key, F.when(F.col("_have"), "PASS").otherwise("FAIL").alias("status"))


# look-up joins


def lookup_ordered(df: DataFrame, keys: Sequence[Column], dim: DataFrame, dim_key: str, id_col: str) -> DataFrame:
    """df with the dimension's columns for the first of its candidate keys that the dimension has; null if none.

    The dimension holds a key once. Rows are matched in one equi-join over (row, key) pairs.
    """
    pairs = df.select(id_col, F.posexplode(F.array(*keys)).alias("_pos", "_key"))
    hit = pairs.join(dim, pairs["_key"] == dim[dim_key]).groupBy(id_col).agg(F.min_by(F.struct(*dim.columns), "_pos").alias("_hit"))
    return df.join(hit, id_col, "left").select(*(df[c] for c in df.columns), *(F.col(f"_hit.{c}").alias(c) for c in dim.columns if c not in df.columns))


def lookup_overwrite(df: DataFrame, dim: DataFrame, on: str, target: str, value: str) -> DataFrame:
    """The dimension's value replaces the target where the key is known."""
    d = dim.select(F.col(on), F.col(value).alias("_new"))
    return df.join(d, on, "left").withColumn(target, F.coalesce("_new", target)).drop("_new")


def lookup_default(df: DataFrame, dim: DataFrame, on: str, value: str, default: object) -> DataFrame:
    return df.join(dim.select(on, value), on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def unmatched(df: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """Distinct non-blank keys that the dimension lacks."""
    return df.select(on).filter(blank_to_null(F.col(on).cast("string")).isNotNull()).distinct().join(dim, on, "left_anti")


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return df.join(done.select(key), key, "left_anti")


def to_fetch(remote: DataFrame, local: DataFrame, key: str, size: str) -> DataFrame:
    """Remote rows that the local side lacks or has in another size, with ``local_size`` (null if not there). The local side holds a key once."""
    there = local.select(key, F.col(size).alias("local_size"))
    return remote.join(there, key, "left").filter(F.col("local_size").isNull() | (F.col("local_size") != F.col(size)))


def assembled(rows: DataFrame, hit: Column, fields: dict[str, tuple[Column | None, Column | None, object]], keep: Sequence[str] = ()) -> DataFrame:
    """Records by field: (value of the look-up, parsed value, constant).

    Where the look-up hit, its value counts, else the parsed one; the constant stands where that is null or blank.
    """
    null = F.lit(None).cast("string")

    def value(known: Column | None, parsed: Column | None, constant: object) -> Column:
        one = F.when(hit, null if known is None else known.cast("string")).otherwise(null if parsed is None else parsed.cast("string"))
        return F.coalesce(blank_to_null(one), F.lit(constant).cast("string"))

    return rows.select(*keep, *(value(*x).alias(name) for name, x in fields.items()))


def resolve_paths(df: DataFrame, candidates: Sequence[Column], inventory: DataFrame, id_col: str, path: str = "path") -> DataFrame:
    """(id, resolved): the first candidate path that the inventory has, else null."""
    pairs = df.select(id_col, F.posexplode(F.array(*candidates)).alias("pos", path))
    hit = pairs.join(inventory.select(path).distinct(), path).groupBy(id_col).agg(F.min_by(path, "pos").alias("resolved"))
    return df.select(id_col).join(hit, id_col, "left")


def path_candidates(path: Column, class_: Column, folder: str = "images") -> list[Column]:
    """Where a file may be: as given, without a table's prefix, raw as images, after 'images', its name, its class folder."""
    bare = F.regexp_replace(path, "^(butterflies|butterfly)/", "")
    bare = F.regexp_replace(bare, "^raw/", "images/")
    name = F.element_at(F.split(bare, "/"), -1)
    inner = F.when(F.rlike(bare, F.lit("(^|/)images/")), F.concat(F.lit(f"{folder}/"), F.regexp_replace(bare, "^(?:.*?/)??images/", "")))
    return [F.when(F.startswith(path, F.lit("/")), path), bare, inner, F.concat(F.lit(f"{folder}/"), name), F.concat(F.lit(f"{folder}/"), F.replace(class_, F.lit(" "), F.lit("_")), F.lit("/"), name)]


# one row per key


def keep_last(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The row with the largest seq of each key; partial aggregation, no window over a hot key.

    A null seq is less than any other; of a key with null ones only, some row stays.
    """
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(seq).isNotNull(), F.col(seq))).alias("_r")).select(*(F.col(c if c == key else f"_r.{c}").alias(c) for c in df.columns))


def keep_first(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The row with the least seq of each key; a null seq comes last."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(F.col(seq).isNull(), F.col(seq))).alias("_r")).select(*(F.col(c if c == key else f"_r.{c}").alias(c) for c in df.columns))


def last_write(df: DataFrame, key: str, value: str, priority: str, seq: str) -> DataFrame:
    """(key, value) of the row with the highest priority, then the largest seq."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(priority, seq)).alias(value))


def in_parts(df: DataFrame, order: Sequence[str], part: str, pos: str) -> DataFrame:
    """df sorted over range partitions, with the partition and the place in it (from 0).

    The sorted rows are stored once in the shared folder, so every later step sees the same partitions,
    and the input is read and shuffled once. A stored place doesn't change when a task is repeated.
    """
    at = unused([*df.columns, part, pos], "_at")
    rows = written(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), shared_dir(df.sparkSession, "sorted"))
    # the generated id is the partition's number times 2^33 plus the place
    return rows.withColumns({part: F.shiftright(F.col(at), 33), pos: F.col(at).bitwiseAND(F.lit((1 << 33) - 1))}).drop(at)


def numbered(df: DataFrame, order: Sequence[str], name: str = "image_id", first: int = 1) -> DataFrame:
    """Numbers first, first+1, ... in an order, without all rows in one task.

    A partition of the sorted rows starts after the number of rows before it. The order should be total; equal
    rows are numbered in any order. Nulls come first.
    """
    part, pos, n = (unused([*df.columns, name], x) for x in ("_part", "_pos", "_n"))
    rows = in_parts(df, order, part, pos)
    sizes = rows.groupBy(part).agg(F.count("*").alias(n))
    before = F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))  # one row per partition
    starts = sizes.select(part, F.coalesce(before, F.lit(0)).alias(n))
    return rows.join(F.broadcast(starts), part).withColumn(name, (F.col(n) + F.col(pos) + first).cast("long")).drop(part, pos, n)


def next_id(df: DataFrame, col: str) -> DataFrame:
    """One row: the largest usable id plus one; bad ids are ignored."""
    return df.agg((F.coalesce(F.max(F.col(col).cast("string").try_cast("bigint")), F.lit(0)) + 1).alias("next_id"))


def append_ids(new: DataFrame, order: Sequence[str], existing: DataFrame, col: str) -> DataFrame:
    """New rows numbered on from the existing table's largest id."""
    return numbered(new, order, "_n").crossJoin(F.broadcast(next_id(existing, col))).withColumn(col, F.col("next_id") + F.col("_n") - 1).drop("_n", "next_id")


def upsert_registry(entries: DataFrame, key: str, seq: str, scalars: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """One row per key: scalars of its first entry; arrays grow by what is new, in order of seq.

    Items are made distinct by key before they are gathered, so a key that has many entries holds no more than its
    result does.  Null arrays add nothing; a key with null ones only has null.  Null items are items.
    """
    first = entries.groupBy(key).agg(*([F.min_by(F.struct(*scalars), seq).alias("_s")] if scalars else [F.count("*").alias("_s")]))
    out = first.select(key, *(F.col(f"_s.{s}").alias(s) for s in scalars))
    for a in arrays:
        items = entries.filter(F.col(a).isNotNull()).select(F.col(key).alias("_k"), F.col(seq).alias("_q"), F.posexplode_outer(a).alias("_p", "_v"))
        new = items.groupBy("_k", "_v", F.col("_p").isNull().alias("_none")).agg(F.min(F.struct("_q", "_p")).alias("_at"))
        whole = F.transform(F.array_sort(F.collect_list(F.when(~F.col("_none"), F.struct("_at", F.struct("_v").alias("_v"))))), lambda x: x["_v"]["_v"])
        grown = new.groupBy("_k").agg(whole.alias(a))
        out = out.join(grown, out[key].eqNullSafe(grown["_k"]), "left").drop("_k")
    return out.select(key, *scalars, *arrays)


# sets


def merge_logs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def merge_ordered(lists: Sequence[DataFrame], key: str, pos: str) -> DataFrame:
    """Keys of several ordered lists, earlier lists first, each once: key, rank (list), pos."""
    rows = [x.select(key, F.lit(i).alias("rank"), F.col(pos).alias("pos")) for i, x in enumerate(lists)]
    all_ = rows[0]
    for r in rows[1:]:
        all_ = all_.union(r)
    return all_.groupBy(key).agg(F.min(F.struct("rank", "pos")).alias("_m")).select(key, F.col("_m.rank").alias("rank"), F.col("_m.pos").alias("pos"))


def two_way_difference(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Keys that only one side has, with the side."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(True)), b.select(key).distinct().withColumn("_b", F.lit(True))
    return x.join(y, key, "full_outer").filter("_a is null or _b is null").select(key, F.when(F.col("_a"), names[0]).otherwise(names[1]).alias("only_in"))
