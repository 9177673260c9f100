"""Column expressions that parse and clean text. All are built-in functions; a null text gives null."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.dims import LONG_STATES, NOISE_WORDS, REFINED_NOISE, STATES

SPACE = r"(?U)\s+"
EMPTY_WORDS = ["", "nan", "none"]
#: Fixed value: how overlay texts name a media code.
MEDIA_CODE = r"(?U)[Mm]edia\s*code[:\s]+(\S+)"


def blank_to_null(c: Column, words: list[str] = EMPTY_WORDS) -> Column:
    """Null for text that stands for a missing value."""
    return F.when(~F.lower(F.trim(c)).isin(words), c)


def clean_text(c: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def strip(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def _match(c: Column, rx: str, group: int = 1) -> Column:
    """First match or null."""
    return F.when(F.rlike(c, F.lit(rx)), F.regexp_extract(c, rx, group))


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def clean_noise(c: Column, noise: list[str] = NOISE_WORDS, words_first: bool = False) -> Column:
    """Drop what text recognition makes of image noise.

    Runs of three or more equal letters become one letter, other characters than letters, digits and ``.,()/-©@``
    a blank; words go that are noise, that have at most two characters not all letters, or over five and no
    vowel (y counts).  More than five words without a longer one or a capital are nothing but noise.
    words_first tests for noise words before runs are shortened.
    """
    bare = lambda w: strip(F.lower(w), ".,()/-")
    text = clean_text(c)
    if words_first:
        text = F.array_join(F.filter(_words(text), lambda w: ~bare(w).isin(noise)), " ")
    text = F.regexp_replace(text, r"([a-zA-Z])\1{2,}", "$1")
    text = F.regexp_replace(text, r"(?U)[^a-zA-Z0-9\s.,()/\-©@]", " ")
    junk = lambda b: b.isin(noise) | ((F.length(b) <= 2) & ~F.rlike(b, F.lit("^[a-z]+$"))) | ((F.length(b) > 5) & ~F.rlike(b, F.lit("[aeiouy]")))
    pairs = F.transform(_words(text), lambda w: F.struct(w.alias("word"), bare(w).alias("bare")))
    kept = F.transform(F.filter(pairs, lambda x: ~junk(x["bare"])), lambda x: x["word"])
    text = strip(clean_text(F.array_join(kept, " ")), " ,.-;")
    nothing = lambda t: ~F.rlike(t, F.lit(r"(?U)\S{3,}|[A-Z]")) & (F.size(_words(t)) > 5)
    return _once(text, lambda t: F.when(nothing(t), F.lit("")).otherwise(t))


def clean_refined(c: Column, noise: list[str] = REFINED_NOISE) -> Column:
    """Second clean-up: ends without letters or digits, noise words and dotted abbreviations go, braces become parentheses."""
    text = F.regexp_replace(F.regexp_replace(c, "^[^a-zA-Z0-9]+", ""), "[^a-zA-Z0-9]+$", "")
    bare = lambda w: strip(F.lower(w), ".,()/-")
    kept = F.filter(_words(text), lambda w: ~bare(w).isin(noise) & ~F.rlike(bare(w), F.lit(r"^([a-z]\.)+[a-z]?$")))
    return strip(clean_text(F.translate(F.array_join(kept, " "), "{}@", "()")), " ,.-;")


def clean_media_code(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9-]", ""), "(?i)^mediacode", "")


def parse_top(c: Column, second: str = "common_name", differs: bool = True) -> Column:
    """Top overlay text to struct(scientific_name, <second>, media_code): first line, second line less the code, the code.

    differs: the second line only counts if it is not the first.
    """
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    name = F.try_element_at(lines, F.lit(1))
    rest = F.nullif(F.regexp_replace(F.regexp_replace(F.try_element_at(lines, F.lit(2)), MEDIA_CODE, ""), r"(?U)^\s+|\s+$", ""), F.lit(""))
    if differs:
        rest = F.when(rest != name, rest)
    return F.struct(name.alias("scientific_name"), rest.alias(second), _match(c, MEDIA_CODE).alias("media_code"))


def parse_top_items(items: Column, second: str = "common_name") -> Column:
    """parse_top for an array of recognised pieces."""
    name, other = F.try_element_at(items, F.lit(1)), F.try_element_at(items, F.lit(2))
    rest = F.when(~F.contains(F.lower(other), F.lit("media code")) & (other != name), other)
    return F.struct(name.alias("scientific_name"), rest.alias(second), _match(F.array_join(items, " "), MEDIA_CODE).alias("media_code"))


def parse_bottom(c: Column) -> Column:
    """Bottom overlay text ``[Sex.] Location. YYYY/MM/DD. ©Name`` to struct(sex, location, date, credit)."""
    credit = F.regexp_replace(_match(c, r"(?d)[©@](.+?)(?:\n|$)"), r"(?U)^\s+|\s+$", "")
    date = _match(c, r"(\d{4}/\d{2}/\d{2})")
    sex = F.initcap(_match(c, r"(?i)^(Male|Female|Unknown)\b"))
    rest = F.when(F.nullif(credit, F.lit("")).isNotNull(), F.regexp_replace(c, r"(?d)[©@].+?(?:\n|$)", "")).otherwise(c)
    rest = F.when(date.isNotNull(), F.replace(rest, date, F.lit(""))).otherwise(rest)
    rest = F.when(sex.isNotNull(), F.regexp_replace(rest, r"(?iU)^(Male|Female|Unknown)\b\.?\s*", "")).otherwise(rest)
    rest = strip(F.regexp_replace(rest, SPACE, " "), " .,\n")
    return F.struct(sex.alias("sex"), F.when(F.length(rest) > 3, rest).alias("location"), date.alias("date"), credit.alias("credit"))


def parse_bottom_items(items: Column) -> Column:
    """parse_bottom for an array of recognised pieces; the sex is a whole word anywhere."""
    whole = F.array_join(items, " ")
    credit = F.try_element_at(F.filter(items, lambda x: F.rlike(x, F.lit("[©@]"))), F.lit(1))
    credit = F.trim(F.translate(credit, "©@", ""))
    date, sex = _match(whole, r"(\d{4}/\d{2}/\d{2})"), F.initcap(_match(whole, r"(?i)\b(Male|Female|Unknown)\b"))
    own = F.filter(items, lambda x: ~(F.coalesce(x == date, F.lit(False)) | F.coalesce((credit != "") & F.contains(x, credit), F.lit(False))))
    own = F.transform(own, lambda x: F.trim(F.when(sex.isNotNull(), F.regexp_replace(x, r"(?iU)\b(Male|Female|Unknown)\b\.?\s*", "")).otherwise(x)))
    return F.struct(sex.alias("sex"), F.nullif(F.array_join(F.filter(own, lambda x: x != ""), " "), F.lit("")).alias("location"), date.alias("date"), credit.alias("credit"))


def extract_state(c: Column, states: list[str] = STATES, whole_words: bool = False) -> Column:
    """The first state of the list that the text contains, in any case."""
    has = lambda s: F.rlike(c, F.lit(rf"(?i)\b{s}\b")) if whole_words else F.contains(F.lower(c), F.lit(s.lower()))
    return F.coalesce(*(F.when(has(s), F.lit(s)) for s in states))


def parse_polluted_location(location: Column, sex: Column, state: Column, date: Column, credit: Column) -> Column:
    """A location that holds other fields to struct(location, sex, state, date, credit); only missing fields are filled."""
    ends = lambda x, chars=" ,.-;": strip(x, chars)
    loc = F.coalesce(location, F.lit(""))
    found = _match(loc, r"(\d{4}[/-]\d{1,2}[/-]\d{1,2})")
    new_date = F.coalesce(blank_to_null(date), F.replace(found, F.lit("-"), F.lit("/")))
    loc = F.when(found.isNotNull(), ends(F.replace(loc, found, F.lit("")))).otherwise(loc)
    word = _match(loc, r"(?i)\b(Male|Female)\b")
    new_sex = F.coalesce(blank_to_null(sex, [*EMPTY_WORDS, "unknown"]), F.initcap(word), sex)
    without = F.when(F.lower(word) == "male", F.regexp_replace(loc, r"(?i)\bmale[.\s,;]*", "")).otherwise(F.regexp_replace(loc, r"(?i)\bfemale[.\s,;]*", ""))
    loc = F.when(word.isNotNull(), ends(without)).otherwise(loc)
    new_state = F.coalesce(blank_to_null(state), extract_state(loc, LONG_STATES))
    parts = F.split(loc, "©")
    new_credit = F.coalesce(blank_to_null(credit), F.trim(F.try_element_at(parts, F.lit(2))))
    loc = F.when(F.contains(loc, F.lit("©")), ends(parts[0], " ,;")).otherwise(loc)
    loc = F.regexp_replace(ends(F.regexp_replace(loc, r"\bIndia\b", "")), SPACE, " ")
    return F.struct(F.nullif(loc, F.lit("")).alias("location"), new_sex.alias("sex"), new_state.alias("state"), new_date.alias("date"), new_credit.alias("credit"))


def common_name_from_title(c: Column) -> Column:
    """What stands after the last ' - ' and before ' | '; null without ' - '."""
    return F.when(F.contains(c, F.lit(" - ")), F.trim(F.split(F.element_at(F.split(c, " - "), -1), r" \| ")[0]))


def make_key(c: Column, default: str = "Unknown_Plant") -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.trim(c), SPACE, "_"), "[^A-Za-z0-9_-]", ""), F.lit("")), F.lit(default))


def url_slug(c: Column) -> Column:
    return F.element_at(F.split(F.rtrim(c, F.lit("/")), "/"), -1)


def swap_dashes(c: Column, to: str = "_") -> Column:
    return F.translate(c, "- " if to == "_" else "_", "__" if to == "_" else "-")


def output_name(class_: Column, stage: Column, number: Column, url: Column) -> Column:
    """File name from class, stage and running number, with the url's extension (or .jpg)."""
    ext = F.coalesce(_match(url, r"(\.[A-Za-z0-9]+)(?:[?#].*)?$"), F.lit(".jpg"))
    part = lambda c: F.translate(F.translate(c, "/", "-"), " ", "")
    return F.concat(part(class_), F.lit("_"), part(stage), F.lit("_"), F.lpad(number.cast("string"), 3, "0"), ext)


def image_type(c: Column) -> Column:
    low = F.lower(c)
    return F.when(F.contains(low, F.lit("hero")), "hero").when(F.contains(low, F.lit("gallery")), "gallery").otherwise("other")


#: Folders at the root that hold no items.
ROOTS = ["data", "scripts", "docs", "logs", ".git", ".github", ".cache"]


def rewrite_path(c: Column, roots: list[str] = ROOTS, files: tuple[str, ...] = ("README.md", ".gitattributes", ".gitignore")) -> Column:
    """New place of a stored file, first rule that fits; the path itself if none does."""
    p = F.split(c, "/")
    rest = lambda a: F.array_join(F.slice(p, a, F.size(p)), "/")
    deep = F.size(p) >= 3
    return (
        F.when(deep & (p[0] == "data") & ~F.get(p, F.lit(1)).isin("butterflies", "plants"), F.concat(F.lit("data/butterflies/raw/"), rest(2)))
        .when(deep & (p[0] == "host_plants"), F.concat(F.lit("data/plants/raw/"), rest(2)))
        .when((F.size(p) >= 2) & ~p[0].isin([*roots, "host_plants"]) & ~c.isin(list(files)) & ~F.endswith(c, F.lit(".log")), F.concat(F.lit("data/plants/raw/"), c))
        .otherwise(c)
    )


def extension(c: Column) -> Column:
    return F.lower(F.coalesce(_match(basename(c), r"(\.[^.]+)$"), F.lit("")))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]+$", "")


def display_name(genus: Column, species: Column) -> Column:
    """'Genus species'; null when both are missing."""
    return F.nullif(F.trim(F.concat_ws(" ", genus, species)), F.lit("")) if genus is not None else species


def digits_to_long(c: Column) -> Column:
    return F.when(F.rlike(c, F.lit(r"^\d+$")), c.try_cast("bigint"))


def absolute_url(c: Column, base: str) -> Column:
    return F.when(F.startswith(c, F.lit("/")), F.concat(F.lit(base), c)).otherwise(c)


def join_hosts(items: Column) -> Column:
    """Names of an array without links, comma-joined."""
    return F.array_join(F.filter(items, lambda x: ~F.startswith(x, F.lit("http"))), ", ")


def map_get(m: Column, key: str, default: str = "Unknown") -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def merge_maps(*maps: Column) -> Column:
    """Entries of all maps; a later map's value stands."""
    return reduce(lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b), maps)


def content_columns(content: Column, path: Column, large: int = 5 << 20) -> list[Column]:
    """sha256, base64 size and whether content is stored apart: images and what is larger than ``large`` bytes."""
    data = content.cast("binary")
    apart = extension(path).isin(".jpg", ".jpeg", ".png") | (F.octet_length(data) > large)
    return [F.sha2(data, 256).alias("sha256"), F.octet_length(data).cast("long").alias("size"), (F.ceil(F.octet_length(data) / 3) * 4).cast("long").alias("payload_chars"), apart.alias("is_large")]
