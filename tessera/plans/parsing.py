"""Registered queries: text parsing and cleaning, paths, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.functions.dims import LONG_STATES, NOISE_WORDS, REFINED_NOISE, STATES
from tessera.operators import graph, pages
from tessera.plans.base import on, table
from tessera.plans.reports import NATION_SQL, customer_states

BLANK = r"[ \t\n\r\f\v\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def clean_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '{BLANK}+', ' ', 'g'))"


def in_list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def runs_sql(c: str) -> str:
    """Runs of three or more of each letter to one, without back-references."""
    for ch in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        c = f"regexp_replace({c}, '{ch}{{3,}}', '{ch}', 'g')"
    return c


def words_sql(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda w: w <> '')"


BARE = "trim(lower(w), '.,()/-')"
NOISE_SQL = f"""WITH a AS (SELECT doc_id, {clean_sql('text')} AS x FROM documents), b AS (SELECT doc_id, regexp_replace({runs_sql('x')}, '[^a-zA-Z0-9 .,()/\\-©@]', ' ', 'g') AS x FROM a),
 c AS (SELECT doc_id, list_filter({words_sql('x')}, lambda w: NOT ({BARE} IN {in_list(NOISE_WORDS)} OR (length({BARE}) <= 2 AND NOT regexp_matches({BARE}, '^[a-z]+$')) OR (length({BARE}) > 5 AND NOT regexp_matches({BARE}, '[aeiouy]')))) AS w FROM b),
 d AS (SELECT doc_id, trim({clean_sql("array_to_string(w, ' ')")}, ' ,.-;') AS x FROM c)
 SELECT doc_id, md5(CASE WHEN len({words_sql('x')}) > 5 AND len(list_filter({words_sql('x')}, lambda w: length(w) > 2 OR regexp_matches(w, '[A-Z]'))) = 0 THEN '' ELSE x END) AS cleaned FROM d"""
REFINED_SQL = f"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^[^a-zA-Z0-9]+', ''), '[^a-zA-Z0-9]+$', '') AS x FROM documents),
 b AS (SELECT doc_id, list_filter({words_sql(clean_sql('x'))}, lambda w: NOT ({BARE} IN {in_list(REFINED_NOISE)} OR regexp_matches({BARE}, '^([a-z]\\.)+[a-z]?$'))) AS w FROM a)
 SELECT doc_id, md5(trim({clean_sql("replace(translate(array_to_string(w, ' '), '{}', '()'), '@', '')")}, ' ,.-;')) AS cleaned FROM b"""


def overlays(spark, sf):
    """Overlay texts made of known parts, and the parts."""
    c = customer_states(spark, sf).join(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    k = F.col("c_custkey")
    sex = F.when(k % 3 == 0, "Male").when(k % 3 == 1, "Female")
    date = F.concat(F.lit("2021/"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("/"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))
    place = F.concat(F.lit("Village "), k.cast("string"), F.lit(", "), F.col("state"))
    parts = c.select("c_custkey", "state", sex.alias("sex"), date.alias("date"), place.alias("place"), F.col("c_mktsegment").alias("name"))
    bottom = F.concat(F.coalesce(F.concat("sex", F.lit(". ")), F.lit("")), "place", F.lit(". "), "date", F.lit(".  ©"), "name")
    top = F.concat(F.lit("Genus c"), k.cast("string"), F.lit("\n"), "name", F.lit("    Media code: AB-"), k.cast("string"))
    polluted = F.concat(F.coalesce(F.concat("sex", F.lit(", ")), F.lit("")), "place", F.lit(", India "), F.replace("date", F.lit("/"), F.lit("-")), F.lit(" ©"), "name")
    return parts.select("c_custkey", top.alias("top"), bottom.alias("bottom"), polluted.alias("polluted"))


PARTS_SQL = f"""(SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' END AS sex, '2021/' || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || '/' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS date,
 'Village ' || c_custkey || ', ' || st.state AS place, st.state, c_mktsegment AS name FROM customer JOIN {NATION_SQL} ON c_nationkey = st.k)"""
KNOWN_STATE = f"CASE WHEN state IN {in_list(STATES)} THEN state END"
#: the first name of the long list that occurs; of the states used here each is its own first match
LONG_STATE = f"CASE WHEN state IN {in_list(LONG_STATES)} THEN state END"


def roundtrip(spark, sf):
    o = overlays(spark, sf)
    x = o.select("c_custkey", t.parse_top(F.col("top")).alias("a"), t.parse_bottom(F.col("bottom")).alias("b"))
    return x.select("c_custkey", "a.scientific_name", "a.common_name", "a.media_code", "b.sex", "b.location", "b.date", "b.credit", t.extract_state(F.col("b.location")).alias("state"), t.clean_media_code(F.concat(F.lit("MediaCode:"), "a.media_code", F.lit("!"))).alias("code"))


def polluted(spark, sf):
    none = F.lit(None).cast("string")
    x = overlays(spark, sf).select("c_custkey", t.parse_polluted_location(F.col("polluted"), F.when(F.col("c_custkey") % 6 == 0, "nan"), none, F.when(F.col("c_custkey") % 5 == 0, "1999/01/01"), none).alias("p"))
    return x.select("c_custkey", "p.*")


def shaped(p):
    """Pages with breadcrumbs, tabs, a table, images and hosts made of their own columns."""
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    lang = F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)/", 1)
    k = F.col("page_id").cast("string")
    lit = F.lit
    html = F.concat(
        lit('<ul id="system-breadcrumb-listing"><li><a href="/x"><span class="style-Family big">'), host, lit('</span><span>'), lang, lit('</span></a></li><li><a><span class="style-Family">second</span></a></li></ul>'),
        lit('<div id="early"><p>egg '), k, lit("<p> , ,</p><p>larva</div><div id=dist>A <b>"), host, lit('</b><br>B</div><div id="stat"><p>first &amp; '), k, lit("</p><table><tr><th>Year<th>Count</tr><tr><td>20<td>"), k, lit("<td>extra</tr></table></div>"),
        lit('<div class="ihgwraapper"><img src="/h'), k, lit('.jpg" alt="hero"></div><div id="adult"><a class="colorbox" href="/g.jpg"><img alt="  cap  x "></a><a class="colorbox" href="/h'), k, lit('.jpg"></a></div>'),
        lit('<div class="textContent"><h4>Larval Host of</h4><a class="spe-a" href="/s-'), (F.col("page_id") % 7).cast("string"), lit('/"><em>Sp '), (F.col("page_id") % 7).cast("string"), lit("</em> – Common</a></div>"), "html",
    )
    return p.select("page_id", html.alias("html"))


HOST_SQL = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)"
PATH_SQL = """CASE WHEN page_id % 5 = 0 THEN 'data/' || page_id || '/a/b.jpg' WHEN page_id % 5 = 1 THEN 'host_plants/X/' || page_id || '.jpg' WHEN page_id % 5 = 2 THEN 'Y_' || page_id || '/c.jpg'
 WHEN page_id % 5 = 3 THEN 'data/plants/raw/' || page_id ELSE 'run-' || page_id || '/x.log' END"""


def stored_paths(p):
    k = F.col("page_id").cast("string")
    pick = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("data/"), k, F.lit("/a/b.jpg"))).when(F.col("page_id") % 5 == 1, F.concat(F.lit("host_plants/X/"), k, F.lit(".jpg")))
    pick = pick.when(F.col("page_id") % 5 == 2, F.concat(F.lit("Y_"), k, F.lit("/c.jpg"))).when(F.col("page_id") % 5 == 3, F.concat(F.lit("data/plants/raw/"), k)).otherwise(F.concat(F.lit("run-"), k, F.lit("/x.log")))
    return p.select("page_id", pick.alias("path"))


def junk_sql(tokens) -> str:
    return " AND ".join(f"NOT contains(href, '{x}')" for x in tokens)


LINKS_SQL = "(SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), 1) - 1 AS pos FROM pages)"


def dashed(p):
    """Pages whose links hold a dash, as index pages have."""
    return p.select("page_id", F.regexp_replace("html", 'href="/([^"]{2})', 'href="/$1-').alias("html"))


QUERIES = {
    "clean_text": (on("documents")(lambda d: d.select("doc_id", F.md5(t.clean_text(F.col("text"))).alias("cleaned"))), f"SELECT doc_id, md5({clean_sql('text')}) AS cleaned FROM documents"),
    "clean_noise": (on("documents")(lambda d: d.select("doc_id", F.md5(t.clean_noise(F.col("text"))).alias("cleaned"))), NOISE_SQL),
    "clean_refined": (on("documents")(lambda d: d.select("doc_id", F.md5(t.clean_refined(F.col("text"))).alias("cleaned"))), REFINED_SQL),
    "overlay_roundtrip": (
        roundtrip,
        f"""SELECT c_custkey, 'Genus c' || c_custkey AS scientific_name, name AS common_name, 'AB-' || c_custkey AS media_code, sex, place AS location, date, name AS credit, {KNOWN_STATE} AS state, 'AB-' || c_custkey AS code FROM {PARTS_SQL}""",
    ),
    "overlay_polluted": (
        polluted,
        f"""SELECT c_custkey, place AS location, sex, {LONG_STATE} AS state, CASE WHEN c_custkey % 5 = 0 THEN '1999/01/01' ELSE date END AS date, name AS credit FROM {PARTS_SQL}""",
    ),
    "title_common_name": (
        on("part")(lambda p: p.select("p_partkey", t.common_name_from_title(F.concat(F.col("p_type"), F.when(F.col("p_partkey") % 4 > 0, F.lit(" - ")).otherwise(F.lit("-")), "p_name", F.lit(" | Site"))).alias("name"))),
        "SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN trim(p_name) END AS name FROM part",
    ),
    "plant_key": (on("part")(lambda p: p.select("p_partkey", t.make_key(F.when(F.col("p_partkey") % 9 > 0, F.concat("p_name", F.lit(" (x)")))).alias("key"))), "SELECT p_partkey, CASE WHEN p_partkey % 9 > 0 THEN regexp_replace(regexp_replace(trim(p_name || ' (x)'), '\\s+', '_', 'g'), '[^A-Za-z0-9_-]', '', 'g') ELSE 'Unknown_Plant' END AS key FROM part"),
    "image_type": (
        on("part")(lambda p: p.select("p_partkey", t.image_type(F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, "_HERO.jpg").when(F.col("p_partkey") % 3 == 1, "_gallery_1.jpg").otherwise(".jpg"))).alias("kind"))),
        "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'hero' WHEN 1 THEN 'gallery' ELSE 'other' END AS kind FROM part",
    ),
    "output_names": (
        on("part")(lambda p: p.select("p_partkey", t.output_name(F.concat(F.lit("A/b "), F.col("p_partkey").cast("string")), F.lit("adult"), F.col("p_partkey") % 50, F.when(F.col("p_partkey") % 2 == 0, F.lit("http://x/y.png?a=1")).otherwise(F.lit("http://x/y"))).alias("name"))),
        "SELECT p_partkey, 'A-b' || p_partkey || '_adult_' || lpad(CAST(p_partkey % 50 AS VARCHAR), 3, '0') || CASE WHEN p_partkey % 2 = 0 THEN '.png' ELSE '.jpg' END AS name FROM part",
    ),
    "sha_and_size_rule": (
        on("documents")(lambda d: d.select("doc_id", *t.content_columns(F.col("text"), F.concat(F.col("source"), F.when(F.col("doc_id") % 10 == 0, ".PNG").otherwise(".txt")), 10000))),
        "SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS size, CAST(ceil(octet_length(encode(text)) / 3) * 4 AS BIGINT) AS payload_chars, doc_id % 10 = 0 OR octet_length(encode(text)) > 10000 AS is_large FROM documents",
    ),
    "content_groups": (
        on("documents")(lambda d: d.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")),
        "SELECT sha256(text) AS sha256, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    ),
    "path_rewrite": (
        on("pages")(lambda p: stored_paths(p).select("page_id", t.rewrite_path(F.col("path")).alias("new_path"))),
        """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'data/butterflies/raw/' || page_id || '/a/b.jpg' WHEN 1 THEN 'data/plants/raw/X/' || page_id || '.jpg' WHEN 2 THEN 'data/plants/raw/Y_' || page_id || '/c.jpg'
 WHEN 3 THEN 'data/plants/raw/' || page_id ELSE 'run-' || page_id || '/x.log' END AS new_path FROM pages""",
    ),
    "misplaced_by_root": (
        on("pages")(lambda p: stored_paths(p).filter(t.rewrite_path(F.col("path")) != F.col("path")).groupBy(F.split("path", "/")[0].alias("root")).agg(F.count("*").alias("n"))),
        f"SELECT split_part(path, '/', 1) AS root, count(*) AS n FROM (SELECT page_id, {PATH_SQL} AS path FROM pages WHERE page_id % 5 < 3) GROUP BY 1",
    ),
    "url_slug": (on("pages")(lambda p: p.select("page_id", t.url_slug(F.col("url")).alias("slug"))), "SELECT page_id, list_last(string_split(rtrim(url, '/'), '/')) AS slug FROM pages"),
    "url_parts": (
        on("pages")(lambda p: p.select("page_id", t.basename(F.col("url")).alias("base"), t.stem(F.col("url")).alias("stem"), t.swap_dashes(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)).alias("host"), t.absolute_url(F.regexp_extract("url", "^[a-z]+://[^/]+(/.*)$", 1), "https://site.example").alias("moved"))),
        f"""SELECT page_id, split_part(url, '/', -1) AS base, regexp_replace(split_part(url, '/', -1), '^(.+)\\.[^.]+$', '\\1') AS stem, translate({HOST_SQL}, '- ', '__') AS host, 'https://site.example' || regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1) AS moved FROM pages""",
    ),
    "page_titles": (
        on("pages")(lambda p: p.select("page_id", pages.title(F.col("html")).alias("title"))),
        "SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), ''), 'Unknown Title') AS title FROM pages",
    ),
    "page_links": (on("pages")(lambda p: p.select("page_id", F.posexplode(pages.hrefs(F.col("html"))).alias("pos", "href"))), f"SELECT page_id, pos, href FROM {LINKS_SQL}"),
    "link_frontier": (
        on("pages")(lambda p: pages.frontier(dashed(p))),
        f"""WITH l AS (SELECT page_id, regexp_replace(href, '^/(..)', '/\\1-') AS href, pos FROM {LINKS_SQL}), k AS (SELECT * FROM l WHERE starts_with(href, '/') AND length(href) > 2 AND contains(href, '-')
 AND substr(href, 2, 1) <> lower(substr(href, 2, 1)) AND {junk_sql(pages.JUNK)}) SELECT 'https://site.example' || href AS url, min(page_id) AS page_id, arg_min(pos, page_id * 100000 + pos) AS pos FROM k GROUP BY 1""",
    ),
    "plant_frontier": (
        on("pages")(lambda p: pages.frontier(dashed(p), plants=True)),
        f"""WITH l AS (SELECT page_id, regexp_replace(href, '^/(..)', '/\\1-') AS href, pos FROM {LINKS_SQL}), k AS (SELECT * FROM l WHERE starts_with(href, '/') AND length(href) > 2 AND contains(href, '-')
 AND NOT substr(href, 2, 1) <> lower(substr(href, 2, 1)) AND len(href) - len(replace(href, '/', '')) = 1 AND {junk_sql(pages.PLANT_JUNK)}) SELECT 'https://site.example' || href AS url, min(page_id) AS page_id, arg_min(pos, page_id * 100000 + pos) AS pos FROM k GROUP BY 1""",
    ),
    "page_taxonomy": (
        on("pages")(lambda p: pages.read_pages(shaped(p)).select("page_id", t.map_get(F.col("taxonomy"), "Family").alias("family"), t.map_get(F.col("common_names"), "Family").alias("common"), t.map_get(F.col("taxonomy"), "Genus").alias("genus"))),
        f"SELECT page_id, {HOST_SQL} AS family, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) AS common, 'Unknown' AS genus FROM pages",
    ),
    "page_tabs": (
        on("pages")(lambda p: pages.read_pages(shaped(p)).select("page_id", F.array_join("early_text", "|").alias("early"), "distribution", F.array_join("description", "|").alias("description"))),
        f"SELECT page_id, 'egg ' || page_id || '|larva' AS early, 'A ' || {HOST_SQL} || ' B' AS distribution, 'first & ' || page_id AS description FROM pages",
    ),
    "page_tables": (
        on("pages")(lambda p: pages.read_pages(shaped(p)).select("page_id", F.explode("sightings").alias("s")).select("page_id", F.col("s")["Year"].alias("year"), t.digits_to_long(F.col("s")["Count"]).alias("count"), F.size("s").alias("cells"))),
        "SELECT page_id, '20' AS year, page_id AS count, 2 AS cells FROM pages",
    ),
    "page_images": (
        on("pages")(lambda p: pages.read_pages(shaped(p)).select("page_id", F.inline("images"))),
        """SELECT page_id, 'https://site.example/h' || page_id || '.jpg' AS url, 'hero' AS caption, 'hero' AS kind, 1 AS position FROM pages UNION ALL SELECT page_id, 'https://site.example/g.jpg', 'cap x', 'adult', 2 FROM pages""",
    ),
    "page_host_degrees": (
        on("pages")(lambda p: graph.degrees(pages.host_edges(pages.read_pages(shaped(p))).select(F.col("page_id").alias("src"), F.col("scientific").alias("dst")))),
        "SELECT 'src' AS side, CAST(page_id AS VARCHAR) AS node, 1 AS degree FROM pages UNION ALL SELECT 'dst', 'Sp ' || (page_id % 7), count(*) FROM pages GROUP BY 2",
    ),
}
