"""Queries on extraction quality, routing, citations and metadata."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import quality as q
from ..functions import routing as r
from ..functions import text as tx
from ..operators import evaluate, unify
from .registry import literal, query, table, values

CASES = [
    (1, "plain words that make twenty tokens of text in all so that the ratio of bad ones is known here now yes it is", 1, 4000),
    (2, "xkcd zzzz qwrtp bcdfg hjkl mnpq rstv wxz bcd fgh jkl mnp qrs tvw xyzz bbb ccc ddd fff ggg", 1, 4000),
    (3, "formula-not-decoded x formula-not-decoded y formula-not-decoded", 3, 90_000),
    (4, "<!-- image -->", None, 2_000_000),
    (5, "\n".join(["ab", "c", "d e"] * 9 + ["a longer line of text"] * 4), 2, 1000),
    (6, "\n".join(["<!-- c -->", "| t |", "# h", "```", "a line of prose"] * 8), None, 500),
    (7, "", 1, 0),
    (8, "fooBarBaz YGG Ygg rhythm NASA " * 6, None, 1024),
]
CASES_SQL = values([(i, t, p, s) for i, t, p, s in CASES])
DOCS_SQL = f"""docs AS (
    SELECT doc_id AS id, text, ceil(n_chars / 2000e0)::INTEGER AS pages, length(text)::BIGINT AS size FROM documents
    UNION ALL SELECT (-id)::BIGINT, text, pages::INTEGER, size::BIGINT FROM ({CASES_SQL}) t(id, text, pages, size))"""
WORDS = "regexp_extract_all(text, '[A-Za-z]+')"
BAD = """list_filter(w, lambda x: length(x) >= 3 AND (length(x) > 25 OR (x <> upper(x) AND
    (NOT regexp_matches(x, '[aeiouyAEIOU]') OR len(regexp_extract_all(substr(x, 2), '[A-Z]')) >= 2))))"""
GARBLED = f"g AS (SELECT id, CASE WHEN len(w) >= 20 THEN len({BAD}) / len(w)::DOUBLE END AS garbled FROM (SELECT id, {WORDS} AS w FROM docs))"
LINES = """list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\x{2028}\\x{2029}]'), lambda x: trim(x, ' ' || chr(9) || chr(160))),
    lambda x: x <> '' AND NOT starts_with(x, '<!--') AND NOT starts_with(x, '|') AND NOT starts_with(x, '#') AND NOT starts_with(x, '```'))"""
FRAGMENTS = f"f AS (SELECT id, CASE WHEN len(x) >= 20 THEN len(list_filter(x, lambda y: length(y) <= 3)) / len(x)::DOUBLE END AS fragmented FROM (SELECT id, {LINES} AS x FROM docs))"
FORMULAS = "m AS (SELECT id, CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, 'formula-not-decoded')) / (length(text) / 1000e0) ELSE 0e0 END AS formulas FROM docs)"
DENSITY = """d AS (SELECT id, CASE WHEN coalesce(pages, 0) > 0 THEN length(text) / pages::DOUBLE ELSE length(text) / greatest(size / 1024e0, 1e-9) END AS value,
    CASE WHEN coalesce(pages, 0) > 0 THEN 'chars/page' ELSE 'chars/KB' END AS unit FROM docs),
    s AS (SELECT *, CASE WHEN unit = 'chars/page' THEN CASE WHEN value < 100 THEN 'severe_low' WHEN value < 500 THEN 'moderate_low' ELSE 'normal' END
    ELSE CASE WHEN value < 1 THEN 'severe_low' WHEN value < 3 THEN 'moderate_low' ELSE 'normal' END END AS severity FROM d)"""


def _docs(spark, sf):
    """Documents with stand-ins for page counts and sizes, and made-up cases with negative ids."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), "text", F.ceil(F.col("n_chars") / 2000).cast("int").alias("pages"), F.length("text").cast("long").alias("size")
    )
    cases = literal(spark, [(-i, t, p, s) for i, t, p, s in CASES], "id long, text string, pages int, size long")
    return docs.unionByName(cases)


@query(f"WITH {DOCS_SQL}, {GARBLED} SELECT id, round(garbled, 6) AS garbled FROM g")
def garbled_ratio(spark, sf):
    return _docs(spark, sf).select("id", F.round(q.garbled_ratio(F.col("text")), 6).alias("garbled"))


@query(f"WITH {DOCS_SQL}, {FORMULAS} SELECT id, round(formulas, 6) AS formulas FROM m")
def formula_density(spark, sf):
    return _docs(spark, sf).select("id", F.round(q.formula_density(F.col("text")), 6).alias("formulas"))


@query(f"WITH {DOCS_SQL}, {FRAGMENTS} SELECT id, round(fragmented, 6) AS fragmented FROM f")
def fragmentation(spark, sf):
    return _docs(spark, sf).select("id", F.round(q.fragmentation_ratio(F.col("text")), 6).alias("fragmented"))


@query(f"WITH {DOCS_SQL}, {DENSITY} SELECT id, round(value, 4) AS value, unit, severity FROM s")
def output_density(spark, sf):
    d = q.output_density(F.length("text"), F.col("pages"), F.col("size"))
    return _docs(spark, sf).select("id", d.alias("d")).select("id", F.round("d.value", 4).alias("value"), "d.unit", "d.severity")


VERDICT = f"""WITH {DOCS_SQL}, {GARBLED}, {FRAGMENTS}, {FORMULAS}, {DENSITY}, v AS (
    SELECT id, list_filter([CASE WHEN garbled > 0.08 THEN 'garbled' END, CASE WHEN fragmented > 0.1 THEN 'fragmented' END,
        CASE WHEN formulas > 2 THEN 'formula_dense' END,
        CASE WHEN severity = 'severe_low' THEN 'density_severe' WHEN severity = 'moderate_low' AND (coalesce(garbled, 0) > 0.08 OR coalesce(fragmented, 0) > 0.1) THEN 'density_moderate' END],
        lambda x: x IS NOT NULL) AS reasons
    FROM g JOIN f USING (id) JOIN m USING (id) JOIN s USING (id))"""


def _verdicts(spark, sf):
    d = q.output_density(F.length("text"), F.col("pages"), F.col("size"))
    rows = _docs(spark, sf).select(
        "id", q.garbled_ratio(F.col("text")).alias("g"), q.fragmentation_ratio(F.col("text")).alias("f"), q.formula_density(F.col("text")).alias("m"), d["severity"].alias("s")
    )
    return rows.select("id", q.reasons(F.col("g"), F.col("f"), F.col("m"), F.col("s")).alias("reasons"))


@query(f"{VERDICT} SELECT id, array_to_string(reasons, ',') AS reasons, len(reasons) > 0 AS needs_reparse FROM v")
def quality_verdict(spark, sf):
    return _verdicts(spark, sf).select("id", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") > 0).alias("needs_reparse"))


@query(
    f"""WITH {DOCS_SQL}, {FRAGMENTS}, v AS (SELECT id, list_filter([CASE WHEN contains(text, 'formula-not-decoded') THEN 'formula_missing' END,
    CASE WHEN contains(text, '<!-- image -->') THEN 'has_unresolved_image' END, CASE WHEN fragmented > 0.1 THEN 'fragmented' END], lambda x: x IS NOT NULL) AS flags
    FROM docs JOIN f USING (id)) SELECT id, CASE WHEN len(flags) > 0 THEN array_to_string(flags, ',') END AS flags FROM v"""
)
def chunk_flags(spark, sf):
    return _docs(spark, sf).select("id", r.flat_flags(q.chunk_flags(F.col("text"))).alias("flags"))


@query("SELECT CASE WHEN n_chars * 400 < 300000 THEN 'small' WHEN n_chars * 400 < 3000000 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def size_bucket(spark, sf):
    return table(spark, sf, "documents").groupBy(q.size_bucket(F.col("n_chars") * 400).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT vec_id AS id, CASE WHEN c > 0.85 THEN 'ocr_only' WHEN c < 0.5 THEN 'vlm_only' ELSE 'both' END AS tier, round(c, 6) AS confidence
    FROM (SELECT vec_id, coalesce(list_avg(list_filter(list_transform(embedding, lambda x: x::DOUBLE * 4), lambda x: x > 0)), 0) AS c FROM embeddings)"""
)
def ocr_tier(spark, sf):
    """The mean of a box list stands for OCR confidence; an empty list has 0."""
    boxes = F.filter(F.transform("embedding", lambda x: x.cast("double") * 4), lambda x: x > 0)
    mean = F.coalesce(F.try_divide(F.aggregate(boxes, F.lit(0.0), lambda s, x: s + x), F.size(boxes)), F.lit(0.0))
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), mean.alias("c"))
    return rows.select("id", q.ocr_tier(F.col("c")).alias("tier"), F.round("c", 6).alias("confidence"))


@query(
    """WITH d AS (SELECT source, sha256(text) AS sha256, min(doc_id) AS doc_id FROM documents GROUP BY ALL)
    SELECT d.doc_id, d.source, sha256, n_chars >= 512 AS kept FROM d JOIN documents x ON x.doc_id = d.doc_id"""
)
def dedup_keep_first(spark, sf):
    """First of equal contents within a source; the size filter comes after."""
    rows = table(spark, sf, "documents").withColumnRenamed("source", "from_")
    first = evaluate.keep_first(rows.withColumn("by_", F.col("from_")), "text", ["by_"], "doc_id")
    return first.select("doc_id", F.col("from_").alias("source"), "sha256", (F.col("n_chars") >= 512).alias("kept"))


STATUS_SQL = f"""{VERDICT}, flagged AS (SELECT id, source, len(reasons) > 0 AS flagged, ceil(n_chars / 2000e0)::BIGINT AS pages FROM v JOIN documents ON doc_id = id),
    st AS (SELECT *, CASE WHEN NOT flagged THEN 'good' WHEN source IN ('src1', 'src2', 'src3') THEN 'pending_llamaparse' ELSE 'degraded' END AS status FROM flagged)"""


def _status(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", F.ceil(F.col("n_chars") / 2000).cast("long").alias("pages"))
    rows = docs.join(_verdicts(spark, sf), "id")
    return rows.withColumn("status", q.manifest_status(F.size("reasons") > 0, F.col("source"), ["src1", "src2", "src3"]))


@query(f"{STATUS_SQL} SELECT status, count(*) AS files, sum(pages)::BIGINT AS pages, (3 * sum(pages))::BIGINT AS credits, round(3 * sum(pages) / 100e0, 4) AS percent FROM st GROUP BY 1")
def manifest_status(spark, sf):
    """Files, pages, credits (three a page) and their share of 10,000 by status."""
    pages = F.sum("pages")
    return _status(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("files"), pages.alias("pages"), (3 * pages).alias("credits"), F.round(3 * pages / 100, 4).alias("percent"))


@query(f"{STATUS_SQL} SELECT source, count(*) AS n FROM st WHERE status = 'degraded' GROUP BY 1")
def degraded_by_source(spark, sf):
    return _status(spark, sf).filter("status = 'degraded'").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


PATHS = [
    "CSE 416/HW4/report.PDF", "CSE 416\\Class14\\14.pdf", "BIOL 1/notes.md", "BIOL 1/.gitignore", "BIOL 1/text8", "X/model-checkpoint-12", "X/a.tar.zip",
    "X/.git/config.py", "X/index/a.py", "X/b.lp", "root.pdf", "X/._a.pdf", "X/.DS_Store", "X/noext", "Y/data/x.CSV", "Y/final exam.pdf", "Y/期末/1.r", "X/pic.JPeG", "X/dot.",
]
#: Every document stands for a file too: its source is the course, and its id picks the rest of the path.
TAILS = ["/a.pdf", "/B.PY", "/x/c.lp", "/d", "/e.tar.gz", "/.git/f.py", "/final.md", "/index/g.r", "/h.JPeG", "/model-checkpoint-1", "/LICENSE", "/._i.pdf", "/j.csv", "/.DS_Store", "/期末/k.sql", "\\l.java"]
DERIVED_SQL = f"SELECT source || ' ' || doc_id || ([{', '.join(repr(t) if chr(92) not in t else chr(39) + t + chr(39) for t in TAILS)}])[doc_id % {len(TAILS)} + 1] AS path FROM documents"
_NAME = "list_extract(parts, -1)"
_EXT = f"lower(regexp_extract({_NAME}, '[^.].*?(\\.[^.]+)$', 1))"
_LISTED = lambda xs: ", ".join(f"'{x}'" for x in xs)
_KINDS = " ".join(f"WHEN ext IN ({_LISTED(e)}) THEN '{k}'" for k, e in r.CATEGORIES.items())
ROUTE_SQL = f"""p AS (SELECT path, list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda x: x <> '') AS parts FROM (SELECT path FROM ({values([(p,) for p in PATHS])}) t(path) UNION ALL {DERIVED_SQL})),
    e AS (SELECT path, parts, {_NAME} AS name, {_EXT} AS ext FROM p),
    c AS (SELECT path, name, ext, CASE WHEN name IN ({_LISTED(r.EXCLUDED_NAMES)}) THEN '排除类' WHEN starts_with(name, 'model-checkpoint') THEN '排除类' {_KINDS} ELSE '未分类' END AS category,
        CASE WHEN len(parts) > 1 THEN parts[1] ELSE '' END AS course,
        len(list_intersect(parts[:-2], [{_LISTED(r.EXCLUDED_DIRS)}])) > 0 AS excluded, starts_with(name, '._') OR name = '.DS_Store' AS junk,
        contains(lower(path), 'final') OR contains(path, '期末') AS final FROM e)"""


def _paths(spark, sf):
    tail = F.get(F.array(*map(F.lit, TAILS)), (F.col("doc_id") % len(TAILS)).cast("int"))
    derived = table(spark, sf, "documents").select(F.concat("source", F.lit(" "), F.col("doc_id").cast("string"), tail).alias("path"))
    return literal(spark, [(x,) for x in PATHS], "path string").unionByName(derived)


def _routed(spark, sf):
    p = F.col("path")
    return _paths(spark, sf).select(
        "path", r.suffix(p).alias("ext"), r.category(p).alias("category"), r.course(p).alias("course"), r.excluded_dir(p).alias("excluded"), r.junk(p).alias("junk"), r.final_related(p).alias("final")
    )


@query(f"WITH {ROUTE_SQL} SELECT path, ext, category, course, excluded, junk, final FROM c")
def route_category(spark, sf):
    return _routed(spark, sf)


@query(
    f"""WITH {ROUTE_SQL}, f AS (SELECT * FROM c WHERE course <> '' AND NOT excluded AND NOT junk)
    SELECT coalesce(category, 'all') AS category, coalesce(ext, 'all') AS ext, count(*) AS n,
           CASE WHEN grouping(category, ext) = 0 THEN array_to_string(list_slice(list_sort(list(path)), 1, 3), '; ') END AS samples
    FROM f GROUP BY ROLLUP (category, ext)"""
)
def category_rollup(spark, sf):
    """Counts by category and extension with the first three paths, subtotals and the total."""
    kept = _routed(spark, sf).filter("course <> '' and not excluded and not junk")
    counts = kept.rollup("category", "ext").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    # The first three of a group are ranked, each task sending three at most; no group's paths are gathered.
    nth = F.row_number().over(Window.partitionBy("category", "ext").orderBy("path"))
    first = kept.select("category", "ext", "path", nth.alias("nth")).filter("nth <= 3").groupBy("category", "ext").agg(F.array_join(F.sort_array(F.collect_list("path")), "; ").alias("samples"))
    found = counts.join(first.withColumn("g", F.lit(0)), ["category", "ext", "g"], "left")
    return found.select(F.coalesce("category", F.lit("all")).alias("category"), F.coalesce("ext", F.lit("all")).alias("ext"), "n", "samples")


STATEMENTS = [
    (1, "select * from t"), (2, "-- note\nCREATE TABLE x (a int)"), (3, "/* a\nb */ create  view v as select 1"), (4, "create role r"), (5, "--only a comment\n"), (6, "   "), (7, "(select 1)"), (8, "Insert into t values (1)"),
]


@query(
    f"""WITH s AS (SELECT id, regexp_replace(stmt, '^(?:\\s|--[^\\n]*\\n|/\\*(?:[^*]|\\*+[^*/])*\\*+/)*', '') AS b FROM (SELECT * FROM ({values(STATEMENTS)}) t(id, stmt)
        UNION ALL SELECT -1 - doc_id, (['', '-- x' || chr(10), '/* ' || source || ' */ create view ', '/*** a */--b' || chr(10) || 'CREATE ', 'drop '])[doc_id % 5 + 1] || text FROM documents)),
    w AS (SELECT id, upper(regexp_extract(b, '^\\s*(\\w+)', 1)) AS a, upper(regexp_extract(b, '^\\s*\\w+\\s+(\\w+)', 1)) AS c FROM s)
    SELECT id::BIGINT AS id, CASE WHEN a = '' THEN 'UNKNOWN' WHEN a = 'CREATE' AND c IN ({_LISTED(r.CREATE_KINDS)}) THEN a || ' ' || c ELSE a END AS kind FROM w"""
)
def sql_type(spark, sf):
    i = F.col("doc_id")
    heads = F.array(F.lit(""), F.lit("-- x\n"), F.concat(F.lit("/* "), "source", F.lit(" */ create view ")), F.lit("/*** a */--b\nCREATE "), F.lit("drop "))
    derived = table(spark, sf, "documents").select((-1 - i).alias("id"), F.concat(F.get(heads, (i % 5).cast("int")), "text").alias("stmt"))
    rows = literal(spark, STATEMENTS, "id long, stmt string").unionByName(derived)
    return rows.select("id", r.sql_type(F.col("stmt")).alias("kind"))


LATEX = [(1, "a \\(x\\) b \\[y\nz\\] c"), (2, "no math"), (3, "\\(a\\)\\(b\\)"), (4, "cost $5")]


@query(
    f"WITH x(id, t) AS (SELECT * FROM ({values(LATEX)}) UNION ALL SELECT -1 - doc_id, '\\(' || text || '\\) \\[' || source || chr(10) || '\\]' FROM documents) "
    f"SELECT id::BIGINT AS id, regexp_replace(regexp_replace(t, '(?s)\\\\\\[(.*?)\\\\\\]', '$$\\1$$', 'g'), '(?s)\\\\\\((.*?)\\\\\\)', '$\\1$', 'g') AS text FROM x"
)
def latex_delims(spark, sf):
    marked = F.concat(F.lit("\\("), "text", F.lit("\\) \\["), "source", F.lit("\n\\]"))
    derived = table(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("id"), marked.alias("t"))
    rows = literal(spark, LATEX, "id long, t string").unionByName(derived)
    return rows.select("id", tx.latex_delimiters(F.col("t")).alias("text"))


SOURCES = [(1, "CSE 416\\Class14\\14.pdf", "CSE 416", 0, 0), (2, "CSE 416/x.pdf", "CSE 416", 3, 5), (3, "", "BIO", None, None), (4, None, None, None, None), (5, "a/b/c/d.py", "", 1, 1), (6, "e.py", "", None, None)]
_FOLDER = "CASE WHEN len(parts) > 2 THEN parts[2] END"
_FILE = "coalesce(list_extract(parts, -1), '')"


@query(
    f"""WITH s AS (SELECT *, list_filter(string_split(replace(coalesce(path, ''), chr(92), '/'), '/'), lambda x: x <> '') AS parts FROM ({values(SOURCES)}) t(id, path, course, a, b)),
    f AS (SELECT *, {_FOLDER} AS folder, coalesce(course, '') <> '' AS named FROM s)
    SELECT id::BIGINT AS id, CASE WHEN folder IS NOT NULL THEN CASE WHEN named THEN course || '(' || folder || '相关)的课程材料' ELSE folder || '相关的课程材料' END
        WHEN named THEN course || '的课程材料' ELSE '课程原始材料' END AS description,
        CASE WHEN len(parts) > 0 AND course IS NOT NULL THEN course || ' / ' || parts[-1] || CASE WHEN a IS NULL THEN '' WHEN a = b THEN ' p.' || (a + 1) ELSE ' p.' || (a + 1) || '-' || (b + 1) END END AS citation FROM f"""
)
def source_description(spark, sf):
    rows = literal(spark, SOURCES, "id long, path string, course string, a int, b int")
    cited = r.citation(F.col("course"), F.when(F.coalesce("path", F.lit("")) != "", F.col("path")), F.col("a"), F.col("b"))
    return rows.select("id", r.source_description(F.col("path"), F.col("course")).alias("description"), cited.alias("citation"))


@query(
    """SELECT doc_id AS id, 'text=' || source || ',lang=' || lang AS flat, [x for x in string_split(coalesce(CASE WHEN doc_id % 3 > 0 THEN array_to_string(list_slice(['a', 'b'], 1, doc_id % 3), ',') END, ''), ',') if x <> ''] AS flags,
    CASE WHEN doc_id % 3 > 0 THEN array_to_string(list_slice(['a', 'b'], 1, doc_id % 3), ',') END AS joined FROM documents"""
)
def metadata_sanitize(spark, sf):
    """Lists to text and back, nulls dropped from a flat map."""
    flags = F.when(F.col("doc_id") % 3 > 0, F.slice(F.array(F.lit("a"), F.lit("b")), 1, (F.col("doc_id") % 3).cast("int")))
    meta = F.struct(flags.alias("flags"), F.col("source"), F.col("lang"))
    rows = table(spark, sf, "documents").select("doc_id", "source", "lang", meta.alias("meta"))
    flat = unify.flat_metadata(F.col("meta"), ["flags"], [], ["source", "lang"])
    rows = rows.select(F.col("doc_id").alias("id"), flat.alias("m"))
    return rows.select("id", F.concat(F.lit("text="), F.col("m")["source"], F.lit(",lang="), F.col("m")["lang"]).alias("flat"), r.flag_list(F.try_element_at("m", F.lit("flags"))).alias("flags"), F.try_element_at("m", F.lit("flags")).alias("joined"))


IMAGES = [(1, "a/b.png", "x", "y", "both"), (2, "c.jpg", "", None, "ocr_only"), (3, "d/e.png", None, "z", "vlm_only")]


@query(
    f"""SELECT id::BIGINT AS id, array_to_string(list_filter([list_extract(string_split(file, '/'), -1), CASE WHEN coalesce(o, '') <> '' THEN '[图片OCR文字]' || chr(10) || o END,
    CASE WHEN coalesce(d, '') <> '' THEN '[图片描述]' || chr(10) || d END], lambda x: x IS NOT NULL), chr(10)) AS text,
    CASE tier WHEN 'both' THEN 'image_ocr_vlm' WHEN 'ocr_only' THEN 'image_ocr' WHEN 'vlm_only' THEN 'image_vlm' END AS chunk_type FROM ({values(IMAGES)}) t(id, file, o, d, tier)"""
)
def image_chunk_text(spark, sf):
    rows = literal(spark, IMAGES, "id long, file string, o string, d string, tier string")
    return rows.select("id", r.image_text(F.col("file"), F.col("o"), F.col("d")).alias("text"), r.image_chunk_type(F.col("tier")).alias("chunk_type"))
