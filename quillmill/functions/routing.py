"""Column expressions for paths, categories, citations, statement types and metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The categories of files and the rules that assign them.
TEXT, CODE, DATA, IMAGE, EXCLUDED, UNKNOWN = "文本知识类", "代码知识类", "数据摘要类", "图片类", "排除类", "未分类"
CATEGORIES = {
    TEXT: ".pdf .docx .pptx .txt .md .rmd .html".split(),
    CODE: ".ipynb .py .r .sql .java .lp".split(),
    DATA: ".csv .xlsx".split(),
    IMAGE: ".png .jpg .jpeg".split(),
    EXCLUDED: ".class .jar .dll .exe .xml .iml .zip .pkl .m4a .mp4 .json .yml".split(),
}
EXCLUDED_NAMES = [".gitignore", ".Rhistory", ".RData", ".name", "LICENSE", "text8"]
EXCLUDED_PREFIXES = ["model-checkpoint"]
EXCLUDED_DIRS = [".claude", ".git", "ingest", "__MACOSX", ".venv", "index", "query", "evaluate"]
CREATE_KINDS = ["TABLE", "INDEX", "VIEW", "DATABASE", "SCHEMA", "TRIGGER", "PROCEDURE", "FUNCTION"]


def parts(path: Column) -> Column:
    """The path's parts; both slashes separate."""
    return F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: p != "")


def file_name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def suffix(path: Column) -> Column:
    """The lower-cased extension with its dot; none for names that only begin or end with a dot."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.].*?(\.[^.]+)$", 1))


def category(path: Column) -> Column:
    """Exact names first, then prefixes, then the extension."""
    name, ext = file_name(path), suffix(path)
    out = F.when(name.isin(*EXCLUDED_NAMES), EXCLUDED)
    for prefix in EXCLUDED_PREFIXES:
        out = out.when(name.startswith(prefix), EXCLUDED)
    for kind, extensions in CATEGORIES.items():
        out = out.when(ext.isin(*extensions), kind)
    return out.otherwise(UNKNOWN)


def excluded_dir(path: Column) -> Column:
    every = parts(path)
    return F.arrays_overlap(F.slice(every, 1, F.greatest(F.size(every) - 1, F.lit(0))), F.array(*map(F.lit, EXCLUDED_DIRS)))


def junk(path: Column) -> Column:
    name = file_name(path)
    return name.startswith("._") | (name == ".DS_Store")


def course(path: Column) -> Column:
    """The first part; empty for a file at the root."""
    every = parts(path)
    return F.when(F.size(every) > 1, F.get(every, F.lit(0))).otherwise("")


def final_related(path: Column) -> Column:
    return F.coalesce(F.lower(path).contains("final") | path.contains("期末"), F.lit(False))


#: The pieces of a statement: comments to the line's end, comments in stars, words, single signs. White space is none.
_COMMENT, _PIECE = r"--[^\n]*\n|/\*[\s\S]*?\*/", r"\w+|\S"


def sql_type(statement: Column) -> Column:
    """The first keyword behind leading comments; CREATE with what it creates; UNKNOWN without a word. A comment
    between CREATE and the next word leaves CREATE alone; null stays null."""
    pieces = F.regexp_extract_all(statement, F.lit(f"{_COMMENT}|{_PIECE}"), F.lit(0))
    first = F.get(F.filter(pieces, lambda x: ~(x.startswith("/*") | x.startswith("--"))), F.lit(0))
    following = F.upper(F.get(pieces, F.array_position(pieces, first).cast("int")))
    made = (F.upper(first) == "CREATE") & following.isin(*CREATE_KINDS)
    named = F.when(made, F.concat_ws(" ", F.upper(first), following)).otherwise(F.upper(first))
    return F.when(first.rlike(r"^\w"), named).when(statement.isNotNull(), "UNKNOWN")


def citation(course_: Column, path: Column, first: Column, last: Column) -> Column:
    """course / file, with 1-based pages where there are any (first and last are 0-based)."""
    pages = F.when(first.isNull(), "").when(
        first == last, F.concat(F.lit(" p."), (first + 1).cast("string"))
    ).otherwise(F.concat(F.lit(" p."), (first + 1).cast("string"), F.lit("-"), (last + 1).cast("string")))
    return F.concat(course_, F.lit(" / "), file_name(path), pages)


# The wording of a source's description.
FOLDER_OPEN, FOLDER_CLOSE, FOLDER_ALONE, COURSE_ALONE, NO_SOURCE = "(", "相关)的课程材料", "相关的课程材料", "的课程材料", "课程原始材料"


def source_description(path: Column, course_: Column) -> Column:
    """A source without its path: the course and the folder below it."""
    every = parts(F.coalesce(path, F.lit("")))
    folder = F.when(F.size(every) > 2, F.get(every, F.lit(1)))
    named = F.coalesce(course_, F.lit("")) != ""
    with_folder = F.when(named, F.concat(course_, F.lit(FOLDER_OPEN), folder, F.lit(FOLDER_CLOSE))).otherwise(F.concat(folder, F.lit(FOLDER_ALONE)))
    return F.when(folder.isNotNull(), with_folder).when(named, F.concat(course_, F.lit(COURSE_ALONE))).otherwise(NO_SOURCE)


def flat_flags(flags: Column) -> Column:
    """A list as comma-joined text, as flat stores want it; null stays null."""
    return F.when(flags.isNotNull(), F.array_join(flags, ","))


def flag_list(text: Column) -> Column:
    """The list of a comma-joined text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda x: x != "")


def image_text(file: Column, ocr: Column, description: Column) -> Column:
    some = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label + "\n"), c))
    return F.concat_ws("\n", file_name(file), some("[图片OCR文字]", ocr), some("[图片描述]", description))


def image_chunk_type(tier: Column) -> Column:
    return F.when(tier == "ocr_only", "image_ocr").when(tier == "vlm_only", "image_vlm").when(tier == "both", "image_ocr_vlm")


def test_category(flags: Column) -> Column:
    return F.when(F.coalesce(F.size(flags), F.lit(0)) > 0, "abstention").otherwise("standard")
