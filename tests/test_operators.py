import bisect
import json
import math
import random
import re
import struct
import zipfile
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill import schemas
from quillmill.functions import quality, routing, text
from quillmill.operators import bm25, chunk_code, chunk_data, chunk_text, fusion, numbering, pages, sampling, unify, vector
from quillmill.sources import files
from quillmill.streaming import ingest


def py_tokens(s):
    out = []
    for m in re.findall(r"[a-zA-Z_][a-zA-Z0-9_]*", s):
        parts = [p.lower() for q in m.split("_") for p in re.split(r"(?<=[a-z0-9])(?=[A-Z])", q) if p]
        out += [m.lower(), *(parts if len(parts) >= 2 else [])]
    return out


TEXTS = ["biased_coin", "getUsername", "中文", "", "__init__ x1Y2", "HTTPServer aB_cD é1a", "a.b-c 1abc _", "camelCaseHTTP_2x"]


def test_tokenizer(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r.w for r in df.select(text.tokenize(F.col("t")).alias("w")).collect()]
    assert got == [py_tokens(t) for t in TEXTS]
    assert got[0] == ["biased_coin", "biased", "coin"] and got[1] == ["getusername", "get", "username"] and got[2] == []


def py_garbled(s):
    words = re.findall("[A-Za-z]+", s)
    if len(words) < 20:
        return None
    bad = 0
    for w in words:
        odd = not set(w) & set("aeiouAEIOUy") or sum(c.isupper() for c in w[1:]) >= 2
        bad += len(w) >= 3 and (len(w) > 25 or (not w.isupper() and odd))
    return bad / len(words)


def test_garbled_ratio_at_its_borders(spark):
    words = ["Ygg", "NASA", "ab", "abc", "bcd", "fooBarBaz", "x" * 25, "a" * 25, "a" * 26, "Rhythm", "YGg", "iPhone"]
    cases = [" ".join(random.Random(i).choices(words, k=n)) for i, n in enumerate([0, 19, 20, 21, 60, 60, 60])]
    got = [r.g for r in spark.createDataFrame([(c,) for c in cases], "t string").select(quality.garbled_ratio(F.col("t")).alias("g")).collect()]
    assert got == [py_garbled(c) for c in cases]


def test_fragmentation_knows_all_line_ends(spark):
    lines = ["ab", "a longer line", "| t", "# h", "", "xyz"]
    body = lambda n, end: end.join((lines * 20)[:n])
    cases = [body(n, e) for n in (38, 40, 41, 80) for e in ("\n", "\r\n", "\r", "\x0b", "\x85", " ")]

    def expect(s):
        kept = [x.strip() for x in s.splitlines() if x.strip() and not x.strip().startswith(("<!--", "|", "#", "```"))]
        return sum(len(x) <= 3 for x in kept) / len(kept) if len(kept) >= 20 else None

    got = [r.g for r in spark.createDataFrame([(c,) for c in cases], "t string").select(quality.fragmentation_ratio(F.col("t")).alias("g")).collect()]
    assert got == [expect(c) for c in cases]


def test_verdicts_of_calibrated_cases(spark):
    """Texts that hit the same thresholds as the calibrated documents."""
    words = lambda bad, n: " ".join(["xkcdqz"] * bad + ["plain"] * (n - bad))
    short = "\n".join(["ab"] * 4 + ["a line with several words"] * 22)
    long = "word " * 300
    cases = [
        (words(20, 108), 1, True), (long, 1, False), (long + "formula-not-decoded " * 2, 1, False), (long + "formula-not-decoded " * 9, 1, True),
        (short, 2, True), ("<!-- image -->", 3, True), ("plain words only " * 12, 1, False), (words(8, 100), 1, False), ("x" * 99, 1, True), ("x" * 100, 1, False),
    ]
    df = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(cases)], "i int, t string, p int")
    d = quality.output_density(F.length("t"), F.col("p"), F.lit(1000))
    r = quality.reasons(quality.garbled_ratio(F.col("t")), quality.fragmentation_ratio(F.col("t")), quality.formula_density(F.col("t")), d["severity"])
    got = {x.i: list(x.r) for x in df.select("i", r.alias("r")).collect()}
    assert [bool(got[i]) for i in range(len(cases))] == [e for *_, e in cases]


def test_bm25_against_the_formula(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices(["aB", "cat", "dog_x", "the", "rare%d" % i], [3, 2, 2, 9, 1], k=rng.randint(1, 30)))) for i in range(40)] + [(40, ""), (41, "")]
    asked = [(0, "cat cat dog_x"), (1, "the rare5"), (2, "nothing zz")]
    bags = {i: Counter(py_tokens(t)) for i, t in docs}
    n, avg = len(docs), sum(sum(b.values()) for b in bags.values()) / len(docs)
    df = Counter(w for b in bags.values() for w in b)
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if x < 0 else x for w, x in idf.items()}

    def score(q, i):
        b, dl = bags[i], sum(bags[i].values())
        return sum(idf.get(w, 0) * b[w] * 2.5 / (b[w] + 1.5 * (0.25 + 0.75 * dl / avg)) for w in py_tokens(q))

    index = bm25.build(spark.createDataFrame(docs, "id long, text string"), "id", "text")
    questions = spark.createDataFrame(asked, "qid long, question string")
    full = bm25.retrieve(index, questions, "qid", "question", 10, require_match=False).collect()
    for q, s in asked:
        want = sorted(bags, key=lambda i: (-round(score(s, i), 6), i))[:10]
        got = sorted((r for r in full if r.qid == q), key=lambda r: r["rank"])
        assert [r.id for r in got] == want and all(abs(r.score - score(s, r.id)) < 1e-9 for r in got)
    assert {r.qid for r in bm25.retrieve(index, questions, "qid", "question").collect()} == {0, 1}


def test_index_round_trip(spark, tmp_path):
    index = bm25.build(spark.createDataFrame([(1, "a b"), (2, "b c c")], "id long, text string"), "id", "text")
    index.write(str(tmp_path))
    asked = spark.createDataFrame([(1, "c")], "qid long, q string")
    rows = [sorted(map(tuple, bm25.retrieve(x, asked, "qid", "q").collect())) for x in (index, bm25.Index.read(spark, str(tmp_path)))]
    assert rows[0] == rows[1] and len(rows[0]) == 1


def test_vectors_exact_and_approximate(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(200)] + [(500, rows_0 := [0.0] * 16), (501, rows_0)]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = spark.createDataFrame(rows[:20], "qid long, vector array<double>")
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    want = {(q, i) for q, v in rows[:20] for i, _ in sorted(rows, key=lambda r: (round(dist(v, r[1]), 6), r[0]))[:5]}
    assert {(r.qid, r.id) for r in vector.top_k(corpus, asked, 5).collect()} == want
    near = {(r.qid, r.id) for r in vector.approximate_top_k(corpus, asked, 5, 16, bits=3, tables=24).collect()}
    assert len(near & want) / len(want) >= 0.9


def test_registered_candidates_reach_the_recall(spark, tmp_path):
    """On unit vectors without structure, the hardest case, as the embeddings table has them."""
    from quillmill.plans import retrieval

    rng = random.Random(2)
    rows = []
    for i in range(600):
        v = [rng.gauss(0, 1) for _ in range(64)]
        norm = math.sqrt(sum(x * x for x in v))
        rows.append((i, [x / norm for x in v]))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.qid, r.id) for r in retrieval.lsh_candidates(spark, str(tmp_path)).collect()}
    want = {(r.qid, r.id) for r in retrieval.vector_topk(spark, str(tmp_path)).collect()}
    assert len(got & want) / len(want) >= 0.9


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.integers(0, 8), unique=True, max_size=6), min_size=1, max_size=3), st.randoms())
def test_fusion_does_not_depend_on_row_order(spark, arms, rnd):
    def fused(shuffle):
        parts = []
        for n, ids in enumerate(arms):
            rows = [(1, i, r) for r, i in enumerate(ids, 1)]
            shuffle(rows)
            parts.append((spark.createDataFrame(rows, "qid long, id long, rank int"), 1.5 if n == 2 else 1.0))
        return [(r.id, round(r.score, 12)) for r in sorted(fusion.fuse(parts, 5).collect(), key=lambda r: r["rank"])]

    scores = {}
    for n, ids in enumerate(arms):
        for r, i in enumerate(ids, 1):
            scores[i] = scores.get(i, 0) + (1.5 if n == 2 else 1.0) / (60 + r)
    want = sorted(scores.items(), key=lambda x: -round(x[1], 12))[:5]
    assert fused(lambda x: None) == fused(rnd.shuffle) == [(i, round(s, 12)) for i, s in want]


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab \n#`\t."), max_size=3000))
def test_splitter_covers_all_text_in_bounded_pieces(body):
    body = body + "\n# Head\n" + body * 3
    got = chunk_text.split_text(body)
    covered = set()
    for piece, kind, _, a, b in got:
        assert body[a:b] == piece and piece == piece.strip() and len(piece) <= 700
        assert kind in ("heading_section", "paragraph")
        covered |= set(range(a, b))
    assert all(c.isspace() for i, c in enumerate(body) if i not in covered)


def test_splitter_headings_and_overlap():
    body = "# One\nintro\n## Two\n" + "word " * 300 + "\n```\n# not a heading\n```\n### Three\nend"
    got = chunk_text.split_text(body)
    assert [g[2] for g in got if g[1] == "heading_section"] == ["One", "Three"]
    paragraphs = [g for g in got if g[1] == "paragraph"]
    assert {g[2] for g in paragraphs} == {"Two"} and all(0 < a[4] - b[3] <= 101 for a, b in zip(paragraphs, paragraphs[1:]) if a[4] > b[3])


def test_as_of_against_bisection(spark):
    rng = random.Random(5)
    anchors = [(d, rng.randint(0, 50), s, rng.randint(0, 9)) for d in "abc" for s in range(rng.randint(1, 8))]
    offsets = [(d, o) for d in "abcz" for o in range(0, 60, 7)]
    got = {(r.doc, r.offset): r.page for r in pages.as_of(spark.createDataFrame(offsets, "doc string, offset long"), spark.createDataFrame(anchors, "doc string, pos long, seq long, page int"), ["doc"]).collect()}
    for d, o in offsets:
        own = sorted([(p, s, g) for x, p, s, g in anchors if x == d])
        at = bisect.bisect_right([p for p, *_ in own], o) - 1
        assert got[d, o] == (None if not own else own[max(at, 0)][2])


def test_anchors_move_forward_and_fall_back(spark):
    texts = spark.createDataFrame([("d", "alpha beta alpha gamma beta")], "doc string, text string")
    blocks = [("d", 0, "text", "alpha", None, 0), ("d", 1, "equation", "alpha", None, 1), ("d", 2, "code", None, "beta", 2), ("d", 3, "text", "alpha beta", None, 3), ("d", 4, "text", "missing", None, 4), ("d", 5, "table", "gamma", None, 5), ("d", 6, "text", "  ", None, 6)]
    got = pages.anchors(texts, spark.createDataFrame(blocks, "doc string, seq long, type string, text string, code_body string, page_idx int"))
    assert sorted((r.seq, r.pos, r.page) for r in got.collect()) == [(0, 0, 0), (1, 11, 1), (2, 23, 2), (3, 0, 3)]


def test_parsers():
    kinds = lambda found: [(c[0], c[1]) for c in found]
    source = "import os\n@deco\nasync def f():\n    'doc'\n\nclass A: pass\nx = 1\n"
    found = chunk_code.python("a.py", source)
    assert kinds(found) == [("py_function", "f"), ("py_class", "A"), ("py_toplevel", None)] and found[0][4] is True and found[0][2].startswith("async def")
    assert chunk_code.python("b.py", "def (:")[0][0] == "py_parse_error"
    assert chunk_code.sql_statements("a ';' b; /* ; */ c -- ;\n; ; \"x;y\" 'it''s;'") == ["a ';' b", "/* ; */ c -- ;", "\"x;y\" 'it''s;'"]
    assert chunk_code.sql("p/q.sql", "select 1;")[0][2] == "q.sql\nselect 1"
    r = chunk_code.r("f.R", "f <- function(a) {\n  # }\n  '}'\n}\ng = function(x) x + 1\nh(2)\n")
    assert kinds(r) == [("r_function", "f"), ("r_function", "g"), ("r_toplevel", None)] and r[0][2].endswith("'}'\n}") and r[2][2] == "h(2)"
    java = "class A {\n  public A(int x) { }\n  @Override\n  public <T> List<T> get(int a) throws E { return \"}\"; }\n  class B {\n    private void run() { /* } */ }\n  }\n  protected abstract int none();\n}"
    found = chunk_code.java("A.java", java)
    assert kinds(found)[:4] == [("java_constructor", "A"), ("java_method", "get"), ("java_method", "run"), ("java_method", "none")]
    assert found[1][2].startswith("这是 A 类的方法:\n") and found[2][2].startswith("这是 B 类的方法:\n") and found[3][2].endswith(";")


def test_notebook_cells():
    cell = lambda kind, text, outputs=(): {"cell_type": kind, "source": text, "outputs": list(outputs)}
    long = {"output_type": "stream", "text": ["y" * 2500]}
    image = {"output_type": "display_data", "data": {"image/png": "..", "text/html": ".."}}
    error = {"output_type": "error", "ename": "E", "evalue": "v"}
    cells = [cell("markdown", "a"), cell("markdown", "b"), cell("code", "c", [image, error]), cell("markdown", "d"), cell("code", " "), cell("code", "e", [long]), cell("raw", "f"), cell("markdown", "g")]
    found = chunk_code.notebook("n.ipynb", json.dumps({"cells": cells}))
    assert [(c[0], c[3]) for c in found] == [("ipynb_markdown", [0]), ("ipynb_merged", [1, 2]), ("ipynb_markdown", [3]), ("ipynb_code", [5]), ("ipynb_markdown", [7])]
    assert "image/png, text/html" in found[1][2] and "E: v" in found[1][2] and "2500" in found[3][2]


def test_tables(tmp_path):
    header = ",".join(f"f{i}" for i in range(70))
    summary, flag, rows, columns = chunk_data.csv_summary("x.csv", "c", f"﻿{header}\n{','.join('1' * 70)}\n".encode())
    assert (rows, columns) == (1, 70) and "等共70个字段" in summary and "﻿" not in summary
    assert chunk_data.read_csv("姓名,年龄\n张,3\n".encode("gb18030")).encoding == "gb18030" and chunk_data.read_csv(b"") == chunk_data.Table([], 0, "utf-8-sig", None)
    path = tmp_path / "b.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row><row><c><v>1</v></c></row></sheetData></worksheet>')
    text_, _, rows, columns = chunk_data.workbook_summary("b.xlsx", "c", path.read_bytes())
    assert (rows, columns) == (1, 2) and text_ == "b.xlsx 是 c 课程的数据集(Excel格式)。包含 1 行、2 列。字段包括:name, 7。"


def test_file_tree(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 60, 70) + b"\0" * 20
    for path, data in {"c1/a.PDF": b"x", "c1/index/b.py": b"x", "c1/._j.py": b"x", "root.py": b"x", "c2/i.png": png, "c2/bad.png": b"no", "c2/s/x.csv": b"a,b\n1,2\n", "c3/__init__.py": b"", "c3/_p/_h.R": b"y", "c3/.hidden.sql": b"z"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    tree = files.scan(spark, str(tmp_path))
    assert sorted((r.rel, r.category, r.ext) for r in tree.collect()) == [
        ("c1/a.PDF", "文本知识类", ".pdf"), ("c2/bad.png", "图片类", ".png"), ("c2/i.png", "图片类", ".png"), ("c2/s/x.csv", "数据摘要类", ".csv"),
        ("c3/.hidden.sql", "代码知识类", ".sql"), ("c3/__init__.py", "代码知识类", ".py"), ("c3/_p/_h.R", "代码知识类", ".r"),
    ]
    found = files.images(files.scan(spark, str(tmp_path), content=True).filter("ext = '.png'")).collect()
    assert [(r.rel, r.width, r.height) for r in found] == [("c2/i.png", 60, 70)]
    assert [r.rel for r in files.of_type(tree, ".csv").collect()] == ["c2/s/x.csv"]


def test_reports_and_document_index(spark, tmp_path):
    (tmp_path / "r.csv").write_text('﻿file,needs_llamaparse,pages,md_file\na,True,3.0,a.md\n"b\n2",False,,b.md\nc,ERROR,x,\n', encoding="utf-8")
    report = files.read_report(spark, str(tmp_path / "r.csv"))
    assert report.columns[0] == "file"
    typed = {r.file: (r.flagged, r.page_count) for r in files.typed_report(report).collect()}
    assert typed == {"a": (True, 3), "b\n2": (False, None), "c": (None, None)}
    manifest = spark.createDataFrame([("a", "k", "llamaparse_done", "l.md", "", "n"), ("b\n2", "k", "good", None, "why", None), ("c", "k", "pending", None, None, None), ("z", "k", "good", None, None, None)], "file string, course string, quality string, llamaparse_md_file string, docling_reasons string, note string")
    got = {r.file: (r.md_file, r.source_note) for r in files.document_index(manifest, report).collect()}
    assert got == {"a": ("l.md", "n"), "b\n2": ("b.md", "why")}


def test_parser_output(spark, tmp_path):
    (tmp_path / "x_content_list.json").write_text(json.dumps([{"type": "text", "text": "t", "page_idx": 2}, {"type": "equation", "text": "e", "page_idx": 3}]))
    blocks = files.content_lists(spark, str(tmp_path / "x_content_list.json"))
    assert [(r.doc, r.seq, r.type, r.page_idx) for r in blocks.collect()] == [("x", 0, "text", 2), ("x", 1, "equation", 3)]
    assert [(r.doc, r.page) for r in pages.equation_pages(blocks).collect()] == [("x", 3)]
    (tmp_path / "y_middle.json").write_text("broken")
    assert files.middles(spark, str(tmp_path / "y_middle.json")).first().pdf_info is None


def test_image_chunks_take_the_last_good_attempt(spark):
    rows = [("p1", "c/a.pdf", "c", "mineru", "both", "o", "d", "0.9", 2, None), ("p2", "c/b.png", "c", "standalone", "", "", "", "", None, "boom"), ("p2", "c/b.png", "c", "standalone", "vlm_only", "", "d", "", None, "")]
    df = spark.createDataFrame(rows, "path string, file string, course string, source string, tier string, ocr_text string, vlm_desc string, ocr_conf string, page_idx int, error string")
    got = unify.image_chunks(df).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.chunk_type, r.source_citation, r.position.page_start) for r in got] == [("img_00000", "image_ocr_vlm", "c / a.pdf p.3", 2), ("img_00001", "image_vlm", "c / b.png", None)]
    assert unify.conform(df).schema == schemas.CHUNK


def test_dense_numbers(spark):
    rows = [(random.Random(i).choice("abc"), i) for i in range(50)] + [(None, 99)]
    got = numbering.dense(spark.createDataFrame(rows, "k string, i int"), ["k", "i"], "n").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [(r.k, r.i) for r in sorted(got, key=lambda r: r.n)] == want and sorted(r.n for r in got) == list(range(51))


def test_samples_meet_their_quotas(spark):
    rows = [(i, f"c{i % 4}", f"f{i % 9}", ["small", "large"][i % 2]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, course string, file string, bucket string")
    got = sampling.stratified(df, 20, "course", "bucket", "id", 42).collect()
    assert len(got) == 20 and set(Counter(r.course for r in got).values()) == {5}
    assert sorted(r.id for r in got) == sorted(r.id for r in sampling.stratified(df.repartition(5), 20, "course", "bucket", "id", 42).collect())
    quotas = spark.createDataFrame([("c0", 3), ("c1", 12)], "course string, quota int")
    picked = sampling.diverse(df, quotas, "course", "file", "id", 1).collect()
    assert Counter(r.course for r in picked) == {"c0": 3, "c1": 12} and len({r.file for r in picked if r.course == "c0"}) == 3
    robin = sampling.round_robin(df, 10, "course", "file", "id", 2).collect()
    assert sorted(Counter(r.course for r in robin).values()) == [2, 2, 3, 3]


def test_ingest_twice_adds_nothing(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    schema = "id long, text string"
    run = lambda: ingest.ingest(spark, src, schema, out, ckpt, "id", lambda df: df.filter("text <> ''"))
    spark.createDataFrame([(1, "a"), (2, ""), (1, "a")], schema).write.parquet(src)
    run()
    run()
    spark.createDataFrame([(1, "again"), (3, "c")], schema).write.mode("append").parquet(src)
    run()
    assert sorted((r.id, r.text) for r in spark.read.parquet(out).collect()) == [(1, "a"), (3, "c")]


def test_paths(spark):
    cases = {".gitignore": "", "a.tar.GZ": ".gz", "x": "", "dir.d/y.R": ".r", ".hidden.py": ".py", "a.": ""}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.s for r in df.select("p", routing.suffix(F.col("p")).alias("s")).collect()} == cases


def test_null_vectors_blocks_of_queries_and_the_store(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(100, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = df.filter("id < 7 or id = 100").withColumnRenamed("id", "qid")
    once = {(r.qid, r.id, r["rank"]) for r in vector.top_k(df, asked, 3).collect()}
    assert len(once) == 21 and 100 not in {q for q, *_ in once}
    vector.write_store(df, str(tmp_path / "store"))
    monkeypatch.setattr(vector, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(vector, "BLOCK_ROWS", 5)
    assert {(r.qid, r.id, r["rank"]) for r in vector.top_k(vector.read_store(spark, str(tmp_path / "store")), asked, 3).collect()} == once
    assert vector.top_k(df, asked.limit(0), 3).count() == 0 and vector.approximate_top_k(df, asked, 3, 4, bits=2, tables=8).count() == 21


def test_quotations_are_found_wherever_they_begin(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "see fooBarBaz is here xfooBar"), (2, "没有 ASCII 的问题吗"), (3, None), (4, "")], "id long, body string")
    asked = spark.createDataFrame([(1, "BarBaz is here xfooBa"), (2, "的问题"), (3, ""), (4, "BarBaz is here xfooBa"), (5, None)], "qid long, question string")
    want = {(1, 1), (2, 2), (4, 1)}
    assert {tuple(r) for r in bm25.quoting(docs, asked).collect()} == want
    monkeypatch.setattr(bm25, "BLOCK_QUESTIONS", 1)
    assert {tuple(r) for r in bm25.quoting(docs, asked).collect()} == want
    scored = spark.createDataFrame([(1, 5, 2.0), (1, 6, 3.0), (1, 7, 2.0), (2, 1, 1.0)], "qid long, id long, score double")
    targets = spark.createDataFrame([(1, 7), (2, 9), (3, 1)], "qid long, target long")
    assert {tuple(r) for r in bm25.rank_of(scored, targets).collect()} == {(1, 7, 3), (2, 9, None), (3, 1, None)}


def test_no_window_gathers_all_rows(spark):
    from quillmill.operators import evaluate

    df = spark.range(5000).selectExpr("id", "'k' as k", "id % 7 as n")
    out = numbering.dense(df, ["k", "id"], "at")
    assert sorted((r.id, r.at) for r in out.collect()) == [(i, i) for i in range(5000)]
    per_range = df.groupBy(numbering.range_of(df, ["k", "id"]).alias("r")).count().collect()
    assert len(per_range) == 4 and max(r["count"] for r in per_range) < 2500
    total = evaluate.running(df, F.col("n"), ["id"], ["k"], "total").collect()
    sums, seen = {}, 0
    for i in range(5000):
        seen += i % 7
        sums[i] = seen
    assert {r.id: r.total for r in total} == sums


def test_images_are_tried_again_and_failures_are_rows(spark):
    from quillmill.operators import images

    def ocr(data):
        if data == b"broken":
            raise ValueError("unreadable")
        return [("clear", 0.9), ("text", 0.95)] if data == b"clear" else [("dim", 0.3)] if data == b"dim" else []

    waits = []
    assert images.attempted(ocr, b"broken", 3, 1.0, waits.append) == (None, "ValueError: unreadable") and waits == [1.0, 2.0]
    df = spark.createDataFrame([("a", b"clear"), ("b", b"dim"), ("c", b"broken"), ("d", b"none")], "path string, content binary")
    got = {r.path: r for r in images.described(df, ocr, lambda data: (f"{len(data)} bytes", 10, 2), wait=0.0).collect()}
    assert got["a"].tier == "ocr_only" and got["a"].ocr_text == "clear text" and got["a"].vlm_desc == ""
    assert got["b"].tier == "vlm_only" and got["b"].vlm_desc == "3 bytes" and got["b"].tokens_in == 10 and got["d"].ocr_conf == 0.0
    assert got["c"].error == "ValueError: unreadable" and got["c"].tier is None


def test_one_broken_row_does_not_stop_the_rest(spark):
    from quillmill.operators import runs

    df = spark.createDataFrame([(1, "2"), (2, "x"), (3, "1")], "doc long, body string")
    got = runs.isolated(df, "doc", lambda row: [{"n": int(row["body"]), "piece": str(i)} for i in range(int(row["body"]))], "n long, piece string")
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert [r[:3] for r in rows] == [(1, 2, "0"), (1, 2, "1"), (2, None, None), (3, 1, "0")] and rows[2][3].startswith("ValueError")
    status = runs.output_status(df, got.filter("error is null"))
    assert {(r.doc, r.status) for r in status.collect()} == {(1, "ok"), (2, "failed"), (3, "ok")}


def test_page_counts_targets_and_reports(spark, tmp_path):
    rows = [("a", b"%PDF-1.4 /Type /Pages /Type /Page >> /Type/Page >>"), ("b", b"no"), ("c", b"%PDF-1.5 packed")]
    got = {r.path: r.pages for r in files.page_counts(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"a": 2, "b": None, "c": None}
    report = spark.createDataFrame([("f1", "X", "True"), ("f2", "X", "True"), ("f3", "Y", "True"), ("f4", "X", "False")], "file string, course string, needs_llamaparse string")
    done = spark.createDataFrame([("f2", None), ("f1", "failed")], "file string, error string")
    assert [r.file for r in files.reparse_targets(report, report.select("file"), ["X"], done).collect()] == ["f1"]
    files.with_column_added(report, done.select("file", F.lit("3").alias("page")), "file", str(tmp_path / "v2"))
    assert {r.file: r.page for r in spark.read.option("header", True).csv(str(tmp_path / "v2")).collect()} == {"f1": "3", "f2": "3", "f3": None, "f4": None}


STATEMENTS = [
    ("-- note\n/* two\nlines */ create  table t (x int)", "CREATE TABLE"), ("create /* what */ table t", "CREATE"), ("select*from t", "SELECT"),
    ("", "UNKNOWN"), ("-- alone", "UNKNOWN"), ("/* open", "UNKNOWN"), ("(select 1)", "UNKNOWN"), (None, None), ("  Insert\ninto t", "INSERT"),
    ("/**/" * 5000 + "delete from t", "DELETE"), ("create", "CREATE"), ("-- create table\nupdate t", "UPDATE"),
]


def test_first_words_of_statements(spark):
    rows = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(STATEMENTS)], "i int, s string")
    assert [r.kind for r in rows.select("i", routing.sql_type(rows.s).alias("kind")).orderBy("i").collect()] == [k for _, k in STATEMENTS]
