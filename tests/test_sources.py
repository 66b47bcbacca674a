"""Readers, structured files and writers on small inputs made here."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lyceum.functions import text as T
from lyceum.sources import bibtex, files, readers, sinks


def docx():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Lattices", "Title") + p("Cells", "Heading1") + p("Unit cells tile space.") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def pptx():
    a, p = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"
    para = lambda t, lvl=0: f'<a:p><a:pPr lvl="{lvl}"/><a:r><a:t>{t}</a:t></a:r></a:p>'
    shape = lambda body, ph="": f'<p:sp><p:nvSpPr><p:nvPr>{f"<p:ph type={chr(34)}{ph}{chr(34)}/>" if ph else ""}</p:nvPr></p:nvSpPr><p:txBody>{body}</p:txBody></p:sp>'
    slide = lambda inner: f'<p:sld xmlns:a="{a}" xmlns:p="{p}"><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/slides/slide1.xml", slide(shape(para("Waves"), "title") + shape(para("Amplitude") + para("of a wave", 1))))
        z.writestr("ppt/slides/slide2.xml", slide(shape(para("Only text"))))
        z.writestr("ppt/notesSlides/notesSlide1.xml", slide(shape(para("Say hello"), "body")))
    return out.getvalue()


def test_single_readers():
    title, parts = readers.read_html(b"<html><head><title>A &amp; B</title><script>x()</script></head><nav>menu</nav><h1>Top</h1><p>Hello <b>you</b></p><ul><li>one</li></ul></html>", "s")
    assert title == "A & B" and parts[0][0] == "# Top\n\nHello you\n\n- one"
    title, parts = readers.read_latex(rb"\title{Notes}\begin{document}\section{One}% hidden" + b"\n" + rb"Some \textbf{bold} math $a_b$ \label{x}\begin{itemize}\item first\end{itemize}\end{document}", "s")
    assert title == "Notes" and "## One" in parts[0][0] and "bold" in parts[0][0] and "- first" in parts[0][0] and "hidden" not in parts[0][0] and "label" not in parts[0][0] and "$a_b$" in parts[0][0]
    title, parts = readers.read_docx(docx(), "s")
    assert title == "Lattices" and parts[0][0] == "# Lattices\n\n## Cells\n\nUnit cells tile space.\n\na | b"
    _, parts = readers.read_pptx(pptx(), "s")
    assert [w for _, w in parts] == ["slide 1", "slide 2"] and parts[0][0].startswith("## Waves") and "- of a wave" in parts[0][0] and "Speaker notes: Say hello" in parts[0][0] and parts[1][0].startswith("## Slide 2")
    nb = {"cells": [{"cell_type": "markdown", "source": ["# Nb\n", "text"]}, {"cell_type": "code", "source": "x = 1"}, {"cell_type": "code", "source": "  "}]}
    title, parts = readers.read_notebook(json.dumps(nb).encode(), "s")
    assert title == "Nb" and parts[0][0] == "# Nb\ntext\n\n```python\nx = 1\n```"
    assert readers.read_text(b"Plain   notes \r\n\r\n\r\n\r\nhere", "s")[1] == [("Plain notes\n\nhere", "")]
    assert readers.read("bad.pdf", b"nope")[2].startswith("Could not read") and readers.read("a.txt", b" ")[2].startswith("No text")


def test_discovery_and_parsing(spark, tmp_path):
    for name, body in {"w1/a.md": "# A\ntext", "w1/b c.txt": "hello", "_build/x.md": "no", "pkg.egg-info/y.md": "no", "skip.md": "no", "bad.docx": "zip?", "z.bin": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    found = files.discover(spark, str(tmp_path), exclude=["skip.md"])
    assert [r.file_path for r in found.collect()] == ["bad.docx", "w1/a.md", "w1/b c.txt"]
    parts = {r.file_path: r for r in files.parse(found).collect()}
    assert parts["w1/a.md"].title == "A" and parts["w1/b c.txt"].text == "hello" and parts["bad.docx"].warning.startswith("Could not read")
    (tmp_path / "toc.yml").write_text("project:\n  toc:\n    - file: w1/a.md\n      children:\n        - file: gone.md\n    - file: bad.docx\n")
    listed, missing = files.listed(files.contents(spark, str(tmp_path / "toc.yml")), found)
    assert [r.file_path for r in listed.collect()] == ["w1/a.md", "bad.docx"] and [r.warning for r in missing.collect()] == ["Missing file: gone.md"]


def test_structured_files(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"version": 1, "concepts": [{"id": "a", "label": "A", "aliases": ["aa"]}, {"id": "b", "label": "B", "aliases": None}]}))
    assert sorted((r.id, list(r.aliases)) for r in files.concepts(spark, str(tmp_path / "c.json")).collect()) == [("a", ["aa"]), ("b", [])]
    (tmp_path / "q.json").write_text(json.dumps([{"query": "what", "expected_files": ["x.md"]}, {"id": "own", "query": "why"}, {"id": "none"}]))
    assert sorted((r.id, r.query) for r in files.questions(spark, str(tmp_path / "q.json")).collect()) == [("own", "why"), ("q1", "what")]
    (tmp_path / "r.csv").write_text("﻿E-mail,Full Name,Limit\n A@x.org ,Ann,\nb@x.org,Bob,5\na@x.org,Anna,7\nnot an address,C,1\n")
    good, bad = files.roster(spark, str(tmp_path / "r.csv"))
    assert sorted(tuple(r) for r in good.collect()) == [("a@x.org", "Anna", 7), ("b@x.org", "Bob", 5)] and [r.email for r in bad.collect()] == ["not an address"]
    (tmp_path / "n.csv").write_text("name\nx\n")
    with pytest.raises(ValueError):
        files.roster(spark, str(tmp_path / "n.csv"))
    lines = spark.createDataFrame([("event: x",), ('data: {"a": 1}',), ("data: [DONE]",), ("data:",)], "value string")
    assert [r.data for r in files.server_events(lines).collect()] == ['{"a": 1}']
    reply = spark.createDataFrame([('Sure: [{"a": 1}, {"a": 2}] done',), ("none",), ("[broken",)], "t string").select(files.reply_objects(F.col("t"), "struct<a:int>").alias("o"))
    assert [len(r.o) for r in reply.collect()] == [2, 0, 0]
    (tmp_path / "w.toml").write_text('[files]\ntypes = ["md"]\n[[chapters]]\nfolder = "a"\nshow = "loud"\n')
    with pytest.raises(ValueError):
        files.settings(str(tmp_path / "w.toml"))


BIB = r"""
@comment{not this}
@string{x = "y"}
@article{one, title = {A {Nested} study of H<sub>2</sub>O}, author = {Doe, Jane and Roe*, Rick and M\"{u}ller, Max}, journal = "Acta" # " Nova", year = 2020, keywords = {ai, skip me}, doi = {10.1/x}}
@inproceedings(two, title = "Second", author = "Jane Doe and Rick Roe", year = {in press}, keywords = {ai})
@thesis{three, title = {Alone}, author = {Nobody, N.}, year = {1999}}
"""


def test_bibtex(spark):
    from lyceum.operators import publications

    found = bibtex.parse(BIB)
    assert [(k, key) for k, key, _ in found] == [("article", "one"), ("inproceedings", "two"), ("thesis", "three")]
    assert found[0][2]["journal"] == "Acta Nova" and found[0][2]["year"] == "2020" and found[1][2]["title"] == "Second"
    entries = bibtex.entries(spark.createDataFrame([(BIB,)], "value string"))
    nodes, edges = publications.graph(entries, {"ai": "Learning", "skip me": None}, me="Doe, Jane", least=2)
    n = {r.id: r for r in nodes.collect()}
    assert set(n) == {"paper:one", "paper:two", "person:rick-roe", "theme:learning"}
    assert n["paper:one"].title == "A Nested study of H<sub>2</sub>O" and n["paper:one"].label == "A Nested study of H2O" and n["paper:one"].authors == "Jane Doe, Rick Roe, Max Müller"
    assert n["paper:one"].url == "https://doi.org/10.1/x" and n["paper:one"].year_int == 2020 and n["paper:two"].year_int is None and n["person:rick-roe"].papers == 2
    assert edges.count() == 4


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00", "w", "answerable", [str(i) for i in range(12)], ["a", "b", "c", "d"], "  two \n words ")], "id int, time string, app string, status string, concepts array<string>, files array<string>, question string").withColumn("time", F.col("time").cast("timestamp_ntz"))
    kept, counts = sinks.ask_rows(rows, True).head(), sinks.ask_rows(rows, False).head()
    assert len(kept.concepts) == 8 and len(kept.files) == 3 and kept.question == "two words" and counts.question is None
    sinks.append_events(sinks.ask_rows(rows, True), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).filter("day = '2024-01-01'").count() == 1
    old = spark.createDataFrame([("a", "kept")], "id string, label string")
    new = spark.createDataFrame([("a", "new", "w"), ("b", "new", "w")], "id string, label string, working string")
    assert sorted(tuple(r) for r in sinks.merged(old, new, working=("working",)).collect()) == [("a", "kept"), ("b", "new")]
    n = spark.createDataFrame([("x", "chapter", "X")], "id string, type string, label string")
    e = spark.createDataFrame([("x", "y", "covers", 1.0)], "source string, target string, type string, weight double")
    doc = json.loads(sinks.graph_document(n, e).head().value)
    assert doc["schema_version"] == "1.3" and doc["nodes"][0]["id"] == "x"
    sinks.report(spark.createDataFrame([(2, "b"), (1, "a")], "n int, line string"), str(tmp_path / "r.md"), str(tmp_path / "h"))
    assert (tmp_path / "r.md").read_text() == "a\nb\n" and len(list((tmp_path / "h").iterdir())) == 1


def test_text_functions(spark):
    def one(column, **values):
        return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).head().x

    assert one(T.folder_title("f"), f="models_and_theories_II") == "Models and Theories II"
    assert one(T.folder_title("f"), f="the-art-OF_DFT iv") == "The Art of DFT IV"
    assert one(T.clean("t"), t="a \t b\r\nc d\n\n\n\ne ") == "a b\nc d\n\ne"
    assert one(T.plain_sentences("t"), t="# H\n```\ncode\n```\n- One [link](u) here. Two *bold* words.\n\n| t |\nThird one") == ["One link here.", "Two bold words.", "Third one"]
    assert [(s.heading, s.body) for s in one(T.page_sections("t"), t="pre\n## A ##\nx\n```\n# no\n```\n# B")] == [("", "pre"), ("A", "x\n```\n# no\n```"), ("B", "")]
    assert one(T.list_items(F.col("t")), t="- a [b](c) item;\n2. second\n* ok\nplain\n- zoom link") == ["a b item", "second"]
    assert one(T.query_phrases("t"), t="What is the net force of motion") == ["force motion", "force of motion", "net force", "net force of", "the net force"]
    assert one(T.without_comments("t"), t="a<!-- b\nc -->d") == "ad"
    assert one(T.slug("t"), t="Énergie & Travail!") == "énergie-travail"
    import re

    assert re.findall(T.alias_pattern("convex hull"), "convex-hull convex  hull xconvex hull") and one(F.regexp_count("t", F.lit(T.alias_pattern("convex hull"))), t="convex-hull convex  hull xconvex hull") == 2
