"""Readers' corner cases, aliases in any number, phrases, the ask flow, and refusals, on small inputs made here."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from lyceum.functions import privacy
from lyceum.functions import text as T
from lyceum.operators import concepts, gate, graph, incremental, phrases, search, sizes, suggest
from lyceum.plans import course
from lyceum.sources import files, readers, sinks
from lyceum.streaming import events as S


def test_web_pages():
    title, text = readers.html_parts("<title> A\n page </title><header>no</header><body>in<nav><p>menu</p></nav><pre>x = 1\n  y = 2</pre><h2>B <i>c</i></h2>one<br>two<svg><title>t</title></svg><ol><li>1</li><li>2 &lt; 3</li></ol>")
    assert text == "in\n\nx = 1\ny = 2\n\n## B c\n\none\n\ntwo\n\n- 1\n\n- 2 < 3" and title.startswith("A page")
    assert readers.html_parts("") == ("", "") and readers.html_parts("</nav><p>a") == ("", "a")


def test_latex_rules():
    text = lambda src: readers.latex_text(src)[1]
    assert readers.latex_text(r"\title{T}\begin{document}x 50\% % gone" + "\nunended") == ("T", "x 50\\% \nunended".replace(" \n", "\n"))
    assert text(r"\url{a.b} \mbox{c} \textrm{d \textsf{e \emph{f}}} \textbf{$x_{1}$}") == r"a.b c d e f \textbf{$x_{1}$}"
    assert text(r"\subsection*{S}a~b\\c\cite[p. 1]{k}\ref{r}\small d\smallskip") == "### S\n\na b\ncd\\smallskip".replace("cd", "c d")
    assert text(r"\begin{figure}[h]f\end{figure}\begin{align}g\end{align}") == r"f\begin{align}g\end{align}"
    assert text(r"\begin{itemize}\item[a] b \item c\end{itemize}") == "- [a] b\n- c"


@pytest.mark.parametrize("seed", range(20))
def test_clean_as_replacements(seed):
    rng = random.Random(seed)
    raw = "".join(rng.choice(["a", " ", "\t", "\n", "\r\n", "\r", "\u00a0", "b c"]) for _ in range(60))
    out = re.sub("[ \t\u00a0]+", " ", raw.replace("\r\n", "\n").replace("\r", "\n"))
    assert readers.clean(raw) == re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", out)).strip()


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


A, P, R = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def slide(*shapes):
    body = "".join(f'<p:sp><p:nvSpPr><p:nvPr>{f"<p:ph type={chr(34)}{k}{chr(34)}/>" if k else ""}</p:nvPr></p:nvSpPr><p:txBody>{"".join(f"<a:p><a:pPr lvl={chr(34)}{v}{chr(34)}/><a:r><a:t>{t}</a:t></a:r></a:p>" for v, t in lines)}</p:txBody></p:sp>' for k, lines in shapes)
    return f'<p:sld xmlns:a="{A}" xmlns:p="{P}"><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>'


def rels(**targets):
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="x/{t.split(":")[0]}" Target="{t.split(":")[1]}"/>' for i, t in targets.items()) + "</Relationships>"


def test_deck_by_its_relations():
    """Notes belong to the slide that is related to them; the deck's order counts; tables keep their rows."""
    deck = f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldIdLst><p:sldId id="1" r:id="b"/><p:sldId id="2" r:id="a"/></p:sldIdLst></p:presentation>'
    table = f'<p:sld xmlns:a="{A}" xmlns:p="{P}"><p:graphicFrame><a:tbl><a:tr><a:tc><a:p><a:r><a:t>x</a:t></a:r></a:p></a:tc><a:tc><a:p><a:r><a:t>y</a:t></a:r></a:p></a:tc></a:tr><a:tr><a:tc/><a:tc/></a:tr></a:tbl></p:graphicFrame></p:sld>'
    data = zipped({"ppt/presentation.xml": deck, "ppt/_rels/presentation.xml.rels": rels(a="slide:slides/slide1.xml", b="slide:slides/slide2.xml"), "ppt/slides/slide1.xml": table, "ppt/slides/slide2.xml": slide(("title", [(0, "Waves")]), ("", [(0, "plain"), (1, "below")]), ("sldNum", [(0, "7")])), "ppt/slides/_rels/slide2.xml.rels": rels(n="notesSlide:../notesSlides/notesSlide1.xml"), "ppt/slides/_rels/slide1.xml.rels": rels(l="slideLayout:../l.xml"), "ppt/notesSlides/notesSlide1.xml": slide(("body", [(0, "Say it")]), ("sldNum", [(0, "7")]))})
    assert readers.read_pptx(data, "s") == ("Waves", [("## Waves\n\nplain\n- below\n\nSpeaker notes: Say it", "slide 1"), ("## Slide 2\n\nx | y", "slide 2")])


def test_document_properties():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Cells</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    assert readers.read_docx(zipped({"word/document.xml": body}), "s") == ("Cells", [("### Cells\n\na\nb", "")])
    own = '<c xmlns:dc="d"><dc:title> Manual </dc:title></c>'
    assert readers.read_docx(zipped({"word/document.xml": body, "docProps/core.xml": own}), "s")[0] == "Manual"


def test_aliases_in_any_number(spark):
    """6,000 aliases of several words and odd ones, against plain patterns."""
    names = [f"word{i} tail{i % 7}" for i in range(6000)] + ["c++", "k-means", "+ +", "a.b", "\\e x"]
    tax = spark.createDataFrame([(f"c{i}", [n]) for i, n in enumerate(names)], "id string, aliases array<string>")
    texts = ["word5999 tail0 and word3-tail3, word3  tail3; xword4 tail4", "C++ k-means a.b ab + + \\E X", "c+ + word1 tail1s", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string").withColumn("title", F.lit("")).withColumn("section", F.lit(None).cast("string"))
    got = {(r.id, r.concept): r.n for r in concepts.mentions(rows, tax, ["id"]).collect()}
    plain = [" ".join((t or "").lower().replace("_", " ").split()) for t in texts]
    want = {(i, f"c{k}"): n for i, t in enumerate(plain) for k, a in enumerate(names) if (n := len(re.findall(T.alias_pattern(a), t)))}
    assert got == want and len(want) >= 7


@pytest.mark.parametrize("block", [50_000, 3])
def test_phrases_as_substrings(spark, block):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("ab c") for _ in range(40))) for i in range(30)] + [(99, None), (100, "")]
    pats = ["a", "ab", "b c", "cab", "zz", "", "ab"]
    got = {(r.id, r.pattern) for r in phrases.occurrences(spark.createDataFrame(texts, "id int, t string"), "id", "t", spark.createDataFrame([(p,) for p in pats], "pattern string"), block).collect()}
    assert got == {(i, p) for i, t in texts for p in set(pats) - {""} if p in (t or "")}


def test_numbers_without_gaps(spark):
    rows = spark.range(997).selectExpr("(id * 7919) % 997 as v").repartition(5)
    assert {r.v: r.n for r in sizes.numbered(rows, "v", "n").collect()} == {i: i for i in range(997)}


def test_what_is_searched_for(spark):
    q = spark.createDataFrame([(1, "what is it", [("user", "waves"), ("system", "no"), ("assistant", " ")], ["  ", "Unit 1"], ""), (2, "plain", None, None, "a  b"), (3, "is this it", [], [], "x" * 900)], "qid int, query string, memory array<struct<role:string,content:string>>, context array<string>, selection string")
    got = {r.qid: (r.search, r.focused) for r in course.search_queries(q).collect()}
    assert got[1] == ("Unit 1 waves what is it", False) and got[2] == ("a b plain", True) and got[3] == ("x" * 600 + " is this it", True)
    assert course.search_queries(q.select("qid", "query")).filter("search <> query or focused").count() == 0


def test_prompt_has_what_was_said(spark):
    q = spark.createDataFrame([(1, "why", [("user", "waves")], ["Unit 1"], "marked")], "qid int, query string, memory array<struct<role:string,content:string>>, context array<string>, selection string")
    d = spark.createDataFrame([(1, "answerable", None)], "qid int, status string, temporal_year string")
    e = spark.createDataFrame([(1, 1, "T", "p.md", 0.9, "text")], "qid int, rank int, title string, file_path string, score double, content string")
    m = gate.prompts(q, d, e, "Hints only.").head().messages
    assert m[0].content.endswith("Hints only.") and all(x in m[1].content for x in ("why", "marked", "Unit 1", "user: waves", "[Source 1] T (p.md)"))


def test_streams_end_with_done_or_error(spark):
    p = spark.createDataFrame([(i, "answerable") for i in range(4)], "qid int, status string")
    r = spark.createDataFrame([(0, 1, "b", None), (0, 0, "a", None), (1, 0, "a", None), (1, 1, None, "429 too many"), (2, 0, "", None)], "qid int, n int, text string, error string")
    got = {}
    for x in gate.streamed(p, r).orderBy("qid", "seq").collect():
        got.setdefault(x.qid, []).append((x.event, x.text))
    assert got[0] == [("start", "answerable"), ("delta", "a"), ("delta", "b"), ("done", "")]
    assert got[1][1] == ("delta", "a") and got[1][2][0] == "error" and "quota" in got[1][2][1]
    assert [x[0] for x in got[2]] == [x[0] for x in got[3]] == ["start", "error"]


def test_tokens(spark):
    t = spark.createDataFrame([("a|b@x.org", 100)], "e string, until long").withColumn("t", privacy.token(b"key", F.col("e"), F.col("until")))
    who = lambda col, key=b"key", now=99: t.select(privacy.token_owner(key, col, F.lit(now)).alias("x")).head().x
    assert who(F.col("t")) == "a|b@x.org" and who(F.col("t"), now=100) is None and who(F.col("t"), key=b"no") is None
    assert who(F.replace(F.col("t"), F.lit("100"), F.lit("900"))) is None and who(F.lit("x")) is None


def test_a_bad_graph_replaces_nothing(spark, tmp_path, monkeypatch):
    (tmp_path / "notes/w1").mkdir(parents=True)
    (tmp_path / "notes/w1/a.md").write_text("# A\n\nForce and motion are here. A force is a push that changes the motion of a body in time.")
    tax = spark.createDataFrame([("force", "Force", "x", ["force"])], "id string, label string, category string, aliases array<string>")
    out = str(tmp_path / "out")
    b = course.build(spark, str(tmp_path / "notes"), tax, out=out)
    assert sorted(r.pos for r in b.chunks.collect()) == [0] and b.nodes.filter("id = 'keyword:force'").head().summary.startswith("A force is a push")
    assert course.doctor(b, questions=tax.limit(0)).select("problem").collect()[0].problem == "no test questions"
    assert course.extract_summary(b.chunks, b.warnings).head().files == 1
    before = b.edges.count()
    real = graph.build
    monkeypatch.setattr(graph, "build", lambda *a: (lambda n, e, p: (n, e.limit(0), p))(*real(*a)))
    with pytest.raises(ValueError):
        course.build(spark, str(tmp_path / "notes"), tax, out=out)
    assert spark.read.parquet(f"{out}/edges").count() == before > 0
    noted = []
    course.ask(b.chunks, spark.createDataFrame([(1, "what is a force")], "qid int, query string"), on_decision=lambda d: noted.append(d.count()))
    with pytest.warns(UserWarning):
        course.ask(b.chunks, spark.createDataFrame([(1, "what is a force")], "qid int, query string"), on_decision=lambda d: 1 / 0)
    assert noted == [1]


def test_stored_indices_give_the_same(spark, tmp_path):
    c = spark.createDataFrame([(str(i), t, "", "f.md", "m", False) for i, t in enumerate(["net force of motion", "energy and work", "the net force", "comparison of work"])], "id string, content string, title string, file_path string, module string, time_sensitive boolean")
    q = spark.createDataFrame([(1, "compare the net force"), (2, "work")], "qid int, query string")
    stored = search.hybrid(c, q, index=search.lexical_index(c).persist(str(tmp_path / "a")), vectors=search.tfidf_index(c).persist(str(tmp_path / "b")))
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, search.hybrid(c, q).collect()))


def test_chapters_shown(spark):
    c = spark.createDataFrame([(m,) for m in ["b", "a", "root", "z", "b", "h"]], "module string")
    settings = spark.createDataFrame([("z", 0, "Last first", "primary"), ("h", 1, "H", "hidden")], "module string, pos int, name string, show string")
    assert [(r.pos, r.module, r.name, r.chunks) for r in suggest.load_chapters(c, settings).orderBy("pos").collect()] == [(0, "z", "Last first", 1), (1, "a", "A", 1), (2, "b", "B", 2)]


def test_feedback_fields(spark):
    rows = spark.createDataFrame([(1, "s", "d", "t", "up", " a \n b ", "x\ny", "p" * 400), (2, "s", "d", "t", "sideways", "q", "", ""), (3, "s", "d", "t", "up", "  ", "", "")], "id int, sender string, day string, time string, rating string, question string, answer string, page string")
    r = sinks.accepted_feedback(rows).collect()
    assert len(r) == 1 and (r[0].question, r[0].answer, len(r[0].page)) == ("a b", "x\ny", 300)
    assert {x.id: x.reason for x in sinks.rejected_feedback(rows).collect()} == {2: "rating must be up or down", 3: "no question"}


def test_cache_of_vectors(spark, tmp_path):
    c = spark.createDataFrame([("a", "h1", "one two"), ("b", "h2", "three")], "id string, hash string, content string")
    asked = []

    def encode(df):
        asked.append(df.count())
        return df.select("id", "hash", F.array(F.length("content").cast("double")).alias("vector"))

    at = str(tmp_path / "v")
    incremental.refreshed(c.limit(1), at, encode)
    assert {r.id: list(r.vector) for r in incremental.refreshed(c, at, encode).collect()} == {"a": [7.0], "b": [5.0]} and asked == [1, 1]
    assert spark.read.parquet(at + ".bak").count() == 1


def test_long_reports_are_whole(spark, tmp_path):
    sinks.report(spark.range(12_000).selectExpr("id as n", "concat('line ', id) as line"), str(tmp_path / "r.md"))
    assert (tmp_path / "r.md").read_text().count("\n") == 12_000


def test_files_by_any_spelling(spark, tmp_path):
    for name in ("a.md", "b.TXT", "c.html"):
        (tmp_path / name).write_text("x")
    assert [r.file_path for r in files.discover(spark, str(tmp_path), suffixes=["md", ".txt"]).collect()] == ["a.md", "b.TXT"]
    (tmp_path / "r.csv").write_text("email\n" + "a@x.org\n" * 3 + "bad\n")
    assert [r.line for r in files.roster(spark, str(tmp_path / "r.csv"))[1].collect()] == [5]


def test_a_stream_reads_its_own_file(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00")], "event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
    for name in ("events.parquet", "events.parquet.bak"):
        rows.write.parquet(str(tmp_path / name))
    one = next((tmp_path / "events.parquet").glob("part-*"))
    for path in (tmp_path / "events.parquet", one):
        assert S.drained(S.source(spark, str(path)), "append").count() == 1


def test_pages_and_escapes(spark):
    row = spark.createDataFrame([('{"a": "</script>"}', "A < B", "a_b*")], "d string, t string, m string").select(sinks.single_page(F.col("d"), F.col("t"), "draw()").alias("p"), sinks.escaped_markdown(F.col("m")).alias("m")).head()
    assert row.p.count("</script>") == 2 and "A &lt; B" in row.p and row.m == r"a\_b\*"
    assert sinks.squeezed(b"x") == sinks.squeezed(b"x")
