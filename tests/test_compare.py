import io
import subprocess
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioflow.cli import main, options_of, parser
from folioflow.config import Options
from folioflow.kernels import prose as K
from folioflow.kernels.comparison import compare_sides, read_side
from folioflow.kernels.documents import read_docx, read_odt
from folioflow.kernels.redline import commented_docx
from folioflow.kernels.words import marked_html
from folioflow.operators import assess as A, compare as C, diff as D
from folioflow.sources import sinks
from folioflow.sources.files import describe_files, list_folder, read_folder
from folioflow.streaming.versions import watch


def test_word_files_with_comments_and_notes():
    old = commented_docx(["About the matter at hand here.", "See one[^1] and two[^2].", "[^1]: first note text", "[^2]: second note here"], [(0, 0, 5, "shared"), (1, 0, 3, "old only")])
    new = commented_docx(["About the matter at hand here.", "A new line was added here.", "See one[^2] and two[^1].", "[^2]: first note text", "[^1]: second note here"], [(0, 0, 5, "shared"), (1, 2, 5, "new only")])
    both = lambda **o: compare_sides(*(read_side("a.docx", x, Options(**o)) for x in (old, new)), Options(**o))
    rows, panel = both()
    assert [(r["kind"], r["left_label"], r["right_label"]) for r in rows] == [("equal", "1", "1"), ("insert", None, "2"), ("equal", "2", "3"), ("equal", "3", "4"), ("equal", "4", "5")]
    assert [(p["text"], p["status"], p["label"]) for p in panel] == [("shared", "unchanged", "1"), ("old only", "removed", "2"), ("new only", "new", "2")]
    assert {r["old_line"] for r in both(comments="none")[0]} == {"About the matter at hand here.", None, "See one[^1] and two[^2].", "[^1]: first note text", "[^2]: second note here"}
    text = [r["new_line"] for r in both(comments="text")[0]]
    assert text[0] == "{>>Assessment: shared<<}About the matter at hand here."


def test_markdown_notes_sentences_and_blank_lines():
    old = "One here. Two there.\n\n- Mr. Fox ran. He won.\n\nNote[^1].\n\n[^1]: what it says\n"
    new = "One here. Two was there.\n\n\n- Mr. Fox ran. He won.\n\nNote[^9].\n\n[^9]: what it  says\n"
    o = Options(by_sentence=True, language="en")
    rows, _ = compare_sides(read_side("x.md", old.encode(), o), read_side("x.md", new.encode(), o), o)
    assert [(r["kind"], r["left_label"], r["new_line"]) for r in rows][:4] == [("equal", "1.1", "One here."), ("replace", "1.2", "Two was there."), ("equal", "3.1", "- Mr. Fox ran."), ("equal", "3.2", "  He won.")]
    assert [r["kind"] for r in rows[4:]] == ["equal", "equal"] or rows[-1]["kind"] in ("replace", "equal")
    assert K.simple_sentences("Dr. No came. He left.", "en-GB") == ["Dr. No came.", "He left."] and K.simple_sentences("Dr. No came.", "xx") == ["Dr.", "No came."]
    assert K.simple_sentences("他来了。他走了。", "zh-Hant") == ["他来了。", "他走了。"]
    same = compare_sides(read_side("x.md", old.encode(), Options()), read_side("x.md", old.replace("[^1]", "[^4]").encode(), Options()), Options())[0]
    assert same == []


def test_formats_only():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'

    def docx(run: str) -> bytes:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>plain </w:t></w:r>{run}</w:p><w:p><w:r><w:t>stays</w:t></w:r></w:p></w:body></w:document>")
        return data.getvalue()

    a, b = docx("<w:r><w:t>word</w:t></w:r>"), docx("<w:r><w:rPr><w:b/></w:rPr><w:t>word</w:t></w:r>")
    rows, _ = compare_sides(read_side("a.docx", a, Options()), read_side("a.docx", b, Options()), Options())
    assert [(r["kind"], r["formats"]) for r in rows] == [("equal", ['made "word" bold']), ("equal", [])]


def test_paragraph_languages():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    lang = lambda x: f'<w:rPr><w:lang w:val="{x}"/></w:rPr>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:r><w:t>usual words</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="Sub"/></w:pPr><w:r><w:t>inherited</w:t></w:r></w:p><w:p><w:r>{lang("it")}<w:t>di</w:t></w:r><w:r>{lang("fr-FR")}<w:t>davantage</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles {w}><w:docDefaults><w:rPrDefault>{lang("en-GB")}</w:rPrDefault></w:docDefaults><w:style w:styleId="Base">{lang("de-DE")}</w:style><w:style w:styleId="Sub"><w:basedOn w:val="Base"/></w:style></w:styles>')
    assert [b.language for b in read_docx(data.getvalue()).blocks] == ["en-GB", "de-DE", "fr-FR"]
    ns = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:style="urn:oasis:names:tc:opendocument:xmlns:style:1.0" xmlns:fo="urn:oasis:names:tc:opendocument:xmlns:xsl-fo-compatible:1.0"'
    style = '<style:style style:name="S" style:family="text"><style:text-properties fo:language="de" fo:country="AT"/></style:style><style:default-style style:family="paragraph"><style:text-properties fo:language="en" fo:country="none"/></style:default-style>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("mimetype", "application/vnd.oasis.opendocument.text")
        z.writestr("content.xml", f'<office:document-content {ns}><office:automatic-styles>{style}</office:automatic-styles><office:body><office:text><text:p>usual</text:p><text:p>a <text:span text:style-name="S">besonders</text:span></text:p></office:text></office:body></office:document-content>')
    assert [b.language for b in read_odt(data.getvalue()).blocks] == ["en", "de-AT"]


def test_marked_html_and_balloons():
    assert marked_html("the colour <b>", "the color <b>") == ("the colo<del>u</del>r &lt;b&gt;", "the color &lt;b&gt;")
    assert marked_html(None, "a&b", "insert") == ("", "<ins>a&amp;b</ins>") and marked_html("x", "x", "equal") == ("x", "x")
    assert K.show_comments("a\ue000", [("Ann", "<why>", "2020-01-01")]) == 'a<span class="comment" title="Ann, 2020-01-01: &lt;why&gt;">&#128172;</span>'


def test_frames(spark, tmp_path):
    old = spark.createDataFrame([("a.md", bytearray(b"one\n\ntwo\n")), ("gone.txt", bytearray(b"x\n")), ("bad.docx", bytearray(b"no zip")), ("bin", bytearray(b"a\0b")), ("null", None)], "path string, content binary")
    new = spark.createDataFrame([("a.md", bytearray(b"one\n\nthree\n")), ("came.txt", bytearray(b"y")), ("bad.docx", bytearray(b"still none")), ("bin", bytearray(b"a\0c")), ("null", None)], "path string, content binary")
    done = C.compared(C.file_pairs(old, new)).cache()
    got = {r.pair_id: (r.change, len(r.rows), bool(r.error)) for r in done.collect()}
    assert got == {"a.md": ("modified", 2, False), "gone.txt": ("deleted", 1, False), "came.txt": ("added", 1, False), "bad.docx": ("modified", 0, True), "bin": ("modified", 0, True)}
    rows = C.rows_of(done)
    assert {r.pair_id: (r.additions, r.deletions) for r in D.counts(rows).collect()} == {"a.md": (1, 1), "gone.txt": (0, 1), "came.txt": (1, 0)}
    assert {(r.pair_id, r.changes, r.formatted) for r in D.change_counts(rows).collect()} == {("a.md", 1, 0), ("gone.txt", 1, 0), ("came.txt", 1, 0)}
    paths = [r.path for r in sinks.write_files(sinks.unified(rows, 1), str(tmp_path / "out"), "diff", ".diff").collect()]
    assert len(paths) == 3 and "-two" in (tmp_path / "out" / "a.md.diff").read_text()
    assert C.compared(C.file_pairs(old.limit(0), new.limit(0))).count() == 0
    texts = spark.createDataFrame([("k", "one\ntwo"), ("n", None)], "id string, text string")
    assert [(r.row_no, r.left_no, r.new_line) for r in C.single_rows(texts, "id", "text").orderBy("row_no").collect()] == [(1, None, "one"), (2, None, "two")]
    assert D.counts(D.diff_rows(C.review_edits(texts, "id", "text", F.regexp_replace("text", "two", "two more")))).first().edited_lines == 1


def test_results_are_handed_on_in_slices():
    files = pd.DataFrame([(str(k), "modified", f"{k}.txt", f"{k}.txt", b"one\n", b"two\n") for k in range(1000)], columns=["pair_id", "change", "old_path", "new_path", "old", "new"])
    got = [len(x) for x in C.compared_frames(iter([files]), Options())]
    assert max(got) <= 200 and sum(got) == 1000  # rows of all files of a batch together take a worker's memory


def test_panel_alone(spark, monkeypatch):
    texts = ["First line of it.", "A line that goes.", "Last line of it."]
    old, new = commented_docx(texts, [(0, 0, 5, "shared"), (1, 0, 6, "old only")]), commented_docx(texts[::2], [(0, 0, 5, "shared"), (1, 0, 4, "new only")])
    files = pd.DataFrame([("a", "modified", "a.docx", "a.docx", old, new), ("b", "added", None, "b.docx", None, new), ("c", "modified", "c.docx", "c.docx", b"no zip", new)], columns=["pair_id", "change", "old_path", "new_path", "old", "new"])
    whole, = C.compared_frames(iter([files]), Options())
    monkeypatch.setattr(C, "compare_sides", None)  # no line is aligned
    alone, = C.compared_frames(iter([files]), Options(), panel_only=True)
    assert [len(x) for x in alone["panel"]] == [3, 2, 0] and alone["panel"].equals(whole["panel"]) and alone["error"].equals(whole["error"]) and not any(alone["rows"])
    pairs = spark.createDataFrame(files, "pair_id string, change string, old_path string, new_path string, old binary, new binary")
    assert C.panel_of(C.compared(pairs, panel_only=True)).count() == 5


def test_folders_and_git(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "A.MD").write_text("one\n")
    (tmp_path / "d" / "b.txt").write_text("two\n")
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "first")
    (tmp_path / "d" / "b.txt").write_text("two\nthree\n")
    git("add", ".")
    assert {r.path for r in list_folder(spark, str(tmp_path)).collect()} == {"d/A.MD", "d/b.txt"}
    assert [r.path for r in read_folder(spark, str(tmp_path), "*.md").collect()] == ["d/A.MD"]
    assert [bytes(r.content) for r in read_folder(spark, str(tmp_path), paths=["d/b.txt"]).collect()] == [b"two\nthree\n"]
    assert {(r.name, r.kind, len(r.changed)) for r in describe_files(list_folder(spark, str(tmp_path))).collect()} == {("A.MD", "Markdown", 16), ("b.txt", "text", 16)}
    done = C.compared(C.file_pairs(C.read_git(spark, str(tmp_path)), C.read_git(spark, str(tmp_path), "INDEX")))
    assert [(r.pair_id, r.change, r.rows[-1].new_line) for r in done.collect()] == [("d/b.txt", "modified", "three")]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.md").write_text("one\n\ntwo words here\n")
    (tmp_path / "b.md").write_text("one\n\ntwo other words here\n")
    for how, want in (("unified", "+two other words here"), ("words", "two {+other +}words here"), ("counts", "edited_lines"), ("html", "<ins>other </ins>"), ("text", "two other words here"), ("panel", "status")):
        assert main([str(tmp_path / "a.md"), str(tmp_path / "b.md"), "--format", how]) == 0
        assert want in capsys.readouterr().out
    assert main(["review", str(tmp_path / "b.md"), "--format", "text"]) == 0 and "other" in capsys.readouterr().out
    assert main([str(tmp_path / "none"), str(tmp_path / "b.md")]) == 2
    assert main([str(tmp_path / "a.md"), str(tmp_path / "b.md"), "--similarity", "3"]) == 2
    o = options_of(parser().parse_args(["a", "b", "--split", "sentence", "--passage-min-words", "6", "--full"]))
    assert o.by_sentence and o.passages.min_words == 6 and o.context_for() == 10**9


def test_assessments_of_comparisons(spark):
    pairs = spark.createDataFrame([("p", ["one two"], ["one three"])], "pair_id string, old array<string>, new array<string>")
    rows = D.diff_rows(pairs)
    A.register_backend("echo", lambda prompt, model: f"{model}: {prompt}")
    (r,) = A.assess_comparison(rows, A.backend("echo:m")).collect()
    assert r.markdown.startswith("m: ") and "one [-two-]{+three+}" in r.markdown and "New version:\none three" in r.markdown and r.error is None
    with pytest.raises(ValueError):
        A.backend("none:x")
    texts = spark.createDataFrame([(1, "a bad word, a bad line", 0), (2, None, 0)], "key int, text string, fixes int")
    fixes = spark.createDataFrame([(1, "bad word", "good word"), (1, "word, a", "x"), (1, "missing", "y"), (2, "q", "r")], "key int, start string, replacement string")
    assert {(r.key, r.text) for r in A.apply_fixes(texts, fixes).collect()} == {(1, "a good word, a bad line"), (2, None)}


def test_stream(spark, tmp_path):
    src, got = tmp_path / "in", {}
    schema = "path string, version int, text string"

    def put(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / f"{n}"))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(src))
        q = watch(stream, str(tmp_path / "state"), lambda out, n: got.setdefault(n, {r.pair_id: (r.additions, r.deletions) for r in out.collect()}), str(tmp_path / "check"))
        q.processAllAvailable()
        q.stop()

    put(0, [("p", 1, "a\nb"), ("q", 1, "x")])
    run()
    put(1, [("p", 2, "a\nc")])
    run()
    put(2, [("q", 2, "x\ny"), ("p", 1, "late")])
    run()
    assert got == {0: {"p@1": (2, 0), "q@1": (1, 0)}, 1: {"p@2": (1, 1)}, 2: {"q@2": (1, 0)}}


def test_redline_inside_the_file():
    from folioflow.kernels.redline import Redline, check_redline

    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" mc:Ignorable="w14"'
    p = lambda *runs: "<w:p>" + "".join(f'<w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t xml:space="preserve">{t}</w:t></w:r>' for t, bold in runs) + "</w:p>"
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"

    def docx(*body: str) -> bytes:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("word/document.xml", f"<w:document {ns}><w:body>{''.join(body)}<w:sectPr/></w:body></w:document>")
            z.writestr("word/media/x.png", b"picture")
        return data.getvalue()

    old = docx(p(("It was a ", False), ("cold", True), (" day in the north.", False)), p(("This paragraph goes away.", False)), table, p(("The end of it all.", False)))
    new = docx(p(("It was a ", False), ("very cold", True), (" day in the north.", False)), table, p(("The end of it all.", False)), p(("Something new at last.", False)))
    r = Redline(old, new)
    data = r.write()
    assert check_redline(data, old, new) == [] and r.left == 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = z.read("word/document.xml").decode()
        assert z.read("word/media/x.png") == b"picture" and 'Ignorable="w14"' in xml and "xmlns:w14=" in xml
    assert '<w:rPr><w:b /></w:rPr><w:t xml:space="preserve">very ' in xml and xml.count("<w:ins ") == 3 and "<w:tbl>" in xml  # a word, a paragraph's run and its mark
    assert check_redline(new, old, new) == ["rejecting all changes does not give the old text"]


def test_sql_functions_and_measures(spark):
    from folioflow.config import MoveSettings
    from folioflow.functions.registry import register_functions, register_measure
    from folioflow.kernels.lines import MEASURES

    register_functions(spark, "t_")
    r = spark.sql("SELECT t_token_sort('a b c d', 'a b c e') AS s, t_word_line('the cat', 'the dog') AS w, t_token_sort(NULL, 'x') AS n").first()
    assert (r.s, r.w, r.n) == (0.75, "the [-cat-]{+dog+}", None)
    with pytest.raises(ValueError):
        MoveSettings(0.5, "own")
    register_measure("own", lambda a, b: float(a == b))
    assert MoveSettings(0.5, "own").algorithm == "own"
    del MEASURES["own"]


def test_files_never_broadcast(spark):
    from folioflow.operators.compare import file_pairs

    old = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "same")], "path string, content string")
    new = spark.createDataFrame([("a", "z"), ("d", "y"), ("c", "same")], "path string, content string")
    got = file_pairs(old, new)  # Spark takes contents made in Python for far smaller than they are
    assert sorted((r.pair_id, r.change) for r in got.collect()) == [("a", "modified"), ("d", "renamed")]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["redlined_files", "document_panel"])
def test_queries_of_files_never_broadcast(spark, tmp_path, name):
    from folioflow.plans.documents import QUERIES

    spark.createDataFrame([(1, "One line.\nAnother line."), (2, "A third.")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString() and got.count() > 1


def test_known_pairs_never_broadcast(spark, tmp_path):
    from folioflow.plans.revisions import known_pairs

    spark.createDataFrame([(1, "One line.\nAnother line."), (2, "A third.")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = known_pairs(spark, str(tmp_path))  # what the Word files are made of, ahead of a checkpoint
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.pair_id, len(r.old), len(r.new)) for r in got.collect()) == [(1, 2, 2), (2, 1, 1)]
