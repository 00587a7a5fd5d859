import subprocess

from pyspark.sql import functions as F

from folioflow.config import Options
from folioflow.functions import text as X
from folioflow.kernels.lines import token_similarity, token_sort
from folioflow.operators import diff as D
from folioflow.operators.assess import assess, prompt
from folioflow.operators.folders import compare_folders, fingerprints_changed
from folioflow.operators.similarity import mutual_best, rare_word_candidates, similar_lines
from folioflow.plans.revisions import ordered_similarity, token_similarities
from folioflow.plans.versions import closest_earlier
from folioflow.sources import sinks
from folioflow.sources.files import decode_text, read_documents, read_folder, read_texts, run_filter
from folioflow.streaming.versions import compare_batch


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    for t, want in (("a\nb\n", ["a", "b"]), ("a\r\nb", ["a", "b"]), ("", []), ("a\x0cb", ["a\x0cb"]), ("\n", [""])):
        assert one(spark, X.split_lines(F.col("t")), t=t) == want
    assert one(spark, X.tokens(F.col("t")), t="The ﬁne café, x_1!  ") == ["The", " ", "ﬁne", " ", "café", ",", " ", "x_1", "!", "  "]
    assert one(spark, X.move_key(F.col("t")), t="too short to move x") is None
    assert one(spark, X.escape_html(F.col("t")), t="<a & 'b'>") == "&lt;a &amp; &#39;b&#39;&gt;"
    assert one(spark, X.describe(F.col("a"), F.col("b")), a="x", b="") == 'removed "x"'
    assert one(spark, X.cut(F.col("t"), 5), t="ab\ncdefgh") == "ab\n[7 more characters of the text left out]"
    assert one(spark, X.included(F.col("t"), "*.md|A/*.txt"), t="x/y.MD") and not one(spark, X.included(F.col("t"), "*.md|A/*.txt"), t="b/y.txt")
    assert one(spark, X.ordered_similarity(F.split("a", " "), F.split("b", " ")), a="a b c d", b="a c d e") == token_similarity("a b c d".split(), "a c d e".split())


def test_folders(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", None)], "path string, content string")
    new = spark.createDataFrame([("a", "1"), ("b", "x"), ("e", "3"), ("d", "")], "path string, content string")
    assert {tuple(r) for r in compare_folders(old, new).collect()} == {("modified", "b", "b"), ("renamed", "c", "e")}
    assert {tuple(r) for r in compare_folders(old, new, renames=False).collect()} == {("modified", "b", "b"), ("deleted", "c", None), ("added", None, "e")}
    assert [r.path for r in fingerprints_changed(old, new).orderBy("path").collect()] == ["b", "c"]
    assert compare_folders(old.limit(0), new.limit(0)).count() == 0


def test_similar_lines_brute_force(spark):
    import itertools
    import random

    r = random.Random(2)
    vocabulary = [f"t{i}" for i in range(12)]
    make = lambda n, k: [(g, i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 9))), "z") for g in range(n) for i in range(k)]
    a, b = make(3, 14), make(3, 14)
    old = spark.createDataFrame(a, "g int, i bigint, line string, counts string")
    new = spark.createDataFrame(b, "g int, j bigint, line string, counts string")
    for t in (0.5, 0.7, 1.0):
        got = {(x.g, x.i, x.j): round(x.score, 9) for x in similar_lines(old, new, "g", t).collect()}
        want = {(x[0], x[1], y[1]): round(s, 9) for x, y in itertools.product(a, b) if x[0] == y[0] and x[2] and y[2] and (s := token_sort(x[2].split(), y[2].split())) >= t - 1e-9}
        assert got == want
    pairs = similar_lines(old, new, "g", 0.5)
    got = {(x.g, x.i, x.j) for x in mutual_best(pairs, "g").collect()}
    taken, want = set(), set()
    for x in sorted(pairs.collect(), key=lambda x: (-x.score, x.i, x.j)):
        if ("i", x.g, x.i) not in taken and ("j", x.g, x.j) not in taken:
            taken |= {("i", x.g, x.i), ("j", x.g, x.j)}
            want.add((x.g, x.i, x.j))
    assert got == want
    assert similar_lines(old.limit(0), new, "g", 0.5).count() == 0
    words = lambda d, k: d.select("g", k, F.split("line", " ").alias("words"))
    c = rare_word_candidates(words(old, "i"), words(new, "j"), "g", rare_min=3, rare_share=0.0, most=5)
    assert c.groupBy("g").count().agg(F.max("count")).first()[0] <= 5


def test_diff_frames(spark, tmp_path):
    old = spark.createDataFrame([("a", "one\ntwo\nthree\n"), ("gone", "x\n"), ("same", "s"), ("empty", ""), ("null", None)], "path string, text string")
    new = spark.createDataFrame([("a", "one\n2 two\nthree\nfour\n"), ("came", "y"), ("same", "s"), ("empty", "now"), ("null", None)], "path string, text string")
    rows = D.diff_rows(D.text_pairs(old, new, "path", "text"))
    c = {r.pair_id: r for r in D.counts(rows).collect()}
    assert set(c) == {"a", "gone", "came", "empty"} and (c["a"].additions, c["a"].deletions, c["gone"].deletions) == (2, 1, 1)
    assert {r.pair_id: r.text for r in sinks.new_version(rows).collect()}["a"] == "one\n2 two\nthree\nfour"
    diff = {r.pair_id: r["diff"] for r in sinks.unified(rows, 1).collect()}["a"]
    (tmp_path / "a").write_text("one\ntwo\nthree\n")
    (tmp_path / "p").write_text(f"--- a/a\n+++ b/a\n{diff}\n")
    if subprocess.run(["git", "apply", "p"], cwd=tmp_path, capture_output=True).returncode == 0:
        assert (tmp_path / "a").read_text() == "one\n2 two\nthree\nfour\n"
    words = {(r.pair_id, r.row_no): r.text for r in D.word_lines(rows).collect()}
    assert "{+2 +}two" in words["a", 2]
    html = sinks.html_report(D.folded(rows, 1)).where("pair_id = 'a'").first()["html"]
    assert "<td><ins>four</ins></td>" in html and "<details>" not in html
    assert D.word_changes(rows).where("pair_id = 'a' and tag = 'insert'").count() == 1
    assert D.diff_rows(D.text_pairs(old.limit(0), new.limit(0), "path", "text"), Options(move_passages=False)).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_bytes("déjà vu – “où”".encode("cp1252"))
    (tmp_path / "d" / "~$a.md").write_bytes(b"lock")
    (tmp_path / "b.txt").write_bytes(b"x\0y")
    (tmp_path / "bad.docx").write_bytes(b"nothing")
    f = read_folder(spark, str(tmp_path))
    got = {r.path: (r.text, r.read_as, r.binary) for r in read_texts(f).collect()}
    assert got == {"d/a.md": ("déjà vu – “où”", "cp1252", False), "b.txt": (None, None, True), "bad.docx": ("nothing", "utf-8", False)}
    assert [r.path for r in read_folder(spark, str(tmp_path), "*.md").collect()] == ["d/a.md"]
    (bad,) = read_documents(f).collect()
    assert bad.path == "bad.docx" and bad.error and bad.text is None
    for t, e in (("zażółć gęślą jaźń", "cp1250"), ("Съешь ещё этих мягких булок", "cp1251"), ("Ξεσκεπάζω την ψυχοφθόρα", "cp1253"), ("çok ışıklı değişim şu", "cp1254"), ("x", "utf-16")):
        assert decode_text(t.encode(e)) == (t, e)
    texts = spark.createDataFrame([("a", "b\na\n")], "path string, text string")
    assert run_filter(texts, "sort").first()["text"] == "a\nb\n"
    assert run_filter(texts, "exit 3").first()["error"] == "exit status 3"


def test_assess(spark):
    d = spark.createDataFrame([(1, "value", "s", "text"), (2, "?", "s", "boom")], "id int, kind string, subject string, text string")
    p = d.select("id", prompt(F.col("kind"), F.col("subject"), F.col("text")).alias("prompt"))

    def runner(text):
        if "boom" in text:
            raise RuntimeError("failed")
        return "## Verdict\n\nimproves"

    got = {r.id: (r.markdown, r.error) for r in assess(p, runner).collect()}
    assert got == {1: ("## Verdict\n\nimproves", None), 2: (None, "failed")}


def test_stream_batches(spark):
    b1 = spark.createDataFrame([("p", 1, "a\nb"), ("p", 2, "a\nc")], "path string, version int, text string")
    out, kept = compare_batch(b1, None)
    assert {r.pair_id: (r.additions, r.deletions) for r in out.collect()} == {"p@1": (2, 0), "p@2": (1, 1)}
    b2 = spark.createDataFrame([("p", 1, "late"), ("p", 3, "a\nc\nd"), ("q", 1, None)], "path string, version int, text string")
    out, kept = compare_batch(b2, kept)
    assert {r.pair_id: (r.additions, r.deletions) for r in out.collect()} == {"p@3": (1, 0)}
    assert {(r.path, r.version) for r in kept.collect()} == {("p", 3), ("q", 1)}


def test_running(spark):
    import random

    from folioflow.session import running

    r = random.Random(6)
    rows = [(None if r.random() < 0.1 else r.choice("aaaab"), i, r.randint(0, 9)) for i in range(400)]
    d = spark.createDataFrame(rows, "k string, o int, v int").repartition(3)
    got = {x.o: (x.n, x.s) for x in running(d, "k", [F.col("o")], {"n": F.lit(1), "s": F.col("v")}).collect()}
    assert got == {o: (sum(k2 == k and o2 < o for k2, o2, _ in rows), sum(v2 for k2, o2, v2 in rows if k2 == k and o2 < o)) for k, o, _ in rows}


def test_closest_earlier(spark):
    import random

    r = random.Random(4)
    docs = {i: {"all"} if i < 30 else set() for i in range(90)}
    for i in range(30, 90):
        docs[i] = {f"k{r.randint(0, 4)}" for _ in range(r.randint(0, 3))} | {f"own{i // 3}" for _ in range(r.randint(0, 1))}
    want = {}
    for i, a in docs.items():
        s, m = max(((len(a & docs[j]), -j) for j in range(i)), default=(0, 0))
        if s:
            want[i] = (-m, s)
    assert all(want[i] == (0, 1) for i in range(1, 30))  # 30 copies of one line
    d = spark.createDataFrame([(i, k) for i, a in docs.items() for k in a], "doc_id bigint, key string")
    for common in (20, 3, 1):
        assert {x.new_id: (x.old_id, x.shared) for x in closest_earlier(d, common).collect()} == want


def test_ordered_similarity(spark, tmp_path):
    import random

    r = random.Random(5)
    make = lambda: [r.choice("abcd") for _ in range(r.randint(0, 80))]
    rows = [(i, make(), make()) for i in range(60)] + [(60, [], [])]

    def brute(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return 2 * best[-1][-1] / (len(a) + len(b)) if a or b else 1.0

    d = spark.createDataFrame(rows, "k bigint, a array<string>, b array<string>")
    assert {x.k: x.similarity for x in token_similarities(d, ["k"]).collect()} == {k: brute(a, b) for k, a, b in rows}
    long = " ".join(f"w{i}" for i in range(500))
    spark.createDataFrame([(1, f"x\ny\n{long}"), (2, "x\ny\nz")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {x.doc_id: x.similarity for x in ordered_similarity(spark, str(tmp_path)).collect()} == {1: round(1000 / 1003, 6), 2: 0.4}


def test_mutual_best_is_complete(spark):
    rows = [(g, i, j, 0.9 if g else 1.0) for g in (0, 1) for i in range(70) for j in range(70)] + [(1, 0, 5, 0.95)]
    d = spark.createDataFrame(rows, "g int, i bigint, j bigint, score double")
    got = {(x.g, x.i, x.j) for x in mutual_best(d, "g").collect()}
    left = [j for j in range(70) if j != 5]
    assert got == {(0, k, k) for k in range(70)} | {(1, 0, 5)} | {(1, i, left[i - 1]) for i in range(1, 70)}


def test_prompts_hold_whole_texts(spark, tmp_path):
    from folioflow.plans.prose import prompt_cut
    from folioflow.plans.review import prompt_parts

    texts = {1: "a line\n" * 6000 + "end", 2: "short", 3: "x" * 300_001}
    spark.createDataFrame([(k, t, "p", "s") for k, t in texts.items()], "doc_id bigint, text string, project string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.prompt for r in prompt_parts(spark, str(tmp_path)).collect()}
    head = "Assess the text below.\n\nSubject: p/s\n\n"
    assert got[1] == head + texts[1] and got[2] == head + "short"
    assert got[3] == head + "x" * 300_000 + "\n[1 more characters of the document left out]"
    assert {r.doc_id: r.cut for r in prompt_cut(spark, str(tmp_path)).collect()}[1] == texts[1]
    cut = spark.createDataFrame([("ab\ncdefgh",)], "t string").select(prompt(F.lit("?"), F.lit("s"), F.col("t"), limit=5).alias("x")).first()["x"]
    assert cut.endswith("\n\nab\n[7 more characters of the document left out]")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_similar_lines_never_broadcast(spark):
    old = spark.createDataFrame([(1, 0, "a b c d e")], "g int, i bigint, line string")
    new = spark.createDataFrame([(1, 0, "a b c d f")], "g int, j bigint, line string")
    got = similar_lines(old, new, "g", 0.7)  # estimates of exploded tokens are far too low
    assert got.count() == 1 and "Broadcast" not in plan_of(got)


def test_similar_lines_joins_tokens_of_both_sides_only(spark, monkeypatch):
    import itertools
    import random

    from folioflow.operators import similarity

    frames = []
    monkeypatch.setattr(similarity, "cut_lineage", lambda d: frames.append(d) or d)
    r = random.Random(5)
    lines = [(k % 2, k, " ".join(r.choice([f"t{i}" for i in range(14)]) for _ in range(r.randint(0, 12))) + f" own{k}") for k in range(60)]
    a, b = lines[:30], lines[30:]
    old, new = spark.createDataFrame(a, "g int, i bigint, line string"), spark.createDataFrame(b, "g int, j bigint, line string")
    want = {(x[0], x[1], y[1]): round(s, 9) for x, y in itertools.product(a, b) if x[0] == y[0] and (s := token_sort(x[2].split(), y[2].split())) >= 0.6 - 1e-9}
    found = lambda: {(x.g, x.i, x.j): round(x.score, 9) for x in similar_lines(old, new, "g", 0.6).collect()}
    assert want and found() == want
    prefix = frames[1]
    assert "Join" not in plan_of(prefix)  # tokens are shuffled once to be counted, not joined with their counts
    both = frames[0].select("g", "side", F.explode("t").alias("t")).groupBy("g", F.xxhash64("t").alias("token")).agg(F.countDistinct("side").alias("n")).where("n = 2")
    assert prefix.count() and prefix.join(both, ["g", "token"], "left_anti").count() == 0
    monkeypatch.setattr(F, "xxhash64", lambda c: F.pmod(F.hash(c), F.lit(5)))  # nearly all tokens meet under one hash
    assert found() == want


def test_moved_lines_matched_never_broadcasts(spark, tmp_path):
    from folioflow.plans.revisions import moved_lines_matched

    spark.createDataFrame([(1, "One line of some length here.\nAnother line of some length.\nA last one of some length.")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = moved_lines_matched(spark, str(tmp_path))
    assert "Broadcast" not in plan_of(got) and [(r.i, r.j, r.score) for r in got.collect()] == [(0, 2, 1.0)]


def test_known_rows_never_broadcast(spark, tmp_path):
    from folioflow.plans.revisions import known_rows

    spark.createDataFrame([(1, "One line of some length here.\nAnother line of some length.")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = known_rows(spark, str(tmp_path))  # what moved_lines_matched reads ahead of its first checkpoint
    assert "Broadcast" not in plan_of(got) and [r.kind for r in got.orderBy("row_no").collect()] == ["moved-out", "equal", "moved-in"]
