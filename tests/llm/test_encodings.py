import pytest

from folioflow.llm import encodings as E
from folioflow.llm.encodings import LOST, CleanModel, find_garbled, label, restore

CLEAN = [
    "The café kept the reader’s objection – see the “old” file… naïve façade.",
    "Der Übersetzer prüfte zwei lange Sätze für die gedruckte Ausgabe und löschte die Überschrift.",
    "Współautorka przeniosła część o metodzie na prośbę wydawcy, żeby skrócić dłuższe zdania.",
    "Редактор восстановил раздел о методе по просьбе издательства и сократил первое предложение.",
    "委员会在截止日期之前保留了结尾的评论。",
    "O tradutor completou a legenda da figura e não aceitou a secção. A REDAÇÃO FICOU.",
] * 30


@pytest.fixture(scope="module")
def model():
    return CleanModel.train(CLEAN)


def garble(t, right, wrong, n=1):
    for _ in range(n):
        t = "".join(chr(b) if wrong == "latin-1" else bytes([b]).decode(wrong, "replace") for b in t.encode(right))
    return t


@pytest.mark.parametrize(("i", "right", "wrong", "n"), [(0, "utf-8", "latin-1", 1), (1, "utf-8", "cp437", 1), (2, "utf-8", "latin-1", 2), (3, "cp1251", "latin-1", 1), (4, "utf-8", "latin-1", 1), (1, "cp1252", "cp850", 1), (5, "utf-8", "mac-roman", 1)])
def test_round_trip(model, i, right, wrong, n):
    bad = garble(CLEAN[i], right, wrong, n)
    (states,) = label(model, [bad])
    assert states is not None and restore(bad, states) == CLEAN[i]


def test_part_only(model):
    t = CLEAN[1] + " " + garble("für", "utf-8", "latin-1") + " " + CLEAN[1]
    assert restore(t, label(model, [t])[0]) == CLEAN[1] + " für " + CLEAN[1]


def test_clean_and_edges(model):
    texts = [*CLEAN[:6], None, "", "plain ascii", "x" * 100_000, "3 × 4 ± 5 º", chr(LOST)]
    got = label(model, texts)
    assert [g is None for g in got] == [True] * 11 + [False]


def test_frame(spark, model):
    rows = [("block", 1, garble(CLEAN[1], "utf-8", "latin-1"), "q"), ("block", 1, garble(CLEAN[1], "utf-8", "latin-1"), "q"), ("block", 2, CLEAN[1], "q"), ("comment_mark", 1, None, "q")]
    df = spark.createDataFrame(rows, "record_kind string, record_id bigint, text string, states string")
    got = find_garbled(df, model).collect()
    assert [(r.record_kind, r.record_id, r.restored) for r in got] == [("block", 1, CLEAN[1])]
    assert find_garbled(df.limit(0), model).count() == 0


def test_windows_label_like_the_whole(monkeypatch):
    texts = ["Die Überprüfung der Änderungen hält an. " * 5, "Größe und Maß der Übung bleiben gleich."]
    model = E.CleanModel.train(texts * 3)
    text = "".join(("Die Überprüfung der Änderungen hält an. ".encode().decode("cp1252") if k % 7 == 3 else "Größe und Maß der Übung bleiben gleich. ") for k in range(200))
    (whole,) = E.label(model, [text])
    monkeypatch.setattr(E, "WINDOW", 700)
    monkeypatch.setattr(E, "OVERLAP", 100)
    (parts,) = E.label(model, [text])
    assert whole.any() and restore(text, whole) == restore(text, parts) and ((whole > 0) == (parts > 0)).mean() > 0.98


def test_model_of_all_documents(spark, tmp_path):
    from folioflow.llm.p5 import clean_model

    rows = [(n, "en", f"plain text number {n}") for n in range(9000)] + [(9000, "en", None), (9001, "en", ""), (9002, "sv", "håll " * 5000 + "ÿþß")]
    spark.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got, want = clean_model(spark, str(tmp_path)), CleanModel.train([t for _, _, t in rows if t is not None])
    assert all((getattr(got, k) == getattr(want, k)).all() for k in ("triples", "p3", "pairs", "p2", "chars", "p1"))
    assert not len(got.strange(E.codepoints("ÿþß")))  # one of 9003 rows, and a long one
    assert label(E.clean_model(spark.createDataFrame([], "text string")), ["für"])[0] is None
