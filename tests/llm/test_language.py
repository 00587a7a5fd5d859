import pytest

from folioflow.llm.language import UNKNOWN, Centroids, base_language, language_segments, normal, segments, training_sentences
from folioflow.llm.sampling import sample_documents

TEXT = {
    "en": ["The committee restored the opening sentence", "A later comment moved the section on method", "The editor shortened two long sentences", "Nobody in the team kept the old heading", "The second reader questioned the list of sources"],
    "de": ["Der Ausschuss löschte die Schlussbemerkung", "Ein späterer Kommentar verschob den Abschnitt", "Die Lektorin kürzte zwei lange Sätze", "Unsere Arbeitsgruppe behielt die Überschrift", "Der zweite Gutachter prüfte das Verzeichnis"],
    "ru": ["Комитет восстановил первое предложение", "Более поздний комментарий удалил раздел", "Редактор сократил два длинных предложения", "Переводчик сохранил заголовок главы", "Издатель проверил список источников"],
    "ja": ["委員会は最初の文を元に戻した", "編集者は章の見出しを短くした", "翻訳者は脚注を削除した", "出版社は結びの一文を残した", "共著者は方法の節を移した"],
}


@pytest.fixture(scope="module")
def model():
    return Centroids.train({k: [normal(x) for x in v] * 4 for k, v in TEXT.items()})


def test_tags():
    assert [base_language(x) for x in ("de_CH", "EN", "x-none", None, "und", "deu-AT", " pt-BR ")] == ["de", "en", None, None, None, "de", "pt"]


def test_segments(model):
    text = "The editor kept the opening sentence. A later comment moved two long sentences. Die Lektorin verschob den zweiten Abschnitt. Der Ausschuss prüfte die Überschrift. 編集者は脚注を削除した。"
    (got,) = segments(model, [text])
    assert [x[2] for x in got] == ["en", "de", "ja"] and all(0 < x[3] <= 1 for x in got)
    assert text[got[1][0] : got[1][1]].startswith("Die") and got[-1][1] == len(text)
    assert segments(model, [None, "", "  ", "12 % | 3.4"]) == [[], [], [], []]
    (long,) = segments(model, ["THE COMMITTEE MOVED THE SECTION. " * 3000])
    assert [x[2] for x in long] == ["en"]


FOREIGN = [
    "Toimituskunta palautti ensimmäisen lauseen alkuperäiseen muotoonsa. Myöhempi kommentti siirsi menetelmää koskevan osan liitteeseen.",
    "A bizottság visszaállította az első mondatot az eredeti formájába. Senki sem tartotta meg a régi címet, ahogy volt.",
    "Ủy ban đã khôi phục câu đầu tiên về dạng ban đầu của nó. Không ai trong nhóm giữ tiêu đề cũ.",
    "הוועדה החזירה את המשפט הראשון לצורתו המקורית. איש בצוות לא שמר על הכותרת הישנה.",
    "sxqzj vkkw pprt qqzm wwxv jjkz ttrq zzkp vvqx kkrt",
]


def test_rejection(model):
    for text in FOREIGN:
        ((_, _, lang, confidence, distance),) = segments(model, [text])[0]
        assert lang == UNKNOWN and 0 < confidence <= 1 and distance > 0.7, text
    # a foreign sentence among others is a segment of its own
    (got,) = segments(model, ["The editor kept the opening sentence. " + FOREIGN[3] + " A later comment moved two long sentences."])
    assert got[0][2] == got[-1][2] == "en"


def test_sample_takes_few_sentences_a_text():
    long = ("en", ". ".join(f"the committee number {chr(97 + i)}{chr(97 + k)} kept this sentence" for i in range(20) for k in range(20)))
    other = [("en", f"A reader numbered {chr(97 + i)} questioned the heading of it.") for i in range(20)]
    got = training_sentences([long, *other, ("xx", None or ""), (None, "No mark here at all, really.")], most=50)
    assert set(got) == {"en", "xx"} and len(got["en"]) == 50 and sum("questioned" in x for x in got["en"]) == 20


def test_bounded_sample(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "'en' as lang", "concat('text ', id % 4000) as text", "1 as h")
    got = sample_documents(df, docs=300)
    assert 200 < len(got) <= 300 and len(set(got)) == len(got) and got == sample_documents(df, docs=300)
    assert sample_documents(df.limit(0)) == [] and len(sample_documents(df.limit(7))) <= 7


def test_held_out(model):
    for lang, t in (("en", "This paragraph confirmed the comparison of both versions"), ("de", "Der Übersetzer erwähnte den Vergleich beider Fassungen"), ("ru", "Второй рецензент заменил сравнение обеих версий")):
        assert segments(model, [t])[0][0][2] == lang


def test_frame(spark, model):
    df = spark.createDataFrame([(1, "The editor kept the heading.", "de", 9), (1, "The editor kept the heading.", "de", 9), (2, None, "de", 9), (3, "gone", None, 9)], "id bigint, text string, language string, marked int")
    got = language_segments(df, "id", model, lambda ts: [t == "gone" for t in ts]).collect()
    assert [(r.id, r.marked, r.lang) for r in got] == [(1, "de", "en")]
    assert language_segments(df.limit(0), "id", model).count() == 0


def test_blocks_by_the_model_of_all_documents(spark, tmp_path):
    from folioflow.llm.p3 import p3_segments

    odd = "Die Lektorin kürzte größere Übungen für das Buch.".encode().decode("cp1252")  # known, as it is in a document, though a long one
    docs = [(n, "de", f"{TEXT['de'][n % 5]} {n}.") for n in range(50)] + [(50, "de", f"{odd}\n" * 800)]
    spark.createDataFrame(docs, "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "p", odd, "de")], "block_id bigint, kind string, text string, language string").write.parquet(f"{tmp_path}/blocks.parquet")
    assert p3_segments(spark, str(tmp_path)).count() == 1
