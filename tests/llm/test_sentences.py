import itertools
import random
import time

import pytest

from folioflow.llm import sentences as S
from folioflow.llm.sentences import sentence_ends, sentence_spans, split_sentences

CASES = [
    ["“We keep it. It reads well,” said the note.", "The share rose from 3.16 to 12.75 per cent vs. the draft.", "Done"],
    ["12. See Fig. 3 and Sect. 4.2 for details, e.g. the old wording.[^5]", "Dr. K. and Prof. L. agreed!", "The U.S. edition keeps it."],
    ["[^44]: Did the editor (who read it twice!) accept change no. 4?", "Figures, notes, etc.", "The end…"],
    ["« Est-ce le texte ? » demanda la lectrice.", "(Le comité a gardé la note.)", "Quelle phrase !"],
    ["„Das bleibt. Es liest sich gut“, schrieb der Verlag.", "Am 3. März wurde Nr. 4 von Dr. K. geprüft.", "Im 19. Jh. schrieb man das anders!"],
    ["这是最后的版本吗？", "审稿人写道：“保留。读起来很好。”并签了字。", "译者删除了它！"],
    ["余白に「残す。読みやすい。」と書かれていた。", "編集者は残した。"],
    ["คณะกรรมการย้ายตารางผลลัพธ์ก่อนกำหนดส่ง", "สัดส่วนเพิ่มจาก 3.48 เป็น 12.75 เปอร์เซ็นต์", "ฉบับที่ 84 ยังไม่เสร็จ"],
    ["डॉ. के. ने पृष्ठ 4 पर अंतर देखा।", "क्या यह अंतिम पाठ है?", "समिति ने वाक्य रखा।"],
    ["Έγινε δεκτή η αλλαγή αρ. 9;", "Βλ. σ. 9 και εικ. 4.2, π.χ. την παλιά διατύπωση."],
    ["См. с. 3 и рис. 4.2, т. е. прежний вариант.", "Комитет сохранил и т. п. на с. 9."],
    ["este párrafo movió la tabla.", "el apéndice revisó la lista.[^3]", "la coautora restauró el título."],
]


@pytest.mark.parametrize("parts", CASES)
def test_cases(parts):
    glue = "" if parts[0][-1] in "。！？" else "  " if parts[0][-1] == "." else " "
    text = glue.join(parts)
    assert [text[a:b] for a, b in sentence_spans(text)] == parts


def test_edges():
    assert sentence_ends(None) == sentence_ends("") == sentence_ends("  \n ") == []
    assert sentence_ends("no end ") == [6]
    assert sentence_ends("...") == [3]
    long = "One sentence here. " * 20_000
    assert len(sentence_ends(long)) == 20_000


def test_frame(spark):
    df = spark.createDataFrame([(1, "All be. Dee fox.", 0), (1, "All be. Dee fox.", 0), (2, None, 0), (3, "x. Y.", 0)], "id bigint, text string, end_pos int")
    got = sorted(tuple(r) for r in split_sentences(df, "id", lambda ts: [t == "x. Y." for t in ts]).collect())
    assert got == [(1, 7), (1, 16)]
    assert split_sentences(df.limit(0), "id").count() == 0


def test_long_quotations_stay_whole():
    for k in (2, 5, 20, 50):
        for a, b in ("“”", "„“", "«»", "»«", "「」", "()", ("« ", " »"), '""'):
            q = a + " ".join(f"We keep part {i}." for i in range(k)) + b
            text = f"It came late. The note said {q} and was signed. Nobody answered."
            assert [text[x:y] for x, y in sentence_spans(text)] == ["It came late.", f"The note said {q} and was signed.", "Nobody answered."], (k, a)
    # marks without a partner join nothing
    text = "He wrote “keep it. Then he left. A 5\" nail (or so. It is fine. »That was all."
    assert len(sentence_spans(text)) == 5


def test_best_split_against_brute_force():
    r = random.Random(8)
    for _ in range(300):
        n = r.randint(1, 8)
        words = [r.choice(["a", "b" * r.randint(2, 40), "c" * r.randint(100, 3000)]) for _ in range(n)]
        starts, ends, at = [], [], 0
        for w in words:
            starts.append(at)
            ends.append(at + len(w))
            at += len(w) + 1
        text = " ".join(words)
        edge = [r.uniform(-3, 3) for _ in words[:-1]] + [0.0]

        def total(cuts):
            spans = list(zip([0, *(c + 1 for c in cuts[:-1])], cuts, strict=True))
            tiny = sum(ends[j] - starts[i] < 3 for i, j in spans)
            return sum(edge[j] + S._length_score(ends[j] - starts[i], 75.0) for i, j in spans) - S.TINY_COST * tiny

        best = max(total([*c, n - 1]) for k in range(n) for c in itertools.combinations(range(n - 1), k))
        assert total(S._best_spans(text, starts, ends, edge, 75.0)) == pytest.approx(best)


def test_linear_time():
    text = ("Before it “we keep it. It reads” wrote the reader. After it (maybe. Or not). e.g. this " * 3000)[:200_000]
    t = time.perf_counter()
    assert len(sentence_ends(text)) > 2000
    assert time.perf_counter() - t < 2


def test_blocks_by_the_model_of_all_documents(spark, tmp_path):
    from folioflow.llm.p4 import p4_found

    odd = "Es heißt: für größere Übungen.".encode().decode("cp1252") + " Noch ein Satz.\n"  # known, as it is in a document, though a long one
    docs = [(n, "de", f"Ein Satz, die Nummer {n}.") for n in range(50)] + [(50, "de", odd * 800)]
    spark.createDataFrame(docs, "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "p", odd.strip())], "block_id bigint, kind string, text string").write.parquet(f"{tmp_path}/blocks.parquet")
    assert p4_found(spark, str(tmp_path)).count() == 2
