import random
from collections import Counter

import pytest

from folioflow.llm.language import Centroids, normal
from folioflow.llm.pairs import DEFECTS, defects, em_posteriors, endings, instruction, label_pairs, last_words, sentences, validated_cutoffs, votes_echo, votes_empty, votes_refusal, votes_truncated

EN = ["The committee restored the opening sentence.", "A later comment moved the section on method.", "The editor shortened two long sentences.", "Nobody in the team kept the old heading.", "The second reader questioned the list of sources.", "The changes are small but useful.", "Most edits are cosmetic and help the text.", "This paragraph confirmed the comparison of both versions."]
DE = ["Der Ausschuss löschte die Schlussbemerkung.", "Ein späterer Kommentar verschob den Abschnitt über die Methode.", "Die Lektorin kürzte zwei lange Sätze.", "Unsere Arbeitsgruppe behielt die Überschrift des Kapitels.", "Der zweite Gutachter prüfte das Quellenverzeichnis.", "Die Änderungen sind klein, aber nützlich.", "Insgesamt hilft die Überarbeitung dem Text.", "Dieser Absatz bestätigte den Vergleich beider Fassungen."]


@pytest.fixture(scope="module")
def model():
    return Centroids.train({"en": [normal(x) for x in EN] * 3, "de": [normal(x) for x in DE] * 3})


def test_em_recovers():
    r = random.Random(1)
    rates = [(0.9, 0.05), (0.8, 0.1), (0.7, 0.02)]
    patterns, truth = Counter(), {}
    for _ in range(20_000):
        y = r.random() < 0.15
        p = "".join("?" if r.random() < 0.2 else "1" if r.random() < (a if y else b) else "0" for a, b in rates)
        patterns[p] += 1
        truth.setdefault(p, []).append(y)
    post = em_posteriors(patterns)
    wrong = sum(sum(y != (post[p] > 0.5) for y in ys) for p, ys in truth.items())
    assert wrong / 20_000 < 0.05
    assert em_posteriors(Counter()) == {} and em_posteriors(Counter({"000": 5})) == {"000": 0.0}


def test_functions():
    ends = set(endings(sentences(" ".join(EN))))
    known = lambda t: last_words(t) in ends
    assert known("x lengthened two long sentences.") and not known("The editor shortened two") and last_words("") == ""
    assert votes_empty("​", "")[0] == 1 and votes_empty("null", "null")[1] == 1 and 1 not in votes_empty("No changes needed.", "No changes needed.")
    assert votes_truncated("The editor shortened two", None, "", known("The editor shortened two"))[1:3] == [1, 1]
    assert 1 not in votes_truncated("- one\n- The editor shortened two long sentences", None, "", known("- one\n- The editor shortened two long sentences"))
    assert votes_truncated('Fine.\n\n```json\n[{"side": "old"', None, "", known('Fine.\n\n```json\n[{"side": "old"'))[0] == 1
    assert votes_truncated("The editor", "The editor shortened it.", "", False)[4] == 1
    assert votes_refusal("I’m sorry, but I can’t help with that.")[:2] == [1, 1]
    assert 1 not in votes_refusal("I’m sorry to see the old example go, but the text is clearer. The editor kept the heading.")
    prompt = "Assess the text below.\n\nThe committee restored the opening sentence of it."
    assert votes_echo("The committee restored the opening sentence of it.", prompt)[:2] == [1, 1]
    assert 1 not in votes_echo("Most edits are cosmetic and they help, I think so.", prompt)
    assert instruction("Assess this. (Answer in Dutch.)\n\ntext") == ("Assess this.", "nl") and instruction("") == ("", None)


def test_cutoffs_on_known_defects(spark, model):
    r = random.Random(4)
    rows, truth = [], {}
    for n in range(600):
        lang, own, other = ("en", EN, DE) if r.random() < 0.6 else ("de", DE, EN)
        ask = "Assess the changes below: do they improve the text?" if lang == "en" else "Beurteile die folgenden Änderungen: Verbessern sie den Text?"
        text = " ".join(r.sample(own, 2))
        answer = " ".join(r.sample(own, 4))
        d = r.choice([None] * 6 + list(DEFECTS))
        if d == "empty":
            answer = r.choice(["", "null", "-", "  "])
        elif d == "echo":
            answer = r.choice([text, f"{ask}\n\n{text}"])
        elif d == "refusal":
            answer = "I’m sorry, but I can’t help with that." if lang == "en" else "Diese Anfrage kann ich leider nicht bearbeiten."
        elif d == "truncated":
            answer = answer[: -r.randint(6, 14)]
        elif d == "language":
            answer = " ".join(r.sample(other, 4))
        truth[n] = d
        rows.append((n, f"{ask}\n\n{text}", answer, None, answer if r.random() < 0.4 and d != "truncated" else None, 1))
    rows += [(9000, None, None, None, None, 1), (9001, "x", "y " * 30_000, "", "", 1)]
    df = spark.createDataFrame(rows, "assess_id bigint, prompt string, markdown string, error string, live_answer string, posterior int")
    labelled, cutoffs = label_pairs(df, model)
    assert set(cutoffs) == set(DEFECTS) and all(0 < c < 1 for c in cutoffs.values())
    out = defects(labelled, cutoffs).where("rank = 1 and answer_field = 'markdown'").collect()
    got = {x.assess_id: x.defect for x in out}
    wrong = [n for n, d in truth.items() if got.get(n) != d]
    assert len(wrong) / len(truth) < 0.06 and got[9000] == "empty"
    labelled, cutoffs = label_pairs(df.limit(0), model)
    assert labelled.count() == 0 and set(cutoffs.values()) == {0.5}


def test_cutoffs_and_ranks(spark):
    known = [("echo", {"echo": 0.62}), ("echo", {"echo": 0.9}), (None, {"echo": 0.41}), (None, {})]
    assert 0.41 < validated_cutoffs(known)["echo"] <= 0.62 and validated_cutoffs(known)["empty"] == validated_cutoffs([])["echo"] == 0.5
    d = spark.createDataFrame([(1, "markdown", {"empty": 0.55, "truncated": 0.99}), (2, "markdown", {"empty": 0.93, "truncated": 0.99}), (3, "markdown", {"language": 0.2})], "assess_id bigint, answer_field string, posteriors map<string,double>")
    got = sorted((r.assess_id, r["rank"], r.defect) for r in defects(d, dict.fromkeys(DEFECTS, 0.5)).collect())
    assert got == [(1, 1, "truncated"), (1, 2, "empty"), (2, 1, "empty"), (2, 2, "truncated")]


def test_cutoffs_count_all_sound_answers(spark, model, monkeypatch):
    from folioflow.llm import pairs

    seen = []
    monkeypatch.setattr(pairs, "validated_cutoffs", lambda known, counts=None: seen.append((known, counts)) or {d: 0.5 for d in DEFECTS})
    ask = "Assess the changes below: do they improve the text?"
    rows = [(n, f"{ask}\n\n{' '.join(EN[k % 8] for k in (n, n + 1))}", " ".join(EN[k % 8] for k in range(n + 2, n + 6)), None, None) for n in range(500)]
    pairs.label_pairs(spark.createDataFrame(rows, "assess_id bigint, prompt string, markdown string, error string, live_answer string"), model)
    ((known, counts),) = seen
    assert sum(c for (d, _), c in zip(known, counts, strict=True) if d is None) == 500  # about 150 of them before
    made = pairs.spoil([{"assess_id": k, "prompt": "p", "answer": f"{x} {k} a b c", "lang": x} for k, x in enumerate(["en", "en", "de", "en"])])
    assert [a[2][:4] for d, a in made if d == "language"] == ["de 2", "de 2", "en 3", "de 2"]
