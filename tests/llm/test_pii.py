import itertools

import numpy as np
import pytest

from folioflow.llm.pii import LABELS, Field, find, particulars, redact, redacted, tokenize, train
from folioflow.llm.pii_table import rows


@pytest.fixture(scope="module")
def field():
    return train(rounds=60)


def test_held_out(field):
    table = rows(seed=77, times=1)
    got = find(field, [t for t, _ in table])
    right = sum(len(set(a) & set(b)) for (_, a), b in zip(table, got, strict=True))
    assert right / sum(len(a) for _, a in table) > 0.85 and right / sum(map(len, got)) > 0.9


def test_names_and_towns_never_seen(field, monkeypatch):
    """Recall on given names, streets and towns that the training table does not hold."""
    from folioflow.llm import pii_table as T

    known = {*T.GIVEN, *T.TOWNS, *T.PLACES, *T.STREETS}
    given, towns, places = ["Bartholomew", "Clementine", "Radoslav", "Xiomara", "Thaddeus", "Philippa"], ["Wexbridge", "Sandoval", "Quimperlé", "Altenkirchen"], ["Juniper", "Barley", "Foundry"]
    assert not known & {*given, *towns, *places}
    monkeypatch.setattr(T, "_given", lambda r: r.choice(given))
    monkeypatch.setattr(T, "_town", lambda r: r.choice(towns))
    monkeypatch.setattr(T, "_place", lambda r: r.choice(places))
    table = T.rows(seed=5, times=1)
    got = find(field, [t for t, _ in table])
    for kind in ("name", "address"):
        want = [(n, x) for n, (_, spans) in enumerate(table) for x in spans if x[2] == kind]
        assert sum(x in got[n] for n, x in want) / len(want) > 0.8, kind


def test_examples(field):
    text = "Send corrections to anna.berg@post.example before Friday.\nPhone +44 1632 960 573 (mornings only).\nISBN 979-0-99-541482-3.\n"
    (got,) = find(field, [text])
    assert {(k, text[a:b]) for a, b, k in got} == {("email", "anna.berg@post.example"), ("phone", "+44 1632 960 573")}
    assert redact(text, got).startswith("Send corrections to [EMAIL] before Friday.\nPhone [PHONE] (")
    assert find(field, [None, "", "  ", "x" * 50_000]) == [[], [], [], []]


def test_viterbi_brute_force():
    rng = np.random.default_rng(3)
    L = len(LABELS)
    t = rng.normal(size=(L, L))
    for j in range(2, L, 2):
        t[:, j] = np.where(np.isin(np.arange(L), [j - 1, j]), t[:, j], -1e4)
    f = Field({}, np.zeros((0, L), dtype=np.float32), t)
    for n in (1, 2, 4):
        emit = rng.normal(size=(n, L)).astype(np.float32) * 2
        emit[:, 0] += 1
        best = max(itertools.product(range(L), repeat=n), key=lambda p: t[0, p[0]] + t[p[-1], 0] + sum(emit[i, x] for i, x in enumerate(p)) + sum(t[a, b] for a, b in itertools.pairwise(p)))
        assert tuple(f.decode(emit)) == best
    # certain places cut the text without changing the path
    emit = rng.normal(size=(40, L)).astype(np.float32)
    emit[10:20, 0] += 100
    cut = f.decode(emit)
    f.certain = 1e9
    assert (f.decode(emit) == cut).all()


def test_tokens():
    keys, places = tokenize("Tel. (555) 555-0101, QQ 12 34 56 A; a (at) b (dot) example")
    assert keys == ["Tel", ".", "#(999) 999-0999".replace("0999", "9999"), ",", "%AA 99 99 99 A", ";", "<EMAIL>"] and places[2] == (5, 19)


def test_frame(spark, field):
    df = spark.createDataFrame([(1, "Contact: a.b@post.example. Contact: a.b@post.example.", "t"), (2, None, "t"), (3, "", "t")], "doc_id bigint, text string, pii_type string")
    assert [tuple(r) for r in particulars(df, field).collect()] == [(1, "email", "a.b@post.example")]
    out = {r.doc_id: (r.text, r.n_found) for r in redacted(df, field).collect()}
    assert out == {1: ("Contact: [EMAIL]. Contact: [EMAIL].", 2), 2: (None, 0), 3: ("", 0)}
    assert particulars(df.limit(0), field).count() == 0
