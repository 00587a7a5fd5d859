"""Accuracy and speed of moved lines and moved passages on simulated revisions with known truth.

``python benchmarks/simulated.py [TRIALS]``. Paragraphs are drawn from a seeded vocabulary
with word frequencies as in running text; a revision edits, moves, adds and drops some.
"""

from __future__ import annotations

import json
import random
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from folioflow.config import MoveSettings  # noqa: E402
from folioflow.kernels.lines import similarity_tokens, token_sort  # noqa: E402
from folioflow.kernels.moves import compare  # noqa: E402


def vocabulary(r: random.Random, size: int = 6000) -> tuple[list[str], list[float]]:
    parts = ["ba", "der", "lo", "mi", "no", "par", "re", "sun", "ta", "ver", "wil", "ga"]
    words = list(dict.fromkeys("".join(r.choice(parts) for _ in range(r.choice([1, 2, 2, 3, 3, 4]))) for _ in range(size * 2)))[:size]
    return words, [1 / (k + 3) for k in range(len(words))]


def sentence(r: random.Random, v, n: int) -> str:
    w = r.choices(v[0], v[1], k=n)
    return " ".join(w).capitalize() + "."


def edited(r: random.Random, v, text: str, share: float) -> str:
    return " ".join(r.choices(v[0], v[1])[0] if r.random() < share and not w.endswith(".") else w for w in text.split())


def line_moves(trials: int, seed: int = 20260926) -> dict:
    r = random.Random(seed)
    v = vocabulary(r)
    right = wrong = true = 0
    took = 0.0
    for _ in range(trials):
        old = [" ".join(sentence(r, v, r.randint(8, 20)) for _ in range(r.randint(2, 5))) for _ in range(40)]
        order = list(range(40))
        moved = {}
        for k in r.sample(range(40), 4):
            order.remove(k)
            order.insert(r.randrange(len(order) + 1), k)
            moved[k] = True
        new, at = [], {}
        for k in order:
            text = old[k]
            if k in moved:
                text = edited(r, v, text, r.choice([0, 0.05, 0.1, 0.2]))
            elif r.random() < 0.15:
                text = edited(r, v, text, 0.15)
            elif r.random() < 0.05:
                continue
            at[k] = len(new)
            new.append(text)
            if r.random() < 0.05:
                new.append(" ".join(sentence(r, v, 12) for _ in range(3)))
        t = time.perf_counter()
        rows = compare(old, new, MoveSettings(0.7), passages=False)
        took += time.perf_counter() - t
        out = {x.move: x.i for x in rows if x.kind == "moved-out"}
        into = {x.move: x.j for x in rows if x.kind == "moved-in"}
        found = {(out[m], into[m]) for m in out}
        same = {x.i: x.j for x in rows if x.kind in ("equal", "replace") and x.i is not None and x.j is not None}
        # a moved line that the alignment kept in place while its neighbours move counts as found
        for k in moved:
            true += 1
            right += (k, at[k]) in found or same.get(k) == at[k]
        wrong += sum(at.get(i) != j for i, j in found)
    p, q = right / max(1, right + wrong), right / true
    return {"precision": round(p, 4), "recall": round(q, 4), "f1": round(2 * p * q / (p + q), 4), "moves": true, "wrong": wrong, "seconds": round(took, 2)}


def passage_moves(trials: int, seed: int = 7) -> dict:
    r = random.Random(seed)
    v = vocabulary(r)
    right = wrong = true = 0
    took = plain = overlap = 0.0
    for _ in range(trials):
        sents = [[sentence(r, v, r.randint(8, 20)) for _ in range(r.randint(3, 6))] for _ in range(30)]
        new = [list(x) for x in sents]
        moved = set()
        for a in r.sample(range(30), 6)[:3]:
            b = r.choice([x for x in range(30) if abs(x - a) > 2])
            s = new[a].pop(r.randrange(1, len(new[a])))
            new[b].append(s)
            moved.add(s)
        for a in r.sample(range(30), 3):  # decoys
            new[a].append(sentence(r, v, 12))
        o, n = [" ".join(x) for x in sents], [" ".join(x) for x in new]
        t = time.perf_counter()
        rows = compare(o, n, MoveSettings(0.7))
        took += time.perf_counter() - t
        t = time.perf_counter()
        compare(o, n, MoveSettings(0.7), passages=False)
        plain += time.perf_counter() - t
        found = [o[x.i][a:b].strip() for x in rows for a, b, _ in x.out_spans]
        true += len(moved)
        for f in found:  # a span of one moved sentence, and how much of it
            share = max((min(len(f), len(m)) / max(len(f), len(m)) for m in moved if f in m or m in f), default=0.0)
            right += share >= 0.5
            wrong += share < 0.5
            overlap += share * (share >= 0.5)
    p, q = right / max(1, right + wrong), right / true
    return {"precision": round(p, 4), "recall": round(q, 4), "f1": round(2 * p * q / (p + q), 4), "moves": true, "wrong": wrong, "boundary_iou": round(overlap / max(1, right), 4), "seconds": round(took, 2), "without_passages": round(plain, 2)}


def stress(seed: int = 11, paragraphs: int = 400, moves: int = 30) -> dict:
    """One large revision in the published set-up: 30 moved sentences and 30 decoys among 400 paragraphs,
    every other one 15 % edited."""
    r = random.Random(seed)
    v = vocabulary(r)
    sents = [[sentence(r, v, r.randint(8, 20)) for _ in range(r.randint(3, 6))] for _ in range(paragraphs)]
    new = [list(x) for x in sents]
    moved = set()
    for a in r.sample(range(paragraphs), moves):
        b = r.choice([x for x in range(paragraphs) if abs(x - a) > 2])
        s = new[a].pop(r.randrange(1, len(new[a])))
        new[b].append(s)
        moved.add(s)
    for a in r.sample(range(paragraphs), moves):
        new[a].append(sentence(r, v, 12))
    new = [[x if x in moved or k % 2 else edited(r, v, x, 0.15) for x in para] for k, para in enumerate(new)]
    o, n = [" ".join(x) for x in sents], [" ".join(x) for x in new]
    t = time.perf_counter()
    rows = compare(o, n, MoveSettings(0.7))
    took = time.perf_counter() - t
    t = time.perf_counter()
    compare(o, n, MoveSettings(0.7), passages=False)
    plain = time.perf_counter() - t
    found = [o[x.i][a:b].strip() for x in rows for a, b, _ in x.out_spans]
    hit = {m for m in moved for f in found if (f in m or m in f) and min(len(f), len(m)) / max(len(f), len(m)) >= 0.5}
    return {"moves": len(moved), "found": len(hit), "reported": len(found), "seconds": round(took, 2), "without_passages": round(plain, 2)}


def pair_scores(n: int = 250, m: int = 200) -> dict:
    r = random.Random(1)
    v = vocabulary(r)
    a = [similarity_tokens(" ".join(sentence(r, v, 15) for _ in range(4))) for _ in range(n)]
    b = [similarity_tokens(" ".join(sentence(r, v, 15) for _ in range(4))) for _ in range(m)]
    t = time.perf_counter()
    for x in a:
        for y in b:
            token_sort(x, y)
    return {"microseconds_per_pair": round((time.perf_counter() - t) / (n * m) * 1e6, 2)}


if __name__ == "__main__":
    k = int(sys.argv[1]) if len(sys.argv) > 1 else 200
    print(json.dumps({"line_moves": line_moves(k), "passages": passage_moves(max(10, k // 4)), "stress": stress(), "token_sort": pair_scores()}))
