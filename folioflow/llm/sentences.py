"""Sentence boundaries across languages and scripts by semi-Markov dynamic programming.

Places where a sentence could end are found first: after end marks with their closing
marks, quotes, brackets and note references, and at blanks between letters of scripts
without end marks. Dynamic programming then picks whole spans between such places: a span
scores by its closing word (abbreviations of several classes, initials, ordinal numbers),
the word that opens what follows, its length, and the quotations and brackets it leaves
open or closes without having opened them. The best-scoring split of the text wins; spans
may be of any length, and time is linear in the text.

Defined results: null and blank texts have no sentences; the last sentence ends with the
last character that isn't blank; a list or note marker belongs to the first sentence;
a mark of quotation without a partner changes nothing.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Weights of a span's length (in characters, by script), of a quotation it cuts, of a span without words.
USUAL, USUAL_DENSE, LENGTH_WEIGHT, SHORT_MOST, LONG_MOST, OPEN_COST, TINY_COST = 75.0, 25.0, 0.15, 0.7, 1.4, 4.0, 4.0  # LONG_MOST is at least twice SHORT_MOST
# Abbreviations by what may follow them (lower case, without the last full stop).
REFERENCES = set(
    """fig figs figure sect sec p pp no nos vol vols ch app ed chap tab pág págs pag núm num cap abb kap nr bd s bl blz dl rys rozdz t r с рис гл табл § σ εικ αρ κεφ
    şek böl cilt n № st pl art par abs anm rn ziff str vers ver rev z lines line ص ج पृ สฯ n° nº n.º стр ил мал v tom rn tel ext apt ул ul ст""".split()
)
TITLES = set(
    """dr dra prof mr mrs ms st sr sra srta m mm mme mlle dott dott.ssa sig sig.ra ing hr fr mevr dhr mevrouw jr rev hon gen col lt capt док др-р проф г-н г-жа κ κα δρ प्रो डॉ श्री د أ inż mgr pan pani""".split()
)
GENERAL = set(
    """vs approx e.g i.e cf viz al aprox ej p.ej v z.b d.h u.a bzw ggf lt evtl inkl vgl z d h u b ca env c.-à-d c.-à-d cfr es ecc ex p.ex bijv d.w.z o.a m.a.w resp t.ex bl.a dvs jfr m.fl np ok proc por zob tj m.in tzn т.е т см напр ср тыс млн млрд тис див напр т.д
    π.χ δηλ περ βλ πρβλ bkz örn yakl vb krş u.s u.k a.m p.m jan feb mar apr jun jul aug sept oct nov dec mon tue wed thu fri sat sun dept inst univ ltd inc co corp einschl ggü ung geb gest hrsg aufl jg jh sog bspw о т.п т.н ок max min min""".split()
)
MAY_END = set("etc usw ff f ecc enz osv m.m itd itp κ.λπ κλπ др д п т.д т.п vb vs. a.m p.m ltd inc co al u.s u.k jr тыс тис млн proc env aprox approx i.a e.d u.dgl".split())
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jänner januari februari mars jh jahrhundert".split())
OPENERS, CLOSERS = "„“”«‹「『（([〈《\"‘‚", "“”»›」』）)]〉》\"’"
ENDS = ".!?…。！？؟।॥｡;\u037e"
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
_NOTE = r"(?:\[\^[^\]\s]{1,20}\])"
_PLACE = re.compile(rf"[{re.escape(ENDS)}]+(?:[”“’\"'»›)\]」』）〉》]|\s?»(?!\w)|{_NOTE})*")
_THAI = re.compile(r"(?<=[฀-๿])((?:[”»)\]]|\[\^[^\]\s]{1,20}\])*)\s+(?=[“«(\[]?[฀-๿A-Z])|\n+")
_OTHER = re.compile(r"[฀-๿\n]")
_ALNUM = re.compile(r"[^\W_]")
_MARKER = re.compile(r"\s*(?:\[\^[^\]\s]{1,20}\]:|[-*+•–]|\(?\d{1,3}[.)]|\(?[a-z]\))\s+")
_WORD = re.compile(r"[^\s“”„«»(\[「『（]+$")
_EVENTS = re.compile(r"[„“”«»「」『』（）()\"]|\[(?!\^)|(?<!\^)\]")
_DENSE = re.compile(r"[\u3040-\u30ff\u4e00-\u9fff]")
_PARTNER = {")": "(", "]": "[", "）": "（", "」": "「", "』": "『"}


def _places(text: str, start: int) -> list[tuple[int, int, str]]:
    """(end, start of the next, kind) of every place where a sentence could end."""
    out = []
    n = len(text)
    for m in _PLACE.finditer(text, start):
        e = m.end()
        if e >= n:
            continue
        marks = m.group().rstrip("”“’\"'»›)]」』）〉》 ")
        nxt = e
        while nxt < n and text[nxt].isspace():
            nxt += 1
        if nxt >= n or (m.group()[0] in ";\u037e" and not _GREEK.search(text, max(0, m.start() - 30), m.start())):
            continue  # the semicolon asks in Greek only
        if nxt == e and not (marks[-1:] in "。！？｡" or m.group()[0] in "。！？｡"):
            continue
        out.append((e, nxt, "mark"))
    if _OTHER.search(text):
        for m in _THAI.finditer(text, start):
            e = m.end(1) if m.group(1) is not None else m.start()
            nxt = m.end()
            if e > start and nxt < n:
                out.append((e, nxt, "line" if "\n" in m.group() else "blank"))
        out = sorted({x[0]: x for x in out}.values())
    return out


def _boundary(text: str, end: int, nxt: int, kind: str, cased: bool) -> float:
    """How well the closing and the opening word fit a boundary at this place."""
    if kind == "line":
        return 3.0
    opening = nxt
    n = len(text)
    while opening < n and (text[opening] in OPENERS or text[opening] in "'¿¡*_ " or (text[opening] in "»”" and not text[opening + 1 : opening + 2].isspace())):
        opening += 1
    first = text[opening : opening + 1]
    if kind == "blank":
        return 2.0
    e = end
    closed = False
    while e > 0 and (text[e - 1] in "”“’\"'»›)]」』）〉》 " or text[e - 1].isspace()):
        if text[e - 1] == "]":
            at = text.rfind("[^", max(0, e - 24), e)
            if at >= 0:
                e = at
                continue
        closed = closed or not text[e - 1].isspace()
        e -= 1
    mark = text[e - 1 : e]
    if mark in "。！？｡":
        if closed and text[end : end + 1] and not text[end : end + 1].isspace() and text[end - 1 : end] in "」』”’":
            return -5.0  # reported speech goes on
        return 3.0
    if mark in "।॥؟":
        return 3.0
    if first.islower():
        score = -6.0 if cased else -3.0 if closed and mark in "!?" else 0.5
    elif first.isupper():
        score = 1.5
    elif first.isdigit():
        score = 0.0
    elif first.isalpha():
        score = 2.0 if _DENSE.match(first) else 1.0  # scripts without case
    else:
        score = -1.0
    if mark in "!?":
        return score + 1.5
    if mark in ";\u037e":
        return score + 0.5
    if "\u0900" <= text[e - 2 : e - 1] <= "\u097f" and mark == ".":
        return -4.0  # Devanagari ends with a danda; a full stop abbreviates
    if mark == "…" or text[e - 3 : e] == "...":
        return score + 0.5
    body = text[:e].rstrip(".")
    m = _WORD.search(body, max(0, len(body) - 40))
    word = m.group().lower() if m else ""
    tail = word.rpartition("/")[2]
    if not tail:
        return score
    if tail in TITLES:
        return -6.0
    if tail.isdigit() and not closed:
        after = re.match(r"[^\W\d_]+", text[opening : opening + 20])
        if after and after.group().lower() in MONTHS and after.group() != after.group().upper():
            return -6.0
        return score + 1.0
    ends = tail in MAY_END
    if ends and not cased:
        return -1.5
    if tail in REFERENCES and (first.isdigit() or not first.isupper() or len(tail) == 1) and not closed and not (len(tail) > 2 and first.isupper()):
        if first.isdigit() or (first.isalpha() and not first.isupper()) or re.match(r"[IVXLC]+\b", text[opening : opening + 8]):
            return -6.0
        return -3.0 if len(tail) == 1 else score - 1.0
    if closed:
        return score + 1.0
    if len(tail) == 1 and tail.isalpha():
        return -4.0
    if re.fullmatch(r"(?:[^\W\d_]{1,3}\.)+(?:-?[^\W\d_]{1,3}\.?-?)*[^\W\d_]{0,3}", tail) and "." in tail:
        return score - (1.0 if ends else 4.0)
    if ends:
        return score - 0.8
    if tail in GENERAL:
        return score - 4.0
    return score + 1.0


def _quotations(text: str, start: int, last: int) -> list[tuple[int, int]]:
    """(opening, closing) places of the quotations and brackets that are closed; marks without
    a partner say nothing."""
    stack: list[tuple[str, int]] = []
    out = []

    def close(wanted: str, at: int) -> bool:
        k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in wanted), None)
        if k is not None:
            out.append((stack[k][1], at))
            del stack[k:]
        return k is not None

    for m in _EVENTS.finditer(text, start, last):
        at, c = m.start(), m.group()
        before, after = text[at - 1 : at] if at > start else " ", text[at + 1 : at + 2] or " "
        opens = (before.isspace() or before in OPENERS or before in "-–—/:") and not (after.isspace() or after in ENDS or after in ",:)]")
        closes = not before.isspace() and (after.isspace() or after in CLOSERS or after in ENDS or after in ",:-–—[")
        if c in _PARTNER:
            close(_PARTNER[c], at)
        elif c in "([（「『„" or (c == "«" and not closes):
            stack.append((c, at))
        elif c == "“":
            if not (not opens and close("„", at)):
                stack.append((c, at))
        elif not (not opens and close({"”": "“„”", "»": "«»", "«": "»", '"': '"'}[c], at)) and not closes:
            stack[:] = [x for x in stack if x[0] != c]  # one of the same kind left open has no partner
            stack.append((c, at))
    return out


def _length_score(n: int, usual: float) -> float:
    """How far a span's length is from the usual one, down to ``-SHORT_MOST`` and ``-LONG_MOST``."""
    x = math.log((n + 4) / usual)
    return -min(SHORT_MOST if x < 0 else LONG_MOST, LENGTH_WEIGHT * x * x)


def _best_spans(text: str, starts: list[int], ends: list[int], edge: list[float], usual: float) -> list[int]:
    """Numbers of the places the best split ends its spans at; the last place is always one.

    ``starts[i]`` is where a span after place ``i - 1`` begins. A place worse than any length
    could make up is on no best path and one better than any length is on every one, so the
    program runs between the latter. Spans longer than ``far`` all score alike for their
    length, so of the starts that far back only the best is kept: time is linear.
    """
    n = len(ends)
    kept = [i for i in range(n - 1) if edge[i] > -LONG_MOST] + [n - 1]
    k = len(kept)
    a = [starts[0]] + [starts[i + 1] for i in kept[:-1]]
    e = [ends[i] for i in kept]
    g = [edge[i] for i in kept]
    tiny = [y - x < 3 or not _ALNUM.search(text, x, y) for x, y in zip(a, e, strict=True)]
    sure = [j == k - 1 or (g[j] > LONG_MOST and not tiny[j] and not tiny[j + 1]) for j in range(k)]
    far = usual * math.exp(math.sqrt(LONG_MOST / LENGTH_WEIGHT))
    out: list[int] = []
    lo = 0
    while lo < k:
        hi = lo
        while not sure[hi]:
            hi += 1
        if hi > lo:  # spans from the start of lo .. hi to the ends of lo .. hi
            best = [0.0] + [float("-inf")] * (hi - lo + 1)
            back = [0] * (hi - lo + 2)
            near, top, top_at = 0, float("-inf"), 0
            for j in range(hi - lo + 1):
                end = e[lo + j]
                while near <= j and end - a[lo + near] > far and end - a[lo + near] >= 64:
                    if best[near] > top:
                        top, top_at = best[near], near
                    near += 1
                score, at = top - LONG_MOST, top_at
                for i in range(near, j + 1):
                    x = a[lo + i]
                    v = best[i] + _length_score(end - x, usual)
                    if tiny[lo + i] and (end - x < 3 or not _ALNUM.search(text, x, end)):
                        v -= TINY_COST
                    if v > score:
                        score, at = v, i
                best[j + 1], back[j + 1] = score + g[lo + j], at
            path = []
            j = hi - lo + 1
            while j > 0:
                path.append(kept[lo + j - 1])
                j = back[j]
            out += path[::-1]
        else:
            out.append(kept[lo])
        lo = hi + 1
    return out


def sentence_ends(text: str | None) -> list[int]:
    """End of each sentence, in characters from the start of the text."""
    if not text or not text.strip():
        return []
    last = len(text.rstrip())
    marker = _MARKER.match(text)
    start = marker.end() if marker else 0
    body = text[start:last]
    cased = body != body.lower() and body != body.upper()
    places = _places(text[:last], start)
    if not places:
        return [last]
    edge = [_boundary(text, e, n, k, cased) for e, n, k in places] + [0.0]
    pairs = _quotations(text, start, last)
    if pairs:  # each quotation that a place lies in is left open by one span and closed by another
        opened, closed = sorted(x for x, _ in pairs), sorted(y for _, y in pairs)
        for i, (e, _, _) in enumerate(places):
            edge[i] -= 2 * OPEN_COST * (bisect_left(opened, e) - bisect_left(closed, e))
    ends = [e for e, _, _ in places] + [last]
    usual = USUAL - (USUAL - USUAL_DENSE) * len(_DENSE.findall(body)) / len(body)
    return [ends[i] for i in _best_spans(text, [start] + [n for _, n, _ in places], ends, edge, usual)]


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence, blanks between left out."""
    spans, at = [], 0
    for e in sentence_ends(text):
        while at < e and text[at].isspace():
            at += 1
        spans.append((at, e))
        at = e
    return spans


def split_sentences(records: DataFrame, key: str, skip=None) -> DataFrame:
    """``records(key, text)`` → ``(key, end_pos)``; ``skip(texts) -> [bool]`` leaves texts out."""
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["text"]]
            left = skip(texts) if skip else [False] * len(texts)
            rows = [(k, e) for k, t, s in zip(b[key], texts, left, strict=True) if not s for e in sentence_ends(t)]
            yield pd.DataFrame(rows, columns=[key, "end_pos"])

    return records.select(key, "text").where(F.length("text") > 0).mapInPandas(run, f"{key} {kind}, end_pos bigint").dropDuplicates([key, "end_pos"])
