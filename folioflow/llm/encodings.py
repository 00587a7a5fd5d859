"""Text garbled by a wrong character encoding: found and, where it can be had, restored.

A hidden Markov model labels every character. One state is clean; each other state is an
encoding pair (the bytes of one encoding, read in another), among them pairs applied twice
and the state of characters that are lost for good. A state emits the characters that its
inverse transform gives, under one model of adjacent characters trained on all documents;
what a state can't have produced, it can't emit. Viterbi paths leave and enter the clean
state at a cost, and each labelled span gets its state's inverse transform.

Characters below U+0080 read the same under every pair, so texts of these alone, and texts
in which every run of three characters is known from clean text, stay clean.

Defined results: null and empty texts are clean. Lost characters (U+FFFD) make a record
garbled and stay in the restored text. Texts of any length are labelled whole, long ones in
windows: a window's path is decided by the characters around, so ``OVERLAP`` characters more
on either side give the path of the whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LOST = 0xFFFD
# Fixed values: (bytes of, read as), and how often in a row.
PAIRS = [
    ("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "cp1250", 1), ("utf-8", "cp1251", 1), ("utf-8", "cp1253", 1), ("utf-8", "cp1254", 1), ("utf-8", "cp437", 1), ("utf-8", "cp850", 1), ("utf-8", "mac-roman", 1), ("utf-8", "cp866", 1), ("utf-8", "iso8859-2", 1), ("utf-8", "iso8859-15", 1),
    ("utf-8", "cp1252", 2), ("utf-8", "latin-1", 2), ("utf-8", "cp1250", 2), ("utf-8", "cp1252", 3),
    ("cp1252", "cp437", 1), ("cp1252", "cp850", 1), ("cp1252", "mac-roman", 1), ("cp1252", "cp1250", 1), ("cp1252", "cp1251", 1), ("cp1250", "cp1252", 1), ("cp1250", "cp850", 1), ("cp1251", "cp1252", 1), ("cp1251", "latin-1", 1), ("cp1251", "koi8-r", 1), ("koi8-r", "cp1251", 1), ("koi8-r", "cp1252", 1), ("cp866", "cp1251", 1), ("cp866", "cp1252", 1), ("cp1253", "cp1252", 1), ("iso8859-7", "latin-1", 1), ("cp1254", "cp1252", 1), ("cp1256", "cp1252", 1), ("cp874", "cp1252", 1), ("iso8859-2", "cp1252", 1), ("iso8859-5", "cp1252", 1),
    ("mac-roman", "cp1252", 1), ("cp850", "cp1252", 1), ("cp437", "cp1252", 1), ("gbk", "cp1252", 1), ("shift_jis", "cp1252", 1), ("euc-jp", "cp1252", 1), ("big5", "cp1252", 1),
]
STATES = ["clean", *(f"{a} as {b}" + (f" x{n}" if n > 1 else "") for a, b, n in PAIRS), "lost"]
ENTER, LEAVE, NEVER, FLOOR = -9.0, -3.0, -50.0, -13.0
WINDOW, OVERLAP = 100_000, 2_000  # characters
_SEPARATOR = 10  # a line feed between the texts of a batch
_SIGNS = np.array([ord(c) for c in "§°ª²³¹ºµ±×÷¼½¾©®«»"])
# whole scripts and double-byte sets never come as a single character: dearer to enter
_DEAR = {"cp1251", "koi8-r", "cp866", "cp1253", "iso8859-7", "cp1256", "cp874", "iso8859-5", "gbk", "shift_jis", "euc-jp", "big5"}


def _single(codec: str) -> np.ndarray:
    """Character of each byte; bytes without one keep their value, as lenient readers do."""
    out = np.arange(256)
    for b in range(128, 256):
        try:
            out[b] = ord(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            pass
    return out


def _to_byte(codec: str) -> np.ndarray:
    out = np.full(0x10000, -1, dtype=np.int16)
    out[_single(codec)] = np.arange(256)
    return out


def _double(codec: str) -> np.ndarray:
    out = np.full((256, 256), -1, dtype=np.int32)
    for a in range(0x81, 0x100):
        for b in range(0x40, 0x100):
            try:
                if len(t := bytes([a, b]).decode(codec)) == 1:
                    out[a, b] = ord(t)
            except UnicodeDecodeError:
                pass
    return out


class Inverse:
    """One pair's inverse: units of characters and what each unit stood for."""

    def __init__(self, right: str, wrong: str, times: int):
        self.right, self.times = right, times
        self.byte = _to_byte(wrong)
        self.kind = "utf8" if right == "utf-8" else "double" if right in ("gbk", "shift_jis", "euc-jp", "big5") else "single"
        self.table = _double(right) if self.kind == "double" else _single(right) if self.kind == "single" else None

    def once(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of a unit, value of the unit at each of its characters, valid)."""
        n = len(cp)
        b = np.where(cp < 0x10000, self.byte[np.minimum(cp, 0xFFFF)], -1).astype(np.int32)
        ascii_ = cp < 128
        start, value, valid = np.ones(n, dtype=bool), cp.copy(), ascii_.copy()
        if self.kind == "single":
            got = b >= 128
            to = self.table[np.where(got, b, 0)]
            real = got & (to > 0x9F)
            value[real], valid[real] = to[real], True
            return start, value, valid
        if self.kind == "double":
            nxt = np.append(b[1:], -1)
            to = np.where((b >= 128) & (nxt >= 64), self.table[np.clip(b, 0, 255), np.clip(nxt, 0, 255)], -1)
            for i in np.flatnonzero(to >= 0):
                if start[i]:
                    value[i : i + 2], valid[i : i + 2], start[i + 1] = to[i], True, False
            return start, value, valid
        pad = np.concatenate([b, [-1, -1, -1]])
        c1, c2, c3 = pad[1 : n + 1], pad[2 : n + 2], pad[3 : n + 3]
        cont = lambda x: (x >= 0x80) & (x < 0xC0)
        two = (b >= 0xC2) & (b < 0xE0) & cont(c1)
        three = (b >= 0xE0) & (b < 0xF0) & cont(c1) & cont(c2)
        four = (b >= 0xF0) & (b < 0xF5) & cont(c1) & cont(c2) & cont(c3)
        for mask, length, code in (
            (two, 2, ((b & 31) << 6) | (c1 & 63)),
            (three, 3, ((b & 15) << 12) | ((c1 & 63) << 6) | (c2 & 63)),
            (four, 4, ((b & 7) << 18) | ((c1 & 63) << 12) | ((c2 & 63) << 6) | (c3 & 63)),
        ):
            low = {2: 0x80, 3: 0x800, 4: 0x10000}[length]
            i = np.flatnonzero(mask & (code >= low) & ~((code >= 0xD800) & (code < 0xE000)) & (code < 0x110000))
            for k in range(length):
                value[i + k], valid[i + k] = code[i], True
                if k:
                    start[i + k] = False
        return start, value, valid

    def units(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, value, valid = self.once(cp)
        for _ in range(self.times - 1):
            first = np.flatnonzero(start)
            unit = np.cumsum(start) - 1
            s2, v2, ok2 = self.once(value[first])
            valid = valid & ok2[unit]
            value = v2[unit]
            start = start & s2[unit]
        return start, value, valid


_inverses: list[Inverse] = []


def inverses() -> list[Inverse]:
    if not _inverses:
        _inverses.extend(Inverse(*p) for p in PAIRS)
    return _inverses


def _find(table: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
    return at, table[at] == codes


def _letter(cp: np.ndarray) -> np.ndarray:
    """Letters of the alphabetic scripts, as far as it takes to tell a word's inside."""
    basic = ((cp >= 65) & (cp <= 90)) | ((cp >= 97) & (cp <= 122))
    return basic | ((cp >= 0xC0) & (cp < 0x600) & (cp != 0xD7) & (cp != 0xF7))


def triple_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(three characters in a row as one number, how often), sorted, of texts between blank lines: as they are,
    which counts three times, in capitals and in small letters. Counts of parts of the texts add up to those of all."""
    whole = "\n\n".join(["", *texts, ""])
    seen: dict[int, int] = {}
    for form, weight in ((whole, 3), (whole.upper(), 1), (whole.lower(), 1)):
        cp = codepoints(form)
        cp = cp[cp != LOST]
        n = pd.Series((((cp[:-2] << 21) | cp[1:-1]) << 21) | cp[2:]).value_counts(sort=False)
        for k, c in zip(n.index.tolist(), (weight * n.to_numpy()).tolist(), strict=True):
            seen[k] = seen.get(k, 0) + c
    triples = np.array(sorted(seen), dtype=np.int64)
    return triples, np.array([seen[k] for k in triples.tolist()], dtype=np.int64)


class CleanModel:
    """Neighbouring characters of clean text: log P(next | the two before), smoothed by
    P(next | the one before) and P(next)."""

    def __init__(self, triples: np.ndarray, p3: np.ndarray, pairs: np.ndarray, p2: np.ndarray, chars: np.ndarray, p1: np.ndarray):
        self.triples, self.p3, self.pairs, self.p2, self.chars, self.p1 = triples, p3, pairs, p2, chars, p1
        self._of: np.ndarray | None = None  # place of each code point among ``chars``, -1 for unseen ones

    def __getstate__(self):
        return self.__dict__ | {"_of": None}

    def place(self, cp: np.ndarray) -> np.ndarray:
        if self._of is None:
            self._of = np.full(0x110000, -1, dtype=np.int32)
            self._of[self.chars] = np.arange(len(self.chars))
        return self._of[cp]

    @staticmethod
    def train(texts: list[str]) -> CleanModel:
        return CleanModel.of(*triple_counts(texts))

    @staticmethod
    def of(triples: np.ndarray, n3: np.ndarray) -> CleanModel:
        """The model of counted triples, sorted; as line feeds end each text, every pair and every character begins one."""
        if not len(triples):
            triples, n3 = np.array([((_SEPARATOR << 21) | _SEPARATOR) << 21 | _SEPARATOR]), np.array([1])
        pairs, which = np.unique(triples >> 21, return_inverse=True)
        n2 = np.bincount(which, n3)
        chars, first = np.unique(pairs >> 21, return_inverse=True)
        n1 = np.bincount(first, n2)
        return CleanModel(triples, n3 / n2[which], pairs, n2 / n1[first], chars, n1 / n1.sum())

    def strange(self, cp: np.ndarray) -> np.ndarray:
        """Positions whose character, beyond ASCII or next to such, was never seen so."""
        codes = (((cp[:-2] << 21) | cp[1:-1]) << 21) | cp[2:]
        wide = cp >= 128
        near = wide[2:] | wide[1:-1] | wide[:-2]
        at = np.flatnonzero(near)
        return at[~_find(self.triples, codes[at])[1]] + 2

    def score(self, before2: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        at, seen = self.place(after), self.place(before) >= 0
        ok1 = at >= 0
        p1 = np.where(ok1, self.p1[at], 0.0)
        p = 0.02 * p1
        # a pair holds only seen characters and a triple only seen pairs: the longer ones are looked up where they can be
        i = np.flatnonzero(ok1 & seen)
        k, ok = _find(self.pairs, (before[i] << 21) | after[i])
        i, k = i[ok], k[ok]
        p[i] += 0.25 * self.p2[k]
        k, ok = _find(self.triples, (((before2[i] << 21) | before[i]) << 21) | after[i])
        p[i[ok]] += 0.65 * self.p3[k[ok]]
        # after an unseen character any mark or blank may come
        p = np.where(seen | _letter(after), p, 0.9 * p1)
        out = np.maximum(np.log(np.maximum(p, 1e-12)), FLOOR)
        i = np.flatnonzero(~ok1)
        out[i] = self._unseen(before[i], after[i])
        return out

    @staticmethod
    def _unseen(before: np.ndarray, cp: np.ndarray) -> np.ndarray:
        control = ((cp >= 0x7F) & (cp < 0xA0)) | (cp == LOST)
        # unseen letters of large scripts are no surprise, nor signs that stand alone; unseen Latin
        # letters and signs within words are
        large = ((cp >= 0x3040) & (cp < 0xD7B0)) | ((cp >= 0x0900) & (cp < 0x1000)) | (cp >= 0x1F000)
        sign = (((cp >= 0x2000) & (cp < 0x2300)) | np.isin(cp, _SIGNS)) & ~_letter(before)
        return np.where(control, -25.0, np.where(large, FLOOR + 3, np.where(sign, FLOOR + 7, FLOOR - 3)))


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def clean_model(documents: DataFrame, part: int = 2_000_000) -> CleanModel:
    """The model of all texts, none left out: triples are counted where the rows are, about ``part``
    characters at a time, and what reaches the driver is each triple with its count, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            texts, size = [], 0
            for t in [*b.column("text").to_pylist(), None]:
                if t is not None:
                    texts.append(t)
                    size += len(t)
                if texts and (t is None or size >= part):
                    counts.update(dict(zip(*(x.tolist() for x in triple_counts(texts)), strict=True)))
                    texts, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["code", "n"])

    counted = documents.select("text").where("text is not null").mapInArrow(run, "code bigint, n bigint")
    got = counted.groupBy("code").agg(F.sum("n").alias("n")).toArrow().sort_by("code")
    return CleanModel.of(got.column("code").to_numpy(), got.column("n").to_numpy())


def label(model: CleanModel, texts: list[str | None], steps: int = 1_500_000) -> list[np.ndarray | None]:
    """State of every character for each text, or None where all is clean."""
    out: list[np.ndarray | None] = [None] * len(texts)
    asked = []
    plain = [i for i, t in enumerate(texts) if t and not t.isascii()]
    if plain:  # one look-up for the whole batch
        cps = [codepoints(texts[i]) for i in plain]
        joined = np.concatenate([np.append(c, _SEPARATOR) for c in cps])
        joined = np.concatenate([[_SEPARATOR, _SEPARATOR], joined])
        ends = np.cumsum([len(c) + 1 for c in cps])
        owner = np.searchsorted(ends, model.strange(joined) - 2, side="right")
        for k in np.unique(owner).tolist():  # long texts in windows that overlap
            n = len(cps[k])
            for lo in range(0, max(1, n), WINDOW):
                hi, a, b = min(n, lo + WINDOW), max(0, lo - OVERLAP), min(n, lo + WINDOW + OVERLAP)
                asked.append((plain[k], lo, hi, a, cps[k][a:b], n))
    asked.sort(key=lambda x: len(x[4]))
    at = 0
    while at < len(asked):
        size, end = 0, at
        while end < len(asked) and (end == at or size + len(asked[end][4]) <= steps // len(STATES)):
            size += len(asked[end][4])
            end += 1
        for (i, lo, hi, a, _, n), states in zip(asked[at:end], _viterbi(model, [x[4] for x in asked[at:end]]), strict=True):
            if states[lo - a : hi - a].any():
                if out[i] is None:
                    out[i] = np.zeros(n, dtype=np.int16)
                out[i][lo:hi] = states[lo - a : hi - a]
        at = end
    return out


def _viterbi(model: CleanModel, cps: list[np.ndarray]) -> list[np.ndarray]:
    whole = np.concatenate([np.append(c, _SEPARATOR) for c in cps])
    before = np.concatenate([[_SEPARATOR], whole[:-1]])
    before2 = np.concatenate([[_SEPARATOR], before[:-1]])
    # far from wide characters all states emit alike and nothing is decided: left out, but for
    # the two characters before, which the next ones are scored by
    wide = whole >= 128
    near = wide.copy()
    near[1:] |= wide[:-1]
    near[2:] |= wide[:-2]
    around = near.copy()
    around[:-1] |= near[1:]
    around[:-2] |= near[2:]
    kept = np.flatnonzero(around)
    counts = near[kept]
    flat, n, S = whole[kept], len(kept), len(STATES)
    emit = np.full((n, S), NEVER)
    emit[:, 0] = np.where(counts, model.score(before2[kept], before[kept], flat), 0.0)
    emit[flat == LOST, 0] = NEVER
    odd = flat >= 128
    here = np.arange(n)
    for s, inv in enumerate(inverses(), 1):
        start, value, ok = inv.units(flat)
        if not (ok & odd).any():
            continue
        prev = np.concatenate([[_SEPARATOR], value[:-1]])
        opened = np.maximum.accumulate(np.where(start, here, 0))  # where the unit of a position starts
        prev2 = np.concatenate([[_SEPARATOR], prev[opened[:-1]]])
        at = np.flatnonzero(ok & counts & start)
        emit[ok, s] = 0.0
        emit[at, s] = model.score(prev2[at], prev[at], value[at])
    emit[(flat == LOST) | ((flat >= 0x80) & (flat < 0xA0)), S - 1] = -3.0  # controls no pair accounts for
    emit[~odd, S - 1] = np.where(counts[~odd], emit[~odd, 0] - 1.0, 0.0)
    ends = np.cumsum([len(c) + 1 for c in cps])
    owner = np.searchsorted(ends, kept, side="right")
    lengths = np.bincount(owner, minlength=len(cps))
    order = np.argsort(lengths, kind="stable")  # texts by their number of kept positions
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    lengths, starts = lengths[order], firsts[order]
    most = int(lengths.max())
    k = len(cps)
    into = np.array([0.0, *(2.5 * ENTER if r in _DEAR else ENTER for r, _, _ in PAIRS), ENTER])
    score = np.tile(into, (k, 1))
    score = score + emit[np.minimum(starts, n - 1)]
    back_clean = np.zeros((most, k), dtype=np.int8)  # best state before, when now clean
    from_clean = np.zeros((most, k, S), dtype=bool)
    for t in range(1, most):
        live = int(np.searchsorted(lengths, t, side="right"))  # shorter ones are done
        a = score[live:]
        e = emit[starts[live:] + t]
        best = a[:, 1:].argmax(axis=1) + 1
        other = a[np.arange(len(a)), best] + LEAVE
        stay = a[:, 0]
        back_clean[t, live:] = np.where(other > stay, best, 0)
        enter = stay[:, None] + into
        took = enter > a
        from_clean[t, live:] = took
        new = np.maximum(enter, a)
        new[:, 0] = np.maximum(other, stay)
        score[live:] = new + e
    out = []
    for j in np.argsort(order, kind="stable").tolist():
        n_j = int(lengths[j])
        path = np.zeros(n_j, dtype=np.int16)
        end = score[j].copy()
        end[1:] += LEAVE
        s = int(end.argmax())
        for t in range(n_j - 1, -1, -1):
            path[t] = s
            if t == 0:
                break
            if s == 0:
                s = int(back_clean[t, j])
            elif from_clean[t, j, s]:
                s = 0
        cp = cps[order[j]]
        states = np.zeros(len(cp), dtype=np.int16)
        if path.any():  # characters left out lie in the span of their neighbours, if these agree
            at = kept[starts[j] : starts[j] + n_j] - (ends[order[j]] - len(cp) - 1)
            inside = at < len(cp)
            at, path = at[inside], path[inside]
            i = np.arange(len(cp))
            left = path[np.maximum(np.searchsorted(at, i, side="right") - 1, 0)]
            right = path[np.minimum(np.searchsorted(at, i, side="left"), len(at) - 1)]
            states = np.where((left == right) & (i >= at[0]) & (i <= at[-1]), left, 0).astype(np.int16)
        # a span counts only if it holds characters that the pair changed
        if states.any():
            edges = np.flatnonzero(np.diff(states)) + 1
            for a, b in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(cp)]]), strict=True):
                if states[a] and not _evidence(cp, a, b, int(states[a])):
                    states[a:b] = 0
        out.append(states)
    return out


def _evidence(cp: np.ndarray, a: int, b: int, state: int) -> bool:
    """A span holds changed characters; under one-byte pairs a sign that stands alone is none."""
    at = a + np.flatnonzero(cp[a:b] >= 128)
    if state == len(STATES) - 1 or inverses()[state - 1].kind != "single":
        return len(at) > 0
    letter = lambda i: 0 <= i < len(cp) and cp[i] not in _SIGNS and chr(int(cp[i])).isalpha()
    return any(letter(i - 1) or letter(i) or letter(i + 1) for i in at.tolist())


def restore(text: str, states: np.ndarray | None) -> str:
    """The text with each labelled span sent back through its state's inverse."""
    if states is None:
        return text
    cp = codepoints(text)
    out = []
    edges = np.flatnonzero(np.diff(states)) + 1
    for a, b in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(cp)]]), strict=True):
        s = int(states[a])
        if 0 < s < len(STATES) - 1:
            start, value, valid = inverses()[s - 1].units(cp[a:b])
            out.append("".join(map(chr, value[start])))
        else:
            out.append("".join(map(chr, cp[a:b])))
    return "".join(out)


def find_garbled(records: DataFrame, model: CleanModel) -> DataFrame:
    """``records(record_kind, record_id, text)`` → ``(record_kind, record_id, states, restored)``
    of the garbled records, once each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["text"]]
            found = [(k, i, sorted({STATES[int(x)] for x in np.unique(s) if x}), restore(t, s)) for k, i, t, s in zip(b["record_kind"], b["record_id"], texts, label(model, texts), strict=True) if s is not None]
            yield pd.DataFrame(found, columns=["record_kind", "record_id", "states", "restored"])

    schema = "record_kind string, record_id bigint, states array<string>, restored string"
    return records.select("record_kind", "record_id", "text").where("text is not null").mapInPandas(run, schema).dropDuplicates(["record_kind", "record_id"])
