"""Personal information in free text by a linear-chain conditional random field.

Tokens (words, numbers with their separators, codes, e-mail forms, single ideographs,
marks) have word-shape features of their own and of their neighbours. The field is trained
by gradient ascent on the likelihood from the small labelled table of ``pii_table`` and
decoded by Viterbi in numpy batches over whole texts. As features of a neighbour depend on
that neighbour alone, each distinct token's scores are summed once and then only looked up.

Where the outside label leads by more than transitions can ever make up, it is certain, so
paths are only searched between such places; that loses nothing.

An exact check follows: a phone or identity number needs enough digits, a name two parts with a
capital or ideographs, and it ends with its sentence. Defined results: null and empty texts hold nothing; each different particular
of a text comes out once; in the redacted text all places are replaced.
"""

from __future__ import annotations

import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from folioflow.llm.pii_table import rows
from folioflow.llm.sentences import sentence_spans

TYPES = ("email", "phone", "id_number", "address", "name")
LABELS = ["O", *(f"{p}-{t}" for t in TYPES for p in "BI")]
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
OFFSETS = (-4, -3, -2, -1, 0, 1, 2, 3)
SCALE = {0: 1.0, 1: 0.6, 2: 0.4, 3: 0.25, 4: 0.25}  # a token's own features lead its neighbours'
_PARTICLES = re.compile(r"(?<![A-Za-zÀ-ɏ])((?:van der|van|von|de) )$")
PAD = "<PAD>"
CHUNK = 300_000  # characters handled at a time
_CJK = "぀-ヿ㐀-鿿豈-﫿々"
_LOCAL = "A-Za-z0-9À-ɏ"
TOKEN = re.compile(
    rf"(?P<EMAIL>[{_LOCAL}][{_LOCAL}._+\-]*+(?:@|\s?\[at\]\s?|\s?\(at\)\s?)[A-Za-z0-9\-]+(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)[A-Za-z0-9\-]+)+)"
    r"|(?P<SPACED>[A-Z]{2}(?: \d{2}){3} [A-Z](?!\w))"
    r"|(?P<CODE>(?=[A-Z0-9]*\d)(?=[A-Z0-9]*[A-Z])[A-Z0-9]{3,}(?!\w))"
    r"|(?P<HOUSE>\d{1,4}[a-z](?!\w))"
    r"|(?P<NUM>\+?\(?\d(?:(?:[ .\-/ ]|\s?\(|\)[\s\-]?)?\d)*(?:-?[A-Z](?!\w))?)"
    rf"|(?P<CJK>[{_CJK}])"
    rf"|(?P<WORD>[^\W\d_{_CJK}]+(?:['’\-][^\W\d_{_CJK}]+)*)"
    r"|(?P<LINE>\n)|(?P<MARK>\S)"
)


_FIND = re.compile(re.sub(r"\(\?P<\w+>", "(?:", TOKEN.pattern))  # the same without names, for all tokens at once


def key_of(token: str) -> str:
    """What features see of a token."""
    kind, s = TOKEN.match(token).lastgroup, token
    if kind == "NUM":
        if s.count("(") != s.count(")") and s.startswith("("):
            s = s[1:]
        i = re.search(r"\d", s).start()
        head = s[i : i + 2]
        return "#" + re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", s[:i]) + (re.sub(r"[1-9]", "9", head) if head[0] == "0" else re.sub(r"\d", "9", head)) + re.sub(r"\d", "9", s[i + 2 :])).replace("\xa0", " ")
    if kind in ("CODE", "SPACED"):
        return "%" + re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", s))
    return {"HOUSE": "~9a", "EMAIL": "<EMAIL>"}.get(kind, s)


def places_of(text: str, tokens: list[str]) -> list[tuple[int, int]]:
    """Where the tokens are; only blanks lie between them. A number doesn't begin with a bracket that it doesn't close."""
    out, at = [], 0
    for t in tokens:
        a = text.find(t, at)
        at = a + len(t)
        out.append((a + (t[0] == "(" and len(t) > 1 and t.count("(") != t.count(")")), at))
    return out


def tokenize(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Keys (what features see) and places of the tokens."""
    tokens = _FIND.findall(text)
    return [key_of(t) for t in tokens], places_of(text, tokens)


def token_features(key: str) -> tuple[list[str], list[str], list[str]]:
    """Features for the token itself, for near and for far neighbours."""
    if key in ("<EMAIL>", PAD, "\n", "~9a"):
        return [key], [key], [key]
    if key[0] in "#%" and len(key) > 1:
        digits = key.count("9") + key.count("0")
        own = [f"k{key[0]}", f"s{key}", f"d{min(digits, 16)}", f"h{key[1:3]}", f"g{re.sub('9+', '9', key)[:12]}", f"p{'-' in key}{'.' in key}{' ' in key}{'/' in key}{'(' in key}{'+' in key}{'A' in key}", f"b{digits > 6}{digits > 3}"]
        return own, [own[0], own[-1], f"d{min(digits, 7)}"], [own[-1]]
    low = key.lower()
    if re.match(f"[{_CJK}]", key):
        own = [f"w{key}", "cjk", "kana" if "぀" <= key <= "ヿ" else "han"]
        return own, own, own[:1]
    if not key[0].isalpha():
        return [f"m{key}"], [f"m{key}"], [f"m{key}"]
    shape = "X." if len(key) == 1 and key.isupper() else "XX" if key.isupper() else "Xx" if key[0].isupper() else "xX" if low != key else "xx" if low.upper() != low else "oo"
    cyr = "cyr" if "Ѐ" <= key[0] <= "ӿ" else "lat"
    own = [f"w{low}", f"S{shape}", f"S{shape}{min(len(key), 12)}", f"a{low[:3]}", f"z{low[-3:]}", f"y{low[-2:]}", f"{cyr}{shape}", f"-{'-' in key}{shape}"]
    return own, [f"w{low}", f"S{shape}", f"z{low[-3:]}"], [f"w{low}"]


def _features_at(key: str, offset: int) -> list[str]:
    own, near, far = token_features(key)
    return [f"{offset}{f}" for f in (own if offset == 0 else near if abs(offset) <= 2 else far)]


class Field:
    """Weights of the trained field."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, transitions: np.ndarray):
        self.index, self.weights, self.transitions = index, weights, transitions
        allowed = transitions[transitions > -1e3]
        self.certain = float(2 * (allowed.max() - allowed.min()))
        self._ids: dict[str, int] = {}  # rows by token and by key
        self._keys: dict[str, int] = {}
        self._table: np.ndarray | None = None

    def __getstate__(self):
        return {"index": self.index, "weights": self.weights, "transitions": self.transitions}

    def __setstate__(self, state):
        self.__init__(**state)

    def ids(self, tokens: list[str]) -> np.ndarray:
        """Row of each token in the table of summed scores, new tokens added to it; ``PAD`` is none."""
        if len(self._ids) > 300_000:
            self._ids, self._keys, self._table = {}, {}, None
        known = self._ids
        out = list(map(known.get, tokens))
        if None in out:
            before = len(self._keys)
            for i, x in enumerate(out):
                if x is None:
                    t = tokens[i]
                    if (x := known.get(t)) is None:
                        key = PAD if t == PAD else key_of(t)
                        x = known[t] = self._keys.setdefault(key, len(self._keys))
                    out[i] = x
            self._grow(list(itertools.islice(self._keys, before, None)))
        return np.array(out, dtype=np.int64)

    def _grow(self, fresh: list[str]) -> None:
        if not fresh:
            return
        zero = np.zeros(len(LABELS), dtype=np.float32)
        block = np.zeros((len(OFFSETS), len(fresh), len(LABELS)), dtype=np.float32)
        for i, k in enumerate(fresh):
            own, near, far = token_features(k)
            for j, o in enumerate(OFFSETS):
                s = zero
                for f in own if o == 0 else near if abs(o) <= 2 else far:
                    at = self.index.get(f"{o}{f}")
                    if at is not None:
                        s = s + self.weights[at]
                block[j, i] = s
        self._table = block if self._table is None else np.concatenate([self._table, block], axis=1)

    def emissions(self, tokens: list[str]) -> np.ndarray:
        """Scores of one long run of tokens."""
        n = len(tokens)
        pad = max(map(abs, OFFSETS))
        ids = self.ids([PAD] * pad + tokens + [PAD] * pad)
        out = np.zeros((n, len(LABELS)), dtype=np.float32)
        for j, o in enumerate(OFFSETS):
            out += self._table[j].take(ids[pad + o : pad + o + n], axis=0)
        return out

    def decode(self, emit: np.ndarray) -> np.ndarray:
        """Best labels of one long run of tokens."""
        n = len(emit)
        best = np.zeros(n, dtype=np.int8)
        open_ = ~(emit[:, 0] - emit[:, 1:].max(axis=1) > self.certain)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        order = np.argsort(ends - starts, kind="stable")
        starts, lengths = starts[order], (ends - starts)[order]
        t_ = self.transitions.astype(np.float32)
        into = np.ascontiguousarray(t_.T)
        at = 0
        while at < len(starts):
            size, stop = 0, at  # paths of like lengths together
            while stop < len(starts) and (stop == at or (lengths[stop] <= 2 * lengths[at] + 8 and (size := size + int(lengths[stop])) < 200_000)):
                stop += 1
            s, ln = starts[at:stop], lengths[at:stop]
            most = int(ln[-1])
            score = t_[0][None, :] + emit[s]  # the label before is O
            back = np.zeros((most, len(s), len(LABELS)), dtype=np.int8)
            for t in range(1, most):
                live = int(np.searchsorted(ln, t, side="right"))
                step = score[live:, None, :] + into[None]  # of each label to come, from each before
                top = step.argmax(axis=2)
                back[t, live:] = top
                score[live:] = np.take_along_axis(step, top[:, :, None], axis=2)[:, :, 0] + emit[s[live:] + t]
            last = (score + t_[:, 0][None, :]).argmax(axis=1)  # and the one after
            for t in range(most - 1, -1, -1):
                live = int(np.searchsorted(ln, t, side="right"))
                rows_ = np.arange(live, len(s))
                best[s[live:] + t] = last[live:]
                if t:
                    last[live:] = back[t, rows_, last[live:]]
            at = stop
        return best


def in_context(table: list, plain: list[str], seed: int = 5) -> list:
    """Each labelled text between plain ones, and plain ones alone, with line and list marks."""
    r = random.Random(seed)
    out = []
    short = [x for x in plain if len(x) < 90] or plain
    for text, spans in table:
        p, q = r.choice(short), r.choice(short)
        pre = r.choice(["", "\n", p + " ", p + " ", p + "\n", "\n- ", "\n+ ", "\n  ", f"\n{r.randint(1, 40)}. ", "。" if text[-1:] == "。" else p + "[^3] "])
        post = r.choice(["", "\n", " " + q, " " + q, "\n" + q, "\n\n" + q, "[^12]\n"])
        out.append((pre + text + post, [(a + len(pre), b + len(pre), k) for a, b, k in spans]))
    for p in plain:
        out.append((r.choice([p, "\n" + p, f"\n{r.randint(1, 40)}. {p}\n", f"{p} {r.choice(short)}", f"\n## {p}\n", f"- {p}\n- {r.choice(short)}"]), []))
    return out


PLAIN = ["The committee restored the caption of figure 3.", "Der Ausschuss löschte die Überschrift des Kapitels.", "Le comité a gardé la première phrase.", "El comité revisó la lista de fuentes.", "委员会删除了第一句话。", "Комитет сократил раздел о методе."]
PLAIN_EACH = 40  # plain sentences a language


def plain_sentences(samples: list[tuple[str | None, str]], each: int = PLAIN_EACH, share: float = 0.012) -> list[str]:
    """Sentences in which every word is usual in its language's documents and no number is
    long: they hold nothing. ``samples`` are (language, text) of a bounded sample."""
    by: dict[str, list[str]] = {}
    for lang, text in samples:
        if lang and text:
            by.setdefault(lang, []).append(text)
    out = []
    for lang in sorted(by):
        seen: dict[str, int] = {}
        for text in by[lang]:
            for w in set(tokenize(text)[0]):
                seen[w] = seen.get(w, 0) + 1
        least = max(3, (share if lang not in ("ja", "zh") else 0.05) * len(by[lang]))
        kept: dict[str, None] = {}
        for text in by[lang]:
            for line in text.split("\n"):
                for a, b in sentence_spans(line):
                    s = line[a:b]
                    keys = tokenize(s)[0]
                    if 3 <= len(keys) <= 40 and all((k[0] == "#" and sum(map(str.isdigit, k)) <= 4) or (k[0] not in "<%#" and seen[k] >= least) for k in keys):
                        kept[s] = None
            if len(kept) >= 20 * each:
                break
        # spread over the documents; scripts written a character at a time need more
        most = each * (4 if lang in ("ja", "zh") else 1)
        out += random.Random(7).sample(sorted(kept), min(most, len(kept)))
    return out or PLAIN


def train(table: list[tuple[str, list[tuple[int, int, str]]]] | None = None, plain: list[str] | None = None, rounds: int = 100, decay: float = 7e-5, rate: float = 0.25) -> Field:
    """Fit the field; ``plain`` are texts that hold nothing."""
    table = in_context(rows() if table is None else table, plain or PLAIN)
    index: dict[str, int] = {}
    words, toks, golds = [], [], []
    for text, spans in table:
        keys, places = tokenize(text)
        if not keys:
            continue
        y = np.zeros(len(keys), dtype=np.int64)
        for a, b, kind in spans:
            inside = [i for i, (p, q) in enumerate(places) if p < b and q > a]
            for k, i in enumerate(inside):
                y[i] = 1 + 2 * TYPES.index(kind) + (k > 0)
        golds.append(y)
        toks.append(len(keys))
        words.append(keys)
    L = len(LABELS)
    by_length = np.argsort([-n for n in toks], kind="stable").tolist()  # the longest first: at a step those still going on come first
    toks, golds, words = [toks[i] for i in by_length], [golds[i] for i in by_length], [words[i] for i in by_length]
    S, most, lengths = len(toks), toks[0], np.array(toks)
    going = np.searchsorted(-lengths, -np.arange(most + 1), side="left")  # how many are longer than i
    mask = np.arange(most)[None, :] < lengths[:, None]
    place = np.where(mask, (np.concatenate([[0], np.cumsum(lengths)[:-1]]))[:, None] + np.arange(most)[None, :], 0)
    # a token's scores at an offset depend on its key alone: features are summed once for each (key, offset)
    pad = max(map(abs, OFFSETS))
    known: dict[str, int] = {PAD: 0}
    stream = [0] * pad
    at = []
    for keys in words:
        at += range(len(stream), len(stream) + len(keys))
        stream += [known.setdefault(k, len(known)) for k in keys] + [0] * pad
    stream_, at_ = np.array(stream), np.array(at)
    combos, which = np.unique(np.stack([stream_[at_ + o] * len(OFFSETS) + j for j, o in enumerate(OFFSETS)], axis=1), return_inverse=True)
    which = which.reshape(len(at), len(OFFSETS))
    names = list(known)
    feats = [[index.setdefault(f, len(index)) for f in _features_at(names[c // len(OFFSETS)], OFFSETS[c % len(OFFSETS)])] for c in combos.tolist()]
    flat = np.concatenate([np.array(f) for f in feats])
    owner = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    combo_start = np.concatenate([[0], np.cumsum([len(f) for f in feats])[:-1]])
    by_feature = np.argsort(flat, kind="stable")
    feature_start = np.searchsorted(flat[by_feature], np.arange(len(index)))
    by_combo = np.argsort(which.ravel(), kind="stable")
    token_of, use_start = by_combo // len(OFFSETS), np.searchsorted(which.ravel()[by_combo], np.arange(len(combos)))
    gold = np.concatenate(golds)
    one = np.zeros((len(gold), L), dtype=np.float32)
    one[np.arange(len(gold)), gold] = 1.0
    banned = np.zeros((L, L), dtype=bool)
    for j in range(2, L, 2):  # an inside label follows its own type only
        banned[:, j] = True
        banned[[j - 1, j], j] = False
    observed = np.zeros((L, L))
    for y in golds:
        np.add.at(observed, (np.concatenate([[0], y]), np.concatenate([y, [0]])), 1)
    w, t = np.zeros((len(index), L), dtype=np.float32), np.zeros((L, L))
    m_w, v_w, m_t, v_t = np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)
    scale = np.array([SCALE[abs(int(f[: 1 + (f[0] == "-")]))] for f in index], dtype=np.float32)[:, None]
    for step in range(1, rounds + 1):
        emit = np.add.reduceat((w * scale)[flat], combo_start, axis=0)[which].sum(axis=1)
        ex = np.exp(emit - emit.max(axis=1, keepdims=True))[place]  # scaled: sums and products instead of logarithms
        tr = np.where(banned, 0.0, np.exp(t)).astype(np.float32)
        alpha, beta = np.zeros((S, most, L), dtype=np.float32), np.zeros((S, most, L), dtype=np.float32)
        x = tr[0][None] * ex[:, 0]
        alpha[:, 0] = x / x.sum(axis=1, keepdims=True)
        for i in range(1, most):
            n = going[i]
            x = (alpha[:n, i - 1] @ tr) * ex[:n, i]
            alpha[:n, i] = x / x.sum(axis=1, keepdims=True)
        beta[np.arange(S), lengths - 1] = tr[:, 0] / tr[:, 0].sum()
        pair = np.zeros((L, L))
        for i in range(most - 2, -1, -1):
            n = going[i + 1]
            y = ex[:n, i + 1] * beta[:n, i + 1]
            x = y @ tr.T
            beta[:n, i] = x / x.sum(axis=1, keepdims=True)
            norm = (alpha[:n, i] * x).sum(axis=1, keepdims=True)
            pair += (alpha[:n, i].T @ (y / norm)) * tr
        marg = (alpha * beta)[mask]
        marg /= marg.sum(axis=1, keepdims=True)
        first = tr[0][None] * ex[:, 0] * beta[:, 0]
        last = alpha[np.arange(S), lengths - 1] * tr[:, 0][None]
        pair[0] += (first / first.sum(axis=1, keepdims=True)).sum(axis=0)
        pair[:, 0] += (last / last.sum(axis=1, keepdims=True)).sum(axis=0)
        g_combo = np.add.reduceat((one - marg)[token_of], use_start, axis=0)
        g_w = np.add.reduceat(g_combo[owner[by_feature]], feature_start, axis=0) * scale / S - decay * w
        g_t = np.where(banned, 0.0, (observed - pair) / S - decay * t)
        for p, g, m, v in ((w, g_w, m_w, v_w), (t, g_t, m_t, v_t)):  # Adam
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) * (1 - step / (rounds + 8))
    return Field(index, (w * scale).astype(np.float32), np.where(banned, -1e4, t))


def _name_bounds(text: str, a: int, b: int) -> tuple[int, int]:
    """A name stops at a full stop that ends no initial, and surname first it takes
    the particle before it."""
    for m in re.finditer(r"[.!?。！？]", text[a:b]):
        if not re.search(r"(?:^|[\s.])\w$", text[a : a + m.start()]):
            b = a + m.start()
            break
    m = _PARTICLES.search(text[max(0, a - 16) : a]) if "," in text[a:b] else None
    return (a - len(m.group(1)) if m else a), b


def _sound(kind: str, s: str) -> bool:
    if kind in ("phone", "id_number"):
        return sum(map(str.isdigit, s)) >= 6
    if kind == "email":
        return bool(re.search(r"@|at", s))
    if kind == "address":
        return len(s) > 5
    han = sum("぀" <= c <= "鿿" for c in s)
    return 2 <= len(s) <= 12 if han else " " in s and any(c.isupper() for c in s)


def find(field: Field, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """(start, end, type) of the particulars of each text, in order."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    pad = [PAD] * max(map(abs, OFFSETS))
    at = 0
    while at < len(texts):
        stream: list[str] = []
        parts = []
        size = 0
        while at < len(texts) and (not parts or size < CHUNK):
            t = texts[at]
            if t:
                tokens = _FIND.findall(t)
                parts.append((at, len(stream), tokens))
                stream += tokens
                stream += pad
                size += len(t)
            at += 1
        if not stream:
            continue
        labels = field.decode(field.emissions(stream))
        for i, start, tokens in parts:
            mine = labels[start : start + len(tokens)]
            begins = np.flatnonzero(mine % 2 == 1)
            places = places_of(texts[i], tokens) if len(begins) else []
            for j in begins:
                k = int(j) + 1
                while k < len(mine) and mine[k] == mine[j] + 1:
                    k += 1
                a, b, kind = places[j][0], places[k - 1][1], TYPES[(int(mine[j]) - 1) // 2]
                line = texts[i].find("\n", a, b)
                if line > a:  # nothing goes on over a line's end
                    b = line
                while b > a and texts[i][b - 1] in ".,;:!?。、 \n":
                    b -= 1
                while a < b and not texts[i][a].isalnum() and texts[i][a] not in "+(":
                    a += 1
                if kind == "name":
                    a, b = _name_bounds(texts[i], a, b)
                if kind in ("name", "address"):
                    while a < b and not texts[i][a].isalnum():
                        a += 1
                if b > a and _sound(kind, texts[i][a:b]):
                    out[i].append((a, b, kind))
    return out


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    for a, b, kind in reversed(found):
        text = text[:a] + PLACEHOLDERS[kind] + text[b:]
    return text


def particulars(documents: DataFrame, field: Field, key: str = "doc_id") -> DataFrame:
    """``documents(key, text)`` → ``(key, pii_type, pii_text)``, each different one once."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["text"]]
            got = [(k, *x) for k, t, found in zip(b[key], texts, find(field, texts), strict=True) for x in dict.fromkeys((kind, t[i:j]) for i, j, kind in found)]
            yield pd.DataFrame(got, columns=[key, "pii_type", "pii_text"])

    return documents.select(key, "text").where(F.length("text") > 0).mapInPandas(run, f"{key} {kind}, pii_type string, pii_text string")


def redacted(documents: DataFrame, field: Field, key: str = "doc_id") -> DataFrame:
    """``(key, text, n_found)`` with placeholders; null texts stay null."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["text"]]
            found = find(field, texts)
            yield pd.DataFrame({key: b[key], "text": [redact(t, f) if t else t for t, f in zip(texts, found, strict=True)], "n_found": [len(f) for f in found]})

    return documents.select(key, "text").mapInPandas(run, f"{key} {kind}, text string, n_found bigint")
