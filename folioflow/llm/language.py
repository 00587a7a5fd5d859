"""Languages of documents and of their segments by nearest centroids.

Sentences become normalised TF-IDF vectors of hashed character n-grams. Each language has
several centroids, clustered from labelled sentences; a sentence is compared with all of
them by cosine. Within a document a best path over the sentences' similarities, with a cost
for each change, gives the segments; short sentences follow their neighbours. A segment is
rejected (``UNKNOWN``) where its whole text is too far from its language's centroids: less
like them than a share of what the language's own sentences usually are, or than what those
of its nearest neighbour among the languages are. The share grows with the segment, as longer
texts come nearer to the centroid of their language.

Training: a bounded sample of labelled documents (``sampling.SAMPLE_DOCS`` rows, chosen by
hash). Sentences nearer to another language than their label are left out once and the
centroids fitted again, so some wrong labels do no harm.

Defined results: null and blank texts, and texts without letters, have no segments; text in
a language that wasn't trained, or in none, is a segment of ``und`` with its distance.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from folioflow.llm.sentences import sentence_spans

TRAIN_SENTENCES, TRAIN_EACH = 400, 6  # sentences a language, sentences a text
BITS, ORDERS, CENTROIDS = 15, (1, 2, 3), 3
CHANGE, SHORT, PULL = 0.8, 8, 1.0
REJECT_SHARE, REJECT_MORE = 0.36, 0.10  # of the median similarity of a language's own sentences; more for 200 letters more
REJECT_NEAR, CHANCE, REJECT_FLOOR = 2.0, 0.052, 0.03  # of its neighbour's similarity beyond chance
UNKNOWN = "und"
_NOISE = re.compile(r"\S*[@/\\{}<>=#]\S*|\[\^[^\]]*\]")
_NOISY = re.compile(r"[@/\\{}<>=#^]")
_NONLETTER = re.compile(r"[\W\d_]+")
_DENSE = re.compile(r"[\u3040-\u30ff\u4e00-\u9fff]")
# Marks that name no language, and three-letter codes of the languages known here.
NO_LANGUAGE = {"", "und", "zxx", "none", "x", "mul", "mis", "null", "unknown", "n/a", "qaa"}
THREE = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl", "swe": "sv", "pol": "pl", "rus": "ru", "ukr": "uk", "ell": "el", "gre": "el", "tur": "tr", "ara": "ar", "hin": "hi", "jpn": "ja", "zho": "zh", "chi": "zh", "tha": "th"}


def base_language(tag: str | None) -> str | None:
    """Two-letter language of a tag in any case, region and separator; None for none."""
    if not isinstance(tag, str):
        return None
    t = re.split(r"[-_ ]", tag.strip().lower())[0]
    return None if t in NO_LANGUAGE else THREE.get(t, t)


def letters(text: str) -> int:
    return sum(map(str.isalpha, text))


def normal(text: str) -> str:
    if _NOISY.search(text):
        text = _NOISE.sub(" ", text)
    return _NONLETTER.sub(" ", text.lower()).strip()


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of the n-grams of normalised texts, sorted by row."""
    joined = "\0".join(f" {t} " for t in texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    row = np.cumsum(cp == 0).astype(np.int64)
    codes = []
    mix = np.uint64(0x9E3779B97F4A7C15)
    for n in ORDERS:
        if len(cp) < n:
            continue
        h = np.zeros(len(cp) - n + 1, dtype=np.uint64)
        ok = np.ones(len(h), dtype=bool)
        for k in range(n):
            part = cp[k : len(cp) - n + 1 + k]
            ok &= part != 0
            h = (h ^ part) * mix
            h ^= h >> np.uint64(29)
        if n == 1:
            ok &= cp != 32
        h = (h * mix) >> np.uint64(64 - BITS)
        codes.append((row[: len(h)][ok] << BITS) | h[ok].astype(np.int64))
    code, count = np.unique(np.concatenate(codes), return_counts=True)
    return code >> BITS, code & ((1 << BITS) - 1), count


class Centroids:
    def __init__(self, languages: list[str], owner: np.ndarray, matrix: np.ndarray, idf: np.ndarray, least: np.ndarray):
        self.languages, self.owner, self.matrix, self.idf, self.least = languages, owner, matrix, idf, least
        self._rows: dict[str, int] = {}
        self._table = np.zeros((0, len(languages)), dtype=np.float32)

    def __getstate__(self):
        return self.__dict__ | {"_rows": {}, "_table": self._table[:0]}

    def remembered(self, texts: list[str], most: int = 200_000) -> np.ndarray:
        """``similarities``, worked out once for equal texts; what is remembered is bounded."""
        if len(self._rows) > most:
            self._rows, self._table = {}, self._table[:0]
        rows, before = self._rows, len(self._rows)
        which = np.array([rows.setdefault(t, len(rows)) for t in texts], dtype=np.int64)
        if len(rows) > before:
            fresh = list(itertools.islice(rows, before, None))
            self._table = np.concatenate([self._table, self.similarities(fresh)])
        return self._table[which]

    @staticmethod
    def _vectors(texts: list[str], idf: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        row, feat, count = features(texts)
        if idf is None:
            df = np.bincount(feat, minlength=1 << BITS)
            idf = np.log((1 + len(texts)) / (1 + df)) + 0.3
        val = (1 + np.log(count)) * idf[feat]
        norm = np.sqrt(np.bincount(row, val * val, minlength=len(texts)))
        return row, feat, val / np.maximum(norm[row], 1e-9), idf

    @staticmethod
    def train(samples: dict[str, list[str]], k: int = CENTROIDS, rounds: int = 6) -> Centroids:
        languages = sorted(x for x, s in samples.items() if s)
        texts = [t for x in languages for t in samples[x]]
        lang = np.array([i for i, x in enumerate(languages) for _ in samples[x]])
        row, feat, val, idf = Centroids._vectors(texts, None)
        first = np.searchsorted(row, np.arange(len(texts) + 1))

        def dense(rows: np.ndarray) -> np.ndarray:  # a language at a time: all at once would not fit the driver
            out = np.zeros((len(rows), 1 << BITS), dtype=np.float32)
            for i, r in enumerate(rows.tolist()):
                out[i, feat[first[r] : first[r + 1]]] = val[first[r] : first[r + 1]]
            return out

        keep = np.ones(len(texts), dtype=bool)
        for again in (True, False):
            cents, owner = [], []
            for i in range(len(languages)):
                rows = np.flatnonzero(keep & (lang == i))
                if not len(rows):
                    rows = np.flatnonzero(lang == i)
                x = dense(rows)
                # wrong labels would make a cluster of their own: they are told by the languages' means alone
                c = x[np.linspace(0, len(rows) - 1, 1 if again else min(k, len(rows))).astype(int)].copy()
                for _ in range(1 if again else rounds):
                    at = (x @ c.T).argmax(axis=1)
                    for j in range(len(c)):
                        if (at == j).any():
                            m = x[at == j].mean(axis=0)
                            c[j] = m / max(np.linalg.norm(m), 1e-9)
                size = np.bincount((x @ c.T).argmax(axis=1), minlength=len(c))
                big = size >= 0.1 * len(rows)  # a few odd sentences are no cluster
                mean = x.mean(axis=0)
                mean /= max(np.linalg.norm(mean), 1e-9)
                c = np.vstack([c[big] + PULL * mean, mean])  # pulled to the mean, or a phrase becomes a language
                c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
                cents.append(c)
                owner += [i] * len(c)
            matrix, owner_ = np.vstack(cents), np.array(owner)
            least, like = np.zeros(len(languages)), np.zeros((len(languages), len(languages)))
            for i in range(len(languages)):
                rows = np.flatnonzero(lang == i)
                sims = dense(rows) @ matrix.T
                if again:
                    keep[rows] = owner_[sims.argmax(axis=1)] == i
                own = sims[keep[rows]][:, owner_ == i]
                least[i] = REJECT_SHARE * np.median(own.max(axis=1)) if len(own) else 0.2
                like[i] = [sims[:, owner_ == j].max(axis=1).mean() if j != i else 0.0 for j in range(len(languages))]
            least = np.maximum(REJECT_FLOOR, np.minimum(least, REJECT_NEAR * (like.max(axis=0) - CHANCE))) if len(languages) > 1 else least
        return Centroids(languages, owner_, np.ascontiguousarray(matrix.T.astype(np.float32)), idf, least)

    def similarities(self, texts: list[str], chunk: int = 150_000) -> np.ndarray:
        """Cosine with the nearest centroid of each language, row by row."""
        out = np.zeros((len(texts), len(self.languages)), dtype=np.float32)
        first = np.searchsorted(self.owner, np.arange(len(self.languages)))
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size < chunk):
                size += 3 * len(texts[end])
                end += 1
            row, feat, val, _ = self._vectors(texts[at:end], self.idf)
            if len(row):
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                s = np.add.reduceat(self.matrix[feat] * val.astype(np.float32)[:, None], starts, axis=0)
                out[at + row[starts]] = np.maximum.reduceat(s, first, axis=1)
            at = end
        return out


def training_sentences(sample: list[tuple[str | None, str]], most: int = TRAIN_SENTENCES, each: int = TRAIN_EACH) -> dict[str, list[str]]:
    """Different sentences of each language from a sample of (language mark, text): at most ``each``
    a text, and more of them only where a language has too few texts."""
    samples: dict[str, dict[str, None]] = {}
    spare: dict[str, list[str]] = {}
    for mark, text in sample:
        lang = base_language(mark)
        kept = samples.setdefault(lang, {}) if lang else {}
        if not lang or len(kept) >= most:
            continue
        n = 0
        for line in text.split("\n"):
            for a, b in sentence_spans(line):
                t = normal(line[a:b])
                if t in kept or letters(t) < (8 if _DENSE.search(t) else 20):
                    continue
                if n < each:
                    kept[t] = None
                    n += 1
                elif len(spare.setdefault(lang, [])) < most:
                    spare[lang].append(t)
    return {lang: list(dict.fromkeys([*kept, *spare.get(lang, [])]))[:most] for lang, kept in samples.items()}


def segments(model: Centroids, texts: list[str | None]) -> list[list[tuple[int, int, str, float, float]]]:
    """(start, end, language, confidence, distance from the nearest centroid) of each segment of each text."""
    spans, flat = [], []
    for t in texts:
        found = []
        for a, b in sentence_spans(t):
            s = normal(t[a:b])
            if s:
                found.append((a, b, len(s) - s.count(" ")))
                flat.append(s)
        spans.append(found)
    if not flat:
        return [[] for _ in texts]
    # all sentences of the batch at once: a row a sentence, a column a language
    sims = model.remembered(flat)
    rows = np.arange(len(flat))
    size = np.array([x[2] for found in spans for x in found])
    short = size < SHORT
    weight = np.where(short, 0.1, 1.0) * np.minimum(1.5, np.sqrt(size / 20.0))
    path = sims.argmax(axis=1)
    counts = np.array([len(x) for x in spans])
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    full = np.flatnonzero(counts)
    mixed = np.maximum.reduceat(path, firsts[full]) != np.minimum.reduceat(path, firsts[full])
    for i in full[mixed].tolist():
        at, n = int(firsts[i]), int(counts[i])
        gain = sims[at : at + n] * (weight[at : at + n, None] * 8.0)
        score, back = gain[0].copy(), []
        for j in range(1, n):
            best = int(score.argmax())
            move = score[best] - CHANGE
            back.append(np.where(score >= move, np.arange(len(score)), best))
            score = np.maximum(score, move) + gain[j]
        at_end = [int(score.argmax())]
        for step in reversed(back):
            at_end.append(int(step[at_end[-1]]))
        path[at : at + n] = at_end[::-1]
    own = sims[rows, path]
    sims[rows, path] = -1.0
    margin = own - np.maximum(0.0, sims.max(axis=1))
    confs = (1.0 / (1.0 + np.exp(-12.0 * margin)) * np.where(short, 0.8, 1.0)).tolist()
    low = (own < model.least[path] * (1 + REJECT_MORE / REJECT_SHARE)).tolist()
    own, path = own.tolist(), path.tolist()
    out: list[list] = []
    doubtful = []  # segments that may be too far: their texts are compared whole
    k = 0
    for found in spans:
        res: list[list] = []
        for a, b, n in found:
            z = b - a
            if not res or res[-1][2] != path[k]:
                res.append([a, b, path[k], 0.0, 0.0, 0, 0, 0, k, k])
            r = res[-1]
            r[1], r[9] = b, k + 1
            for at, v in ((3, confs[k] * z), (4, own[k] * z), (5, z), (6, n), (7, n * low[k])):
                r[at] += v
            k += 1
        out.append(res)
        doubtful += [r for r in res if 2 * r[7] >= r[6] >= SHORT]
    if doubtful:
        whole = model.similarities([" ".join(flat[r[8] : r[9]]) for r in doubtful])
        for r, s in zip(doubtful, whole, strict=True):
            share = 1 + REJECT_MORE / REJECT_SHARE * min(1.0, max(0.0, (r[6] - 60) / 200))
            near = float(s[r[2]])
            if near < model.least[r[2]] * share:
                r[2], r[3], r[4] = -1, r[5] / (1.0 + math.exp(-12.0 * (float(model.least[r[2]]) * share - near))), near * r[5]
    names = [*model.languages, UNKNOWN]
    return [[(r[0], r[1], names[r[2]], round(r[3] / max(1, r[5]), 4), round(1 - r[4] / max(1, r[5]), 4)) for r in res] for res in out]


def language_segments(records: DataFrame, key: str, model: Centroids, skip=None) -> DataFrame:
    """``records(key, text, language)`` → ``(key, marked, n_letters, start_pos, end_pos, lang, confidence, distance)``."""
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["text"]]
            if skip:
                texts = [None if s else t for t, s in zip(texts, skip(texts), strict=True)]
            rows = [(k, base_language(m), letters(t), *seg) for k, m, t, found in zip(b[key], b["language"], texts, segments(model, texts), strict=True) if t for seg in found]
            yield pd.DataFrame(rows, columns=[key, "marked", "n_letters", "start_pos", "end_pos", "lang", "confidence", "distance"])

    schema = f"{key} {kind}, marked string, n_letters bigint, start_pos bigint, end_pos bigint, lang string, confidence double, distance double"
    return records.select(key, "text", "language").where(F.length("text") > 0).mapInPandas(run, schema).dropDuplicates([key, "start_pos"])
