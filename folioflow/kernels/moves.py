"""Rows of the side-by-side table with moved lines and moved passages: pure Python."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from difflib import SequenceMatcher

from folioflow.config import MoveSettings, PassageSettings
from folioflow.kernels.lines import MEASURES, LineIndex, kept, line_pairs, move_key, similarity_tokens
from folioflow.kernels.matching import equal_pairs, greedy_pairs
from folioflow.kernels.sequences import bit_places, lcs_length
from folioflow.kernels.words import TOKEN, WORD, comments_only, describe, quote, word_diff, word_ops


@dataclass
class Row:
    kind: str
    i: int | None
    j: int | None
    changes: list[str] = field(default_factory=list)
    words_added: int = 0
    words_removed: int = 0
    move: int | None = None
    edited: bool = False
    out_spans: list[tuple[int, int, int]] = field(default_factory=list)  # start, end, move
    in_spans: list[tuple[int, int, int]] = field(default_factory=list)
    plain: tuple[int, int] | None = None  # words added and removed before passages were marked


@dataclass(frozen=True)
class Passage:
    row: int
    side: str
    start: int
    end: int
    first: int
    last: int
    line: bool


def _words(text: str) -> int:
    return len(WORD.findall(text))


class Piece:
    """A text with its tokens, their places and its words, worked out once."""

    __slots__ = ("text", "tokens", "starts", "ends", "bag", "pairs", "matcher")

    def __init__(self, text: str):
        found = [m for m in TOKEN.finditer(text) if not m.group().isspace()]
        self.text = text
        self.tokens = [m.group() for m in found]
        self.starts, self.ends = [m.start() for m in found], [m.end() for m in found]
        self.bag = Counter(self.tokens)
        self.pairs = set(zip(self.tokens, self.tokens[1:]))  # neighbours
        self.matcher: SequenceMatcher | None = None  # made when something is first matched with the whole of it


_piece = kept(Piece)


@kept
def content_words(text: str, letters: int) -> Counter:
    """Case-folded words of at least so many letters, with how often they occur."""
    return Counter(w for x in WORD.findall(text) if len(w := x.casefold()) >= letters)


def long_enough(text: str, s: PassageSettings) -> bool:
    return _words(text) >= s.min_words and len("".join(text.split())) >= s.min_chars


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    t = text[a:b]
    return a + len(t) - len(t.lstrip()), b - len(t) + len(t.rstrip())


def plain_rows(old: list[str], new: list[str], moves: MoveSettings, ignore_whitespace: bool = False) -> list[Row]:
    rows = []
    for tag, i, j in line_pairs(old, new, moves.similarity, ignore_whitespace, moves.algorithm):
        row = Row(tag, i, j)
        if tag == "replace":
            d = word_diff(old[i], new[j])
            if not d["changes"] and (old[i] == new[j] or any(comments_only(old[i][a:b], new[j][c:e]) for t, a, b, c, e in word_ops(old[i], new[j]) if t != "equal")):
                row.kind = "equal"
            row.changes, row.words_added, row.words_removed = d["changes"], d["words_added"], d["words_removed"]
        elif tag == "delete":
            row.changes, row.words_removed = ["removed this line"], _words(old[i])
        elif tag == "insert":
            row.changes, row.words_added = ["added this line"], _words(new[j])
        rows.append(row)
    return rows


def _changed_runs(text: str, ranges: list[tuple[int, int, int]], s: PassageSettings) -> list[tuple[int, int, int, int]]:
    """(start, end, first op, last op) of the runs of changed ranges with few words between them."""
    runs: list[tuple[int, int, int, int]] = []
    for a, b, n in ranges:
        if runs and _words(text[runs[-1][1] : a]) <= s.max_gap:
            runs[-1] = (runs[-1][0], b, runs[-1][2], n)
        else:
            runs.append((a, b, n, n))
    return runs


def passages_of(k: int, row: Row, old: list[str], new: list[str], moves: MoveSettings, s: PassageSettings, with_passages: bool) -> list[Passage]:
    """What of a row may have come from or gone to elsewhere: the whole of a lone line, or an edited line's runs of changes."""
    if row.kind in ("delete", "insert"):
        side, text = ("out", old[row.i]) if row.kind == "delete" else ("in", new[row.j])
        line = move_key(text) is not None
        wanted = (line and moves.similarity < 1) or (with_passages and long_enough(text, s))
        return [Passage(k, side, *_trimmed(text, 0, len(text)), -1, -1, line)] if wanted else []
    if row.kind != "replace" or not with_passages:
        return []
    ops = [(n, op) for n, op in enumerate(word_ops(old[row.i], new[row.j])) if op[0] != "equal" and not comments_only(old[row.i][op[1] : op[2]], new[row.j][op[3] : op[4]])]
    out = []
    for side, text, at in (("out", old[row.i], 1), ("in", new[row.j], 3)):
        for a, b, first, last in _changed_runs(text, [(op[at], op[at + 1], n) for n, op in ops if op[at] < op[at + 1]], s):
            a, b = _trimmed(text, a, b)
            if long_enough(text[a:b], s):
                out.append(Passage(k, side, a, b, first, last, False))
    return out


def shared_core(a: list[str], b: list[str], s: PassageSettings, matcher: SequenceMatcher | None = None) -> tuple[int, int, int, int] | None:
    """Token ranges of what two passages have in common, from the positions they match at.

    Matched positions make runs, and runs with short gaps on both sides make islands. The core
    goes from the beginning of the island with the first long run to the end of the one with the last.
    ``matcher`` knows ``b`` already.
    """
    matcher = matcher or SequenceMatcher(None, "", b, autojunk=False)
    matcher.set_seq1(a)
    runs = matcher.get_matching_blocks()[:-1]
    long = [k for k, r in enumerate(runs) if r.size >= s.edge_run]
    if not long:
        return None
    lo, hi = long[0], long[-1]
    near = lambda x, y: y.a - x.a - x.size <= s.max_gap and y.b - x.b - x.size <= s.max_gap
    while lo > 0 and near(runs[lo - 1], runs[lo]):
        lo -= 1
    while hi + 1 < len(runs) and near(runs[hi], runs[hi + 1]):
        hi += 1
    a1, a2, b1, b2 = runs[lo].a, runs[hi].a + runs[hi].size, runs[lo].b, runs[hi].b + runs[hi].size
    skip = 0
    while a1 + skip < a2 and b1 + skip < b2 and a[a1 + skip] == b[b1 + skip] and a[a1 + skip] in ".,;:!?":
        skip += 1
    return (a1 + skip, a2, b1 + skip, b2) if a1 + skip < a2 and b1 + skip < b2 else None


def best_window(short: list[str], long: list[str], tries: int = 4) -> tuple[int, int]:
    """Where in the longer side the shorter one fits best, widened by half its length each way:
    of the windows with most tokens in common the one that keeps their order best."""
    n, m = len(short), len(long)
    left = Counter(short)  # copies of a token that the window doesn't have yet, below 0 for those beyond
    have, shared = 0, []
    for k, t in enumerate(long):
        if t in left:
            have += left[t] > 0
            left[t] -= 1
        if k >= n and (t := long[k - n]) in left:
            left[t] += 1
            have -= left[t] > 0
        shared.append(have)
    starts = sorted(range(m - n + 1), key=lambda k: -shared[k + n - 1])[:tries]
    where = bit_places(short)
    at = max(starts, key=lambda k: (lcs_length(short, long[k : k + n], where), -k))
    return max(0, at - n // 2), min(m, at + n + n // 2)


def passage_match(x: str | Piece, y: str | Piece, least: float, s: PassageSettings, algorithm: str = "token-sort") -> tuple[float, int, int, int, int] | None:
    """(score, ranges of characters on both sides) of the best common passage of two."""
    x, y = (t if isinstance(t, Piece) else Piece(t) for t in (x, y))
    n, m = len(x.tokens), len(y.tokens)
    if s.edge_run > 1 and x.pairs.isdisjoint(y.pairs):
        return None  # no run of two
    small, large = (x.bag, y.bag) if len(x.bag) < len(y.bag) else (y.bag, x.bag)
    if sum(min(c, large[t]) for t, c in small.items() if t in large) < max(s.min_words, least * min(n, m) / 2):
        return None
    regions = [(0, n, 0, m)]
    if min(n, m) < s.partial_share * max(n, m):
        regions.append((0, n, *best_window(x.tokens, y.tokens)) if n < m else (*best_window(y.tokens, x.tokens), 0, m))
    found = []
    for i1, i2, j1, j2 in regions:
        if j2 - j1 == m:
            y.matcher = y.matcher or SequenceMatcher(None, "", y.tokens, autojunk=False)
        core = shared_core(x.tokens[i1:i2], y.tokens[j1:j2], s, y.matcher if j2 - j1 == m else None)
        if core is None:
            continue
        a1, a2, b1, b2 = x.starts[i1 + core[0]], x.ends[i1 + core[1] - 1], y.starts[j1 + core[2]], y.ends[j1 + core[3] - 1]
        p, q = x.text[a1:a2], y.text[b1:b2]
        if long_enough(p, s) and long_enough(q, s) and (content_words(p, s.content_letters) & content_words(q, s.content_letters)).total() >= s.shared_words:
            alike = 1.0 if p.split() == q.split() else MEASURES[algorithm](similarity_tokens(p), similarity_tokens(q))
            found.append((alike, a1, a2, b1, b2))
    best = max(found, default=None)
    return best if best and best[0] >= least - 1e-9 else None


class MoveSearch:
    """Moved lines and passages of one comparison, marked in its rows."""

    def __init__(self, rows: list[Row], old: list[str], new: list[str], moves: MoveSettings, settings: PassageSettings, with_passages: bool):
        self.rows, self.old, self.new, self.moves, self.settings, self.with_passages = rows, old, new, moves, settings, with_passages
        self.moved = 0
        self.met: set[tuple[Passage, Passage]] = set()
        self.pieces: dict[Passage, Piece] = {}
        self.words: dict[Passage, Counter] = {}

    def line(self, p: Passage) -> str:
        row = self.rows[p.row]
        return self.old[row.i] if p.side == "out" else self.new[row.j]

    def piece(self, p: Passage) -> Piece:
        if p not in self.pieces:
            self.pieces[p] = _piece(self.line(p)[p.start : p.end])
        return self.pieces[p]

    def run(self) -> None:
        gone, came = ([k for k, r in enumerate(self.rows) if r.kind == kind] for kind in ("delete", "insert"))
        for a, b in equal_pairs([move_key(self.old[self.rows[k].i]) for k in gone], [move_key(self.new[self.rows[k].j]) for k in came]):
            self.move_line(gone[a], came[b])
        free = [p for k, r in enumerate(self.rows) for p in passages_of(k, r, self.old, self.new, self.moves, self.settings, self.with_passages)]
        for turn in range(self.settings.rounds):
            taken = greedy_pairs(self.like_lines(free)) if turn == 0 else []
            used = {p for _, *two, _ in taken for p in two}
            if self.with_passages:
                taken += greedy_pairs(self.like_passages(free, used))
            if not taken:
                break
            used = {p for _, *two, _ in taken for p in two}
            left = [rest for _, p, q, match in taken for rest in self.settle(p, q, match)]
            free = [p for p in free if p not in used and self.rows[p.row].kind in ("delete", "insert", "replace")] + left

    def like_lines(self, free: list[Passage]):
        """(rank, out, in, None) of every pair of lines that fits, the likest first."""
        into = [p for p in free if p.side == "in"]
        index = LineIndex({n: self.line(q) for n, q in enumerate(into) if q.line}, self.moves.similarity, self.moves.algorithm)
        for p in free:
            for n, score in index.like(self.line(p)) if p.side == "out" and p.line else ():
                self.met.add((p, into[n]))
                yield (-score, p.row, into[n].row), p, into[n], None

    def like_passages(self, free: list[Passage], used: set[Passage]):
        """(rank, out, in, match) of every pair of passages that fits and could be taken, the likest first.

        Pairs are tried in the order that equal scores are taken in. So a pair that can't be bettered
        is taken for sure, unless one before it was, and its two need no other partner.
        """
        out, into = ([p for p in free if p.side == side] for side in ("out", "in"))
        used = set(used)
        most = 1.0 if self.moves.algorithm in ("token-sort", "token-set") else math.inf  # others may score higher
        for p, q in sorted(self.candidates(out, into), key=lambda x: (x[0].row, x[0].start, x[1].row, x[1].start)):
            if p in used or q in used or (p, q) in self.met or (p.row == q.row and p.first <= q.last and q.first <= p.last):
                continue  # taken, seen before, or an edit in place
            self.met.add((p, q))
            match = passage_match(self.piece(p), self.piece(q), self.moves.similarity, self.settings, self.moves.algorithm)
            if match:
                yield (-match[0], p.row, p.start, q.row, q.start), p, q, match
                if match[0] >= most:
                    used |= {p, q}

    def candidates(self, out: list[Passage], into: list[Passage]) -> list[tuple[Passage, Passage]]:
        """Pairs with content words in common, from an index of the words. Where there are more than
        ``max_pairs`` pairs at all only rare words count, and the pairs with most of them are kept."""
        s = self.settings
        for p in (*out, *into):
            if p not in self.words:
                self.words[p] = content_words(self.line(p)[p.start : p.end], s.content_letters)
        words = {p: self.words[p] for p in (*out, *into)}
        many = len(out) * len(into) > s.max_pairs
        if not many and s.shared_words < 1:
            return [(p, q) for p in out for q in into]
        spread = Counter(w for bag in words.values() for w in bag)
        most = max(s.rare_min, s.rare_share * len(words)) if many else len(words)
        holders: dict[str, list[tuple[int, int]]] = {}
        for n, q in enumerate(into):
            for w, c in words[q].items():
                if spread[w] <= most:
                    holders.setdefault(w, []).append((n, c))
        kept, counted = [], {}
        for m, p in enumerate(out):
            shared: dict[int, int] = {}
            for w, c in words[p].items():
                for n, k in holders.get(w, ()):
                    shared[n] = shared.get(n, 0) + (1 if many else min(c, k))
            if many:
                counted |= {(m, n): c for n, c in shared.items()}
            else:
                kept += [(m, n) for n, c in sorted(shared.items()) if c >= s.shared_words]
        if many:
            kept = sorted(counted, key=lambda x: (-counted[x], x))[: s.max_pairs]
        return [(out[m], into[n]) for m, n in kept]

    def settle(self, p: Passage, q: Passage, match: tuple | None) -> list[Passage]:
        """Marks a pair as moved; what lies before and after the moved part of a passage is free again."""
        if match is None:
            self.move_line(p.row, q.row)
            return []
        self.moved += 1
        left = []
        for z, lo, hi, spans in ((p, *match[1:3], self.rows[p.row].out_spans), (q, *match[3:5], self.rows[q.row].in_spans)):
            spans.append((z.start + lo, z.start + hi, self.moved))
            for a, b in ((z.start, z.start + lo), (z.start + hi, z.end)):
                a, b = _trimmed(self.line(z), a, b)
                if a < b and long_enough(self.line(z)[a:b], self.settings):
                    left.append(Passage(z.row, z.side, a, b, z.first, z.last, False))
        return left

    def move_line(self, a: int, b: int) -> None:
        self.moved += 1
        x, y = self.rows[a], self.rows[b]
        d = word_diff(self.old[x.i], self.new[y.j])
        edited = bool(d["changes"])
        tail = ", edited: " + ", ".join(d["changes"]) if edited else ""
        x.kind, y.kind, x.move, y.move, x.edited, y.edited = "moved-out", "moved-in", self.moved, self.moved, edited, edited
        x.changes, y.changes = [f"moved to line {y.j + 1}{tail}"], [f"moved from line {x.i + 1}{tail}"]
        x.words_removed, x.words_added, y.words_added, y.words_removed = d["words_removed"], 0, d["words_added"], 0


def mark_moves(rows: list[Row], old: list[str], new: list[str], moves: MoveSettings, settings: PassageSettings, with_passages: bool = True) -> list[Row]:
    """Finds moved lines, then moved lines that were edited and moved passages; in place."""
    MoveSearch(rows, old, new, moves, settings, with_passages).run()
    _redraw(rows, old, new)
    return rows


def _outside(a: int, b: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out = []
    for s, e, _ in sorted(spans):
        if e <= a or s >= b:
            continue
        if s > a:
            out.append((a, s))
        a = max(a, e)
    if a < b:
        out.append((a, b))
    return out


def _redraw(rows: list[Row], old: list[str], new: list[str]) -> None:
    """Counts again where passages moved: words that only moved don't count, words edited on the way do."""
    place = {n: (r.i, s, e) for r in rows for s, e, n in r.out_spans}
    into = {n: (r.j, s, e) for r in rows for s, e, n in r.in_spans}
    for r in rows:
        if not r.out_spans and not r.in_spans:
            continue
        r.plain = (r.words_added, r.words_removed)  # the counts as if no passage had moved
        changes, added, removed = [], 0, 0
        if r.kind == "replace":
            ops = word_ops(old[r.i], new[r.j])
        else:
            t = old[r.i] if r.kind == "delete" else new[r.j]
            ops = (("delete", 0, len(t), 0, 0),) if r.kind == "delete" else (("insert", 0, 0, 0, len(t)),)
        for tag, i1, i2, j1, j2 in ops:
            if tag == "equal":
                continue
            o = [old[r.i][a:b] for a, b in _outside(i1, i2, r.out_spans)] if i2 > i1 else []
            n = [new[r.j][a:b] for a, b in _outside(j1, j2, r.in_spans)] if j2 > j1 else []
            if len(o) <= 1 and len(n) <= 1 and (i2 - i1, j2 - j1) == (len("".join(o)), len("".join(n))):
                changes.append(describe("".join(o), "".join(n)))
            else:
                changes += [describe(x, "") for x in o if x.strip()] + [describe("", x) for x in n if x.strip()]
            removed += sum(_words(x) for x in o)
            added += sum(_words(x) for x in n)
        for s, e, k in r.out_spans:
            j, a, b = into[k]
            d = word_diff(old[r.i][s:e], new[j][a:b])
            changes.append(f"moved {quote(old[r.i][s:e])} to line {j + 1}{', edited' if d['changes'] else ''}")
            removed += d["words_removed"]
        for s, e, k in r.in_spans:
            i, a, b = place[k]
            d = word_diff(old[i][a:b], new[r.j][s:e])
            changes.append(f"moved {quote(new[r.j][s:e])} from line {i + 1}{', edited' if d['changes'] else ''}")
            added += d["words_added"]
        r.changes, r.words_added, r.words_removed = changes, added, removed


def compare(old: list[str], new: list[str], moves: MoveSettings | None = None, settings: PassageSettings | None = None, passages: bool = True, ignore_whitespace: bool = False) -> list[Row]:
    """All rows of two lists of lines."""
    moves, settings = moves or MoveSettings(), settings or PassageSettings()
    return mark_moves(plain_rows(old, new, moves, ignore_whitespace), old, new, moves, settings, passages)
