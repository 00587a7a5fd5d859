"""Two files compared as a whole: reading, comments, notes, sentences, rows, formats, panel. Pure Python."""

from __future__ import annotations

from dataclasses import dataclass, field

from folioflow.config import Options
from folioflow.kernels import prose as K
from folioflow.kernels.documents import DocumentError, document_kind, read_docx, read_odt
from folioflow.kernels.encodings import decode_text, is_binary
from folioflow.kernels.moves import Row, compare
from folioflow.kernels.words import MARKS, PLACEHOLDERS, placeholder, placeholder_number

Runs = list[tuple[int, int, str]]


@dataclass
class Line:
    text: str
    label: str
    runs: Runs = field(default_factory=list)
    language: str | None = None


@dataclass
class Side:
    """One file: its lines, the comments its placeholders stand for, what it was read as."""

    lines: list[Line] = field(default_factory=list)
    comments: list[tuple[str, str, str]] = field(default_factory=list)
    kind: str = "text"
    read_as: str = ""


def read_side(path: str, data: bytes | None, options: Options) -> Side:
    """A file as lines; ``DocumentError`` where it holds no text."""
    if not data:
        return Side()
    suffix = path.rpartition("/")[2].rpartition(".")[2].lower()
    if suffix in ("docx", "odt"):
        kind = document_kind(data)
        if kind is None:
            raise DocumentError("neither a Word nor an OpenDocument text")
        doc = (read_docx if kind == "docx" else read_odt)(data, options.changes, options.skip_resolved)
        lines = []
        for n, b in enumerate(doc.blocks, 1):
            lead = "• " if b.kind == "item" else ""
            lines.append(Line(lead + b.text, str(n), [(s + len(lead), e + len(lead), k) for s, e, k in b.styles], b.language))
        return Side(lines, [c[:3] for c in doc.comments], kind, kind)
    if is_binary(data):
        raise DocumentError("no text")
    text, read_as = decode_text(data, options.encoding)
    prose = suffix in ("md", "markdown", "qmd", "rmd")
    comments: list[tuple[str, str, str]] = []
    if prose:
        text, comments = K.fold_comments(text, options.empty_comments)
    parts = text.replace("\r\n", "\n").split("\n")
    if parts[-1] == "":
        parts.pop()
    return Side([Line(x, str(n), K.md_styles(x) if prose else []) for n, x in enumerate(parts, 1)], comments, "md" if prose else "text", read_as)


def _kept_runs(old: str, new: str, runs: Runs) -> Runs:
    """Style runs of a text after characters went from it."""
    if old == new or not runs:
        return runs
    place, j = [0], 0
    for c in old:
        j += j < len(new) and new[j] == c
        place.append(j)
    return [(place[s], place[e], k) for s, e, k in runs if place[s] < place[e]]


def _by_sentence(side: Side, language: str | None) -> list[Line]:
    if side.kind in ("docx", "odt"):
        split = [(x.label if len(parts) < 2 else f"{x.label}.{k}", s, x) for x in side.lines for parts in [K.simple_sentences(x.text, x.language or language) or [x.text]] for k, s in enumerate(parts, 1)]
    else:
        by_label = {x.label: x for x in side.lines}
        split = [(label, s, by_label[label.partition(".")[0]]) for label, s in K.split_sentences([x.text for x in side.lines], language)]
    out, at, last = [], 0, None
    for label, s, line in split:
        at = 0 if line is not last else at
        a = max(0, line.text.find(s.strip(), at))
        at, last = a + len(s.strip()), line
        lead = len(s) - len(s.lstrip())
        out.append(Line(s, label, [(max(b, a) - a + lead, min(e, at) - a + lead, k) for b, e, k in line.runs if b < at and e > a], line.language))
    return out


def document_language(side: Side, options: Options) -> str | None:
    """The language given, or with ``document`` the one most letters of the file are marked with."""
    if options.language not in ("guess", "document", "default"):
        return options.language
    letters: dict[str, int] = {}
    for x in side.lines if options.language == "document" else ():
        if x.language:
            letters[x.language] = letters.get(x.language, 0) + sum(map(str.isalpha, x.text))
    return max(sorted(letters), key=letters.get, default=None)


def _renumbered(side: Side, known: dict[tuple[str, str], int]) -> None:
    """Placeholders of both sides by one register of (author, text)."""
    names = {placeholder(k): placeholder(known.setdefault(c[:2], len(known))) for k, c in enumerate(side.comments)}
    table = str.maketrans(names)
    for x in side.lines:
        x.text = x.text.translate(table)


def registered(old: Side, new: Side) -> tuple[list[tuple[str, str, str]], dict[str, str]]:
    """The register of both sides' comments as (author, text, date) and each one's status; placeholders follow it, in place."""
    known: dict[tuple[str, str], int] = {}
    for side in (old, new):
        _renumbered(side, known)
    dates = {c[:2]: c[2] for side in (new, old) for c in side.comments}
    register = [(a, t, dates.get((a, t), "")) for a, t in known]
    on = [{c[:2] for c in side.comments} for side in (old, new)]
    status = {placeholder(k): "unchanged" if key in on[0] and key in on[1] else "new" if key in on[1] else "removed" for key, k in known.items()}
    return register, status


def prepare(old: Side, new: Side, options: Options) -> tuple[list[tuple[str, str, str]], dict[str, str]]:
    """Both sides' lines ready for alignment, in place; the register of comments and each one's status."""
    register, status = registered(old, new)
    if options.comments == "text":
        for side in (old, new):
            for x in side.lines:
                text = K.critic(x.text, [c[:2] for c in register])
                x.text, x.runs = text, x.runs if text == x.text else []
    else:
        shared = {c for c, s in status.items() if s == "unchanged"}
        everything = options.comments == "none"
        pattern = f"[{MARKS}]" if everything else "[" + "".join(sorted(shared)) + "]" if shared else None
        for side in (old, new):
            kept = []
            for x in side.lines:
                text = K.remove_marks(x.text, pattern) if pattern else x.text
                if text.strip() or not x.text.strip() or text == x.text:
                    kept.append(Line(text, x.label, _kept_runs(x.text, text, x.runs), x.language))
            side.lines = kept
    for side in (old, new):
        if options.by_sentence:
            side.lines = _by_sentence(side, document_language(side, options))
        if options.prose and side.kind != "text":
            side.lines = [x for x in side.lines if x.text.strip()]
    return register, status


def _places(old: Side, new: Side) -> list[dict[tuple[str, str], tuple[str, str]]]:
    """For each side, the label and the beginning of the line where a comment stands first."""
    places = []
    for side in (old, new):
        seen: dict[tuple[str, str], tuple[str, str]] = {}
        for x in side.lines:
            for c in "".join(PLACEHOLDERS.findall(x.text)):
                if (k := placeholder_number(c)) < len(side.comments):
                    seen.setdefault(side.comments[k][:2], (x.label, K.remove_marks(x.text)[:60]))
        places.append(seen)
    return places


def _entries(register: list[tuple[str, str, str]], status: dict[str, str], places: list[dict[tuple[str, str], tuple[str, str]]]) -> list[dict]:
    panel = []
    for k, (author, text, date) in enumerate(register):
        s = status[placeholder(k)]
        label, anchor = (places[0] if s == "removed" else places[1]).get((author, text), ("", ""))
        panel.append({"author": author, "text": text, "status": s, "label": label, "anchor": anchor, "date": date})
    return panel


def panel_of_sides(old: Side, new: Side) -> list[dict]:
    """The entries of the comment panel alone; no line is aligned for them."""
    places = _places(old, new)
    return _entries(*registered(old, new), places)


def compare_sides(old: Side, new: Side, options: Options) -> tuple[list[dict], list[dict]]:
    """Rows of the side-by-side table and entries of the comment panel. Sides that are equal but for
    shared comments and the numbers of notes have no rows."""
    places = _places(old, new)
    register, status = prepare(old, new, options)
    panel = _entries(register, status, places)
    a, b = [x.text for x in old.lines], [x.text for x in new.lines]
    match = K.match_footnotes(a, b)
    a2, b2 = K.set_aside(a, b, match)
    names = [{chr(0xF0000 + i): label for i, label in enumerate(side)} for side in (match.keys(), match.values())]
    rows = compare(a2, b2, options.moves, options.passages, options.move_passages, options.ignore_whitespace)
    formats = {}
    for n, r in enumerate(rows):
        if r.kind == "equal" and r.i is not None and r.j is not None and a2[r.i] == b2[r.j]:
            x, y = old.lines[r.i], new.lines[r.j]
            if x.runs != y.runs and a[r.i] == b[r.j]:
                formats[n] = K.format_changes(x.runs, y.runs, y.text)
    if a2 == b2 and not any(formats.values()):
        return [], panel
    out = []
    for n, r in enumerate(rows):
        left, right = None if r.i is None else old.lines[r.i], None if r.j is None else new.lines[r.j]
        said = [K.restore([K.restore([c], names[0])[0]], names[1])[0] for c in r.changes]
        out.append(_row(n, r, left, right, said, formats.get(n, [])))
    return out, panel


def _row(n: int, r: Row, left: Line | None, right: Line | None, changes: list[str], formats: list[str]) -> dict:
    plain = r.plain or (r.words_added, r.words_removed)
    return {
        "row_no": n + 1, "kind": r.kind, "left_no": None if r.i is None else r.i + 1, "right_no": None if r.j is None else r.j + 1, "left_label": left and left.label, "right_label": right and right.label,
        "old_line": left and left.text, "new_line": right and right.text, "changes": changes, "words_added": r.words_added, "words_removed": r.words_removed, "move_pair": r.move, "edited": r.edited,
        "moved_out": [left.text[s:e] for s, e, _ in r.out_spans] if left else [], "moved_in": [right.text[s:e] for s, e, _ in r.in_spans] if right else [], "words_added_plain": plain[0], "words_removed_plain": plain[1],
        "formats": formats, "language": (right or left).language,
    }
