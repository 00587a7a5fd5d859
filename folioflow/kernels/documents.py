"""Word and OpenDocument files to blocks of text: pure Python over the zipped XML.

A block is ``(kind, level, text, styles)`` with ``kind`` one of p, heading, item, row, note;
``styles`` are runs ``(start, end, name)``. Tracked changes are accepted, rejected or shown
(as ``[-...-]`` and ``{+...+}``); comments become private-use characters whose number is the
place of ``(author, text, date, resolved)`` in the list of comments.
"""

from __future__ import annotations

import io
import zipfile
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET

from folioflow.kernels.words import placeholder

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
W14 = "{http://schemas.microsoft.com/office/word/2010/wordml}"
W15 = "{http://schemas.microsoft.com/office/word/2012/wordml}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
OFFICE = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
STYLE = "{urn:oasis:names:tc:opendocument:xmlns:style:1.0}"
FO = "{urn:oasis:names:tc:opendocument:xmlns:xsl-fo-compatible:1.0}"
DRAWING = "{urn:oasis:names:tc:opendocument:xmlns:drawing:1.0}"
SVG = "{urn:oasis:names:tc:opendocument:xmlns:svg-compatible:1.0}"
DC = "{http://purl.org/dc/elements/1.1/}"


class DocumentError(ValueError):
    """The file can't be read as what its name says."""


@dataclass
class Block:
    kind: str
    level: int
    text: str
    styles: list[tuple[int, int, str]] = field(default_factory=list)
    language: str | None = None


@dataclass
class Document:
    blocks: list[Block] = field(default_factory=list)
    comments: list[tuple[str, str, str, bool]] = field(default_factory=list)

    def lines(self) -> list[str]:
        return [("• " if b.kind == "item" else "") + b.text for b in self.blocks]


class _Writer:
    def __init__(self, changes: str):
        self.changes = changes
        self.parts: list[str] = []
        self.size = 0
        self.styles: list[tuple[int, int, str]] = []
        self.letters: dict[str, int] = {}  # letters of the block by the language they are marked with

    def language(self) -> str | None:
        """The language with most letters since the last block, the first of equals."""
        best = max(self.letters, key=self.letters.get, default=None)
        self.letters = {}
        return best

    def add(self, text: str, names: tuple[str, ...] = (), change: str | None = None, language: str | None = None) -> None:
        if not text or (change == "ins" and self.changes == "reject-all") or (change == "del" and self.changes == "accept-all"):
            return
        if language and (n := sum(map(str.isalpha, text))):
            self.letters[language] = self.letters.get(language, 0) + n
        if change and self.changes == "show":
            text = "{+" + text + "+}" if change == "ins" else "[-" + text + "-]"
        for n in names:
            if self.styles and self.styles[-1][2] == n and self.styles[-1][1] == self.size:
                self.styles[-1] = (self.styles[-1][0], self.size + len(text), n)
            else:
                self.styles.append((self.size, self.size + len(text), n))
        self.parts.append(text)
        self.size += len(text)

    def take(self) -> tuple[str, list[tuple[int, int, str]]]:
        out = "".join(self.parts), self.styles
        self.parts, self.size, self.styles = [], 0, []
        return out


def _parts(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise DocumentError("not a zipped document") from e


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    try:
        return ET.fromstring(z.read(name))
    except KeyError:
        return None
    except ET.ParseError as e:
        raise DocumentError(f"{name} is no XML") from e


def _math(node: ET.Element) -> str:
    """Office Math in one line."""
    tag = node.tag.removeprefix(M)
    get = lambda name: "".join(_math(c) for x in node.findall(M + name) for c in x)
    if tag == "t":
        return node.text or ""
    if tag == "f":
        return f"({get('num')})/({get('den')})"
    if tag == "sSup":
        return f"{get('e')}^({get('sup')})"
    if tag == "sSub":
        return f"{get('e')}_({get('sub')})"
    if tag == "rad":
        return f"√({get('e')})"
    return "".join(_math(c) for c in node)


def read_docx(data: bytes, changes: str = "accept-all", skip_resolved: bool = True) -> Document:
    with _parts(data) as z:
        body = _xml(z, "word/document.xml")
        if body is None:
            raise DocumentError("no word/document.xml")
        styles: dict[str, tuple[str, str | None]] = {}
        said: dict[str, str] = {}  # languages that styles set
        usual: str | None = None
        for s in (root := _xml(z, "word/styles.xml")) is not None and root.findall(W + "style") or []:
            n = s.find(W + "name")
            based = s.find(W + "basedOn")
            tongue = s.find(f"{W}rPr/{W}lang")
            if tongue is not None and tongue.get(W + "val"):
                said[s.get(W + "styleId", "")] = tongue.get(W + "val", "")
            styles[s.get(W + "styleId", "")] = ((n.get(W + "val", "") if n is not None else "").lower(), based.get(W + "val") if based is not None else None)
        if root is not None and (tongue := root.find(f"{W}docDefaults/{W}rPrDefault/{W}rPr/{W}lang")) is not None:
            usual = tongue.get(W + "val")
        notes: dict[tuple[str, str], ET.Element] = {}
        for kind in ("footnote", "endnote"):
            for x in (root := _xml(z, f"word/{kind}s.xml")) is not None and root.findall(W + kind) or []:
                if x.get(W + "type") in (None, "normal"):
                    notes[kind, x.get(W + "id", "")] = x
        doc = Document()
        done: set[str] = set()
        for x in (root := _xml(z, "word/commentsExtended.xml")) is not None and list(root) or []:
            if x.get(W15 + "done") == "1":
                done.add(x.get(W15 + "paraId", ""))
        comment_at: dict[str, int] = {}
        for c in (root := _xml(z, "word/comments.xml")) is not None and root.findall(W + "comment") or []:
            text = "\n".join("".join(t.text or "" for t in p.iter(W + "t")) for p in c.iter(W + "p")).strip()
            resolved = any(p.get(W14 + "paraId") in done for p in c.iter(W + "p"))
            if text and not (resolved and skip_resolved):
                comment_at[c.get(W + "id", "")] = len(doc.comments)
                doc.comments.append((c.get(W + "author", ""), text, c.get(W + "date", ""), resolved))
    w = _Writer(changes)
    order: list[tuple[str, str]] = []

    def style_of(p: ET.Element) -> tuple[str, int]:
        pr = p.find(W + "pPr")
        if pr is None:
            return "p", 0
        name, hops = pr.find(W + "pStyle"), 0
        key = name.get(W + "val") if name is not None else None
        while key and hops < 10:
            label, parent = styles.get(key, (key.lower(), None))
            if label in ("title",):
                return "heading", 1
            if label.startswith("heading") and label[-1:].isdigit():
                return "heading", int(label[-1])
            if label.startswith("list"):
                return "item", 0
            if label.startswith("toc"):
                return "toc", 0
            key, hops = parent, hops + 1
        return ("item", 0) if pr.find(W + "numPr") is not None else ("p", 0)

    def spoken(key: str | None) -> str | None:
        """The language of a style, its own or inherited."""
        hops = 0
        while key and hops < 10:
            if key in said:
                return said[key]
            key, hops = styles.get(key, ("", None))[1], hops + 1
        return None

    here: list[str | None] = [None]  # the language of the paragraph

    def run(r: ET.Element, change: str | None, link: bool) -> None:
        pr = r.find(W + "rPr")
        names = ["link"] if link else []
        language = here[0]
        if pr is not None:
            own, style = pr.find(W + "lang"), pr.find(W + "rStyle")
            language = (own.get(W + "val") if own is not None else None) or (spoken(style.get(W + "val")) if style is not None else None) or language
        if pr is not None:
            for tag, n in (("b", "bold"), ("i", "italic"), ("u", "underline"), ("strike", "strike")):
                x = pr.find(W + tag)
                if x is not None and x.get(W + "val") not in ("0", "false", "none"):
                    names.append(n)
            v = pr.find(W + "vertAlign")
            if v is not None and v.get(W + "val") in ("superscript", "subscript"):
                names.append(v.get(W + "val"))
        for x in r:
            if x.tag in (W + "t", W + "delText"):
                w.add(x.text or "", tuple(names), change, language)
            elif x.tag in (W + "tab", W + "br", W + "cr"):
                w.add(" ", tuple(names), change)
            elif x.tag == W + "noBreakHyphen":
                w.add("-", tuple(names), change)
            elif x.tag in (W + "footnoteReference", W + "endnoteReference"):
                key = ("footnote" if x.tag == W + "footnoteReference" else "endnote", x.get(W + "id", ""))
                if key in notes and not (change == "del" and changes == "accept-all") and not (change == "ins" and changes == "reject-all"):
                    if key not in order:
                        order.append(key)
                    w.add(f"[^{order.index(key) + 1}]")
            elif x.tag == W + "drawing":
                d = x.find(f".//{DRAW}docPr")
                says = (d.get("descr") or "") if d is not None else ""
                w.add(f"[image: {says}]" if says else "[image]", (), change)

    def inline(node: ET.Element, change: str | None = None, link: bool = False) -> None:
        for x in node:
            if x.tag == W + "r":
                run(x, change, link)
            elif x.tag in (W + "ins", W + "moveTo"):
                inline(x, "ins", link)
            elif x.tag in (W + "del", W + "moveFrom"):
                inline(x, "del", link)
            elif x.tag == W + "hyperlink":
                inline(x, change, True)
            elif x.tag in (M + "oMath", M + "oMathPara"):
                w.add(_math(x), (), change)
            elif x.tag == W + "commentRangeStart":
                if (k := comment_at.get(x.get(W + "id", ""))) is not None:
                    w.add(placeholder(k))
            elif x.tag in (W + "sdt", W + "smartTag", W + "sdtContent"):
                inline(x, change, link)

    def paragraph(p: ET.Element, out: list[Block], kind: str | None = None) -> None:
        k, level = style_of(p)
        if k == "toc":
            return
        named = p.find(f"{W}pPr/{W}pStyle")
        here[0] = (spoken(named.get(W + "val")) if named is not None else None) or usual
        inline(p)
        mark = p.find(f"{W}pPr/{W}rPr")
        gone = mark is not None and ((mark.find(W + "del") is not None and changes == "accept-all") or (mark.find(W + "ins") is not None and changes == "reject-all"))
        if gone:
            return  # the paragraph's mark is deleted: it goes on in the next one
        text, st = w.take()
        if text or kind != "note":
            out.append(Block(kind or k, level, text, st, w.language()))

    def body_of(node: ET.Element, out: list[Block]) -> None:
        for x in node:
            if x.tag == W + "p":
                paragraph(x, out)
            elif x.tag == W + "tbl":
                for row in x.iter(W + "tr"):
                    cells = []
                    for c in row.findall(W + "tc"):
                        inner: list[Block] = []
                        body_of(c, inner)
                        cells.append(" ".join(b.text for b in inner if b.text))
                    out.append(Block("row", 0, " | ".join(cells)))
            elif x.tag in (W + "sdt", W + "sdtContent"):
                body_of(x, out)

    top = body.find(W + "body")
    body_of(top if top is not None else body, doc.blocks)
    if w.size:
        text, st = w.take()
        doc.blocks.append(Block("p", 0, text, st))
    k = 0
    while k < len(order):  # notes may refer to further notes
        inner: list[Block] = []
        body_of(notes[order[k]], inner)
        doc.blocks.append(Block("note", 0, f"[^{k + 1}]: " + " ".join(b.text.strip() for b in inner if b.text.strip())))
        k += 1
    return doc


def read_odt(data: bytes, changes: str = "accept-all", skip_resolved: bool = True) -> Document:
    with _parts(data) as z:
        root = _xml(z, "content.xml")
        if root is None:
            raise DocumentError("no content.xml")
        more = _xml(z, "styles.xml")
    styles: dict[str, tuple[set[str], str | None, str]] = {}
    said: dict[str, str] = {}
    usual: str | None = None

    def tongue(p: ET.Element) -> str | None:
        language, country = p.get(FO + "language"), p.get(FO + "country")
        return None if not language or language == "none" else language if not country or country == "none" else f"{language}-{country}"

    for r in (more, root):
        for d in r.iter(STYLE + "default-style") if r is not None else ():
            if d.get(STYLE + "family") == "paragraph":
                usual = next((t for p in d.findall(STYLE + "text-properties") if (t := tongue(p))), usual)
    for r in (more, root):
        for s in r.iter(STYLE + "style") if r is not None else ():
            names = set()
            for p in s.findall(STYLE + "text-properties"):
                if t := tongue(p):
                    said[s.get(STYLE + "name", "")] = t
                if p.get(FO + "font-weight") == "bold":
                    names.add("bold")
                if p.get(FO + "font-style") == "italic":
                    names.add("italic")
                if p.get(STYLE + "text-underline-style", "none") != "none":
                    names.add("underline")
                if p.get(STYLE + "text-line-through-style", "none") != "none":
                    names.add("strike")
                at = p.get(STYLE + "text-position", "")
                if at.startswith("super") or at[:1].isdigit() and not at.startswith("0"):
                    names.add("superscript")
                elif at.startswith(("sub", "-")):
                    names.add("subscript")
            styles[s.get(STYLE + "name", "")] = (names, s.get(STYLE + "parent-style-name"), (s.get(STYLE + "display-name") or s.get(STYLE + "name", "")).lower())

    def style_names(key: str | None) -> tuple[str, ...]:
        found: set[str] = set()
        hops = 0
        while key and key in styles and hops < 10:
            found |= styles[key][0]
            key, hops = styles[key][1], hops + 1
        return tuple(sorted(found))

    def spoken(key: str | None) -> str | None:
        hops = 0
        while key and hops < 10:
            if key in said:
                return said[key]
            key, hops = styles.get(key, (set(), None, ""))[1], hops + 1
        return None

    doc, w = Document(), _Writer(changes)
    regions: dict[str, tuple[str, ET.Element | None]] = {}
    for t in root.iter(TEXT + "changed-region"):
        key = t.get(TEXT + "id") or t.get("{http://www.w3.org/XML/1998/namespace}id", "")
        for kind in ("insertion", "deletion"):
            if (x := t.find(TEXT + kind)) is not None:
                regions[key] = ("ins" if kind == "insertion" else "del", x)
    active: list[str] = []
    notes: list[ET.Element] = []

    def change() -> str | None:
        return "ins" if active else None

    def deleted_text(x: ET.Element) -> str:
        return " ".join("".join(p.itertext()) for p in x.iter() if p.tag in (TEXT + "p", TEXT + "h"))

    def inline(node: ET.Element, names: tuple[str, ...] = (), language: str | None = None) -> None:
        w.add(node.text or "", names, change(), language)
        for x in node:
            t = x.tag
            if t == TEXT + "s":
                w.add(" " * int(x.get(TEXT + "c", "1")), names, change())
            elif t in (TEXT + "tab", TEXT + "line-break"):
                w.add(" ", names, change())
            elif t == TEXT + "span":
                inline(x, tuple(dict.fromkeys((*names, *style_names(x.get(TEXT + "style-name"))))), spoken(x.get(TEXT + "style-name")) or language)
            elif t == TEXT + "a":
                inline(x, (*names, "link"), language)
            elif t == TEXT + "note":
                notes.append(x)
                w.add(f"[^{len(notes)}]", (), change())
            elif t == OFFICE + "annotation":
                text = "\n".join("".join(p.itertext()) for p in x.iter(TEXT + "p")).strip()
                resolved = any(v == "true" for k, v in x.attrib.items() if k.endswith("resolved"))
                if text and not (resolved and skip_resolved):
                    who, when = x.find(DC + "creator"), x.find(DC + "date")
                    doc.comments.append(((who.text or "") if who is not None else "", text, (when.text or "") if when is not None else "", resolved))
                    w.add(placeholder(len(doc.comments) - 1))
            elif t == TEXT + "change-start":
                if regions.get(x.get(TEXT + "change-id", ""), ("",))[0] == "ins":
                    active.append(x.get(TEXT + "change-id", ""))
            elif t == TEXT + "change-end":
                if x.get(TEXT + "change-id", "") in active:
                    active.remove(x.get(TEXT + "change-id", ""))
            elif t == TEXT + "change":
                kind, region = regions.get(x.get(TEXT + "change-id", ""), ("", None))
                if kind == "del" and region is not None:
                    w.add(deleted_text(region), names, "del")
            elif t == DRAWING + "frame":
                d = x.find(SVG + "desc")
                says = (d.text or "") if d is not None else ""
                w.add(f"[image: {says}]" if says else "[image]", (), change())
            elif t not in (OFFICE + "annotation-end", TEXT + "tracked-changes"):
                inline(x, names, language)
            w.add(x.tail or "", names, change(), language)

    def body_of(node: ET.Element, out: list[Block], item: bool = False) -> None:
        for x in node:
            if x.tag in (TEXT + "p", TEXT + "h"):
                inline(x, (), spoken(x.get(TEXT + "style-name")) or usual)
                text, st = w.take()
                level = int(x.get(TEXT + "outline-level", "1")) if x.tag == TEXT + "h" else 0
                title = styles.get(x.get(TEXT + "style-name", ""), (set(), None, ""))[2] == "title"
                out.append(Block("heading" if level or title else "item" if item else "p", level or int(title), text, st, w.language()))
            elif x.tag in (TEXT + "list", TEXT + "list-item", TEXT + "list-header"):
                body_of(x, out, True)
            elif x.tag == TABLE + "table":
                for row in x.iter(TABLE + "table-row"):
                    cells = []
                    for c in row.findall(TABLE + "table-cell"):
                        inner: list[Block] = []
                        body_of(c, inner)
                        cells.append(" ".join(b.text for b in inner if b.text))
                    out.append(Block("row", 0, " | ".join(cells)))
            elif x.tag in (TEXT + "section", TEXT + "index-body"):
                body_of(x, out, item)
            elif x.tag == TEXT + "change-start" and regions.get(x.get(TEXT + "change-id", ""), ("",))[0] == "ins":
                active.append(x.get(TEXT + "change-id", ""))
            elif x.tag == TEXT + "change-end" and x.get(TEXT + "change-id", "") in active:
                active.remove(x.get(TEXT + "change-id", ""))

    top = root.find(f"{OFFICE}body/{OFFICE}text")
    if top is None:
        raise DocumentError("no text body")
    body_of(top, doc.blocks)
    k = 0
    while k < len(notes):
        inner: list[Block] = []
        n = notes[k].find(TEXT + "note-body")
        if n is not None:
            body_of(n, inner)
        doc.blocks.append(Block("note", 0, f"[^{k + 1}]: " + " ".join(b.text.strip() for b in inner if b.text.strip())))
        k += 1
    return doc


_MARKS = {"bold": "**", "italic": "*", "strike": "~~"}


def to_markdown(doc: Document) -> str:
    """The document as Markdown, styles as marks around their runs."""
    out = []
    for b in doc.blocks:
        at: dict[int, str] = {}
        for s, e, n in b.styles:
            if n in _MARKS and not b.kind == "heading":
                at[s] = at.get(s, "") + _MARKS[n]
                at[e] = _MARKS[n] + at.get(e, "")
        text = "".join(at.get(i, "") + c for i, c in enumerate(b.text)) + at.get(len(b.text), "")
        out.append("#" * max(1, b.level) + " " + text if b.kind == "heading" else "- " + text if b.kind == "item" else "| " + text + " |" if b.kind == "row" else text)
    return "\n\n".join(out)


def document_kind(data: bytes) -> str | None:
    """docx or odt by what lies in the zip, None for anything else."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            if "word/document.xml" in names:
                return "docx"
            if "mimetype" in names and z.read("mimetype").startswith(b"application/vnd.oasis.opendocument.text"):
                return "odt"
    except zipfile.BadZipFile:
        pass
    return None
