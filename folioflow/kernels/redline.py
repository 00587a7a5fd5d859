"""Word and OpenDocument files with the changes between two versions as tracked changes."""

from __future__ import annotations

import copy
import io
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from folioflow.kernels.documents import DocumentError, W, read_docx
from folioflow.kernels.moves import Row, compare
from folioflow.kernels.words import PLACEHOLDERS, word_ops

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_O = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:dc="http://purl.org/dc/elements/1.1/"'


def pieces(rows: list[Row], old: list[str], new: list[str]) -> list[tuple[str, list[tuple[str, str]]]]:
    """Paragraphs as (what became of the paragraph, [(equal, ins or del, text)])."""
    out = []
    for r in rows:
        if r.i is not None and r.j is not None:
            parts = []
            for tag, i1, i2, j1, j2 in word_ops(old[r.i], new[r.j]):
                if tag == "equal":
                    parts.append(("equal", new[r.j][j1:j2]))
                else:
                    parts += [("del", old[r.i][i1:i2])] * (i2 > i1) + [("ins", new[r.j][j1:j2])] * (j2 > j1)
            out.append(("equal", parts))
        elif r.i is not None:
            out.append(("del", [("del", old[r.i])] if old[r.i] else []))
        else:
            out.append(("ins", [("ins", new[r.j])] if new[r.j] else []))
    return out


def _zip(files: list[tuple[str, str]]) -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files:
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), text)
    return data.getvalue()


def tracked_docx(rows: list[Row], old: list[str], new: list[str], author: str = "Comparison", date: str = "2000-01-01T00:00:00Z") -> bytes:
    n = 0

    def who() -> str:
        nonlocal n
        n += 1
        return f'w:id="{n}" w:author={quoteattr(author)} w:date="{date}"'

    def run(kind: str, text: str) -> str:
        tag = "w:delText" if kind == "del" else "w:t"
        r = f'<w:r><{tag} xml:space="preserve">{escape(text)}</{tag}></w:r>'
        return r if kind == "equal" else f"<w:{kind} {who()}>{r}</w:{kind}>"

    body = []
    for fate, parts in pieces(rows, old, new):
        mark = "" if fate == "equal" else f"<w:pPr><w:rPr><w:{fate} {who()}/></w:rPr></w:pPr>"
        body.append(f"<w:p>{mark}{''.join(run(k, t) for k, t in parts)}</w:p>")
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    return _zip([
        ("[Content_Types].xml", head + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'),
        ("_rels/.rels", head + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'),
        ("word/document.xml", f"{head}<w:document {_W}><w:body>{''.join(body)}</w:body></w:document>"),
    ])


def tracked_odt(rows: list[Row], old: list[str], new: list[str], author: str = "Comparison", date: str = "2000-01-01T00:00:00") -> bytes:
    regions, body = [], []

    def region(kind: str, text: str = "") -> str:
        key = f"c{len(regions) + 1}"
        info = f"<office:change-info><dc:creator>{escape(author)}</dc:creator><dc:date>{date}</dc:date></office:change-info>"
        regions.append(f'<text:changed-region text:id="{key}"><text:{kind}>{info}{f"<text:p>{escape(text)}</text:p>" if kind == "deletion" else ""}</text:{kind}></text:changed-region>')
        return key

    for fate, parts in pieces(rows, old, new):
        out = []
        for k, t in parts:
            t_ = escape(t).replace("  ", " <text:s/>")
            if k == "equal":
                out.append(t_)
            elif k == "ins":
                key = region("insertion")
                out.append(f'<text:change-start text:change-id="{key}"/>{t_}<text:change-end text:change-id="{key}"/>')
            else:
                out.append(f'<text:change text:change-id="{region("deletion", t)}"/>')
        body.append(f'<text:p text:style-name="{fate}">{"".join(out)}</text:p>')
    content = f'<?xml version="1.0" encoding="UTF-8"?><office:document-content {_O} office:version="1.2"><office:body><office:text><text:tracked-changes>{"".join(regions)}</text:tracked-changes>{"".join(body)}</office:text></office:body></office:document-content>'
    manifest = '<?xml version="1.0" encoding="UTF-8"?><manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"><manifest:file-entry manifest:full-path="/" manifest:media-type="application/vnd.oasis.opendocument.text"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>'
    return _zip([("mimetype", "application/vnd.oasis.opendocument.text"), ("META-INF/manifest.xml", manifest), ("content.xml", content)])


def commented_docx(lines: list[str], notes: list[tuple[int, int, int, str]], author: str = "Assessment", date: str = "2000-01-01T00:00:00Z") -> bytes:
    """A Word file of the lines with comments: ``(line, start, end, text)`` in characters of a line.

    Notes outside the lines are left out; overlapping ones keep their own ranges."""
    good = [(k, max(0, a), min(b, len(lines[k])), t) for k, a, b, t in notes if 0 <= k < len(lines) and a < b and t.strip()]
    body = []
    for k, line in enumerate(lines):
        marks = sorted([(a, 1, n) for n, (at, a, _, _) in enumerate(good) if at == k] + [(b, 0, n) for n, (at, _, b, _) in enumerate(good) if at == k])
        out, at = [], 0
        for place, opens, n in [*marks, (len(line), 2, 0)]:
            if place > at:
                out.append(f'<w:r><w:t xml:space="preserve">{escape(line[at:place])}</w:t></w:r>')
                at = place
            if opens == 1:
                out.append(f'<w:commentRangeStart w:id="{n}"/>')
            elif opens == 0:
                out.append(f'<w:commentRangeEnd w:id="{n}"/><w:r><w:commentReference w:id="{n}"/></w:r>')
        body.append(f"<w:p>{''.join(out)}</w:p>")
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    who = f'w:author={quoteattr(author)} w:date="{date}"'
    comments = "".join(f'<w:comment w:id="{n}" {who}><w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p></w:comment>' for n, (_, _, _, t) in enumerate(good))
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return _zip([
        ("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{kind}.document.main+xml"/><Override PartName="/word/comments.xml" ContentType="{kind}.comments+xml"/></Types>'),
        ("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="word/document.xml"/></Relationships>'),
        ("word/_rels/document.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/comments" Target="comments.xml"/></Relationships>'),
        ("word/document.xml", f"{head}<w:document {_W}><w:body>{''.join(body)}</w:body></w:document>"),
        ("word/comments.xml", f"{head}<w:comments {_W}>{comments}</w:comments>"),
    ])


class Redline:
    """Tracked changes put into the new version's own Word file: its styles, tables, notes and parts stay.

    Paragraphs of the body whose text is all in plain runs are marked word by word, run by run, so
    that each piece keeps its format. Others, and rows of tables, that changed are left as they are
    in the new version and counted in ``left``.
    """

    def __init__(self, old: bytes, new: bytes, author: str = "Comparison", date: str = "2000-01-01T00:00:00Z"):
        self.author, self.date, self.numbers, self.left = author, date, 900_000, 0
        with zipfile.ZipFile(io.BytesIO(new)) as z:
            self.parts = [(i, z.read(i)) for i in z.infolist()]
        xml = next((d for i, d in self.parts if i.filename == "word/document.xml"), None)
        if xml is None:
            raise DocumentError("no word/document.xml")
        self.names = [n for _, n in ET.iterparse(io.BytesIO(xml), ("start-ns",))]
        for prefix, uri in self.names:
            if prefix and not prefix.startswith("ns"):
                ET.register_namespace(prefix, uri)
        self.root = ET.fromstring(xml)
        self.body = self.root.find(W + "body")
        lines = lambda data: [(b.kind, PLACEHOLDERS.sub("", b.text)) for b in read_docx(data).blocks if b.kind != "note"]
        self.old, self.new = lines(old), lines(new)

    def _mark(self, kind: str) -> ET.Element:
        self.numbers += 1
        return ET.Element(W + kind, {W + "id": str(self.numbers), W + "author": self.author, W + "date": self.date})

    def _run(self, text: str, like: ET.Element | None, deleted: bool) -> ET.Element:
        r = ET.Element(W + "r")
        if like is not None and (pr := like.find(W + "rPr")) is not None:
            r.append(copy.deepcopy(pr))
        t = ET.SubElement(r, W + ("delText" if deleted else "t"), {"{http://www.w3.org/XML/1998/namespace}space": "preserve"})
        t.text = text
        return r

    def _paragraph_mark(self, p: ET.Element, kind: str) -> None:
        pr = p.find(W + "pPr")
        if pr is None:
            pr = ET.Element(W + "pPr")
            p.insert(0, pr)
        rpr = pr.find(W + "rPr")
        if rpr is None:
            rpr = ET.SubElement(pr, W + "rPr")
        rpr.insert(0, self._mark(kind))

    @staticmethod
    def _plain(p: ET.Element) -> list[tuple[ET.Element, str]] | None:
        """The runs of a paragraph with their texts, or None where it holds more than plain runs."""
        out = []
        for x in p:
            if x.tag in (W + "pPr", W + "bookmarkStart", W + "bookmarkEnd", W + "proofErr"):
                continue
            if x.tag != W + "r" or any(c.tag not in (W + "rPr", W + "t") for c in x):
                return None
            out.append((x, "".join(t.text or "" for t in x.findall(W + "t"))))
        return out

    def _inserted(self, p: ET.Element) -> None:
        for k, x in enumerate(list(p)):
            if x.tag == W + "r":
                m = self._mark("ins")
                p.remove(x)
                p.insert(k, m)
                m.append(x)
        self._paragraph_mark(p, "ins")

    def _deleted(self, text: str) -> ET.Element:
        p = ET.Element(W + "p")
        self._paragraph_mark(p, "del")
        if text:
            m = self._mark("del")
            m.append(self._run(text, None, True))
            p.append(m)
        return p

    def _edited(self, p: ET.Element, runs: list[tuple[ET.Element, str]], old: str, new: str) -> None:
        ends, at = [], 0
        for _, t in runs:
            at += len(t)
            ends.append(at)
        made: list[ET.Element] = []

        def pieces(a: int, b: int) -> list[ET.Element]:
            out, start = [], 0
            for (r, t), end in zip(runs, ends, strict=True):
                x, y = max(a, start), min(b, end)
                if x < y:
                    out.append(self._run(t[x - start : y - start], r, False))
                start = end
            return out

        for tag, i1, i2, j1, j2 in word_ops(old, new):
            if tag == "equal":
                made += pieces(j1, j2)
                continue
            if i2 > i1:
                near = next((r for (r, _), end in zip(runs, ends, strict=True) if end > j1), runs[-1][0] if runs else None)
                m = self._mark("del")
                m.append(self._run(old[i1:i2], near, True))
                made.append(m)
            if j2 > j1:
                m = self._mark("ins")
                m.extend(pieces(j1, j2))
                made.append(m)
        first = next((k for k, x in enumerate(p) if x.tag == W + "r"), len(p))
        for r, _ in runs:
            p.remove(r)
        for k, x in enumerate(made):
            p.insert(first + k, x)

    def _places(self) -> list[tuple[ET.Element, ET.Element] | None]:
        """(parent, paragraph, or for a row its table) of each line of the new version, None for what can't be placed."""
        found: list[tuple[ET.Element, ET.Element]] = []

        def walk(node: ET.Element) -> None:
            for x in node:
                if x.tag == W + "p":
                    found.append((node, x))
                elif x.tag == W + "tbl":
                    found.extend([(node, x)] * len(list(x.iter(W + "tr"))))
                elif x.tag in (W + "sdt", W + "sdtContent"):
                    walk(x)

        walk(self.body)
        if len(found) == len(self.new):
            return found
        out: list[tuple[ET.Element, ET.Element] | None] = []
        k = 0  # paragraphs that the reader leaves out (contents tables, joined ones): by their texts
        for kind, text in self.new:
            fits = lambda x: x[1].tag == W + "tbl" if kind == "row" else x[1].tag == W + "p" and "".join(t.text or "" for t in x[1].iter(W + "t")) == text  # noqa: B023, E731
            at = next((n for n in range(k, len(found)) if fits(found[n])), None)
            out.append(None if at is None else found[at])
            k = k if at is None else at + 1
        return out

    def write(self, options=None) -> bytes:
        from folioflow.config import Options

        options = options or Options()
        places = self._places()
        a, b = [t for _, t in self.old], [t for _, t in self.new]
        rows = compare(a, b, options.moves, options.passages, options.move_passages, options.ignore_whitespace)
        waiting: list[str] = []

        def put(place: tuple[ET.Element, ET.Element] | None) -> None:
            if place is None or not waiting:
                return
            at = list(place[0]).index(place[1])
            for k, text in enumerate(waiting):
                place[0].insert(at + k, self._deleted(text))
            waiting.clear()

        for r in rows:
            if r.j is None:
                waiting.append(a[r.i])
                continue
            place = places[r.j]
            put(place)
            if r.i is not None and a[r.i] == b[r.j]:
                continue
            runs = self._plain(place[1]) if place else None
            if place is None or place[1].tag != W + "p" or (r.i is not None and (runs is None or "".join(t for _, t in runs) != b[r.j])):
                self.left += 1
            elif r.i is None:
                self._inserted(place[1])
            else:
                self._edited(place[1], runs, a[r.i], b[r.j])
        if waiting:  # at the end, before the section's own settings
            at = next((k for k, x in enumerate(self.body) if x.tag == W + "sectPr"), len(self.body))
            for k, text in enumerate(waiting):
                self.body.insert(at + k, self._deleted(text))
        xml = ET.tostring(self.root, encoding="unicode")
        head, _, rest = xml.partition(">")
        for prefix, uri in self.names:  # names that only attributes speak of must stay declared
            if prefix and f"xmlns:{prefix}=" not in head:
                head += f" xmlns:{prefix}={quoteattr(uri)}"
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for info, content in self.parts:
                z.writestr(info, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{head}>{rest}' if info.filename == "word/document.xml" else content)
        return data.getvalue()


def check_redline(data: bytes, old: bytes, new: bytes) -> list[str]:
    """What is wrong with tracked changes: accepting them must give the new text, rejecting them the old one."""
    texts = lambda x, how: [t for b in read_docx(x, how).blocks if b.kind != "note" and (t := PLACEHOLDERS.sub("", b.text))]
    wrong = []
    if texts(data, "accept-all") != texts(new, "accept-all"):
        wrong.append("accepting all changes does not give the new text")
    if texts(data, "reject-all") != texts(old, "accept-all"):
        wrong.append("rejecting all changes does not give the old text")
    return wrong
