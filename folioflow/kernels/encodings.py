"""Text of unknown encoding: pure Python."""

from __future__ import annotations

BOMS = ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"), (b"\xef\xbb\xbf", "utf-8-sig"))
#: Encodings tried on text that isn't UTF-8; letters usual in running text decide, ties go to the first.
LADDER = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254")
LIKELY = {"cp1252": "éèàçñöüäßáíóúâêîôûåæøìòù’“”–«»", "cp1250": "łżźćńęąśóščřžýáíéěůťďňőű„”", "cp1251": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъ", "cp1253": "αβγδεζηθικλμνξοπρστυφχψωάέήίόύώς", "cp1254": "ışğçöüİ"}


def is_binary(data: bytes) -> bool:
    """A NUL in the first 8,000 bytes, unless a mark says that the text is UTF-16 or UTF-32."""
    return b"\0" in data[:8000] and not any(data.startswith(m) for m, _ in BOMS)


def decode_text(data: bytes, encoding: str | None = None) -> tuple[str, str]:
    """(text, what it was read as): UTF-8 where that fits, else by BOM, else the likeliest of a ladder."""
    if encoding:
        return data.decode(encoding, "replace"), encoding
    for bom, name in BOMS:
        if data.startswith(bom):
            try:
                return data.decode(name), name
            except UnicodeDecodeError:
                break
    try:
        text = data.decode("utf-8")
        if not any("\x80" <= c < "\xa0" for c in text):
            return text, "utf-8"
    except UnicodeDecodeError:
        pass
    best = ("", "", -1e9)
    for name in LADDER:
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        wide = [c for c in text if c > "\x7f"]
        score = sum(c.lower() in LIKELY[name] for c in wide) - 0.5 * sum(not c.isalpha() and c.lower() not in LIKELY[name] for c in wide)
        words = text.split()
        score -= 2 * sum(any(c > "\x7f" and c.isupper() for c in w[1:]) and not w.isupper() for w in words)
        if name in ("cp1251", "cp1253"):  # a word of two scripts is no word
            score -= 3 * sum(any(c.isascii() and c.isalpha() for c in w) and any(c > "\u0370" and c.isalpha() for c in w) for w in words)
        if score > best[2]:
            best = (text, name, score)
    return (best[0], best[1]) if best[1] else (data.decode("latin-1"), "latin-1")
