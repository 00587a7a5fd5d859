"""Saved answers and projects as JSON with the digests of the texts they speak of."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

FORMAT = 1


class ChangedError(ValueError):
    """The texts are no longer those that the answers were given for."""


def digest(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode("utf-8")).hexdigest()


def save(path: str | Path, answers: list[dict], texts: dict[str, str | bytes]) -> None:
    Path(path).write_text(json.dumps({"format": FORMAT, "answers": answers, "texts": {k: digest(v) for k, v in sorted(texts.items())}}, ensure_ascii=False, indent=1), encoding="utf-8")


def load(path: str | Path, texts: dict[str, str | bytes], fields: set[str] | None = None) -> list[dict]:
    """The answers, refused where a text is missing, new or changed; unknown fields are dropped."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    if data.get("format") != FORMAT:
        raise ValueError(f"format {data.get('format')} isn't known")
    now = {k: digest(v) for k, v in texts.items()}
    wrong = sorted(k for k in {*now, *data["texts"]} if now.get(k) != data["texts"].get(k))
    if wrong:
        raise ChangedError("changed since: " + ", ".join(wrong))
    return [{k: v for k, v in a.items() if fields is None or k in fields} for a in data["answers"]]


def free_name(path: str | Path) -> Path:
    """The path, or beside a locked or existing file the next free numbered one."""
    path = Path(path)
    k, out = 1, path
    while out.exists():
        k += 1
        out = path.with_stem(f"{path.stem} ({k})")
    return out
