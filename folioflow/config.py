"""Options of a comparison, checked when made."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class MoveSettings:
    similarity: float = 0.7
    algorithm: str = "token-sort"

    def __post_init__(self):
        if not 0 < self.similarity <= 1:
            raise ValueError("similarity lies above 0 and up to 1")
        from folioflow.kernels.lines import MEASURES

        if self.algorithm not in MEASURES:
            raise ValueError(f"no such measure: {self.algorithm}")


@dataclass(frozen=True)
class PassageSettings:
    min_words: int = 4
    min_chars: int = 15
    max_gap: int = 2
    shared_words: int = 2
    content_letters: int = 4
    edge_run: int = 2
    partial_share: float = 0.8
    rounds: int = 4
    max_pairs: int = 250_000
    rare_share: float = 0.01
    rare_min: int = 20

    def __post_init__(self):
        for name in ("min_words", "min_chars", "edge_run", "rounds", "max_pairs"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} is at least 1")
        for name in ("max_gap", "shared_words", "content_letters", "rare_min"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} is at least 0")
        if not (0 < self.partial_share <= 1 and 0 <= self.rare_share <= 1):
            raise ValueError("shares lie between 0 and 1")


@dataclass(frozen=True)
class Options:
    context: int | None = None
    max_hidden: int = 500
    prose: bool = True
    by_sentence: bool = False
    ignore_whitespace: bool = False
    comments: str = "markers"
    changes: str = "accept-all"
    skip_resolved: bool = True
    empty_comments: bool = False
    move_passages: bool = True
    paragraph_moves: MoveSettings = field(default_factory=MoveSettings)
    sentence_moves: MoveSettings = field(default_factory=lambda: MoveSettings(0.55))
    passages: PassageSettings = field(default_factory=PassageSettings)
    language: str = "guess"
    encoding: str | None = None

    def __post_init__(self):
        if self.comments not in ("markers", "text", "none"):
            raise ValueError("comments is markers, text or none")
        if self.changes not in ("accept-all", "reject-all", "show"):
            raise ValueError("changes is accept-all, reject-all or show")
        if self.context is not None and self.context < 0:
            raise ValueError("context is at least 0")

    @property
    def moves(self) -> MoveSettings:
        return self.sentence_moves if self.by_sentence else self.paragraph_moves

    def context_for(self) -> int:
        return self.context if self.context is not None else 0 if self.prose else 3
