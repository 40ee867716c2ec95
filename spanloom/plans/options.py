"""The options of a search, checked against each other."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions import tables as T


@dataclass(frozen=True)
class Options:
    literal: bool = False
    word: bool = False
    ignore_case: bool = False
    comments_only: bool = False
    globs: tuple[str, ...] = ()
    langs: tuple[str, ...] = ()
    tests: str = "include"
    paths: tuple[str, ...] | None = None
    select: str = "all"
    kinds: tuple[str, ...] = ()
    min_references: int = 0
    orphan_context: int = T.ORPHAN_CONTEXT
    #: None: every ranked span, with neither budget nor cap.
    max_tokens: int | None = T.MAX_TOKENS
    #: None: 3 with a budget, no cap without.
    max_per_file: int | None = None
    columns: bool = False
    explain: bool = False
    #: A `.tiktoken` vocabulary; without one, tokens are counted as pieces of the published split.
    vocabulary: str | None = None

    def __post_init__(self) -> None:
        if self.tests not in ("include", "exclude", "only"):
            raise ValueError("tests: include, exclude or only")
        if self.select not in ("all", "declarations", "references"):
            raise ValueError("select: all, declarations or references")
        if self.kinds and self.select == "references":
            raise ValueError("kinds choose declarations; they conflict with references")
        if self.min_references and (self.select != "all" or self.kinds):
            raise ValueError("min_references conflicts with choosing only declarations or references")
        if self.max_tokens is not None and self.max_tokens < 0 or self.orphan_context < 0:
            raise ValueError("no negative budget or context")

    @property
    def declarations_only(self) -> bool:
        return self.select == "declarations" or bool(self.kinds)

    @property
    def cap(self) -> int:
        """Spans from one file; 0 for no cap."""
        return self.max_per_file if self.max_per_file is not None else 0 if self.max_tokens is None else T.MAX_PER_FILE

    @property
    def match_cap(self) -> int | None:
        return None if self.max_tokens is None else T.MATCH_CAP

    @property
    def whole_lines(self) -> int:
        """Declarations of more lines than this are cut to a window."""
        return 1 << 62 if self.max_tokens is None else max(1, self.max_tokens // T.TOKENS_PER_LINE)
