"""Clauses and queries, as the parser makes them or a program does."""

from __future__ import annotations

import enum
from dataclasses import dataclass, field, replace


class Presence(enum.Enum):
    OPTIONAL = "optional"
    REQUIRED = "required"
    PROHIBITED = "prohibited"


class Wildcard(enum.Enum):
    NONE = 0
    LEADING = 1
    TRAILING = 2
    BOTH = 3


@dataclass(frozen=True)
class Clause:
    term: str
    fields: tuple[str, ...] = ()
    boost: float = 1.0
    edit_distance: int | None = None
    use_pipeline: bool = True
    wildcard: Wildcard = Wildcard.NONE
    presence: Presence = Presence.OPTIONAL


@dataclass
class Query:
    """Clauses over the fields of an index."""

    all_fields: tuple[str, ...]
    clauses: list[Clause] = field(default_factory=list)

    def clause(self, c: Clause) -> "Query":
        """Adds a clause: no fields means all, a boost that isn't positive means 1,
        and a term with a wildcard isn't trimmed or stemmed."""
        unknown = [f for f in c.fields if f not in self.all_fields]
        if unknown:
            raise ValueError(f"unknown fields: {', '.join(unknown)}")
        term = c.term
        if c.wildcard in (Wildcard.LEADING, Wildcard.BOTH) and term[:1] != "*":
            term = "*" + term
        if c.wildcard in (Wildcard.TRAILING, Wildcard.BOTH) and term[-1:] != "*":
            term += "*"
        self.clauses.append(replace(c, term=term, fields=tuple(c.fields) or tuple(self.all_fields), boost=c.boost if c.boost > 0 else 1.0, use_pipeline=c.use_pipeline and "*" not in term))
        return self

    def term(self, term: str) -> "Query":
        return self.clause(Clause(term))

    @property
    def is_negated(self) -> bool:
        return bool(self.clauses) and all(c.presence is Presence.PROHIBITED for c in self.clauses)
