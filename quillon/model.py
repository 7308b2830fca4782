"""Configuration of an index and of a search, and the error that carries a message as a value."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field


class SearchError(ValueError):
    """A query that cannot be answered; raised while planning, before any job."""


@dataclass(frozen=True)
class Analyzer:
    """White-space tokens, lower-cased or as they are."""

    lower_case: bool = False

    @classmethod
    def default(cls) -> Analyzer:
        return cls()

    def with_lower_casing(self) -> Analyzer:
        return Analyzer(True)


@dataclass(frozen=True)
class Field:
    """How one column is indexed. ``positions`` allows phrases; ``stored`` allows its value in
    hits. Every field is indexed, whatever ``indexed`` says."""

    name: str
    analyzer: Analyzer = Analyzer()
    stored: bool = True
    indexed: bool = True
    positions: bool = True


@dataclass(frozen=True)
class Schema:
    """Fields of an index; the first is the default one."""

    fields: tuple[Field, ...]
    default_or: bool = True

    @classmethod
    def of(cls, *fields: Field) -> Schema:
        if not fields:
            raise SearchError("a schema needs a field")
        if len({f.name for f in fields}) < len(fields):
            raise SearchError("field names must differ")
        return cls(tuple(fields))

    @property
    def default_field(self) -> Field:
        return self.fields[0]

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def stored(self) -> list[str]:
        return [f.name for f in self.fields if f.stored]

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise SearchError(f"Unsupported field: '{name}'")

    def to_json(self) -> str:
        return json.dumps({"fields": [asdict(f) for f in self.fields], "default_or": self.default_or})

    @classmethod
    def from_json(cls, text: str) -> Schema:
        raw = json.loads(text)
        return cls(tuple(Field(**{**f, "analyzer": Analyzer(**f["analyzer"])}) for f in raw["fields"]), raw["default_or"])


@dataclass(frozen=True)
class SearchRequest:
    """``None`` fields mean all stored ones, an empty list none."""

    query: str
    size: int = 10
    skip: int = 0
    highlight_fields: list[str] | None = field(default_factory=list)
    result_fields: list[str] | None = field(default_factory=list)
    last_term_prefix: bool = False
