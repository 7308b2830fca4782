"""Fragments of stored values with the first occurrence of the query marked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Highlighter:
    """Marks the first occurrence of the whole query string, without regard to case, in about
    ``max_size`` characters around it. ``tag_room`` more are allowed for the marks."""

    before: str = "<b>"
    after: str = "</b>"
    max_size: int = 100

    @property
    def tag_room(self) -> int:
        return len(self.before) + len(self.after)

    def column(self, text: Column, query: str) -> Column:
        """The fragment; the whole chain is native, each step over the one before."""
        needle = _java_trim(query)
        at = F.instr(F.lower(text), needle.lower()) - 1 if needle else F.lit(0)
        steps = F.struct(text.alias("t"), at.alias("at"))
        return F.element_at(F.transform(F.transform(F.array(steps), lambda s: self._window(s, len(needle))), self._mark), 1)

    def _window(self, s: Column, n: int) -> Column:
        t, at = s["t"], s["at"]
        start = F.greatest(at - self.max_size // 2, F.lit(0))
        whole = (at < 0) | (start == 0) | (F.length(t) < self.max_size)
        edge = self._edge(t, start)
        begin = F.when(whole, 0).when(edge > at, start).otherwise(edge)
        return F.struct(F.substr(t, begin.cast("int") + 1).alias("t"), F.when(at < 0, -1).otherwise(at - begin).cast("int").alias("at"), F.lit(n).alias("n"))

    @staticmethod
    def _edge(t: Column, start: Column) -> Column:
        """The first blank, line break, tab or full stop at or after ``start``."""
        rest = F.substr(t, start.cast("int") + 1)
        found = F.regexp_instr(rest, F.lit(r"[ \n\t.]"))
        return F.when(found > 0, start + found - 1).otherwise(F.lit(1 << 30))

    def _mark(self, s: Column) -> Column:
        t, at, n = s["t"], s["at"], s["n"]
        marked = F.concat(F.substr(t, F.lit(1), at), F.lit(self.before), F.substr(t, at + 1, n), F.lit(self.after), F.substr(t, at + n + 1))
        full = F.regexp_replace(F.when(at < 0, t).otherwise(marked), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
        most = self.max_size + self.tag_room
        return F.when(F.length(full) > most, F.concat(F.substr(full, F.lit(1), F.lit(most)), F.lit("..."))).otherwise(full)


def _java_trim(s: str) -> str:
    return s.strip("".join(map(chr, range(0x21))))


def format_fragment(text: str, offsets: list[int], before: str = "<b>", after: str = "</b>") -> str:
    """Wrap each (start, length) pair of ``offsets`` in tags."""
    if len(offsets) % 2:
        raise AssertionError("offsets come in pairs of start and length")
    out, at = [], 0
    for start, size in zip(offsets[::2], offsets[1::2], strict=True):
        if start < at or size < 0 or start + size > len(text):
            raise ValueError(f"offset {start}, length {size} is not within the text")
        out += [text[at:start], before, text[start : start + size], after]
        at = start + size
    return "".join(out) + text[at:]


def formatted(text: Column, offsets: Column, before: str = "<b>", after: str = "</b>") -> Column:
    """:func:`format_fragment` of columns: ``offsets`` is an array of starts and lengths in order. An odd
    number of them, or a pair that is not within the text, is an error of the job; null gives null."""
    at = lambda i: F.get(offsets, i)
    pairs = F.floor(F.size(offsets) / 2).cast("int")
    end = lambda i: F.when(i < 0, F.lit(0)).otherwise(at(2 * i) + at(2 * i + 1))
    each = F.transform(F.sequence(F.lit(0), pairs - 1), lambda i: F.concat(F.substr(text, end(i - 1) + 1, at(2 * i) - end(i - 1)), F.lit(before), F.substr(text, at(2 * i) + 1, at(2 * i + 1)), F.lit(after)))
    whole = F.concat(F.array_join(each, ""), F.substr(text, end(pairs - 1) + 1))
    wrong = F.exists(F.sequence(F.lit(0), pairs - 1), lambda i: (at(2 * i) < end(i - 1)) | (at(2 * i + 1) < 0) | (end(i) > F.length(text)))
    odd = F.raise_error(F.lit("offsets come in pairs of start and length")).cast("string")
    out = F.raise_error(F.lit("an offset is not within the text")).cast("string")
    return F.when(text.isNull() | offsets.isNull(), F.lit(None).cast("string")).when(F.size(offsets) % 2 == 1, odd).when(pairs == 0, text).when(wrong, out).otherwise(whole)
