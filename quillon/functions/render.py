"""Hits as HTML cards, in the columns themselves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def card(title: Column, link: Column, fragment: Column, before: str = "<b>", after: str = "</b>") -> Column:
    """A titled link over a fragment, of which only the highlighter's marks stay markup."""
    shown = F.replace(F.replace(escaped(fragment), escaped(F.lit(before)), F.lit(before)), escaped(F.lit(after)), F.lit(after))
    return F.concat(F.lit('<article><h3><a href="'), escaped(link), F.lit('">'), escaped(title), F.lit("</a></h3><p>"), shown, F.lit("</p></article>"))


def function_card(name: Column, params: Column, return_type: Column, description: Column) -> Column:
    """A function's signature over its description."""
    signature = F.concat(escaped(name), F.lit("("), escaped(params), F.lit("): "), escaped(return_type))
    return F.concat(F.lit("<article><h3><code>"), signature, F.lit("</code></h3><p>"), escaped(description), F.lit("</p></article>"))
