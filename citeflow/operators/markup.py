"""Parts of full-text XML, as column expressions.

A text is split at the opening tags of an element; a piece holds an element as
far as its closing tag, or, where elements of one name are nested, as many
further pieces as it takes until they are closed. Broken markup gives what can be
read of it and never an error; null counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeflow.functions.text import plain


def _pieces(xml: Column, tag: str) -> Column:
    """What follows each opening tag, its attributes first."""
    parts = F.split(F.coalesce(xml, F.lit("")), rf"(?i)<{tag}(?=[\s>])")
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def _content(piece: Column) -> Column:
    """A piece without the rest of its opening tag."""
    return F.substring(piece, F.instr(piece, ">") + 1, F.length(piece))


def elements(xml: Column, tag: str) -> Column:
    """Contents of all elements of that name, those within others of the name
    each by itself."""
    return F.transform(_pieces(xml, tag), lambda p: _content(F.element_at(F.split(p, rf"(?i)</{tag}\s*>"), 1)))


def _first(xml: Column, tag: str) -> Column:
    return plain(F.coalesce(F.try_element_at(elements(xml, tag), F.lit(1)), F.lit("")))


def abstract(xml: Column) -> Column:
    """Text of the first abstract; empty where there is none."""
    return _first(xml, "abstract")


def section(xml: Column, names: list[str], most: int | None = 6000) -> Column:
    """Text of the first section whose title contains one of the names, with
    the sections in it and without its title. most: characters that a card
    holds; None for all."""
    pieces = _pieces(xml, "sec")
    titled = F.transform(pieces, lambda p: F.lower(_first(F.element_at(F.split(p, r"(?i)</sec\s*>"), 1), "title")))
    wanted = F.transform(titled, lambda t: F.exists(F.array(*[F.lit(n.lower()) for n in names]), lambda n: F.contains(t, n)))
    at = F.array_position(wanted, True).cast("int")
    rest = F.slice(pieces, F.greatest(at, F.lit(1)), F.greatest(F.size(pieces) - at + 1, F.lit(0)))

    def take(acc: Column, piece: Column) -> Column:
        parts = F.split(piece, r"(?i)</sec\s*>")
        closed = F.size(parts) - 1
        still = acc["open"] + 1 - closed
        # Where the section closes within the piece, only what precedes that tag is its own.
        own = F.when(still > 0, F.array_join(parts, " ")).otherwise(F.array_join(F.slice(parts, F.lit(1), acc["open"] + 1), " "))
        go = F.struct(F.concat(acc["text"], F.lit(" "), _content(own)).alias("text"), F.when(still > 0, still).otherwise(F.lit(0)).alias("open"), (still <= 0).alias("done"))
        return F.when(acc["done"], acc).otherwise(go)

    body = F.aggregate(rest, F.struct(F.lit("").alias("text"), F.lit(0).alias("open"), F.lit(False).alias("done")), take)["text"]
    text = F.when(at > 0, plain(F.regexp_replace(body, r"(?is)^\s*<title[^>]*>.*?</title\s*>", " "))).otherwise(F.lit(""))
    return text if most is None else F.substring(text, 1, most)


def _some(found: Column, most: int | None) -> Column:
    return found if most is None else F.slice(found, 1, most)


def tables(xml: Column, most: int | None = 5) -> Column:
    """The first tables (None: all), each a list of rows of cell texts."""
    cells = lambda row: F.transform(elements(row, "t[dh]"), plain)
    return F.transform(_some(elements(xml, "table-wrap"), most), lambda t: F.transform(elements(t, "tr"), cells))


def figures(xml: Column, most: int | None = 5) -> Column:
    """The first figures (None: all): (nth, label, caption, href)."""
    link = lambda f: F.split_part(F.split_part(f, F.lit('xlink:href="'), F.lit(2)), F.lit('"'), F.lit(1))
    return F.transform(
        _some(elements(xml, "fig"), most),
        lambda f, i: F.struct((i + 1).alias("nth"), _first(f, "label").alias("label"), _first(f, "caption").alias("caption"), link(f).alias("href")),
    )
