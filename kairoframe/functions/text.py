"""Text for pages, requests and file names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bound

# Characters that HTML gives a meaning, the ampersand first.
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
# What makes a line an item of a list or a heading, and what marks strong words.
_ITEM, _HEADING, _BOLD, _ITALIC = r"(?U)^([-*]|[0-9]+\.)\s+", r"(?U)^#{1,4}\s", r"\*\*(.+?)\*\*", r"\*(.+?)\*"
_PREFIX = "data:image/jpeg;base64,"


def escape_html(text: Column) -> Column:
    """The text as HTML shows it; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c, name in _ESCAPES:
        out = F.replace(out, F.lit(c), F.lit(name))
    return out


def strip(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^[\s﻿]+|[\s﻿]+$", "")


def markdown_html(text: Column) -> Column:
    """Headings, lists, paragraphs, bold and italic words of a note as HTML; all else is escaped, null is empty."""
    strong = lambda s: F.regexp_replace(F.regexp_replace(escape_html(s), _BOLD, "<b>$1</b>"), _ITALIC, "<i>$1</i>")

    def line(raw: Column) -> Column:
        def shown(x: Column) -> Column:
            item = F.concat(F.lit("<li>"), strong(F.regexp_replace(x, _ITEM, "")), F.lit("</li>"))
            heading = F.concat(F.lit("<h3>"), strong(F.regexp_replace(x, r"(?U)^#+\s*", "")), F.lit("</h3>"))
            html = F.when(x.rlike(_ITEM), item).when(x.rlike(_HEADING), heading).when(x != "", F.concat(F.lit("<p>"), strong(x), F.lit("</p>"))).otherwise("")
            return F.struct(x.rlike(_ITEM).alias("item"), html.alias("html"))

        return bound(strip(raw), shown)

    def joined(lines: Column) -> Column:
        def with_list(x: Column, i: Column) -> Column:
            inside = F.coalesce(F.get(lines, i - 1)["item"], F.lit(False))
            return F.concat(F.when(x["item"] & ~inside, "<ul>").when(~x["item"] & inside, "</ul>").otherwise(""), x["html"])

        end = F.when(F.element_at(lines, -1)["item"], "</ul>").otherwise("")
        return F.concat(F.array_join(F.transform(lines, with_list), ""), end)

    return bound(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line), joined)


def image_url(data: Column) -> Column:
    """Bytes of an image as an address that holds them."""
    return F.concat(F.lit(_PREFIX), F.regexp_replace(F.base64(data), r"[\r\n]", ""))


def image_bytes(url: Column) -> Column:
    """The bytes that an address holds: what follows its first comma; null if that isn't base64."""
    return F.try_to_binary(F.get(F.split(url, ",", 2), F.lit(1)), F.lit("base64"))


def run_name(time: Column, tag: Column) -> Column:
    """A name for a run's files: the time to the second and the tag, without slashes."""
    return F.concat_ws("_", F.date_format(time, "yyyyMMdd-HHmmss"), F.translate(tag, "/", "_"))


def run_time(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")
