"""HTML and wiki markup: small readers of one text, and the Spark jobs that apply them to whole tables.

The readers are plain Python over one page each (markup nests, which column expressions cannot follow); links and redirects need no
nesting and stay column expressions. A null page reads as an empty one.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = (*HEADINGS, "p", "li", "td", "th")
HIDDEN = ("script", "style", "noscript", "nav", "footer")
REDIRECT = r"(?i)^\s*#(?:REDIRECT|перенаправление)\s*\[\[(.*?)\]\]"

#: An opening tag ends open blocks of these kinds, up to the nearest list or table around it.
_ENDS = {"p": ("p",), "li": ("p", "li"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), **{h: ("p",) for h in HEADINGS}}
_FENCES = ("ul", "ol", "table")


class _Page(HTMLParser):
    """(tag, text) of every block in order of its start; a block's text includes that of the blocks inside it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, list[str]]] = []
        self.open: list[tuple[str, list[str]]] = []
        self.loose: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif not self.hidden and (tag in BLOCKS or tag in _FENCES):
            while self.open and self.open[-1][0] in _ENDS.get(tag, ()):
                self.open.pop()
            self.open.append((tag, []))
            if tag in BLOCKS:
                self.found.append(self.open[-1])

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            self.loose.append(data)
            for _, parts in self.open:
                parts.append(data)


def _flat(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


def read_html(html: str | None) -> tuple[list[tuple[str, str]], str]:
    """Blocks (tag, text) that are not blank, and all visible text."""
    page = _Page()
    page.feed(html or "")
    page.close()
    return [(tag, text) for tag, parts in page.found if (text := _flat(parts))], _flat(page.loose)


def html_sections_of(html: str | None, title: str) -> list[tuple[list[str], str]]:
    """(path, text): a heading of level n keeps n entries of the path and adds itself; equal paths share one text.

    A page without blocks is one section with all its visible text; a blank page has none.
    """
    blocks, loose = read_html(html)
    path, texts = [title], {}
    for tag, text in blocks:
        if tag in HEADINGS:
            path = [*path[: int(tag[1])], text]
        else:
            texts.setdefault(tuple(path), []).append(text)
    if not texts and loose:
        return [([title], loose)]
    return [(list(p), " ".join(t)) for p, t in texts.items()]


def connector_text_of(html: str | None) -> str:
    """Headings of levels 1 to 4 as # lines, cells between bars, a blank line between blocks; all visible text if there are none."""
    blocks, loose = read_html(html)

    def line(tag: str, text: str) -> str:
        return f"{'#' * int(tag[1])} {text}" if tag in HEADINGS[:4] else f"| {text} |" if tag in ("td", "th") else text

    return "\n\n".join(line(*b) for b in blocks if b[0] not in HEADINGS[4:]) or loose


def clean_wiki(text: str | None) -> str:
    """Readable text: no comments, references, templates or files; link labels; table rows as cells between bars; no magic words."""
    text = re.sub(r"<!--.*?-->|<ref[^>/]*/>|<ref\b.*?</ref>", "", text or "", flags=re.S)
    text = re.sub(r"^\{\|.*?^\|\}", lambda m: _table(m.group()), text, flags=re.S | re.M)
    text = _without_nested(text, "{{", "}}")
    text = re.sub(r"\[\[(?:file|image|category|файл|категория):[^\[\]]*(?:\[\[[^\[\]]*\]\][^\[\]]*)*\]\]", "", text, flags=re.I)
    text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", r"\1", text)
    text = re.sub(r"\[https?://[^\s\]]+\s+([^\]]+)\]", r"\1", text)
    text = re.sub(r"\[https?://[^\s\]]+\]|'{2,}|<[^<>]+>", "", text).replace("&nbsp;", " ")
    lines = (" ".join(line.split()) for line in text.splitlines())
    return "\n".join(line for line in lines if line and not line.startswith("__"))


def _without_nested(text: str, start: str, end: str) -> str:
    """Drops balanced spans at any depth in one pass; an unclosed start stays."""
    kept, begun = [], []
    for part in re.split(f"({re.escape(start)}|{re.escape(end)})", text):
        if part == end and begun:
            del kept[begun.pop() :]
        else:
            if part == start:
                begun.append(len(kept))
            kept.append(part)
    return "".join(kept)


def _table(text: str) -> str:
    rows = []
    for line in map(str.strip, text.splitlines()):
        if line.startswith(("!", "|")) and not line.startswith(("|-", "|}")):
            cells = re.split(r"!!|\|\|", re.sub(r"^(\|\+|[|!])", "", line))
            rows.append(" | ".join(c for c in map(str.strip, cells) if c))
    return "\n".join(rows)


def wiki_sections_of(text: str | None, title: str) -> list[tuple[list[str], str]]:
    """(path, clean text) of the introduction and of every heading's body that is not blank."""
    parts = re.split(r"^(={2,6})\s*(.+?)\s*\1[ \t]*$", text or "", flags=re.M)
    found, above = [([title], parts[0])], []
    for marks, heading, body in zip(parts[1::3], parts[2::3], parts[3::3]):
        above = [x for x in above if x[0] < len(marks)] + [(len(marks), clean_wiki(heading) or heading)]
        found.append(([title, *(h for _, h in above)], body))
    return [(path, clean) for path, body in found if (clean := clean_wiki(body))]


# ---------------------------------------------------------------- Spark


def _sections(read):
    @F.pandas_udf("array<struct<path: array<string>, text: string>>")
    def run(text: pd.Series, title: pd.Series) -> pd.Series:
        return pd.Series([[{"path": p, "text": t} for p, t in read(x, y or "")] for x, y in zip(text, title)])

    return run


def _exploded(rows: DataFrame, key: str, found: Column) -> DataFrame:
    s = rows.select(key, F.posexplode(found).alias("section", "s"))
    return s.select(key, F.col("section").cast("long").alias("section"), "s.path", "s.text")


def html_sections(pages: DataFrame, key: str, html: str, title: Column) -> DataFrame:
    """key, section, path, text."""
    return _exploded(pages, key, _sections(html_sections_of)(F.col(html), title))


def wiki_sections(pages: DataFrame, key: str, text: str, title: Column) -> DataFrame:
    """key, section, path, text."""
    return _exploded(pages, key, _sections(wiki_sections_of)(F.col(text), title))


def html_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, block, level (null but for headings), text."""

    @F.pandas_udf("array<struct<tag: string, text: string>>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([[{"tag": tag, "text": text} for tag, text in read_html(v)[0]] for v in x])

    b = pages.select(key, F.posexplode(run(F.col(html))).alias("block", "b"))
    level = F.when(F.col("b.tag").isin(*HEADINGS), F.substring("b.tag", 2, 1).cast("long"))
    return b.select(key, F.col("block").cast("long").alias("block"), F.col("b.tag").alias("tag"), level.alias("level"), F.col("b.text").alias("text"))


def connector_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(connector_text_of)

    return run(html)


def html_title(html: Column) -> Column:
    """The title element's text, or the first heading's of level 1 or 2; empty if there is none."""
    found = F.coalesce(*(F.nullif(F.trim(F.regexp_extract(html, f"(?is)<{t}[^>]*>(.*?)</{t}>", 1)), F.lit("")) for t in ("title", "h1", "h2")))
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(found, "<[^<>]+>", " "), r"\s+", " ")), F.lit(""))


def links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """key, url, link: every different anchor target, absolute; fragments alone give none."""
    target = F.explode(F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(r"""(?i)<a\s[^>]*?href=["']([^"'#]+)"""), F.lit(1))))
    host = F.regexp_extract(url, r"^([a-z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(url, r"^([a-z]+://[^/?#]+(?:/[^?#]*(?=/))?)", 1)
    t = F.col("target")
    scheme = F.concat(F.substring_index(F.col(url), ":", 1), F.lit(":"))
    full = F.when(t.rlike("^[a-z]+:"), t).when(t.startswith("//"), F.concat(scheme, t)).when(t.startswith("/"), F.concat(host, t)).otherwise(F.concat(folder, F.lit("/"), t))
    return pages.select(key, url, target.alias("target")).select(key, url, full.alias("link")).distinct()


def redirect_target(text: Column) -> Column:
    """The title that a redirect page names; null for other pages."""
    return F.nullif(F.regexp_extract(text, REDIRECT, 1), F.lit(""))
