"""Page metadata and readable text from raw HTML (one Arrow batch of pages at a time)."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Elements without content, elements whose text is dropped, and block elements.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
        "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer", "keygen", "menuitem"}
DROPPED = {"script", "style", "nav", "footer", "aside", "header"}
HIDDEN = {"script", "style", "template"}
BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "div", "article", "section"}
META_FIELDS = {"description": "description", "og:description": "description", "keywords": "keywords", "author": "author",
               "article:author": "author", "article:published_time": "published_date", "date": "published_date",
               "dc.date": "published_date", "og:image": "og_image", "og:site_name": "site_name"}

PAGE_SCHEMA = StructType(
    [StructField(n, StringType()) for n in ("title", "description", "author", "published_date", "og_image", "site_name")]
    + [StructField("keywords", ArrayType(StringType())), StructField("content", StringType())]
)


class _Outline(HTMLParser):
    """Text pieces of a page, and each element as a range of them.

    A closing tag ends the nearest open element of that name and all inside it;
    one that matches nothing is ignored. Elements never close each other.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts, self.elements, self.open, self.meta, self.joining = [], [], [], [], False

    def handle_starttag(self, tag, attrs):
        self.joining = False
        values = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.meta.append(values)
        element = [tag, values.get("class", ""), len(self.texts), None]
        self.elements.append(element)
        if tag in VOID:
            element[3] = len(self.texts)
        else:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.joining = False
        if any(e[0] == tag for e in self.open):
            while self.open:
                e = self.open.pop()
                e[3] = len(self.texts)
                if e[0] == tag:
                    break

    def handle_data(self, data):
        if self.joining:
            self.texts[-1][0] += data
        else:
            self.texts.append([data, frozenset(e[0] for e in self.open)])
            self.joining = True

    def handle_comment(self, data):
        self.joining = False

    def finish(self, html):
        self.feed(html)
        self.close()
        for e in self.open:
            e[3] = len(self.texts)
        return self


def _metadata(page: _Outline) -> dict:
    title = next((e for e in page.elements if e[0] == "title"), None)
    out = {"title": "".join(t for t, _ in page.texts[title[2]:title[3]]).strip() if title else None, "keywords": []}
    for values in page.meta:
        field = META_FIELDS.get((values.get("name") or values.get("property") or "").lower())
        content = values.get("content", "")
        if not field or not content:
            continue
        if field == "keywords":
            out[field] = [k.strip() for k in content.split(",") if k.strip()]
        elif field != "description" or not out.get(field):
            out[field] = content
    return out


#: Tags that hold a page's text, the better first; a class that speaks of content comes last.
_BOXES = {"main": 0, "article": 1}


def _box(page: _Outline) -> tuple[int, int, int]:
    """Number of the first element inside the text's box, and the range of texts the box holds; the whole page without one."""
    ranked = [(_BOXES.get(tag, 2), i) for i, (tag, name, *_) in enumerate(page.elements) if tag in _BOXES or "content" in name.lower()]
    if not ranked:
        return 0, 0, len(page.texts)
    at = min(ranked)[1]
    return at + 1, page.elements[at][2], page.elements[at][3]


def _content(page: _Outline, title: str | None) -> str:
    """Blocks of the box that say something new, then its list items, in one walk over its elements."""
    first, low, high = _box(page)
    inside = [e for e in page.elements[first:] if low <= e[2] and e[3] <= high]
    alive = [True] * (high - low)
    for tag, _, start, stop in inside:
        if tag in DROPPED:
            alive[start - low : stop - low] = [False] * (stop - start)

    def said(tag: str, start: int, stop: int) -> str:
        texts = (page.texts[i] for i in range(start, stop) if alive[i - low])
        parts = (t.strip() for t, tags in texts if tag in HIDDEN or not tags & HIDDEN)
        return " ".join(("" if tag == "li" else " ").join(p for p in parts if p).split())

    blocks, items, told = [], [], ""
    for tag, _, start, stop in inside:
        if tag in BLOCKS:
            text = said(tag, start, stop)
            if len(text) > 5 and text not in told:
                blocks.append(text)
                told = f"{told}\0{text}"
        elif tag == "li":
            items.append(said(tag, start, stop))
    known = set(blocks)
    news = [t for t in dict.fromkeys(items) if len(t) > 10 and t not in known]
    body = "\n".join(blocks + ["- " + t for t in news])
    return body if not title or title in body[:200] else f"# {title}\n\n{body}"


@F.pandas_udf(PAGE_SCHEMA)
def _parse_page(html: pd.Series) -> pd.DataFrame:
    rows = []
    for text in html:
        page = _Outline().finish(text or "")
        meta = _metadata(page)
        rows.append({**dict.fromkeys(PAGE_SCHEMA.names), **meta, "content": _content(page, meta["title"])})
    return pd.DataFrame(rows, columns=PAGE_SCHEMA.names, dtype=object)


# Non-deterministic, so that a filter on one field does not parse the page a second time.
parse_page = _parse_page.asNondeterministic()
