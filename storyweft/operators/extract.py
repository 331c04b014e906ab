"""Readable text of HTML pages: main content by text density, safe markup, lead images, language, repetition."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_WORDS = 150
# Tags and attributes that may stay, and what headings become.
KEEP_TAGS = set("p h2 h3 h4 ul ol li blockquote figure figcaption img a strong em b i u s br hr pre code table thead tbody tr th td sup sub cite q time abbr".split())
KEEP_ATTRIBUTES = {"a": ("href",), "img": ("src", "alt", "width", "height"), "td": ("colspan",), "th": ("colspan",), "time": ("datetime",), "abbr": ("title",)}
RENAMED = {"h1": "h2", "h5": "h4", "h6": "h4"}
VOID = {"br", "hr", "img"}
BLOCKS = {"p", "blockquote", "li", "h2", "h3", "h4", "figcaption", "pre", "td", "dd", "dt"}
SKIPPED = {"script", "style", "noscript", "template", "iframe", "svg", "form", "button", "select", "textarea"}
ASIDE = {"nav", "footer", "aside", "header", "menu"}
ARTICLE = "title string, byline string, site_name string, excerpt string, lang string, words int, image string, images array<string>, content string"


def absolute(value: str | None, base: str | None) -> str | None:
    """A web address made absolute; null if it isn't of the web."""
    try:
        url = urljoin(base or "", (value or "").strip())
        return url if value and urlsplit(url).scheme in ("http", "https") and urlsplit(url).netloc else None
    except ValueError:
        return None


class _Page(HTMLParser):
    """Blocks of a page with their container, text and inner markup, and its head's figures."""

    def __init__(self, base: str | None):
        super().__init__(convert_charrefs=True)
        self.base, self.meta, self.lang, self.title = base, {}, None, ""
        self.path: list[str] = []
        self.serial, self.ids = 0, []
        self.skip, self.aside, self.in_title = 0, 0, False
        self.blocks: list[dict] = []
        self.images: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "html":
            self.lang = a.get("lang")
        elif tag == "meta":
            name = (a.get("property") or a.get("name") or "").lower()
            if name and a.get("content") and name not in self.meta:
                self.meta[name] = a["content"].strip()
        elif tag == "link" and (a.get("rel") or "").lower() == "image_src":
            self.meta.setdefault("image_src", a.get("href") or "")
        if tag == "title":
            self.in_title = True
        if tag in SKIPPED:
            self.skip += 1
        if tag in ASIDE:
            self.aside += 1
        if tag not in VOID and tag not in ("meta", "link", "input", "source"):
            self.serial += 1
            self.path.append(tag)
            self.ids.append(self.serial)
        if self.skip:
            return
        if RENAMED.get(tag, tag) in BLOCKS:
            self.blocks.append({"tag": RENAMED.get(tag, tag), "parent": self.ids[-2] if len(self.ids) > 1 else 0, "text": [], "html": [], "link": 0, "aside": self.aside > 0})
        if tag == "img":
            url = absolute(a.get("src") or a.get("data-src"), self.base)
            small = any((a.get(k) or "").isdigit() and int(a[k]) < 40 for k in ("width", "height"))
            if url and not small and not self.aside:
                self.images.append(url)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in self.path:
            while self.path:
                t = self.path.pop()
                self.ids.pop()
                self.skip -= t in SKIPPED and self.skip > 0
                self.aside -= t in ASIDE and self.aside > 0
                if t == tag:
                    break

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if self.skip or not self.blocks or not any(RENAMED.get(t, t) in BLOCKS for t in self.path):
            return
        self.blocks[-1]["text"].append(data)
        if "a" in self.path:
            self.blocks[-1]["link"] += len(data)


class _Safe(HTMLParser):
    """Allow-listed markup of a fragment."""

    def __init__(self, base: str | None, skip_image: str | None):
        super().__init__(convert_charrefs=True)
        self.base, self.skip_image, self.out, self.drop, self.open = base, skip_image, [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.drop += 1
        tag = RENAMED.get(tag, tag)
        if self.drop or tag not in KEEP_TAGS:
            return
        a, kept = dict(attrs), []
        if tag == "img":
            a["src"] = absolute(a.get("src") or a.get("data-src") or a.get("data-lazy-src"), self.base)
            small = any((a.get(k) or "").isdigit() and int(a[k]) < 40 for k in ("width", "height"))
            if not a["src"] or small:
                return
            a["src"] = re.sub(r"^http:", "https:", a["src"])
            if a["src"] == self.skip_image:
                self.skip_image = None
                return
        if tag == "a":
            a["href"] = absolute(a.get("href"), self.base)
        for k in KEEP_ATTRIBUTES.get(tag, ()):
            if a.get(k):
                kept.append(f' {k}="{_escape(a[k])}"')
        if tag == "a" and a["href"]:
            kept.append(' rel="noopener nofollow" target="_blank"')
        if tag == "img":
            kept.append(' loading="lazy"')
        self.out.append(f"<{tag}{''.join(kept)}{' /' if tag in VOID else ''}>")
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.drop = max(0, self.drop - 1)
        tag = RENAMED.get(tag, tag)
        if not self.drop and tag in self.open:
            while self.open:
                t = self.open.pop()
                self.out.append(f"</{t}>")
                if t == tag:
                    break

    def handle_data(self, data):
        if not self.drop:
            self.out.append(_escape(data, quote=False))


def _escape(s: str, quote: bool = True) -> str:
    s = s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return s.replace('"', "&quot;") if quote else s


def sanitize(html: str | None, base: str | None = None, skip_image: str | None = None) -> str | None:
    """A fragment with allow-listed tags and attributes, absolute addresses, and no empty blocks or imageless figures."""
    if html is None:
        return None
    p = _Safe(base, skip_image)
    p.feed(html)
    p.close()
    out = "".join(p.out) + "".join(f"</{t}>" for t in reversed(p.open))
    for _ in range(3):
        out = re.sub(r"<(p|li|h2|h3|h4|blockquote|ul|ol|figcaption)>\s*</\1>", "", out)
    return re.sub(r"<figure>(?:(?!<img|</figure>).)*</figure>", "", out, flags=re.S).strip()


def extract(html: str | None, url: str | None, least: int = LEAST_WORDS) -> dict | None:
    """The readable article of a page, or None: too few words, repetitive, or nothing left."""
    if not html:
        return None
    page = _Page(url)
    page.feed(html)
    page.close()
    score: dict[int, float] = {}
    for b in page.blocks:
        b["flat"] = re.sub(r"\s+", " ", "".join(b["text"])).strip()
        if not b["aside"] and len(b["flat"]) > 20 and b["link"] < 0.5 * len("".join(b["text"])):
            score[b["parent"]] = score.get(b["parent"], 0.0) + len(b["flat"]) ** 0.9 + 20 * b["flat"].count(",")
    if not score:
        return None
    best = max(score, key=lambda k: score[k])
    main = [b for b in page.blocks if not b["aside"] and b["flat"] and (b["parent"] == best or score.get(b["parent"], 0) > 0.25 * score[best] or (b["tag"] in ("h2", "h3", "h4", "blockquote") and b["link"] == 0))]
    text = [b["flat"] for b in main]
    words = sum(len(t.split()) for t in text)
    long = [t for t in text if len(t) > 20]
    if words < least or (len(long) >= 6 and len(set(long)) < 0.6 * len(long)):
        return None
    meta = page.meta
    images = list(dict.fromkeys(u for u in [*(absolute(meta.get(k), url) for k in ("og:image", "og:image:url", "og:image:secure_url", "twitter:image", "twitter:image:src", "image_src")), *page.images] if u))
    content = sanitize("".join(f"<{b['tag']}>{_escape(b['flat'], quote=False)}</{b['tag']}>" for b in main), url, images[0] if images else None)
    site = meta.get("og:site_name")
    title = meta.get("og:title") or re.sub(r"\s+", " ", page.title).strip()
    for tail in filter(None, [site, urlsplit(url or "").hostname]):
        title = re.sub(rf"\s+[|–—:·-]\s+{re.escape(tail)}$", "", title, flags=re.I)
    byline = meta.get("author") or meta.get("article:author")
    return {
        "title": title or None, "byline": re.sub(r"(?i)^by\s+", "", byline) if byline else None, "site_name": site, "excerpt": meta.get("description") or meta.get("og:description") or (text[0][:280] if text else None),
        "lang": page.lang, "words": words, "image": images[0] if images else None, "images": images, "content": content,
    }


def extract_articles(pages: DataFrame, key: str = "id", url: str = "url", html: str = "html", least: int = LEAST_WORDS) -> DataFrame:
    """A row for each page that has a readable article: ``key`` and ARTICLE. Pages are parsed where they are read."""
    source = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("h"))
    kind = source.schema["k"].dataType.simpleString()
    names = [x.split()[0] for x in ARTICLE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, extract(h, u, least)) for k, u, h in zip(pdf["k"], pdf["u"], pdf["h"])]
            yield pd.DataFrame([{"k": k} | x for k, x in rows if x], columns=["k", *names])

    return source.mapInPandas(run, f"k {kind}, {ARTICLE}").withColumnRenamed("k", key)


@F.pandas_udf(T.StringType())
def sanitized(html: pd.Series, base: pd.Series) -> pd.Series:
    """:func:`sanitize` over Arrow batches."""
    return pd.Series([sanitize(h, b) for h, b in zip(html, base)], dtype="object")


@F.pandas_udf(T.StringType())
def absolute_url(value: pd.Series, base: pd.Series) -> pd.Series:
    """:func:`absolute` over Arrow batches."""
    return pd.Series([absolute(v, b) for v, b in zip(value, base)], dtype="object")


def paragraphs(html: Column) -> Column:
    """Text of the paragraphs of more than 20 characters."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1)
    return F.filter(F.transform(found, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, "<[^>]+>", " "), r"\s+", " "))), lambda p: F.length(p) > 20)


def repetitive(html: Column) -> Column:
    """Whether a page of six paragraphs or more has less than 0.6 of them distinct."""
    p = paragraphs(html)
    return F.coalesce((F.size(p) >= 6) & (F.size(F.array_distinct(p)) < 0.6 * F.size(p)), F.lit(False))


def html_lang(html: Column) -> Column:
    """The language that a page names."""
    return F.nullif(F.regexp_extract(html, r"""(?i)<html\b[^>]*\blang=["']?([A-Za-z-]+)""", 1), F.lit(""))


def decode_html(body: bytes | None, content_type: str | None) -> str | None:
    """Text of a page: charset of the header, else of a meta tag in its first 4096 bytes, else UTF-8; unknown ones are UTF-8."""
    if body is None:
        return None
    m = re.search(r"charset=[\"']?([\w-]+)", content_type or "", re.I) or re.search(rb"<meta[^>]+charset=[\"']?([\w-]+)", body[:4096], re.I)
    label = (m.group(1).decode() if m and isinstance(m.group(1), bytes) else m.group(1) if m else "utf-8").lower()
    label = "windows-1252" if label in ("iso-8859-1", "latin1", "ascii", "us-ascii") else label
    try:
        return body.decode(label, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")
