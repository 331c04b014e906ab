"""Records that are template residue, filler or error pages instead of reports."""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyweft.llm.pages import OUTSIDE, classified

WHOLE, LIKELY = 0.4, 0.1  # share of a line's class on pages without a paragraph: of an error template; of what may be one
CONTENT = 0.12  # and the share under which a line is ordinary content
FILLER_WORDS, FILLER_SHARE, FILLER_DISTINCT = 12, 0.2, 0.35  # words of a line that is filler if less than that share of them is usual, or, of a stretch, distinct
STRETCH = 48

# Fixed values, besides the slots that are induced: how template languages and editors write a slot that is still to be filled.
SLOTS = [
    r"\{\{[^{}\n]{0,80}\}\}", r"\$\{[\w.:| -]{1,60}\}", r"#\{[\w.]{1,60}\}", r"<%[=-]?[^%\n]{0,80}%>", r"\{%[^%\n]{0,80}%\}", r"%%\w{1,60}%%", r"@@\w{1,60}@@",
    r"(?<!\w)__[A-Za-z]\w{0,60}?__(?!\w)", r"\bXX_\w{1,60}?_XX\b", r"\[\[[\w .]{0,60}\]\]", r"\[(?:INSERT|Insert|insert) [^\]\n]{1,60}\]", r"\[[\w ]{1,60} goes here\]",
    r"\bTK(?: [A-Z_]+){0,5} TK\b", r"\{[a-z]\w{0,60}\|[^{}\n]{0,60}\}", r"\{[a-z]+_\w{1,60}\}", r"<[A-Z][A-Z_]{2,60}>", r"\[object \w+\]",
]
SLOT = re.compile("|".join(SLOTS))
# What programs print for a value that isn't there.
STRAY = re.compile(r"(?:undefined|null|NaN|None|nil|N/A|\(null\)|\[object \w+\])(?:[\s,;|/-]+(?:undefined|null|NaN|None|nil|N/A|\(null\)|\[object \w+\]))*")
CAPITAL, CLOSED = re.compile(r"<[A-Z]").search, re.compile(r"</([A-Z]+)>")
KEPT = re.compile(r"<(?![%/A-Z][A-Z_]*[%>])[^>]*>")


def _may_hold_slot(t: str) -> bool:
    """Whether a text has what every slot of SLOTS has, as it stands or escaped."""
    if "{" in t or "[" in t or "<%" in t or "%%" in t or "@@" in t or "__" in t or "XX_" in t or "TK" in t or CAPITAL(t):
        return True
    return "&" in t and ("&l" in t or "&#" in t or "&commat;" in t or "&percnt;" in t or "&num;" in t or "&dollar;" in t)


def holds_slot(text: str | None) -> bool:
    """Whether a title or content holds an unfilled slot; markup as such is none."""
    if not text or not _may_hold_slot(text):
        return False
    if closed := set(CLOSED.findall(text)):  # markup in capitals
        text = re.sub(f"<(?:{'|'.join(sorted(closed))})>", " ", text)
    return bool(SLOT.search(html.unescape(KEPT.sub(" ", text)))) or bool(SLOT.search(text) if "<%" in text else False)


def _few_words(w: list[str]) -> bool:
    """Whether most stretches of STRETCH words, so that length alone doesn't tell, have few distinct ones."""
    if len(w) <= STRETCH:
        return len(set(w)) < FILLER_DISTINCT * len(w)
    parts = [w[i : i + STRETCH] for i in range(0, len(w), STRETCH)]
    if len(parts) > 1 and len(parts[-1]) < FILLER_WORDS:
        parts.pop()
    most = len(parts) // 2
    for p in parts:
        if len(set(p)) >= FILLER_DISTINCT * len(p):
            most += 1
            if most >= len(parts):  # half of them have many
                return False
    return True


def is_filler(line: str, usual: frozenset[str]) -> bool:
    """Whether a long line is of words that aren't usual or of few words; a part of it tells of nearly all lines that it isn't."""
    n = line.count(" ") + 1
    if n <= STRETCH:
        part = set(line[: 2 * len(line) // 3].casefold().split(" ")[:-1])
        if len(part) >= FILLER_DISTINCT * n and len(part & usual) >= FILLER_SHARE * n:
            return False
    w = line.casefold().split(" ")
    return list(map(usual.__contains__, w)).count(True) < FILLER_SHARE * n or _few_words(w)


def told(title: str | None, content: str | None, shown: list[str], usual: frozenset[str]) -> tuple[bool, bool]:
    """Whether a record holds a slot as template languages write it or nothing but stray values, and whether a long line of it is filler."""
    slot = bool(shown) and all(map(STRAY.fullmatch, shown)) or bool(title) and bool(STRAY.fullmatch(title.strip())) or holds_slot(title) or holds_slot(content)
    filler = False
    for v in shown:
        if v.count(" ") + 1 >= FILLER_WORDS:
            if is_filler(v, usual):
                filler = True
                break
    return slot, filler


def residue(articles: DataFrame, key: str = "id", title: str = "title", content: str = "content", site: str = "site_name", lines: DataFrame | None = None, words: dict[str, bool] | None = None) -> DataFrame:
    """Columns ``key, slot, filler, whole_page``: records whose title or content isn't a real report, and why.

    ``slot``: a line or title has a variable, a blank or a default where its aligned siblings have values (``pages.unfilled``), or
    title or content holds a slot as template languages write it (SLOTS), or is nothing but stray program values. ``filler``:
    a long line of words that other records don't use, or of few words over and over. ``whole_page``: records are aligned line by line (``classified``);
    a line class found on records without any paragraph for the most part is an error template, and a record of such
    lines with no paragraph is an error page. A report that mentions such words, or whose furniture asks for scripts, has
    paragraphs and no slot. ``lines`` may be given as ``classified`` with :func:`told`.

    Null titles and contents hold nothing; empty contents are not cases by themselves. Of rows with one key any that is a case makes it
    one. Null keys are left out, other columns are not read, an empty table gives an empty result.
    """
    judged = lines if lines is not None else classified(articles, False, key=key, site=site, content=content, words=words, title=title, told=told)
    own = judged.where("slot is not null").groupBy("k").agg(F.max("slot").alias("slot"), F.max("filler").alias("filler"))
    bare = judged.where("bare and no >= 0").groupBy("k").agg(
        F.max("whole").alias("most"), F.sum(((F.col("shared") < OUTSIDE) & (F.col("whole") < CONTENT)).cast("int")).alias("ordinary")
    )
    pages = bare.where((F.col("most") >= WHOLE) | ((F.col("ordinary") == 0) & (F.col("most") >= LIKELY))).select("k", F.lit(True).alias("whole_page"))
    left = judged.where("open").select("k", F.lit(True).alias("left"))
    false = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    first = own.join(left, "k", "full_outer").withColumn("slot", F.coalesce(F.col("slot"), F.lit(False)) | F.coalesce(F.col("left"), F.lit(False)))
    return first.join(pages, "k", "full_outer").select(F.col("k").alias(key), false("slot"), false("filler"), false("whole_page"))
