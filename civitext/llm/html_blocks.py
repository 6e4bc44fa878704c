"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is cut into blocks at block-level tags. Each block is described by its
words and link density, those of the blocks before and after it, and by the
kind of element around it. A decision tree, grown on the labelled table below,
keeps or drops each block; the kept ones are the text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitext.llm import text_arrays as ta

# HTML element names by their role in a page.
_RAW = frozenset("script style noscript template textarea title select button svg math iframe object canvas head".split())
_BOILERPLATE = frozenset("nav aside footer form menu dialog fieldset".split())
_MAIN = frozenset("article main".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSED_BY_NEXT = frozenset("p li dd dt tr td th h1 h2 h3 h4 h5 h6".split())
_MARKED = re.compile(
    r"(?<![a-z])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|masthead|menu|modal|nav\w*|newsletter|"
    r"notices?|pager|pagination|popup|promo\w*|related|replies|reply|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?![a-z])",
    re.I,
)
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)/?>""", re.S)
_MARK = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: One line a block: words and link density of the block, of the one before and
#: of the one after, whether a boilerplate element and whether an article holds
#: it, and whether it belongs to the main text.
LABELLED = np.array(
    [
        # words, links, before, its links, after, its links, boilerplate, article, main
        (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), (2, 1.0, 1, 1.0, 9, 0.0, 1, 0, 0),
        (9, 0.0, 1, 1.0, 8, 0.0, 1, 0, 0), (5, 0.0, 30, 0.0, 0, 0.0, 1, 0, 0), (14, 0.1, 60, 0.0, 2, 1.0, 1, 0, 0),
        (40, 0.0, 55, 0.0, 12, 0.0, 1, 1, 0), (3, 0.3, 40, 0.0, 30, 0.0, 1, 1, 0), (60, 0.0, 3, 0.0, 45, 0.0, 1, 0, 0),
        (25, 0.0, 80, 0.0, 25, 0.0, 1, 1, 0), (1, 0.0, 1, 0.0, 70, 0.0, 1, 1, 0), (120, 0.0, 12, 0.0, 0, 0.0, 1, 0, 0),
        (11, 0.0, 9, 0.0, 50, 0.0, 0, 1, 1), (50, 0.0, 11, 0.0, 35, 0.0, 0, 1, 1), (2, 0.0, 35, 0.0, 40, 0.0, 0, 1, 1),
        (1, 0.0, 4, 0.0, 6, 0.0, 0, 1, 1), (3, 0.0, 2, 0.0, 8, 0.0, 0, 1, 1), (90, 0.1, 20, 0.0, 60, 0.0, 0, 1, 1),
        (4, 0.0, 60, 0.0, 0, 0.0, 0, 1, 1), (6, 0.0, 1, 1.0, 9, 1.0, 0, 1, 1), (22, 0.4, 50, 0.0, 31, 0.1, 0, 1, 1),
        (1, 0.0, 9, 0.0, 12, 0.0, 0, 1, 1), (7, 0.0, 11, 0.0, 10, 0.0, 0, 1, 1), (33, 0.0, 3, 0.0, 5, 1.0, 0, 1, 1),
        (1, 0.0, 0, 0.0, 1, 0.0, 0, 1, 1), (2, 0.0, 3, 0.0, 2, 0.0, 0, 1, 1), (5, 0.0, 0, 0.0, 4, 0.0, 0, 1, 1),
        (4, 0.0, 2, 0.0, 3, 0.0, 0, 1, 1), (8, 0.0, 4, 0.0, 1, 0.0, 0, 1, 1), (3, 0.0, 7, 0.0, 5, 0.0, 0, 1, 1),
        (2, 0.0, 9, 0.0, 4, 0.9, 0, 1, 1), (6, 0.0, 8, 0.0, 0, 0.0, 0, 1, 1), (10, 0.0, 5, 1.0, 3, 0.0, 0, 1, 1),
        (1, 0.0, 20, 0.0, 2, 0.0, 0, 1, 1), (7, 0.0, 30, 0.0, 5, 0.0, 0, 1, 1), (5, 0.0, 12, 0.0, 1, 1.0, 0, 1, 1),
        (4, 1.0, 5, 1.0, 4, 1.0, 0, 1, 0), (6, 1.0, 70, 0.0, 5, 1.0, 0, 1, 0), (9, 0.9, 25, 0.0, 6, 1.0, 0, 1, 0),
        (3, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0), (5, 0.8, 4, 1.0, 60, 0.0, 0, 0, 0), (12, 0.9, 40, 0.1, 6, 1.0, 0, 0, 0),
        (30, 0.7, 8, 1.0, 9, 1.0, 0, 0, 0), (2, 0.0, 3, 1.0, 3, 1.0, 0, 0, 0), (3, 0.0, 2, 1.0, 4, 0.8, 0, 0, 0),
        (5, 0.0, 4, 1.0, 3, 0.0, 0, 0, 0), (4, 0.2, 3, 0.0, 5, 1.0, 0, 0, 0), (1, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0),
        (45, 0.0, 10, 0.0, 38, 0.0, 0, 0, 1), (80, 0.1, 45, 0.0, 60, 0.0, 0, 0, 1), (28, 0.0, 3, 1.0, 50, 0.0, 0, 0, 1),
        (18, 0.0, 40, 0.0, 33, 0.1, 0, 0, 1), (24, 0.2, 61, 0.0, 4, 1.0, 0, 0, 1), (16, 0.0, 20, 0.0, 2, 1.0, 0, 0, 1),
        (8, 0.0, 35, 0.0, 42, 0.0, 0, 0, 1), (6, 0.0, 50, 0.0, 28, 0.0, 0, 0, 1), (3, 0.0, 25, 0.0, 60, 0.0, 0, 0, 1),
        (9, 0.0, 2, 1.0, 55, 0.0, 0, 0, 1), (7, 0.0, 0, 0.0, 48, 0.0, 0, 0, 1), (20, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1),
    ]
)


def grow(rows: np.ndarray, depth: int = 8):
    """A tree ``(feature, cut, low, high)`` by Gini impurity; a leaf is the share of main text."""
    share = rows[:, -1].mean()
    if depth == 0 or share in (0, 1):
        return float(share)
    best = None
    for f in range(rows.shape[1] - 1):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] < cut
            a, b = rows[low, -1], rows[~low, -1]
            impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, float(cut), low
    if best is None:
        return float(share)
    _, f, cut, low = best
    return f, cut, grow(rows[low], depth - 1), grow(rows[~low], depth - 1)


@cache
def tree():
    return grow(LABELLED)


def keeps(node, row: tuple) -> bool:
    while isinstance(node, tuple):
        f, cut, low, high = node
        node = low if row[f] < cut else high
    return node >= 0.5


def blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """``(text, words, words in links, in boilerplate, in an article)`` in page order."""
    out: list[tuple[str, int, int, bool, bool]] = []
    pieces: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, boilerplate, article
    links, at = 0, 0

    def state() -> tuple[bool, bool]:
        return stack[-1][1:] if stack else (False, False)

    def flush() -> None:
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            out.append((text, text.count(" ") + 1, len(html.unescape("".join(linked)).split()), *state()))
        pieces.clear()
        linked.clear()

    def say(piece: str) -> None:
        pieces.append(piece)
        linked.append(piece if links else " ")

    while True:
        m = _TOKEN.search(page, at)
        say(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing = bool(m[1])
        if name in _RAW and not closing and not m[0].endswith("/>"):
            end = re.compile(rf"</{name}\s*>|<body\b" if name == "head" else rf"</{name}\s*>", re.I).search(page, at)
            at = len(page) if end is None else end.end() if end[0][1] == "/" else end.start()
            say(" ")
        elif name == "a":
            links = 0 if closing else 1
        elif name == "br":
            say(" ")
        elif name in _BLOCK:
            flush()
            links = 0
            if name in _VOID:
                continue
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            else:
                if name in _CLOSED_BY_NEXT and stack and stack[-1][0] == name:
                    stack.pop()
                boiler, article = state()
                marked = any(_MARKED.search(a or b or c) for a, b, c in _MARK.findall(m[3]))
                if name in _MAIN and not boiler:
                    article, marked = True, marked and name != "main"
                elif name in ("body", "html"):
                    marked = False
                boiler = boiler or marked or name in _BOILERPLATE or (name == "header" and not article)
                stack.append((name, boiler, article))
    flush()
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    if not found:
        return ""
    none = (0, 0.0)
    about = [(words, min(1.0, links / words)) for _, words, links, _, _ in found]
    around = [none, *about, none]
    kept = [
        text
        for k, (text, _, _, boiler, article) in enumerate(found)
        if keeps(tree(), (*around[k + 1], *around[k], *around[k + 2], boiler, article))
    ]
    return " ".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in ta.slices(batches, "html"):
        texts = [main_text(page or "") for page in batch.column("html").to_pylist()]
        at = batch.schema.get_field_index("html")
        yield batch.remove_column(at).append_column("text", pa.array(texts, pa.string()))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text`` in place of ``html``: the main text, or '' where there is none.

    A null or empty page has no text. All other columns and all rows stay,
    repeated ones included; a column named ``text`` is replaced. Unclosed
    elements end with the page. One scan without a shuffle.
    """
    pages = pages.drop("text").withColumn("html", F.col("html").cast("string"))
    schema = pages.drop("html").withColumn("text", F.lit("")).schema
    return pages.mapInArrow(_extract, schema)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
