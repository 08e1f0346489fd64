"""HTML extraction by line-block distribution.

Markup is stripped to lines, one per block element. Lengths of text are summed
over windows of a few lines; text begins where the sums surge and ends where
they dive. Lines inside menus, adverts, comments and the like have length 0, as
have links, and where a page marks its article, so have the lines outside it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines in a window.
WINDOW = 3
#: Characters that a window needs in a page without a marked article.
LEAST_SUM = 80

_RAW = frozenset({"script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "object", "canvas", "math", "title"})
_ASIDE = frozenset({"nav", "footer", "aside", "form", "dialog", "menu", "button", "figure", "head"})
_MAIN = frozenset({"article", "main"})
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr "
    "html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that mark what is not article text.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup login comment comments disqus replies reply respond menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead related share sharing social widget pagination pager toolbar alert skip search".split()
)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPACE = re.compile(r"\s+")


def _marked(attributes: str) -> bool:
    for name, value in _ATTRIBUTE.findall(attributes):
        value = value.strip("\"'").lower()
        if name.lower() == "hidden" or (name.lower() == "aria-hidden" and value == "true"):
            return True
        if name.lower() in ("class", "id", "role") and (_MARKS & set(re.split(r"[^a-z]+", value)) or value in ("complementary", "contentinfo")):
            return True
    return False


class _Line:
    __slots__ = ("parts", "linked", "main", "aside")

    def __init__(self, main: int, aside: bool) -> None:
        self.parts, self.linked, self.main, self.aside = [], 0, main, aside


def page_lines(page: str) -> tuple[list[tuple[str, int, int, bool]], int]:
    """Lines (text, linked characters, number of the article they are in, aside) of a page; number of articles."""
    lines: list[_Line] = []
    # Open elements that leave text out: (tag, depth of the same tag within).
    aside: list[list] = []
    main_depth = mains = link = 0
    current = _Line(0, False)

    def cut() -> None:
        nonlocal current
        if current.parts:
            lines.append(current)
        current = _Line(mains if main_depth else 0, bool(aside))

    def add(text: str) -> None:
        if text:
            plain = html.unescape(text)
            current.parts.append(plain)
            if link:
                current.linked += len(plain.strip())

    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        mark = page.find("<", at)
        if mark < 0 or mark > last:
            add(page[at:])
            break
        add(page[at:mark])
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), mark):
            at = page.find(">", mark) + 1
            continue
        tag = _TAG.match(page, mark) or _LOOSE_TAG.match(page, mark)
        if not tag:
            add("<")
            at = mark + 1
            continue
        at = tag.end()
        closing, name, attributes = tag[1], tag[2].lower(), tag[3]
        if name in _RAW and not closing:
            if attributes.endswith("/"):
                continue
            end = re.compile(f"</{re.escape(name)}[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in _BLOCK:
            cut()
        if name == "a":
            link = 0 if closing else 1
        if closing:
            for k in range(len(aside) - 1, -1, -1):
                if aside[k][0] == name:
                    aside[k][1] -= 1
                    if aside[k][1] == 0:
                        del aside[k:]
                    break
            if name in _MAIN and main_depth:
                main_depth -= 1
        elif name not in _VOID and not attributes.endswith("/"):
            if name in _MAIN and not (aside and _marked(attributes)):
                # An article does not lie in an unclosed menu before it.
                aside = [a for a in aside if a[0] in ("div", "section", "li", "ul", "ol")] if not _marked(attributes) else aside
            for a in aside:
                a[1] += a[0] == name
            if name in _ASIDE or (name == "header" and not main_depth) or (name not in ("html", "body") and name in _BLOCK | {"span"} and _marked(attributes)):
                aside.append([name, 1])
            if name in _MAIN:
                main_depth += 1
                mains += main_depth == 1
        if name in _BLOCK:
            current = _Line(mains if main_depth else 0, bool(aside))
        elif aside and not current.parts:
            current.aside = True
    cut()
    out = [(_SPACE.sub(" ", "".join(x.parts)).strip(), x.linked, x.main, x.aside) for x in lines]
    return [x for x in out if x[0]], mains


def window_sums(lengths: list[int], window: int) -> list[int]:
    """Sum of each line's length and those of the lines after it in the window."""
    total = [0]
    for x in lengths:
        total.append(total[-1] + x)
    return [total[min(k + window, len(lengths))] - total[k] for k in range(len(lengths))]


def main_text(page: str | None, window: int = WINDOW, least_sum: int = LEAST_SUM) -> str:
    """The article's lines: those between the surges and dives of the window sums."""
    if not page:
        return ""
    lines, mains = page_lines(page)
    within = mains > 0 and any(x[2] and not x[3] for x in lines)
    lengths = []
    for text, linked, main, aside in lines:
        if aside or (within and not main):
            lengths.append(0)
        elif within:
            lengths.append(len(text))
        else:
            lengths.append(max(0, len(text) - 2 * linked))
    sums = window_sums(lengths, window)
    least = 1 if within else min(least_sum, max(sums, default=0))
    kept, inside = [], False
    for k, total in enumerate(sums):
        if not inside and total >= least > 0:
            inside = True  # surge
        elif inside and total < least and not lengths[k]:
            inside = False  # dive
        if inside and lengths[k]:
            kept.append(lines[k][0])
    return "\n".join(kept)


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html", window: int = WINDOW, least_sum: int = LEAST_SUM) -> DataFrame:
    """Each page's (page_id, url, text, n_chars), a row per input row.

    A null or empty page, and one without article text, has an empty text.
    Broken markup (unclosed tags, stray brackets, cut-off pages) is read as far
    as it goes. Null ids and urls stay; extra columns are ignored. Pages are
    worked through in their scan tasks, one at a time, without a shuffle.
    """
    schema = T.StructType([pages.schema[page_id], pages.schema[url], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), window, least_sum) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names
            )

    return pages.select(F.col(page_id), F.col(url), F.col(source).cast("string").alias("__page")).mapInArrow(extract, schema)
