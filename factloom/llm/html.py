"""Main text of web pages: the maximum-scoring run of words and tags.

A page is a sequence of tags and of words between them. Words score positive or
negative by where they stand, tags negative, with weights learned from labelled
pages; a linear scan finds the contiguous run of the highest sum, which spans
the content. Within it, what belongs to page furniture by its element, role or
class name is left out. Labelled pages are those whose markup names one main
element; a bounded sample of them gives the weights as log odds of standing
inside or outside that element.

Defined cases: null or empty html gives an empty text; so does a page without
words outside of furniture; markup that is cut off or not closed is read as far
as it goes, an element ends with the one around it; of two runs with equal sums
the first and longer one is taken; null urls are returned as they are;
repeated rows get equal results; a page without labelled pages around it (or an
empty table) uses the prior weights; other columns are not read.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that the weights are learned from, at most.
LABELLED = 2_000

# Element and attribute names of HTML.
#: Elements whose content is never page text.
SILENT = frozenset("script style template noscript iframe object svg math head textarea select option canvas video audio map datalist".split())
#: Elements of page furniture.
FURNITURE = frozenset("nav header footer aside form menu dialog button fieldset label input search".split())
#: Elements of the main content.
MAIN = frozenset(["article", "main"])
#: Elements that stand in a line of text; every other tag ends a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose nesting is followed.
HOLDERS = frozenset(
    "html body div section article main nav header footer aside form menu dialog ul ol dl table thead tbody tr td th "
    "figure details fieldset button label search".split()
) | SILENT
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: Parts of class names and ids that name furniture.
NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar side aside ad ads adv "
    "advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended "
    "comment comments commentlist disqus reply replies respond discussion feedback widget widgets toolbar pagination pager form search "
    "copyright legal disclaimer skip".split()
)
#: Weights before any page was seen: of words by where they stand, and of a tag.
#: Furniture is left out later, so that it neither draws a run nor breaks one.
PRIOR = {"word": 1.0, "link": -0.5, "outside": -1.0, "furniture": 0.0}
TAG_PRIOR, TAG_IN_MAIN = -0.3, -0.01

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|(?=<)|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[a-z]+|[0-9]+")


def furniture(name: str, attributes: str, in_main: bool) -> bool:
    """Whether an element is page furniture by its name, role, class or id."""
    if name in FURNITURE and not (name == "header" and in_main):
        return True
    if not attributes or name in ("html", "body"):
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "role" and value in ROLES:
            return True
        if key == "style" and "display:none" in value.replace(" ", ""):
            return True
        if key in ("class", "id") and (in_main or name not in MAIN) and not re.fullmatch("h[1-6]", name):
            parts = set(_PART.findall(value))
            if parts & NAMES and not (in_main and parts & NAMES <= {"header"}):
                return True
    return False


def tokens(page: str) -> Iterator[tuple[str, str, bool, bool]]:
    """(kind, value, in furniture, in main); kind is ``tag``, ``inline`` or ``text``.

    ``value`` is the element's name, or raw text. Holders nest on a stack; a closing
    tag closes the nearest open holder of its name with all inside it.
    """
    stack: list[tuple[str, bool, bool]] = [("", False, False)]
    links, para = 0, ""
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            _, bad, main = stack[-1]
            yield ("link" if links else "text"), page[at : m.start()], bad or bool(para), main
        at = m.end()
        if not m[3]:
            continue
        name, closing = m[3].lower(), bool(m[2])
        if name == "a":
            links = 0 if closing else 1
        if name not in INLINE:
            para = ""
            links = 0
        if name in HOLDERS:
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            elif name not in VOID and not m[4].rstrip().endswith("/"):
                _, bad, main = stack[-1]
                bad = bad or name in SILENT or furniture(name, m[4], main)
                stack.append((name, bad, main or name in MAIN))
        elif not closing and name not in VOID and name not in INLINE and furniture(name, m[4], stack[-1][2]):
            para = name  # a paragraph of furniture, up to the next block
        _, bad, main = stack[-1]
        yield ("inline" if name in INLINE else "tag"), name, bad or bool(para), main
    if at < len(page):
        _, bad, main = stack[-1]
        yield ("link" if links else "text"), page[at:], bad or bool(para), main


def place(kind: str, bad: bool, main: bool, marked: bool) -> str:
    """Where a word stands: in furniture, outside a marked main element, in plain text, or in a link of an unmarked page."""
    if bad:
        return "furniture"
    if marked:
        return "word" if main else "outside"
    return "link" if kind == "link" else "word"


def counts(page: str) -> tuple[Counter, Counter] | None:
    """Words by place and tags by name, inside and outside the one main element; None if not so marked."""
    found = list(tokens(page))
    if sum(k == "tag" and v in MAIN for k, v, *_ in found) != 2:
        return None
    inside, outside = Counter(), Counter()
    for kind, value, bad, main in found:
        to = inside if main and not bad else outside
        if kind in ("text", "link"):
            to[place(kind, bad, main, True)] += len(value.split())
        else:
            to[f"<{value}"] += 1
    return inside, outside


def learn(pages: list[tuple[Counter, Counter]]) -> dict[str, float]:
    """Weights as log odds; words in plain text stay positive, tags and other words negative."""
    inside, outside = Counter(), Counter()
    for a, b in pages:
        inside.update(a), outside.update(b)
    n_in, n_out = sum(inside.values()), sum(outside.values())
    weights = dict(PRIOR)
    if not n_in or not n_out:
        return weights
    for name in inside.keys() | outside.keys():
        odds = math.log((inside[name] + 1) / (n_in + 1)) - math.log((outside[name] + 1) / (n_out + 1))
        if name == "word":
            weights[name] = min(max(odds, 0.5), PRIOR[name])
        elif name in PRIOR:
            weights[name] = max(min(odds, PRIOR[name]), 3 * PRIOR[name])
        else:
            weights[name] = max(min(odds, -0.01), 2 * TAG_PRIOR)
    return weights


def extract(page: str | None, weights: dict[str, float]) -> str:
    """Text of the best run: blocks without furniture, joined by empty lines."""
    if not page:
        return ""
    found = list(tokens(page))
    marked = any(k == "tag" and v in MAIN and not bad for k, v, bad, _ in found)
    best = (0.0, 0, 0)
    total, start = 0.0, 0
    for k, (kind, value, bad, main) in enumerate(found):
        if kind in ("text", "link"):
            total += weights[place(kind, bad, main, marked)] * len(value.split())
        else:
            total += 0.0 if bad else TAG_IN_MAIN if main else weights.get(f"<{value}", TAG_PRIOR)
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best[0]:
            best = (total, start, k + 1)
    blocks: list[str] = []
    run: list[str] = []
    for kind, value, bad, main in [*found[best[1] : best[2]], ("tag", "", False, False)]:
        if kind == "tag":
            block = " ".join(references.unescape("".join(run)).split())
            if block:
                blocks.append(block)
            run = []
        elif kind == "inline":
            if value == "br":
                run.append(" ")
        elif not bad and (main or not marked):
            run.append(value)
    return "\n\n".join(blocks)


def fit(pages: DataFrame, html: str = "html", most: int = LABELLED) -> dict[str, float]:
    """Weights from at most ``most`` pages whose markup names a main element."""
    marked = pages.select(F.col(html).alias("h")).where(F.lower("h").rlike(r"<(article|main)\b"))
    found = [counts(r["h"]) for r in marked.limit(most).collect()]
    return learn([c for c in found if c])


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    weights = fit(pages, html) if weights is None else weights
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [extract(p, weights) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1).cast(pa.string()), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ], schema=schema)

    return pages.select(F.col(key).cast("long"), F.col(url), F.col(html)).mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
