"""Main text of web pages: the maximum-scoring run of words and tags, with tag weights from labelled pages."""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, text string, n_chars long"
#: Elements whose content is never text.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video head textarea select button datalist".split())
#: Elements that are page furniture wherever they stand. A header outside the article is, too.
ASIDE = frozenset("nav footer aside form dialog menu".split())
#: Elements that begin and end a block.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role names that mean furniture, and those that say nothing by themselves.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsors sponsored promo promos promotion promotions banner banners cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget masthead footer comment comments replies disqus respond share sharing social related recommended newsletter subscribe subscription signup login search pagination pager complementary contentinfo toolbar skip".split()
)
PLAIN = frozenset("site page global main top bottom left right inner outer box bar list wrap wrapper container block section area panel item items link links button buttons btn slot unit form field fields icons post posts article articles blog story stories user reader side sign up header body text fixed sticky mobile desktop primary secondary info law content holder row col group".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[A-Za-z][^<>]*\Z", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I | re.S)
_SPACE = re.compile(r"\s+")
#: Labelled pages that tag weights are fitted on: a documented, bounded sample.
SAMPLE = 2000
#: What a word adds; what a tag takes away lies between these, by the fitted odds.
WORD, LEAST, MOST = 1.0, 0.001, 3.0
#: What a left-out element takes away, whole, and a tag that the sample doesn't hold: two of these are less than a word.
LEFT_OUT, UNSEEN = 0.4, 0.25


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value) in page order: text with its string, open and close with the attributes' string."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                yield "text", "", m[0][9:-3]
            continue
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, m[3] or ""
        if name in ("script", "style", "textarea", "title", "noscript", "template", "iframe") and not (m[3] or "").endswith("/"):
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            inner = page[at : end.start()] if end else page[at:]
            if name == "title" and inner:
                yield "text", "", inner
            at = end.end() if end else n
            yield "close", name, ""


def names_furniture(value: str) -> bool:
    """Whether one of the names in a class, id or role means furniture: by all its parts, so "related-work" does not."""
    for name in value.split():
        parts = [p.lower() for p in _PART.findall(name)]
        if any(p in NAMED for p in parts) and all(p in NAMED or p in PLAIN for p in parts):
            return True
    return False


def furniture(name: str, attrs: str, in_article: bool) -> bool:
    """Whether an element is left out wherever it stands."""
    if name in RAW or name in ASIDE or name == "header" and not in_article:
        return True
    if not attrs:
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key in ("class", "id", "role") and name not in ("html", "body", "article", "main") and names_furniture(value):
            return True
    return False


def feature(kind: str, name: str, left_out: bool) -> str:
    return ("-" if left_out else "") + ("/" if kind == "close" else "") + name


def stream(page: str) -> list[tuple[str, str, bool]]:
    """("word" | "tag", text or feature, inside the article): what is scored. Left-out elements are one tag each.

    Unclosed elements end where one of their ancestors does, or with the page.
    """
    out: list[tuple[str, str, bool]] = []
    stack: list[tuple[str, bool]] = []
    skipping = inside = 0
    for kind, name, value in tokens(page):
        if kind == "text":
            if not skipping and value:
                out.append(("word", value, inside > 0))
            continue
        if kind == "open":
            if name in VOID:
                if not skipping:
                    out.append(("tag", feature(kind, name, False), inside > 0))
                continue
            left_out = furniture(name, value, inside > 0)
            if not skipping:
                out.append(("tag", feature(kind, name, left_out), inside > 0))
            if value.endswith("/"):
                continue
            stack.append((name, left_out))
            skipping += left_out
            inside += name in ("article", "main")
            continue
        found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
        if found is None:
            continue
        if name not in BLOCKS and any(x in BLOCKS for x, _ in stack[found + 1 :]):
            continue  # an inline end tag doesn't close the blocks opened after it
        own = stack[found][1]
        for x, left_out in reversed(stack[found:]):
            skipping -= left_out
            inside -= x in ("article", "main")
        del stack[found:]
        if not skipping and not own:
            out.append(("tag", feature(kind, name, False), inside > 0))
    return out


def fit(pages: Iterator[str]) -> dict[str, float]:
    """Tag weights from labelled pages: those whose article or main element marks the content.

    A tag costs more the likelier it stands outside the content. Left-out elements have one cost: their own words
    don't count, so where they stand says nothing about the words beside them.
    """
    within, without = Counter(), Counter()
    for page in pages:
        items = stream(page)
        if not any(inside for _, _, inside in items):
            continue
        for kind, x, inside in items:
            if kind == "tag" and not x.startswith("-"):
                (within if inside else without)[x] += 1
    odds = {x: math.log((without[x] + 0.5) / (within[x] + 0.5)) for x in {*within, *without}}
    return {x: min(MOST, LEAST + max(0.0, v) * 4) for x, v in sorted(odds.items())}


def best_run(items: list[tuple[str, str, bool]], weights: dict[str, float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the highest score, by one scan; the first and longest of equals.

    On a page that marks content, words inside the marks alone count and nothing takes away, so the run reaches from the
    first marked word to the last, however many marks there are and whatever stands between them.
    """
    marked = _marked(items)
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, (kind, x, inside) in enumerate(items):
        if kind == "word":
            total += WORD * len(x.split()) if inside or not marked else 0.0
        elif not marked:
            total -= weights.get(x, LEFT_OUT if x.startswith("-") else UNSEEN)
        if total < 0:
            total, start = 0.0, i + 1
        elif total > best or total == best and best_at[0] == start:
            best, best_at = total, (start, i + 1)
    return best_at


def _marked(items: list[tuple[str, str, bool]]) -> bool:
    return any(inside and kind == "word" and x.strip() for kind, x, inside in items)


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text: blocks joined by one newline, white space inside a block one space. Null and empty pages: empty.

    Of the best run the words are taken, where the page marks content (article or main) those inside the marks.
    """
    items = stream(page or "")
    marked = _marked(items)
    start, end = best_run(items, weights)
    items = [x if x[0] == "tag" or x[2] or not marked else ("tag", "-outside", False) for x in items[start:end]]
    blocks, now = [], []
    for kind, x, _ in items:
        if kind == "word":
            now.append(x)
        elif x.lstrip("-/") in BLOCKS or x.startswith("-"):
            blocks.append("".join(now))
            now = []
        elif x == "br":
            now.append(" ")
    blocks.append("".join(now))
    texts = (_SPACE.sub(" ", _html.unescape(b)).strip() for b in blocks)
    return "\n".join(t for t in texts if t)


def fitted(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights from at most ``sample`` pages, those with the smallest hashes of id and url; unlabelled ones are passed over.

    The hashes are compared first, so html is not shuffled.
    """
    hashed = pages.select(F.xxhash64("page_id", "url").alias("__h"), "html")
    last = hashed.select("__h").orderBy("__h").limit(sample).agg(F.max("__h")).first()[0]
    if last is None:
        return {}
    some = hashed.where((F.col("__h") <= last) & F.col("html").isNotNull()).select("html").limit(sample)
    return fit(r["html"] for r in some.toLocalIterator())


def main_texts(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html).

    Null and empty html give an empty text; whole pages are read, cut-off ones as far as they go; repeated rows and
    null ids each have a row; other columns are ignored; an empty table gives no rows.
    """
    w = fitted(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x.as_py(), w) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, SCHEMA)
