"""HTML extraction: flat text blocks, classified by a decision tree.

A page is read once, as tags and text.  Text between the borders of block elements is one
block.  Each block has its word count and link density, those of the blocks before and after
it, and what its open elements say: whether an article or main part holds it and whether a
navigation, form, advert, comment part and so on does.  A decision tree, trained in numpy on
the blocks of the small labelled pages below, keeps a block or drops it.

Defined results: null and empty pages give an empty text; text outside any block element is
a block; ``br`` is white space; scripts, styles and the like that are never closed run to the
end of the page; tags that are never closed end where an outer one does.  Repeated pages give
equal rows.  Only id, url and html are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laggard.llm.common import table

#: A comment, a declaration, or a tag; quotes count after an equals sign only.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>?",
                 re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Elements without text of the page; those of the first kind run to the end of the page if never closed.
RAW = frozenset("script style textarea title iframe xmp".split())
SKIPPED = RAW | frozenset("noscript template svg math object select button canvas audio video".split())
CLOSING = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in SKIPPED}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table caption tbody
thead tfoot td th tr ul frameset""".split())
#: Elements whose nesting is followed; of p, li and the like only the borders count.
NESTED = frozenset("""body article aside blockquote details dialog div dl fieldset figure footer form header main menu nav ol
section table ul a p h1 h2 h3 h4 h5 h6 li td span""".split())
ENDS_WITH_NEXT = {"p": BLOCK, "li": {"li"}, "td": {"td", "th", "tr"}, "a": {"a"}}
BAD_TAGS = frozenset("nav aside footer form menu dialog fieldset header".split())
GOOD_TAGS = frozenset(("article", "main"))
STRONG = frozenset("""nav navbar navigation menu breadcrumb breadcrumbs footer ad ads adv advert adverts advertisement advertising
sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe
subscription signup share sharing social related recommended recommendations comment comments commentlist commentary disqus
reply replies respond responses discussion form search login hidden pagination pager toolbar skip copyright legal widget
complementary contentinfo navigation dropdown""".split())
WEAK = frozenset("header masthead banner sidebar side aside meta tags byline rail toplinks links".split())
GOOD = frozenset("article articlebody content main post story entry text body prose".split())
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "inside", "bad")


def hint(tag: str, attributes: str) -> int:
    """What an element says of its text: 1 article, -1 not the article, 0 nothing."""
    if tag in GOOD_TAGS:
        good, bad = True, False
    else:
        good, bad = False, tag in BAD_TAGS and tag != "header"
    weak = tag == "header"
    if attributes.strip():
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role"):
                parts = [x.lower() for x in NAME_PARTS.findall(value)]
                bad |= not STRONG.isdisjoint(parts)
                weak |= not WEAK.isdisjoint(parts)
                good |= not GOOD.isdisjoint(parts)
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) \
                    or name == "aria-hidden" and value == "true":
                bad = True
        if re.search(r"(?:^|\s)hidden(?:\s|$)", attributes):
            bad = True
    if tag in GOOD_TAGS:
        return -1 if bad else 1
    if bad:
        return -1
    if good and weak:
        return 0
    return 1 if good else -1 if weak else 0


def blocks_of(page: str) -> list[tuple[str, int, int, int, int]]:
    """(text, words, words in links, inside an article, inside a bad part) in page order."""
    out: list[tuple[str, int, int, int, int]] = []
    stack: list[tuple[str, int, int]] = []   # open elements: tag, inside, bad
    inside = bad = 0
    parts: list[str] = []
    linked: list[str] = []
    in_link = 0

    def close_block() -> None:
        text = " ".join(unescape("".join(parts)).split())
        if text:
            n = text.count(" ") + 1
            out.append((text, n, min(n, len(unescape("".join(linked)).split())), inside, bad))
        parts.clear()
        linked.clear()

    def leave(upto: int) -> None:
        nonlocal inside, bad, in_link
        del stack[upto:]
        inside, bad = stack[-1][1:] if stack else (0, 0)
        in_link = sum(x[0] == "a" for x in stack)

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            text = page[at:m.start()]
            parts.append(text)
            if in_link:
                linked.append(text + " ")
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK:
                close_block()
            if tag in NESTED:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        leave(i)
                        break
                    if tag in ("p", "a", "span", "li", "td") and stack[i][0] in ("article", "main", "section", "div", "body", "nav"):
                        break
            continue
        if tag in SKIPPED:
            if m[0].endswith("/>"):
                continue
            close = CLOSING[tag].search(page, at)
            at = close.end() if close else end if tag in RAW else at
            parts.append(" ")
            continue
        if tag in BLOCK:
            close_block()
        elif tag in ("br", "img", "td", "wbr"):
            parts.append(" ")
        if tag in VOID or tag not in NESTED or m[0].endswith("/>"):
            continue
        if stack and tag in ENDS_WITH_NEXT.get(stack[-1][0], ()):
            leave(len(stack) - 1)
        elif tag in BLOCK and tag not in ("li", "td", "p"):
            # a link or paragraph that was never closed ends where a block begins
            while stack and stack[-1][0] in ("p", "span"):
                leave(len(stack) - 1)
        said = 0 if tag in ("body", "a", "span") and not m[3].strip() or tag == "body" else hint(tag, m[3])
        if tag == "header" and inside and said < 0 and not m[3].strip():
            said = 0               # an article's own heading
        if said > 0 and tag in GOOD_TAGS and stack and not any(t in GOOD_TAGS for t, _, _ in stack):
            inside, bad = 1, 0     # an article in a wrapper that looks like a form or menu
        elif said > 0:
            inside = 1
        elif said < 0:
            bad = 1
        stack.append((tag, inside, bad))
        if tag == "a":
            in_link += 1
    close_block()
    return out


def features_of(blocks: list[tuple[str, int, int, int, int]]) -> np.ndarray:
    """One row of FEATURES for each block; beyond the page's ends nothing has no words."""
    n = len(blocks)
    words = np.array([0, *(b[1] for b in blocks), 0], float)
    links = np.array([0, *(b[2] for b in blocks), 0], float) / np.maximum(words, 1)
    x = np.empty((n, len(FEATURES)))
    x[:, 0], x[:, 1], x[:, 2], x[:, 3], x[:, 4], x[:, 5] = words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:]
    x[:, 6], x[:, 7] = [b[3] for b in blocks], [b[4] for b in blocks]
    return x


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1):
    """A decision tree by Gini impurity: a share of kept blocks, or (feature, cut, low, high)."""
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return share
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, kept = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        ok = (v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least)
        if not ok.any():
            continue
        low, high = kept[:-1], kept[-1] - kept[:-1]
        gini = low * (1 - low / n) + high * (1 - high / (len(y) - n))
        i = int(np.argmin(np.where(ok, gini, np.inf)))
        if best is None or gini[i] < best[0] - 1e-12:
            best = (gini[i], f, (v[i] + v[i + 1]) / 2)
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return share
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def judge(tree, x: np.ndarray) -> np.ndarray:
    """Share of kept blocks of each row's leaf."""
    out = np.empty(len(x))

    def go(node, rows):
        if isinstance(node, tuple):
            low = x[rows, node[0]] <= node[1]
            go(node[2], rows[low])
            go(node[3], rows[~low])
        else:
            out[rows] = node
    go(tree, np.arange(len(x)))
    return out


PROSE = ("The river rose slowly over the week and by Sunday the lower meadows stood under water again, as they had two "
         "years before, when the bridge was closed.")
SHORT = "Nothing was decided."


def labelled_pages() -> list[tuple[str, list[int]]]:
    """The small labelled table: pages and, for each of their blocks in order, whether it is kept."""
    menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "World", "Sport", "Contact"))
    teasers = "".join(f"<p><a href='/{i}'>{PROSE[:40 + i]}</a></p>" for i in (3, 9, 14))
    pages = []
    for opened, closed in (("<article>", "</article>"), ("<main>", "</main>"),
                           ('<div class="post-content">', "</div>"), ('<div id="story">', "</div>")):
        pages += [
            (f"<nav><ul>{menu}</ul></nav><div class=ad>{PROSE}</div>{opened}<h1>High water</h1><p>{PROSE}</p><p>{SHORT}</p>"
             f"<p>Rain.</p><ul><li>One boat</li><li>Two pumps</li></ul>{closed}<footer>&copy; 2020 {PROSE}</footer>",
             [0] * 5 + [1] * 6 + [0]),
            (f"<div class='header'><a href=/>Herald</a></div><div class=cookie-notice><p>{PROSE}</p></div>{opened}<p>{SHORT}</p>"
             f"<p>{PROSE}</p><aside><p>{PROSE}</p></aside><p>See <a href=/x>the map</a> of it.</p><p>{PROSE}</p>{closed}"
             f"<section class=comments><p>{PROSE}</p><p>{SHORT}</p></section>",
             [0, 0, 1, 1, 0, 1, 1, 0, 0]),
            (f"{opened}<h2>Flood</h2><p>{PROSE}</p><form><p>{SHORT}</p><p>{PROSE}</p></form><blockquote>{SHORT}</blockquote>"
             f"<p><a href=/y>{SHORT}</a></p>{closed}<div class=sidebar>{teasers}</div>",
             [1, 1, 0, 0, 1, 1, 0, 0, 0]),
        ]
    pages += [  # pages that name no part: words and links of a block and its neighbours must do
        (f"<div>{''.join(f'<p><a href=/{w}>{w}</a></p>' for w in 'abcd')}</div><p>{PROSE}</p><p>{PROSE}</p><p>{SHORT}</p>"
         f"<p>{PROSE}</p><div><p><a href=/z>More</a></p><p>Terms</p></div>", [0] * 4 + [1] * 4 + [0, 0]),
        (f"<p>Menu</p><p><a href=/q>Search here</a></p><p>{PROSE} {PROSE}</p><p>{PROSE}</p><p><a href=/b>{PROSE}</a></p>"
         f"<p><a href=/c>{PROSE}</a></p><p>Imprint</p>", [0, 0, 1, 1, 0, 0, 0]),
        (f"<p><a href=/>Home</a></p><p>{PROSE}</p><p>Rain.</p><p>{PROSE}</p><p>{PROSE} {PROSE}</p><p>More rain.</p><p>{PROSE}</p>"
         f"<p>{SHORT}</p><p>Rain.</p><p>{PROSE}</p><p><a href=/n>Next</a></p><p>Terms</p>", [0] + [1] * 9 + [0, 0]),
        (f"<p>Contact</p><p>Help</p><p><a href=/s>Shop</a></p><p>{PROSE}</p><p>No more.</p><p>{PROSE}</p><p><a href=/t>Top</a></p>"
         f"<p>Privacy notes</p><p>Imprint</p>", [0, 0, 0, 1, 1, 1, 0, 0, 0]),
    ]
    return pages


@lru_cache(maxsize=1)
def default_tree():
    return train(labelled_pages())


def train(pages: list[tuple[str, list[int]]]):
    x, y = [], []
    for page, kept in pages:
        blocks = blocks_of(page)
        if len(blocks) != len(kept):
            raise ValueError(f"{len(kept)} labels for {len(blocks)} blocks: {[b[0][:20] for b in blocks]}")
        x.append(features_of(blocks))
        y += kept
    return grow(np.concatenate(x), np.array(y, float))


def main_text(page: str | None, tree) -> str:
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    keep = judge(tree, features_of(blocks)) >= 0.5
    return "\n".join(b[0] for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", tree=None) -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    tree = default_tree() if tree is None else tree
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                texts = [main_text(p, tree) for p in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()),
                                                  pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html")) \
        .mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
