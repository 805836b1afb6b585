"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks of text. Each block is described by its words and link density, those of its neighbours, and its
tag path: the nearest marked element around it, what share of the page's words that element holds, and what the rest of the
page has. No mark decides by itself. A decision tree, grown on the blocks of a small table of labelled pages, keeps or drops
each block.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

#: Fixed values of the markup: elements within a line, elements whose content is no text, containers, and regions by element.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = set("script style noscript template textarea title svg math iframe object audio video canvas select button".split())
CONTAINERS = set("html body div section article main nav footer header aside form ul ol dl li table thead tbody tr td th figure figcaption blockquote fieldset details dialog menu center".split())
OUTSIDE = set("nav footer aside form menu dialog fieldset".split())
INSIDE = set("article main".split())
#: Words in class, id and role attributes that mark what is not the article, and what is.
MARKS_OUTSIDE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|menu|nav\w*|breadcrumbs?|footer|header|masthead|sidebar|aside|related|widget|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|share|social|comments?|replies|disqus|login|search\w*|contentinfo|complementary|form)(?:$|[\s_-])", re.I)
MARKS_INSIDE = re.compile(r"(?:^|[\s_-])(?:article\w*|content|entry|post|story|main)(?:$|[\s_-])", re.I)
#: Words of these attributes that tell of the state of a page, not of what the element is: has-sidebar, comments-open.
_STATE = re.compile(r"(?<!\S)(?:(?:has|with|without|no)[-_]\S+|\S+[-_](?:open|closed|enabled|disabled|allowed))(?!\S)", re.I)
FORMS = set("form fieldset".split())
#: Silent elements whose content ends at their end tag or with the page. Others without an end tag are passed over.
RAW = set("script style textarea title iframe".split())
#: A tag; where its quotes are not in pairs, it ends at the next >.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*>|[^>]*(?:>|\Z))", re.S)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:$|[\s=>])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

#: What an element marks: a region beside the article; a form or an element whose class, id or role says so, which may be a
#: wrapper of the page as well; nothing; an element whose class, id or role says article; article or main.
REGION, MARKED_OUT, NOTHING, MARKED_IN, ARTICLE = -2, -1, 0, 1, 2
FEATURES = "words links words_before links_before words_after links_after heading nearest beyond share inside_share".split()
#: Pages of the labelled table, and the seed of what they hold.
PAGES, SEED = 480, 11


def labelled_page(rng: random.Random, k: int) -> tuple[str, list[tuple[str, int]]]:
    """An invented page and its blocks with their labels: 1 is main text. k chooses the layout, rng words and sizes."""
    labels: list[tuple[str, int]] = []
    seen: set[str] = set()

    def words(n: int, label: int) -> str:
        text = ""
        while not text or text in seen:
            text = " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(n))
        seen.add(text)
        labels.append((text, label))
        return text

    def links(n: int, label: int = 0) -> str:
        return "<ul>" + "".join(f'<li><a href="/">{words(rng.randrange(1, 5), label)}</a></li>' for _ in range(n)) + "</ul>"

    def paragraphs(n: int, label: int, tag: str = "p") -> str:
        out = []
        for _ in range(n):
            text = words(rng.choice([1, 2, 5, 9, 14, 25, 40, 80, 140]), label)
            if label and rng.random() < 0.15 and " " in text:  # a few words of a sentence are a link
                first, _, rest = text.partition(" ")
                text = f'<a href="/">{first}</a> {rest}'
            out.append(f"<{tag}>{text}</{tag}>")
        return "".join(out)

    def outside(kind: int, long: bool = False) -> str:
        n = rng.randrange(2, 6) if long else rng.randrange(1, 3)
        body = paragraphs(n, 0) if long or kind % 3 else f"<div>{words(rng.randrange(2, 12), 0)}</div>"
        made = [
            lambda: f"<nav>{links(rng.randrange(3, 7))}</nav>", lambda: f'<div class="menu">{links(rng.randrange(3, 7))}</div>', lambda: f'<div class="ad">{words(rng.randrange(3, 14), 0)}</div>', lambda: f"<aside>{body}</aside>",
            lambda: f'<div class="sidebar">{body}{links(3)}</div>', lambda: f'<div class="cookie-notice">{words(rng.randrange(5, 25), 0)}</div>', lambda: f"<footer>{body}</footer>", lambda: f'<div id="footer">{body}</div>',
            lambda: f"<form><label>{words(2, 0)}</label><p>{words(rng.randrange(3, 9), 0)}</p></form>", lambda: f'<section class="comments">{body}{paragraphs(n, 0)}</section>', lambda: f'<div class="related-posts">{links(4)}{body}</div>',
            lambda: f"<header><h1>{words(3, 0)}</h1><p>{words(4, 0)}</p></header>", lambda: f'<div class="newsletter-box">{body}</div>', lambda: f'<div class="article-comments">{paragraphs(n + 1, 0)}</div>',
            lambda: "<div class='comments'>" + "".join(f'<div class="comment"><div class="content">{paragraphs(1, 0)}</div></div>' for _ in range(n + 1)) + "</div>", lambda: f'<aside><article class="teaser"><h3>{words(3, 0)}</h3>{paragraphs(1, 0)}</article></aside>']
        return made[kind]()

    # The article: an element, a marked element, or none at all; in wrappers that look like something else, or not.
    way = k % 5
    opening, closing = [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ('<div id="content"><article class="post">', "</article></div>"), ("<div>", "</div>")][way]
    unmarked = way == 4
    wrap = (k // 5) % 6
    before, after = [("", ""), ('<div class="layout has-sidebar">', "</div>"), ('<form id="aspnetForm">', "</form>"), ('<div class="with-banner page">', "</div>"), ('<div class="promo-frame">', "</div>"), ("<div><div>", "</div></div>")][wrap]
    tiny = k % 7 == 0  # an article of a few words among longer other blocks, or none
    sides = [rng.randrange(16) for _ in range(rng.randrange(1, 4))]
    ends = [rng.randrange(16) for _ in range(rng.randrange(1, 4))]
    page = "<html><body>" + before
    page += "".join(outside(x) for x in sides if not (unmarked and x in (9, 13, 14)))
    if k % 4 == 0 or unmarked:  # a few words that nothing marks
        page += f"<div>{words(rng.randrange(1, 12), 0)}</div>"
    if k % 8 == 7:
        return "<html><body>" + "".join(outside(x, True) for x in rng.sample((3, 3, 6, 6, 7, 9), 1 + k % 3 // 2)) + "</body></html>", labels
    page += opening + (f"<p>{words(rng.randrange(1, 12), 1)}</p>" if tiny else f"<h1>{words(rng.randrange(2, 9), 1)}</h1>")
    for part in range(0 if tiny else rng.randrange(1, 5)):
        page += paragraphs(rng.randrange(1, 5), 1)
        if part and rng.random() < 0.4:
            page += f"<h2>{words(rng.randrange(1, 6), 1)}</h2>" + paragraphs(1, 1)
        if rng.random() < 0.2:
            page += "<ul>" + paragraphs(rng.randrange(2, 5), 1, "li") + "</ul>"
        if rng.random() < 0.25:
            page += rng.choice([outside(2), outside(10), outside(12), links(rng.randrange(3, 6))])
    if k % 3 == 0:
        page += outside((9, 13, 14)[k // 3 % 3], True)
    page += closing + (f"<p>{words(rng.randrange(1, 6), 0)}</p>{links(3)}" if unmarked else "") + "".join(outside(x, tiny or x in (9, 14)) for x in ends)
    return page + after + "</body></html>", labels


def labelled(pages: int = PAGES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of the invented pages."""
    rng, xs, ys = random.Random(seed), [], []
    for k in range(pages):
        page, labels = labelled_page(rng, k)
        want = dict(labels)
        bs, x = described(page)
        xs.append(x)
        ys += [want[b] for b in bs]
    return np.concatenate(xs), np.array(ys)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 12) -> tuple:
    """A tree of (feature, limit, below or at, above) and (label,), by the largest drop of the Gini index. Branches keep `least`
    rows at least."""
    n, total = len(y), int(y.sum())
    if depth == 0 or total in (0, n) or n < 2 * least:
        return (int(2 * total >= n),)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, below = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1  # rows below the limit
        cut = cut[(cut >= least) & (cut <= n - least)]
        if not len(cut):
            continue
        a, b = below[cut - 1] / cut, (total - below[cut - 1]) / (n - cut)
        gini = cut * a * (1 - a) + (n - cut) * b * (1 - b)
        k = int(gini.argmin())
        if best is None or gini[k] < best[0] - 1e-9:
            best = (float(gini[k]), f, float(v[cut[k] - 1] + v[cut[k]]) / 2)
    if best is None or best[0] >= total * (n - total) / n - 1e-9:
        return (int(2 * total >= n),)
    _, f, limit = best
    low = x[:, f] <= limit
    return (f, limit, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


@lru_cache(maxsize=1)
def tree() -> tuple:
    return grow(*labelled())


def classify(node: tuple, x: np.ndarray) -> np.ndarray:
    if len(node) == 1:
        return np.full(len(x), bool(node[0]))
    low = x[:, node[0]] <= node[1]
    out = np.empty(len(x), bool)
    out[low], out[~low] = classify(node[2], x[low]), classify(node[3], x[~low])
    return out


def marks_of(attrs: str) -> str:
    return _STATE.sub(" ", " ".join(next(filter(None, m), "") for m in _ATTR.findall(attrs))) if attrs else ""


def kind_of(name: str, attrs: str, in_article: bool) -> int:
    """What an element marks by itself."""
    marks = marks_of(attrs)
    if name in INSIDE:
        return MARKED_OUT if in_article and MARKS_OUTSIDE.search(marks) else ARTICLE
    if name in FORMS:
        return MARKED_OUT
    if name in OUTSIDE or (name == "header" and not in_article):
        return REGION
    if name in ("html", "body") or not marks:
        return NOTHING
    return MARKED_OUT if MARKS_OUTSIDE.search(marks) else MARKED_IN if MARKS_INSIDE.search(marks) else NOTHING


def silent_ends(page: str, name: str) -> dict[int, int]:
    """For each start tag of a silent element that has its end tag: where it ends, and where its end tag does."""
    out: dict[int, int] = {}
    open_: list[int] = []
    for m in re.compile(rf"<(/?){re.escape(name)}\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>", re.I).finditer(page):
        if m[0].endswith("/>"):
            continue
        if not m[1]:
            if name in ("button", "select"):  # these do not nest
                open_.clear()
            open_.append(m.end())
        elif open_:
            out[open_.pop()] = m.end()
    return out


def parsed(page: str) -> tuple[list[tuple[str, int, int, int, int]], list[tuple[str, str, int]]]:
    """Flat blocks in page order: text, words, words in links, container, heading; and containers: name, attributes, container
    around it. Containers are places in their list, -1 for none."""
    out: list[tuple[str, int, int, int, int]] = []
    nodes: list[tuple[str, str, int]] = []
    ends: dict[str, dict[int, int]] = {}
    stack: list[tuple[str, int]] = []
    text: list[str] = []
    linked = links = heading = pos = 0

    def flush() -> None:
        nonlocal linked
        words = "".join(text).split()
        if words:
            out.append((" ".join(words), len(words), min(linked, len(words)), stack[-1][1] if stack else -1, heading))
        text.clear()
        linked = 0

    while True:
        m = _TAG.search(page, pos)
        piece = entities.unescape(page[pos : m.start() if m else len(page)])
        if piece:
            text.append(piece)
            if links:
                linked += len(piece.split())
        if not m:
            break
        pos = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing = bool(m[1])
        if name in SILENT:
            flush() if name not in ("button", "select") else text.append(" ")
            if not closing and not m[3].endswith("/"):
                if name in RAW:
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
                    pos = end.end() if end else len(page)
                else:
                    if name not in ends:
                        ends[name] = silent_ends(page, name)
                    pos = ends[name].get(pos, pos)
        elif name in INLINE:
            if name == "br":
                text.append(" ")
            elif name == "a":
                links = 0 if closing else 1
        else:
            flush()
            links = 0
            if name[0] == "h" and name[1:] in "1 2 3 4 5 6".split():
                heading = 0 if closing else 1
            elif name in CONTAINERS:
                if not closing:
                    nodes.append((name, m[3], stack[-1][1] if stack else -1))
                    stack.append((name, len(nodes) - 1))
                elif any(s[0] == name for s in stack):
                    while stack.pop()[0] != name:
                        pass
                heading = 0
            elif not closing:
                heading = 0
    flush()
    return out, nodes


def described(page: str) -> tuple[list[str], np.ndarray]:
    """The shown blocks of a page and their features, in the order of FEATURES."""
    bs, nodes = parsed(page)
    nearest, beyond, at = [NOTHING] * (len(nodes) + 1), [NOTHING] * (len(nodes) + 1), [-1] * (len(nodes) + 1)
    own, hidden = [False] * (len(nodes) + 1), [False] * (len(nodes) + 1)
    for i, (name, attrs, above) in enumerate(nodes):
        kind = kind_of(name, attrs, own[above])
        hidden[i] = hidden[above] or bool(_HIDDEN.search(attrs))
        own[i] = own[above] or kind == ARTICLE
        nearest[i], beyond[i], at[i] = (kind, nearest[above], i) if kind else (nearest[above], beyond[above], at[above])
    bs = [b for b in bs if not hidden[b[3]]]
    # Words that are in no link: of each element, of the page, and of blocks whose nearest mark says article.
    words = [0] * (len(nodes) + 1)
    for b in bs:
        words[b[3]] += b[1] - b[2]
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i][2] >= 0:
            words[nodes[i][2]] += words[i]
    total = max(1, sum(b[1] - b[2] for b in bs))
    inside = sum(b[1] - b[2] for b in bs if nearest[b[3]] in (ARTICLE, MARKED_IN)) / total
    # Where article or main is in nothing that looks like another region, what is not in one is beside it.
    sure = any(own[i] and nearest[i] == ARTICLE and beyond[i] >= NOTHING for i in range(len(nodes)))
    padded = [(0, 0.0), *((b[1], b[2] / b[1]) for b in bs), (0, 0.0)]
    rows = []
    for i, b in enumerate(bs):
        n = b[3]
        share = words[at[n]] / total if at[n] >= 0 else 1.0
        rows.append([*padded[i + 1], *padded[i], *padded[i + 2], b[4], REGION if sure and not own[n] else min(nearest[n], 1), min(beyond[n], 1), share, inside])
    return [b[0] for b in bs], np.array(rows, float).reshape(len(rows), len(FEATURES))


def main_texts(pages: list[str], node: tuple | None = None) -> list[str]:
    found = [described(p) for p in pages]
    keep = classify(node or tree(), np.concatenate([x for _, x in found])).tolist() if found else []
    out, k = [], 0
    for bs, _ in found:
        out.append("\n\n".join(b for b, yes in zip(bs, keep[k : k + len(bs)], strict=True) if yes))
        k += len(bs)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: id, url, text (empty if there is no main text), n_chars.

    Null html counts as empty. Repeated rows give repeated rows, an empty table none. Other columns are ignored.
    """
    node = tree()
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = main_texts(b["html"].to_pylist(), node)
            yield pa.RecordBatch.from_arrays([b["id"], b["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["id", "url", "text", "n_chars"])

    return rows.mapInArrow(extracted, f"id {rows.schema['id'].dataType.simpleString()}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
