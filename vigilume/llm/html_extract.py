"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its path of open tags from the root. For every path the length of its texts
and the punctuation in them are summed and divided by the number of its blocks; the two ratios are smoothed over the blocks
in page order, fused into one weight, and paths above the page's own threshold are content. Short blocks of a content area
(a heading, a one-word paragraph) belong to the article as well: all blocks below the innermost element that holds the
content paths are kept. Elements that never hold the main text (menus, forms, scripts, comments and the like, by tag, role
or class name) are left out before and after.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame

from vigilume.llm.arrow_rows import map_rows

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.DOTALL
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
#: Their content is no markup: it ends at their own end tag only.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup",
    "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: An opening tag of the key closes open elements of the value, up to the nearest element outside both.
P_CLOSERS = BLOCK - {"body", "dd", "dt", "head", "html", "li", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"},
    "tfoot": {"tbody", "thead", "tr", "td", "th"},
}
BARRIERS = {"ul", "ol", "dl", "table", "select", "menu", "body", "html"}
#: Never part of the main text, by tag, by role, and by a word of the class or id.
OUT_TAGS = {
    "nav", "footer", "aside", "form", "script", "style", "noscript", "iframe", "template", "button", "select", "menu",
    "textarea", "head", "title", "svg", "canvas", "object", "embed", "dialog", "input", "option", "search", "math",
}
OUT_ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert",
    "alertdialog",
}
OUT_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo",
    "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "side", "aside", "widget",
    "footer", "masthead", "cookie", "cookies", "consent", "notice", "gdpr", "popup", "modal", "overlay", "newsletter",
    "subscribe", "signup", "login", "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies",
    "related", "recommended", "share", "sharing", "social", "toolbar", "pagination", "pager", "skip", "alert",
}
INNER = {"article", "main"}
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
SPACES = re.compile(r"\s+")


def _outside(tag: str, attributes: str, open_tags: list) -> bool:
    if tag in OUT_TAGS or tag == "header" and not any(t in INNER for t, *_ in open_tags):
        return True
    if tag in ("body", "html") or not attributes.strip():
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        name = name.lower()
        if name == "role" and value in OUT_ROLES:
            return True
        if name in ("class", "id") and tag not in INNER and OUT_WORDS & set(re.split(r"[^a-z]+", value)):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", attributes.lower()))


def blocks_of(page: str) -> list[tuple[tuple[int, ...], tuple[str, ...], str, bool]]:
    """Blocks in page order: (ids of the open elements, their tags, text, link text only).

    Elements that never hold the main text are skipped. Tags that browsers close by themselves are closed here, and a page
    that ends early ends all elements, so every block is there.
    """
    out: list[tuple[tuple[int, ...], tuple[str, ...], str, bool]] = []
    stack: list[tuple[str, int, bool]] = []
    text: list[str] = []
    state = {"plain": 0, "link": 0, "id": 0}

    def flush() -> None:
        if text:
            whole = SPACES.sub(" ", html.unescape("".join(text))).strip()
            if whole:
                path = [(i, t) for t, i, _ in stack if t in BLOCK]
                out.append((tuple(i for i, _ in path), tuple(t for _, t in path), whole, not state["plain"]))
            text.clear()
        state["plain"] = state["link"] = 0

    def hidden() -> bool:
        return any(h for _, _, h in stack)

    def take(piece: str) -> None:
        if piece and not hidden():
            text.append(piece)
            if piece.strip():
                state["link" if any(t == "a" for t, *_ in stack) else "plain"] += 1

    def close(upto: int) -> None:
        if any(t in BLOCK for t, *_ in stack[upto:]):
            flush()
        del stack[upto:]

    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            take(page[at:])
            break
        m = TOKEN.match(page, start)
        if not m:
            if page[start + 1 : start + 2] in ("/", "") and start + 2 >= n:  # a tag cut off by the end of the page
                take(page[at:start])
                break
            take(page[at : start + 1])
            at = start + 1
            continue
        take(page[at:start])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                take(" ")
            found = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            if found >= 0 and not (tag not in BLOCK and any(t in BARRIERS for t, *_ in stack[found:])):
                close(found)
            continue
        if tag in BLOCK:
            flush()
            if tag in P_CLOSERS:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in BLOCK:
                        break
        if tag in CLOSES:
            depth = len(stack)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in BARRIERS:
                    break
                if stack[k][0] in CLOSES[tag]:
                    depth = k
            close(depth)
        if tag in VOID:
            if tag in ("br", "hr"):
                take(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = end.start() if end else n
        state["id"] += 1
        stack.append((tag, state["id"], _outside(tag, m[3] or "", stack)))
        if m[3] and m[3].endswith("/") and tag not in BLOCK:
            stack.pop()
    flush()
    return out


def _smooth(values: list[float], sigma: float = 1.0) -> list[float]:
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-2, 3)]
    out = []
    for i in range(len(values)):
        near = [(values[i + k - 2], w) for k, w in enumerate(weights) if 0 <= i + k - 2 < len(values)]
        out.append(sum(v * w for v, w in near) / sum(w for _, w in near))
    return out


def main_text(page: str) -> str:
    """The article of a page, one block a line; '' when the page has no text."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    # per path: length of text and number of punctuation marks, over its number of blocks
    totals: dict[tuple[str, ...], list[int]] = {}
    for _, path, text, link in blocks:
        t = totals.setdefault(path, [0, 0, 0])
        t[0] += 0 if link else len(text)
        t[1] += 0 if link else len(PUNCTUATION.findall(text))
        t[2] += 1
    length = _smooth([totals[p][0] / totals[p][2] for _, p, _, _ in blocks])
    marks = _smooth([totals[p][1] / totals[p][2] for _, p, _, _ in blocks])
    fused = [a * (1 + b) for a, b in zip(length, marks, strict=True)]
    weight: dict[tuple[str, ...], list[float]] = {}
    for (_, path, _, _), f in zip(blocks, fused, strict=True):
        weight.setdefault(path, []).append(f)
    mean = {p: sum(v) / len(v) for p, v in weight.items()}
    center = sum(fused) / len(fused)
    spread = math.sqrt(sum((f - center) ** 2 for f in fused) / len(fused))
    threshold = min(max(center - spread, 0.0), max(mean.values()))
    content = [b for b in blocks if mean[b[1]] >= threshold and not b[3]] or blocks
    # an element of the page that is made for the main text settles where it is
    made = [k for ids, tags, *_ in content for k, t in zip(ids, tags, strict=True) if t in INNER]
    if made:
        inside = {k: sum(len(b[2]) for b in content if k in b[0]) for k in set(made)}
        tag_of = {k: t for ids, tags, *_ in content for k, t in zip(ids, tags, strict=True)}
        articles = {k for k in inside if tag_of[k] == "article"} or set(inside)
        # several articles beside each other belong together; one within another is part of it
        return "\n".join(b[2] for b in blocks if articles & set(b[0]))
    total = sum(len(b[2]) for b in content)
    root: tuple[int, ...] = ()
    while True:  # go inwards as long as one element holds nearly all content
        share: dict[int, int] = {}
        for ids, _, text, _ in content:
            if ids[: len(root)] == root and len(ids) > len(root):
                share[ids[len(root)]] = share.get(ids[len(root)], 0) + len(text)
        best = max(share, key=share.get, default=None)
        if best is None or share[best] < 0.8 * total or not any(len(b[0]) > len(root) + 1 and b[0][: len(root) + 1] == (*root, best) for b in content):
            break
        root = (*root, best)
    return "\n".join(b[2] for b in blocks if b[0][: len(root)] == root)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: (page_id, url, text, n_chars in code points).

    NULL, empty and text-free pages give ''. Repeated rows are each extracted, ids and urls may be NULL, and other columns
    are left behind.
    """
    import pyspark.sql.functions as F

    def make():
        def row(i, url, page):
            text = main_text(page or "")
            yield i, url, text, len(text)

        return row

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_rows(rows, make, "page_id long, url string, text string, n_chars long")
