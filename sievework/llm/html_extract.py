"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by their tag path from the root to the leaf.
For each path the mean text length and the mean number of punctuation marks of
its nodes are taken, smoothed over the nodes in page order and fused; nodes above
the standard deviation of the page are content. The lowest element that holds most
of the content is the main element, and its blocks are the main text, short ones
included; content outside of it stays where its paths are those of the main
element's. An article or main element that holds half of the content goes before a
lower one. Elements that say that they are menus, adverts, forms or the like never count.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption option".split()
)
CLOSES_P = BLOCK - {"html", "body", "dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option"}
#: A start tag ends an open element of these, up to the container in which they nest.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
#: Elements without main text.
NEVER = frozenset("head script style noscript template iframe object svg math canvas audio video form button select textarea input label fieldset nav footer aside menu dialog title option noembed noframes search xmp".split())
#: Words of class, id and role that mark what is not main text.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|adbox|banner|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|paywall|"
    r"nav|navbar|navigation|menu|menus|breadcrumb|breadcrumbs|pagination|pager|toc|header|masthead|topbar|footer|bottom|copyright|legal|disclaimer|sidebar|side|aside|widget|widgets|related|recommended|recommendations|trending|popular|"
    r"share|sharing|social|follow|comment|comments|commentlist|reply|replies|respond|disqus|discussion|search|searchform|form|skip|hidden|contentinfo|complementary|dialog|tags|tagcloud)(?:$|[\s_-])",
    re.I,
)
#: Block elements that are text themselves, not containers of it.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre".split())
#: Share of the content that the main element holds.
MOST = 0.7
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.S)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Element:
    __slots__ = ("tag", "path", "parent", "out", "depth")

    def __init__(self, tag: str, parent: Element | None, out: bool):
        self.tag, self.parent, self.out = tag, parent, out
        self.path = f"{parent.path}/{tag}" if parent else tag
        self.depth = parent.depth + 1 if parent else 0


def _marked(tag: str, raw: str) -> bool:
    """Whether an element's attributes say that it is not main text."""
    if not raw or raw.isspace():
        return False
    at = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}
    if "hidden" in at or at.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(at.get("style", "")):
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    return any(MARKS.search(at.get(k, "")) for k in ("class", "id", "role"))


def blocks_of(page: str) -> list[tuple[Element, list[tuple[Element, str]]]]:
    """Blocks in page order: the block's element, and its text nodes with their elements."""
    root = Element("#", None, False)
    at, out, block = root, [], []
    pos, n = 0, len(page)

    def flush() -> None:
        nonlocal block
        if any(not t.isspace() for _, t in block):
            owner = block[0][0]
            for e, t in block:
                if not t.isspace():
                    owner = e
                    break
            while owner.tag not in BLOCK and owner.parent:
                owner = owner.parent
            out.append((owner, block))
        block = []

    def close(to: Element) -> None:
        """Ends all open elements below ``to``."""
        nonlocal at
        while at is not to:
            if at.tag in BLOCK:
                flush()
            at = at.parent

    while pos < n:
        m = _TOKEN.search(page, pos)
        if m is None or m.start() > pos:
            text = page[pos : m.start() if m else n]
            block.append((at, html.unescape(text) if "&" in text else text))
        if m is None:
            break
        pos = m.end()
        if m[0].startswith("<![CDATA["):
            block.append((at, m[0][9:].removesuffix("]]>")))
            continue
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            e = at
            while e is not root and e.tag != tag:
                e = e.parent
            if e is not root:
                close(e.parent)
            elif tag in BLOCK:
                flush()
            continue
        if tag == "br":
            block.append((at, "\n"))
            continue
        if tag in CLOSES_P or tag in IMPLIED:
            enders, within = IMPLIED.get(tag, (set(), set()))
            enders = enders | ({"p"} if tag in CLOSES_P else set())
            e, last = at, None
            while e is not root and e.tag not in within and not (tag in CLOSES_P and e.tag in ("button", "table", "td", "th", "caption")):
                if e.tag in enders:
                    last = e
                e = e.parent
            if last:
                close(last.parent)
        if tag in VOID:
            if tag in BLOCK:
                flush()
            continue
        if tag in BLOCK:
            flush()
        e = Element(tag, at, at.out or tag in NEVER or _marked(tag, attributes) or (tag == "header" and not _inside(at, ("article", "main"))))
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, pos)
            text = page[pos : end.start() if end else n]
            if not e.out:
                block.append((e, html.unescape(text)))
            pos = end.end() if end else n
            if tag in BLOCK:
                flush()
            continue
        at = e
    close(root)
    flush()
    return out


def _inside(e: Element | None, tags: tuple[str, ...]) -> bool:
    while e:
        if e.tag in tags:
            return True
        e = e.parent
    return False


def path_scores(blocks) -> np.ndarray:
    """A fused, smoothed tag-path ratio for each block that is not marked."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    nodes = []
    for k, (_, texts) in enumerate(blocks):
        for e, t in texts:
            size = len("".join(t.split()))
            if size:
                length[e.path] += size
                marks[e.path] += len(PUNCTUATION.findall(t))
                count[e.path] += 1
                nodes.append((k, e.path, size))
    if not nodes:
        return np.zeros(len(blocks))
    ratio = np.array([length[p] / count[p] for _, p, _ in nodes])
    weight = np.array([marks[p] / count[p] for _, p, _ in nodes])
    smooth = np.array([0.25, 0.5, 0.25])

    def smoothed(x: np.ndarray) -> np.ndarray:
        y = np.concatenate([x[:1], x, x[-1:]])
        return np.convolve(y, smooth, "valid")

    fused = smoothed(ratio) * (1 + smoothed(weight))
    score = np.zeros(len(blocks))
    np.maximum.at(score, [k for k, _, _ in nodes], fused)
    return score


def main_blocks(page: str) -> list[str]:
    """The blocks of the main text, in page order.

    Content nodes are those whose path score passes the threshold. The main
    element is the lowest that holds most of their text; where that is part of an
    article or main element, or such an element holds half of their text, it is that one.
    Content nodes outside of it stay if their paths are among those within, as in an
    article that is spread over siblings, or score as high as the mean of these.
    """
    blocks = [b for b in blocks_of(page) if not all(e.out for e, t in b[1] if not t.isspace())]
    blocks = [(owner, [(e, t) for e, t in texts if not e.out]) for owner, texts in blocks]
    if not blocks:
        return []
    score = path_scores(blocks)
    content = score >= min(score.std(), score.max())
    weight = np.array([sum(len("".join(t.split())) for _, t in texts) for _, texts in blocks]) * score * content
    inside: dict[int, tuple[Element, float]] = {}
    for (owner, _), w in zip(blocks, weight, strict=True):
        e = owner
        while w and e:
            inside[id(e)] = (e, inside.get(id(e), (e, 0.0))[1] + w)
            e = e.parent
    total = float(weight.sum())
    main = max(((e.depth, w, k) for k, (e, w) in inside.items() if w >= MOST * total))
    main = inside[main[2]][0]
    # The outermost of those that hold the most: parts of an article may be articles themselves.
    articles = [(w, -e.depth, k) for k, (e, w) in inside.items() if e.tag in ("article", "main")]
    if articles and max(articles)[0] >= total / 2:
        main = inside[max(articles)[2]][0]
    while main.parent and (main.tag not in BLOCK or main.tag in TEXT):
        main = main.parent
    within = np.array([_under(owner, main) for owner, _ in blocks])
    paths = {owner.path for (owner, _), w, good in zip(blocks, within, content, strict=True) if w and good}
    mean = float(np.average(score[within & content], weights=weight[within & content])) if weight[within].any() else 0.0
    out = []
    for (owner, texts), w, good, s in zip(blocks, within, content, score, strict=True):
        text = " ".join("".join(t for _, t in texts).split())
        if text and (w or good and (owner.path in paths or s >= mean)):
            out.append(text)
    return out


def _under(e: Element | None, top: Element) -> bool:
    while e and e is not top:
        e = e.parent
    return e is top


def main_text(page: str | None) -> str:
    return "\n".join(main_blocks(page)) if page else ""


def plain_text(page: str | None) -> str:
    """All text that a page shows, block by block."""
    hidden = ("head", "script", "style", "noscript", "template", "title", "iframe", "noembed", "noframes", "xmp")
    out = []
    for _, texts in blocks_of(page or ""):
        if text := " ".join("".join(t for e, t in texts if not _inside(e, hidden)).split()):
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    Null and empty pages have an empty text. Repeated rows come out as often as
    they go in; extra columns are not read. No shuffle.
    """
    common.session(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kept = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return kept.mapInArrow(run, "page_id long, url string, text string, n_chars long")
