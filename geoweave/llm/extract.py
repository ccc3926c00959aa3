"""Main text of web pages from flat text blocks.

A page is read into a flat list of text blocks. A block is described by its own number of words and link density, by those of its neighbours on both sides, and by what the
elements around it are called (article or furniture); a decision tree says whether it belongs to the article. The tree is grown on a small labelled table when the
operator starts, so nothing is stored that was trained elsewhere.
"""

from __future__ import annotations

import html as standard
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.labelled_blocks import LABELLED

#: Element names of the HTML standard by how they act on text.
BREAKING = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
                     "nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset("script style title textarea iframe noscript template noframes noembed svg math object select canvas audio video".split())
#: What closes an open element of the same kind: (opening, those it closes, what stops the search).
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Words in names, classes and roles of elements. A page part named so is furniture; inside the first kind everything is, inside the second an article may stand.
NEVER = frozenset("nav navigation navbar menu breadcrumb breadcrumbs aside sidebar footer comment comments commentlist disqus replies respond discussion cookie cookies consent gdpr ad ads advert adverts advertisement "
                  "advertising adsense sponsor sponsored promo related recommended popular trending newsletter subscribe share sharing social dialog modal popup pagination pager hidden complementary contentinfo".split())
FURNITURE = frozenset("header masthead topbar banner form search login signup register toolbar widget widgets rail notice notices alert overlay copyright legal disclaimer skip tags".split())
ARTICLE = frozenset("article main content post entry story".split())
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "named", "inside", "never", "heading", "has_article")

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/>]*))")
_REST = re.compile(r"(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


def naming(tag: str, attributes: dict[str, str]) -> tuple[int, bool]:
    """(named, never): -1 for furniture, 1 for an article, 0 for neither, and whether everything inside is furniture."""
    if tag in ("html", "body"):
        return 0, False
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")) is not None
    words = {tag}
    for name in ("class", "id", "role", "itemprop"):
        for token in attributes.get(name, "").split():
            parts = [w.lower() for w in _WORDS.findall(_HUMP.sub(" ", token))]
            # "has-sidebar" and "comments-open" tell about a page, not what stands inside
            if parts and not ({parts[0], parts[-1]} & {"has", "no", "with", "without", "open", "closed"}):
                words.update(parts)
    if hidden or words & NEVER:
        return -1, True
    return (-1, False) if words & FURNITURE else (1, False) if words & ARTICLE else (0, False)


def described(elements: list[tuple[str, int, bool]]) -> tuple[int, bool, bool, bool]:
    """(named, inside, never, heading) from the open elements, outermost first: what the innermost named one says, whether any is an article, whether anything is lost inside, and whether it is a heading."""
    named = next((n for _, n, _ in reversed(elements) if n), 0)
    return named, any(n > 0 for _, n, _ in elements), any(x for _, _, x in elements), any(t in HEADINGS for t, _, _ in elements)


def flat_blocks(page: str) -> list[tuple[str, int, int, int, bool, bool, bool]]:
    """(text, words, linked words, named, inside, never, heading) of each non-empty block in page order.

    Character references are decoded, white space becomes one space; two line breaks in a row part a block as elements do. An unclosed comment, script or tag ends the page.
    """
    out, pieces, linked = [], [], 0
    stack: list[tuple[str, int, bool]] = []
    links, breaks, at, end = 0, 0, 0, len(page)

    def flush():
        nonlocal linked, breaks
        text = " ".join("".join(pieces).split())
        if text:
            out.append((text, text.count(" ") + 1, linked, *described(stack)))
        pieces.clear()
        linked = breaks = 0

    def close(names, stops=()):
        """Close the innermost open element of `names`, and what is open inside it, unless one of `stops` comes first."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in stops:
                return

    while at < end:
        m = _OPEN.search(page, at)
        to = m.start() if m else end
        if to > at:
            text = standard.unescape(page[at:to])
            pieces.append(text)
            if links:
                linked += len(text.split())
            if breaks and not text.isspace():
                breaks = 0
        if not m:
            break
        at = m.end()
        if m[1]:
            found = page.find("-->", at)
            at = end if found < 0 else found + 3
            continue
        if m[2]:
            found = page.find(">", at)
            at = end if found < 0 else found + 1
            continue
        tag = m[4].lower()
        rest = _REST.match(page, at)
        found = rest.end() if rest else page.find(">", at) + 1
        inside, at = page[at:found - 1], found or end
        if m[3]:
            if tag in BREAKING:
                flush()
                close({tag})
            elif tag == "a":
                links = 0
            continue
        if tag == "br":
            breaks += 1
            pieces.append(" ")
            if breaks > 1:
                flush()
            continue
        if tag in SKIPPED:
            if tag in BREAKING:
                flush()
            if not inside.endswith("/"):
                found = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
                at = found.start() if found else end
            continue
        if tag == "a":
            links = 1
        elif tag in BREAKING:
            flush()
            if stack and stack[-1][0] == "p":
                stack.pop()
            if tag in CLOSED_BY:
                close(*CLOSED_BY[tag])
            if tag not in VOID:
                attributes = {k.lower(): next((v for v in vs if v), "") for k, *vs in _ATTRIBUTE.findall(inside)} if inside else {}
                stack.append((tag, *naming(tag, attributes)))
    flush()
    return out


def block_features(blocks: list[tuple[int, int, int, bool, bool, bool]]) -> np.ndarray:
    """One row of FEATURES for each (words, linked words, named, inside, never, heading) of a page, in order; beyond the ends of a page there are no words and no links."""
    if not blocks:
        return np.zeros((0, len(FEATURES)))
    words, linked, named, inside, never, heading = (np.array(c, dtype=float) for c in zip(*blocks))
    density = np.minimum(linked / np.maximum(words, 1), 1)
    before, after = lambda x: np.append(0, x[:-1]), lambda x: np.append(x[1:], 0)
    found = np.full(len(words), float(((named > 0) & (never == 0)).any()))
    return np.stack([words, density, before(words), before(density), after(words), after(density), named, inside, never, heading, found], axis=1)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2):
    """A binary decision tree by Gini impurity: (feature, threshold, tree at or below, tree above), or the verdict of a leaf. Ties go to the first feature and the lowest threshold."""
    if depth == 0 or len(set(y)) == 1 or len(y) < 2 * least:
        return bool(2 * y.sum() > len(y))
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            n, m = low.sum(), (~low).sum()
            if min(n, m) >= least:
                p, q = y[low].mean(), y[~low].mean()
                impurity = n * p * (1 - p) + m * q * (1 - q)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, float(t), low)
    if best is None:
        return bool(2 * y.sum() > len(y))
    _, f, t, low = best
    return f, t, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def decide(tree, row: np.ndarray) -> bool:
    while not isinstance(tree, bool):
        f, t, low, high = tree
        tree = low if row[f] <= t else high
    return tree


def labelled_features(table: str = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled table: a line for each block (elements around it, words, linked words, label), pages parted by empty lines."""
    x, y = [], []
    for page in table.strip().split("\n\n"):
        blocks = []
        for line in page.splitlines():
            path, words, linked, label = line.split()
            elements = []
            for element in path.split(">"):
                tag, _, rest = element.partition(".")
                elements.append((tag, *naming(tag, {"class": rest.replace(".", " ")})))
            blocks.append((int(words), int(linked), *described(elements)))
            y.append(int(label))
        x.append(block_features(blocks))
    return np.concatenate(x), np.array(y)


def trained_tree(table: str = LABELLED):
    return grow(*labelled_features(table))


def main_text(page: str | None, tree) -> str:
    blocks = flat_blocks(page or "")
    rows = block_features([b[1:] for b in blocks])
    return "\n".join(b[0] for b, row in zip(blocks, rows) if decide(tree, row))


def extract_pages(pages: DataFrame, table: str = LABELLED, most_bytes: int = 8 << 20) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of `pages`: the main text, its blocks joined by line feeds, and its code points.

    Null and empty pages give an empty text, repeated rows are alike, an empty table gives no rows, other columns are not read. A task holds one page and at most
    `most_bytes` of texts at a time; nothing is shuffled. The tree has a few dozen nodes and travels with the task.
    """
    tree = trained_tree(table)

    def run(batches):
        for batch in batches:
            kept, texts, size = 0, [], 0
            for i, page in enumerate(batch.column("html")):
                texts.append(main_text(page.as_py(), tree))
                size += len(texts[-1])
                if size > most_bytes or i == batch.num_rows - 1:
                    part = batch.slice(kept, len(texts))
                    yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
                    kept, texts, size = i + 1, [], 0
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
