"""Main text of web pages by the distribution of text over line blocks.

A page becomes lines, one per block element. Markup that is never article text
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, reader
comments) leaves an empty line; a line that is mostly link text counts as
empty. The text lengths are summed over windows of `WINDOW` lines; a region
begins where a window surges over `SURGE` characters and ends where the text
dives to nothing for a whole window; between the two every line of text stays.

Where a page marks an article and a window surges inside the mark, the lines
outside count as empty and any text inside is a surge, so that only menus of
`WINDOW` links or more fall out there. A mark without a surge (a teaser, an empty
frame) decides nothing unless the whole page has no surge.
"""
from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SURGE, LINKED = 3, 86, 0.6

# Elements of the HTML standard by their part in a page.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary "
                   "table tbody td tfoot th thead tr ul title noscript template iframe".split())
NEVER = frozenset("head nav footer aside form button select option textarea dialog menu noscript template iframe svg canvas object audio video title".split())
RAW = frozenset("script style textarea title noscript iframe template svg xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
             "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
HINT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|notification\w*|popup|modal|overlay|"
                  r"nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|side|widget\w*|related|recommend\w*|share|sharing|social|subscribe|newsletter|"
                  r"comments?|commentlist|respond|disqus\w*|replies|reply|footer|foot|header|masthead|topbar|toolbar|pagination|pager|login|signup|search\w*)(?:$|[\s_-])", re.I)
ASIDE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsored|comments?|replies|reply)(?:$|\s)", re.I)  # of an <article> itself
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
READ = frozenset("class id role hidden aria-hidden href".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)(\s*+>)?")
_ATTRIBUTE = re.compile(r"[\s/]*+(>|=?[^\s/>=]*+)(\s*+=\s*+)?")
_BARE = re.compile(r"[^\s>]*+")
_SPACE = re.compile(r"\s+")


class _Reader:
    """Tags of one page, read once from left to right by the standard's rules.
    A quote that is never closed ends with its tag, at the next `>`."""

    def __init__(self, page: str):
        self.page = page
        self.open_quotes = set()  # quote characters that do not come again

    def attributes(self, at: int) -> tuple[dict[str, str], int]:
        """What is read of a tag's attributes from `at` on, and where the tag ends."""
        page, found = self.page, {}
        while at < len(page):
            m = _ATTRIBUTE.match(page, at)
            at = m.end()
            if m[1] == ">":
                return found, m.end(1)
            value = ""
            if m[2]:
                quote = page[at:at + 1]
                if quote in ("'", '"'):
                    end = -1 if quote in self.open_quotes else page.find(quote, at + 1)
                    if end < 0:
                        self.open_quotes.add(quote)
                        end = page.find(">", at)
                        return found, end + 1 if end >= 0 else len(page)
                    value, at = page[at + 1:end], end + 1
                else:
                    bare = _BARE.match(page, at)
                    value, at = bare[0], bare.end()
            name = m[1].lower()
            if name in READ:
                found.setdefault(name, value)
        return found, at

    def after(self, name: str, at: int) -> int:
        """Where the content of a raw element that begins at `at` is over."""
        m = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(self.page, at)
        end = self.page.find(">", m.end()) if m else -1
        return end + 1 if end >= 0 else len(self.page)

    def tags(self) -> Iterator[tuple[str, str, bool, dict[str, str]]]:
        """(text before, name, closing, attributes); the last one has no name."""
        page, at, start = self.page, 0, 0
        while True:
            start = page.find("<", start)
            if start < 0:
                yield page[at:], "", False, {}
                return
            m = _NAME.match(page, start)
            if m:
                name, attributes, end = m[2].lower(), {}, m.end()
                if not m[3]:
                    attributes, end = self.attributes(m.end())
                if not m[1] and name in RAW:
                    end = self.after(name, end)
                yield page[at:start], name, bool(m[1]), attributes
            elif page.startswith("<!--", start):
                end = start + 5 if page.startswith("<!-->", start) else page.find("-->", start + 4)
                end = len(page) if end < 0 else end if page.startswith("<!-->", start) else end + 3
                yield page[at:start], "!", False, {}
            elif page[start + 1:start + 2] in ("!", "?") or page.startswith("</", start) and start + 2 < len(page):
                end = page.find(">", start)
                end = end + 1 if end >= 0 else len(page)
                yield page[at:start], "!", False, {}
            else:  # a `<` of the text
                start += 1
                continue
            at = start = end


def _unwanted(name: str, attributes: dict[str, str], article: bool) -> bool:
    if name in NEVER or name in RAW or (name == "header" and not article):
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or attributes.get("role", "").strip().lower() in ROLES:
        return True
    hint = None if name in ("html", "body", "main") else ASIDE if name == "article" else HINT
    return hint is not None and any(hint.search(attributes.get(key, "")) for key in ("class", "id"))


def lines(page: str) -> list[tuple[str, bool, int]]:
    """The page's blocks in order: the text that may be article text, whether it
    stands in a marked article, and how many of its characters are link text.
    Blocks that hold nothing count as one between two others."""
    out: list[tuple[str, bool, int]] = []
    stack: list[tuple[str, bool, bool]] = []
    depth: Counter[str] = Counter()  # of each name in the stack
    parts: list[str] = []
    linked, link = 0, None  # the stack's height where a link began
    left_out, gap = False, False  # text not wanted in this block; the last line is a bare gap between blocks

    def pop() -> None:
        nonlocal link
        depth[stack.pop()[0]] -= 1
        if link is not None and len(stack) < link:
            link = None

    def flush() -> None:
        nonlocal linked, left_out, gap
        text = _SPACE.sub(" ", "".join(parts)).strip()
        bare = not text and not left_out
        if not (bare and gap):
            out.append((text, bool(stack) and stack[-1][2], linked))
        parts.clear()
        linked, left_out, gap = 0, False, bare

    for text, name, closing, attributes in _Reader(page).tags():
        unwanted, article = stack[-1][1:] if stack else (False, False)
        if unwanted:
            left_out = left_out or bool(text) and not text.isspace()
        elif text:
            text = html.unescape(text)
            parts.append(text)
            if link is not None:
                linked += len(_SPACE.sub(" ", text).strip())
        if not name or name == "!":
            continue
        if name == "br":
            parts.append("\n")
            continue
        if name == "a":
            link = len(stack) if "href" in attributes and not closing else None
        if name in BLOCKS:
            flush()
        if closing:
            while depth[name]:
                last = stack[-1][0]
                pop()
                if last == name:
                    break
            continue
        if name in VOID or name in RAW:
            continue
        if name in BLOCKS and stack and stack[-1][0] == "p":
            pop()
        while name in CLOSED_BY and stack and stack[-1][0] in CLOSED_BY[name]:
            pop()
        unwanted, article = stack[-1][1:] if stack else (False, False)
        unwanted = unwanted or _unwanted(name, attributes, article)
        if name in BLOCKS or unwanted:
            stack.append((name, unwanted, article or name in ("article", "main")))
            depth[name] += 1
    flush()
    return out


def windowed(lengths: np.ndarray) -> np.ndarray:
    """The sum of each length and the next `WINDOW - 1`."""
    return np.convolve(lengths, np.ones(WINDOW, np.int64))[WINDOW - 1:] if len(lengths) else lengths


def regions(lengths: np.ndarray, surge: int = SURGE) -> np.ndarray:
    """Which lines lie between a surge and the dive after it."""
    n, sums = len(lengths), windowed(lengths)
    keep, i = np.zeros(n, bool), 0
    dives = np.flatnonzero(sums == 0)
    for start in np.flatnonzero((lengths > 0) & (sums > surge)):
        if start >= i:
            after = np.searchsorted(dives, start)
            i = int(dives[after]) if after < len(dives) else n
            keep[start:i] = True
    return keep


def _in_menus(linked: np.ndarray) -> np.ndarray:
    """Which lines stand in a row of `WINDOW` or more lines of links."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], linked.astype(np.int8), [0]])))
    out = np.zeros(len(linked), bool)
    for a, b in edges.reshape(-1, 2):
        out[a:b] = b - a >= WINDOW
    return out


def main_text(page: str | None) -> str:
    """The article's blocks joined by newlines; empty when there is none."""
    found = lines(page or "")
    size = np.array([len(text) for text, _, _ in found], np.int64)
    marked = np.array([mark for _, mark, _ in found], bool) & (size > 0)
    linked = np.array([n for _, _, n in found], np.int64) > LINKED * size
    plain = np.where(linked, 0, size)
    # Blocks without text (between </p> and <p>) do not part two links of a menu.
    filled = np.flatnonzero(size)
    text = np.zeros(len(found), bool)
    text[filled] = ~_in_menus(linked[filled])
    if (windowed(np.where(marked, plain, 0)) > SURGE).any():
        keep = regions(np.where(marked & text, size + SURGE, 0)) & marked & text
    else:
        keep = regions(plain) & text
        if not keep.any():  # too little text for a surge: all there is
            keep = marked if marked.any() else text if text.any() else size > 0
    return "\n".join(found[i][0] for i in np.flatnonzero(keep))


def extracted(pages: DataFrame) -> DataFrame:
    """`page_id`, `url`, `text` and `n_chars` of each row of `pages`. A null or
    empty page has the empty text; repeated rows are extracted alike; other
    columns are not read.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                found = [main_text(h) for h in rows.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                                                 ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
