"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one per block element, in page order. Menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments (by element, role or class name) leave a run
of empty lines; they end with their own end tag, that of an enclosing element, or where HTML lets it be left out
(paragraphs, list items, table cells and rows, terms, options). Over windows of ``WINDOW`` lines the text lengths are summed, link text not counted. A surge
is the first window that reaches the threshold, a dive the first empty one after it; the lines between are
kept, for every surge of the page. Where a page marks its article or main part, the one with more text weighs in:
its lines count ``MARKED`` times, or as often as its longest window needs to surge, and empty lines part it from
what lies outside. Surges and dives still choose inside: ``WINDOW`` or more lines in a row that are nothing but
links are empty there (shorter runs and headlines count with their links), and what follows such a list stays only
if it surges. Lines outside count a ``MARKED``-th if the marked part surges by its plain lengths, so that a
teaser beside an article falls out. An article inside an element dropped for its class, id or role counts only if
the page has no other text.

Defined results: a null html gives an empty text; so does a page without text. A null id or url is kept as
null; repeated rows give repeated results. Whole pages are read; only the named columns are used. White
space inside a block becomes one space, blocks are joined by one line feed, character references decoded.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines summed in a window, and the text length (code points) of a surge where no article is marked.
WINDOW, SURGE = 3, 80
#: Weight of a line in the marked article or main part.
MARKED = 4

# Element names.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody tfoot thead tr ul".split()
)
SPACED = {"br", "td", "th", "wbr", "img", "input"}
DROPPED = set(
    "script style noscript template title textarea select button iframe object svg canvas video audio map dialog "
    "nav footer aside form header menu".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end is not to be waited for if an article begins inside: pages are often wrapped in them.
WRAPPERS = {"form", "header", "nav", "menu", "div", "section"}
# Words of class names, ids and roles that mark what is not the article.
MARKS = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside complementary contentinfo cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment "
    "comments respond disqus replies share sharing social related recommended pagination pager toolbar widget search "
    "copyright legal disclaimer".split()
)
#: Words that are marks only where a name begins or ends with them: builders of pages put them amid names of any part.
EDGE_MARKS = {"ad", "ads", "alert", "aside", "header", "search", "social", "widget"}
#: Parts that have a header of their own; headings and paragraphs named so are no site header either.
HEADED = {"article", "entry", "page", "post", "story"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that are the article's own inside it, whatever their class.
OWN = {"h1", "blockquote", "header"}
#: Elements that a start tag ends though their end tag is left out, and the elements beyond which it does not reach.
_ROWS = {"td", "th", "tr"}
_TABLE = {"table", "template"}
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"} | _TABLE),
    **dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl"} | _TABLE)),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "button": ({"button"}, _TABLE),
    **dict.fromkeys(("td", "th"), ({"td", "th", "caption"}, _TABLE)),
    "tr": (_ROWS | {"caption"}, _TABLE),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (_ROWS | {"tbody", "thead", "tfoot", "caption"}, _TABLE)),
    **dict.fromkeys(HEADINGS, (HEADINGS, BLOCKS - HEADINGS)),
}
#: Starts that do not end an open paragraph, and what hides a paragraph from the others.
IN_P = {"html", "head", "body", "legend", "caption", "tbody", "thead", "tfoot", "tr"}
P_SCOPE = {"table", "caption", "td", "th", "button", "object", "template"}
CELLS = {"table", "caption", "td", "th", "template"}
#: Words behind which a name tells a state or topic of something else.
STATE_WORDS = {"has", "with", "no", "without", "is", "js", "category", "tag"}
COMMENT_WORDS = {"comment", "comments", "respond", "disqus", "replies"}
_WORDS = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _marked(attrs: dict[str, str | None], among: set[str], edges: set[str] = EDGE_MARKS) -> bool:
    """Whether a class, id or role has one of the words, but behind a state word as in has-sidebar.

    The words in ``edges`` count as the first or last word only, a header not as that of a ``HEADED`` part.
    """
    for key in ("class", "id", "role"):
        for name in (attrs.get(key) or "").lower().split():
            words = _WORDS.findall(name)
            told = next((n for n, word in enumerate(words) if word in STATE_WORDS), len(words))
            for place, word in enumerate(words[:told]):
                if word not in among or word in edges and place not in (0, len(words) - 1):
                    continue
                if word != "header" or not HEADED & set(words):
                    return True
    return False


class _Lines(HTMLParser):
    """Cuts a page into lines (text, length of text outside links, zone, whether a headline).

    Zone 2 is an article, 1 the main part, 0 other.

    With ``recover`` an article ends the drop of a marked element around it; ``passed`` tells that there is one.
    """

    def __init__(self, recover: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool]] = []
        self.words: list[str] = []
        self.linked = self.article = self.main = self.links = 0
        self.recover, self.passed, self.by_mark, self.headline = recover, False, False, False
        self.stack: list[str] = []
        self.open: Counter[str] = Counter()
        # the dropped element and its place in the stack of open elements
        self.dropped, self.depth = "", 0

    def _close(self, place: int) -> None:
        """Leave the open elements from this place on."""
        if self.dropped and place <= self.depth:
            if self.dropped not in BLOCKS:
                self.words.append(" ")
            self.dropped = ""
        self.open.subtract(self.stack[place:])
        del self.stack[place:]

    def _imply(self, tag: str) -> None:
        """Leave the elements that this start tag ends."""
        pairs = [IMPLIED[tag]] if tag in IMPLIED else []
        if tag in BLOCKS - IN_P:
            pairs += [({"p"}, P_SCOPE), ({"select"}, _TABLE)]
        for ended, scope in pairs:
            if not any(self.open[t] for t in ended):
                continue
            found = None
            for place in range(len(self.stack) - 1, -1, -1):
                if self.stack[place] in ended:
                    found = place
                elif self.stack[place] in scope:
                    break
                if found is not None and tag not in ("tr", "tbody", "thead", "tfoot", "optgroup"):
                    break
            if found is not None:
                self._close(found)

    def end_line(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            zone = 2 if self.article else 1 if self.main else 0
            self.lines.append((text, max(0, len(text) - self.linked), zone, self.headline))
        self.words, self.linked, self.headline = [], 0, False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = dict(attrs)
        opens = tag in ("article", "main") and not _marked(named, COMMENT_WORDS)
        self._imply(tag)
        if tag not in VOID:
            self.stack.append(tag)
            self.open[tag] += 1
        if self.dropped:
            wrapped = opens and self.dropped in WRAPPERS
            self.passed |= wrapped
            if tag == "main" or wrapped and (self.recover or not self.by_mark):
                self.dropped = ""
            else:
                return
        if tag in BLOCKS:
            self.end_line()
        elif tag in SPACED:
            self.words.append(" ")
        if opens:
            self.article += tag == "article"
            self.main += tag == "main"
        elif tag not in VOID and self._goes(tag, named):
            self.dropped, self.depth = tag, len(self.stack) - 1
            self.by_mark = _marked(named, MARKS)
            if not (self.article or self.main):
                self.lines += [("", 0, 0, False)] * WINDOW
            return
        self.links += tag == "a"
        self.headline |= tag in HEADINGS

    def _goes(self, tag: str, named: dict[str, str | None]) -> bool:
        if tag in ("body", "html"):
            return False
        if tag in DROPPED and not (tag == "header" and self.article):
            return True
        if "hidden" in named or _HIDDEN.search(named.get("style") or ""):
            return True
        if self.article and tag in OWN:
            return False
        return _marked(named, MARKS - {"header"} if tag in HEADINGS | {"p"} else MARKS)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML ignores the slash

    def handle_endtag(self, tag: str) -> None:
        hidden = self.dropped
        scope = set() if tag in ("html", "body") else {"table"} if tag in CELLS | _ROWS | {"tbody", "thead", "tfoot"} else CELLS
        if tag not in BLOCKS | DROPPED | _ROWS:
            scope = scope | BLOCKS  # the end of an inline element does not end a block
        for place in range(len(self.stack) - 1, -1, -1) if self.open[tag] else ():
            if self.stack[place] == tag:
                self._close(place)
                break
            if self.stack[place] in scope:
                break
        if hidden and (self.dropped or tag == hidden):
            return
        if tag in BLOCKS:
            self.end_line()
        elif tag in SPACED:
            self.words.append(" ")
        if tag == "article":
            self.article = max(0, self.article - 1)
        elif tag == "main":
            self.main = max(0, self.main - 1)
        elif tag == "a":
            self.links = max(0, self.links - 1)

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.words.append(data)
            if self.links:
                self.linked += len(data.strip())


def between_surges_and_dives(lengths: list[int], threshold: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Line ranges [start, end) from each surge of the window sums to the dive after it."""
    n = len(lengths)
    sums, total = [0] * n, 0
    for i in range(n - 1, -1, -1):
        total += lengths[i] - (lengths[i + window] if i + window < n else 0)
        sums[i] = total
    kept, i = [], 0
    while i < n:
        if sums[i] < threshold or not lengths[i]:
            i += 1
            continue
        end = i
        while end < n and sums[end]:
            end += 1
        last = max(j for j in range(i, end) if lengths[j])
        while i and lengths[i - 1] and (not kept or i > kept[-1][1]):
            i -= 1  # a short headline before the surge
        kept.append((i, last + 1))
        i = max(end, last + 1)
    return kept


def _inner_lengths(lines: list[tuple[str, int, bool]]) -> list[int]:
    """Lengths of lines in the marked part: nothing in lists of links, whole texts in headlines and single links."""
    lengths = [len(text) if headline else n for text, n, headline in lines]
    if not any(lengths):
        return [len(text) for text, _, _ in lines]
    at = 0
    for filled, run in groupby(list(lengths), bool):
        size = sum(1 for _ in run)
        if not filled and size < WINDOW:
            lengths[at : at + size] = [len(text) for text, _, _ in lines[at : at + size]]
        at += size
    return lengths


def _peak(lengths: list[int]) -> int:
    return max((sum(lengths[i : i + WINDOW]) for i in range(len(lengths))), default=0)


def _chosen(parser: _Lines) -> str:
    texts = {z: sum(len(text) for text, _, zone, _ in parser.lines if zone == z) for z in (2, 1)}
    marked = max(texts, key=lambda z: texts[z])
    # (whether marked, texts, lengths) of each stretch of lines inside or outside the marked part
    parts = []
    for inside, run in groupby(parser.lines, lambda line: line[2] == marked):
        lines = [(text, n, headline) for text, n, _, headline in run]
        parts.append((inside, [t for t, _, _ in lines], _inner_lengths(lines) if inside else [n for _, n, _ in lines]))
    own = max((_peak(lengths) for inside, _, lengths in parts if inside), default=0)
    weight = max(MARKED, -(-SURGE // own)) if own else 1
    lines = []
    for inside, kept_texts, lengths in parts:
        if lines:
            lines += [("", 0)] * WINDOW
        weighed = [n * weight if inside else -(-n // MARKED) if own >= SURGE else n for n in lengths]
        lines += zip(kept_texts, weighed, strict=True)
    lengths = [n for _, n in lines]
    threshold = min(SURGE, _peak(lengths))
    if not threshold:
        return ""
    kept = between_surges_and_dives(lengths, threshold)
    return "\n".join(t for a, b in kept for t, _ in lines[a:b] if t)


def main_text(html: str | None) -> str:
    for recover in (False, True):
        parser = _Lines(recover)
        parser.feed(html or "")
        parser.close()
        parser.end_line()
        text = _chosen(parser)
        if text or not parser.passed:
            break
    return text


SCHEMA = "page_id bigint, url string, text string, n_chars bigint"


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page. No shuffle; a task holds one Arrow batch."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    )
    return rows.mapInArrow(extract, SCHEMA)
