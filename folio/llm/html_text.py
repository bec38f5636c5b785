"""Main text of web pages by line-block distribution.

A page's markup is stripped to lines: one for each block element, its text with character references decoded and white space folded. A line's weight
is its length without link text, and nothing where more than half of it is link text; page furniture (by element, role, class or id) is never kept. The
weights are summed over sliding windows of `width` lines. Text surges where a window exceeds the threshold (a share of the page's largest window) and
dives where the windows fall to nothing; the lines between, links and short ones too, are the main text, and removed furniture does not part them. So a list of links that is longer than a window and lies outside
the surges is left out. If an article or main element has text, all of its lines are the main text, and they alone; if its text is links only, where it is
longer than the link-free text of the rest of the page.

Nulls: a null html is an empty page with empty text; null page_id and url stay null. A page of any length is one pass over its tags. Repeated rows give
repeated results, an empty table no rows. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?>[^>"']+|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)""", re.S)  # what is not closed ends with the page
ATTRIBUTE = re.compile(r"""([^\s/>="'][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?|"[^"]*"|'[^']*'""")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
FURNITURE = {"head", "nav", "footer", "aside", "form", "noscript", "template", "svg", "object", "video", "audio", "canvas", "button", "select", "dialog", "menu", "map", "fieldset", "applet"} | RAW
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "nobr", "label", "input", "picture", "source", "math", "semantics", "mrow", "mi", "mn", "mo", "mtext", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mfenced"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "note"}
NAMES = re.compile(
    r"^(?:ads?|advert\w*|adsense|adbox|adslot|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|submenu|topbar|breadcrumbs?|crumbs?|sidebar|rail|aside|footer|foot|colophon|masthead|"
    r"comments?|commentlist|disqus\w*|respond|replies|reply|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|"
    r"recommendations|widget|pagination|pager|toolbar|copyright|legal|disclaimer|skip|search|tags|hidden|paywall|teaser|outbrain|taboola|header|(?:is|visually)[-_]+hidden|user[-_]*reviews?|reviews?[-_]+(?:list|section|form))$"
)
#: A class or id word is a name as a whole, or where all of its parts are names or these, with a name among them.
PLACES = set("site page main top bottom left right global primary secondary post entry mobile desktop container wrapper wrap box bar area block list links link buttons button icons section inner unit slot form item items posts articles stories".split())
CARDS = re.compile(r"^(?:comments?|commentlist|respond|replies|reply|related|recommended|recommendations|teaser|promo\w*|outbrain|taboola)$")  # may hold articles that are not the page's
ADVERTS = re.compile(r"^(?:ads?|advert\w*|sponsor\w*|promo\w*)$")  # an article by one of these names is not the page's
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PLACED = {"div", "ul", "ol", "dl", "table", "td", "header"}  # an id on another element, or on a section, is a place to link to
SINGLE = {"header"}  # furniture unless it lies in an article
#: An end tag is left out where one of these follows: the open element, if it is one of the named, ends there.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _named(word: str, in_article: bool) -> bool:
    """Whether a class or id word says furniture."""
    parts = re.split(r"[-_]+", word)
    if parts[-1] in ("header", "tags") and (in_article or len(parts) > 1 and parts[0] in ("post", "entry", "article", "section", "page")):
        return False
    if NAMES.match(word):
        return True
    names = [bool(NAMES.match(p)) and p != "hidden" for p in parts]
    return any(names) and all(n or p in PLACES for n, p in zip(names, parts, strict=True))


def _attributes(text: str) -> dict[str, str]:
    """Values by whole name, in lower case; the first of a name counts."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text) if text else ():
        if name:
            quoted = value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1
            out.setdefault(name.lower(), html.unescape(value[1:-1] if quoted else value).strip().lower())
    return out


def _furniture(tag: str, attributes: dict[str, str], in_article: bool) -> tuple[bool, list[str]]:
    """Whether an element is furniture whatever it holds, and the class and id words by which it is unless it holds the article."""
    if tag in FURNITURE or (tag in SINGLE and not in_article):
        return True, []
    words = {"class": [], "id": []}
    for name, value in attributes.items():
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, []
        if name == "role" and value in ROLES:
            return True, []
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, []
        if name == "class" and tag == "article" and any(ADVERTS.match(w) for w in value.split()):
            return True, []
        if name in words and tag not in ("html", "body", "article", "main") and tag not in HEADINGS:
            words[name] += value.split()
    if tag not in PLACED or "section" in words["class"]:
        words["id"] = []
    return False, [w for w in words["class"] + words["id"] if _named(w, in_article)]


def lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, weight, in an article) of each block in page order."""
    out: list[tuple[str, int, bool, int]] = []
    stack: list[str] = []
    open_tags: dict[str, int] = {}
    bad = links = articles = 0  # open furniture, links and articles
    named = [(-1, False)]  # each element that is furniture by name: the one around it, and whether it is for cards
    held: list[bool] = [True]  # whether it holds the main element
    within = 0  # the innermost open one
    holders: list[int] = []  # within of each article
    marks: list[tuple[bool, bool, bool, int]] = []
    text: list[tuple[str, bool]] = []

    def flush() -> None:
        if text:
            whole = " ".join(html.unescape("".join(t for t, _ in text)).split())
            if whole:
                free = "".join(html.unescape("".join(t for t, link in text if not link)).split())
                out.append((whole, len(free), articles > 0, within))
            text.clear()

    def pop() -> None:
        nonlocal bad, links, articles, within
        open_tags[stack.pop()] -= 1
        b, a, m, within = marks.pop()
        bad, links, articles = bad - b, links - a, articles - m

    def hold(at: int) -> None:
        while not held[at]:
            held[at] = True
            at = named[at][0]

    at = 0
    while True:
        m = TAG.search(page, at)
        between = page[at : m.start() if m else len(page)]
        if between and not bad:
            text.append((between, links > 0))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        block = tag not in INLINE
        if block:
            flush()
        if m[1]:
            if open_tags.get(tag):
                if tag in INLINE:
                    depth = len(stack) - 1
                    while stack[depth] != tag and stack[depth] in INLINE:
                        depth -= 1
                    if stack[depth] != tag:
                        continue  # an inline end tag does not end blocks
                while True:
                    if marks[-1][3] != within:
                        flush()
                    last = stack[-1]
                    pop()
                    if last == tag:
                        break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if block and "p" in stack[-1:]:
            pop()
        while stack and stack[-1] in CLOSES.get(tag, ()):
            pop()
        if block and not stack[-1:] == ["a"]:
            while stack and stack[-1] in INLINE:  # formatting left open ends with its block
                pop()
            if "p" in stack[-1:]:
                pop()
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        attributes = _attributes(m[3])
        is_bad, names = _furniture(tag, attributes, articles > 0)
        is_article = tag in ("article", "main") or attributes.get("role") == "main"
        if is_article or is_bad or names:
            flush()
        stack.append(tag)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        marks.append((is_bad, tag == "a", is_article, within))
        if names and not is_bad and not bad:
            named.append((within, any(CARDS.match(p) for w in names for p in re.split(r"[-_]+", w))))
            held.append(False)
            within = len(named) - 1
        if is_article and not is_bad and not bad:
            if tag == "article":
                holders.append(within)
            else:
                hold(within)
        bad, links, articles = bad + is_bad, links + (tag == "a"), articles + is_article
    flush()

    def open_ones() -> list[bool]:
        """Of each named element, whether it and all around it hold the article."""
        open_ = [True]
        for k in range(1, len(named)):
            open_.append(held[k] and open_[named[k][0]])
        return open_

    shown = open_ones()
    if not any(a and shown[k] for _, _, a, k in out):  # no article but in furniture by name: there it is, if it is no card and not less than the rest
        rest = sum(w for _, w, _, k in out if shown[k])
        cards = [False]
        for k in range(1, len(named)):
            cards.append(named[k][1] or cards[named[k][0]])
        before = held.copy()
        for k in holders:
            if not cards[k]:
                hold(k)
        more = open_ones()
        if sum(len(t) for t, _, a, k in out if a and more[k]) >= rest:
            shown = more
        else:
            held = before
    return [(t, w, a) for t, w, a, k in out if shown[k]]


def main_text(page: str, width: int = 3, share: float = 0.1, least: int = 80) -> str:
    rows = lines(page)
    inside = [t for t, _, a in rows if a]
    if any(w for _, w, a in rows if a) or sum(map(len, inside)) > sum(w for _, w, a in rows if not a):
        return "\n\n".join(inside)
    weights = [w if 2 * w >= len(t.replace(" ", "")) else 0 for t, w, _ in rows]  # lines that are mostly links weigh nothing
    sums = [sum(weights[max(0, i - width // 2) : i + width // 2 + 1]) for i in range(len(weights))]
    floor = min(least, share * max(sums, default=0))
    kept, i = [], 0
    while i < len(rows):
        if sums[i] <= 0:
            i += 1
            continue
        end = i
        while end < len(rows) and sums[end] > 0:
            end += 1
        if max(sums[i:end]) >= floor:  # a surge, up to its dive
            kept += [t for t, _, _ in rows[i:end]]
        i = end
    return "\n\n".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) if x else "" for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of pages."""
    common.ship(pages.sparkSession)
    return pages.selectExpr("page_id", "cast(url AS string) AS url", "cast(html AS string) AS html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op2_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
