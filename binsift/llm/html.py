"""Main text of HTML pages by two passes of block rules.

Pass one classifies each text block by stop-word density, length and link density as good, bad or undecided; page
furniture (menus, headers and footers of the page, sidebars, forms, adverts, notices, comments), told by element or by
class and id names, is bad outright. A compound name counts if all its parts speak of furniture or of layout
(`share-buttons`, not `share-price`). Other names with such a part, and names that articles use too (`legal`, `related`,
`search`, ...), only count outside of article elements, and not at all on a page that would have no text otherwise.

An article element with text decides for its page, whatever stands beside it and however long; without one, a main
element does. Only articles named as teasers, or several that are all short and led by a link, give way to more good text
outside of them. Inside an article every block that isn't furniture is text, but for lists of links; link density
tells menus from text outside. Where most text of a page has the stop words of no known language, length and link density
alone tell good from bad. Pass two gives undecided blocks, which are short, the label of the nearest decided neighbour
inside the same article element (ties go to good); undecided blocks without one are bad, unless nothing on the page is
good: then they are its text.

The page is read once from left to right: every search for an end (of a quote, a comment, an element) is remembered until
it is passed, so time grows with the length of a page whatever stands in it.

Defined results: null, empty and text-less pages give the empty text. Unclosed elements end with their parent; what has
no end tag although it needs one (script, style, svg, ...) hides no more than the text up to the next tag, an unclosed
comment ends at the next `>`, an unclosed quote at the end of its tag, an unfinished last tag is no text. Character
references are decoded once. Repeated rows give repeated results. Extra columns of the input are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_map

SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks int, n_kept int"
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is page furniture wherever they stand.
FURNITURE = frozenset("nav aside footer button dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is no markup, and elements whose content isn't shown as text.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
UNSEEN = frozenset("svg annotation object canvas select template noscript audio video datalist".split())
#: Of those, the ones that the start of a block ends.
FOREIGN = frozenset("svg select canvas".split())
#: Elements that their next sibling ends.
SIBLINGS = frozenset("p li option td th tr dt dd".split())
#: Tokens of class, id and role that name page furniture.
CUES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo banner cookie cookies consent gdpr popup modal newsletter subscribe subscription"
    " nav navbar navigation breadcrumb breadcrumbs pagination pager sidebar share sharing comment comments reply replies responses commentlist disqus footer masthead topbar toolbar".split()
)
#: Those that name comments of readers: an article element inside is one of them.
COMMENTS = frozenset("comment comments reply replies responses commentlist disqus".split())
#: Parts of compound names that speak of layout.
LAYOUT = frozenset(
    "list area section sections wrapper wrap container content box block bar button buttons link links icon icons tool tools slot unit inner outer left right top bottom upper lower center middle main primary secondary"
    " site page post entry item items row col column columns grid panel group holder body text title count policy dialog message sticky fixed floating mobile desktop small large big wide narrow full inline js is has no up in the and of"
    " global local first last header head menu form overlay image img frame zone place placeholder label thread feed stream sm md lg xl".split()
)
#: Tokens that name it only outside of articles, and tokens of articles that stand for others.
DOUBTFUL = frozenset("notice notices alert overlay signup login menu aside widget widgets related recommended recommendations promotion social discussion copyright legal search form header response thread".split())
TEASER = frozenset("teaser teasers card preview excerpt".split())
PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:;|!|$)", re.I)
WORD = re.compile(r"[^\W\d_]+")
#: The most frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    (
        "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will more no if out so what up said its about into than them can only other"
        " der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch"
        " le la les de des et un une du en est que qui dans pour au par sur pas plus ne se ce il elle avec sont aux son cette ou mais nous vous leur être comme tout fait"
        " el los las y del que en por con para una su al lo como más pero sus este ya entre porque cuando muy sin sobre también hasta hay donde quien desde todo nos durante"
    ).split()
)

_PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)\s*(=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_AFTER_QUOTE = frozenset(" \t\n\r\f/>")
_BREAK = re.compile(r"<(?:p|div|article|main|section|h[1-6]|ul|ol|table|body)(?=[\s/>])", re.I)


@dataclass
class Rules:
    """Thresholds of pass one: characters, share of stop words, share of characters inside links."""

    short: int = 70
    long: int = 200
    stop_low: float = 0.15
    stop_high: float = 0.25
    links: float = 0.3
    list_links: float = 0.8


@dataclass
class Block:
    text: str
    linked: int
    furniture: bool
    doubtful: bool
    article: int
    main: bool = False
    listed: int = 0
    label: str = ""


class Scanner:
    """Tags and texts of a page, in one pass over it."""

    def __init__(self, page: str):
        self.page = page
        self.next: dict[str, int] = {}
        self.ends: dict[str, int] = {}
        self.pairs: dict[str, dict[int, int]] = {}

    def find(self, what: str, at: int) -> int:
        """Place of the next `what`, -1 if there is none; each stretch of the page is searched once."""
        known = self.next.get(what, 0)
        if known == -1 or known > at:
            return known
        self.next[what] = found = self.page.find(what, at)
        return found

    def end_tag(self, name: str, at: int) -> int:
        """Place after the next end tag of a raw element, -1 if there is none."""
        known = self.ends.get(name, 0)
        if known == -1 or known > at:
            return known
        m = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(self.page, at)
        self.ends[name] = m.end() if m else -1
        return self.ends[name]

    def partner(self, name: str, at: int) -> int:
        """Place after the end tag that belongs to the start tag at a place, -1 if none does."""
        if name not in self.pairs:
            pairs: dict[int, int] = {}
            opened: list[int] = []
            for m in re.compile(rf"<(/?){name}(?=[\s/>])", re.I).finditer(self.page):
                if not m[1]:
                    opened.append(m.start())
                elif opened:
                    pairs[opened.pop()] = m.start()
            self.pairs[name] = pairs
        return self.pairs[name].get(at, -1)

    def attributes(self, at: int) -> tuple[dict[str, str], int, bool]:
        """Attributes from a place inside a tag on, the place after its end, whether it closes itself."""
        page, n, out = self.page, len(self.page), {}
        while True:
            gap = _GAP.match(page, at)
            at = gap.end()
            if at >= n or page[at] == ">":
                return out, min(at + 1, n), gap[0].endswith("/")
            m = _ATTRIBUTE.match(page, at)
            at, value = m.end(), ""
            if m[2]:
                quote = page[at : at + 1]
                end = self.find(quote, at + 1) if quote in ('"', "'") else -1
                # What follows the end of a value tells a quote from an apostrophe of a text further on.
                if end >= 0 and (page[end + 1 : end + 2] in _AFTER_QUOTE or end + 1 == n or page.find(">", at, end) < 0):
                    value, at = page[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(page, at)
                    value, at = bare[0].strip("\"'"), bare.end()
            out.setdefault(m[1].lower(), value)

    def tokens(self) -> Iterator[tuple[str, str, bool, dict[str, str]]]:
        """(text, name, closing, attributes): a text without name, or a tag."""
        page, at, n = self.page, 0, len(self.page)
        none: dict[str, str] = {}
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                yield page[at:], "", False, none
                return
            if lt > at:
                yield page[at:lt], "", False, none
            if m := _PLAIN.match(page, lt):
                name, closing, attrs, at, selfish = m[2].lower(), bool(m[1]), none, m.end(), False
            elif page.startswith("<!--", lt):
                at = lt + 4 if page.startswith(("<!-->", "<!--->"), lt) else self.find("-->", lt + 4)
                at = self.find(">", lt if at < 0 else at) + 1 or n
                continue
            elif page.startswith(("<!", "<?"), lt):
                at = self.find(">", lt) + 1 or n
                continue
            elif page.startswith("</", lt):
                m = _NAME.match(page, lt + 2)
                at = self.find(">", lt) + 1 or n
                if not m:
                    continue
                name, closing, attrs, selfish = m[0].lower(), True, none, False
            elif m := _NAME.match(page, lt + 1):
                name, closing = m[0].lower(), False
                attrs, at, selfish = self.attributes(m.end())
            else:
                yield "<", "", False, none
                at = lt + 1
                continue
            if not closing and (name in RAW or name in UNSEEN and not selfish):
                at = self._beyond(name, lt, at)
                continue
            yield "", name, closing, attrs

    def _beyond(self, name: str, lt: int, at: int) -> int:
        """Place after an element whose content isn't text: its end tag, or the next tag if it has none."""
        if name in RAW:
            end = self.end_tag(name, at)
        else:
            end = self.partner(name, lt)
            if end >= 0 and name in FOREIGN and (m := _BREAK.search(self.page, at, end)):
                return m.start()
        if end >= 0:
            return end
        end = self.page.find("<", at) if name in RAW else at
        return len(self.page) if end < 0 else end


@dataclass
class Names:
    """What the class, id and role names of an element say."""

    cued: bool = False
    doubtful: bool = False
    teaser: bool = False
    comment: bool = False


NO_NAMES = Names()


def _names_of(attrs: dict[str, str]) -> Names:
    given = [value for key in ("class", "id", "role") if (value := attrs.get(key))]
    if not given:
        return NO_NAMES
    out = Names()
    for name in " ".join(given).split():
        parts = {p.lower() for p in PARTS.split(name) if p}
        if parts & CUES:
            rest = parts - CUES - DOUBTFUL - LAYOUT
            sure = not any(len(p) > 1 and not p.isdigit() for p in rest)
            out.cued |= sure
            out.doubtful |= not sure
            out.comment |= sure and bool(parts & COMMENTS)
        out.doubtful |= bool(parts & DOUBTFUL)
        out.teaser |= bool(parts & TEASER)
    return out


def _hidden(attrs: dict[str, str]) -> bool:
    """Whether attributes hide their element: hidden, aria-hidden=true, display:none or visibility:hidden in its style."""
    return "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true" or bool(HIDING.search(attrs.get("style", "")))


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, with the number of linked characters, whether furniture, and the article they stand in."""
    out: list[Block] = []
    # open elements: name, and below it furniture, doubtful, article number, main, comments, number of the list
    stack: list[tuple[str, bool, bool, int, bool, bool, int]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = links = articles = breaks = lists = 0
    furniture, doubtful, article, main, comment, listed = nothing = False, False, 0, False, False, 0

    def flush() -> None:
        nonlocal linked, breaks
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, min(linked, len(text)), furniture, doubtful, article, main, listed))
            parts.clear()
        linked = breaks = 0

    def pop() -> str:
        nonlocal furniture, doubtful, article, main, comment, listed
        name = stack.pop()[0]
        opened[name] -= 1
        furniture, doubtful, article, main, comment, listed = stack[-1][1:] if stack else nothing
        return name

    for text, name, closing, attrs in Scanner(page).tokens():
        if not name:
            parts.append(text)
            if links:
                linked += len(text.strip())
            if breaks and not text.isspace():
                breaks = 0
            continue
        if name == "a":
            links = 0 if closing else 1
            continue
        if name == "br":
            breaks += 1
            parts.append(" ")
            if breaks == 2:
                flush()
            continue
        names = _names_of(attrs) if attrs else NO_NAMES
        if name not in BLOCK and not (name == "span" and (names.cued or closing and stack and stack[-1][0] == "span")):
            continue
        flush()
        links = 0
        if name in VOID:
            continue
        if closing:
            if opened[name]:
                while pop() != name:
                    pass
            continue
        if stack and (stack[-1][0] == "p" and name != "span" or stack[-1][0] == name in SIBLINGS):
            pop()  # a block ends an open paragraph, a list item the one before it
        cued = names.cued and name not in ("html", "body", "main")
        comment |= cued and names.comment
        if comment:
            furniture = True
        elif name == "article" and not article or name == "main" and not main and not article:
            if not articles and not main:  # what wraps the page's article isn't furniture for its class
                furniture = any(opened[x] for x in FURNITURE)
            if name == "main":
                main = True
            else:
                articles += 1
                article = articles
            doubtful = name == "article" and (cued or names.teaser)
        elif name in FURNITURE or cued or name == ("form" if article or main else "header"):
            furniture = True
        elif not (article or main) and (name == "form" or names.doubtful and name not in ("html", "body")):
            doubtful = True
        if name in ("ul", "ol"):
            lists += 1
            listed = lists
        if attrs and name not in ("html", "body") and _hidden(attrs):
            furniture = True
        stack.append((name, furniture, doubtful, article, main, comment, listed))
        opened[name] += 1
    flush()
    if not any(b.article and not b.furniture for b in out):
        for b in out:
            b.article = int(b.main)
    return out


def _density(text: str) -> float:
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def _first_pass(found: list[Block], rules: Rules, doubts: bool) -> None:
    """Labels by furniture, article elements, length, link density and stop-word density."""
    chars, in_links = Counter(), Counter()
    for b in found:
        chars[b.listed] += len(b.text)
        in_links[b.listed] += b.linked

    def menu(b: Block) -> bool:
        """Whether links tell that a block is none of the text."""
        if b.article:
            return b.listed > 0 and in_links[b.listed] > rules.list_links * chars[b.listed]
        return b.linked > rules.links * len(b.text)

    text_of = [not (b.furniture or doubts and b.doubtful or menu(b)) for b in found]
    articles: dict[int, list[Block]] = {}
    for b, ok in zip(found, text_of):
        if ok and b.article:
            articles.setdefault(b.article, []).append(b)
    inside = sum(len(b.text) for own in articles.values() for b in own)
    teasers = len(articles) > 1 and all(all(len(b.text) < rules.long for b in own) and any(b.linked >= rules.list_links * len(b.text) for b in own) for own in articles.values())
    # Stop words, of the blocks that need them: those outside of articles.
    dense = {i: _density(b.text) for i, (b, ok) in enumerate(zip(found, text_of)) if ok and not b.article and len(b.text) >= rules.short}
    known = sum(len(found[i].text) for i, d in dense.items() if d >= rules.stop_low)
    told = known >= sum(len(found[i].text) for i in dense) - known
    for i, b in enumerate(found):
        n = len(b.text)
        if not text_of[i]:
            b.label = "bad"
        elif n < rules.short:
            b.label = "undecided"
        elif b.article or not told or dense[i] >= rules.stop_high:
            b.label = "good"
        elif dense[i] >= rules.stop_low:
            b.label = "good" if n >= rules.long else "undecided"
        else:
            b.label = "bad"
    outside = sum(len(b.text) for b in found if b.label == "good" and not b.article)
    for b in found:
        if inside and bool(b.article) == (teasers and inside < outside):
            b.label = "bad"


def classify(found: list[Block], rules: Rules) -> list[Block]:
    """Set every block's label to good or bad by the two passes."""
    _first_pass(found, rules, True)
    if any(b.doubtful for b in found) and not any(b.label == "good" or b.label == "undecided" and b.article for b in found):
        _first_pass(found, rules, False)
    # Nearest decided neighbour of the same article on either side; inside articles only text decides.
    near: list[list[tuple[int, str]]] = [[] for _ in found]
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        last: dict[int, tuple[int, str]] = {}
        for i in order:
            b = found[i]
            if b.label != "undecided":
                if not (b.article and b.label == "bad"):
                    last[b.article] = (i, b.label)
            elif b.article in last:
                near[i].append((abs(i - last[b.article][0]), last[b.article][1]))
    for b, options in zip(found, near):
        if b.label == "undecided":
            close = min((d for d, _ in options), default=None)
            b.label = "good" if any(d == close and x == "good" for d, x in options) or (b.article and not options) else "short"
    rest = "bad" if any(b.label == "good" for b in found) else "good"
    for b in found:
        if b.label == "short":
            b.label = rest
    return found


def main_text(page: str, rules: Rules | None = None) -> tuple[str, int, int]:
    """Text of the good blocks joined by line ends, the number of blocks, the number kept."""
    found = classify(blocks(page), rules or Rules())
    kept = [b.text for b in found if b.label == "good"]
    return "\n".join(kept), len(found), len(kept)


def extract(pages: DataFrame, rules: Rules | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept for every page."""
    rules = rules or Rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_text(h or "", rules) for h in b.column("html").to_pylist()]
            columns = [pa.array([g[0] for g in got], pa.string()), pa.array([len(g[0]) for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *columns], ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    return arrow_map(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run, SCHEMA)
