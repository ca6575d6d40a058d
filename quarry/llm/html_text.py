"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags. In the first pass each block is classed by its length, the share of its characters inside
links and the share of stop words: good, bad, or undecided (short, or near good). Blocks inside menus, headers, footers, forms and the like
are bad. In the second pass an undecided block takes the label of the nearest decided neighbours within its region of the page: good if
both agree or one is good and the block itself is near good. A region is an article (or main) element, or the rest of the page; an article in
which nothing is decided is good, since its markup says so.

A page is read once from start to end, in time linear in its length whatever its markup: a `<` after the page's last `>` is text, quoted
attributes that never end are read as unquoted from there on, and end tags look only for elements that are open.

Defined results. Null or empty html, or a page of boilerplate alone: an empty string. Markup that isn't closed ends with the page. Very long
pages: read whole, in one task's memory. Character references of numbers that no character has: U+FFFD. Null page_id or url, repeated rows or
ids: each row has its result. Empty table: no rows. Other columns of the input play no part.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import map_arrow, pick

#: Lengths in characters and densities of the block rules.
SHORT, LONG = 70, 200
LINKS_AT_MOST = 0.33
STOPS_LOW, STOPS_HIGH = 0.12, 0.25
#: Frequent function words of the languages served.
STOP_WORDS = frozenset(
    """the of and to in a is that for on with as at by be this are was it from or an not have has had were but which you they his her its their we can all will
    le la les de des du un une et est que qui dans en pour pas sur par avec ce il elle au aux ne se plus
    der die das und ist von den mit zu auf für im nicht ein eine einer des dem sich als auch an es
    el los las del y en que una por con para se no su al lo como más
    di che il per non una con sono della
    o os as do da em um uma não com se mais""".split()
)
#: Elements that cut blocks, that hold boilerplate, and whose text is no text.
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog head button select textarea fieldset label noscript template iframe object svg canvas audio video map".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that mark boilerplate.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice gdpr sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments reply replies respond discussion disqus social share sharing related recommended newsletter subscribe subscription signup login popup modal overlay pagination pager widget toolbar complementary contentinfo search".split())

_TOKEN = re.compile(r"<!--|<[!?]|</?[a-zA-Z]")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>")
_UNQUOTED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_LONG_REFERENCE = re.compile(r"&#0*(\d{8,});?")
_RAW_END = {name: re.compile(rf"</{name}\b", re.IGNORECASE) for name in RAW}
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")


def unescape(text: str) -> str:
    """Character references decoded; Python converts no number of thousands of digits, so those are told first."""
    return html_lib.unescape(_LONG_REFERENCE.sub("\ufffd", text) if "&#" in text else text)


@dataclass
class Block:
    text: str
    links: int = 0
    boilerplate: bool = False
    region: int = 0
    heading: bool = False
    label: str = field(default="")


def _marked(attributes: str) -> bool:
    """Whether the attributes say that the element is boilerplate or hidden."""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id", "role") and not MARKS.isdisjoint(re.split(r"[\s_-]+", value)):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, white space normalized, character references decoded; empty ones are left out."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # open elements: name, boilerplate, region
    parts: list[tuple[str, bool]] = []
    at, regions, links, heading = 0, 0, 0, False

    def close() -> None:
        nonlocal parts
        text = " ".join("".join(p for p, _ in parts).split())
        if text:
            linked = len(" ".join("".join(p if in_link else " " for p, in_link in parts).split()))
            out.append(Block(text, linked, bool(stack) and stack[-1][1], stack[-1][2] if stack else 0, heading))
        parts = []

    def pop() -> None:
        open_names[stack.pop()[0]] -= 1

    def text(start: int, end: int) -> None:
        if end > start:
            parts.append((unescape(page[start:end]), links > 0))

    last, quoted, open_names = page.rfind(">"), True, Counter()
    while m := _TOKEN.search(page, at):
        if m[0] == "<!--":
            text(at, m.start())
            end = page.find("-->", m.end())
            at = end + 3 if end >= 0 else len(page)
            continue
        if m.start() > last:
            break
        text(at, m.start())
        if m[0] in ("<!", "<?"):
            at = page.find(">", m.end()) + 1
            continue
        tag = _TAG.match(page, m.start()) if quoted else None
        if not tag:
            quoted, tag = False, _UNQUOTED.match(page, m.start())
        m, at = tag, tag.end()
        name, ends = m[2].lower(), bool(m[1])
        if name == "a":
            links = max(0, links - 1) if ends else 1  # links don't nest
        if name in BLOCK:
            close()
            links = 0 if name not in ("br", "hr") else links
        if ends:
            if open_names[name]:
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                if name not in BLOCK and stack[i][1] != (stack[i - 1][1] if i else False):
                    close()
                while len(stack) > i:
                    pop()
            heading = heading and name not in ("h1", "h2", "h3", "h4", "h5", "h6")
            continue
        if name in RAW and not m[3].rstrip().endswith("/"):
            end = _RAW_END[name].search(page, at)
            at = page.find(">", end.end()) + 1 if end else 0
            at = at or len(page)
            continue
        if name in VOID:
            continue
        bad, region = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
        if name in ("article", "main"):
            while stack and stack[-1][0] in ("nav", "header", "menu"):  # left open
                pop()
            bad, region = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
            if not region:
                regions += 1
                region = regions
        own = name in BOILERPLATE or name == "header" and not region or name not in ("html", "body", "article", "main") and _marked(m[3])
        if own and not bad and name not in BLOCK:
            close()
        if name in BLOCK or own or bad or name in ("span", "b", "i", "em", "strong", "section"):
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                pop()
                bad, region = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
            stack.append((name, bad or own, region))
            open_names[name] += 1
        heading = name in ("h1", "h2", "h3", "h4", "h5", "h6") or heading and name not in BLOCK
    text(at, len(page))
    close()
    return out


def classify(block: Block) -> str:
    """First pass: good, bad, near (near good) or short."""
    if block.boilerplate:
        return "bad"
    n = len(block.text)
    if block.links > LINKS_AT_MOST * n:
        return "bad"
    if not block.region and "©" in block.text:
        return "bad"
    words = _WORD.findall(block.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if n < SHORT:
        return "bad" if block.links and not block.region else "short"
    if stops >= STOPS_HIGH:
        return "good" if n > LONG else "near"
    if stops >= STOPS_LOW:
        return "near"
    return "short" if block.region else "bad"


def label(page: list[Block]) -> None:
    """Both passes: set each block's label to good or bad."""
    first = [classify(b) for b in page]
    for i, b in enumerate(page):
        b.label = first[i]
    regions: dict[int, list[int]] = {}
    for i, b in enumerate(page):
        if not b.boilerplate:
            regions.setdefault(b.region, []).append(i)
    for region, places in regions.items():
        # In an article what is decided bad has links; it says nothing on its neighbours.
        decided = [(k, first[i]) for k, i in enumerate(places) if first[i] == "good" or first[i] == "bad" and not region]
        before, after = [None] * len(places), [None] * len(places)
        for side, order, seen in ((before, range(len(places)), dict(decided)), (after, range(len(places) - 1, -1, -1), dict(decided))):
            last = None
            for k in order:
                side[k] = last
                last = seen.get(k, last)
        for k, i in enumerate(places):
            if first[i] in ("near", "short"):
                near = {x for x in (before[k], after[k]) if x}
                if not near:
                    page[i].label = "good" if region or first[i] == "near" else "bad"
                elif len(near) == 1:
                    page[i].label = near.pop()
                else:
                    page[i].label = "good" if first[i] == "near" or page[i].heading and after[k] == "good" else "bad"


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    label(found)
    return " ".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    d = pick(pages, "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(d, run, f"page_id {d.schema[0].dataType.simpleString()}, url string, text string, n_chars long")
