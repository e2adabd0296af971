"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. First pass: blocks of menus, forms, comments and the like, blocks that
are mostly links, and blocks of notices are boilerplate; long blocks with enough stop words (or of any words inside an
article) are content; what is short, or long without stop words, stays undecided. Second pass: an undecided block takes
the label of its nearest decided neighbours, one on either side: in its section, else in its part of the page, else among
all blocks that no menu or the like refused for its place. Neighbours that disagree leave it to the section: content
inside an article or main part, boilerplate elsewhere. Without any such neighbour it is content.

Character references are decoded, white space inside a block is one space, blocks are joined by one newline in page
order. A null or empty page, or one without content, has an empty text. Broken pages (unclosed tags, cut off in the
middle of a tag, comment or script) are read as far as they go. Every row is judged alone; repeated rows get equal
results, further columns are ignored.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.llm.common import map_batches, table

#: Words that running text of these languages can't do without (en, de, fr, es).
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his in is it its not of on or she that the their they this to was were what when which who will with you "
    "aber als am auch auf aus bei das dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch oder sein sich sie sind um und vom von war wie wird zu zum zur "
    "au aux avec ce ces cette comme dans de du elle en est et il ils je la le les leur mais ne nous par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con del el ella era esta este ha la las lo los más muy no o para pero por que se si sin sobre su sus también una y ya".split()
)
SKIPPED = frozenset("script style noscript template svg math iframe object canvas title select textarea audio video".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog button".split())
MAIN = frozenset(("article", "main"))
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id or role that name parts around the main text.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|comments?|commentlist|disqus|replies|respond|cookies?|consent|notice|gdpr|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|"
    r"sidebar|side|widget|related|recommend\w*|breadcrumbs?|nav|navbar|navigation|menu|toolbar|pagination|pager|footer|foot|header|masthead|topbar|copyright|legal|disclaimer|complementary|contentinfo|search|skip\w*)(?:$|[\s_-])",
    re.I,
)
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story)(?:$|[\s_-]|body|text|content)", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@functools.cache
def _close(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)")


@dataclass
class Block:
    text: str
    link_chars: int
    boilerplate: bool  # by where it stands
    main: bool
    section: int
    label: bool | None = None


class Rules:
    """Limits of the first pass."""

    link_density = 0.5
    long_chars = 70
    stop_density = 0.12


def blocks(page: str) -> list[Block]:
    """Text blocks in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # tag, boilerplate, main, section
    pieces: list[str] = []
    state = {"link": 0, "a": 0, "sections": 0}
    opened: Counter[str] = Counter()
    last_close: dict[str, int] = {}
    at, end, low = 0, len(page), page.lower()
    if len(low) != end:  # a letter became two
        low = page.translate(_LOWER)

    def closed(name: str) -> int:
        """Where what is skipped ends; -1 if it is never closed."""
        if name not in last_close:
            last_close[name] = low.rfind(f"</{name}")
        if at > last_close[name]:
            return -1
        m = _close(name).search(low, at)
        return m.end() if m else -1

    def where() -> tuple[bool, bool, int]:
        return stack[-1][1:] if stack else (False, False, 0)

    def flush() -> None:
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            out.append(Block(text, state["link"], *where()))
        pieces.clear()
        state["link"] = 0

    def put(text: str) -> None:
        if text:
            pieces.append(text)
            if state["a"]:
                state["link"] += len("".join(text.split()))

    for m in iter(lambda: _TOKEN.search(page, at), None):
        put(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "a":
                state["a"] = max(0, state["a"] - 1)
            if name in BLOCKS:
                flush()
                if name == "p":  # what isn't the innermost stays open
                    depth = len(stack) - 1 if stack and stack[-1][0] == "p" else -1
                else:
                    depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1) if opened[name] else -1
                if depth >= 0:
                    for gone in stack[depth:]:
                        opened[gone[0]] -= 1
                    del stack[depth:]
            continue
        if name in SKIPPED:
            if not m[3].rstrip().endswith("/"):
                to = closed(name)
                if to >= 0:
                    at = to
                elif name in ("script", "style"):
                    at = end
                elif name == "title":
                    at = next_tag if (next_tag := page.find("<", at)) >= 0 else end
            if name in BLOCKS:
                flush()
            continue
        if name == "br":
            put(" ")
        if name == "a":
            state["a"] += 1
        if name not in BLOCKS:
            continue
        flush()
        state["a"] = 0
        if name == "body":  # whatever the head left open
            stack.clear()
            opened.clear()
        if name in ("p", "li", "tr", "td", "th", "dd", "dt", "option") and stack and stack[-1][0] == name:
            opened[stack.pop()[0]] -= 1
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        bad, main, section = where()
        attributes = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(m[3])} if m[3] else {}
        label = " ".join(attributes.get(k, "") for k in ("class", "id", "role"))
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        named_bad = bool(label.strip()) and bool(NAMES.search(label)) and name not in MAIN and name not in ("body", "html")
        is_main = name in MAIN or bool(label.strip()) and bool(MAIN_NAMES.search(label)) and not named_bad
        bad = bad or hidden or name in BOILERPLATE or named_bad or (name == "header" and not main)
        if name in ("article", "main", "section", "div", "nav", "footer", "aside", "header", "form", "table", "td", "blockquote", "ul", "ol", "dl"):
            state["sections"] += 1 if name not in ("ul", "ol", "dl", "blockquote", "table", "td") or bad else 0
            section = state["sections"] if name not in ("ul", "ol", "dl", "blockquote", "table", "td") or bad else section
        opened[name] += 1
        stack.append((name, bad, main or is_main, section))
    put(page[at:])
    flush()
    return out


def classify(found: list[Block], rules: type[Rules] = Rules) -> list[Block]:
    """Labels every block in two passes; True is content."""
    for b in found:
        solid = len(b.text) - b.text.count(" ")
        words = _WORD.findall(b.text.lower())
        stops = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
        if b.boilerplate or b.link_chars > rules.link_density * solid:
            b.label = False
        elif len(b.text) >= rules.long_chars and (stops >= rules.stop_density or b.main):
            b.label = True
    keys = (lambda b: b.section, lambda b: ("part", b.main), lambda b: "page")
    decided = [b.label for b in found]
    sides: list[dict[int, list[bool]]] = [{}, {}, {}]  # of each undecided block, by key: its nearest decided neighbours' labels
    for way in (range(len(found)), range(len(found) - 1, -1, -1)):
        nearest: dict[object, bool] = {}
        for i in way:
            if found[i].boilerplate:
                continue
            for k, key in enumerate(keys):
                if decided[i] is not None:
                    nearest[key(found[i])] = decided[i]
                elif (label := nearest.get(key(found[i]))) is not None:
                    sides[k].setdefault(i, []).append(label)
    for i, b in enumerate(found):
        if decided[i] is None:
            near = next((x[i] for x in sides if i in x), [True])
            b.label = near[0] if len(set(near)) == 1 else b.main
    return found


def main_text(page: str) -> str:
    return "\n".join(b.text for b in classify(blocks(page)) if b.label)


_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches):
    for batch in batches:
        texts = [main_text(x or "") for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=_ARROW)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, main text and its length for each row of pages."""
    return map_batches(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), _extract, "page_id long, url string, text string, n_chars long")


def op5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
