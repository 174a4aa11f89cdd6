"""Main text of web pages by two-pass block rules.

Pass one labels each block by itself: what its place says (menus, forms, adverts), link
density, length and stop-word density make it good or bad, or leave it undecided. Pass
two gives undecided blocks the label of their nearest decided neighbours. An article
only shifts what a block in it needs; blocks inside and outside are judged by the same signs.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe|select|xmp|object|canvas|math)\b(?:\"[^\"]*\"|'[^']*'|[^\"'>])*(?:/>|>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^\"'>])*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")

_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ASIDE = frozenset("nav footer aside form button dialog menu head fieldset".split())
_MAIN = frozenset("article main".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Words in class, id or role that mark what surrounds an article.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion sidebar side comment comments comentarios kommentare "
    "commentaires reply replies disqus respond cookie cookies consent notice notices alert warning nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "footer share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay pagination pager widget widgets toolbar "
    "masthead topbar skip copyright legal disclaimer search complementary contentinfo".split())
#: The most frequent function words of four languages (fixed values).
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be been but by can could do for from had has have he her his how i if in into is it its just like may more most "
    "my no not of on one only or other our out over she so some such than that the their them then there these they this to up was we were what when which who "
    "will with would you your "
    "aber als am an auch auf aus bei bin bis da das dass dem den der des die doch du durch ein eine einem einen einer er es für hat hatte ich ihr im in ist ja "
    "kann man mehr mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur "
    "au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais même ne nous on ont ou par pas plus pour qu que qui sa se "
    "ses son sont sur un une vous y été "
    "al algo como con cuando del desde donde el ella ellos entre era es esta este están fue ha hasta hay la las le lo los más me mi muy no nos o para pero por "
    "porque que se ser si sin sobre son su sus también te tiene un una unos y ya".split())
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    short: int = 70  #: characters under which a block without a clear sign stays undecided
    long: int = 200
    stop_low: float = 0.15
    stop_high: float = 0.25
    most_links: float = 0.35
    article_links: float = 0.6  #: share of links above which a block in an article is bad


GOOD, BAD, OPEN = 1, 0, -1


#: First words of names that say what an element has or lacks, and words of names of whole pages: neither says what it is.
_STATES = frozenset("no not has have with without hide show is open closed".split())
_PAGES = frozenset("page site layout template home".split())


def _marked(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element is hidden, and whether a name in its class, id or role marks it as something beside an article."""
    named = False
    for name, *values in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, named
        if name == "style":
            if "display:none" in value.replace(" ", ""):
                return True, named
        elif name in ("class", "id", "role"):
            for token in value.split():
                words = _PART.findall(token)
                if tag in _MAIN:
                    # an article is an article, unless a name says outright that it is a comment or a teaser
                    named |= token in _MARKS
                elif words and words[0] not in _STATES and _PAGES.isdisjoint(words):
                    named |= not _MARKS.isdisjoint(words)
    return False, named


def blocks(page: str) -> list[tuple[str, int, int, int, tuple[int, ...]]]:
    """Blocks in page order: text with single blanks, characters of it in links, place (BAD aside, GOOD in an article, OPEN), number of its article (0 outside), and the numbers of the elements around it that only a name marks."""
    found: list[tuple[str, int, int, int, tuple[int, ...]]] = []
    open_tags: list[tuple[str, bool, int]] = []
    marks: list[int] = []
    aside = inside = links = articles = named = 0
    parts: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append((text, len(" ".join(html.unescape("".join(linked)).split())), BAD if aside else GOOD if inside else OPEN, articles if inside else 0, tuple(marks)))
            parts.clear()
            linked.clear()

    def close(k: int) -> None:
        nonlocal aside, inside, links
        for tag, bad, mark in open_tags[k:]:
            aside -= bad
            if mark:
                marks.remove(mark)
            inside -= tag in _MAIN
            links -= tag == "a"
        del open_tags[k:]

    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            parts.append(text)
            if links:
                linked.append(text)
            continue
        tag = m["tag"]
        if tag is None:
            if m["raw"] is not None:
                parts.append(" ")
            continue
        tag = tag.lower()
        if tag not in _INLINE:
            flush()
        if m["end"]:
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == tag:
                    close(k)
                    break
            continue
        if tag in _CLOSES_P:
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == "p":
                    close(k)
                    break
                if open_tags[k][0] not in _INLINE:
                    break
        attrs = m["attrs"]
        if tag in _VOID or attrs.endswith("/"):
            continue
        hidden, marked = _marked(tag, attrs) if attrs and tag not in ("html", "body") else (False, False)
        bad = tag in _ASIDE or tag == "header" and not inside or hidden
        named += marked
        open_tags.append((tag, bad, named if marked else 0))
        if marked:
            marks.append(named)
        aside += bad
        articles += tag in _MAIN and not inside
        inside += tag in _MAIN
        links += tag == "a"
    flush()
    return found


def _alone(text: str, linked: int, place: int, s: Settings) -> int:
    """Label of a block by itself."""
    if place == BAD:
        return BAD
    density = linked / len(text)
    if density > (s.article_links if place == GOOD else s.most_links):
        return BAD
    if len(text) < s.short:
        return OPEN
    words = _WORD.findall(text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if place == GOOD:
        if density <= s.most_links:
            return GOOD if stops >= s.stop_low else OPEN
        return OPEN if stops >= s.stop_low else BAD
    if stops >= s.stop_high or stops >= s.stop_low and len(text) >= s.long:
        return GOOD
    return OPEN if stops >= s.stop_low else BAD


def main_text(page: str | None, s: Settings = Settings()) -> str:
    """Good blocks of a page, joined by one blank; empty for a null, empty or text-free page.

    An undecided block takes the label of the nearest decided one on either side; where
    the two differ, the nearer by characters between, of equals the good one. Blocks
    inside an article ask within it only, and what stands aside there is not asked; where
    nothing is decided on one side of them, they are good. Blocks outside ask each other
    and what stands aside; one that no neighbour decides is bad. What a class, id or role
    marks stands aside; where that would leave a page empty, an element that holds most of
    its text is judged as if it had no such name.
    """
    if not page:
        return ""
    found = blocks(page)
    out = _good(found, frozenset(), s)
    if not out and any(marks for *_, marks in found):
        # names alone do not empty a page: the elements that hold most of it are judged without them
        held: Counter[int] = Counter()
        for text, _, _, _, marks in found:
            held.update(dict.fromkeys(marks, len(text)))
        total = sum(len(text) for text, *_ in found)
        out = _good(found, frozenset(m for m, n in held.items() if 2 * n > total), s)
    return out


def _good(found: list[tuple[str, int, int, int, tuple[int, ...]]], unmarked: frozenset[int], s: Settings) -> str:
    """The good blocks; ``unmarked`` elements count as if they had no name."""
    found = [(text, linked, place if unmarked.issuperset(marks) else BAD, article) for text, linked, place, article, marks in found]
    labels = [_alone(text, linked, place, s) for text, linked, place, _ in found]
    ends, total = [], 0
    for text, *_ in found:
        total += len(text)
        ends.append(total)
    near: list[list[int | None]] = []
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        seen: list[int | None] = [None] * len(found)
        last: dict[int, int] = {}
        for k in order:
            place, article = found[k][2:]
            scope = article if place == GOOD else 0
            if labels[k] != OPEN:
                last[scope] = k  # a menu or advert beside an open block is a decided neighbour
            seen[k] = last.get(scope)
        near.append(seen)
    out = []
    for k, (text, _, place, _) in enumerate(found):
        label = labels[k]
        if label == OPEN:
            before, after = near[0][k], near[1][k]
            sides = [x for x in (before, after) if x is not None]
            if place == GOOD and len(sides) < 2:
                label = GOOD
            elif not sides:
                label = BAD
            else:
                between = {x: max(ends[x], ends[k]) - min(ends[x], ends[k]) - len(found[max(x, k)][0]) for x in sides}
                label = labels[max(sides, key=lambda x: (-between[x], labels[x]))]
        if label == GOOD:
            out.append(text)
    return " ".join(out)


def extract(pages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``page_id``, ``url``, ``text`` and its length ``n_chars`` in code points: one row per input row.

    The whole page is read; nothing is cut. Null and empty pages give an empty text, and
    repeated rows the same text. Broken markup is read as far as it goes: unclosed tags
    end with the page. Other columns play no part.
    """
    narrow = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py(), s) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return narrow.mapInArrow(run, f"page_id {dict(narrow.dtypes)['page_id']}, url {dict(narrow.dtypes)['url']}, text string, n_chars bigint")
