"""HTML extraction by two passes of block rules.

A page is cut into blocks of text at block elements. The first pass decides
each block from the share of its words that are stop words, its length and its
link density; short blocks and near-misses stay open. The second pass gives
open blocks the label of the nearest decided neighbours: the same on both sides
decides, and where they differ the nearer one does. On a page in a language that
the lists don't know, its own most frequent short words stand for stop words;
of scripts without spaces each letter is a word.

Markup moves the thresholds. Inside an article or main element less is asked of a
block. Under a class name of what often isn't the article (tags, related, social,
legal and so on) only dense running text is content. Under the marks of what never
is (navigation, headers, footers, asides, forms, notices, adverts, comments, hidden
parts) a block of any length to judge is none, as an advert or a comment reads like
the article does. Labels don't cross the edges of articles and of marked
containers: a short line in a container inherits only from that container's own
text. The edges of an article in which the first pass found content count as
content. A page without content is judged again with fewer stop words asked for, as
tables and lists of names have few. An article without content is judged like the
rest of the page, unless no block of the page is content and the article has so few
words of running text that it may lack stop words by chance.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Common function words of the languages that pages come in.
STOP_WORDS = {
    "en": "a about after all also an and any are as at be been but by can could did do for from had has have he her his if in into is it its more no not of on or our out over she so some than that the their them then there these they this to up was we were what when which who will with would you your",
    "de": "aber als am an auch auf aus bei bin bis das dass dem den der des die doch durch ein eine einem einen einer es für hat ich ihr im in ist mit nach nicht noch nur oder sein sich sie sind so über um und uns vom von vor war was wenn werden wie wir wird zu zum zur",
    "fr": "à au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou où par pas plus pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous",
    "es": "a al algo como con de del desde donde el ella ellos en entre era es esa ese esta este fue ha hasta hay la las le les lo los más me mi muy no nos o para pero por que se ser si sin sobre son su sus también te todo tu un una uno y ya",
    "it": "al alla che chi con da dal dei della delle di e è gli ha i il in io la le lo ma mi nei nel nella non per più quando se si sono un una",
    "pt": "ao as com como da das de do dos e ela ele em foi isso mais mas não na no nos o os ou para pela pelo por quando que se ser uma um",
    "nl": "aan als bij dan dat de die dit door een en er haar het hij ik in is maar met naar niet om onder ook op te tot uit van voor was wat ze zijn",
    "ru": "а без бы был в вы для до его ее же за и из или к как мы на не но о он она они от по при с так то у уже что это",
}
STOP = frozenset(w for words in STOP_WORDS.values() for w in words.split())

#: Fixed values of HTML: elements that end a block, whose text is no text, and that have no end tag.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li link main menu meta nav noframes noscript object ol optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul video".split())
SILENT = frozenset("script style noscript template svg math iframe object head title textarea select button noframes canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav footer aside form header menu dialog button".split())
#: Elements whose start ends an open p.
ENDS_P = BLOCKS - frozenset("body head html link meta template noscript object iframe video option optgroup".split())

#: Open elements that the start of another ends, within their list or table.
SIBLINGS = {"li": ("li",), "tr": ("tr",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}

#: What the contract of the article leaves out, and what often isn't the article, in class names and ids.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|adslot|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|popup|modal|newsletter|subscri\w*|signup|login"
    r"|nav\w*|menu\w*|breadcrumb\w*|pagination|pager|sidebar\w*|aside|footer\w*|copyright|comments?|commentlist|reply|replies|disqus|respond)(?:$|[\s_-])",
    re.I,
)
DOUBTED = re.compile(r"(?:^|[\s_-])(?:alert|overlay|side|rail|widget\w*|legal|disclaimer|social|share|sharing|related|recommended|trending|popular|tags?|toolbar|search)(?:$|[\s_-])", re.I)
#: Heads of a site; inside an article they hold its title.
HEADS = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: A quote begins a value only after an equals sign; an open one runs to the end.
TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$)|))*+)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
#: Letters of scripts without spaces between words are words by themselves.
WORD = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]|[^\W\d_]+")
SPACE = re.compile(r"\s+")

LOW_STOP, HIGH_STOP, LINE, SHORT, LONG, MOST_LINKS = 0.10, 0.22, 30, 70, 200, 0.4
#: Of a page whose words the lists hardly know: the share under which that is so, and how many of its own words of at most so many letters, seen so often, are its stop words.
UNKNOWN, OWN, LETTERS, SEEN = 0.04, 12, 4, 3
#: What is left of the stop words asked for where a page would have no content, and of how many words of running text an article may lack them by chance.
EASE, FEW = 0.1, 200


def _marked(attributes: str, inside: bool) -> int:
    """2 where attributes mark what isn't the article, 1 where they mark what often isn't, else 0; inside one, heads don't."""
    if not attributes.strip():
        return 0
    mark = 0
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and (MARKED.search(value) or not inside and HEADS.search(value)) or name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
            return 2
        if name in ("class", "id") and DOUBTED.search(value):
            mark = 1
    hidden = re.search(r"(?:^|\s)hidden(?:\s|$|=)", ATTRIBUTE.sub(lambda m: m[0] if m[1].lower() == "hidden" else " ", attributes))
    return 2 if hidden else mark


class Block(NamedTuple):
    """A block: its text, the code points of it in links, the strongest mark over it (0 to 2), the number of the outermost article that it is in and of the outermost marked container (0: none)."""

    text: str
    linked: int
    mark: int = 0
    article: int = 0
    container: int = 0


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order. The time is linear in the page."""
    out: list[Block] = []
    #: Open elements: name, mark, whether an article.
    open_: list[tuple[str, int, bool]] = []
    #: Places in open_ by name, and silent elements that nothing ends from here on.
    places: dict[str, list[int]] = defaultdict(list)
    endless: set[str] = set()
    said: list[str] = []
    linked = 0
    n_in = n_links = articles = containers = 0
    #: Open elements by their mark.
    under = [0, 0, 0]

    def end_block() -> None:
        nonlocal linked
        if said:
            text = SPACE.sub(" ", "".join(said)).strip()
            said.clear()
            if text:
                mark = 2 if under[2] else min(under[1], 1)
                out.append(Block(text, linked, mark, articles if n_in else 0, containers if mark else 0))
        linked = 0

    def last(*names: str) -> int:
        return max((places[n][-1] for n in names if places[n]), default=-1)

    def close(k: int) -> None:
        nonlocal n_in, n_links
        for name, mark, article in open_[k:]:
            places[name].pop()
            under[mark] -= 1
            n_in -= article
            n_links -= name == "a"
        del open_[k:]

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            said.append(text)
            if n_links:
                linked += len(text.strip())

    at = 0
    while True:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if not name:  # a comment or declaration
            continue
        if name == "br":
            said.append("\n")
            continue
        if m[1]:
            if name in BLOCKS:
                end_block()
            if places[name]:
                close(last(name))
            continue
        attributes = m[3] or ""
        if name in SILENT:
            if name in BLOCKS:
                end_block()
            if not attributes.endswith("/"):
                end = None if name in endless else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                if end is None:
                    endless.add(name)
                at = end.end() if end else (len(page) if name in ("script", "style", "textarea", "title") else at)
            continue
        if name in BLOCKS:
            end_block()
            if name in ENDS_P:
                if places["p"]:
                    close(last("p"))
            k = last(*SIBLINGS.get(name, ()))
            if k > last("ul", "ol", "dl", "table", "menu"):
                close(k)
        if name in VOID or attributes.endswith("/"):
            continue
        article = name in ("article", "main") or 'articleBody"' in attributes or 'role="main"' in attributes
        mark = _marked(attributes, n_in > 0 or article) if name not in ("body", "html", "main") else 0
        article = article and mark < 2
        if name in OUTSIDE and not (name == "header" and n_in):
            mark = 2
        if article:
            mark = 0
        containers += mark > 0 and not under[1] and not under[2]
        places[name].append(len(open_))
        open_.append((name, mark, article))
        under[mark] += 1
        articles += article and not n_in
        n_in += article
        n_links += name == "a"
    end_block()
    return out


def stop_words(blocks: list[Block]) -> frozenset[str]:
    """The stop words that a page is judged by: the lists', or its own where its text outside links hardly has any of these."""
    words = [w for text, linked, *_ in blocks if not linked for w in WORD.findall(text.lower())]
    if not words or sum(w in STOP for w in words) >= UNKNOWN * len(words):
        return STOP
    own = Counter(w for w in words if len(w) <= LETTERS)
    return frozenset(w for w, n in sorted(own.items(), key=lambda x: (-x[1], x[0]))[:OWN] if n >= SEEN)


def _running(text: str) -> bool:
    """Whether a text is running text: at most a fifth of its tokens have no letter. Rows of tables and figures aren't, and stop words say nothing of them."""
    tokens = text.split()
    return 5 * sum(WORD.search(t) is None for t in tokens) <= len(tokens)


def _decided(block: Block, stops: frozenset[str], ease: float = 1.0) -> bool | None:
    """The first pass: whether a block is content, None where its neighbours decide. Ease multiplies the stop words asked for."""
    text, linked, mark, article, _ = block
    low, high = LOW_STOP * ease, HIGH_STOP * ease
    words = WORD.findall(text.lower())
    stop = sum(w in stops for w in words) / len(words) if words else 0.0
    article = article and not mark
    if linked / len(text) > MOST_LINKS:
        return None if article and stop >= low and len(text) >= SHORT else False
    if len(text) < SHORT:
        return True if article and stop >= high and len(text) >= LINE else None
    if mark:
        return mark == 1 and stop >= high
    if stop >= high or stop >= low and (article or len(text) >= LONG):
        return True
    return None if article or stop >= low or len(text) >= LONG else False


def labels_of(blocks: list[Block]) -> list[bool]:
    """Which blocks are content."""
    stops = stop_words(blocks)
    ease = 1.0 if any(_decided(b, stops) for b in blocks) else EASE
    first = [_decided(b, stops, ease) for b in blocks]
    articles = {b.article for b in blocks if b.article}
    real = {b.article for b, x in zip(blocks, first, strict=True) if x and b.article and not b.mark}
    if not any(first):
        words = Counter()
        for b in blocks:
            if b.article and not b.mark:
                words[b.article] += len(WORD.findall(b.text)) if _running(b.text) else 0
        real = {a for a, n in words.items() if n <= FEW}
    if len(real) < len(articles):  # a teaser is judged again, without its markup's word
        first = [_decided(b._replace(article=0), stops, ease) if b.article and b.article not in real else x for b, x in zip(blocks, first, strict=True)]
    #: Blocks that may inherit from each other: of one container, of one article, or between two articles.
    parts: dict[tuple[int, int, int], list[int]] = defaultdict(list)
    between = before = 0
    for i, b in enumerate(blocks):
        article = b.article if b.article in real else 0
        if not b.mark:
            between += article != before
            before = article
        parts[(b.container, 0, 0) if b.mark else (0, article, 0 if article else between)].append(i)
    out = [False] * len(blocks)
    for (_, article, _), at in parts.items():
        for i, x in zip(at, _inherited([first[i] for i in at], article > 0), strict=True):
            out[i] = x
    return out


def _inherited(first: list[bool | None], edge: bool) -> list[bool]:
    """The second pass: open blocks get the label of the nearest decided one, of two as near the label edge. Where edge is True both ends count as content beside the first and last block, else nothing is beyond them."""
    n = len(first)
    before: list[tuple[int, bool]] = []
    last = (-1, True) if edge else (-n - 1, False)
    for i, x in enumerate(first):
        last = (i, x) if x is not None else last
        before.append(last)
    out, nearest = [False] * n, (n, True) if edge else (2 * n + 1, False)
    for i in range(n - 1, -1, -1):
        nearest = (i, first[i]) if first[i] is not None else nearest
        (a, left), (b, right) = before[i], nearest
        out[i] = first[i] if first[i] is not None else (left if left == right else (left if i - a < b - i else right if b - i < i - a else edge))
    return out


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by two line feeds; empty for none."""
    blocks = blocks_of(page or "")
    return "\n\n".join(b[0] for b, good in zip(blocks, labels_of(blocks), strict=True) if good)


def extract(page: Column) -> Column:
    """The main text of each whole page.

    A null page, an empty one and one without content are empty texts; equal
    pages have equal texts. It is an expression of its own column, so other
    columns, repeated rows and empty tables need no rule.
    """

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(x) for x in pages], dtype=object)

    return text(page)


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", extract(F.col("html")).alias("text"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
