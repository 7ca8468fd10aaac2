"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: its elements that make blocks, each with the path of elements it stands under, and its
blocks of text. Pages of a host whose upper elements are the same have a layout. Tokens of a layout that occur equally
often on each of its pages share an occurrence vector; vectors are compared by fingerprints that partial aggregates
build, so that no host's pages meet in one task. The class of the elements that stand once on every page is the root of
the template: where they open and close, in one order, cuts every page into the same slots. Frequent classes that hold
texts nest in these slots and are template too. Pages whose root stands in another order are a layout of their own.

What the slots hold on all pages decides: slots whose text hardly changes, and those of links, are none of the article.
Of the others the one with most text is; with it go the slots of the same root element, of the elements around it
if they hold text of a like amount beside it, and headlines before it. Names of elements (menu, footer, comments) are a
further sign only: they apply to containers inside the chosen one. Texts of the template are left out.

Layouts of few different pages have no template; there names of elements decide alone, and an article or main element if
it has half of the text that is left.

Defined cases: a null or empty html gives an empty text; pages without a host share the host ""; repeated rows
give a row each; copies of a page count once; what begins as a tag and doesn't end is text; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, materialize

# no repeat overlaps another and none is given back, so that malformed pages take linear time too
_ATTRS = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+'){0,256}+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|select|svg|iframe|object)\b{_ATTRS}>.*?(?:</(?P=raw)\s*+>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>\"']*+)(?P<attrs>{_ATTRS})>|<[!?][^<>]*+>|(?P<text>[^<]++|<)",
    re.S | re.I,
)
#: Elements that begin and end blocks of text, elements without content, those that hold no main text, and those that
#: hold other blocks.
_BLOCKS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUTSIDE = frozenset("nav header footer aside form head menu dialog button label".split())
_CONTAINERS = frozenset("article aside body center div dl fieldset footer form header html main menu nav ol section table tbody td tr ul".split())
_CLOSES_P = _BLOCKS - {"br", "body", "html", "head", "title", "option"}
#: Words of class, id or role that mark parts other than the article, and words that say nothing beside them.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion sidebar side nav navbar navigation menu breadcrumb breadcrumbs header masthead footer comment comments respond discussion replies cookie cookies consent notice notification alert gdpr popup modal newsletter subscribe subscription signup login share sharing social related recommended widget widgets toolbar pagination pager copyright complementary contentinfo search skip hidden".split()
)
_NEUTRAL = frozenset("area articles bar block bottom box column container content form global inner items left links list main outer page panel posts primary right secondary section site the thread top wrap wrapper".split())
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_DIGITS = re.compile(r"\d+")
#: Levels of elements that make a layout: html, what is in it, in body and in its parts.
_UPPER = 4
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
OPEN, CLOSE, TEXT = 0, 1, 2


def _hash(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(map(str, parts))) - (1 << 63)


def _marked(names: list[str]) -> bool:
    """Whether a name of an element is made of the words that mark other parts, at least one, and neutral ones."""
    for name in " ".join(names).lower().split():
        words = [w for w in re.split(r"[-_]+", _DIGITS.sub("", name)) if w]
        if any(w in _MARKS for w in words) and all(w in _MARKS or w in _NEUTRAL for w in words):
            return True
    return False


def page_events(source: str) -> list[tuple]:
    """What opens, closes and is said on a page, in order: (OPEN or CLOSE, path, depth, tag) of elements that make blocks,
    and (TEXT, path, depth of the innermost mark around it or 0, number of the outermost article or main element
    around it or 0, text, characters in links). A path is a hash of an element, its names and what it stands under.
    A block goes on over inline elements and ends at block elements."""
    events: list[tuple] = []
    # tag, path, depth, mark, article, whether a paragraph can be closed here, whether in a link
    stack: list[tuple] = [("", 0, 0, 0, 0, False, False)]
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = articles = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            _, path, _, mark, article, _, _ = stack[-1]
            events.append((TEXT, path, mark, article, text, min(linked, len(text))))
        linked = 0

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            tag, path, depth, *_ = stack.pop()
            opened[tag] -= 1
            if tag in _BLOCKS:
                events.append((CLOSE, path, depth, tag))

    for m in _TOKEN.finditer(source):
        if (text := m["text"]) is not None:
            parts.append(text)
            if stack[-1][6]:
                linked += len(text)
            continue
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if tag in _BLOCKS:
            flush()
        if m["end"]:
            if opened.get(tag):
                at = len(stack) - 1
                while stack[at][0] != tag:
                    at -= 1
                if any(x[0] in _BLOCKS for x in stack[at + 1 :]):
                    flush()
                close(at)
            continue
        if tag in _CLOSES_P and stack[-1][5]:
            at = len(stack) - 1
            while stack[at][0] != "p":
                at -= 1
            close(at)
        attrs = m["attrs"] or ""
        _, path, depth, mark, article, p, link = stack[-1]
        names = [x.strip("\"'") for x in _NAMES.findall(attrs)] if attrs else []
        if tag in ("article", "main") and not article and not mark:
            articles += 1
            article = articles
        if tag in _BLOCKS:
            path, depth, p = _hash(path, tag, _DIGITS.sub("#", "|".join(sorted(names)).lower())), depth + 1, tag == "p"
            # the header of an article holds its headline: only one outside of articles is the page's
            other = tag in _OUTSIDE and not (tag == "header" and article)
            if tag not in ("html", "body", "article", "main") and (other or (attrs and (_HIDDEN.search(attrs) or (tag in _CONTAINERS and _marked(names))))):
                mark = depth
            events.append((OPEN, path, depth, tag))
        elif tag in _OUTSIDE or (attrs and _HIDDEN.search(attrs)):
            mark = depth + 1
        if tag in _VOID or attrs.endswith("/"):
            if tag in _BLOCKS:
                events.append((CLOSE, path, depth, tag))
        else:
            opened[tag] = opened.get(tag, 0) + 1
            stack.append((tag, path, depth, mark, article, p, link or tag == "a"))
    flush()
    close(1)
    return events


def _layout(events: list[tuple]) -> int:
    """The page's upper elements, whatever they say and however often they stand there."""
    return _hash("layout", *sorted({e[1] for e in events if e[0] == OPEN and e[2] <= _UPPER}))


def _host(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _occurrences(pages: DataFrame) -> DataFrame:
    """(host, layout, token, is_text, page, content, n): how often each token stands on each page; token 0 is the page
    itself. ``content`` stands for what the page says: copies have the same."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, source in zip(*[c.to_pylist() for c in batch.columns]):
                events = page_events(source or "")
                host, layout, content = _host(url), _layout(events), _hash("said", *[e[4] for e in events if e[0] == TEXT and not e[2]])
                page, seen = _hash(page_id, source or ""), {0: (False, 1)}
                for e in events:
                    if e[0] != CLOSE:
                        key = e[1] if e[0] == OPEN else _hash(e[1], e[4])
                        seen[key] = (e[0] == TEXT, seen.get(key, (0, 0))[1] + 1)
                rows += [(host, layout, key, is_text, page, content, n) for key, (is_text, n) in seen.items()]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 7, kinds)], names=["host", "layout", "token", "is_text", "page", "content", "n"])

    return pages.select("page_id", "url", "html").mapInArrow(count, "host string, layout bigint, token bigint, is_text boolean, page bigint, content bigint, n bigint")


def template_classes(pages: DataFrame, support: float = 0.5, least_pages: int = 4, least_texts: int = 8) -> DataFrame:
    """(host, layout, roots, texts): the elements of the root class and the template's texts of each layout with
    ``least_pages`` different contents. Texts need ``least_texts`` contents and the share ``support`` of all."""
    found = _occurrences(pages)
    # the occurrence vector's fingerprint: an order-free combination of (page, count) hashes, with its sums
    vector = [F.bit_xor(F.xxhash64("page", "n")).alias("v"), F.bit_xor(F.xxhash64("n", "page")).alias("u"), F.count("*").alias("pages")]
    by_content = found.groupBy("host", "layout", "token", "is_text", "content").agg(*vector)
    sums = [F.bit_xor("v").alias("v"), F.bit_xor("u").alias("u"), F.sum("pages").alias("pages"), F.count("*").alias("contents")]
    tokens = materialize(by_content.groupBy("host", "layout", "token", "is_text").agg(*sums).filter(F.col("contents") >= least_pages), "template-tokens")
    page = tokens.filter("token = 0").select("host", "layout", *[F.col(c).alias(f"_{c}") for c in ("v", "u", "pages", "contents")])
    both = tokens.filter("token <> 0").join(page, ["host", "layout"])
    same = (F.col("v") == F.col("_v")) & (F.col("u") == F.col("_u")) & (F.col("pages") == F.col("_pages"))
    text = F.col("is_text") & (F.col("contents") >= least_texts) & (F.col("contents") >= support * F.col("_contents"))
    classes = both.groupBy("host", "layout").agg(F.collect_set(F.when(same & ~F.col("is_text"), F.col("token"))).alias("roots"), F.collect_set(F.when(text, F.col("token"))).alias("texts"))
    return classes.filter("size(roots) > 0")


def _slots(events: list[tuple], roots: frozenset, texts: frozenset) -> tuple[int, list[tuple]]:
    """(order of the root elements, slots): a slot is (number, root containers around it, headline or not, its blocks).
    Slots without a block are left out; the template's texts are no blocks."""
    number, around, order, out = 0, [], [], []
    blocks: list[tuple] = []
    head = ""

    def end() -> None:
        nonlocal blocks
        if blocks:
            out.append((number, tuple(p for p, tag in around if tag in _CONTAINERS), head, blocks))
            blocks = []

    for e in events:
        if e[0] == TEXT:
            if _hash(e[1], e[4]) not in texts:
                blocks.append(e)
        elif e[1] in roots:
            end()
            number += 1
            order.append(e[:2])
            if e[0] == OPEN:
                around.append((e[1], e[3]))
            else:
                around = [x for x in around if x[0] != e[1]]
            head = around[-1][1] if around else ""
    end()
    return _hash("order", *order), out


def _of_layout(classes: list | None, layout: int) -> tuple[frozenset, frozenset]:
    for c in classes or ():
        if c["layout"] == layout:
            return frozenset(c["roots"]), frozenset(c["texts"])
    return frozenset(), frozenset()


def _with_templates(pages: DataFrame, templates: DataFrame, rows: int, salts: int = 32) -> DataFrame:
    """``pages`` with their host's ``templates`` (host, ...; ``rows`` entries). Beyond a broadcast they meet by host and
    salt, so that a host with a third of all pages is many tasks."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    if rows <= 1_000_000:  # 8 MB
        return pages.join(F.broadcast(templates), "host", "left")
    salted = templates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return pages.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(salted, ["host", "_salt"], "left")


_SLOT = "host string, layout bigint, ord bigint, slot int, around array<bigint>, head string, content bigint, page bigint, chars bigint, plain bigint, links bigint"


def slot_contents(pages: DataFrame) -> DataFrame:
    """What each page of a layout with a template has in each slot: characters, those without a mark, those in links,
    and a hash; slot -1 is the page. ``pages`` have ``classes``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, source, classes in zip(*[c.to_pylist() for c in batch.columns]):
                events = page_events(source or "") if classes else []
                layout = _layout(events) if classes else 0
                roots, texts = _of_layout(classes, layout)
                if not roots:
                    continue
                host, page = _host(url), _hash("said", *[e[4] for e in events if e[0] == TEXT and not e[2]])
                order, slots = _slots(events, roots, texts)
                rows.append((host, layout, order, -1, [], "", page, page, 0, 0, 0))
                for number, around, head, blocks in slots:
                    size = [len(b[4]) for b in blocks]
                    content = _hash(*[b[4] for b in blocks])
                    rows.append((host, layout, order, number, list(around), head, content, page, sum(size), sum(n for n, b in zip(size, blocks) if not b[2]), sum(b[5] for b in blocks)))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 11, kinds)], names=[c.split()[0] for c in _SLOT.split(", ")])

    return pages.select("url", "html", "classes").mapInArrow(read, _SLOT)


def choose_slots(slots: pd.DataFrame, least_pages: int, like: float = 0.4, varied: float = 0.3) -> tuple[int | None, list[int]]:
    """(path of the chosen container or None, kept slots) of one layout from its slots' sums over all pages. Slots vary
    whose texts are ``varied`` times as many as the pages that have them; text beside the chosen container is of a like
    amount from ``like`` times its text on."""
    pages = slots[slots["slot"] == -1]
    if not len(pages) or int(pages["pages"].iloc[0]) < least_pages:
        return None, []
    rest = slots[(slots["slot"] >= 0) & (slots["contents"] >= varied * slots["pages"]) & (slots["contents"] > 1) & (2 * slots["links"] <= slots["chars"])]
    rest = rest.sort_values("slot")
    size = "plain" if rest["plain"].sum() >= 0.2 * rest["chars"].sum() else "chars"
    rest = rest[rest[size] > 0]
    text = rest[~rest["head"].isin(("h1", "h2", "h3", "h4", "h5", "h6", "title"))]
    if not len(text):
        return None, []
    main = text.loc[text[size].idxmax()]
    around = [*main["around"]]
    if not around:
        return None, []
    under = lambda rows, path: rows[[path in a for a in rows["around"]]]
    chosen = around[-1]
    for path in reversed(around[:-1]):
        own = under(text, chosen)[size].sum()
        if under(text, path)[size].sum() - own >= like * own:
            chosen = path
    kept = set(under(rest, chosen)["slot"])
    kept |= set(rest[(rest["head"] == "h1") & (rest["slot"] < main["slot"])]["slot"])
    return int(chosen), sorted(int(k) for k in kept)


def kept_slots(slots: DataFrame, least_pages: int = 4) -> DataFrame:
    """(host, layout, ord, container, kept) of the layouts that have a main text, from :func:`slot_contents`."""
    # copies of a page count once
    once = slots.groupBy("host", "layout", "ord", "slot", "page").agg(F.first("around").alias("around"), F.first("head").alias("head"), F.min("content").alias("content"), *[F.max(c).alias(c) for c in ("chars", "plain", "links")])
    each = once.groupBy("host", "layout", "ord", "slot", "content").agg(F.first("around").alias("around"), F.first("head").alias("head"), F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in ("chars", "plain", "links")])
    sums = each.groupBy("host", "layout", "ord", "slot").agg(F.first("around").alias("around"), F.first("head").alias("head"), F.count("*").alias("contents"), *[F.sum(c).alias(c) for c in ("pages", "chars", "plain", "links")])

    def choose(f: pd.DataFrame) -> pd.DataFrame:
        container, kept = choose_slots(f, least_pages)
        first = f.iloc[0]
        rows = [(first["host"], first["layout"], first["ord"], container, kept)] if container is not None else []
        return pd.DataFrame(rows, columns=["host", "layout", "ord", "container", "kept"])

    # a group is a layout's slots, of which a page has one more than root elements open and close
    return sums.groupBy("host", "layout", "ord").applyInPandas(choose, "host string, layout bigint, ord bigint, container bigint, kept array<int>")


def deduce_templates(pages: DataFrame) -> tuple[DataFrame, int]:
    """(host, classes, choices) per host that has a template, and the number of entries."""
    classes = template_classes(pages).groupBy("host").agg(F.collect_list(F.struct("layout", "roots", "texts")).alias("classes"))
    size = F.sum(F.aggregate("classes", F.lit(0).cast("long"), lambda s, c: s + F.size(c["roots"]) + F.size(c["texts"])))
    classes, seen = counted(classes, "template-classes", n=size)
    slots = slot_contents(_with_templates(pages, classes, seen["n"] or 0))
    chosen = kept_slots(slots).groupBy("host").agg(F.collect_list(F.struct("layout", "ord", "container", "kept")).alias("choices"))
    return materialize(classes.join(chosen, "host", "left"), "templates"), seen["n"] or 0


def main_text(source: str, classes: list | None, choices: list | None) -> str:
    """The main text of a page, with its host's templates or by its elements alone."""
    events = page_events(source)
    layout = _layout(events)
    roots, texts = _of_layout(classes, layout)
    if roots:
        order, slots = _slots(events, roots, texts)
        for c in choices or ():
            if c["layout"] == layout and c["ord"] == order:
                (depth,) = {e[2] for e in events if e[0] == OPEN and e[1] == c["container"]}
                kept = frozenset(c["kept"])
                return "\n".join(b[4] for number, _, head, blocks in slots if number in kept for b in blocks if b[2] <= depth or head == "h1")
    blocks = [e for e in events if e[0] == TEXT and not e[2] and (not texts or _hash(e[1], e[4]) not in texts)]
    inside = [b for b in blocks if b[3]]
    if 2 * sum(len(b[4]) for b in inside) >= sum(len(b[4]) for b in blocks):
        blocks = inside
    return "\n".join(b[4] for b in blocks)


def main_texts(pages: DataFrame) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars."""
    templates, entries = deduce_templates(pages)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(source or "", classes, choices) for source, classes, choices in zip(*[c.to_pylist() for c in batch.columns[2:]])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = _with_templates(pages, templates, entries)
    return joined.select("page_id", "url", "html", "classes", "choices").mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint")
