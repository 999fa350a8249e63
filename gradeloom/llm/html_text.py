"""Main text of web pages by template deduction over the pages of each host.

A token is the opening or the closing of an element, told apart by the path from the root.
Its occurrence vector says how often each page of the host holds it; tokens with equal
vectors form an equivalence class. The class of what every page holds just once is the frame
of the host's template; classes of several elements that at least half of the pages hold
nest in it. A class is valid if on nearly all of its pages its tokens stand in one order, over
and over in that order if they come back, and if its spans and those of other classes do not
overlap; tokens of other classes are taken as the pages' own.

What stands between a token of the template and the next is a slot. Slots whose text keeps
coming back from page to page belong to the template too (menus, notices, adverts), inside an
article as well; the other slots are extracted.

Pages of a host with the same texts in the same order are copies and count once.
Vectors are not gathered: two sums of hashes of (page, number) stand for one, so that
a host with very many pages needs no large group; and since a template token is on half of
the pages, a host's template is no larger than twice the tokens of its average page. Of the slots that
are left, what HTML itself calls no main text (menus, forms, sidebars, readers' comments and the like)
is out on every host, however many pages it has and whatever their texts are; what is never shown
as text (scripts, comments, options) is out anyway. Reading a page takes time in proportion to its length.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm.common import Carried, arrow_batches, batch_slices, named
from gradeloom.llm.url_filters import url_host
from gradeloom.session import Scratch, ship_package

#: A slot is the template's if so many of its texts are seen and each distinct one comes back this often.
MIN_TEXTS, MIN_REPEATS = 8, 4
#: A class is valid if it is in order on such a share of its pages.
VALID_SHARE = 0.9
#: Templates are sent to every task up to so many rows, and joined by host beyond.
BROADCAST_ROWS = 50_000

#: HTML's elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br".split())
RAW = frozenset("script style textarea title xmp".split())
HIDDEN = frozenset("audio canvas datalist embed frame frameset head iframe input map noscript object optgroup option script select style svg template textarea title video".split())
LEFT_OUT = frozenset("aside button dialog fieldset footer form label legend menu nav output".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Names of classes, ids and roles of what isn't main text.
NAMES = (
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist contentinfo cookie cookies "
    "consent complementary copyright disqus dialog footer gdpr menu modal nav navbar navigation newsletter notice notices pager pagination "
    "popup promo promoted promotion replies reply respond sidebar side-bar site-header site-footer skip-link sponsor sponsored subscribe subscription"
).split()
#: Names that are no main text outside an article, and names of what is main text only where a page has no other.
HEADERS, BESIDE = "header masthead".split(), "byline-share related search share sharing social toolbar widget widgets".split()


def _name_of(names: list[str]) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{'|'.join(map(re.escape, names))})(?:$|[\s_-])", re.I)


_left_out_name, _header_name, _beside_name = _name_of(NAMES), _name_of(HEADERS), _name_of(BESIDE)
_markup = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)|[^<]+|<", re.S)
#: The rest of a tag; quoted values may hold its end.
_rest_of_tag = re.compile(r"([^>\"']*+(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*+)*+)>", re.S)
_attribute = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_digits = re.compile(r"[\d/]+")
_raw_end = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW}
OPEN, CLOSE, TEXT = 0, 1, 2
_keys: dict[tuple[int, str], int] = {}


def digest(data: str) -> int:
    return int.from_bytes(hashlib.blake2b(data.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def path_key(parent: int, step: str) -> int:
    """A number for the path that leads from ``parent`` over ``step``."""
    found = _keys.get((parent, step))
    if found is None:
        if len(_keys) >= 50_000:
            _keys.clear()
        found = _keys[parent, step] = digest(f"{parent}/{step}")
    return found


class Element:
    """An open element; ``paragraph`` and ``item`` are the places in the stack of what a new block ends."""

    __slots__ = ("beside", "close", "hidden", "item", "key", "main", "out", "paragraph", "tag")

    def __init__(self, parent: Element | None, tag: str, names: str, at: int):
        self.tag = tag
        self.key = path_key(parent.key, f"{tag}.{_digits.sub('#', names)}" if names else tag) if parent else 0
        self.close = ~self.key
        inline = tag in INLINE
        self.paragraph = at if tag == "p" else parent.paragraph if parent and inline else 0
        self.item = at if tag == "li" else parent.item if parent and (inline or tag == "p") else 0
        self.main = parent is not None and (parent.main or tag in ("article", "main"))
        self.hidden = parent is not None and (parent.hidden or tag in HIDDEN)
        named = names != "" and tag not in ("html", "body")
        top = tag == "header" or (named and _header_name.search(names) is not None)
        self.out = parent is not None and (parent.out or tag in LEFT_OUT or (top and not parent.main) or (named and _left_out_name.search(names) is not None))
        self.beside = parent is not None and (parent.beside or (named and _beside_name.search(names) is not None))


def read_page(page: str) -> Iterator[tuple[str, Element, str]]:
    """("open", element, ""), ("close", element, ""), ("text", element, text) and ("break", element, "") in page order.

    Ends that are left out are put in: a paragraph ends before the next block, an element
    with its parent, all with the page. ``out`` marks what HTML says is no main text, ``main``
    what it says is, ``beside`` what is main text only for want of other, ``hidden`` what is not shown as text. Once a quoted value has no end, the
    rest of the page's tags end at their first ``>``; where there is none, ``<`` is text.
    """
    stack = [Element(None, "", "", 0)]
    is_open: Counter = Counter()
    at, quotes, last_end = 0, True, page.rfind(">")

    def cut(to: int) -> Iterator[tuple[str, Element, str]]:
        while len(stack) > to:
            element = stack.pop()
            is_open[element.tag] -= 1
            yield "close", element, ""

    while at < len(page):
        found = _markup.match(page, at)
        tag = found.group(2)
        start, at = at, found.end()
        if tag is None:
            text = found.group()
            if text[0] != "<" or len(text) == 1:
                yield "text", stack[-1], text
            continue
        rest = _rest_of_tag.match(page, at) if quotes and at <= last_end else None
        if rest:
            attributes, at = rest.group(1), rest.end()
        elif at <= last_end:
            quotes, end = False, page.index(">", at)
            attributes, at = page[at:end], end + 1
        else:
            at = start + 1
            yield "text", stack[-1], "<"
            continue
        tag = tag.lower()
        if found.group(1):
            if is_open[tag]:
                to = len(stack) - 1
                while stack[to].tag != tag:
                    to -= 1
                yield from cut(to)
            if tag not in INLINE:
                yield "break", stack[-1], ""
            continue
        if tag in ENDS_PARAGRAPH or tag == "li":
            ended = stack[-1].item if tag == "li" else stack[-1].paragraph
            if ended:
                yield from cut(ended)
        parent = stack[-1]
        names = " ".join(a or b or c for _, a, b, c in _attribute.findall(attributes)) if attributes else ""
        element = Element(parent, tag, names, len(stack))
        yield "open", element, ""
        if tag == "br":
            yield "text", parent, " "
        elif tag not in INLINE:
            yield "break", element, ""
        if tag in RAW:
            end = _raw_end[tag].search(page, at)
            at = end.end() if end else len(page)
            yield "close", element, ""
        elif tag in VOID or attributes.endswith("/"):
            yield "close", element, ""
        else:
            stack.append(element)
            is_open[tag] += 1
    yield from cut(1)


def squeezed(text: str) -> str:
    return " ".join(html.unescape(text).split())


def page_events(page: str) -> tuple[list[int], list[int], int]:
    """A page's tokens and its texts' digests in order, their kinds, and a digest of all texts."""
    ids, kinds, said = [], [], hashlib.blake2b(digest_size=8)
    for kind, element, text in read_page(page):
        if kind == "open":
            ids.append(element.key)
            kinds.append(OPEN)
        elif kind == "close":
            ids.append(element.close)
            kinds.append(CLOSE)
        elif kind == "text" and not element.hidden and (short := squeezed(text)):
            ids.append(digest(short))
            kinds.append(TEXT)
            said.update(ids[-1].to_bytes(8, "little", signed=True))
    return ids, kinds, int.from_bytes(said.digest(), "little", signed=True)


def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``host page_key said ids kinds`` of each page."""
    for batch in batches:
        for own in batch_slices(batch, "html"):
            ids, kinds, said = zip(*map(page_events, own.column("html").to_pylist()), strict=True)
            columns = [own.column("host"), own.column("page_key"), pa.array(said, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(kinds, pa.list_(pa.int8()))]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "page_key", "said", "ids", "kinds"])


def distinct_pages(seen: DataFrame) -> DataFrame:
    """One page, that with the smallest key, for all that say the same on a host."""
    first = seen.groupBy("host", "said").agg(F.min("page_key").alias("page_key")).select("host", "page_key")
    return seen.join(first, ["host", "page_key"], "left_semi").dropDuplicates(["host", "page_key"])


def equivalence_classes(seen: DataFrame) -> DataFrame:
    """Each token's class: tokens of a host whose occurrence vectors are equal.

    ``host token opens pages occurrences vector``; the sums stay in a long up to 2 ** 31 pages.
    """
    tokens = seen.select("host", "page_key", F.explode(F.arrays_zip("ids", "kinds")).alias("event")).filter(F.col("event.kinds") != TEXT)
    counted = tokens.groupBy("host", "page_key", F.col("event.ids").alias("token"), (F.col("event.kinds") == OPEN).alias("opens")).agg(F.count(F.lit(1)).alias("n"))
    held = F.xxhash64("page_key", "n")
    low, high = held.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(held, 32)
    vector = F.struct(F.sum(low).alias("low"), F.sum(high).alias("high")).alias("vector")
    return counted.groupBy("host", "token", "opens").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("occurrences"), vector)


def template_classes(classes: DataFrame, hosts: DataFrame) -> DataFrame:
    """``host token class``: the frame, and classes of two elements or more on at least half of the pages."""
    sizes = classes.groupBy("host", "vector").agg(F.sum(F.col("opens").cast("int")).alias("elements"))
    joined = classes.join(hosts, "host").join(sizes, ["host", "vector"])
    frame = (F.col("pages") == F.col("host_pages")) & (F.col("occurrences") == F.col("pages"))
    nested = (F.col("elements") >= 2) & (F.col("pages") * 2 >= F.col("host_pages"))
    return joined.filter(frame | nested).select("host", "token", F.xxhash64("vector").alias("class"))


def invalid_classes(ids: np.ndarray, of_class: dict[int, int], members: dict[int, int]) -> set[int]:
    """The classes whose tokens are out of order on a page, or whose spans overlap with another's.

    The first round of a class on a page is its order; every further round must repeat it,
    and each round must begin and end within one gap of every class that is around it.
    """
    order: dict[int, list[int]] = {}
    place: Counter = Counter()
    around: list[int] = []  # classes with a round begun, innermost last
    bad: set[int] = set()
    for token in ids:
        kind = of_class.get(token)
        if kind is None or kind in bad:
            continue
        known, size, at = order.setdefault(kind, []), members[kind], place[kind]
        if len(known) < size:
            known.append(token)
        elif known[at] != token:
            bad.add(kind)
        if at == 0:
            around.append(kind)
        while around and around[-1] in bad:
            around.pop()
        if kind not in bad and around[-1] != kind:  # it goes on while another one, begun later, is not over
            bad.add(around.pop())
            while around and around[-1] != kind:
                bad.add(around.pop())
        place[kind] = (at + 1) % size
        if place[kind] == 0 and around and around[-1] == kind:
            around.pop()
    return bad.union(kind for kind in around if place[kind])


def orders_of(ids: np.ndarray, of_class: dict[int, int]) -> dict[int, int]:
    """A digest of the order in which each class's tokens first come on a page."""
    orders: dict[int, list[int]] = {}
    for token in dict.fromkeys(ids):
        if token in of_class:
            orders.setdefault(of_class[token], []).append(token)
    return {kind: digest(repr(tokens)) for kind, tokens in orders.items()}


def check_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``host class order bad`` of each page: how its classes stand on it."""
    for batch in batches:
        hosts, kinds, orders, bads = [], [], [], []
        for host, ids, template in zip(*(batch.column(c).to_pylist() for c in ("host", "ids", "template")), strict=True):
            of_class = {x["token"]: x["class"] for x in template}
            bad = invalid_classes(ids, of_class, Counter(of_class.values()))
            for kind, order in orders_of(ids, of_class).items():
                hosts.append(host)
                kinds.append(kind)
                orders.append(order)
                bads.append(kind in bad)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(kinds, pa.int64()), pa.array(orders, pa.int64()), pa.array(bads, pa.bool_())], names=["host", "class", "order", "bad"])


def slot_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``host slot text`` of each text of a page: the template token that it follows, 0 before the first."""
    for batch in batches:
        hosts, slots, texts = [], [], []
        for host, ids, kinds, template in zip(*(batch.column(c).to_pylist() for c in ("host", "ids", "kinds", "template")), strict=True):
            tokens, slot = {x["token"] for x in template or ()}, 0
            for x, kind in zip(ids, kinds, strict=True):
                if kind == TEXT:
                    hosts.append(host)
                    slots.append(slot)
                    texts.append(x)
                elif x in tokens:
                    slot = x
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(slots, pa.int64()), pa.array(texts, pa.int64())], names=["host", "slot", "text"])


def with_template(pages: DataFrame, template: DataFrame, how: str) -> DataFrame:
    """Each page with its host's rows of ``template`` as one array, bounded by the size of pages.

    Spark sends the templates to every task up to ``BROADCAST_ROWS`` rows; beyond, the join is
    by host, and adaptive execution splits a host with very many pages.
    """
    fields = [c for c in template.columns if c != "host"]
    gathered = template.groupBy("host").agg(F.collect_list(F.struct(*fields)).alias("template"))
    if template.count() <= BROADCAST_ROWS:
        gathered = F.broadcast(gathered)
    return pages.join(gathered, "host", how)


def deduce_templates(seen: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each token of each host's template: ``host slot own``.

    ``own`` tells of the slot after the token: false if it is the template's, null if not.
    """
    hosts = seen.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    candidates = scratch.write(template_classes(equivalence_classes(seen), hosts), "candidate-classes")
    checked = with_template(seen.select("host", "ids"), candidates, "inner").mapInArrow(check_classes, "host string, class long, order long, bad boolean")
    ordered = checked.groupBy("host", "class", "order").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("bad")).alias("fit"))
    valid = ordered.groupBy("host", "class").agg(F.sum("n").alias("n"), F.max("fit").alias("fit")).filter(F.col("fit") >= VALID_SHARE * F.col("n")).select("host", "class")
    template = scratch.write(candidates.join(valid, ["host", "class"], "left_semi").select("host", "token"), "template-tokens")
    texts = with_template(seen, template, "left").mapInArrow(slot_texts, "host string, slot long, text long")
    each = texts.groupBy("host", "slot", "text").agg(F.count(F.lit(1)).alias("n"))
    summed = each.groupBy("host", "slot").agg(F.sum("n").alias("texts"), F.count(F.lit(1)).alias("distinct_texts"))
    repeats = (F.col("texts") >= MIN_TEXTS) & (F.col("texts") >= MIN_REPEATS * F.col("distinct_texts"))
    judged = summed.select("host", "slot", F.when(repeats, F.lit(False)).alias("own"))
    tokens = template.withColumnRenamed("token", "slot").unionByName(hosts.select("host", F.lit(0).cast("long").alias("slot")))
    return tokens.join(judged, ["host", "slot"], "left")


def main_text(page: str, slots: dict[int, bool | None]) -> str:
    """The page's own blocks by its host's slots.

    What HTML calls no main text never comes out. Of the rest the blocks of articles and main elements are
    the text if they have any outside the template; else all blocks outside the template, those of
    names like ``related`` or ``widget`` last. A block is template only if all of it is. A page with
    nothing but template is read without slots.
    """
    blocks: list[tuple[bool, bool, bool, str]] = []
    parts: list[str] = []
    kind_of: tuple[bool, bool, bool] | None = None
    own = slots.get(0)

    def close() -> None:
        nonlocal kind_of
        if kind_of:
            blocks.append((*kind_of, squeezed("".join(parts))))
        parts.clear()
        kind_of = None

    for kind, element, text in read_page(page):
        if kind == "break":
            close()
        elif kind == "text" and not element.hidden and not element.out:
            if text.isspace() or ("&" in text and not squeezed(text)):
                pass  # white space tells nothing
            elif not kind_of:
                kind_of = (element.main, element.beside, own is False)
            elif kind_of[2] and own is not False:
                kind_of = (*kind_of[:2], False)
            parts.append(text)
        elif kind == "open":
            own = slots.get(element.key, own)
        elif kind == "close":
            own = slots.get(element.close, own)
    close()
    for template in (False, True):
        for beside in (False, True):
            found = [(main, text) for main, aside, repeated, text in blocks if repeated <= template and aside <= beside]
            chosen = [text for main, text in found if main] or [text for _, text in found]
            if chosen:
                return "\n\n".join(chosen)
    return ""


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Adds ``text`` and ``n_chars`` to the pages (``url html``), instead of ``html``.

    Blocks are trimmed, with one space for white space inside and an empty line between
    them; character references are decoded. A null ``html`` is an empty page, with an empty
    text; pages with a null or odd ``url`` form one host. Repeated rows get equal texts; an
    input column named like an output, in any case of letters, is replaced, others stay. An
    empty table gives an empty result.
    """
    spark = pages.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "html-text")
    held = Carried(pages, ["url", "html"], ["text", "n_chars"])
    source, host = F.coalesce("html", F.lit("")), url_host(F.col("url"))
    observed = held.df.select(host.alias("host"), F.xxhash64(source).alias("page_key"), source.alias("html"))
    with arrow_batches(spark):
        seen = scratch.write(observed.mapInArrow(observe, "host string, page_key long, said long, ids array<long>, kinds array<byte>"), "page-events")
    single = scratch.write(distinct_pages(seen), "distinct-pages")
    slots = scratch.write(deduce_templates(single, scratch), "slots")
    scratch.drop("page-events", "distinct-pages", "candidate-classes", "template-tokens")
    rest = held.without("html")
    keyed = held.df.select(*[x for x, _ in rest], host.alias("host"), source.alias("html"))
    joined = with_template(keyed, slots, "left").select(*[x for x, _ in rest], "html", "template")
    added = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    schema = T.StructType([*joined.drop("html", "template").schema.fields, *added])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch_slices(batch, "html"):
                sources, templates = own.column("html").to_pylist(), own.column("template").to_pylist()
                texts = [main_text(page, {x["slot"]: x["own"] for x in template or ()}) for page, template in zip(sources, templates, strict=True)]
                yield pa.RecordBatch.from_arrays([*own.columns[:-2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return named(joined.mapInArrow(extract, schema), rest, ["text", "n_chars"])
