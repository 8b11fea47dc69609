"""HTML extraction by union-free regular expressions, inferred for each host from its pages."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>|(?P<text>[^<]++|<)",
    re.S | re.I,
)
MARKED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NOT_MARK = re.compile(r"[^a-z0-9:_-]")
#: The same in parts, for pages with tags that don't end: what ends at the next bracket, a tag's head, what decides where it ends.
RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*+>", re.S | re.I)
HEAD = re.compile(r"<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)")
DECIDES = re.compile(r"[>\"']")

# Fixed element and class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead title tr ul caption".split()
)
SPACED = frozenset("br td th img".split())
CLOSED_BY = {"p": BLOCKS - {"body", "html", "head", "title", "option", "caption", "tbody", "tr", "thead", "tfoot", "li"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Elements with nothing to read in them, those of them that a block element ends, and page furniture.
EMPTY = frozenset("svg math select object template noscript iframe canvas video audio".split())
LEFT_BY_BLOCKS, OPTIONS = frozenset("svg math select iframe".split()), frozenset("option title".split())
FURNITURE = frozenset("head nav menu footer aside button dialog title".split()) | EMPTY
#: Of a class, id or role: words that vote; those that only repeats or constant text confirm, as they
#: also name parts of articles; and those that say enough if they stand alone, not in a compound.
FURNITURE_NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer sidebar aside complementary contentinfo "
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal "
    "newsletter subscribe subscription signup login search share sharing social related recommended comment comments disqus replies respond widget toolbar pagination pager skip".split()
)
WEAK_NAMES = frozenset("header masthead topbar banner notice notices alert promotion search login share sharing social menu skip".split())
LABELS = frozenset("ad ads advert adverts advertisement advertising sponsored cookie cookies consent gdpr newsletter comments disqus breadcrumb breadcrumbs navbar pagination".split())
LABEL_ELEMENTS = frozenset("form fieldset".split())
#: Names of what is never content beside some; words that may go with them, and words that turn them into a state of the page.
SURE = frozenset("comments disqus replies respond ads advert adverts advertisement advertising sponsored newsletter cookie cookies consent".split())
SURE_WITH = frozenset(
    "reader readers user users visitor visitors post page article story blog facebook list section area thread wrapper container box block banner slot unit form signup subscribe notice bar popup google text top bottom left right inner outer body the and our ad comment comments".split()
)
SURE_PAIRS = frozenset([("comment", "list"), ("comment", "section"), ("comment", "thread"), ("comment", "form"), ("user", "comment"), ("reader", "comment"), ("related", "posts"), ("related", "articles"), ("related", "stories"), ("related", "work"), ("share", "buttons"), ("ad", "slot"), ("ad", "banner"), ("ad", "unit"), ("ad", "container")])
SURE_ALONE = frozenset("ad share related".split())
EXPLICIT = ("article", "main")
INLINE = frozenset("p br a abbr b cite code em i mark q s small span strong sub sup time u".split())
#: Formatting that is no part of a wrapper unless it has a class, id or role.
FLAT = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements nested deeper are read as text of the one that holds them.
DEEPEST = 150
#: Items of one element from which a wrapper keeps them by mark, without their order.
ORDERED = 64
#: Share of a host's distinct pages on which a constant slot is; wrappers that are aligned in one task, one after another.
NEARLY_ALL, TOGETHER = 0.9, 64


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def tokens(page: str) -> Iterator[tuple[int, str | None, str, str | None, str]]:
    """``start, text, close, name, rest`` of a page's texts and tags; comments and scripts give none of both."""
    for m in TOKEN.finditer(page):
        if m["text"] == "<" and (HEAD.match(page, m.start()) or page[m.end() : m.end() + 1] in ("!", "?")):
            # a tag that doesn't end: to look for the ends of all that follow it would take the square of their number
            yield from _unended(page, m.start())
            return
        yield m.start(), m["text"], m["close"], m["name"], m["rest"] or ""


def _unended(page: str, at: int) -> Iterator[tuple[int, str | None, str, str | None, str]]:
    """As ``tokens`` from a place on, where the end of every tag is known from one pass from right to left."""
    places = [m.start() for m in DECIDES.finditer(page, at)]
    ends, same = [-1] * (len(places) + 1), {'"': -1, "'": -1}
    for i in range(len(places) - 1, -1, -1):
        c = page[places[i]]
        if c == ">":
            ends[i] = places[i]
        else:  # a quoted value: the tag goes on behind the next quote of its kind
            ends[i] = ends[same[c] + 1] if same[c] >= 0 else -1
            same[c] = i
    last = page.rfind(">")
    while at < len(page):
        if page[at] != "<" or at > last:
            end = page.find("<", at) if page[at] != "<" else len(page)
            end = end if end >= 0 else len(page)
            yield at, page[at:end], "", None, ""
            at = end
        elif m := RAW.match(page, at):
            yield at, None, "", None, ""
            at = m.end()
        else:
            m = HEAD.match(page, at)
            end = ends[bisect_left(places, m.end())] if m else -1
            if end < 0:
                yield at, "<", "", None, ""
                at += 1
            else:
                yield at, None, m["close"], m["name"], page[m.end() : end]
                at = end + 1


class Item:
    """A text slot (mark #), an element, or a group of items that repeats (no mark).

    ``stats`` of a slot: the distinct pages that fill it, and the least and greatest hash of what they fill in.
    """

    __slots__ = ("mark", "items", "optional", "repeated", "stats", "moved", "above")

    def __init__(self, mark: str):
        self.mark, self.items, self.optional, self.repeated, self.stats, self.moved, self.above = mark, [], False, False, None, None, None

    def at(self) -> Item:
        """Where this item went when it was folded or aligned."""
        found = self
        while found.moved is not None:
            found = found.moved
        return found

    def inner(self) -> set[str]:
        return {x.mark for x in self.items if x.mark != "#"}


class Run:
    """A run of text: what holds it, and what its surroundings say."""

    __slots__ = ("text", "slot", "chain", "furniture", "named", "explicit")

    def __init__(self, text, slot, chain, furniture, named, explicit):
        self.text, self.slot, self.chain, self.furniture, self.named, self.explicit = text, slot, chain, furniture, named, explicit


def sure(name: str) -> bool:
    """Whether a class, id or role names comments, adverts, forms and the like: by its words, all of which say so or may go with it."""
    words = [w for w in re.split(r"[^a-z0-9]+", name) if w and not w.isdigit()]
    return tuple(words) in SURE_PAIRS or (len(words) == 1 and words[0] in SURE_ALONE) or (any(w in SURE for w in words) and all(w in SURE or w in SURE_WITH for w in words))


def parse(page: str) -> tuple[Item, list]:
    """The tree of a page's elements and text slots, and its text runs and tag names in order.

    An element is furniture by its name, and so is all in it; ``header`` is unless
    inside an article. ``named`` tells the elements around a text whose class, id or
    role has furniture words: for each its item and how much the words say (3 to 0).
    It starts anew inside ``article`` and ``main``, which no name around them discards.
    ``chain`` lists the items around a text, outermost first.
    """
    root = Item("")
    # open elements: name, furniture, named, the explicit element around, and the items that hold their text
    stack: list[tuple] = []
    events: list = []
    chain: tuple = (root,)
    for start, text, close, name, rest in tokens(page):
        if text is not None:
            slot = None
            if not text.isspace() and not (stack and stack[-1][1]):
                items = chain[-1].items
                if not items or items[-1].mark != "#":
                    items.append(Item("#"))
                slot = items[-1]
            top = stack[-1] if stack else ("", False, (), "", chain)
            events.append(Run(text, slot, chain, top[1], top[2], top[3]))
        elif name:
            name = name.lower()
            if close:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
                if depth >= 0 and not (name not in BLOCKS and any(x[0] in BLOCKS for x in stack[depth + 1 :])):
                    del stack[depth:]
                    chain = stack[-1][4] if stack else (root,)
                events.append(name)
                continue
            if name in BLOCKS:
                if name not in OPTIONS:
                    left = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in LEFT_BY_BLOCKS or stack[i][0] in BLOCKS - OPTIONS), -1)
                    if left >= 0 and stack[left][0] in LEFT_BY_BLOCKS:
                        del stack[left:]
                while stack and stack[-1][0] not in BLOCKS | EMPTY | {"td", "th"} and any(x[0] == "p" for x in stack) and name in CLOSED_BY["p"]:
                    stack.pop()
            while stack and name in CLOSED_BY.get(stack[-1][0], ()):
                stack.pop()
            chain = stack[-1][4] if stack else (root,)
            whole = {w for found in MARKED.findall(rest) for w in (found[0] or found[1] or found[2]).lower().split()} if "=" in rest else ()
            words = {w for x in whole for w in re.split(r"[^a-z0-9]+", x) if w}
            _, above, named, explicit = stack[-1][:4] if stack else ("", False, (), "")
            own = name in FURNITURE or (name == "header" and not explicit)
            inner = chain
            if name not in VOID and not (above or own) and (name not in FLAT or words) and len(chain) < DEEPEST:
                item = Item(NOT_MARK.sub("_", name) + "".join(f".{w}" for w in sorted(words)))
                chain[-1].items.append(item)
                inner = (*chain, item)
            if name in EXPLICIT and not explicit:
                named, explicit = (), name
            elif name not in ("html", "body") and (name in LABEL_ELEMENTS or words & FURNITURE_NAMES):
                says = 3 if name == "form" or any(map(sure, whole)) else 2 if name in LABEL_ELEMENTS or any(w in LABELS for w in whole) else int(bool(words & FURNITURE_NAMES - WEAK_NAMES))
                named = (*named, (inner[-1], start, says))
            events.append(name)
            if name not in VOID and not rest.endswith("/"):
                stack.append((name, above or own, named, explicit, inner))
                chain = inner
    return root, events


def like(a: Item, b: Item) -> float:
    """How like two items are in what they hold, from 0 to 1; unlike marks are nothing like."""
    if a.mark != b.mark:
        return -1.0
    x, y = a.inner(), b.inner()
    return len(x & y) / len(x | y) if x or y else 1.0


def add_stats(a: list | None, b: list | None) -> list | None:
    if a is None or b is None:
        return b if a is None else a
    return [a[0] + b[0], min(a[1], b[1]), max(a[2], b[2])]


def merge(a: Item, b: Item) -> Item:
    """b goes into a: repeats and optionals of either stay, what they hold is aligned."""
    a.optional |= b.optional
    a.repeated |= b.repeated
    a.stats = add_stats(a.stats, b.stats)
    a.items = align(a.items, b.items)
    b.moved = a
    return a


def grouped(items: list[Item], others: list[Item]) -> list[Item]:
    """Where ``others`` has a group and ``items`` its items once, these become the group."""
    for group in (x for x in others if not x.mark):
        marks, at = [x.mark for x in group.items], 0
        while at + len(marks) <= len(items):
            if [x.mark for x in items[at : at + len(marks)]] == marks:
                made = Item("")
                made.items, made.repeated = items[at : at + len(marks)], True
                items = [*items[:at], made, *items[at + len(marks) :]]
            at += 1
    return items


def by_mark(items: list[Item]) -> list[Item]:
    """One item of each mark, by first occurrence: what is left of many unlike items."""
    found: dict[str, Item] = {}
    for x in items:
        if x.mark in found:
            merge(found[x.mark], x).repeated = True
        else:
            found[x.mark] = x
            x.optional = True
    return list(found.values())


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """The items of both in one order: a mismatch turns optional what only one of them has.

    The alignment has most likeness of what is matched; of equals, the earliest match.
    """
    if len(a) > ORDERED or len(b) > ORDERED:
        return by_mark([*a, *b])
    a, b = grouped(a, b), grouped(b, a)
    if [x.mark for x in a] == [x.mark for x in b] and len({x.mark for x in a}) == len(a):
        return [merge(x, y) for x, y in zip(a, b, strict=True)]
    n, m = len(a), len(b)
    score = [[1.0 + like(x, y) for y in b] for x in a]
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, own = best[i], best[i + 1], score[i]
        for j in range(m - 1, -1, -1):
            row[j] = max(below[j], row[j + 1], (below[j + 1] + own[j] + 0.5) if own[j] > 0 else 0.0)
    out: list[Item] = []
    i = j = 0
    while i < n and j < m:
        if score[i][j] > 0 and best[i][j] == best[i + 1][j + 1] + score[i][j] + 0.5:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        else:
            lone, i, j = (a[i], i + 1, j) if best[i][j] == best[i + 1][j] else (b[j], i, j + 1)
            lone.optional = True
            out.append(lone)
    for lone in (*a[i:], *b[j:]):
        lone.optional = True
        out.append(lone)
    return out if len(out) <= ORDERED else by_mark(out)


def fold(item: Item) -> None:
    """Repeats among the items of an element, inside out, as one item or group: ``x x x`` becomes ``(x)+``.

    Items repeat if they have the same marks in the same order and hold mostly the same.
    """
    for x in item.items:
        if x.items:
            fold(x)
    out: list[Item] = []
    for x in item.items:
        out.append(x)
        again = True
        while again:
            again = False
            size = len(out)
            if size >= 2 and out[-2].mark == out[-1].mark and like(out[-2], out[-1]) > 0.5:
                merge(out[-2], out.pop()).repeated = True
                again = True
                continue
            last = out[-1].mark
            for n in range(2, size):
                group = out[-n - 1]
                if not group.mark and [g.mark for g in group.items] == [g.mark for g in out[-n:]]:
                    for g, y in zip(group.items, out[-n:], strict=True):
                        merge(g, y)
                    del out[-n:]
                    again = True
                    break
                if 2 * n <= size and out[-n - 1].mark == last and all(like(p, q) > 0.5 for p, q in zip(out[-2 * n : -n], out[-n:], strict=True)) and any(p.mark != "#" for p in out[-n:]):
                    made = Item("")
                    made.items, made.repeated = [merge(p, q) for p, q in zip(out[-2 * n : -n], out[-n:], strict=True)], True
                    out[-2 * n :] = [made]
                    again = True
                    break
    item.items = out if len(out) <= ORDERED else by_mark(out)


def slots_of(item: Item) -> list[Item]:
    """The slots of a wrapper in order, with what is above each item set."""
    found: list[Item] = []
    todo = [item]
    while todo:
        x = todo.pop()
        if x.mark == "#":
            found.append(x)
        for y in x.items:
            y.above = x
        todo += reversed(x.items)
    return found


def written(item: Item) -> str:
    """A wrapper's items as a union-free regular expression: # is a text slot, mark( ) an element."""
    parts = []
    for x in item.items:
        own = "#" if x.mark == "#" else f"{x.mark}({written(x)})"
        parts.append(own + "+" * x.repeated + "?" * x.optional)
    return " ".join(parts)


_SYMBOL = re.compile(r"[a-z0-9.:_-]*\(|#|\)|[+?]")


def read(text: str) -> Item:
    root = Item("")
    open_items, last = [root], root
    for symbol in _SYMBOL.findall(text):
        if symbol == "+":
            last.repeated = True
        elif symbol == "?":
            last.optional = True
        elif symbol == ")":
            last = open_items.pop()
        else:
            last = Item(symbol if symbol == "#" else symbol[:-1])
            open_items[-1].items.append(last)
            if symbol != "#":
                open_items.append(last)
    return root


def skeleton(page: str) -> tuple[str, list[tuple[int, int]], Item, list]:
    """A page's folded expression; (hash, length) of what fills its slots, in order; its tree and events."""
    root, events = parse(page)
    fold(root)
    slots = slots_of(root)
    number = {id(s): i for i, s in enumerate(slots)}
    filled: list[list[str]] = [[] for _ in slots]
    for e in events:
        if type(e) is Run and e.slot is not None:
            filled[number[id(e.slot.at())]].append(e.text)
    texts = [" ".join(html.unescape("".join(parts)).split()) for parts in filled]
    return written(root), [(text_hash(t), len(t)) for t in texts], root, events


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_host, _html) -> of each page its skeleton, the hashes that fill it and a hash of all."""
    for batch in batches:
        rows = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shape, slots, _, _ = skeleton(page or "")
            values = [v for v, _ in slots]
            rows.append((host, text_hash(f"{shape} {values}"), shape, values))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64())))], names=["_host", "_page", "_shape", "_values"])


#: A wrapper, with what the pages of a host fill in: pages, least and greatest hash of each slot in order.
STATE = "_host string, _group long, _n long, _shape string, _stats array<array<long>>"


def load(shape: str, stats: list) -> Item:
    root = read(shape)
    for slot, own in zip(slots_of(root), stats, strict=True):
        slot.stats = own
    return root


def _aligned(fan: int):
    """Rows of STATE in order of host, group and pages -> one row for each group, and the number of its next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, wrapper, pages = None, None, 0

        def done() -> pa.RecordBatch:
            stats = [s.stats for s in slots_of(wrapper)]
            columns = [[key[0]], [key[1] // fan], [pages], [written(wrapper)], [stats]]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in STATE.split(", ")])

        for batch in batches:
            for host, group, n, shape, stats in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = load(shape, stats)
                if (host, group) == key:
                    wrapper.items, pages = align(wrapper.items, own.items), pages + n
                    continue
                if key is not None:
                    yield done()
                key, wrapper, pages = (host, group), own, n
        if key is not None:
            yield done()

    return run


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, pages, wrapper, stats`` from ``url, html``: one union-free expression for each host.

    Pages are cut into elements and text slots, and repeats of them folded, where
    they are read. A host's pages of equal skeleton and text count once. Of equal
    skeletons only sums are left, by host, skeleton and slot, so that a host with a
    third of all pages is no more than its different skeletons. Those are aligned
    iteratively, the most frequent first, TOGETHER in one task, then what comes of
    them, until each host has one wrapper: a mismatch of text is a slot, one of
    elements an optional or a repeated group. A task holds one wrapper, and of it at
    most ORDERED items of an element in their order.
    """
    spark = pages.sparkSession
    rows = pages.select(host_of("url").alias("_host"), F.col("html").alias("_html")).mapInArrow(_survey, "_host string, _page long, _shape string, _values array<long>")
    once = rows.groupBy("_host", "_page").agg(F.min(F.struct("_shape", "_values")).alias("_r")).select("_host", "_r.*")
    # a null stands for the page itself, so that skeletons without a slot count too
    each = once.select("_host", "_shape", F.posexplode(F.concat(F.array(F.lit(None).cast("long")), "_values")).alias("_at", "_value"))
    sums = each.groupBy("_host", "_shape", "_at").agg(F.count("*").alias("_n"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi"))
    whole = sums.groupBy("_host", "_shape").agg(F.array_sort(F.collect_list(F.struct("_at", "_n", "_lo", "_hi"))).alias("_all"))
    stats = F.transform(F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(0))), lambda x: F.array(x["_n"], x["_lo"], x["_hi"]))
    level = whole.select("_host", F.col("_all")[0]["_n"].alias("_n"), "_shape", stats.alias("_stats"))
    counts = level.groupBy("_host").agg(F.ceil(F.count("*") / TOGETHER).alias("_groups")).withColumnRenamed("_host", "_h")
    level = level.join(counts, F.col("_host") == F.col("_h")).select("_host", F.pmod(F.xxhash64("_shape"), F.col("_groups")).alias("_group"), "_n", "_shape", "_stats")
    level = level.persist()
    left = (level.agg(F.max("_group")).first()[0] or 0) + 1
    first = level
    while True:
        dealt = level.repartition(partitions(spark), "_host", "_group").sortWithinPartitions("_host", "_group", F.desc("_n"), "_shape", F.col("_stats").cast("string"))
        level = dealt.mapInArrow(_aligned(TOGETHER), STATE).persist()
        if left == 1:
            break
        left = -(-left // TOGETHER)
    level.count()
    first.unpersist()
    return level.select(F.col("_host").alias("host"), F.col("_n").alias("pages"), F.col("_shape").alias("wrapper"), F.col("_stats").alias("stats"))


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)), F.lit(""))


def constant_slots(wrapper: Item, pages: int) -> set[int]:
    """Of a host's wrapper the slots that nearly all of two or more pages fill with the same text."""
    return {id(s) for s in slots_of(wrapper) if pages > 1 and s.stats and s.stats[1] == s.stats[2] and s.stats[0] >= NEARLY_ALL * pages}


def fixed_slots(shape: str, wrapper: str, stats: list, pages: int) -> frozenset[int]:
    """Which slots of a skeleton match constant slots of its host's wrapper.

    The skeleton is aligned with the wrapper, and its slots are read off where they went.
    """
    host = load(wrapper, stats)
    constant = constant_slots(host, pages)
    if not constant:
        return frozenset()
    page = read(shape)
    slots = slots_of(page)
    host.items = align(host.items, page.items)
    return frozenset(i for i, s in enumerate(slots) if id(s.at()) in constant)


def discarded(runs: list[Run], fixed: set[int]) -> set[tuple]:
    """The named elements that are furniture, of the runs of a page's content.

    Comments, adverts, forms and the like are, whatever share of the text they hold, if
    there is text of the page outside all named elements. Of others, none is that holds half
    or more of the text that varies. Of the rest a label is; else the wrapper has to agree: all text in it is constant over the host, or it holds a
    repeated group of more than paragraphs, or, unless its name is weak, it is outside
    the container that most of the page's text is in.
    """
    if not any(r.named for r in runs):
        return set()
    if all(id(r.slot.at()) in fixed for r in runs):
        fixed = set()
    mass: dict[int, int] = {}
    inside: dict[tuple, list[tuple[Run, int]]] = {}
    total, longest = 0, ()
    for r in runs:
        size = 0 if id(r.slot.at()) in fixed else len(r.text.strip())
        total += size
        for x in r.chain:
            mass[id(x)] = mass.get(id(x), 0) + size
        for element in r.named:
            inside.setdefault(element, []).append((r, size))
    for r in runs:
        core = [x for x in r.chain if 2 * mass[id(x)] > total]
        if len(core) > len(longest):
            longest = core
    while len(longest) > 1 and longest[-1].mark.split(".")[0] in INLINE:
        longest = longest[:-1]
    around = {id(x) for x in longest}
    found = set()
    beside = any(not r.named and id(r.slot.at()) not in fixed for r in runs)
    for element, own in inside.items():
        item, _, says = element
        if says == 3 and beside:
            found.add(element)
            continue
        if 2 * sum(n for _, n in own) >= total > 0:
            continue
        repeats = any(_repeats(r.slot.at(), item.at()) for r, _ in own)
        foreign = says and len(longest) > 1 and id(item) not in around and longest[-1] not in own[0][0].chain[: own[0][0].chain.index(item) + 1]
        if says >= 2 or repeats or foreign or all(id(r.slot.at()) in fixed for r, _ in own):
            found.add(element)
    return found


def _repeats(slot: Item, element: Item) -> bool:
    """If there is a repeated item other than paragraphs between a slot and an element around it."""
    x = slot
    while x is not None and x is not element:
        if x.repeated and x.mark != "#" and x.mark.split(".")[0] not in INLINE:
            return True
        x = x.above
    return False


def extract_text(page: str, fixed_of=None) -> str:
    """The blocks of a page's content, joined by blank lines.

    ``fixed_of`` tells the slots of a skeleton that are constant over its host. A page
    that has text in ``article`` or ``main`` says itself what its content is. Of
    others it is all text in slots that vary, wherever they stand; where none does, as
    on copies under other addresses, it is all text. Text
    of an article stays though every page of the host has it. Names of classes take
    away from both what ``discarded`` tells.
    """
    root, events = parse(page)
    fold(root)
    slots = slots_of(root)
    numbers = fixed_of(written(root)) if fixed_of else frozenset()
    fixed = {id(s) for i, s in enumerate(slots) if i in numbers}
    runs = [e for e in events if type(e) is Run and e.slot is not None]
    explicit = next((name for name in EXPLICIT if any(r.explicit == name for r in runs)), "")
    if explicit:
        runs = [r for r in runs if r.explicit == explicit]
    gone = discarded(runs, fixed)
    firm = set() if explicit else fixed
    kept = [r for r in runs if not (gone and any(x in gone for x in r.named))]
    if all(id(r.slot.at()) in firm for r in kept):
        firm = set()
    kept = {id(r) for r in kept if id(r.slot.at()) not in firm}
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        if text:
            blocks.append(text)
        held.clear()

    for e in events:
        if type(e) is Run:
            if id(e) in kept:
                held.append(html.unescape(e.text))
            elif e.slot is None and not e.furniture and held:
                held.append(" ")
        elif e in BLOCKS:
            flush()
        elif e in SPACED:
            held.append(" ")
    flush()
    return "\n\n".join(blocks)


#: Skeletons whose constant slots a task remembers.
REMEMBERED = 20_000


def _extract(known=None):
    """(page_id, url, html, host[, pages, wrapper, stats]) -> texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[tuple, frozenset] = {}
        for batch in batches:
            htmls, hosts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            rules = None if known else list(zip(*(batch.column(i).to_pylist() for i in (4, 5, 6)), strict=True))
            texts = []
            for i, (page, host) in enumerate(zip(htmls, hosts, strict=True)):
                pages, wrapper, stats = (known.value.get(host) if known else rules[i]) or (0, "", [])

                def fixed_of(shape: str, key=host, rule=(wrapper or "", stats or [], pages or 0)) -> frozenset:
                    if (key, shape) not in memory:
                        if len(memory) >= REMEMBERED:
                            memory.clear()
                        memory[key, shape] = fixed_slots(shape, *rule)
                    return memory[key, shape]

                texts.append(extract_text(page or "", fixed_of))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


#: Most bytes of hosts' wrappers that are broadcast; beyond, pages are joined by host.
RULE_BYTES = 16_000_000


def main_text(pages: DataFrame, rule_bytes: int = RULE_BYTES) -> DataFrame:
    """``page_id, url, text, n_chars`` for each page, by its host's wrapper.

    Each page's skeleton is aligned with the wrapper that ``wrappers`` infers for its
    host, and its text is taken from the slots that vary. Null html is empty and gives an
    empty text, as does a page without content. A null or odd url has the host ''. Pages
    that repeat count once in a wrapper and have each a row. Tags may be unclosed, and
    nested to any depth; pages are read whole, one at a time. Columns beside
    ``page_id, url, html`` aren't looked at. Wrappers are broadcast while their summed
    size, which is computed first, is below ``rule_bytes``; else pages are joined to
    them by host, where AQE splits hot hosts. The texts are the same.
    """
    known = wrappers(pages)
    size = known.select(F.sum(F.length("host") + F.length("wrapper") + 24 * F.size("stats") + 16)).first()[0] or 0
    rows = pages.select("page_id", "url", "html", host_of("url").alias("_host"))
    schema = "page_id long, url string, text string, n_chars long"
    if size <= rule_bytes:
        found = {r["host"]: (r["pages"], r["wrapper"], r["stats"]) for r in known.toLocalIterator()}
        return rows.mapInArrow(_extract(pages.sparkSession.sparkContext.broadcast(found)), schema)
    joined = rows.join(known, rows["_host"] == known["host"], "left").select("page_id", "url", "html", "_host", "pages", "wrapper", "stats")
    return joined.mapInArrow(_extract(), schema)
