"""Main text of web pages by wrapper inference: union-free regular expressions per host.

A page is a stream of tags and texts.  The pages of a host are aligned one after the other with
the host's wrapper, element by element from the root: an element that some page lacks becomes an
optional group, one that occurs again a repeated group, elements seen in either order one repeated
group of options, and a text that differs becomes a slot.  What stays equal is the host's template.

The wrapper is kept as what the alignment has found so far for every place (the path of elements):
how often the element occurs and in how many parents, what it follows, and the texts that all pages
with this place share.  Two such wrappers merge by sums, maxima, unions and intersections, so the
wrapper does not depend on the order of pages, and tasks hand on one row per host.

A page is read by matching it with its host's wrapper: slots are text; texts of the template go, and
so do repeated groups of links outside of the content element.  What the wrapper cannot know (that
a `nav`, a form or an advert is no article) is told by tags and by names made of such words alone.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import byte_slices, map_arrow, materialize, read_table

#: A table of hosts up to this many rows is broadcast; beyond, it is joined by shuffle.
BROADCAST_HOSTS = 200_000
#: Places of wrappers that a task holds before it hands them on.
HELD_PLACES = 200_000
#: Rows of one host that meet first; their results then meet per host.
SALTS = 64
#: Different contents that a text must stand in to be template, where a host has as many, and the
#: share of the host's pages that must have its place.
VERSIONS, SUPPORT = 3, 0.25
#: Links that a group repeats on average to be a menu.
MENU_ITEMS = 3

# Kinds of HTML elements, and names that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "xmp", "noembed", "noframes")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
CONTAINERS = frozenset("html body div main article section center table tbody tr td".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split())
DROPPED_TAGS = frozenset("nav header footer aside form menu button select dialog script style noscript template svg iframe head title textarea object video audio canvas xmp noembed noframes".split())
UNNAMED_TAGS = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus reply replies respond".split())
SITE_NAMES = frozenset("area bar bottom container fixed global inner main outer page primary secondary site sticky top wrap wrapper".split())
LAYOUT_NAMES = SITE_NAMES | frozenset("block body box boxes button center col column group holder item items layer left link links list module panel region right row section slot space unit units zone".split())
EDGE_NAMES = frozenset("header masthead footer foot".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay sidebar sidenav widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs "
    "header masthead topbar footer foot comment comments commentlist disqus reply replies respond share sharing social related recommended "
    "newsletter subscribe subscription login signup search form pagination pager skip toolbar copyright".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def stream(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(kind, tag, marks, text): kind "open", "close" or "text"; marks are the words of class
    and id, and the role, of an opening tag.  Comments and the content of raw elements go."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", "", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", "", page[at : m.start()]
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            yield "close", tag, "", ""
            continue
        marks = "\n".join(f"{k.lower()}={' '.join((a or b or c).split())}" for k, a, b, c in _ATTRIBUTE.findall(m[3])) if "=" in m[3] else ""
        yield "open", tag, marks, ""
        if m[3].endswith("/") and tag in RAW and tag == "svg":
            yield "close", tag, "", ""
        elif tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            yield "close", tag, "", ""


def named(value: str) -> str | None:
    """The word that makes a class or id one of a menu, notice, advert and so on: all its words say
    so or speak of layout (`ad-box`, `siteHeader`), and one of the former is given back.  A name
    with any other word (`entry-header`, `share-price`) says nothing, and headers and footers are
    those of the whole page (`page-footer`, not `section-header`)."""
    words = [w.lower() for w in _NAME.findall(value)]
    telling = [w for w in words if w in DROPPED_NAMES]
    layout = SITE_NAMES if any(w in EDGE_NAMES for w in telling) else LAYOUT_NAMES
    return telling[0] if telling and all(w in DROPPED_NAMES or w in layout for w in words) else None


def dropped(tag: str, marks: str) -> str | None:
    """Why an element is no part of an article: "tag" (or role), "comment", "name", or None."""
    if tag in DROPPED_TAGS:
        return "tag"
    if not marks or tag in UNNAMED_TAGS:
        return None
    why = None
    for part in marks.split("\n"):
        kind, _, value = part.partition("=")
        if kind == "role":
            if value.strip().lower() in DROPPED_ROLES:
                return "tag"
            continue
        for word in value.split():
            if (found := named(word)) is not None:
                if found in COMMENT_NAMES:
                    return "comment"
                why = "name"
    return why


def elements(page: str) -> Iterator[tuple[str, str, str]]:
    """The stream with end tags made explicit: (event, tag, marks or text).  Void elements stay closed, a block start closes an open
    paragraph, list and table parts close their like, an end tag closes what it matches."""
    open_tags: list[str] = []

    def close(k: int) -> Iterator:
        while len(open_tags) > k:
            yield "close", open_tags.pop(), ""

    def find(tags: set | frozenset, stop: frozenset) -> int:
        for i in range(len(open_tags) - 1, -1, -1):
            if open_tags[i] in tags:
                return i
            if open_tags[i] in stop:
                return -1
        return -1

    for kind, tag, marks, text in stream(page):
        if kind == "text":
            yield "text", "", text
        elif kind == "open":
            if tag in CLOSES_P and (k := find({"p"}, frozenset(("table", "td", "th", "li", "article", "body")))) >= 0:
                yield from close(k)
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                like = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}}.get(tag, {tag})
                if (k := find(like, frozenset(("ul", "ol", "dl", "table", "select")) | ({"tr"} if tag in ("td", "th") else set()))) >= 0:
                    yield from close(k)
            yield "open", tag, marks
            if tag not in VOID:
                open_tags.append(tag)
            else:
                yield "close", tag, ""
        elif (k := find({tag}, frozenset())) >= 0:
            yield from close(k)
    yield from close(0)


def key_of(tag: str, marks: str) -> str:
    """What makes elements alike: the tag and the class words, less those with digits, which count
    or are generated."""
    words = {w for part in marks.split("\n") if part.startswith("class=") for w in part[6:].split() if not any(c.isdigit() for c in w)}
    return " ".join([tag, *sorted(words)]) if words else tag


def number(*parts: object) -> int:
    """64 bits that stand for some values."""
    return int.from_bytes(blake2b("\n".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Reading:
    """A page read once: `blocks` of (place, text, linked characters) in page order, and, with
    `align`, what a wrapper takes from it.  A place is the number of a path of element keys."""

    ROOT = 0

    def __init__(self, page: str, menus: frozenset = frozenset(), align: bool = False):
        self.blocks: list[tuple[int, str, int]] = []
        self.keys: dict[int, tuple[int, str]] = {}
        self.met: dict[int, list[int]] = {}
        self.follows: set[tuple[int, int]] = set()
        self._ids: dict[tuple[int, str], int] = {}
        self._read(page, menus, align)

    def _place(self, parent: int, key: str) -> int:
        if (found := self._ids.get((parent, key))) is None:
            found = self._ids[parent, key] = number(parent, key)
            self.keys[found] = parent, key
        return found

    def _read(self, page: str, menus: frozenset, align: bool) -> None:
        held: list[str] = []
        linked = links = 0
        path = [self.ROOT]  # places of the open block elements
        opened: list[tuple[bool, object]] = []  # per open element: whether it is a block, and its doubt
        families: list[tuple[Counter, list]] = [(Counter(), [None])]  # per open block: children met, the last one
        shut = 0  # open elements that are dropped for sure
        doubts: list[dict] = []  # open elements dropped by name: an article inside redeems them
        raised: list[tuple[tuple, int, str, int]] = []

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                raised.append((tuple(doubts), path[-1], text, min(linked, len(text))))
            linked = 0

        def leave(children: Counter) -> None:
            for place, n in children.items():
                own = self.met.setdefault(place, [0, 0, 0])
                own[0] += n
                own[1] += 1
                own[2] = max(own[2], n)

        for event, tag, value in elements(page):
            if event == "text":
                if not shut:
                    text = entities.unescape(value)
                    held.append(text)
                    linked += len(text.strip()) * (links > 0)
            elif tag == "br":
                if event == "open" and not shut:
                    held.append(" ")
            elif tag in VOID:
                if tag not in INLINE and not shut and event == "open":
                    flush()
            elif event == "open":
                if shut:
                    shut += 1
                    continue
                why = dropped(tag, value)
                block = tag not in INLINE
                if block or why is not None:
                    flush()
                if block:
                    place = self._place(path[-1], key_of(tag, value))
                    if align:
                        children, last = families[-1]
                        children[place] += 1
                        if last[0] is not None:
                            self.follows.add((last[0], place))
                        last[0] = place
                    if place in menus:
                        why = "tag"
                if why == "tag":
                    shut = 1
                    continue
                if tag in ("article", "main"):
                    for d in doubts:
                        d["redeemed"] |= d["why"] == "name"
                doubt = {"why": why, "redeemed": False} if why is not None else None
                if doubt is not None:
                    doubts.append(doubt)
                opened.append((block, doubt))
                links += tag == "a"
                if block:
                    path.append(place)
                    families.append((Counter(), [None]))
            elif shut > 1:
                shut -= 1
            elif shut:
                shut = 0
            elif opened:
                block, doubt = opened.pop()
                links -= tag == "a"
                if block or doubt is not None:
                    flush()
                if doubt is not None:
                    doubts.pop()
                if block:
                    path.pop()
                    leave(families.pop()[0])
        flush()
        while families:
            leave(families.pop()[0])
        self.blocks = [(place, text, n) for why, place, text, n in raised if all(d["redeemed"] for d in why)]


@dataclass(slots=True)
class Place:
    """What a wrapper knows of one path of elements."""

    parent: int
    key: str
    count: int = 0  # occurrences
    parents: int = 0  # parents that have it
    most: int = 0  # most in one parent
    pages: int = 0  # pages with text of its own
    blocks: int = 0  # texts, characters, characters in links
    chars: int = 0
    linked: int = 0
    versions: set = field(default_factory=set)  # contents of those pages, `VERSIONS` at most
    texts: Counter | None = None  # number of a text -> how often all those pages have it

    def merge(self, other: Place) -> None:
        self.count, self.parents, self.most = self.count + other.count, self.parents + other.parents, max(self.most, other.most)
        self.pages, self.blocks = self.pages + other.pages, self.blocks + other.blocks
        self.chars, self.linked = self.chars + other.chars, self.linked + other.linked
        self.versions = least(self.versions, other.versions)
        self.texts = other.texts if self.texts is None else self.texts if other.texts is None else self.texts & other.texts


def least(a: set, b: set) -> set:
    return set(sorted(a | b)[:VERSIONS])


class Wrapper:
    """What the pages of a host aligned so far have in common: `places` by number, and `follows`,
    the pairs of places seen one after the other.  Pages without text do not count."""

    def __init__(self) -> None:
        self.pages, self.most, self.versions = 0, 0, set()
        self.places = {Reading.ROOT: Place(Reading.ROOT, "")}
        self.follows: set[tuple[int, int]] = set()

    @classmethod
    def of(cls, page: str) -> Wrapper | None:
        read = Reading(page, align=True)
        if not read.blocks:
            return None
        own, content = cls(), number(*(text for _, text, _ in read.blocks))
        own.pages, own.most, own.versions, own.follows = 1, len(read.blocks), {content}, read.follows
        own.places[Reading.ROOT].count = 1
        for place, (parent, key) in read.keys.items():
            own.places[place] = Place(parent, key, *read.met.get(place, (0, 0, 0)))
        for place, text, linked in read.blocks:
            at = own.places[place]
            at.pages, at.versions, at.blocks = 1, {content}, at.blocks + 1
            at.chars, at.linked = at.chars + len(text), at.linked + linked
            at.texts = at.texts if at.texts is not None else Counter()
            at.texts[number(place, text)] += 1
        return own

    def merge(self, other: Wrapper) -> None:
        self.pages, self.most = self.pages + other.pages, max(self.most, other.most)
        self.versions = least(self.versions, other.versions)
        self.follows |= other.follows
        for place, theirs in other.places.items():
            if place in self.places:
                self.places[place].merge(theirs)
            else:
                self.places[place] = theirs

    def template(self) -> list[int]:
        """Numbers of the texts that are the host's own: all pages that have the place have them.
        Copies of one page tell nothing, nor do contents that differ in a small part alone, which
        may be versions of one article."""
        n = len(self.versions)
        if n < 2:
            return []
        found: list[int] = []
        for at in self.places.values():
            if at.texts and len(at.versions) >= min(VERSIONS, n) and at.pages >= SUPPORT * self.pages:
                found += at.texts.elements()
        return sorted(found) if len(found) * (2 if n == 2 else 4 / 3) <= self.most else []

    def below(self) -> dict[int, list[int]]:
        """Places by parent."""
        out: dict[int, list[int]] = {}
        for place, at in self.places.items():
            if place != Reading.ROOT:
                out.setdefault(at.parent, []).append(place)
        return out

    def menus(self) -> list[int]:
        """Places whose text is all in links, with an element inside that repeats `MENU_ITEMS` times
        or more on average, outside of the content element: the deepest single element with elements
        in it and half of all text.  A place with more than half of the text is no menu."""
        below = self.below()
        order = [Reading.ROOT]
        for place in order:
            order += below.get(place, ())
        chars, linked, items = {}, {}, {}
        for place in reversed(order):
            at, inside = self.places[place], below.get(place, ())
            chars[place] = at.chars + sum(chars[c] for c in inside)
            linked[place] = at.linked + sum(linked[c] for c in inside)
            items[place] = max((max(items[c], self.places[c].count) for c in inside), default=0)
        total, content, chain = chars[Reading.ROOT], Reading.ROOT, {Reading.ROOT}
        while deeper := [c for c in below.get(content, ()) if c in below and 2 * chars[c] >= total and self.places[c].most == 1]:
            content = min(deeper)
            chain.add(content)
        found, left = [], [Reading.ROOT]
        while left:
            place = left.pop()
            if place not in chain and 0 < chars[place] == linked[place] and 2 * chars[place] <= total and items[place] >= MENU_ITEMS * self.places[place].count:
                found.append(place)
            elif place != content:
                left += below.get(place, ())
        return sorted(found)

    def expression(self) -> str:
        """The wrapper in writing: `( )?` an optional, `( )+` a repeated, `( )*` an optional repeated
        group, `#` a text slot, `=` texts of the template alone."""
        below, template = self.below(), set(self.template())
        after: dict[int, set[int]] = {}
        for a, b in self.follows:
            after.setdefault(a, set()).add(b)

        def reached(place: int) -> set[int]:
            seen: set[int] = set()
            todo = list(after.get(place, ()))
            while todo:
                if (x := todo.pop()) not in seen:
                    seen.add(x)
                    todo += after.get(x, ())
            return seen

        def groups(parent: int) -> list[list[int]]:
            """Children in order; those that are seen in either order are one group."""
            left = sorted(below.get(parent, ()), key=lambda c: (self.places[c].key, c))
            reach, out = {c: reached(c) for c in left}, []
            while left:
                first = next(c for c in left if not any(c in reach[x] and x not in reach[c] for x in left))
                out.append([c for c in left if c == first or (c in reach[first] and first in reach[c])])
                left = [c for c in left if c not in out[-1]]
            return out

        out: list[str] = []
        todo: list[int | str] = [Reading.ROOT]
        while todo:
            if isinstance(item := todo.pop(), str):
                out.append(item)
                continue
            at, inner = self.places[item], []
            if at.texts is not None:
                inner.append("=" if at.texts and set(at.texts) <= template and at.texts.total() * at.pages == at.blocks else "#")
            for own in groups(item):
                together = len(own) > 1
                inner += ["("] * together
                for c in own:
                    optional, again = together or self.places[c].parents < at.count, not together and self.places[c].most > 1
                    mark = ("", "?", "+", "*")[optional + 2 * again]
                    inner += ["(", c, f"){mark}"] if mark else [c]
                inner += [")+"] * together
            todo += reversed([f"<{at.key}>", *inner, f"</{at.key.split(' ')[0]}>"] if at.key else inner)
        return " ".join(out)

    def dump(self) -> str:
        rows = [(p, at.parent, at.key, at.count, at.parents, at.most, at.pages, at.blocks, at.chars, at.linked, sorted(at.versions), None if at.texts is None else sorted(at.texts.items())) for p, at in self.places.items()]
        return json.dumps([self.pages, self.most, sorted(self.versions), sorted(self.follows), rows])

    @classmethod
    def load(cls, text: str) -> Wrapper:
        own = cls()
        own.pages, own.most, versions, follows, rows = json.loads(text)
        own.versions, own.follows = set(versions), {(a, b) for a, b in follows}
        own.places = {p: Place(*at, set(versions), None if texts is None else Counter(dict(texts))) for p, *at, versions, texts in rows}
        return own


def infer(pages: list[str]) -> Wrapper | None:
    """The wrapper of some pages; None if none of them has text."""
    wrapper = None
    for page in pages:
        if (own := Wrapper.of(page)) is not None:
            if wrapper is None:
                wrapper = own
            else:
                wrapper.merge(own)
    return wrapper


_HOST = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def with_host(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host; a url without a host has the empty one."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), _HOST, 1))
    return pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"), host.alias("host"))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, constants, menus, expression: the wrapper of each host of `with_host` rows that has
    texts, from every page.

    A task folds its pages into one wrapper per host; the tasks' wrappers meet in two rounds, one
    at a time, so a host with many pages is no large group anywhere.  A wrapper's size is that of
    the different element paths of its host."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([w.dump() for w in held.values()], pa.string())], names=["host", "wrapper"])

        places = 0
        for batch in batches:
            for part in byte_slices(batch, "html"):
                for host, page in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    if (own := Wrapper.of(page.as_py())) is None:
                        continue
                    if host in held:
                        places -= len(held[host].places)
                        held[host].merge(own)
                    else:
                        held[host] = own
                    places += len(held[host].places)
                    if places >= HELD_PLACES:
                        yield rows()
                        held.clear()
                        places = 0
        yield rows()

    def folding(final: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, None

            def row() -> pa.RecordBatch:
                if not final:
                    return pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([held.dump()], pa.string())], names=["host", "wrapper"])
                lists = [pa.array([v], pa.list_(pa.int64())) for v in (held.template(), held.menus())]
                return pa.RecordBatch.from_arrays([pa.array([at], pa.string()), *lists, pa.array([held.expression()], pa.string())], names=["host", "constants", "menus", "expression"])

            for batch in batches:
                for key, host, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                    own, key = Wrapper.load(text.as_py()), (key.as_py(), host.as_py())
                    if held is not None and key == current:
                        held.merge(own)
                        continue
                    if held is not None:
                        yield row()
                    current, at, held = key, host.as_py(), own
            if held is not None:
                yield row()

        return run

    def sorted_by(rows: DataFrame, salt) -> DataFrame:
        return rows.select(salt.cast("long").alias("salt"), "host", "wrapper").repartition("salt", "host").sortWithinPartitions("salt", "host")

    parts = map_arrow(pages.select("host", "html"), per_task, "host string, wrapper string")
    met = map_arrow(sorted_by(parts, F.pmod(F.spark_partition_id(), F.lit(SALTS))), folding(False), "host string, wrapper string")
    return map_arrow(sorted_by(met, F.lit(0)), folding(True), "host string, constants array<long>, menus array<long>, expression string")


def extract_page(page: str, constants: list[int] | None = None, menus: list[int] | None = None) -> str:
    """Main text of one page, matched with its host's wrapper: the blocks that are neither the
    template's nor in its menus, in page order."""
    left = Counter(constants or ())
    texts = []
    for place, text, _ in Reading(page, frozenset(menus or ())).blocks:
        if left and left[m := number(place, text)] > 0:
            left[m] -= 1
        else:
            texts.append(text)
    return "\n\n".join(texts)


def extract(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per input row.

    Defined results: a null or empty html, or one without text, gives the empty text; a null or
    odd url shares the wrapper of the empty host; repeated rows are extracted each; an empty
    table gives an empty table; other columns are not read.  Pages are read whole, one at a
    time; unclosed elements end where HTML ends them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "html"):
                texts = [extract_page(*(v.as_py() for v in row)) for row in zip(*(part.column(k) for k in (2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    ship(pages.sparkSession)
    hosts = wrappers.where((F.size("constants") > 0) | (F.size("menus") > 0)).select("host", "constants", "menus")
    side = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    return map_arrow(pages.join(side, "host", "left").select("page_id", "url", "html", "constants", "menus"), run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    pages = with_host(read_table(spark, sf_dir, "pages"))
    return extract(pages, materialize(infer_wrappers(pages), "wrappers"))
