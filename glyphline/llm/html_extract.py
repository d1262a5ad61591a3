"""Main text of web pages by equivalence classes of tokens across pages of a host."""

from __future__ import annotations

import functools
import hashlib
import html as entities
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, bounded_batches, materialize, small_side
from .url_filter import url_host

#: Pages of a host that are compared at a time.
BLOCK = 32
#: Fewer pages are too few to tell a template from copies by numbers alone.
FEW = 4
#: Tokens that fewer than one page in so many have, and slots of less than one in so many of the best's text, don't count.
RARE = 20

# a tag ends at the first > outside of quotes; values with a < in them are short, so that marks that are
# never closed cost no more than a look around each
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/><]*+)"
    r"(?P<attrs>(?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+(?=>)|(?:[^>\"'<]|\"[^\"]{0,4096}\"|'[^']{0,4096}'){0,4096}+(?=>)|[^><]*+(?=>))>|</?[a-zA-Z][^<]*\Z",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z][\w-]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_RAW = frozenset("script style textarea title noscript template xmp".split())
#: Elements whose text is never the article's.
_OUT = frozenset("head script style nav footer aside form button select option input textarea label fieldset noscript template iframe object svg canvas audio video dialog menu title xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_BOILER_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in an element's class or id that say it isn't part of the article.
_BOILER = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|adsense|adsby\w*|banner|promo|promotion|sponsor|sponsored|cookie|cookies|consent|gdpr|notice|notices|notification|alert|"
    r"nav|navbar|navigation|menu|menus|sidebar|sidebars|breadcrumb|breadcrumbs|header|masthead|footer|comment|comments|commentlist|disqus|replies|responses|share|sharing|social|related|recommended|"
    r"newsletter|subscribe|subscription|signup|login|search|popup|modal|overlay|widget|widgets|pagination|pager|toolbar|skip|copyright|disclaimer)(?:$|[\s_-])"
)


class Token:
    """A tag or a run of text; role: what makes it the same token on another page."""

    __slots__ = ("kind", "name", "role", "text", "main", "boiler")

    def __init__(self, kind, name="", role="", text="", main="", boiler=False):
        self.kind, self.name, self.role, self.text, self.main, self.boiler = kind, name, role, text, main, boiler


@functools.lru_cache(1 << 16)
def _start(name: str, attrs: str) -> tuple[str, str, bool]:
    """Role of a start tag, whether it is an article or main element, and whether it is left out."""
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(attrs)} if attrs else {}
    labels = [found.get(k, "") for k in ("class", "id", "role")]
    roles = set(labels[2].split())
    main = next((x for x in ("article", "main") if name == x or x in roles), "")
    boiler = name in _OUT or bool(roles & _BOILER_ROLE) or found.get("aria-hidden") == "true" or "hidden" in attrs.lower().split()
    boiler = boiler or (name not in ("html", "body", "article", "main") and any(_BOILER.search(x) for x in labels[:2] if x))
    return f"<{name} {' '.join(labels)}>".replace("   >", ">"), main, boiler


def tokenize(html: str) -> list[Token]:
    """Tags and texts of a page; comments and declarations are left out, raw elements have one text."""
    out, at, n = [], 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            out.append(Token("text", text=html[at:]))
            break
        if m.start() > at:
            out.append(Token("text", text=html[at : m.start()]))
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            out.append(Token("end", name, f"</{name}>"))
            continue
        role, main, boiler = _start(name, m["attrs"]) if len(m["attrs"]) <= 256 else _start.__wrapped__(name, m["attrs"])
        out.append(Token("start", name, role, main=main, boiler=boiler))
        if name in _RAW:
            end = _raw_end(name).search(html, at)
            stop = end.start() if end else n
            out += [Token("raw", name, text=html[at:stop]), Token("end", name, f"</{name}>")]
            at = html.find(">", stop) + 1 or n
    return out


@functools.lru_cache(64)
def _raw_end(name: str):
    return re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I)


def _plain(text: str) -> str:
    return " ".join(entities.unescape(text).split())


@functools.lru_cache(1 << 16)
def _key(role: str) -> int:
    """_hash of what recurs: tags and paths."""
    return _hash(role)


@functools.lru_cache(1 << 12)
def _label(role: str) -> int:
    """Of a division's tag, digits being alike."""
    return _hash(_DIGITS.sub("#", role))


def _hash(role: str) -> int:
    return int.from_bytes(hashlib.blake2b(role.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def page_keys(tokens: list[Token]) -> list[int]:
    """What makes each token the same on another page: 64 bits, odd for texts, 0 for blanks and raw texts.

    A text's key is of its words and of the name of the element that holds it.
    """
    now = Open()
    out = []
    for t in tokens:
        key = 0
        if t.kind == "text":
            words = _plain(t.text)
            if words:
                key = _hash(f"{now.top()[0]}#{words}") | 1
        elif t.kind == "start":
            key = _key(t.role) & ~1 or 2
            now.start(t)
        elif t.kind == "end":
            key = _key(t.role) & ~1 or 2
            now.end(t.name)
        out.append(key)
    return out


def _layouts(pages: list[tuple[int, ...]]) -> list[list[tuple[int, ...]]]:
    """Pages grouped with the first of them, fullest first, of whose tags they have half in common."""
    groups: list[tuple[frozenset, list[tuple[int, ...]]]] = []
    for page in sorted(pages, key=lambda p: (-len(p), p)):
        tags = frozenset(k for k in page if k and not k & 1)
        for first, members in groups:
            if 2 * len(tags & first) >= len(tags | first):
                members.append(page)
                break
        else:
            groups.append((tags, [page]))
    return [members for _, members in groups]


def _rising(places: list[int]) -> list[int]:
    """A longest rising run of places, by patience sorting."""
    tails: list[int] = []
    ends: list[int] = []
    back = []
    for i, at in enumerate(places):
        p = bisect_left(tails, at)
        tails[p : p + 1] = [at]
        ends[p : p + 1] = [i]
        back.append(ends[p - 1] if p else -1)
    keep, i = [], ends[-1] if ends else -1
    while i >= 0:
        keep.append(places[i])
        i = back[i]
    return keep[::-1]


def _agreed(orders: list[list[int]], need: int) -> list[int]:
    """The tokens of the orders in one order, without those that stand elsewhere on too many pages."""
    longest = max(orders, key=len)
    after = dict(zip([0, *longest], [*longest, 0], strict=True))  # 0: the beginning and the end
    for order in orders:
        before = 0
        for k in order:
            if k not in after:
                after[k], after[before] = after[before], k
            before = k
    placed, k = [], after[0]
    while k:
        placed.append(k)
        k = after[k]
    at = {k: i for i, k in enumerate(placed)}
    fits = Counter()
    for order, n in Counter(map(tuple, orders)).items():
        for i in _rising([at[k] for k in order]):
            fits[placed[i]] += n
    return [k for k in placed if fits[k] >= need]


def deduce(pages: list[tuple[int, ...]], sizes: dict[int, int]) -> dict[int, tuple[bool, tuple[int, int]]]:
    """What pages of one layout share: text -> (whether a page has it once, its slot).

    Most pages decide, three of four at least, so that a page of an error or cut short takes
    nothing away. Tokens that occur once on most pages are the template's root, in the order that
    most pages agree on; the stretches between neighbours, named by these two (0: the page's
    edge), are its slots. Texts that most pages have in other numbers are nested if on most pages
    all of their occurrences lie within one and the same slot. Two or three pages of which half of
    the text and more is shared (``sizes`` has the characters of each text) are copies of each
    other and show no template.
    """
    m = len(pages)
    need = m - m // 4
    counts = [Counter(k for k in page if k) for page in pages]
    once, present = Counter(), Counter()
    for c in counts:
        present.update(c.keys())
        once.update(k for k, n in c.items() if n == 1)
    ones = {k for k, n in once.items() if n >= need}
    orders = [[k for k in page if k in ones and c[k] == 1] for page, c in zip(pages, counts, strict=True)]
    root = _agreed(orders, need)
    place = {k: i for i, k in enumerate(root)}
    edges = [0, *root, 0]
    found = {k: (True, (edges[i], edges[i + 2])) for k, i in place.items() if k & 1}
    inner = {k for k, n in present.items() if k & 1 and n >= need and k not in place}
    if inner:
        votes = defaultdict(Counter)
        for page in pages:
            now, where = -1, defaultdict(set)
            for k in page:
                now = place.get(k, now)
                if k in inner:
                    where[k].add(now)
            for k, slots in where.items():
                if len(slots) == 1:
                    votes[k].update(slots)
        for k, seen in votes.items():
            slot, n = max(seen.items(), key=lambda x: (x[1], -x[0]))
            if n >= need:
                found[k] = (False, (edges[slot + 1], edges[slot + 2]))
    if m < FEW:
        for c in counts:
            if 2 * sum(sizes[k] for k in c if k in found) > sum(sizes[k] for k in c if k & 1):
                return {}
    return found


#: Elements whose places in the page are the template's; the text of others belongs to the one around them.
_DIVISIONS = frozenset("div section article main aside nav header footer form td".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Division:
    """A place for text: its path of elements, each with its labels and its number among its like."""

    __slots__ = ("key", "parent", "label", "number", "like", "chars", "links", "parts", "out", "main")

    def __init__(self, parent: Division | None = None, label: int = 0, out: bool = False, main: str = ""):
        self.parent, self.label, self.out, self.main = parent, label, out, main
        self.like: dict[int, int] = {}
        self.number = parent.like.get(label, 0) if parent else 0
        if parent:
            parent.like[label] = self.number + 1
        self.key = _key(f"{parent.key} {label} {self.number}") if parent else 0
        self.chars = self.links = 0
        self.parts: list[str] = []


class Open:
    """The open elements: of each its name, whether it is in the main part, whether left out, its division."""

    def __init__(self, wanted: str = ""):
        self.root = Division()
        self.wanted = wanted
        self.stack: list[tuple[str, bool, bool, Division]] = []
        self.names: dict[str, int] = defaultdict(int)

    def top(self) -> tuple[str, bool, bool, Division]:
        return self.stack[-1] if self.stack else ("", not self.wanted, False, self.root)

    def _cut(self, i: int) -> None:
        while len(self.stack) > i:
            self.names[self.stack.pop()[0]] -= 1

    def start(self, t: Token) -> Division | None:
        """Open an element; its division if it is one."""
        if t.name in _VOID:
            return None
        if t.name == "p" and self.names["p"] > 0:  # a paragraph ends one that is open
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == "p":
                    self._cut(i)
                    break
                if self.stack[i][0] in _BLOCKS:
                    break
        _, main, out, around = self.top()
        boiler = t.boiler or (t.name == "header" and not (main and self.wanted))
        own = Division(around, _label(t.role), out or boiler, t.main) if t.name in _DIVISIONS else around
        self.stack.append((t.name, main or (bool(t.main) and self.wanted in (t.main, "any")), out or boiler, own))
        self.names[t.name] += 1
        return own if own is not around else None

    def end(self, name: str) -> None:
        if self.names[name] <= 0:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                self._cut(i)
                break
            if self.stack[i][0] in ("article", "main", "body") and name not in ("body", "html", "main"):
                break  # a stray end tag doesn't end what it stands in


_DIGITS = re.compile(r"\d+")


def divisions(tokens: list[Token], texts: bool = True) -> list[Division]:
    """A page's divisions with their own text: characters, those in links, and what it says."""
    now = Open()
    out = [now.root]
    for t in tokens:
        if t.kind == "start":
            own = now.start(t)
            if own is not None:
                out.append(own)
        elif t.kind == "end":
            now.end(t.name)
        elif texts and t.kind == "text" and not t.text.isspace():
            d = now.top()[3]
            words = " ".join(t.text.split())
            d.chars += len(words)
            d.parts.append(words)
            if now.names["a"] > 0:
                d.links += len(words)
    return out


def _above(d: Division) -> list[Division]:
    """A division and those around it, inmost first."""
    out = [d]
    while out[-1].parent is not None:
        out.append(out[-1].parent)
    return out


class Template:
    """What a host's pages share.

    texts: text -> (votes, whether a page has it once, its slots). slots: the divisions that hold
    the pages' own text -> rank, the least first. minor: divisions of most pages that hold little.
    """

    def __init__(self, texts: dict[int, tuple[int, bool, list[tuple[int, int]]]], slots: dict[int, int] | None = None, minor: frozenset[int] = frozenset()):
        self.texts, self.slots, self.minor = texts, slots or {}, minor

    def content(self, tokens: list[Token]) -> list[Division]:
        """The divisions that hold the page's article, around the slot of the best rank.

        The article element that the slot is in, whole; without one all slots of the main element
        that it is in; without one the slots beside it: those of its parent, at the top of a page those
        that are labelled as it is and aren't minor. What is within menus, notices and the like is passed over.
        """
        if not self.slots:
            return []
        found = [d for d in divisions(tokens, False) if d.key in self.slots and not d.out]
        best = min(found, key=lambda d: self.slots[d.key], default=None)
        if best is None:
            return []
        above = _above(best)
        for d in above:
            if d.main == "article":
                return [d]
        main = next((d for d in above if d.main), None)
        if main is not None:
            return [d for d in found if main in _above(d)]
        beside = [d for d in found if d.parent is best.parent]
        return beside if len(above) > 2 else [d for d in beside if d.label == best.label and d.key not in self.minor]

    def shared(self, keys: list[int]) -> list[int]:
        """For each token of a page 0, or the votes for its being the template's.

        It is if the page has it once and so does the template, or if it stands in its slot:
        after the token that begins the slot and before the one that ends it, where the page has
        them.
        """
        counts = Counter(keys)
        first: dict[int, int] = {}
        for i, k in enumerate(keys):
            first.setdefault(k, i)
        out = []
        for i, k in enumerate(keys):
            votes, one, slots = self.texts.get(k, (0, False, ())) if k & 1 else (0, False, ())
            if votes and not (one and counts[k] == 1) and not any(first.get(a, -1) < i < first.get(b, len(keys)) for a, b in slots):
                votes = 0
            out.append(votes)
        return out


def _main_part(tokens: list[Token]) -> str:
    """"article" if the page has one outside of menus, notices and the like, else so "main", else ""."""
    now = Open("any")
    parts = set()
    for t in tokens:
        if t.kind == "start":
            now.start(t)
            if t.main and t.name not in _VOID and not now.top()[2]:
                parts.add(t.main)
        elif t.kind == "end":
            now.end(t.name)
    return "article" if "article" in parts else "main" if parts else ""


def extract(tokens: list[Token], template: Template | None = None) -> str:
    """The article's blocks, in page order, joined by line feeds.

    If the template has slots on the page, content is what stands in the divisions around them that
    hold the article (``Template.content``), nested divisions included, and the headings before
    these in the divisions around. Where the page's own text
    stands between its divisions, the slot is the whole page but for the minor divisions. A page
    without such a slot (of a host of too few pages, or of another layout) goes by its structure:
    content is its article or main elements, or all of it if it has none. In either case texts
    within an element that holds menus, notices and the like are left out, and texts that the
    host's pages share are before the first and after the last block of content; those in between
    are the article's, as are all where there is no other, and templates that fewer than ``FEW``
    pages show don't count there. On a whole page shared texts are left out anywhere.
    """
    places = template.content(tokens) if template else []
    wanted = "" if places else _main_part(tokens)  # articles say more than what holds them
    held = {d.key for d in places}
    whole = not wanted and (not places or 0 in held)
    around = {d.key for d in _above(places[0])[1:]} if places else set()
    now = Open(wanted)
    blocks: list[tuple[str, bool]] = []  # text, whether it holds more than the template's texts
    parts: list[str] = []
    own = False
    inside = {id(now.root): 0 in held}  # divisions of the article

    def close():
        nonlocal own
        if parts:
            text = _plain_joined(parts)
            if text:
                blocks.append((text, own))
            parts.clear()
        own = False

    votes = template.shared(page_keys(tokens)) if template and template.texts else [0] * len(tokens)
    kept = []  # so that ids of divisions stay apart
    begun = False
    for t, shared in zip(tokens, votes, strict=True):
        if t.kind == "start":
            if t.name in _BLOCKS:
                close()
            elif t.name == "br":
                parts.append(" ")
            made = now.start(t)
            if made is not None:
                kept.append(made)
                begun = begun or made.key in held
                inside[id(made)] = made.key in held or (inside[id(made.parent)] and not (0 in held and made.key in template.minor))
        elif t.kind == "end":
            if t.name in _BLOCKS:
                close()
            now.end(t.name)
        elif t.kind == "text":
            name, main, out, d = now.top()
            if places:
                main = inside[id(d)] or (not begun and d.key in around and any(now.names[h] > 0 for h in _HEADINGS))
            if main and not out:
                own = own or not (shared >= FEW or t.text.isspace())
                if not whole or not shared:
                    parts.append(t.text)
    close()
    if not whole:
        content_at = [i for i, (_, mine) in enumerate(blocks) if mine]
        if content_at:
            blocks = blocks[content_at[0] : content_at[-1] + 1]
    return "\n".join(text for text, _ in blocks)


def _plain_joined(parts: list[str]) -> str:
    return _plain("".join(parts))


def block_classes(pages: list[tuple[tuple[int, ...], dict[int, int]]]) -> list[tuple[int, int, bool, int, int]]:
    """(text, votes, once, slot's begin, slot's end) of a block's different pages, layout by layout.

    A text has as many votes as its layout has pages here; text 0 counts all of the pages.
    """
    pages = sorted({page: sizes for page, sizes in pages if page}.items(), key=lambda x: x[0])
    sizes = {k: n for _, some in pages for k, n in some.items()}
    out = [(0, len(pages), False, 0, 0)] if pages else []
    for group in _layouts([page for page, _ in pages]):
        if len(group) > 1:
            out += [(k, len(group), one, *slot) for k, (one, slot) in deduce(group, sizes).items()]
    return out


def templates(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(host, texts: key, votes, once, slots) of each host that has a template, from (host, different, html).

    Copies of a page share a block and count once.
    Only keys of tokens are shuffled, 8 bytes each and 4 for a text's size. The classes of a
    host's blocks are joined: votes for a text are added up, and it is the host's if at least
    ``FEW`` pages vote for it, and one in 64 in all, or if the host has no more than
    ``FEW`` - 1 different pages.
    """

    def keys(batches):
        import pyarrow as pa

        seen: set[tuple[str, int]] = set()  # so that copies aren't sent again
        for batch in batches:
            for part in (batch.slice(a, 512) for a in range(0, batch.num_rows, 512)):
                found, sizes, new = [], [], []
                for i, (host, html) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    copy = (host, hash(html))
                    if not html or copy in seen:
                        continue
                    if len(seen) < 1 << 16:
                        seen.add(copy)
                    new.append(i)
                    tokens = tokenize(html)
                    page = page_keys(tokens)
                    found.append([k for k in page if k])
                    sizes.append([len(t.text) for t, k in zip(tokens, page, strict=True) if k & 1])
                part = part.take(pa.array(new, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))], ["host", "b", "keys", "sizes"])

    def classes(batches):
        def stream():
            for batch in batches:
                for a in range(0, batch.num_rows, 512):
                    yield from batch.slice(a, 512).to_pylist()

        for (host, _), group in groupby(stream(), key=lambda r: (r["host"], r["b"])):
            group = ((tuple(r["keys"]), dict(zip((k for k in r["keys"] if k & 1), r["sizes"], strict=True))) for r in group)
            pages: dict[tuple[int, ...], dict[int, int]] = {}
            for page, sizes in group:  # copies count once
                pages.setdefault(page, sizes)
                if len(pages) == 4 * block:
                    yield from made(host, pages)
                    pages = {}
            yield from made(host, pages)

    def made(host, pages):
        import pyarrow as pa

        out = block_classes(list(pages.items()))
        if out:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([host] * len(out), pa.string()), *columns], ["host", "key", "votes", "once", "a", "z"])

    b = F.pmod(F.xxhash64("html"), F.coalesce("different", F.lit(1).cast("long")))
    pages = rows.select("host", b.alias("b"), "html").mapInArrow(keys, "host string, b long, keys array<long>, sizes array<int>")
    pages = pages.repartition("host", "b").sortWithinPartitions("host", "b")
    found = pages.mapInArrow(classes, "host string, key long, votes long, once boolean, a long, z long")
    found = found.groupBy("host", "key").agg(F.sum("votes").alias("votes"), (2 * F.sum(F.when(F.col("once"), F.col("votes")).otherwise(0)) > F.sum("votes")).alias("once"), F.collect_set(F.struct("a", "z")).alias("slots"))
    found = materialize(found, "classes")
    total = found.where("key = 0").select("host", F.col("votes").alias("pages"))
    found = found.where("key <> 0").join(total, "host").where((F.col("pages") < FEW) | ((F.col("votes") >= FEW) & (F.col("votes") * 64 >= F.col("pages"))))
    return found.groupBy("host").agg(F.collect_list(F.struct("key", "votes", "once", "slots")).alias("texts"))


def slots(rows: DataFrame) -> DataFrame:
    """(host, slots: key, rank, and minor: keys) of each host, from (host, html): where its pages differ.

    Divisions are the tokens that are compared: a division's path of elements, with their labels and
    numbers, is the same token on every page that has it. Tokens of a host that the same pages have
    (of equal sums of the pages' hashes) are one equivalence class; a class is valid if two pages and
    one in ``RARE`` have it, and is nested in the class of the division around it. A valid token's slot
    holds its own text, which is its text outside of nested divisions, if it is not the same on three
    pages of four. Divisions that are alike and stand around in varying numbers, so that a quarter of
    their text is in those that not even three pages of four have, are no tokens of their own: their
    text belongs to the division around them. Slots are ranked by their class's
    text, then by their own, without links; those of a ``RARE``-th of the host's best are kept (the text
    of others is the article's where an article element or a kept slot holds it).
    Divisions of three pages of four that hold less than a fifth of it are minor, on hosts of ``FEW`` pages and more.

    One row of 68 bytes for each division and page is shuffled, all else is counted before it is;
    copies of a page count once.
    """

    def run(batches):
        import pyarrow as pa

        seen: set[tuple[str, int]] = set()  # so that copies aren't sent again
        kinds = [pa.string(), *[pa.int64()] * 4, pa.int32(), *[pa.int64()] * 3]
        for batch in batches:
            for part in (batch.slice(a, 256) for a in range(0, batch.num_rows, 256)):
                out = []
                for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    page = _hash(html) if html else 0
                    if not html or (host, page) in seen:
                        continue
                    if len(seen) < 1 << 16:
                        seen.add((host, page))
                    for d in divisions(tokenize(html)):
                        parent = d.parent.key if d.parent else -1
                        out.append((host, d.key, page, parent, d.label, d.number, _hash("\n".join(d.parts)) if d.parts else 0, d.chars, d.links))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = ["host", "key", "page", "parent", "label", "number", "text", "chars", "links"]
    found = rows.select("host", "html").mapInArrow(run, "host string, key long, page long, parent long, label long, number int, text long, chars long, links long")
    more = ["parent", "label", "number"]
    found = found.groupBy("host", "key", "page").agg(*[F.max(c).alias(c) for c in (*more, "text", "chars", "links")])
    sums = [F.sum(c).alias(c) for c in ("chars", "links")]
    mark = F.sum(F.pmod(F.col("page"), F.lit((1 << 31) - 1)))
    found = found.groupBy("host", "key", "text").agg(F.count("*").alias("n"), mark.alias("mark"), *[F.max(c).alias(c) for c in more], *sums)
    found = found.groupBy("host", "key").agg(F.sum("n").alias("pages"), F.max("n").alias("same"), F.sum("mark").alias("mark"), *[F.max(c).alias(c) for c in more], *sums)
    found = materialize(found, "divisions")
    total = found.where("key = 0").select("host", F.col("pages").alias("total"))
    valid = found.join(total, "host").where(f"pages >= 2 and pages * {RARE} >= total")
    own = F.when(F.col("same") * 4 < F.col("pages") * 3, F.col("chars") - F.col("links")).otherwise(0)
    valid = valid.withColumn("own", own)
    most = valid.where("key <> 0").groupBy("host", "parent", "label").agg(F.max("number").alias("last"), F.max("pages").alias("most"))
    like = valid.where("key <> 0").join(most.where("last > 0"), ["host", "parent", "label"])
    seldom = F.sum(F.when(F.col("pages") * 4 < F.col("most") * 3, F.col("own")).otherwise(0))
    like = like.groupBy("host", "parent", "label").agg(F.sum("own").alias("given"), seldom.alias("seldom"))
    like = materialize(like.where("seldom * 4 > given").drop("seldom"), "alike")
    given = like.groupBy("host", F.col("parent").alias("key")).agg(F.sum("given").alias("given"))
    tokens = valid.join(like.select("host", "parent", "label"), ["host", "parent", "label"], "left_anti")
    tokens = tokens.join(given, ["host", "key"], "left").withColumn("own", F.col("own") + F.coalesce("given", F.lit(0)))
    tokens = materialize(tokens.select("host", "key", "mark", "pages", "total", "own"), "tokens")
    classes = tokens.groupBy("host", "mark", "pages").agg(F.sum("own").alias("text"))
    best = tokens.groupBy("host").agg(F.max("own").alias("best"))
    ranked = tokens.join(classes, ["host", "mark", "pages"]).join(best, "host")
    is_slot = (F.col("own") > 0) & (F.col("own") * RARE >= F.col("best"))
    is_minor = (F.col("total") >= FEW) & (F.col("pages") * 4 >= F.col("total") * 3) & (F.col("own") * 5 < F.col("best"))
    order = F.struct((-F.col("text")).alias("t"), (-F.col("own")).alias("o"), "key")
    ranked = ranked.groupBy("host").agg(F.array_sort(F.collect_list(F.when(is_slot, order))).alias("slots"), F.collect_list(F.when(is_minor, F.col("key"))).alias("minor"))
    return ranked.select("host", F.col("slots.key").alias("slots"), "minor").where("size(slots) > 0")


def _template(row) -> Template:
    """The template of a row with texts, slots and minor, any of which may be null."""
    texts = {t["key"]: (t["votes"], t["once"], [(s["a"], s["z"]) for s in t["slots"]]) for t in row["texts"] or ()}
    return Template(texts, {k: i for i, k in enumerate(row["slots"] or ())}, frozenset(row["minor"] or ()))


def extract_text(pages: DataFrame, block: int = BLOCK, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page.

    Pages of a host are compared in blocks of about ``block``: a large host is dealt over as many
    blocks as it needs by the hash of its pages, so that no task gets a host of a third of all
    pages, and all pages of a host take part. The blocks' classes are joined over the host, and
    its one template is applied to all of its pages. The html is read three times; it is shuffled only
    if the templates are too many to broadcast.

    Character references are decoded, white space within a block of text is one space, blocks are
    joined by a line feed in page order. Null and empty html give an empty text; a null url counts
    as one host, ''; a host of one page has no template, nor a host of two or three that are mostly
    copies one of texts; there the pages' structure decides. Repeated rows are kept. Broken markup is
    read as far as it goes. An empty table gives an empty result. Other columns aren't used.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.coalesce(url_host(F.col(url_col)), F.lit("")).alias("host"))
    sizes = rows.groupBy("host", F.xxhash64("html").alias("page")).count()
    sizes = sizes.groupBy("host").agg(F.ceil(F.sum("count") / block).cast("long").alias("blocks"), F.ceil(F.count("*") / block).cast("long").alias("different"))
    large = materialize(sizes.where("blocks > 1"), "hosts")
    rows = rows.join(small_side(large, 256), "host", "left")
    known = templates(rows, block).join(slots(rows), "host", "full")
    known = materialize(known, "templates")
    kind = rows.schema["page_id"].dataType.simpleString()
    b = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("blocks", F.lit(1).cast("long")))
    rows = rows.select("page_id", "url", "html", "host", b.alias("b"))
    sizes = [F.coalesce(n * F.size(c), F.lit(0)) for n, c in ((64, "texts"), (16, "slots"), (16, "minor"))]
    few = known.select(F.sum(F.lit(96) + sizes[0] + sizes[1] + sizes[2])).first()[0] or 0
    shared = None
    if few <= BROADCAST_BYTES // 4:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: _template(r) for r in known.collect()})
    else:  # each block gets its host's template, first of its rows
        texts = known.join(large, "host", "left").select("host", F.struct("texts", "slots", "minor").alias("texts"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1).cast("long")) - 1)).alias("b"))
        rows = rows.withColumn("first", F.lit(1)).unionByName(texts.withColumn("first", F.lit(0)), allowMissingColumns=True)
        rows = rows.repartition("host", "b").sortWithinPartitions("host", "b", "first").select("page_id", "url", "html", "host", "texts")

    def run(batches):
        import pyarrow as pa

        now = (None, None)
        for batch in batches:
            for part in (batch.slice(a, 128) for a in range(0, batch.num_rows, 128)):
                htmls, hosts = part.column(2).to_pylist(), part.column(3).to_pylist()
                given = part.column(4).to_pylist() if shared is None else [None] * len(hosts)
                keep, texts = [], []
                for i, (html, host, own) in enumerate(zip(htmls, hosts, given, strict=True)):
                    if own is not None:
                        now = (host, _template(own))
                        continue
                    template = shared.value.get(host) if shared is not None else now[1] if now[0] == host else None
                    keep.append(i)
                    texts.append(extract(tokenize(html or ""), template))
                part = part.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if shared is not None:
        rows = rows.select("page_id", "url", "html", "host")
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
