"""Main-text extraction by union-free wrappers inferred for each host from its pages' token streams.

A page's tags become nested lists of items. Same-host lists are aligned one after the other: items on one side only
become optional, items that recur become one repeated group, differing texts become slots, equal ones stay constant
(Crescenzi, Mecca and Merialdo, "RoadRunner", 2001). Slots count the letters that stood in them, and those in links. From
the slots' letters the wrapper says which elements hold the article, which texts are template and which lists are menus;
a class or id name decides only where the slots agree with it."""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import as_text, durable, with_long

#: What HTML says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

#: Elements, roles and class or id words that are not the article.
DROP_TAGS = frozenset("head nav header footer aside form script style noscript template svg iframe button select textarea menu dialog object canvas audio video math title xmp noembed noframes".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer"
    " sidebar aside cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup comment comments disqus reply replies respond"
    " share sharing social related recommended widget form login search toolbar pagination pager skip"
    " banner disclaimer paywall privacy toast announcement copyright".split()
)
WHOLE = frozenset({"html", "body", "main"})
COMMENT_WORDS = frozenset("comment comments reply replies disqus".split())
COMMENT_PARTS = frozenset("area list section thread box wrap wrapper container body content form".split())
MAIN_WORDS = frozenset("content article post entry story articlebody".split())

#: Shares of a host's slot letters. An element named like boilerplate is the article all the same if it holds so much: a
#: name of one word, a name of which one part says so. A mark of the article counts if its elements hold so much.
NAMED, PARTLY_NAMED, MARKED = 0.9, 0.5, 0.1
#: A list outside a marked article is a menu if so much of its letters are links.
LINKED = 0.7

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>|<[!?/][^>]*+>|<(?=[a-zA-Z/!?])[^>]*+\Z", re.S)
ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


def _deep() -> None:
    """Pages nest as deep as they like; the recursions here are plain Python, which keeps its frames on the heap."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1 << 30))


def _constant(text: str) -> str:
    """A text by which it is compared: itself, or if it is long a hash of the whole of it."""
    t = " ".join(text.split())
    return t if len(t) <= 80 else "#" + hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _sig(name: str, attrs: str) -> str:
    """Tag, id, classes and role of an element in one string; digits do not count."""
    if not attrs.strip(" /\n\t"):
        return name
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}
    words = [a.get("id", ""), *a.get("class", "").split(), a.get("itemprop", "")]
    plain = (re.sub(r"[\s_0-9-]+", "-", re.sub(r"([a-z])([A-Z])", r"\1-\2", w)).strip("-").lower() for w in words)
    tail = " ".join(sorted({w for w in plain if w}))
    role = a.get("role", "").lower()
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        role = "hidden"
    return f"{name}|{tail}|{role}" if tail or role else name


def _names(sig: str) -> tuple[str, list[list[str]], str]:
    """(tag, names as lists of their parts, role)."""
    name, _, rest = sig.partition("|")
    tail, _, role = rest.partition("|")
    return name, [w.split("-") for w in tail.split()], role


@lru_cache(1 << 16)
def boilerplate_share(sig: str) -> float:
    """From which share of the slots on an element counts as article: 0 always, 2 never."""
    name, names, role = _names(sig)
    if name in DROP_TAGS and name != "form" or role in DROP_ROLES or role == "hidden":
        return 2.0
    if any(w[0] in COMMENT_WORDS and (len(w) == 1 or w[1] in COMMENT_PARTS) or len(w) > 1 and w[-1] in COMMENT_WORDS and w[0] not in ("no", "has", "with", "allow") for w in names):
        return 2.0
    if name in WHOLE:
        return 0.0
    if name == "form" or name != "article" and any(len(w) == 1 and w[0] in DROP_WORDS for w in names):
        return NAMED
    return PARTLY_NAMED if name != "article" and any(x in DROP_WORDS for w in names for x in w) else 0.0


@lru_cache(1 << 16)
def main_rank(sig: str) -> int:
    """How surely an element holds the article: 3 article, 2 main, 1 by its class, 0 no."""
    name, names, role = _names(sig)
    if name == "article":
        return 3
    if name == "main" or role == "main":
        return 2
    return int(name in ("div", "section", "td") and any(x in MAIN_WORDS for w in names for x in w))


class Element:
    __slots__ = ("sig", "name", "kids")

    def __init__(self, sig: str, name: str):
        self.sig, self.name, self.kids = sig, name, []


def parse(source: str | None) -> Element:
    """The tree of a page: elements and decoded texts. Unclosed and stray tags are repaired as browsers mostly do."""
    top = Element("", "")
    stack, text = [top], source or ""
    signs: dict = {}
    open_: dict[str, int] = {}  # how many elements of a name are open, so that a stray tag does not search the stack
    at, n = 0, len(text)

    def say(t: str) -> None:
        if t:
            stack[-1].kids.append(entities.unescape(t))

    def cut(i: int) -> None:
        for e in stack[i:]:
            open_[e.name] -= 1
        del stack[i:]

    def close_within(names: set, barrier: set) -> None:
        if any(open_.get(x) for x in names):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in barrier:
                    return
                if stack[i].name in names:
                    return cut(i)

    while at < n:
        m = TAG.search(text, at)
        if m is None:
            say(text[at:])
            break
        say(text[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["close"]:
            if open_.get(name):
                i = len(stack) - 1
                while stack[i].name != name:
                    i -= 1
                cut(i)
            continue
        if name in CLOSES_P:
            close_within({"p"}, {"button", "table", "td", "th", "li", "div", "article", "section", "aside", "blockquote"})
        if name in CLOSED_BY:
            close_within(CLOSED_BY[name], BARRIER[name])
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(text, at)
            at = end.end() if end else n
            continue
        raw = (name, m["attrs"])
        if raw not in signs:
            signs[raw] = _sig(*raw)
        e = Element(signs[raw], name)
        stack[-1].kids.append(e)
        if name not in VOID and (not m["attrs"].endswith("/") or name in CLOSES_P):
            stack.append(e)
            open_[name] = open_.get(name, 0) + 1
    return top


# Wrappers: lists of items {"s": signature, "o": optional, "r": repeated, "k": items inside}; "#" is a text with its
# constant "t" or a slot (t None), and how many letters "c" stood there, "l" of them in links; "()" is a repeated group of
# optional items. A list has one group at most, and outside it a signature once.


def _transparent(e: Element) -> bool:
    return e.name in INLINE and boilerplate_share(e.sig) == 0


def to_items(e: Element, link: bool = False) -> list[dict]:
    out = []
    for k in e.kids:
        if isinstance(k, str):
            if t := _constant(k):
                n = len(k)
                out.append({"s": "#", "o": 0, "r": 0, "t": t, "c": n, "l": n if link else 0})
        elif _transparent(k):
            out += to_items(k, link or k.name == "a")
        else:
            out.append({"s": k.sig, "o": 0, "r": 0, "k": to_items(k, link)})
    return fold(out)


def _merge(a: dict, b: dict) -> dict:
    if a["s"] == "#":
        return {"s": "#", "o": a["o"] | b["o"], "r": a["r"] | b["r"], "t": a["t"] if a["t"] == b["t"] else None, "c": a["c"] + b["c"], "l": a["l"] + b["l"]}
    if a["s"] == "()":
        return _grouped([a, b], 0, 1)[0]
    return {"s": a["s"], "o": a["o"] | b["o"], "r": a["r"] | b["r"], "k": align(a["k"], b["k"])}


def fold(items: list[dict]) -> list[dict]:
    """Neighbours of one signature become one repeated item; the range over which signatures recur, one repeated group."""
    out: list[dict] = []
    for x in items:
        if out and out[-1]["s"] == x["s"]:
            out[-1] = _merge(out[-1], x) | {"r": 1}
        else:
            out.append(x)
    last: dict[str, int] = {}
    low, high = len(out), -1
    for i, x in enumerate(out):
        for sig in _members([x]) | {x["s"]}:
            if sig in last:
                low, high = min(low, last[sig]), i
            last.setdefault(sig, i)
    return out if high < 0 else _grouped(out, low, high)


def _grouped(items: list[dict], low: int, high: int) -> list[dict]:
    members: dict[str, dict] = {}  # of a group in a group the members count, so groups stay flat
    for x in items[low : high + 1]:
        for y in x["k"] if x["s"] == "()" else [x]:
            members[y["s"]] = _merge(members[y["s"]], y) if y["s"] in members else y
    return [*items[:low], {"s": "()", "o": 0, "r": 1, "k": [m | {"o": 1} for m in members.values()]}, *items[high + 1 :]]


def _absorb(items: list[dict], sigs: set) -> list[dict]:
    at = [i for i, x in enumerate(items) if x["s"] == "()" or x["s"] in sigs]
    return _grouped(items, at[0], at[-1]) if at else items


def _members(items: list[dict]) -> set:
    return {m["s"] for x in items if x["s"] == "()" for m in x["k"]}


def align(a: list[dict], b: list[dict]) -> list[dict]:
    """One list that generalises both."""
    sigs = _members(a) | _members(b)
    while sigs:
        a, b = _absorb(a, sigs), _absorb(b, sigs)
        more = _members(a) | _members(b)
        if more == sigs:
            break
        sigs = more
    # outside groups a signature stands once in a list, so the longest common sequence is the longest rising run of places
    place = {x["s"]: i for i, x in enumerate(a)}
    tails: list[int] = []
    ends: list[int] = []
    before: dict[int, int | None] = {}
    for j, y in enumerate(b):
        if (i := place.get(y["s"])) is not None:
            k = bisect_left(tails, i)
            before[j] = ends[k - 1] if k else None
            tails[k : k + 1], ends[k : k + 1] = [i], [j]
    both, j = set(), ends[-1] if ends else None
    while j is not None:
        both.add(b[j]["s"])
        j = before[j]
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i]["s"] == b[j]["s"]:
            out.append(_merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif i < len(a) and a[i]["s"] not in both:
            out.append(a[i] | {"o": int(a[i]["s"] != "()")})  # a group's members are optional, so it may be empty as it is
            i += 1
        else:
            out.append(b[j] | {"o": int(b[j]["s"] != "()")})
            j += 1
    return fold(out)


def to_regex(items: list[dict]) -> str:
    """The wrapper as a union-free regular expression over tags, constants and slots (#)."""
    out = []
    for x in items:
        if x["s"] == "#":
            body = "#" if x["t"] is None else re.escape(x["t"])
        elif x["s"] == "()":
            body = to_regex(x["k"])
        else:
            name, _, rest = x["s"].partition("|")
            body = f"<{name}{' ' + rest.strip('|') if rest else ''}>{to_regex(x['k'])}</{name}>"
        tail = ("*" if x["o"] else "+") if x["r"] else "?" if x["o"] else ""
        out.append(f"({body}){tail}" if tail else body)
    return "".join(out)


class Wrapper:
    """Which text of a host's pages is the article: read off the letters that its slots held.

    With enough pages only texts that differ between them are slots; with fewer all texts are."""

    def __init__(self, items: list[dict], pages: int, enough: int = 5):
        self.items, self.template = items, pages >= enough
        held = self._weigh()
        if self.template and not held[""]:  # the pages are all alike: nothing tells template from article
            self.template = False
            held = self._weigh()
        self.shares = {sig: n / max(1, held[""]) for sig, n in held.items()}
        self._dropped: dict[str, bool] = {}
        self.rank = self._rank()

    def _slot(self, x: dict) -> int:
        return x["c"] if x["t"] is None or not self.template else 0

    def _weigh(self) -> dict[str, int]:
        """Slot letters in the outermost elements of each signature, and under "" in all but what is never article."""
        held: dict[str, int] = {}
        open_: dict[str, int] = {}

        def walk(items: list[dict]) -> int:
            total = 0
            for x in items:
                s = x["s"]
                if s == "#":
                    total += self._slot(x)
                elif s == "()":
                    total += walk(x["k"])
                elif boilerplate_share(s) < 2:
                    open_[s] = open_.get(s, 0) + 1
                    n = walk(x["k"])
                    open_[s] -= 1
                    if not open_[s]:
                        held[s] = held.get(s, 0) + n
                    total += n
            return total

        held[""] = walk(self.items)
        return held

    def drops(self, sig: str) -> bool:
        """Whether elements of a signature are not article: always, or while the slots in them do not say otherwise."""
        if sig not in self._dropped:
            least = boilerplate_share(sig)
            self._dropped[sig] = least > 0 and self.shares.get(sig, 0.0) < least
        return self._dropped[sig]

    def _rank(self) -> int:
        """The surest mark of the article whose elements hold their share of the slots; without a template, the surest."""
        held: dict[int, int] = {}

        def walk(items: list[dict], over: frozenset) -> int:
            total = 0
            for x in items:
                if x["s"] == "#":
                    total += self._slot(x)
                elif x["s"] == "()":
                    total += walk(x["k"], over)
                elif not self.drops(x["s"]):
                    r = main_rank(x["s"])
                    n = walk(x["k"], over | {r} if r else over)
                    if r and r not in over:
                        held[r] = held.get(r, 0) + n
                    total += n
            return total

        total = walk(self.items, frozenset())
        return max((r for r, n in held.items() if not self.template or n >= MARKED * total), default=0)

    def text(self, page: Element) -> str:
        roots = self._roots(page) if self.rank else []
        if roots:
            return "\n\n".join(t for r in roots if (t := self._render(r, None)))
        return self._render(page, self.items if self.template else None)

    def _roots(self, page: Element) -> list[Element]:
        """The page's outermost elements of the wrapper's best rank, or of the next one that it has, in page order."""
        found: dict[int, list] = {}
        stack = [(page, frozenset())]
        while stack:
            e, over = stack.pop()
            r = main_rank(e.sig)
            if r and r not in over:
                found.setdefault(r, []).append(e)
            inside = over | {r} if r else over
            stack += [(k, inside) for k in reversed(e.kids) if isinstance(k, Element) and not self.drops(k.sig)]
        top = max((r for r in found if r <= self.rank), default=0)
        return found.get(top, [])

    def _menu(self, item: dict) -> bool:
        """Whether nearly all letters that an element held on the host's pages are links, in several of its places."""
        letters = links = places = 0
        todo = [item["k"]]
        while todo:
            for x in todo.pop():
                if x["s"] == "#":
                    letters, links, places = letters + x["c"], links + x["l"], places + (2 if x["r"] else 1)
                else:
                    places += 2 if x["r"] else 0
                    todo.append(x["k"])
        return letters > 0 and places > 1 and links > LINKED * letters

    def _render(self, top: Element, wrapper: list[dict] | None) -> str:
        """The blocks below top without what is dropped, and, beside a wrapper, without its constant texts and menus."""
        blocks: list[str] = []
        part: list[str] = []

        def flush() -> None:
            if t := " ".join("".join(part).split()):
                blocks.append(t)
            part.clear()

        def walk(e: Element, items: list[dict] | None) -> None:
            known = None
            if items is not None:
                known = {y["s"]: y for x in items for y in (x["k"] if x["s"] == "()" else [x])}
            constant = known["#"]["t"] if known and "#" in known and not known["#"]["r"] else None
            for k in e.kids:
                if isinstance(k, str):
                    if constant is None or _constant(k) != constant:
                        part.append(k)
                elif self.drops(k.sig):
                    if k.name not in INLINE:
                        flush()
                elif _transparent(k):
                    if k.name == "br":
                        part.append(" ")
                    walk(k, items)
                else:
                    flush()
                    inner = known.get(k.sig) if known else None
                    if not (inner and self._menu(inner)):
                        walk(k, inner["k"] if inner else None)
                    flush()

        walk(top, wrapper)
        flush()
        return "\n\n".join(blocks)


def extract_page(source: str | None, wrapper: Wrapper | None = None) -> str:
    _deep()
    page = parse(source)
    return (wrapper or Wrapper(to_items(page), 1)).text(page)


def to_json(items: list[dict]) -> str:
    """A wrapper in page order as a flat list, whatever its depth."""
    rows: list[list] = []

    def walk(items: list[dict], depth: int) -> None:
        for x in items:
            rows.append([depth, x["s"], x["o"], x["r"], *([x["t"], x["c"], x["l"]] if x["s"] == "#" else [])])
            if x["s"] != "#":
                walk(x["k"], depth + 1)

    walk(items, 0)
    return json.dumps(rows)


def from_json(text: str) -> list[dict]:
    lists: list[list] = [[]]
    for depth, sig, optional, repeated, *slot in json.loads(text):
        x = {"s": sig, "o": optional, "r": repeated} | (dict(zip("tcl", slot)) if slot else {"k": []})
        del lists[depth + 1 :]
        lists[depth].append(x)
        if not slot:
            lists.append(x["k"])
    return lists[0]


def _host(url: str) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def infer_wrappers(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", salts: int = 32, held_hosts: int = 2000) -> DataFrame:
    """(host, wrapper as JSON, n_pages) from all pages.

    Each task aligns its own pages per host as they come and hands on one wrapper a host (earlier once it holds
    held_hosts of them); these are aligned in salted groups and then per host. So a host with a third of all pages
    costs each task one wrapper, and a group at most as many as there are tasks by salts."""
    schema = "host string, wrapper string, n_pages long"

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}

        _deep()

        def out() -> pd.DataFrame:
            got = pd.DataFrame([(h, to_json(w), n) for h, (w, n) in held.items()], columns=["host", "wrapper", "n_pages"])
            held.clear()
            return got

        for pdf in batches:
            for host, source in zip(pdf.host, pdf.html):
                items = to_items(parse(source))
                old = held.get(host)
                held[host] = [align(old[0], items), old[1] + 1] if old else [items, 1]
                if len(held) >= held_hosts:
                    yield out()
        yield out()

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        _deep()
        merged = None
        for w in sorted(pdf.wrapper):
            merged = from_json(w) if merged is None else align(merged, from_json(w))
        return pd.DataFrame({"host": [pdf.host.iloc[0]], "wrapper": [to_json(merged)], "n_pages": [int(pdf.n_pages.sum())]})

    parts = pages.select(_host(url_col).alias("host"), F.col(html_col).alias("html")).mapInPandas(fit, schema)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
    return salted.groupBy("host", "salt").applyInPandas(join, schema).groupBy("host").applyInPandas(join, schema)


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", enough: int = 5, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Per row of pages: page_id, url, text (blocks joined by two line ends; empty if none).

    The article is where the host's wrapper has its slots: in article elements, else main, else parts named like content
    (of marks that hold a share of the slots), else in the body; all such elements count, in page order, those of equal
    length too. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left
    out by their tags and roles; by a class or id only if the slots do not hold the article there. Outside a marked
    article, texts that are constant on a host of enough pages and lists of links are template. Null html is an empty
    page; pages without a host share one wrapper; a page is repaired where tags are unclosed, stray or cut off; its
    length, depth and number of elements are not limited. Repeated rows come back repeated; an empty table gives no
    rows; other columns are not read."""
    # written first: short wrappers are broadcast by their measured size, and else both sides of the join are plain
    # exchanges, of which AQE splits a hot host's pages
    wrappers = durable(infer_wrappers(pages, url_col=url_col, html_col=html_col))
    held_bytes = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host") + 16)).first()[0] or 0
    if held_bytes <= broadcast_bytes:
        wrappers = F.broadcast(wrappers)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _deep()
        held: dict = {}
        for pdf in batches:
            texts = []
            for source, w, n in zip(pdf.html, pdf.wrapper, pdf.n_pages):
                key = (w, n)
                if key not in held:
                    if len(held) > 5000:
                        held.clear()
                    held[key] = Wrapper(from_json(w), int(n), enough) if isinstance(w, str) else None
                texts.append(extract_page(source, held[key]))
            yield pd.DataFrame({"page_id": pdf.page_id, "url": pdf.url, "text": texts})

    rows = pages.select(as_text(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), _host(url_col).alias("host"))
    found = rows.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper", "n_pages").mapInPandas(apply, "page_id string, url string, text string")
    return with_long(found, "page_id")
