"""Main text of pages through wrappers inferred for each host.

A page is read as a tree of block elements with texts. A host's wrapper is a
union-free regular expression over these tokens: a tree of tags, in which a tag
that some pages lack is optional, one that comes more than once under its
parent is a repeated group, and texts are literals or slots. It is made by
iterated alignment (Crescenzi, Mecca, Merialdo, "RoadRunner", 2001): elements
of one page with equal tags under one parent fold into a group, pages and
wrappers are aligned tag by tag, and a text that one side lacks turns from a
literal into a slot. Two wrappers align in time linear in their sizes, in any
order with the same result, so a hot host is folded in parts.

The wrapper decides what is main text. Its slots hold what differs between
pages: the content region is made of the article or main elements if the host
has any, else of the smallest element that holds most of the slots'
characters and their headings. Under it, texts are left out that are under menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles or comments, or
that are literals: the same on every page that has their place, on `EVIDENCE`
different pages or more. A class or id that names such a part is no reason
where the element holds an article, a main element or, comments aside, most of
the host's slots: then it is the page's frame. A page of which literals would
take more than half keeps them (pages of such a host are copies of each other).

Every page takes part in inference: pages are folded inside each partition,
then by (host, salt), then by host. Of a wrapper only its rule is joined to the
host's pages.

Defined cases: a null or empty html gives the empty text; a null or odd url is
a host of its own; rows with null or repeated ids give one row each; an empty
table gives an empty result; other columns are ignored. Elements may be nested
to any depth and attribute values may have any length.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise, small_batches

#: Hosts folded at once in a task.
HOSTS = 5000
#: Different pages on which a text must be the same to be a literal.
EVIDENCE = 4
_SALTS = 16

# Elements of HTML and the words that name what is not main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
ASIDE = frozenset("nav footer aside form script style noscript template head title button select textarea iframe svg menu dialog canvas object audio video".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promoted sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments reply replies discussion disqus respond related recommended widget widgets toolbar pagination pager search skip copyright legal".split()
)
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSED_BY_TWIN = {"li": "ul ol", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select", "p": ""}

COMMENTS = frozenset("comment comments reply replies discussion disqus respond".split())
# Words before a part's name that say that it is not there, or only goes with it.
WITHOUT = frozenset("no not non without with has have hide hidden is".split())

_STOP = re.compile(r">|=\s*+([\"'])")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_LABEL = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the tag that starts at `at` ends, or -1. A quote counts only as an attribute's value, and only if it is closed; last: the last quote of each kind."""
    while found := _STOP.search(page, at):
        quote, at = found[1], found.end()
        if not quote:
            return at - 1
        if at <= last[quote]:
            at = page.find(quote, at) + 1
    return -1


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) with kinds open, close and text; comments, declarations and raw elements are left out."""
    at, n = 0, len(page)
    last = {q: page.rfind(q) for q in "\"'"}
    ends: dict[str, re.Pattern] = {}
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", page[at:]
            return
        if lt > at:
            yield "text", "", page[at:lt]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        named = _NAME.match(page, lt + 1)
        if not named and page[lt + 1 : lt + 2] not in ("!", "?"):
            yield "text", "", "<"
            at = lt + 1
            continue
        end = _tag_end(page, lt, last)
        if end < 0:
            return
        at = end + 1
        if not named:
            continue
        name = named[1].lower()
        if page[lt + 1] == "/":
            yield "close", name, ""
        else:
            yield "open", name, page[lt + 1 + len(name) : end]
            if name in RAW:
                if name not in ends:
                    ends[name] = re.compile(rf"</{re.escape(name)}\s*>", re.I)
                stop = ends[name].search(page, at)
                at = stop.end() if stop else n
                yield "close", name, ""


def _words(rest: str) -> list[str]:
    if "=" not in rest:
        return []
    found = " ".join(a or b or c for a, b, c in _LABEL.findall(rest))
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", found).lower())


def _names_aside(words: list[str]) -> str:
    """What the words of classes and ids say: "c" comments, "s" another part that is not main text, or nothing."""
    kinds = {"c" if w in COMMENTS else "s" for before, w in zip(["", *words], words, strict=False) if w in ASIDE_WORDS and before not in WITHOUT}
    return "c" if "c" in kinds else "s" if kinds else ""


class Page:
    """The tree of a page's block elements. Of element i: parent[i], key[i], soft[i] (aside by its names) and hard[i] (aside by its tag, here or above); texts are (element, text)."""

    def __init__(self, page: str):
        self.parent, self.key, self.soft, self.hard = [-1], [""], [""], [False]
        self.texts: list[tuple[int, str]] = []
        self.stack: list[tuple[str, int]] = []  # open elements: name, its node or that of the block around it
        self.open: dict[str, list[int]] = {}  # places in the stack by name
        self.blocks: list[int] = []  # places in the stack of block elements
        self.text: list[str] = []
        for kind, name, rest in tokens(page):
            if kind == "text":
                self.text.append(_html.unescape(rest))
            elif kind == "close":
                if self.open.get(name):
                    self._close(self.open[name][-1])
            elif name not in VOID:
                self._start(name, rest)
            elif name == "hr":
                self._flush()
            else:
                self.text.append(" " if name == "br" else "")
        self._flush()

    def _node(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def _flush(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            self.text.clear()
            if line:
                self.texts.append((self._node(), line))

    def _close(self, to: int) -> None:
        """Close the open elements from place `to` on."""
        while len(self.stack) > to:
            if self.blocks and self.blocks[-1] == len(self.stack) - 1:
                self._flush()
                self.blocks.pop()
            name, _ = self.stack.pop()
            self.open[name].pop()

    def _start(self, name: str, rest: str) -> None:
        last = lambda of: self.open[of][-1] if self.open.get(of) else -1
        if name in CLOSES_P and self.blocks and self.stack[self.blocks[-1]][0] == "p":
            self._close(self.blocks[-1])
        if name in CLOSED_BY_TWIN and name != "p" and last(name) > max(map(last, CLOSED_BY_TWIN[name].split())):
            self._close(last(name))
        words = _words(rest)
        hard = name in ASIDE or name == "header" and max(last("article"), last("main")) < 0
        soft = "" if name in ("html", "body", "main") else _names_aside(words)
        if name == "article" and soft == "s":
            soft = ""
        node = self._node()
        place = len(self.stack)
        if name not in INLINE or hard or soft:
            self._flush()
            self.parent.append(node)
            self.key.append(f"{name}.{'.'.join(sorted(set(words)))}" if words else name)
            self.soft.append(soft)
            self.hard.append(hard or self.hard[node])
            node = len(self.key) - 1
            self.blocks.append(place)
        self.stack.append((name, node))
        self.open.setdefault(name, []).append(place)


def _hash(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")


# A wrapper is {"n": parts, "p": hashes of different pages, EVIDENCE of them at most}. A part is a list, parents before
# their children: [parent, key, soft, hard, pages, repeated, characters, literals {hash: characters}, hashes of pages].
PARENT, KEY, SOFT, HARD, PAGES, REPEATED, CHARS, LITERALS, SEEN = range(9)


def _some(a: list[int], b: list[int]) -> list[int]:
    return sorted({*a, *b})[:EVIDENCE]


def infer(page: Page) -> dict:
    """The wrapper of one page: equal tags under one parent are one part, all texts are literals."""
    own = _hash(*(t for _, t in page.texts))
    parts: list[list] = []
    at: dict[tuple[int, str], int] = {}
    where: list[int] = []
    for parent, key, soft, hard in zip(page.parent, page.key, page.soft, page.hard, strict=True):
        to = (where[parent] if parent >= 0 else -1, key)
        if to not in at:
            at[to] = len(parts)
            parts.append([to[0], key, soft, hard, 1, False, 0, {}, [own]])
        else:
            parts[at[to]][REPEATED] = True
            parts[at[to]][HARD] &= hard
        where.append(at[to])
    for node, text in page.texts:
        part = parts[where[node]]
        part[CHARS] += len(text)
        part[LITERALS][_hash(text)] = len(text)
    return {"n": parts, "p": [own]}


def align(a: dict, b: dict) -> dict:
    """Two wrappers as one; a is changed. Tags that only one has are optional, texts that one lacks at a place become its slot."""
    parts = a["n"]
    at = {(p[PARENT], p[KEY]): i for i, p in enumerate(parts)}
    where: list[int] = []
    for p in b["n"]:
        to = (where[p[PARENT]] if p[PARENT] >= 0 else -1, p[KEY])
        i = at.get(to)
        if i is None:
            i = at[to] = len(parts)
            parts.append([to[0], *p[1:]])
        else:
            mine = parts[i]
            mine[PAGES] += p[PAGES]
            mine[REPEATED] |= p[REPEATED]
            mine[HARD] &= p[HARD]
            mine[CHARS] += p[CHARS]
            if mine[LITERALS]:
                mine[LITERALS] = {h: n for h, n in mine[LITERALS].items() if h in p[LITERALS]}
            mine[SEEN] = _some(mine[SEEN], p[SEEN])
        where.append(i)
    a["p"] = _some(a["p"], b["p"])
    return a


def rule(wrapper: dict) -> dict:
    """What a wrapper says of its pages: "main" and "frame", paths of the content region and of elements that only seem to be asides, and "literals"."""
    parts = wrapper["n"]
    n = len(parts)
    proven = [len(p[SEEN]) >= EVIDENCE for p in parts]
    # Characters that differ between pages; of a host with too few pages all count.
    slots = [0 if p[HARD] else p[CHARS] - (sum(p[LITERALS].values()) * p[PAGES] if ok else 0) for p, ok in zip(parts, proven, strict=True)]
    if not any(x > 0 for x in slots):
        slots = [0 if p[HARD] else p[CHARS] for p in parts]
    named = [not p[HARD] and not p[SOFT] and re.match(r"(?:article|main)\b|[^.]*.*\.(?:articlebody|main)\b", p[KEY]) is not None for p in parts]

    def below(values: list) -> list:
        out = list(values)
        for i in range(n - 1, 0, -1):
            out[parts[i][PARENT]] += out[i]
        return out

    inside, whole = below([int(x) for x in named]), below(slots)
    frame = [bool(p[SOFT]) and (inside[i] > 0 or p[SOFT] == "s" and 2 * whole[i] > whole[0] > 0) for i, p in enumerate(parts)]
    aside = [False] * n
    for i, p in enumerate(parts):
        aside[i] = bool(p[SOFT]) and not frame[i] or p[PARENT] >= 0 and aside[p[PARENT]]
    whole = below([0 if a else x for x, a in zip(slots, aside, strict=True)])
    parents = [p[PARENT] for p in parts]

    def path(i: int) -> list[str]:
        out = []
        while i > 0:
            out.append(parts[i][KEY])
            i = parents[i]
        return out[::-1]

    # The topmost articles that have slots; else down as long as one element holds most of them.
    under = [False] * n
    main = []
    for i in range(1, n):
        under[i] = under[parents[i]] or named[parents[i]] and whole[parents[i]] > 0
        if named[i] and not under[i] and whole[i] > 0:
            main.append(path(i))
    if not main:
        children: list[list[int]] = [[] for _ in parts]
        for i in range(1, n):
            children[parents[i]].append(i)
        at = 0
        while True:
            best = max(children[at], key=lambda i: whole[i], default=None)
            if best is None or whole[best] <= 0 or whole[best] < 0.6 * whole[at] or not children[best]:
                break
            if any(i != best and whole[i] > 0 and re.match(r"h[1-6]\b", parts[i][KEY]) for i in children[at]):
                break  # a heading beside it belongs to it
            at = best
        main.append(path(at))
    hashes = [0] * n
    for i, p in enumerate(parts):
        hashes[i] = _hash(hashes[p[PARENT]] if i else 0, p[KEY])
    literals = [_hash(hashes[i], h) for i, p in enumerate(parts) if proven[i] for h in p[LITERALS]]
    return {"main": main, "frame": [path(i) for i in range(n) if frame[i]], "literals": literals}


def _trie(paths: list[list[str]]) -> dict:
    root: dict = {}
    for p in paths:
        at = root
        for key in p:
            at = at.setdefault(key, {})
        at[""] = True
    return root


class Rule:
    """A rule made ready for pages."""

    def __init__(self, said: dict):
        self.main, self.frame, self.literals = _trie(said["main"]), _trie(said["frame"]), set(said["literals"])

    def text(self, page: Page) -> str | None:
        """The main text of a page, or None if it has nothing under the region."""
        n = len(page.key)
        main, frame = [self.main] + [None] * (n - 1), [self.frame] + [None] * (n - 1)
        inside, aside, hashes = ["" in self.main] + [False] * (n - 1), [False] * n, [_hash(0, "")] + [0] * (n - 1)
        for i in range(1, n):
            up = page.parent[i]
            main[i] = main[up] and main[up].get(page.key[i])
            frame[i] = frame[up] and frame[up].get(page.key[i])
            inside[i] = inside[up] or bool(main[i]) and "" in main[i]
            aside[i] = aside[up] or page.hard[i] or bool(page.soft[i]) and not (frame[i] and "" in frame[i])
            hashes[i] = _hash(hashes[up], page.key[i])
        found = [(i, t) for i, t in page.texts if inside[i] and not aside[i] and not page.hard[i]]
        if self.literals:
            own = [t for i, t in found if _hash(hashes[i], _hash(t)) not in self.literals]
            if 2 * sum(map(len, own)) >= sum(len(t) for _, t in found):
                return " ".join(own) if found else None
        return " ".join(t for _, t in found) if found else None


def extract(page: str | None, host: Rule | None) -> str:
    """The main text of one page; a page without anything in the host's region is its own wrapper."""
    tree = Page(page or "")
    text = host.text(tree) if host else None
    return text if text is not None else Rule(rule(infer(tree))).text(tree) or ""


def _packed(w: dict) -> str:
    return json.dumps({"p": w["p"], "n": [[*p[:LITERALS], list(p[LITERALS].items()), p[SEEN]] for p in w["n"]]})


def _unpacked(text: str) -> dict:
    w = json.loads(text)
    for p in w["n"]:
        p[LITERALS] = dict(map(tuple, p[LITERALS]))
    return w


def rules(pages: DataFrame) -> DataFrame:
    """(host, rule) of all hosts; the rule as JSON."""
    small_batches(pages.sparkSession)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, dict] = {}
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(map(_packed, held.values())), pa.string())], names=["host", "wrapper"])
        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = infer(Page(page or ""))
                held[host] = align(held[host], own) if host in held else own
            if len(held) > HOSTS:
                yield out()
                held = {}
        yield out()

    def fold(last: bool):
        def run(table: pa.Table) -> pa.Table:
            one = None
            for w in table.column("wrapper"):
                one = align(one, _unpacked(w.as_py())) if one else _unpacked(w.as_py())
            return pa.table({"host": table.column("host")[:1], "wrapper": pa.array([json.dumps(rule(one)) if last else _packed(one)], pa.string())})

        return run

    parts = pages.mapInArrow(local, "host string, wrapper string")
    parts = parts.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(_SALTS)).alias("s")).applyInArrow(fold(False), "host string, wrapper string")
    parts = parts.groupBy("host").applyInArrow(fold(True), "host string, wrapper string")
    return materialise(parts.select("host", F.col("wrapper").alias("rule")), "rules")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) for every row."""
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.coalesce(F.lower(F.regexp_extract(url_col, _HOST, 1)), F.lit("")).alias("host"))
    found = rules(named.select("host", "html")).withColumn("s", F.explode(F.array(*map(F.lit, range(_SALTS)))))
    salted = named.withColumn("s", F.pmod(F.xxhash64("page_id", "url"), F.lit(_SALTS)).cast("int"))
    met = salted.join(found, ["host", "s"], "left").select("page_id", "url", "html", "rule")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, Rule] = {}
        for b in batches:
            texts = []
            for page, said in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if said is not None and said not in ready:
                    if len(ready) > 500:
                        ready.clear()
                    ready[said] = Rule(json.loads(said))
                texts.append(extract(page, ready.get(said)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return met.mapInArrow(run, f"page_id {pages.schema[id_col].dataType.simpleString()}, url string, text string")
