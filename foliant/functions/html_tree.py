"""A tolerant tree of XHTML and what is done with it: nodes as rows, selection of text, and bilingual documents.

The tree is built by the standard library's parser with implied end tags; it closes what is left open. Each element gets
its position in document order (pre) and that of its last descendant (last), so ancestry is an interval test.
"""

from __future__ import annotations

import re
from functools import lru_cache
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags whose text is selected, tags under which none is, tags without content, and what closes a paragraph.
TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "figcaption", "dt", "dd", "td", "th")
SKIPPED = ("pre", "code", "script", "style")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dt dd".split())
#: An element on the left ends one on the right that is open in the same parent.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "p": {"body", "div", "td", "th", "li", "section", "blockquote"}}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None
    pre: int
    children: list = field(default_factory=list)
    last: int = 0

    def above(self) -> list[Node]:
        out, n = [], self.parent
        while n is not None and n.tag:
            out.append(n)
            n = n.parent
        return out

    def walk(self) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))


class Tree(HTMLParser):
    def __init__(self, text: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("", {}, None, 0)
        self.count = 0
        self.head = ""
        self.feed(text.removeprefix("﻿"))
        self.close()
        last = self.count
        for n in reversed(list(self.root.walk())):
            inner = [c.last for c in n.children if isinstance(c, Node)]
            n.last = max([n.pre, *inner])
        self.root.last = last

    def _close(self, tags: set[str], scope: set[str]) -> None:
        n = self.open
        while n.tag and n.tag not in scope:
            if n.tag in tags:
                self.open = n.parent
                return
            n = n.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS:
            self._close(ENDS[tag], SCOPES.get(tag, set()))
        elif tag in BLOCKS:
            self._close({"p"}, SCOPES["p"])
        self.count += 1
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open, self.count)
        self.open.children.append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open = self.open.parent

    def handle_endtag(self, tag: str) -> None:
        n = self.open
        while n.tag and n.tag != tag:
            n = n.parent
        if n.tag == tag:
            self.open = n.parent

    def handle_data(self, data: str) -> None:
        self.open.children.append(data)

    def handle_decl(self, decl: str) -> None:
        self.head += f"<!{decl}>"

    def handle_pi(self, data: str) -> None:
        self.head += f"<?{data}>"


def text_of(node: Node) -> str:
    """The trimmed texts below a node, joined by spaces; a line break element is a line break."""
    out: list[str] = []

    def add(n: Node) -> None:
        stack = list(reversed(n.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                if c.strip():
                    out.append(c.strip())
            elif c.tag == "br":
                out.append("\n")
            else:
                stack.extend(reversed(c.children))

    add(node)
    return re.sub(r" ?\n ?", "\n", " ".join(out)).strip()


_SIMPLE = re.compile(r"([A-Za-z][\w-]*|\*)?((?:[.#][\w-]+|\[[\w-]+(?:[~^$*|]?=(?:\"[^\"]*\"|'[^']*'|[^\]\"']*))?\]|:(?:first-child|last-child|only-child|not\([^()]*\)))*)")
_PART = re.compile(r"[.#][\w-]+|\[[^\]]+\]|:[\w-]+(?:\([^()]*\))?")


def matches(node: Node, selector: str) -> bool:
    """Selectors of elements: tag, .class, #id, [attr], [attr=value] (also ~= ^= $= *= |=), :first-child, :last-child,
    :only-child, :not(...); compounds of these, descendants (a b), children (a > b) and lists (a, b).

    One that isn't understood matches nothing, and makes its list match nothing.
    """
    steps = [chain_of(part) for part in re.split(r",(?![^\[]*\])(?![^()]*\))", selector)]
    return all(steps) and any(_chain_matches(node, chain) for chain in steps)


@lru_cache(maxsize=1000)
def chain_of(selector: str) -> tuple[tuple[str, str], ...]:
    """The compounds of a selector from the last to the first, each with what binds it to the next; empty if there is an error."""
    tokens = re.findall(r"\s*>\s*|\s+|(?:[^\s>\[(]|\[[^\]]*\]|\([^()]*\))+", selector.strip())
    out, bind = [], ""
    for t in reversed(tokens):
        if not t.strip() or t.strip() == ">":
            if not out or bind:
                return ()
            bind = t.strip() or " "
        else:
            m = _SIMPLE.fullmatch(t)
            if not m or not t or (out and not bind):
                return ()
            out.append((bind, t))
            bind = ""
    return () if bind else tuple(out)


def _chain_matches(node: Node, chain: tuple[tuple[str, str], ...]) -> bool:
    (_, own), rest = chain[0], chain[1:]
    if not _compound_matches(node, own):
        return False
    if not rest:
        return True
    above = list(node.above())
    bind = rest[0][0]
    candidates = [a for a in above if a.parent is not None or a.tag] if bind == " " else [a for a in above if a is node.parent]
    return any(_chain_matches(a, (("", rest[0][1]), *rest[1:])) for a in candidates)


def _compound_matches(node: Node, compound: str) -> bool:
    m = _SIMPLE.fullmatch(compound)
    if not m:
        return False
    if m.group(1) not in (None, "*") and node.tag != m.group(1).lower():
        return False
    return all(_part_matches(node, part) for part in _PART.findall(m.group(2)))


def _part_matches(node: Node, part: str) -> bool:
    if part[0] == ".":
        return part[1:] in node.attrs.get("class", "").split()
    if part[0] == "#":
        return node.attrs.get("id") == part[1:]
    if part[0] == ":":
        if part.startswith(":not("):
            return not _compound_matches(node, part[5:-1].strip())
        siblings = [c for c in node.parent.children if isinstance(c, Node)] if node.parent is not None else [node]
        return (siblings[0] is node or part == ":last-child") and (siblings[-1] is node or part == ":first-child")
    name, how, value = re.fullmatch(r"\[([\w-]+)(?:([~^$*|]?=)(.*))?\]", part).groups()
    if name not in node.attrs or how is None:
        return name in node.attrs
    have, value = node.attrs[name], value.strip("\"'")
    if not value and how in ("~=", "^=", "$=", "*="):
        return False
    return {"=": have == value, "~=": value in have.split(), "^=": have.startswith(value), "$=": have.endswith(value), "*=": value in have, "|=": have == value or have.startswith(value + "-")}[how]


@dataclass(frozen=True)
class Scope:
    """What is selected: running text, tables, alternative texts, titles; tags and selectors left out."""

    tags: tuple[str, ...] = TAGS
    exclude: tuple[str, ...] = ()
    body: bool = True
    tables: bool = True
    alt_text: bool = True
    metadata: bool = True


def selected(tree: Tree, scope: Scope) -> list[tuple[Node, str | None, str]]:
    """(node, attribute or None, text) in document order: the innermost elements of the scope's tags, and attributes.

    Texts below two code points, elements under SKIPPED tags and all of excluded subtrees are left out.
    """
    out = []
    nodes = list(tree.root.walk())
    skipped = {n.pre for n in nodes if any(a.tag in SKIPPED for a in n.above())}
    banned = {n.pre for n in nodes if any(matches(a, s) for a in (n, *n.above()) for s in scope.exclude)}
    taken = [n for n in nodes if n.tag in scope.tags and n.pre not in skipped]
    inner = sorted(n.pre for n in taken)
    import bisect

    for n in nodes:
        if n.pre in banned:
            continue
        if n.tag in scope.tags and n.pre not in skipped:
            at = bisect.bisect_right(inner, n.pre)
            leaf = at >= len(inner) or inner[at] > n.last
            wanted = scope.tables if n.tag in ("td", "th") else scope.body if n.tag in TAGS else True
            text = text_of(n)
            if leaf and wanted and len(text) >= 2:
                out.append((n, None, text))
        for name, wanted in (("alt", scope.alt_text), ("title", scope.metadata)):
            value = n.attrs.get(name, "").strip()
            if wanted and len(value) >= 2:
                out.append((n, name, value))
    return out


NODES = "tag string, attrs map<string,string>, pre int, last int, ancestors array<string>, text string"
TEXTS = "part int, tag string, attribute string, text string"


def _rows(df: DataFrame, keys: list[str], content: str, schema: str, make) -> DataFrame:
    source = df.select(*keys, F.col(content).alias("__content")).where("__content is not null")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    names = [c.split()[0] for c in re.sub(r"<[^>]*>", "", schema).split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for *key, content in b[[*keys, "__content"]].itertuples(index=False):
                tree = Tree(content if isinstance(content, str) else bytes(content).decode("utf-8", "replace"))
                rows += [(*key, *r) for r in make(tree)]
            yield pd.DataFrame(rows, columns=[*keys, *names])

    return source.mapInPandas(run, f"{kinds}, {schema}")


def nodes(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """keys + (tag, attrs, pre, last, ancestors, text) of every element. Null contents give no rows, empty ones neither."""
    return _rows(df, keys, content, NODES, lambda t: [(n.tag, n.attrs, n.pre, n.last, [a.tag for a in n.above()], text_of(n)) for n in t.root.walk()])


def texts(df: DataFrame, keys: list[str], content: str = "content", scope: Scope = Scope()) -> DataFrame:
    """keys + (part, tag, attribute, text) of what is selected, in document order."""
    return _rows(df, keys, content, TEXTS, lambda t: [(k, n.tag, a, x) for k, (n, a, x) in enumerate(selected(t, scope))])


def render(tree: Tree) -> str:
    def write(n: Node | str) -> str:
        if isinstance(n, str):
            return escape(n, quote=False)
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in n.attrs.items())
        if n.tag in VOID:
            return f"<{n.tag}{attrs}/>"
        inner = "".join(c if isinstance(c, str) and n.tag in ("script", "style") else write(c) for c in n.children)
        return f"<{n.tag}{attrs}>{inner}</{n.tag}>"

    return tree.head + "".join(write(c) for c in tree.root.children)


def bilingual(content: str, answers: dict[int, str], mode: str, source: str, target: str, scope: Scope = Scope(), keep_attrs: bool = True) -> str:
    """The document with the answers to its selected parts put in.

    mode: bilingual (answer before the original), interleaved (after it) or translation_only (in its place). A list item
    keeps both inside; elements get their language; an original language of auto counts as en.
    """
    tree = Tree(content)
    source = "en" if source == "auto" else source
    for k, (n, attribute, _) in enumerate(selected(tree, scope)):
        if k not in answers:
            continue
        if attribute:
            n.attrs[attribute] = answers[k]
            continue
        kept = {a: v for a, v in n.attrs.items() if a not in ("id", "lang")} if keep_attrs else {}
        if n.tag == "li":
            new = Node("p", {"lang": target}, n, 0, [answers[k]])
            if mode == "translation_only":
                n.children = [new]
            else:
                n.children = [new, *n.children] if mode == "bilingual" else [*n.children, new]
                if mode == "bilingual":
                    n.attrs["class"] = (n.attrs.get("class", "") + " bilingual-li").strip()
            continue
        new = Node(n.tag, kept | {"lang": target}, n.parent, 0, [answers[k]])
        siblings = n.parent.children
        at = next(i for i, c in enumerate(siblings) if c is n)
        n.attrs.setdefault("lang", source)
        siblings[at : at + 1] = {"bilingual": [new, n], "interleaved": [n, new]}.get(mode, [new])
    return render(tree)


def bilingual_documents(df: DataFrame, keys: list[str], answer, mode: str, source: str, target: str, content: str = "content", scope: Scope = Scope()) -> DataFrame:
    """keys + (content): each document with `answer` of its selected texts put in. Null contents stay null."""
    rows = df.select(*keys, F.col(content).cast("string").alias("__content"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[keys].copy()
            made = []
            for text in b["__content"]:
                if not isinstance(text, str):
                    made.append(None)
                    continue
                parts = selected(Tree(text), scope)
                made.append(bilingual(text, {k: answer(t) for k, (_, _, t) in enumerate(parts)}, mode, source, target, scope))
            out["content"] = made
            yield out

    return rows.mapInPandas(run, f"{kinds}, content string")


def with_font(html: str, font: str) -> str:
    """A document whose body has a font: a style at the end of the head, or at the start of the document if it has none."""
    style = f"<style>body {{ font-family: {font}; }}</style>"
    if re.search("</head>", html, re.I):
        return re.sub("</head>", lambda m: style + m.group(), html, count=1, flags=re.I)
    return re.sub(r"(<html\b[^>]*>)", lambda m: m.group() + style, html, count=1, flags=re.I)
