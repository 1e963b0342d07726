"""Operator 5: layout-aware text of HTML pages.

A tokenizer splits a page into tags and text; a tree builder puts in the end tags that HTML lets
authors leave out (paragraphs, list items, table cells and rows, definitions, options, and the head, which ends at
the first tag or text that is no head content) and ignores stray ones; a renderer writes all visible text: blocks on lines of their own, a blank line around
paragraphs, headings, lists and tables, items with their bullet or number, indented by nesting, the cells of a table
in aligned columns, ``pre`` as it is.

Not visible: head, script, style, template, noscript, media and form data without text, comments, and elements
with ``hidden`` or an inline ``display:none`` or ``visibility:hidden``. Everything else is,
navigation and footers included.

Defined cases: null and empty pages give the empty text; text without tags is one paragraph; an unfinished tag at the end is
dropped; a quoted value that never closes ends where its tag does. Depth and length are not bounded, and nothing recurses. Pages are treated one by one; other columns stay.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlark.llm.common import table

VOID = frozenset("area base basefont bgsound br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes audio video canvas object svg math datalist".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3"
                  " h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr".split())
ENDS_PARAGRAPH = BLOCK - frozenset("option optgroup legend caption body html tbody thead tfoot tr td th".split())
SCOPE = frozenset("table td th caption html template button object".split())
# What a start tag closes, and where looking for it ends.
IMPLIED = {"li": (frozenset(["li"]), SCOPE | {"ul", "ol", "menu", "dir"}), "dt": (frozenset(["dt", "dd"]), SCOPE | {"dl"}), "dd": (frozenset(["dt", "dd"]), SCOPE | {"dl"}),
           "td": (frozenset(["td", "th", "caption"]), frozenset(["table", "tr"])), "th": (frozenset(["td", "th", "caption"]), frozenset(["table", "tr"])),
           "tr": (frozenset(["tr", "caption"]), frozenset(["table"])), "option": (frozenset(["option"]), frozenset(["select", "optgroup"])),
           "optgroup": (frozenset(["optgroup", "option"]), frozenset(["select"])), "tbody": (frozenset(["tbody", "thead", "tfoot", "caption"]), frozenset(["table"]))}
IMPLIED["thead"] = IMPLIED["tfoot"] = IMPLIED["tbody"]
# An attribute; a quote delimits right after the equals sign only, and only if it is closed.
_ATTR = r"[ \t\n\r\f/]*+([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?>\"([^\"]*+)\"|'([^']*+)'|([^ \t\n\r\f>]*+)))?+"
_ATTRIBUTE = re.compile(_ATTR)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<slash>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<raw>(?:" + _ATTR + r")*+[ \t\n\r\f/]*+)(?P<close>>|\Z)"
                    r"|<(?=[^a-zA-Z/!?]|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)", re.S)
_MAY_HIDE = re.compile("hidden|style", re.I)
# What of a style is no declaration of its own: comments, strings, arguments.
_ASIDE = re.compile(r"/\*.*?(?:\*/|\Z)|\"[^\"]*\"|'[^']*'|\([^)]*\)", re.S)
_DECLARATION = re.compile(r"\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important\s*)?", re.I)
_START = re.compile(r"\s*(-?\d{1,9})")
_BLANK = re.compile(r"[ \t\n\r\f]+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """``("text" | "start" | "end", name or text, attributes)``."""
    at, n = 0, len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        if not found:
            yield "text", page[at:], ""
            return
        if found.start() > at:
            yield "text", page[at:found.start()], ""
        at = found.end()
        if found["name"] is None:
            if found[0] == "<":
                yield "text", "<", ""
            continue
        if not found["close"]:
            return  # the page ends within a tag
        name = found["name"].lower()
        yield ("end" if found["slash"] else "start"), name, found["raw"]
        if not found["slash"] and name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if stop is None:
                yield "text", page[at:], ""
                yield "end", name, ""
                return
            yield "text", page[at:stop.start()], ""
            at = stop.start()


def attributes_of(raw: str) -> dict[str, str]:
    """Values by name in lower case; of attributes of one name the first counts."""
    out: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(double or single or bare))
    return out


def hides(raw: str) -> bool:
    """Whether an element of these attributes is hidden: by ``hidden``, or by its style, of which the last
    declaration counts unless an earlier one is important."""
    if not _MAY_HIDE.search(raw):
        return False
    found = attributes_of(raw)
    if "hidden" in found:
        return True
    style: dict[str, tuple[bool, str]] = {}
    for part in _ASIDE.sub(" ", found.get("style", "")).split(";"):
        if (said := _DECLARATION.fullmatch(part)) and (bool(said[3]) or not style.get(said[1].lower(), (False,))[0]):
            style[said[1].lower()] = bool(said[3]), said[2].lower()
    return ("none" in style.get("display", ())) or ("hidden" in style.get("visibility", ()))


def tree(page: str) -> Iterator[tuple[str, str, str]]:
    """The tokens with every element closed, in order."""
    stack: list[str] = []
    count: Counter[str] = Counter()

    def close_to(depth: int) -> Iterator[tuple[str, str, str]]:
        while len(stack) > depth:
            name = stack.pop()
            count[name] -= 1
            yield "end", name, ""

    def find(names: frozenset, stop: frozenset) -> int | None:
        if not any(count[x] for x in names):
            return None
        for k in range(len(stack) - 1, -1, -1):
            if stack[k] in names:
                return k
            if stack[k] in stop:
                return None
        return None

    def opened(name: str, attributes: str = "") -> tuple[str, str, str]:
        stack.append(name)
        count[name] += 1
        return "start", name, attributes

    for kind, name, attributes in tokens(page):
        if stack[-1:] == ["head"]:
            if kind == "start" and name == "head":
                continue
            if name.strip(" \t\n\r\f") if kind == "text" else name not in HEAD if kind == "start" else name == "br":
                yield from close_to(len(stack) - 1)
        if kind == "text":
            yield kind, name, attributes
        elif kind == "start":
            if name in ENDS_PARAGRAPH and (at := find(frozenset(["p"]), SCOPE)) is not None:
                yield from close_to(at)
            if name in IMPLIED and (at := find(*IMPLIED[name])) is not None:
                yield from close_to(at)
            if name in ("td", "th") and count["table"] and find(frozenset(["tr"]), frozenset(["table"])) is None:
                yield opened("tr")
            if name in VOID:
                yield kind, name, attributes
                yield "end", name, ""
            else:
                yield opened(name, attributes)
        elif name == "br":
            yield "start", "br", ""
            yield "end", "br", ""
        else:
            stop = frozenset(["table"]) if name in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else SCOPE - {name} if name in BLOCK - SCOPE else frozenset()
            if (at := find(frozenset([name]), stop)) is not None:
                yield from close_to(at)
    yield from close_to(0)


class Lines:
    """Text laid out in lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.blank = self.wanted = False  # whether the line ends in a space; whether a blank line is due

    def text(self, value: str) -> None:
        value = _BLANK.sub(" ", value)
        if value[:1] == " " and (self.blank or not self.parts):
            value = value[1:]
        if value:
            self.parts.append(value)
            self.blank = value[-1] == " "

    def flush(self) -> None:
        line = "".join(self.parts).rstrip(" ")
        self.parts, self.blank = [], False
        if line:
            self.add([line])

    def add(self, lines: list[str]) -> None:
        if self.wanted and self.lines:
            self.lines.append("")
        self.wanted = False
        self.lines += lines


def aligned(rows: list[list[list[str]]]) -> list[str]:
    """Rows of cells, each a list of lines, in columns of the width of their widest line."""
    widths: list[int] = []
    for row in rows:
        for k, cell in enumerate(row):
            wide = max(map(len, cell), default=0)
            if k == len(widths):
                widths.append(wide)
            widths[k] = max(widths[k], wide)
    out = []
    for row in rows:
        for line in range(max(map(len, row), default=0)):
            out.append("  ".join((cell[line] if line < len(cell) else "").ljust(widths[k]) for k, cell in enumerate(row)).rstrip())
    return out


def render(page: str | None) -> str:
    """All visible text of a page."""
    boxes = [Lines()]  # where text goes: the page, and within it items, quotes and cells
    tables: list[tuple[list, Lines]] = []  # rows so far, and where the table will stand
    lists: list[list] = []  # kind and next number
    frames: list[tuple[str, object]] = []  # what to do at the end of an open element
    hidden = pre = 0
    for kind, name, attributes in tree(page or ""):
        here = boxes[-1]
        if kind == "text":
            if hidden:
                continue
            value = html.unescape(name).replace(" ", " ")
            if pre:
                first, *others = value.replace("\r\n", "\n").split("\n")
                here.parts.append(first)
                for part in others:
                    here.add(["".join(here.parts)])
                    here.parts = [part]
            else:
                here.text(value)
        elif kind == "start":
            if hidden or name in UNSEEN or (attributes and hides(attributes)):
                hidden += 1
                frames.append((name, "hidden"))
                continue
            todo: object = None
            if name in BLOCK:
                here.flush()
                here.wanted = here.wanted or (name in SPACED and not (name in ("ul", "ol") and lists))
            if name == "br":
                if here.parts:
                    here.flush()
                elif here.lines:
                    here.add([""])
            elif name in ("ul", "ol", "menu", "dir"):
                start = _START.match(attributes_of(attributes).get("start", "")) if name == "ol" else None
                lists.append([name, int(start[1]) if start else 1])
                todo = "list"
            elif name == "li":
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                boxes.append(Lines())
                todo = ("item", mark)
            elif name in ("blockquote", "dd"):
                boxes.append(Lines())
                todo = ("item", "  ")
            elif name == "pre":
                pre += 1
                todo = "pre"
            elif name == "table":
                tables.append(([], here))
                todo = "table"
            elif name == "tr" and tables:
                tables[-1][0].append([])
            elif name in ("td", "th") and tables and tables[-1][0]:
                boxes.append(Lines())
                todo = "cell"
            frames.append((name, todo))
        else:
            _, todo = frames.pop()
            if todo == "hidden":
                hidden -= 1
                continue
            if name in BLOCK:
                here.flush()
            if todo == "list":
                lists.pop()
            elif todo == "pre":
                pre -= 1
            elif todo == "cell":
                tables[-1][0][-1].append(boxes.pop().lines)
            elif todo == "table":
                rows, _ = tables.pop()
                if lines := aligned(rows):
                    here.add(lines)
            elif isinstance(todo, tuple):
                done, mark = boxes.pop(), todo[1]
                if done.lines:
                    pad = " " * len(mark)
                    boxes[-1].add([(mark if k == 0 else pad if line else "") + line for k, line in enumerate(done.lines)])
            if name in BLOCK:
                boxes[-1].wanted = boxes[-1].wanted or (name in SPACED and not (name in ("ul", "ol") and lists))
    boxes[0].flush()
    return "\n".join(boxes[0].lines).strip("\n")


def extract_text(pages: DataFrame, column: str = "html", into: str = "text") -> DataFrame:
    """Adds the visible text of every page."""
    @F.pandas_udf("string")
    def rendered(values: pd.Series) -> pd.Series:
        return values.map(render)

    return pages.withColumn(into, rendered(column))


def op5_html(spark, sf_dir) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))
