"""Elements of a page as an array of intervals, and selectors over it.

``with_elements`` parses each page once, where it is read, into

    dom STRUCT<text ARRAY<STRING>,
               elements ARRAY<STRUCT<pos, tag, until, start, end, classes, attrs>>,
               index MAP<STRING, ARRAY<INT>>>

Elements stand in document order.  ``pos`` counts them, the descendants of an
element are those with ``pos`` between its own and ``until``; its text is
the characters ``start`` to ``end`` of the page's text, which stands in ``text`` in
pieces of equal length.  Nested text, containers and descendants are
thus interval tests inside one row.  ``index`` has the elements of each tag, class
(``.name``) and attribute (``[name``), so that a step of a selector looks at those
that it may match and not at the whole page.

Selectors are data, not code: ``parse_selector`` turns a text into steps (tag,
id, classes, attribute tests, joined by descendant combinators, with an optional
``@attribute``), and the functions below take arrays of them as columns, so that
they may differ from row to row.  Child and sibling combinators, groups and
pseudo classes are not read: such selectors match nothing.

A page that lists a whole shop has millions of elements; as a row of structs they
are many times its markup.  ``scan`` keeps them in flat arrays, and ``places``,
``linked``, ``first_link`` and ``texts`` apply the same selectors where the page is
parsed, so that only what they find becomes a row.
"""

from __future__ import annotations

import html as entities
import io
import json
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import WHITESPACE_CLASS, let, normalize_whitespace

# Elements without content, elements whose content is plain text,
# and elements that end where the next of a kind begins.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
PLAIN_TEXT = frozenset(("script", "style", "title", "textarea"))
UNSEEN_TEXT = frozenset(("script", "style"))
ENDED_BY = {"li": ("li",), "option": ("option",), "tr": ("tr",), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"),
            "dt": ("dt", "dd"), "dd": ("dt", "dd"), "p": ("p", "div", "ul", "ol", "table", "section", "h1", "h2", "h3")}

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in PLAIN_TEXT}

PIECE_BITS = 8
PIECE = 1 << PIECE_BITS  # characters of a page's text that are stored together

ELEMENT = ("struct<pos:int,tag:string,until:int,start:int,end:int,classes:array<string>,attrs:map<string,string>>")
DOM = f"struct<text:array<string>,elements:array<{ELEMENT}>,index:map<string,array<int>>>"
STEP = "struct<key:string,tag:string,id:string,classes:array<string>,attrs:array<struct<name:string,op:string,value:string>>>"
SELECTORS = f"array<struct<attr:string,steps:array<{STEP}>>>"

_ARROW_ELEMENT = pa.struct([("pos", pa.int32()), ("tag", pa.string()), ("until", pa.int32()), ("start", pa.int32()),
                            ("end", pa.int32()), ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string()))])
_ARROW_DOM = pa.struct([("text", pa.list_(pa.string())), ("elements", pa.list_(_ARROW_ELEMENT)),
                        ("index", pa.map_(pa.string(), pa.list_(pa.int32())))])


#: Attribute texts of up to so many characters are remembered, the last so many of them.
SHORT_MARKUP, MOST_REMEMBERED = 256, 4096


def _keys(classes: Iterable[str], names: Iterable[str]) -> list[str]:
    """Entries of the index for an element's classes and attributes."""
    return [*[f".{c}" for c in dict.fromkeys(classes)], *[f"[{name}" for name in names]]


def _read_attributes(rest: str) -> tuple[dict[str, str], list[str], list[str]]:
    attrs: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(rest):
        value = double or single or bare
        attrs.setdefault(name.lower(), entities.unescape(value) if "&" in value else value)
    classes = attrs["class"].split() if "class" in attrs else []
    return attrs, classes, _keys(classes, attrs)


_remembered = lru_cache(MOST_REMEMBERED)(_read_attributes)


def _attributes(rest: str) -> tuple[dict[str, str], list[str], list[str]]:
    """Attributes, classes and index entries in the markup of a tag; not to be changed."""
    return _remembered(rest) if len(rest) <= SHORT_MARKUP else _read_attributes(rest)


class Page:
    """A parsed page: its text, and its elements in document order, one flat array for
    each of their values.  Attributes stay in the markup, between ``first`` and ``last``."""

    __slots__ = ("html", "text", "tags", "until", "start", "end", "first", "last", "index")

    def __init__(self, html: str):
        self.html, self.text = html, ""
        self.tags: list[str] = []
        self.until, self.start, self.end, self.first, self.last = (array("i") for _ in range(5))
        self.index: dict[str, array] = {}

    def attributes(self, pos: int) -> tuple[dict[str, str], list[str], list[str]]:
        return _attributes(self.html[self.first[pos]:self.last[pos]])


def scan(html: str | None) -> Page:
    """The text and the elements of a page in one pass over its markup."""
    html = html or ""
    page = Page(html)
    tags, until, start, ends, index = page.tags, page.until, page.start, page.end, page.index
    names: dict[str, str] = {}
    written = io.StringIO()
    open_: list[int] = []
    length = at = 0

    def text(piece: str) -> None:
        nonlocal length
        if piece:
            plain = entities.unescape(piece) if "&" in piece else piece
            written.write(plain)
            length += len(plain)

    def close(n: int) -> None:
        while len(open_) > n:
            pos = open_.pop()
            until[pos], ends[pos] = len(tags), length

    while found := _MARKUP.search(html, at):
        text(html[at:found.start()])
        at = found.end()
        end, tag, rest = found.groups()
        if tag is None:
            continue
        tag = names.setdefault(tag := tag.lower(), tag)
        if end:
            for n in range(len(open_) - 1, -1, -1):
                if tags[open_[n]] == tag:
                    close(n)
                    break
            continue
        while open_ and tag in ENDED_BY.get(tags[open_[-1]], ()):
            close(len(open_) - 1)
        pos = len(tags)
        tags.append(tag)
        until.append(pos + 1)
        start.append(length)
        ends.append(length)
        page.first.append(found.start(3))
        page.last.append(found.end(3))
        for key in (tag, *_attributes(rest)[2]):
            if key in index:
                index[key].append(pos)
            else:
                index[key] = array("i", (pos,))
        if tag in PLAIN_TEXT:
            stop = _END[tag].search(html, at)
            content, at = (html[at:stop.start()], stop.end()) if stop else (html[at:], len(html))
            if tag not in UNSEEN_TEXT:
                text(content)
            ends[pos] = length
        elif tag not in VOID:
            open_.append(pos)
    text(html[at:])
    close(0)
    page.text = written.getvalue()
    return page


def parse(html: str | None) -> dict:
    """The text and the elements of a page, an element as a dict."""
    page = scan(html)

    def element(pos: int) -> dict:
        attrs, classes, _ = page.attributes(pos)
        return {"pos": pos, "tag": page.tags[pos], "until": page.until[pos], "start": page.start[pos], "end": page.end[pos],
                "classes": classes, "attrs": list(attrs.items())}

    return {"text": page.text, "elements": [element(pos) for pos in range(len(page.tags))]}


def in_pieces(page: dict) -> dict:
    text = page["text"]
    index: dict[str, list[int]] = {}
    for e in page["elements"]:
        for key in [e["tag"], *_keys(e["classes"], (name for name, _ in e["attrs"]))]:
            index.setdefault(key, []).append(e["pos"])
    return {"text": [text[i:i + PIECE] for i in range(0, len(text), PIECE)], "elements": page["elements"], "index": list(index.items())}


#: Characters of markup that are parsed into one batch.
MOST_CHARS = 4 << 20


def _by_size(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about `MOST_CHARS`, at least one text each."""
    first = chars = 0
    for n, text in enumerate(texts):
        if n > first and chars + len(text or "") > MOST_CHARS:
            yield first, n
            first, chars = n, 0
        chars += len(text or "")
    if first < len(texts):
        yield first, len(texts)


def with_elements(pages: DataFrame, html: str = "html", name: str = "dom") -> DataFrame:
    """`pages` with the parsed page in the column `name`; rows stay where they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch[html].to_pylist()
            for first, end in _by_size(texts):
                parsed = pa.array([in_pieces(parse(h)) for h in texts[first:end]], _ARROW_DOM)
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns, parsed], names=[*batch.schema.names, name])

    kinds = ", ".join(f"`{c}` {t}" for c, t in pages.dtypes)
    return pages.mapInArrow(run, f"{kinds}, `{name}` {DOM}")


_STEP = re.compile(r"""(\*|[a-zA-Z][\w-]*)?((?:\.[\w-]+|\#[\w-]+|\[[\w-]+(?:\*?=(?:'[^']*'|"[^"]*"|[\w-]+))?\])*)""")
_TEST = re.compile(r"""\.([\w-]+)|\#([\w-]+)|\[([\w-]+)(?:(\*?=)(?:'([^']*)'|"([^"]*)"|([\w-]+)))?\]""")


def _key(step: dict) -> str | None:
    """Entry of the index with all elements that a step may match; None for any element."""
    if step["classes"]:
        return f".{step['classes'][0]}"
    return "[id" if step["id"] else f"[{step['attrs'][0]['name']}" if step["attrs"] else step["tag"]


def parse_selector(selector: str) -> dict | None:
    """Steps of ``selector[@attribute]``; None where it is not understood."""
    path, _, attr = selector.strip().partition("@")
    steps, at = [], 0
    path = path.strip()
    while at < len(path):
        found = _STEP.match(path, at)
        if not found[0]:
            return None
        step: dict = {"tag": None if found[1] in (None, "*") else found[1].lower(), "id": None, "classes": [], "attrs": []}
        for cls, ident, name, op, *values in _TEST.findall(found[2]):
            if cls:
                step["classes"].append(cls)
            elif ident:
                step["id"] = ident
            else:
                step["attrs"].append({"name": name.lower(), "op": op or None, "value": "".join(values)})
        step["key"] = _key(step)
        steps.append(step)
        space = re.compile(r"\s+").match(path, found.end())
        if found.end() < len(path) and not space:
            return None
        at = space.end() if space else found.end()
    return {"attr": attr or None, "steps": steps} if steps else None


def selectors(texts: list[str]) -> Column:
    """Selectors as a column; those not understood are left out."""
    parsed = [p for t in texts if (p := parse_selector(t))]
    return F.from_json(F.lit(json.dumps(parsed)), SELECTORS)


def _matches(e: Column, s: Column) -> Column:
    def test(a: Column) -> Column:
        value = F.try_element_at(e["attrs"], a["name"])
        return F.coalesce(F.when(a["op"].isNull(), value.isNotNull()).when(a["op"] == "=", value == a["value"])
                          .otherwise(F.contains(value, a["value"])), F.lit(False))

    return ((s["tag"].isNull() | (e["tag"] == s["tag"]))
            & (s["id"].isNull() | F.coalesce(F.try_element_at(e["attrs"], F.lit("id")) == s["id"], F.lit(False)))
            & F.forall(s["classes"], lambda c: F.array_contains(e["classes"], c)) & F.forall(s["attrs"], test))


_POWERS = [1 << i for i in range(30, -1, -1)]


def _spans(found: Column) -> Column:
    """Intervals of elements for `_inside`: their beginnings and their ends, each in order."""
    return F.struct(F.transform(found, lambda e: e["pos"]).alias("starts"), F.sort_array(F.transform(found, lambda e: e["until"])).alias("ends"),
                    powers(found).alias("powers")).cast("struct<starts:array<int>,ends:array<int>,powers:array<int>>")


def powers(ordered: Column) -> Column:
    """Steps of `before` for an array of this length."""
    return F.filter(F.lit(_POWERS), lambda p: p <= F.size(ordered))


def before(ordered: Column, steps: Column, limit: Column) -> Column:
    """How many of an ordered array are less, by halving."""
    return F.aggregate(steps, F.lit(0), lambda n, p: F.when(F.get(ordered, n + p - 1) < limit, n + p).otherwise(n))


def _inside(e: Column, spans: Column) -> Column:
    """More intervals begin before the element than have ended there: two searches by
    halving, whatever the number of intervals."""
    return before(spans["starts"], spans["powers"], e["pos"]) > before(spans["ends"], spans["powers"], e["pos"] + 1)


def _candidates(dom: Column, s: Column) -> Column:
    """Elements that a step may match, by its first class or attribute or else its tag, in
    document order."""
    places = F.coalesce(F.try_element_at(dom["index"], s["key"]), F.when(s["key"].isNull(), F.transform(dom["elements"], lambda e: e["pos"])),
                        F.array().cast("array<int>"))
    return F.transform(places, lambda p: F.get(dom["elements"], p))


def select(dom: Column, selector: Column) -> Column:
    """Elements of the page that match one selector, in document order.

    Most selectors name something that a page does not have at all: the index tells so
    before any step is looked at."""
    steps = selector["steps"]
    none = F.array().cast(f"array<{ELEMENT}>")
    known = F.forall(steps, lambda s: s["key"].isNull() | F.map_contains_key(dom["index"], s["key"]))
    matching = lambda s: F.filter(_candidates(dom, s), lambda e: _matches(e, s))
    within = lambda found, s: F.when(F.size(found["starts"]) == 0, none).otherwise(
        F.filter(_candidates(dom, s), lambda e: _matches(e, s) & _inside(e, found)))
    around = F.aggregate(F.slice(steps, 2, F.greatest(F.size(steps) - 2, F.lit(0))), let(let(F.try_element_at(steps, F.lit(1)), matching), _spans),
                         lambda found, s: let(within(found, s), _spans))
    last = F.try_element_at(steps, F.lit(-1))
    bound = F.struct(around.alias("around"), last.alias("last"))
    return F.when(~known, none).when(F.size(steps) == 1, let(last, matching)).otherwise(let(bound, lambda b: within(b["around"], b["last"])))


def page_text(dom: Column) -> Column:
    return F.array_join(dom["text"], "")


def element_text(dom: Column, e: Column) -> Column:
    """Read from the pieces that the element touches, not from the beginning of the page."""
    first = F.shiftright(e["start"], PIECE_BITS)
    touched = F.shiftright(e["end"] - 1, PIECE_BITS) - first + 1
    joined = F.when(touched <= 1, F.get(dom["text"], first)).otherwise(
        F.array_join(F.transform(F.sequence(first, first + touched - 1), lambda i: F.get(dom["text"], i)), ""))
    return normalize_whitespace(F.substr(joined, e["start"] - first * PIECE + 1, e["end"] - e["start"]))


def values(dom: Column, selector: Column) -> Column:
    """Non-empty texts (or attribute values) of what a selector matches."""
    found = F.transform(select(dom, selector), lambda e: F.when(selector["attr"].isNull(), element_text(dom, e)).otherwise(
        normalize_whitespace(F.try_element_at(e["attrs"], selector["attr"]))))
    return F.filter(found, lambda v: v != "")


def first_values(dom: Column, chosen: Column) -> Column:
    """Values of the first selector of `chosen` that has any."""
    none = F.array().cast("array<string>")
    return F.aggregate(chosen, none, lambda got, s: F.when(F.size(got) > 0, got).otherwise(values(dom, s)))


def _distinct(pairs: Column) -> Column:
    """Each ``STRUCT<href, text>`` once.  ``array_distinct`` compares structs two by two but
    looks texts up in a table, so each pair goes through one text, and back."""
    packed = F.transform(pairs, lambda x: F.concat(F.length(x["href"]).cast("string"), F.lit(":"), x["href"], F.coalesce(F.concat(F.lit("="), x["text"]), F.lit(""))))

    def pair(key: Column) -> Column:
        length = F.substring_index(key, ":", 1)
        at, n = F.length(length) + 2, length.cast("int")
        rest = F.substr(key, at + n)
        return F.struct(F.substr(key, at, n).alias("href"), F.when(rest != "", F.substr(rest, F.lit(2))).alias("text"))

    return F.transform(F.array_distinct(packed), pair)


def link_places(dom: Column, chosen: Column) -> Column:
    """Positions of the elements with a ``href`` that a selector list matches: selector by
    selector, each once."""
    linking = lambda e: F.coalesce(F.try_element_at(e["attrs"], F.lit("href")) != "", F.lit(False))
    return F.array_distinct(F.flatten(F.transform(chosen, lambda s: F.transform(F.filter(select(dom, s), linking), lambda e: e["pos"]))))


def link_at(dom: Column, place: Column) -> Column:
    """``STRUCT<place, href, text>`` of an element."""
    def link(e: Column) -> Column:
        return F.struct(e["pos"].alias("place"), F.try_element_at(e["attrs"], F.lit("href")).alias("href"), F.coalesce(
            F.nullif(element_text(dom, e), F.lit("")), normalize_whitespace(F.try_element_at(e["attrs"], F.lit("aria-label")))).alias("text"))

    return let(F.get(dom["elements"], place), link)


def links(dom: Column, groups: Column) -> Column:
    """For each of an array of selector lists, the links that it matches as
    ``ARRAY<STRUCT<href, text>>``: selector by selector, each pair once."""
    pair = lambda x: F.struct(x["href"].alias("href"), x["text"].alias("text"))
    return F.transform(groups, lambda chosen: _distinct(F.transform(link_places(dom, chosen), lambda p: let(link_at(dom, p), pair))))


def first_href(dom: Column, chosen: Column) -> Column:
    """``href`` of the first element of the first selector whose first element has one."""
    firsts = F.transform(chosen, lambda s: F.try_element_at(F.try_element_at(select(dom, s), F.lit(1))["attrs"], F.lit("href")))
    return F.coalesce(F.try_element_at(F.filter(firsts, lambda h: F.coalesce(h != "", F.lit(False))), F.lit(1)), F.lit(""))


# ---------------------------------------------------------------- where a page is parsed
_SPACE = re.compile(WHITESPACE_CLASS.replace(r"\x{0B}", r"\x0b").replace(r"\x{A0}", r"\xa0").replace(r"\x{", r"\u").replace("}", "") + "+")


class Step(NamedTuple):
    key: str | None
    tag: str | None
    id: str | None
    classes: list[str]
    attrs: list[dict]
    sure: bool  # the index entry has nothing that does not match


class Selector(NamedTuple):
    attr: str | None
    steps: list[Step]


@lru_cache(1 << 14)
def compiled(parsed: str) -> list[Selector]:
    """Selectors of a JSON text of what ``parse_selector`` gives."""
    def step(s: dict) -> Step:
        tests = len(s["classes"]) + len(s["attrs"]) + (s["tag"] is not None)
        return Step(s["key"], s["tag"], s["id"], s["classes"], s["attrs"], s["id"] is None and tests <= 1 and all(a["op"] is None for a in s["attrs"]))

    return [Selector(p["attr"], [step(s) for s in p["steps"]]) for p in json.loads(parsed)]


def selector_texts(texts: list[str]) -> str:
    """``compiled`` reads it; selectors not understood are left out."""
    return json.dumps([p for t in texts if t and (p := parse_selector(t))])


def _meets(page: Page, pos: int, s: Step) -> bool:
    if s.tag is not None and page.tags[pos] != s.tag:
        return False
    attrs, classes, _ = page.attributes(pos)
    if s.id is not None and attrs.get("id") != s.id or any(c not in classes for c in s.classes):
        return False
    for a in s.attrs:
        value = attrs.get(a["name"])
        if value is None or a["op"] == "=" and value != a["value"] or a["op"] == "*=" and a["value"] not in value:
            return False
    return True


def _within(page: Page, positions: Iterable[int], around: Sequence[int]) -> list[int]:
    """Those that lie inside an element of `around`; both in document order."""
    found, n, reach = [], 0, 0
    for pos in positions:
        while n < len(around) and around[n] < pos:
            reach = max(reach, page.until[around[n]])
            n += 1
        if reach > pos:
            found.append(pos)
    return found


def places(page: Page, selector: Selector) -> Sequence[int]:
    """Positions of the elements that a selector matches, in document order."""
    if not all(s.key is None or s.key in page.index for s in selector.steps):
        return ()
    found: Sequence[int] | None = None
    for s in selector.steps:
        candidates = range(len(page.tags)) if s.key is None else page.index[s.key]
        if found is not None:
            candidates = _within(page, candidates, found)
        found = candidates if s.sure else array("i", (pos for pos in candidates if _meets(page, pos, s)))
        if not found:
            return ()
    return found or ()


def linked(page: Page, chosen: list[Selector]) -> Sequence[int]:
    """``link_places``: elements with a ``href``, selector by selector, each once."""
    return array("i", dict.fromkeys(pos for s in chosen for pos in places(page, s) if page.attributes(pos)[0].get("href")))


def text_at(page: Page, pos: int) -> str:
    return plain_text(page.text[page.start[pos]:page.end[pos]])


def plain_text(text: str | None) -> str:
    """``normalize_whitespace``."""
    return _SPACE.sub(" ", text or "").strip(" ")


def link_of(page: Page, pos: int) -> tuple[str, str]:
    """``(href, text)`` of an element with a href."""
    attrs = page.attributes(pos)[0]
    return attrs["href"], text_at(page, pos) or plain_text(attrs.get("aria-label"))


def first_link(page: Page, chosen: list[Selector]) -> str:
    """``first_href``."""
    for s in chosen:
        if (found := places(page, s)) and (href := page.attributes(found[0])[0].get("href")):
            return href
    return ""


def texts(page: Page, chosen: list[Selector]) -> Iterator[str]:
    """``first_values``, one by one."""
    for s in chosen:
        some = False
        for pos in places(page, s):
            if value := text_at(page, pos) if s.attr is None else plain_text(page.attributes(pos)[0].get(s.attr)):
                some = True
                yield value
        if some:
            return
