"""Template parameters out of wiki markup.

Balanced markup is beyond regular expressions, so two small helpers run as Arrow-batched UDFs: the parameters of the first
matching transclusion (`template_params`) and the cleaned value (`clean_value`). Both read a text once, in linear time, into a tree of its
transclusions (`tree`) and walk over that. `page_values` does for a page all that the fields of a job ask of it, in one call. All else (lead section, names,
what is made of values) is done in Column expressions around them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.functions.text import ASCII_DIGITS

_SIGN = re.compile(r"\{\{|\}\}|\[\[|\]\]|[|=]|(?i:<nowiki>)")
_NOWIKI_END = re.compile("(?i:</nowiki>)")
_LINK = re.compile(r"\[\[(?!\[)")
_NOTE, _NOTE_END = re.compile(r"<ref(?=[\s/>])", re.I), re.compile(r"</ref\s*>", re.I)
_NUMBER_OR_SIDE = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)|[NSEWnsew]")
# Fixed value: templates of coordinates.
COORDINATES = ("Coord", "Coordinate", "Coordinates")
_LINK_OR_PIPE = re.compile(r"\[\[|\]\]|\|")


@dataclass(slots=True)
class Call:
    """A transclusion text[begin:end], or braces that never close (no parts, end two after begin).

    parts: (begin, end, place of the sign that ends the parameter's name, or -1); inner: transclusions inside, in order.
    """

    begin: int
    end: int = -1
    parts: list[tuple[int, int, int]] = field(default_factory=list)
    inner: list[Call] = field(default_factory=list)
    #: while it is open: where the current part begins, its name's end, and the fewest links that were open since the call began
    at: int = 0
    name_end: int = -1
    floor: int = 0


def tree(text: str) -> list[Call]:
    """The transclusions of a text that stand in no other one, each with those inside; one pass, whatever the nesting.

    Open calls lie on a stack. A pipe belongs to the innermost one, unless a link is open there; links are counted over the whole text, and a call
    remembers the lowest count since it began, so what is open in it is the difference. In a call, a nowiki block hides its signs from
    the calls around it, but a transclusion inside the block is found.
    """
    found, stack, links, at = [], [], 0, 0
    while m := _SIGN.search(text, at):
        sign, a, at = m[0], m.start(), m.end()
        top = stack[-1] if stack else None
        if sign == "{{":
            stack.append(Call(a, at=at, floor=links))
        elif top is None:
            continue
        elif sign == "}}":
            top.parts.append((top.at, a, top.name_end))
            top.end = at
            stack.pop()
            if stack:
                stack[-1].floor = min(stack[-1].floor, top.floor)
            (stack[-1].inner if stack else found).append(top)
        elif sign == "[[":
            links += 1
        elif sign == "]]":
            links -= 1
            top.floor = min(top.floor, links)
        elif sign[0] == "<":
            close = _NOWIKI_END.search(text, at)
            inside = text[at : close.start() if close else len(text)]
            name = inside.partition("=")[0]
            if top.name_end < 0 and links == top.floor and len(name) < len(inside) and "{{" not in name and "[[" not in name:
                top.name_end = at + len(name)
            if "{{" in inside:
                top.inner += _moved(tree(inside), at)
            at = close.end() if close else len(text)
        elif links == top.floor:
            if sign == "|":
                top.parts.append((top.at, a, top.name_end))
                top.at, top.name_end = at, -1
            elif top.name_end < 0:
                top.name_end = a
    for open_ in stack:  # what never closes is no call; what it holds stands by itself
        found += [Call(open_.begin, open_.begin + 2), *open_.inner]
    return sorted(found, key=lambda c: c.begin)


def _moved(calls: list[Call], by: int) -> list[Call]:
    return [Call(c.begin + by, c.end + by, [(a + by, b + by, e + by if e >= 0 else -1) for a, b, e in c.parts], _moved(c.inner, by)) for c in calls]


def in_order(calls: list[Call]) -> Iterator[Call]:
    """Every call, outer before inner, in the order of the text."""
    rest = calls[::-1]
    while rest:
        call = rest.pop()
        if call.parts:
            yield call
        rest += call.inner[::-1]


def plain_name(name: str, prefixes: tuple[str, ...], first_letter: bool) -> str:
    """Name without namespace, one blank for blanks and underscores, first letter upper-cased."""
    head, colon, rest = name.partition(":")
    squeeze = lambda s: " ".join(s.replace("_", " ").split())
    if colon and squeeze(head).lower() in {squeeze(p).lower() for p in prefixes}:
        name = rest
    name = squeeze(name)
    return name[:1].upper() + name[1:] if first_letter else name


def params(text: str, call: Call) -> dict[str, str]:
    """Named and numbered parameters, trimmed; the later of two of a name counts."""
    unnamed = (str(i + 1) for i in range(len(call.parts)))
    return {(text[a:e].strip() if e >= 0 else next(unnamed)): text[max(a, e + 1) : b].strip() for a, b, e in call.parts[1:]}


def outside_calls(text: str, calls: list[Call], begin: int, end: int, unwrap: bool) -> str:
    """text[begin:end] without its calls, or with the first unnamed parameter of each in its place."""
    out = []
    for call in calls:
        out.append(text[begin : call.begin])
        begin = call.end
        kept = next(((a, b) for a, b, e in call.parts[1:] if e < 0), None) if unwrap else None
        if kept is not None:
            a, b = kept[0] + len(part := text[slice(*kept)]) - len(part.lstrip()), kept[0] + len(part.rstrip())
            out.append(outside_calls(text, [c for c in call.inner if a <= c.begin < b], a, max(a, b), True))
    return "".join([*out, text[begin:end]])


def first_piece(value: str) -> str:
    """What stands before the first pipe that is in no link."""
    links = 0
    for m in _LINK_OR_PIPE.finditer(value):
        if m[0] == "|" and not links:
            return value[: m.start()]
        links = links + 1 if m[0] == "[[" else max(0, links - 1) if m[0] == "]]" else links
    return value


def unlabelled(value: str) -> str:
    """Links without their labels. A link that holds another bracket, or isn't closed, stays as it is."""
    head, *rest = _LINK.split(value)
    out = [head]
    for piece in rest:
        inner, close, tail = piece.partition("]]")
        target, bar, _ = inner.partition("|")
        out.append(f"[[{target}]]{tail}" if close and bar and "[" not in inner and "]" not in inner else f"[[{piece}")
    return "".join(out)


def without_notes(text: str) -> str:
    """Without comments (to the end, if one isn't closed) and without references; a reference that isn't closed stays."""
    kept, at = [], 0
    while (begin := text.find("<!--", at)) >= 0:
        kept.append(text[at:begin])
        end = text.find("-->", begin + 4)
        at = len(text) if end < 0 else end + 3
    text, kept, at = "".join([*kept, text[at:]]), [], 0
    while m := _NOTE.search(text, at):
        end = text.find(">", m.end())
        tag = text[m.end() : end] if end >= 0 else None
        close = None
        if tag is not None and (tag in ("", "/") or tag[0].isspace()):
            close = end + 1 if tag.endswith("/") else (e := _NOTE_END.search(text, end + 1)) and e.end()
        kept.append(text[at : m.start() if close else m.end()])
        at = close or m.end()
    return "".join([*kept, text[at:]])


def cleaned(raw: str, unwrap: bool = False) -> str:
    """What a value parser should see; empty if no letter or digit is left."""
    value = raw.replace("{{!}}", "|")
    if "{{" in value:
        value = outside_calls(value, tree(value), 0, len(value), unwrap)
    value = re.sub(r"'{2,}", "", unlabelled(value)).replace("&nbsp;", " ")
    value = " ".join(first_piece(value).split())
    return value if any(c.isalnum() for c in value) else ""


def lead_section(text: Column) -> Column:
    """Text before the first heading line."""
    return F.regexp_extract(text, r"(?s)\A(.*?)(?:(?m:^=+[^=\n]+=+[ \t]*$).*)?\z", 1)


def transcluded(text: str, known: set[str], prefixes: tuple[str, ...], first_letter: bool) -> dict[str, str] | None:
    """Parameters of the first transclusion of a known name."""
    calls = in_order(tree(text))
    return next((params(text, c) for c in calls if plain_name(text[slice(*c.parts[0][:2])], prefixes, first_letter) in known), None)


def unnamed(found: dict[str, str], first: int) -> list[str]:
    """Values of the unnamed parameters from the first on, up to the first gap or empty one."""
    out: list[str] = []
    while value := found.get(str(first + len(out))):
        out.append(value)
    return out


def coordinate(raw: str, prefixes: tuple[str, ...]) -> str:
    """What a coordinate is read from: numbers and hemispheres at the start of a nested coordinate template, or else the cleaned text."""
    found = transcluded(raw, {plain_name(n, (), True) for n in COORDINATES}, prefixes, True) if "{{" in raw else None
    if found is None:
        return cleaned(raw)
    values = [v.strip().translate(ASCII_DIGITS) for v in unnamed(found, 1)]
    end = next((i for i, v in enumerate(values) if not _NUMBER_OR_SIDE.fullmatch(v)), len(values))
    return " ".join(values[:end])


def template_params(text: Column, names: list[str], prefixes: tuple[str, ...] = ("Template",), first_letter: bool = True) -> Column:
    """map<string,string> of the first transclusion of one of the names; null if there is none."""
    known = {plain_name(n, prefixes, first_letter) for n in names}

    @pandas_udf("map<string,string>")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else transcluded(without_notes(t), known, prefixes, first_letter))

    # texts without any opening braces needn't cross to Python
    return F.when(F.contains(text, F.lit("{{")), read(text))


VALUES = "struct<raw:map<string,string>,clean:map<string,string>>"


def page_values(text: Column, names: list[str], wanted: list[str], runs: list[int] = [], prefixes: tuple[str, ...] = ("Template",), first_letter: bool = True, unwrap: bool = False) -> Column:  # noqa: B006
    """struct(raw, clean): the wanted parameters that have a value, of the first transclusion of one of the names, as they are and cleaned; null if there is none.

    runs: numbers from which on the unnamed parameters are wanted as well, up to the first gap.
    """
    known = {plain_name(n, prefixes, first_letter) for n in names}
    asked = {n.strip() for n in wanted}

    @pandas_udf(VALUES)
    def read(texts: pd.Series) -> pd.DataFrame:
        def one(t: str | None) -> tuple:
            found = None if t is None else transcluded(without_notes(t), known, prefixes, first_letter)
            if found is None:
                return None, None
            keys = asked | {str(first + i) for first in runs for i in range(len(unnamed(found, first)))}
            raw = {k: found[k] for k in keys if found.get(k)}
            return raw, {k: cleaned(v, unwrap) for k, v in raw.items()}

        return pd.DataFrame([one(t) for t in texts], columns=["raw", "clean"], dtype=object)

    got = read(text)
    return F.when(F.contains(text, F.lit("{{")), got)


def coordinate_texts(values: Column, prefixes: tuple[str, ...] = ("Template",)) -> Column:
    """array<string> -> what a coordinate is read from, for each."""

    @pandas_udf("array<string>")
    def read(lists: pd.Series) -> pd.Series:
        return lists.map(lambda texts: None if texts is None else [None if t is None else coordinate(t, prefixes) for t in texts])

    return read(values)


def clean_value(raw: Column, unwrap: bool = False) -> Column:
    @pandas_udf("string")
    def clean(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else cleaned(v, unwrap))

    return clean(raw)


def first_of(params: Column, names: list[str]) -> Column:
    """The first named parameter with a value."""
    return F.coalesce(*(F.nullif(F.try_element_at(params, F.lit(n.strip())), F.lit("")) for n in names))


def value_pattern(params: Column, pattern: str, clean=None) -> Column:
    """Fill {name} places; null unless all have a value."""
    pieces = []
    for literal, name in re.findall(r"([^{}]*)(?:\{([^{}]*)\})?", pattern):
        if literal:
            pieces.append(F.lit(literal))
        if name:
            value = first_of(params, [name])
            pieces.append(F.nullif(clean(value), F.lit("")) if clean else value)
    return F.concat(*pieces)


def coordinate_params(raw: Column, prefixes: tuple[str, ...] = ("Template",)) -> Column:
    """What a coordinate is read from, for one text."""
    return F.get(coordinate_texts(F.array(raw), prefixes), F.lit(0))


def page_links(text: Column, category_prefixes: tuple[str, ...] = ("Category",)) -> Column:
    """struct(templates, categories): the names of all transclusions and of all categories that a text names, as they are written."""
    category = re.compile(rf"\[\[\s*(?:{'|'.join(map(re.escape, category_prefixes))})\s*:([^\[\]|]*)", re.I)

    @pandas_udf("struct<templates:array<string>,categories:array<string>>")
    def read(texts: pd.Series) -> pd.DataFrame:
        def one(t: str | None) -> tuple[list[str], list[str]]:
            plain = "" if t is None else without_notes(t)
            named = [plain[slice(*c.parts[0][:2])].strip() for c in in_order(tree(plain))] if "{{" in plain else []
            return list(dict.fromkeys(named)), list(dict.fromkeys(c.strip() for c in category.findall(plain)))

        return pd.DataFrame([one(t) for t in texts], columns=["templates", "categories"], dtype=object)

    return read(text)
