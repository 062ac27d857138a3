"""Users' regular expressions: read into a tree, checked, and written again for Java's engine, which Spark runs.

Two dialects are read. `LINEAR` is that of transforms: no look-around, no references to groups. `FULL`, that of format constraints, has these, atomic groups and possessive
repeats as well. What the two engines call differently is translated: names of groups, properties of characters, operations on classes, flags and their scope, anchors, and repeats of
repeats, which Java would take as possessive. A pattern whose unbounded repeats can divide one text among themselves in exponentially many ways (`ambiguous`) is
never given to a backtracking engine.

    LINEAR transforms: `searching` gives Java's pattern, `replacing` its replacement; ValueError says what is wrong.
    FULL formats: `whole_match` is a condition over a text; None for a pattern that isn't understood.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

LINEAR, FULL = "linear", "full"
#: Places that a pattern's repeats may be written out to, and places up to which ambiguity is looked for.
MOST_PLACES, MOST_COMPARED = 20_000, 160
TOP = 0x10FFFF

# One-letter escapes, classes of ASCII characters by name, white space, general categories by their long names.
ESCAPES = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}
ASCII_CLASSES = {
    "alnum": "09AZaz", "alpha": "AZaz", "ascii": "\0\x7f", "blank": "\t\t  ", "cntrl": "\0\x1f\x7f\x7f", "digit": "09", "graph": "!~", "lower": "az", "print": " ~",
    "punct": "!/:@[`{~", "space": "\t\r  ", "upper": "AZ", "word": "09AZ__az", "xdigit": "09AFaf",
}
SPACES = ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
CATEGORIES = {
    "other": "C", "control": "Cc", "format": "Cf", "unassigned": "Cn", "privateuse": "Co", "surrogate": "Cs", "letter": "L", "lowercaseletter": "Ll", "modifierletter": "Lm", "otherletter": "Lo",
    "titlecaseletter": "Lt", "uppercaseletter": "Lu", "casedletter": "LC", "mark": "M", "spacingmark": "Mc", "enclosingmark": "Me", "nonspacingmark": "Mn", "number": "N", "decimalnumber": "Nd", "letternumber": "Nl",
    "othernumber": "No", "punctuation": "P", "connectorpunctuation": "Pc", "dashpunctuation": "Pd", "closepunctuation": "Pe", "finalpunctuation": "Pf", "initialpunctuation": "Pi", "otherpunctuation": "Po",
    "openpunctuation": "Ps", "symbol": "S", "currencysymbol": "Sc", "modifiersymbol": "Sk", "mathsymbol": "Sm", "othersymbol": "So", "separator": "Z", "lineseparator": "Zl", "paragraphseparator": "Zp", "spaceseparator": "Zs",
}


# the tree


@dataclass(frozen=True)
class Chars:
    """One character. java: its class, in brackets; holds: is a code point in it? (None: this can't be told here)."""

    java: str
    holds: Callable[[int], bool] | None
    fold: bool = False

    def __hash__(self):
        return hash((self.java, self.fold))

    def __eq__(self, other):
        return isinstance(other, Chars) and (self.java, self.fold) == (other.java, other.fold)

    @property
    def written(self) -> str:
        return f"(?iu:{self.java})" if self.fold else self.java

    def has(self, c: str) -> bool:
        forms = {c, c.lower(), c.upper()} if self.fold else {c}
        return any(self.holds(ord(x)) for x in forms if len(x) == 1)


@dataclass(frozen=True)
class Cat:
    parts: tuple


@dataclass(frozen=True)
class Alt:
    parts: tuple


@dataclass(frozen=True)
class Repeat:
    body: object
    low: int
    high: int | None
    how: str = ""  # greedy; ? lazy, + possessive


@dataclass(frozen=True)
class Group:
    body: object
    number: int


@dataclass(frozen=True)
class Look:
    """An assertion: an anchor (body None, java all of it), or a group that looks around or is atomic (java its head)."""

    java: str
    body: object = None
    edge: str = ""  # start or end of the text


@dataclass(frozen=True)
class Back:
    number: int


@dataclass(frozen=True)
class Flags:
    fold: bool = False
    lines: bool = False
    dot_all: bool = False
    spaced: bool = False
    swapped: bool = False
    unicode: bool = True
    crlf: bool = False


FLAG = {"i": "fold", "m": "lines", "s": "dot_all", "x": "spaced", "U": "swapped", "u": "unicode", "R": "crlf"}


def point(cp: int) -> str:
    return chr(cp) if cp < 128 and chr(cp).isalnum() else f"\\x{{{cp:X}}}"


def ranges(*pairs: tuple[int, int]) -> Chars:
    body = "".join(point(a) if a == b else f"{point(a)}-{point(b)}" for a, b in pairs)
    return Chars(f"[{body}]", lambda c: any(a <= c <= b for a, b in pairs))


def negated(x: Chars) -> Chars:
    inner = x.java[1:-1]
    # a class that is nothing but one class keeps its brackets
    java = f"[{inner[1:]}]" if inner.startswith("^") and "[" not in inner and "&&" not in inner else f"[^{inner}]" if "&&" not in inner and "[" not in inner else f"[{point(0)}-{point(TOP)}&&[^{x.java}]]"
    return Chars(java, x.holds and (lambda c: not x.holds(c)), x.fold)


def together(parts: list[Chars]) -> Chars:
    known = all(p.holds for p in parts)
    return parts[0] if len(parts) == 1 else Chars(f"[{''.join(p.java for p in parts)}]", (lambda c: any(p.holds(c) for p in parts)) if known else None)


def both(a: Chars, b: Chars) -> Chars:
    return Chars(f"[{a.java}&&{b.java}]", (lambda c: a.holds(c) and b.holds(c)) if a.holds and b.holds else None)


def _is_word(c: int) -> bool:
    kind = unicodedata.category(chr(c))
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or c in (0x200C, 0x200D) or 0x24B6 <= c <= 0x24E9


PERL = {
    "d": (Chars(r"[\d]", lambda c: unicodedata.category(chr(c)) == "Nd"), "digit"),
    "w": (Chars(r"[\w]", _is_word), "word"),
    "s": (ranges(*SPACES), "space"),
}


def _ascii(name: str) -> Chars:
    s = ASCII_CLASSES[name]
    return ranges(*((ord(a), ord(b)) for a, b in zip(s[::2], s[1::2], strict=True)))


def compiles(java: str) -> bool:
    from pyspark.errors import IllegalArgumentException

    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(java)
        return True
    except IllegalArgumentException:
        return False


def _property(name: str) -> Chars:
    """A property of characters by its name here, under the name that Java has for it."""
    key, sign, value = (name if "=" in name or ":" in name else f"={name}").replace(":", "=").partition("=")
    plain = "".join(c for c in (value or key).lower() if c not in " _-")
    if plain == "any":
        return ranges((0, TOP))
    if plain == "ascii":
        return ranges((0, 127))
    if plain == "assigned":
        return negated(_property("Cn"))
    short = CATEGORIES.get(plain) or next((v for v in CATEGORIES.values() if v.lower() == plain), None)
    if short and key.lower() in ("", "gc", "general_category"):
        if short == "LC":
            return together([_property(x) for x in ("Lu", "Ll", "Lt")])
        return Chars(rf"[\p{{{short}}}]", lambda c: unicodedata.category(chr(c)).startswith(short))
    bare = value.strip().replace(" ", "_").replace("-", "_")
    for java in [rf"[\p{{Is{bare}}}]"] if not key else [rf"[\p{{script={bare}}}]"] if key.lower() in ("sc", "script", "scx", "script_extensions") else []:
        if compiles(java):
            return Chars(java, None)
    raise ValueError(f"unknown property of characters '{name}'")


class Reader:
    """One pass over a pattern. Alternatives, sequences and atoms call each other as they nest."""

    def __init__(self, text: str, dialect: str):
        self.text, self.at, self.dialect, self.flags, self.names, self.groups = text, 0, dialect, Flags(), {}, 0

    def fail(self, says: str):
        raise ValueError(f"{says} at {self.at} of /{self.text}/")

    def peek(self, s: str) -> bool:
        return self.text.startswith(s, self.at)

    def take(self, s: str) -> bool:
        hit = self.peek(s)
        self.at += len(s) * hit
        return hit

    def next(self) -> str:
        if self.at >= len(self.text):
            self.fail("the pattern ends too soon")
        self.at += 1
        return self.text[self.at - 1]

    def skip(self) -> None:
        """Blanks and remarks, where the flag x holds."""
        while self.flags.spaced and self.at < len(self.text):
            if self.text[self.at].isspace():
                self.at += 1
            elif self.text[self.at] == "#":
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end
            else:
                return

    def read(self):
        out = self.alternatives()
        if self.at < len(self.text):
            self.fail("an unopened group is closed")
        return out

    def alternatives(self):
        parts = [self.sequence()]
        while self.take("|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else Alt(tuple(parts))

    def sequence(self):
        parts: list = []
        while True:
            self.skip()
            if self.at >= len(self.text) or self.text[self.at] in "|)":
                return parts[0] if len(parts) == 1 else Cat(tuple(parts))
            c = self.text[self.at]
            if c in "*+?" or c == "{" and (self.dialect == LINEAR or self.counted(peek=True)):
                if not parts:
                    self.fail("nothing to repeat")
                parts[-1] = self.repeated(parts[-1])
                continue
            atom = self.atom()
            if atom is not None:
                parts.append(atom)

    def counted(self, peek: bool = False):
        """(low, high) of a repeat in braces; None where there is none, and nothing is taken."""
        start, end = self.at, self.text.find("}", self.at)
        low, comma, high = (x.strip() for x in self.text[start + 1 : max(end, start + 1)].partition(","))
        good = end > 0 and (low.isdigit() or comma and not low and high.isdigit()) and (not high or high.isdigit())
        if peek:
            return good
        if not good:
            self.fail("this is no number of repeats")
        self.at = end + 1
        return int(low or 0), int(high) if high else None if comma else int(low)

    def repeated(self, body):
        c = self.text[self.at]
        if c == "{":
            low, high = self.counted()
        else:
            self.at += 1
            low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
        if high is not None and high < low:
            self.fail("a repeat ends below its beginning")
        self.skip()
        lazy = self.take("?")
        how = "?" if lazy != self.flags.swapped else ""
        if self.dialect == FULL and not lazy and c != "{" and self.take("+"):
            how = "+"
        if isinstance(body, Repeat) and body.how == how and max(low, body.low) < 2 and {high, body.high} <= {None, 1}:
            return Repeat(body.body, low * body.low, 1 if high == body.high == 1 else None, how)  # a repeat of a repeat is one
        return Repeat(body, low, high, how)

    def leaf(self, x: Chars) -> Chars:
        return replace(x, fold=True) if self.flags.fold else x

    def atom(self):
        c = self.next()
        f = self.flags
        if c == "(":
            return self.group()
        if c == "[":
            return self.leaf(self.bracket())
        if c == ".":
            return ranges((0, TOP)) if f.dot_all else negated(ranges((10, 10), (13, 13)) if f.crlf else ranges((10, 10)))
        if c == "^":
            start = r"(?:\A|(?<=\n)|(?<=\r)(?!\n))" if f.crlf else r"(?:\A|(?<=\n))"
            return Look(start) if f.lines else Look(r"\A", edge="start")
        if c == "$":
            end = r"(?:(?=\r)|(?<!\r)(?=\n)|\z)" if f.crlf else r"(?=\n|\z)"
            return Look(end) if f.lines else Look(r"\z", edge="end")
        if c == "\\":
            return self.escaped()
        return self.leaf(ranges((ord(c), ord(c))))

    def escaped(self):
        c = self.next()
        if c.isdigit() and c.isascii():
            if self.dialect == LINEAR or c == "0":
                self.fail("no references to groups")
            while self.at < len(self.text) and self.text[self.at].isdigit():
                c += self.next()
            return Back(int(c))
        if self.dialect == FULL and c == "k" and self.take("<"):
            return self.named_back(">")
        if self.dialect == FULL and c == "h":
            return _ascii("xdigit")
        if self.dialect == FULL and c == "Z":
            return Look(r"(?=\n*\z)")
        if c in "bB":
            word = r"[0-9A-Za-z_]" if not self.flags.unicode else r"\w"
            edge = rf"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
            for name, java in (("start-half", rf"(?<!{word})"), ("end-half", rf"(?!{word})"), ("start", rf"(?<!{word})(?={word})"), ("end", rf"(?<={word})(?!{word})")):
                if c == "b" and self.take(f"{{{name}}}"):
                    return Look(java)
            return Look(edge if c == "b" else rf"(?!{edge})")
        if c in "Az":
            return Look(rf"\{c}", edge="start" if c == "A" else "end")
        if c in "<>":
            return Look(r"(?<!\w)(?=\w)" if c == "<" else r"(?<=\w)(?!\w)")
        return self.leaf(self.escaped_chars(c))

    def escaped_chars(self, c: str) -> Chars:
        """What an escape that may stand in a class means."""
        if c.lower() in PERL:
            unicode, ascii_name = PERL[c.lower()]
            out = unicode if self.flags.unicode else _ascii(ascii_name)
            return negated(out) if c.isupper() else out
        if c in "pP":
            name = self.next()
            if name == "{":
                end = self.text.find("}", self.at)
                name, self.at = (self.text[self.at : end], end + 1) if end >= 0 else self.fail("a property isn't closed")
            turned = name.startswith("^")
            out = _property(name[turned:])
            return negated(out) if (c == "P") != turned else out
        cp = self.code(c)
        return ranges((cp, cp))

    def code(self, c: str) -> int:
        """Code point of an escaped character."""
        if c in ESCAPES:
            return ESCAPES[c]
        if c in "xuU":
            if self.take("{"):
                end = self.text.find("}", self.at)
                digits, self.at = self.text[self.at : max(end, self.at)], max(end, self.at) + 1
            else:
                digits = "".join(self.next() for _ in range({"x": 2, "u": 4, "U": 8}[c]))
            if not digits or any(d not in "0123456789abcdefABCDEF" for d in digits) or int(digits, 16) > TOP:
                self.fail("no code point")
            return int(digits, 16)
        if self.dialect == FULL and c == "e":
            return 27
        if c.isascii() and not c.isalnum() and c not in "<>":
            return ord(c)
        self.fail(f"unknown escape '{c}'")

    def named_back(self, close: str):
        end = self.text.find(close, self.at)
        name, self.at = self.text[self.at : max(end, self.at)], end + 1
        if name.isdigit():
            return Back(int(name))
        if name not in self.names:
            self.fail(f"no group '{name}'")
        return Back(self.names[name])

    def group(self):
        outer = self.flags
        head = None
        if self.take("?"):
            if self.take("P=") and self.dialect == FULL:
                return self.named_back(")")
            for sign in ("<=", "<!", "=", "!", ">"):
                if self.peek(sign):
                    if self.dialect == LINEAR:
                        self.fail("no look-around")
                    self.at += len(sign)
                    head = f"(?{sign}"
                    break
            else:
                if self.take("P<") or self.take("<"):
                    end = self.text.find(">", self.at)
                    name, self.at = self.text[self.at : max(end, self.at)], end + 1
                    if end < 0 or not name or name[0].isdigit() or not all(x.isalnum() or x in "_.[]" for x in name) or name in self.names:
                        self.fail("this is no name for a group")
                    self.groups += 1
                    self.names[name] = number = self.groups
                    return self.closed(outer, lambda body: Group(body, number))
                on = True
                while not self.peek(":") and not self.peek(")"):
                    c = self.next()
                    if c == "-" and on:
                        on = False
                    elif c in FLAG:
                        self.flags = replace(self.flags, **{FLAG[c]: on})
                    else:
                        self.fail(f"unknown flag '{c}'")
                if self.take(")"):
                    return None  # holds to the end of the group around it
                self.at += 1
                return self.closed(outer, lambda body: body)
            return self.closed(outer, lambda body: Look(head, body))
        self.groups += 1
        number = self.groups
        return self.closed(outer, lambda body: Group(body, number))

    def closed(self, outer: Flags, build):
        body = self.alternatives()
        if not self.take(")"):
            self.fail("a group isn't closed")
        self.flags = outer
        return build(body)

    def bracket(self) -> Chars:
        turned = self.take("^")
        out, part, op, first = None, [], None, True

        def joined(a, b, sign):
            return b if a is None else both(a, b) if sign == "&&" else both(a, negated(b)) if sign == "--" else together([both(a, negated(b)), both(b, negated(a))])

        empty = both(ranges((0, 0)), ranges((1, 1)))
        while True:
            self.skip()
            if self.peek("]") and not first:
                self.at += 1
                out = joined(out, together(part) if part else empty, op)
                return negated(out) if turned else out
            sign = next((s for s in ("&&", "--", "~~") if self.peek(s)), None)
            if sign and not first:
                self.at += 2
                out, part, op = joined(out, together(part) if part else empty, op), [], sign
                continue
            first = False
            part.append(self.class_item())

    def class_item(self) -> Chars:
        c = self.next()
        if c == "[":
            for name in ASCII_CLASSES:
                for mark in ("", "^"):
                    if self.take(f":{mark}{name}:]"):
                        return negated(_ascii(name)) if mark else _ascii(name)
            return self.bracket()
        low = None
        if c == "\\":
            c = self.next()
            if c.lower() in PERL or c in "pP" or self.dialect == FULL and c == "h":
                found = _ascii("xdigit") if c == "h" else self.escaped_chars(c)
                if self.peek("-") and not self.peek("-]") and not self.peek("--"):
                    self.fail("a range begins with a class")
                return found
            low = self.code(c)
        low = ord(c) if low is None else low
        if self.peek("-") and not self.peek("-]") and not self.peek("--"):
            self.at += 1
            self.skip()
            c = self.next()
            if c == "[":
                self.fail("a range ends with a class")
            high = self.code(self.next()) if c == "\\" else ord(c)
            if high < low:
                self.fail("a range ends below its beginning")
            return ranges((low, high))
        return ranges((low, low))


# what is made of the tree


def java(node) -> str:
    """Java's pattern; groups are named g1, g2, ..."""
    if isinstance(node, Chars):
        return node.written
    if isinstance(node, Cat):
        return "".join(map(java, node.parts))
    if isinstance(node, Alt):
        return f"(?:{'|'.join(map(java, node.parts))})"
    if isinstance(node, Repeat):
        times = f"{{{node.low},{'' if node.high is None else node.high}}}"
        return f"(?:{java(node.body)}){times}{node.how}"
    if isinstance(node, Group):
        return f"(?<g{node.number}>{java(node.body)})"
    if isinstance(node, Back):
        return rf"\k<g{node.number}>"
    return node.java if node.body is None else f"{node.java}{java(node.body)})"


def inside(node) -> Iterator:
    yield node
    for x in node.parts if isinstance(node, Cat | Alt) else (getattr(node, "body", None),):
        if x is not None:
            yield from inside(x)


def nullable(node) -> bool:
    if isinstance(node, Chars):
        return False
    if isinstance(node, Cat):
        return all(map(nullable, node.parts))
    if isinstance(node, Alt):
        return any(map(nullable, node.parts))
    if isinstance(node, Repeat):
        return node.low == 0 or nullable(node.body)
    return nullable(node.body) if isinstance(node, Group) else True


class Places:
    """The automaton of a tree's places: one state per character that the pattern names, edges with their number. Assertions and references read nothing here.

    whole: repeats are written out, so that the automaton accepts what the pattern does; else twice at most, which is enough to see ambiguity.
    """

    def __init__(self, tree, whole: bool = False):
        self.chars: list[Chars] = []
        self.follow: list[list[int]] = []
        self.whole = whole
        self.empty, self.first, self.last = self.build(tree)

    def build(self, node) -> tuple[bool, list[int], list[int]]:
        if isinstance(node, Chars):
            if len(self.chars) >= MOST_PLACES:
                raise ValueError("the pattern is too large")
            self.chars.append(node)
            self.follow.append([])
            at = [len(self.chars) - 1]
            return False, at, at
        if isinstance(node, Cat):
            return self.row(node.parts)
        if isinstance(node, Alt):
            parts = [self.build(p) for p in node.parts]
            return any(p[0] for p in parts), [x for p in parts for x in p[1]], [x for p in parts for x in p[2]]
        if isinstance(node, Group):
            return self.build(node.body)
        if isinstance(node, Look) and node.java == "(?>":
            return self.build(node.body)
        if not isinstance(node, Repeat):
            return True, [], []
        if node.high == 0:
            return True, [], []
        if node.high is None:
            copies = [node.body] * (max(1, node.low) if self.whole else 1)
            out = self.row(copies, loop=True)
        else:
            high, low = (node.high, node.low) if self.whole else (min(node.high, 2), min(node.low, 2))
            out = self.row([node.body] * low + [Repeat(node.body, 0, 1)] * (high - low)) if high != 1 else self.build(node.body)
        return out[0] or node.low == 0, out[1], out[2]

    def row(self, parts, loop: bool = False) -> tuple[bool, list[int], list[int]]:
        empty, first, last = True, [], []
        for i, part in enumerate(parts):
            e, f, t = self.build(part)
            self.link(last, f)
            if loop and i == len(parts) - 1:
                self.link(t, f)
            first = first + f if empty else first
            last = last + t if e else t
            empty = empty and e
        return empty, first, last

    def link(self, sources: list[int], targets: list[int]) -> None:
        for p in sources:
            self.follow[p].extend(targets)

    @cached_property
    def back(self) -> list[set[int]]:
        """Places from which each can be reached."""
        came: list[set[int]] = [set() for _ in self.chars]
        for p, targets in enumerate(self.follow):
            for q in targets:
                came[q].add(p)
        out = []
        for q in range(len(self.chars)):
            seen, rest = set(), [q]
            while rest:
                for p in came[rest.pop()] - seen:
                    seen.add(p)
                    rest.append(p)
            out.append(seen)
        return out


def _meet(a: Chars, b: Chars, known: dict) -> bool:
    """Is there a character in both? Every character of the basic plane is tried by Java's engine."""
    if a == b:
        return True
    key = tuple(sorted((a.written, b.written)))
    if key not in known:
        jvm = SparkSession.active()._jvm
        if "" not in known:
            known[""] = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
        known[key] = jvm.java.util.regex.Pattern.compile(f"(?dU)(?={a.written}){b.written}").matcher(known[""]).find()
    return known[key]


def ambiguous(tree) -> bool:
    """Can unbounded repeats share out one text in exponentially many ways?

    They can if from some place two different ways lead back to it over the same characters. Ways are followed in pairs.
    """
    if any(isinstance(x, Look) and x.body is not None and x is not tree and ambiguous(x.body) for x in inside(tree)):
        return True
    a = Places(tree)
    loops = [p for p in range(len(a.chars)) if p in a.back[p]]
    on_loop, known = set(loops), {}
    follow = {p: [q for q in a.follow[p] if q in on_loop and q in a.back[p]] for p in loops}
    if any(len(set(f)) < len(f) for f in follow.values()):
        return True
    split = {p for p, f in follow.items() if any(_meet(a.chars[x], a.chars[y], known) for i, x in enumerate(f) for y in f[:i])}
    if not split:
        return False
    if len(loops) > MOST_COMPARED:
        return True
    for start in split:
        ahead, rest = {(start, start)}, [(start, start)]
        came: dict[tuple[int, int], set[tuple[int, int]]] = {}
        while rest:
            p, q = rest.pop()
            for x in follow[p]:
                for y in follow[q]:
                    if _meet(a.chars[x], a.chars[y], known):
                        came.setdefault((x, y), set()).add((p, q))
                        if (x, y) not in ahead:
                            ahead.add((x, y))
                            rest.append((x, y))
        behind, rest = set(), [(start, start)]
        while rest:
            for pair in came.get(rest.pop(), set()) - behind:
                behind.add(pair)
                rest.append(pair)
        if any(p != q for p, q in behind):
            return True
    return False


def parsed(pattern: str, dialect: str = LINEAR):
    """(tree, names of groups, number of groups); ValueError for what isn't a pattern."""
    reader = Reader(pattern, dialect)
    tree = reader.read()
    Places(tree, whole=True)  # its size is bounded
    if any(isinstance(x, Back) and x.number > reader.groups for x in inside(tree)):
        raise ValueError(f"no such group in /{pattern}/")
    return tree, reader.names, reader.groups


def searching(pattern: str) -> str:
    """Java's pattern that finds the same matches as LINEAR, from left to right; ValueError for others and for ambiguous ones."""
    tree, _, _ = parsed(pattern)
    if ambiguous(tree):
        raise ValueError(f"the repeats in /{pattern}/ can share out a text in too many ways")
    out = java(tree)
    if nullable(tree):  # an empty match right behind a match doesn't count
        out = rf"(?=(?<rest>[\x{{0}}-\x{{10FFFF}}]*))(?>{out})(?:(?!\k<rest>\z)|\A|(?!\G))"
    out = f"(?dU){out}"
    if not compiles(out):
        raise ValueError(f"/{pattern}/ can't be run")
    return out


def replacing(replacement: str, pattern: str) -> str:
    """Java's replacement. $1 and ${1} and ${name} and $name are groups, empty where the pattern has none of them; $$ is a dollar sign, as is one that begins no reference."""
    _, names, groups = parsed(pattern)
    out, at, text = [], 0, replacement
    literal = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    while at < len(text):
        sign = text.find("$", at)
        if sign < 0:
            break
        out.append(literal(text[at:sign]))
        at = sign + 1
        word = at
        if text[at : at + 1].isdigit() and text[at].isascii():  # all digits, and no more, are the group's number
            while word < len(text) and text[word].isascii() and text[word].isdigit():
                word += 1
            name, at = text[at:word], word
        elif text.startswith("$", at):
            # the second sign stands for one; digits behind it were put in braces before
            end = at + 1
            while end < len(text) and text[end].isascii() and text[end].isdigit():
                end += 1
            out.append(literal("$" if end == at + 1 else f"${{{text[at + 1 : end]}}}"))
            at = end
            continue
        elif text.startswith("{", at):
            end = text.find("}", at)
            if end < 0:
                out.append(literal("$"))
                continue
            name, at = text[at + 1 : end], end + 1
        else:
            while word < len(text) and text[word].isascii() and (text[word].isalnum() or text[word] == "_"):
                word += 1
            if word == at:
                out.append(literal("$"))
                continue
            name, at = text[at:word], word
        number = int(name) if name.isascii() and name.isdigit() else names.get(name, -1)
        if number == 0:
            out.append("$0")
            # a digit behind it must not be read with it
            if text[at : at + 1].isdigit():
                out[-1] = "$0\\" + text[at]
                at += 1
        elif 0 < number <= groups:
            out.append(f"${{g{number}}}")
    return "".join([*out, literal(text[at:])])


def accepts(places: Places, text: str) -> bool:
    """Does the automaton read the whole text? Linear in it, whatever the pattern."""
    here, ends = None, set(places.last)
    for c in text:
        from_here = places.first if here is None else {q for p in here for q in places.follow[p]}
        here = {q for q in from_here if places.chars[q].has(c)}
        if not here:
            return False
    return places.empty if here is None else bool(here & ends)


def _bare(node):
    """A tree without anchors that are met anyway where a whole text is asked for, or None if it holds other assertions or what can't be told here."""
    parts = list(node.parts) if isinstance(node, Cat) else [node]
    while parts and isinstance(parts[0], Look) and parts[0].edge == "start":
        parts.pop(0)
    while parts and isinstance(parts[-1], Look) and parts[-1].edge == "end":
        parts.pop()
    out = Cat(tuple(parts))
    fine = all(not isinstance(x, Look | Back) and not (isinstance(x, Repeat) and x.how == "+") and not (isinstance(x, Chars) and x.holds is None) for x in inside(out))
    return out if fine else None


def whole_match(text: Column, pattern: str) -> Column | None:
    """Does the pattern (FULL) match all of the text? None for patterns that aren't understood, or that only a search without bound could decide."""
    try:
        tree, _, _ = parsed(pattern, FULL)
        risky = ambiguous(tree)
    except ValueError:
        return None
    if not risky:
        out = rf"(?dU)\A(?:{java(tree)})\z"
        return text.rlike(out) if compiles(out) else None
    bare = _bare(tree)
    if bare is None:
        return None
    places = Places(bare, whole=True)

    @pandas_udf("boolean")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else accepts(places, t))

    return read(text)
