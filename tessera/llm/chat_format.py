"""Chat formatting by schema fingerprints, DataFrame functions only.

A record is a VARIANT value. Its schema gives its nested field paths ($.messages[].role, ...). The paths that any layout knows are
kept, sorted and hashed; this fingerprint selects a declarative mapping that turns the layout into canonical turns (role, text). So fields beside
the conversation (ids, names, sources, tools) don't matter, and a mapping lists which of its paths may be missing. Records whose
fingerprint has no mapping (no known layout, or fields of two) keep null turns, with their fingerprint and all their paths, so that a mapping can be written for them.

The template is `<|im_start|>role\\ntext<|im_end|>\\n` per turn. Inside texts and roles, every `<`, any number of
backslashes, `|` gets one backslash more, so no text holds a control string; a line break in a role becomes `<|n|>`, which no
escaped role holds. `turns_of` reads the formatted string back, `loss_text` those of its turns under the loss mask.

Defined cases: null or missing text or role is empty; a text that is a list of parts is the texts of its parts, joined; a leading system
field is a turn if it isn't empty; a null record has no paths and no turns; an empty list of messages is a known layout, and no turns format to the
empty string; equal turns stay as they are; an empty table gives no rows; columns of the names added are replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TURN = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """A layout: the paths it needs and those that may be missing; either a list of messages with their role and text fields, or top-level fields that are one turn each."""

    name: str
    needed: tuple[str, ...]
    optional: tuple[str, ...] = ()
    messages: str | None = None
    role: str = "role"
    text: str = "content"
    #: (role, fields of its text, in order; those that are empty are left out)
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    @property
    def fingerprints(self) -> list[str]:
        """One for each choice of optional paths; a path below another one only with that one."""
        subsets = (c for k in range(len(self.optional) + 1) for c in combinations(self.optional, k))
        fits = lambda c: all(p.rpartition("[]")[0] in (*self.needed, *c) for p in c if p.endswith("[].text"))
        return [fingerprint_of_paths((*self.needed, *c)) for c in subsets if fits(c)]


def fingerprint_of_paths(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def _messages(name: str, top: str, role: str, text: str, roles: dict[str, str] | None = None) -> Mapping:
    inner = f"$.{top}[].{text}"
    return Mapping(name, (f"$.{top}",), (f"$.{top}[].{role}", inner, f"{inner}[].text", "$.system"), top, role, text, roles=roles or {})


def _fields(name: str, needed: tuple[str, ...], optional: tuple[str, ...], *turns: tuple[str, tuple[str, ...]]) -> Mapping:
    return Mapping(name, tuple(f"$.{x}" for x in needed), tuple(f"$.{x}" for x in ("system", *optional)), turns=(("system", ("system",)), *turns))


SPEAKERS = {"human": "user", "gpt": "assistant", "chatgpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    _messages("messages", "messages", "role", "content"),
    _messages("turns", "turns", "role", "text"),
    _messages("conversations", "conversations", "from", "value", SPEAKERS),
    _messages("conversations by role", "conversations", "role", "content", SPEAKERS),
    _fields("instruction", ("instruction", "output"), ("input",), ("user", ("instruction", "input")), ("assistant", ("output",))),
    _fields("instruction and response", ("instruction", "response"), ("context",), ("user", ("instruction", "context")), ("assistant", ("response",))),
    _fields("prompt and response", ("prompt", "response"), (), ("user", ("prompt",)), ("assistant", ("response",))),
    _fields("prompt and completion", ("prompt", "completion"), (), ("user", ("prompt",)), ("assistant", ("completion",))),
    _fields("question and answer", ("question", "answer"), ("context",), ("user", ("context", "question")), ("assistant", ("answer",))),
)


def field_paths(record: Column) -> Column:
    """Sorted nested field paths of a VARIANT, arrays as []; null for null. An array that mixes objects with other values is a leaf.

    The schema string is cut into names, opening and closing signs; a fold over them keeps the path of every open object.
    """
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(r"`(?:[^`]|``)*`|[^\s<>:,`]+(?=: )|OBJECT<|ARRAY<|>"), F.lit(0))
    start = F.struct(F.array(F.lit("$")).alias("open"), F.lit("$").alias("at"), F.array().cast("array<string>").alias("paths"))

    def step(s: Column, t: Column) -> Column:
        name = F.concat(F.element_at(s["open"], -1), F.lit("."), t)
        listed = F.concat(s["at"], F.lit("[]"))
        opens = (t == "OBJECT<") | (t == "ARRAY<")
        at = F.when(t == "ARRAY<", listed).when((t == "OBJECT<") | (t == ">"), s["at"]).otherwise(name)
        stack = F.when(opens, F.array_append(s["open"], at)).when(t == ">", F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(1)))).otherwise(s["open"])
        paths = F.when(opens | (t == ">"), s["paths"]).otherwise(F.array_append(s["paths"], name))
        return F.struct(stack.alias("open"), at.alias("at"), paths.alias("paths"))

    return F.aggregate(tokens, start, step, lambda s: F.array_sort(F.array_distinct(s["paths"])))


def schema_fingerprint(paths: Column) -> Column:
    return F.sha2(F.array_join(paths, "\n"), 256)


def _text(v: Column, path: str) -> Column:
    """Text at a path; of a list of parts, the texts of the parts, one after the other."""
    parts = F.try_variant_get(v, path, "array<variant>")
    said = lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(F.startswith(F.schema_of_variant(p), F.lit("STRING")), F.try_variant_get(p, "$", "string")), F.lit(""))
    return F.coalesce(F.array_join(F.transform(parts, said), ""), F.try_variant_get(v, path, "string"), F.lit(""))


def _turns(record: Column, m: Mapping) -> Column:
    system = F.struct(F.lit("system").alias("role"), _text(record, "$.system").alias("text"))
    if m.messages is None:
        one = []
        for role, fields in m.turns:
            texts = F.filter(F.array(*(_text(record, f"$.{x}") for x in fields)), lambda x: x != "")
            one.append(F.struct(F.lit(role).alias("role"), F.array_join(texts, "\n\n").alias("text")))
        return F.filter(F.array(*one), lambda t: (t["role"] != "system") | (t["text"] != ""))
    items = F.try_variant_get(record, f"$.{m.messages}", "array<variant>")
    rename = F.create_map(*(F.lit(x) for pair in m.roles.items() for x in pair)) if m.roles else None
    said = lambda v: F.coalesce(F.try_variant_get(v, f"$.{m.role}", "string"), F.lit(""))
    role = lambda v: said(v) if rename is None else F.coalesce(rename[said(v)], said(v))
    turns = F.transform(items, lambda v: F.struct(role(v).alias("role"), _text(v, f"$.{m.text}").alias("text")))
    return F.concat(F.filter(F.array(system), lambda t: t["text"] != ""), turns)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def formatted(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit("<|n|>")), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))
    return F.array_join(F.transform(turns, one), "")


def turns_of(text: Column) -> Column:
    """The turns that a formatted string holds."""
    parts = F.filter(F.split(text, r"<\|im_start\|>"), lambda x: x != "")

    def read(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.length(role) + 2, F.length(part) - F.length(role) - 2 - len(END))
        return F.struct(unescape(F.replace(role, F.lit("<|n|>"), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, read).cast(TURN)


def loss_spans(text: Column, roles: tuple[str, ...] = ("assistant",)) -> Column:
    """Loss mask over a formatted string: (start, length) in code points of each text of a trained role, as it stands there (escaped)."""
    parts = F.split(text, r"<\|im_start\|>")

    def step(s: Column, part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        begin = s["at"] + F.length(role) + 1
        size = F.length(part) - F.length(role) - 2 - len(END)
        trained = (part != "") & unescape(F.replace(role, F.lit("<|n|>"), F.lit("\n"))).isin(*roles)
        spans = F.when(trained, F.array_append(s["spans"], F.struct(begin.cast("int").alias("start"), size.cast("int").alias("length")))).otherwise(s["spans"])
        return F.struct((s["at"] + F.length(part) + len(START)).cast("int").alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return F.aggregate(parts, start, step, lambda s: s["spans"])


def loss_text(text: Column, spans: Column) -> Column:
    """What lies under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda x: unescape(F.substr(text, x["start"] + 1, x["length"]))), "")


def format_chats(records: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Add schema_paths (all), schema_fingerprint (of the known ones), layout, turns, formatted and loss_spans; columns of these names are replaced."""
    known = F.array(*map(F.lit, sorted({p for m in mappings for p in (*m.needed, *m.optional)})))
    out = records.withColumn("schema_paths", field_paths(F.col(record_col)))
    out = out.withColumn("schema_fingerprint", schema_fingerprint(F.array_intersect("schema_paths", known)))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURN)
    for m in reversed(mappings):
        hit = F.col("schema_fingerprint").isin(*m.fingerprints)
        layout, turns = F.when(hit, F.lit(m.name)).otherwise(layout), F.when(hit, _turns(F.col(record_col), m).cast(TURN)).otherwise(turns)
    out = out.withColumn("layout", layout).withColumn("turns", turns).withColumn("formatted", formatted(F.col("turns")))
    return out.withColumn("loss_spans", loss_spans(F.col("formatted")))
