"""The 23 property constraints. A rule adds no rows; it gives a condition (local) or the row ids that violate it (joins).

Rows: row_id, item, property, one typed value (v_item, v_text, v_amount, v_unit, v_date, the others null) and used, the properties of its qualifiers.
A rule about another kind of value is never violated. Local rules are Column builders over the definition; the others are DataFrame builders, each one semi- or
anti-join. `Definition` is one constraint of a property, `rules` turns definitions into what `first_violation` takes.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.patterns import whole_match
from tessera.operators.claims import MOST_SENT, reduced, text_rows, truthy, values_of
from tessera.operators.closure import in_classes, members, reached
from tessera.plans.lineage import checkpointed

#: Kinds of constraints and what their messages call them.
NAMES = {
    "Q52004125": "allowed entity types", "Q21510851": "allowed qualifiers", "Q21514353": "allowed units", "Q54554025": "citation needed", "Q21510852": "Commons link",
    "Q21502838": "conflicts with", "Q21502410": "distinct values", "Q21502404": "format", "Q52848401": "integer", "Q21510855": "inverse",
    "Q21503247": "item requires statement", "Q21510856": "mandatory qualifier", "Q51723761": "no bounds", "Q52558054": "none of", "Q21510859": "one of",
    "Q53869507": "property scope", "Q21510860": "range", "Q19474404": "single value", "Q52060874": "single best value", "Q21510862": "symmetric",
    "Q21503250": "type", "Q21510864": "value requires statement", "Q21510865": "value type",
}
ITEM_TYPE, MAIN_VALUE = "Q29934200", "Q54828448"


# local rules: violated?


def allowed_entity_types(types: list[str]) -> Column:
    return F.lit(bool(types) and ITEM_TYPE not in types)


def property_scope(scopes: list[str]) -> Column:
    return F.lit(bool(scopes) and MAIN_VALUE not in scopes)


def never(*_) -> Column:
    """Citation needed and no bounds are never violated by a new statement."""
    return F.lit(False)


def allowed_qualifiers(used: Column, allowed: list[str]) -> Column:
    return F.size(F.array_except(used, F.array(*map(F.lit, allowed)).cast("array<string>"))) > 0


def mandatory_qualifier(used: Column, needed: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, needed)).cast("array<string>"), used)) > 0


def allowed_units(amount: Column, unit: Column, allowed: list[str | None]) -> Column:
    return amount.isNotNull() & ~F.coalesce(unit, F.lit("1")).isin(*("1" if u is None else u for u in allowed))


def one_of(item: Column, listed: list[str]) -> Column:
    return F.coalesce(~item.isin(*listed), F.lit(False)) if listed else item.isNotNull()


def none_of(item: Column, listed: list[str]) -> Column:
    return F.coalesce(item.isin(*listed), F.lit(False)) if listed else F.lit(False)


def format_(text: Column, pattern: str) -> Column:
    """Does the pattern not match the whole text? One that isn't understood is met by all values."""
    met = whole_match(text, pattern)
    return F.lit(False) if met is None else F.coalesce(~met, F.lit(False))


def integer(amount: Column) -> Column:
    return F.coalesce(amount.cast("string").rlike(r"\.[0-9]*[1-9]"), F.lit(False))


def amount_range(amount: Column, low: float | None, high: float | None) -> Column:
    x = amount.cast("double")
    out = F.lit(False)
    if low is not None:
        out = out | (x < low)
    if high is not None:
        out = out | ((x > high) & ~F.isnan(x))  # not a number violates no bound
    return F.coalesce(out, F.lit(False))


def date_range(date: Column, low: tuple[int, int, int] | None, high: tuple[int, int, int] | None) -> Column:
    """Violated if all days that the date may mean lie outside."""
    number = lambda y, m, d: y * 10_000 + m * 100 + d
    first = number(date["year"], F.greatest(date["month"], F.lit(1)), F.greatest(date["day"], F.lit(1)))
    last = number(date["year"], F.when(date["month"] == 0, 12).otherwise(date["month"]), F.when(date["day"] == 0, 31).otherwise(date["day"]))
    out = F.lit(False)
    if low is not None:
        out = out | (last < number(low[0], max(low[1], 1), max(low[2], 1)))
    if high is not None:
        out = out | (first > number(high[0], high[1] or 12, high[2] or 31))
    return F.coalesce(out, F.lit(False))


# rules on the item's own statements


def _ranks(rows: DataFrame, claims: DataFrame, send: bool | None) -> DataFrame:
    held = reduced(claims, rows, {"property": "property", "item": "item"}) if send else claims
    own = held.groupBy("property", "item").agg(F.max(F.col("rank") != "deprecated").alias("_any"), F.max(F.col("rank") == "normal").alias("_normal"), F.max(F.col("rank") == "preferred").alias("_preferred"))
    return rows.join(own, ["property", "item"])


def single_value(rows: DataFrame, claims: DataFrame, send: bool | None = None) -> DataFrame:
    return _ranks(rows, claims, send).where("_any").select("row_id")


def single_best_value(rows: DataFrame, claims: DataFrame, send: bool | None = None) -> DataFrame:
    return _ranks(rows, claims, send).where("_normal AND NOT _preferred").select("row_id")


def _having(claims: DataFrame, prop: str, values: list[str] | None) -> DataFrame:
    """Statements of a property, of any rank, with one of the values if there are any."""
    have = claims.where(F.col("property") == prop)
    return have.where(F.col("item_value").isin(*values)) if values else have


def _near(claims: DataFrame, rows: DataFrame, column: str, send: bool | None) -> DataFrame:
    """The claims of the rows' items (or of the items in another column), if these may be sent."""
    return reduced(claims, rows, {"item": column}) if send else claims


def item_requires_statement(rows: DataFrame, claims: DataFrame, required: str, values: list[str] | None = None, send: bool | None = None) -> DataFrame:
    return rows.join(_near(_having(claims, required, values), rows, "item", send), "item", "left_anti").select("row_id")


def conflicts_with(rows: DataFrame, claims: DataFrame, other: str, values: list[str] | None = None, send: bool | None = None) -> DataFrame:
    return rows.join(_near(_having(claims, other, values), rows, "item", send), "item", "left_semi").select("row_id")


def declared_conflicts(rows: DataFrame, claims: DataFrame, conflicts: DataFrame, send: bool | None = None) -> DataFrame:
    """Conflicts that properties on the item declare with ours. conflicts: property, with_property, with_value (an item; null: any)."""
    mine = rows.join(conflicts, (rows["property"] == conflicts["with_property"]) & (conflicts["with_value"].isNull() | (rows["v_item"] == conflicts["with_value"])))
    mine = mine.select("row_id", "item", conflicts["property"].alias("_declares"))
    have = _near(claims, rows, "item", send).select(F.col("item").alias("_item"), F.col("property").alias("_has")).distinct()
    return mine.join(have, (F.col("item") == F.col("_item")) & (F.col("_declares") == F.col("_has")), "left_semi").select("row_id").distinct()


# rules on other items


def distinct_values(rows: DataFrame, claims: DataFrame, values: DataFrame | None = None, send: bool | None = None) -> DataFrame:
    """Another item has the value, an item or a text that is in no language. Holders are reduced to their least and greatest per value, so a frequent value joins as one row.

    values: the claims laid out by value (`claims.values_of`)."""
    said = text_rows(rows)
    mine = rows.select("row_id", "item", "property", F.when(F.col("v_item").isNotNull(), "v_item").otherwise("v_text").alias("kind"), F.coalesce("v_item", said).alias("value")).where("value IS NOT NULL")
    held = values_of(claims) if values is None else values
    if send:
        held = reduced(held, mine, {"property": "property", "kind": "kind", "value": "value"})
    holders = held.groupBy("property", "kind", "value").agg(F.min("item").alias("_a"), F.max("item").alias("_b"))
    return mine.join(holders, ["property", "kind", "value"]).where("_a <> item OR _b <> item").select("row_id")


def inverse(rows: DataFrame, claims: DataFrame, inverse_property: str | None = None, send: bool | None = None) -> DataFrame:
    """The value's item doesn't point back, by the inverse property (symmetric: the same one), in a statement of its best rank."""
    asked = rows.where("v_item IS NOT NULL").withColumn("_wanted", F.lit(inverse_property) if inverse_property else F.col("property"))
    held = claims.where(F.col("property") == inverse_property) if inverse_property else claims
    back = truthy(_near(held, asked, "v_item", send)).select(F.col("item").alias("_value"), F.col("property").alias("_property"), F.col("item_value").alias("_item"))
    same = (back["_property"] == asked["_wanted"]) & (asked["v_item"] == back["_value"]) & (asked["item"] == back["_item"])
    if not send:  # the keys of the layout only, so that statements stay where they are; the third condition is no key in this form
        same = (back["_property"] == asked["_wanted"]) & (asked["v_item"] == back["_value"]) & F.array_contains(F.array(back["_item"]), asked["item"])
    return asked.join(back, same, "left_anti").select("row_id")


def value_requires_statement(rows: DataFrame, claims: DataFrame, required: str, values: list[str] | None = None, send: bool | None = None) -> DataFrame:
    asked = rows.where("v_item IS NOT NULL")
    have = _having(truthy(_near(claims.where(F.col("property") == required), asked, "v_item", send)), required, values).select(F.col("item").alias("_value"))
    return asked.join(have, F.col("v_item") == F.col("_value"), "left_anti").select("row_id")


def type_(rows: DataFrame, claims: DataFrame, subclass: DataFrame | None, classes: list[str], relation: tuple[str, ...] = ("P31",), of: str = "item", below: DataFrame | None = None, send: bool | None = None) -> DataFrame:
    """The item (or, for value type, the value's item: of "v_item") is in none of the classes; no class is no limit. below (node): the classes and their subclasses, where these are known."""
    if not classes:
        return rows.select("row_id").limit(0)
    asked = rows.where(F.col(of).isNotNull())
    items = asked.select(F.col(of).alias("item")).distinct()
    near = _near(claims.where(F.col("property").isin(*relation)), asked, of, send)
    fine = members(items, near, below, relation) if below is not None else in_classes(items, near, subclass, classes, relation)
    return asked.join(fine.select(F.col("item").alias("_fine")), F.col(of) == F.col("_fine"), "left_anti").select("row_id")


def commons_link(rows: DataFrame, pages: DataFrame, namespace: str | None = None, send: bool | None = None) -> DataFrame:
    """A text value (in no language) without a page of its name. pages: namespace, title."""
    there = pages.where(F.col("namespace") == (namespace or ""))
    asked = rows.withColumn("_text", text_rows(rows)).where("_text IS NOT NULL")
    there = (reduced(there, asked, {"title": "_text"}) if send else there).select(F.col("title").alias("_title"))
    return asked.join(there, F.col("_text") == F.col("_title"), "left_anti").select("row_id")


def first_violation(rows: DataFrame, rules: list[tuple]) -> DataFrame:
    """rows with `violation`: the first violated rule in the order of definition. Local rules are columns; the others join once each.

    rules: (name, condition or violating row ids, items that are spared (optional)).
    """
    out, tests = rows, []
    for i, (name, rule, *spare) in enumerate(rules):
        spared = F.col("item").isin(*spare[0]) if spare and spare[0] else F.lit(False)
        if isinstance(rule, DataFrame):
            found = rule.select(F.col("row_id").alias(f"_id{i}")).distinct()
            out = out.join(found, out["row_id"] == found[f"_id{i}"], "left")
            tests.append(F.when(F.col(f"_id{i}").isNotNull() & ~spared, F.lit(name)))
        else:
            tests.append(F.when(rule & ~spared, F.lit(name)))
    if not tests:
        return rows.withColumn("violation", F.lit(None).cast("string"))
    return out.withColumn("violation", F.coalesce(*tests)).select(*rows.columns, "violation")


# from definitions to rules

# Qualifiers of a constraint, and the items that name a relation.
ITEMS, PROPERTIES, PATTERN, CLASSES, RELATION, SCOPES, EXCEPTIONS, NAMESPACE = "P2305", "P2306", "P1793", "P2308", "P2309", "P5314", "P2303", "P2307"
LOW_DATE, HIGH_DATE, HIGH_AMOUNT, LOW_AMOUNT = "P2310", "P2311", "P2312", "P2313"
SUBCLASS_ONLY, EITHER = "Q21514624", "Q30208840"


@dataclass(frozen=True)
class Definition:
    """One constraint of a property. qualifiers: property to its values; a value is a text (id, string, amount, time), None for no value, NOW for an unknown one."""

    kind: str
    status: str = "normal"
    qualifiers: dict[str, list[str | None]] = field(default_factory=dict)

    def ids(self, prop: str, letter: str = "Q") -> list[str]:
        return [v for v in self.qualifiers.get(prop, []) if v and re.fullmatch(rf"{letter}[0-9]+", v)]

    def first(self, prop: str) -> str | None:
        return next(iter(self.qualifiers.get(prop, [])), None)


NOW = "unknown value"


@dataclass
class World:
    """What rules that join read. classes: item, property, item_value, rank (defaults to claims); subclass: child, parent; pages: namespace, title; conflicts: see declared_conflicts; values: the claims by value
    (`claims.ClaimTable`). send: are the rows few enough for their keys to be sent to all tasks (None: not known)? below: which groups of classes are above a class (`closure.reached`), and the groups. properties: those of the run's fields, if they are known."""

    claims: DataFrame
    classes: DataFrame | None = None
    subclass: DataFrame | None = None
    pages: DataFrame | None = None
    conflicts: DataFrame | None = None
    today: datetime.date | None = None
    values: DataFrame | None = None
    send: bool | None = None
    below: tuple[DataFrame, list[list[str]]] | None = None
    properties: tuple[str, ...] = ()

    def own(self, statements: DataFrame | None = None) -> DataFrame:
        """Statements of the run's own properties; the filter goes down to their scan."""
        statements = self.claims if statements is None else statements
        return statements.where(F.col("property").isin(*self.properties)) if self.properties else statements


def _date(text: str | None, today: datetime.date | None) -> tuple[int, int, int] | None:
    """(year, month, day) of a bound as it is stored, 0 for unknown; an unknown value stands for today."""
    if text == NOW:
        now = today or datetime.datetime.now(datetime.UTC).date()
        return now.year, now.month, now.day
    m = re.match(r"\+([0-9]+)-([0-9]+)-([0-9]+)", text or "")
    return (int(m[1]), int(m[2]), int(m[3])) if m else None


def _number(text: str | None) -> float | None:
    try:
        return float(text) if text is not None and text != NOW else None
    except ValueError:
        return None


def _range(d: Definition, w: World) -> Column:
    low, high = _date(d.first(LOW_DATE), w.today), _date(d.first(HIGH_DATE), w.today)
    return amount_range(F.col("v_amount"), _number(d.first(LOW_AMOUNT)), _number(d.first(HIGH_AMOUNT))) | date_range(F.col("v_date"), low, high)


def _conflicts(d: Definition, r: DataFrame, w: World) -> DataFrame | Column:
    other = next(iter(d.ids(PROPERTIES, "P")), None)
    parts = [conflicts_with(r, w.claims, other, d.ids(ITEMS), w.send)] if other else []
    parts += [declared_conflicts(r, w.claims, w.conflicts, w.send)] if w.conflicts is not None else []
    return parts[0].union(parts[1]) if len(parts) > 1 else parts[0] if parts else F.lit(False)


def _typed(d: Definition, r: DataFrame, w: World, of: str) -> DataFrame:
    relation = {SUBCLASS_ONLY: ("P279",), EITHER: ("P31", "P279")}.get(next(iter(d.ids(RELATION)), ""), ("P31",))
    classes = sorted(set(d.ids(CLASSES)))
    below = None
    if w.below is not None and classes in w.below[1]:
        below = w.below[0].where(F.col("groups").bitwiseAND(F.lit(1 << w.below[1].index(classes))) != 0)
    return type_(r, w.classes if w.classes is not None else w.claims, w.subclass, classes, relation, of, below, w.send)


def _with_property(d: Definition, build: Callable) -> DataFrame | Column:
    """A rule that needs a property in its definition is never violated without one."""
    prop = next(iter(d.ids(PROPERTIES, "P")), None)
    return F.lit(False) if prop is None else build(prop)


#: What each kind makes of (definition, rows, world).
BUILD: dict[str, Callable] = {
    "allowed entity types": lambda d, r, w: allowed_entity_types(d.ids(ITEMS)),
    "allowed qualifiers": lambda d, r, w: allowed_qualifiers(F.col("used"), d.ids(PROPERTIES, "P")),
    "allowed units": lambda d, r, w: allowed_units(F.col("v_amount"), F.col("v_unit"), d.qualifiers.get(ITEMS, [])),
    "citation needed": lambda d, r, w: never(),
    "Commons link": lambda d, r, w: commons_link(r, w.pages, d.first(NAMESPACE), w.send),
    "conflicts with": _conflicts,
    "distinct values": lambda d, r, w: distinct_values(r, w.own(), None if w.values is None else w.own(w.values), w.send),
    "format": lambda d, r, w: format_(F.col("v_text"), d.first(PATTERN)) if d.first(PATTERN) is not None else F.lit(False),
    "integer": lambda d, r, w: integer(F.col("v_amount")),
    "inverse": lambda d, r, w: _with_property(d, lambda p: inverse(r, w.claims, p, w.send)),
    "item requires statement": lambda d, r, w: _with_property(d, lambda p: item_requires_statement(r, w.claims, p, d.ids(ITEMS), w.send)),
    "mandatory qualifier": lambda d, r, w: mandatory_qualifier(F.col("used"), d.ids(PROPERTIES, "P")),
    "no bounds": lambda d, r, w: never(),
    "none of": lambda d, r, w: none_of(F.col("v_item"), d.ids(ITEMS)),
    "one of": lambda d, r, w: one_of(F.col("v_item"), d.ids(ITEMS)),
    "property scope": lambda d, r, w: property_scope(d.ids(SCOPES)),
    "range": lambda d, r, w: _range(d, w),
    "single value": lambda d, r, w: single_value(r, w.own(), w.send),
    "single best value": lambda d, r, w: single_best_value(r, w.own(), w.send),
    "symmetric": lambda d, r, w: inverse(r, w.own(), None, w.send),
    "type": lambda d, r, w: _typed(d, r, w, "item"),
    "value requires statement": lambda d, r, w: _with_property(d, lambda p: value_requires_statement(r, w.claims, p, d.ids(ITEMS), w.send)),
    "value type": lambda d, r, w: _typed(d, r, w, "v_item"),
}


def selected(definitions: list[Definition], chosen: tuple[str, ...] | None = None) -> list[Definition]:
    """Those of known kinds that are mandatory, or normal and chosen (None: all normal ones); suggestions are not checked."""
    return [d for d in definitions if d.kind in NAMES and (d.status == "mandatory" or d.status == "normal" and (chosen is None or d.kind in chosen))]


def rules(definitions: list[Definition], rows: DataFrame, world: World) -> list[tuple]:
    """What first_violation takes, in the order of definition; kinds that aren't known are left out."""
    return [(NAMES[d.kind], BUILD[NAMES[d.kind]](d, rows, world), d.ids(EXCEPTIONS)) for d in definitions if d.kind in NAMES]


def with_classes(definitions: list[Definition], world: World) -> World:
    """world with the classes below those that any of the definitions names, found in one walk."""
    groups = sorted({tuple(sorted(set(d.ids(CLASSES)))) for d in definitions if NAMES.get(d.kind) in ("type", "value type") and d.ids(CLASSES)})
    if not groups or world.subclass is None or len(groups) > 62:
        return world
    listed = [list(g) for g in groups]
    return replace(world, below=(reached(listed, world.subclass.select(F.col("parent").alias("src"), F.col("child").alias("dst"))), listed))


def violations(rows: DataFrame, tests: list[tuple], world: World, claims: DataFrame) -> DataFrame | None:
    """(row_id, violation) of the rows that violate a rule: the first one in the order of definition; None without rules.

    tests: (field, rule), where a rule is a Definition, or (name, f) with f(rows, claims) a condition or violating row ids. Rows have their field. Conditions are columns; a rule
    that joins is a stage: rows that have violated an earlier rule, and rows of other fields, have left before it. What is left is checkpointed after each
    stage, so a stage never repeats those before it.
    """
    if not tests:
        return None
    defined = [r for _, r in tests if isinstance(r, Definition)]
    world = with_classes(defined, replace(world, send=rows.limit(MOST_SENT + 1).count() <= MOST_SENT if world.send is None else world.send))
    found, left, waiting = [], rows, []

    def settle(marks: Column, ids: DataFrame | None = None) -> None:
        nonlocal left
        marked = left if ids is None else left.join(ids.select(F.col("row_id").alias("_hit")).distinct(), F.col("row_id") == F.col("_hit"), "left")
        marked = checkpointed(marked.withColumn("violation", marks).drop("_hit"))
        found.append(marked.where("violation IS NOT NULL").select("row_id", "violation"))
        left = marked.where("violation IS NULL").drop("violation")

    for i, rule in tests:
        mine = F.col("field") == i
        if isinstance(rule, Definition):
            if rule.kind not in NAMES:
                continue
            name, spared = NAMES[rule.kind], rule.ids(EXCEPTIONS)
            build = lambda r, rule=rule, name=name: BUILD[name](rule, r, world)
            mine = mine & ~F.col("item").isin(*spared) if spared else mine
        else:
            name, build = rule[0], lambda r, rule=rule: rule[1](r, claims)
        test = build(left.where(mine))
        if isinstance(test, Column):
            waiting.append(F.when(mine & test, F.lit(name)))
            continue
        if waiting:
            settle(F.coalesce(*waiting))
            waiting, test = [], build(left.where(mine))
        settle(F.when(F.col("_hit").isNotNull(), F.lit(name)), test)
    if waiting:
        found.append(left.withColumn("violation", F.coalesce(*waiting)).where("violation IS NOT NULL").select("row_id", "violation"))
    out = found[0] if found else None
    for part in found[1:]:
        out = out.union(part)
    return out
