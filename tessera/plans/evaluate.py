"""From candidate pages to outcomes: extract, parse, check, and plan the statements of all fields of a job.

No row is dropped. A row keeps its raw value, its value, a status (ready, skipped, error) and the message of the first step that
rejected it. Specifications are constant, so the branch for each field's datatype is chosen while the plan is built, and only the lookups that
these datatypes need are joined, each once for all fields. Pages are read once: one call per page gives the parameters that any field asks for, texts are dropped, every field becomes a narrow
typed row, and these are checkpointed once, before they meet claims, constraints and history; so no later join carries a text or repeats the Python part, and
a job with four properties reads and parses its pages as often as one with one.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.functions import text as T
from tessera.functions import wikitext as W
from tessera.operators import constraints, existing
from tessera.sources import lookups

from .job import JobSpec, for_extra
from .lineage import checkpointed, spread

SKIPS = ("the page has no Wikidata item", "template not found", "no value", "the item already has this value", "the item already has the property", "a link to an archived copy", "this value was removed from the item before")


GONE = "the item does not exist"


@dataclass
class Catalog:
    """What lookups read, and the wiki that pages are on. claims: item, property, rank, item_value, text_value, amount, unit, year, month, day, latitude, longitude,
    precision (of the date; null or missing: a day) and language (of a text; null or missing: it has none)."""

    claims: DataFrame
    #: title, item (null: the page has none)
    link_targets: DataFrame | None = None
    #: name, shared (true: in the shared repository)
    files: DataFrame | None = None
    #: name (lower case), unit
    units: DataFrame | None = None
    #: item, rev, comment
    history: DataFrame | None = None
    prefixes: tuple[str, ...] = ("Template",)
    file_prefixes: tuple[str, ...] = ("File", "Image")
    months: dict[str, int] = field(default_factory=lambda: N.abbreviated(N.ENGLISH))
    host: str = "en.wikipedia.org"
    dbname: str = "enwiki"
    language: str = "en"
    edition: str | None = "Q328"
    #: names of namespaces by number
    namespaces: dict[int, str] = field(default_factory=dict)
    #: does the first letter of a template's name count in upper case only?
    first_letter: bool = True
    #: another parser's answers: text, language, year, month, day, precision
    dates: DataFrame | None = None
    #: what rules that join read besides claims
    world: constraints.World | None = None
    #: merged items: from_item, to_item
    merges: DataFrame | None = None
    #: items that there are: item (None: all)
    items: DataFrame | None = None


@dataclass(frozen=True)
class Field:
    """One property of a job. datatypes: those of its qualifiers' properties; units: names of the units that its values may carry (name, unit)."""

    spec: JobSpec
    datatype: str
    rules: Sequence = ()
    datatypes: dict[str, str] = field(default_factory=dict)
    units: DataFrame | None = None


PLACE = "struct<latitude:double,longitude:double,precision:double>"
#: What is read of a value before anything is looked up.
DRAFT = {
    "raw_value": "string", "missing": "boolean", "text": "string", "link": "string", "file": "string", "amount": "string", "unit_text": "string", "unit_key": "string", "date": N.DATE, "date_error": "string",
    "place": PLACE, "url_error": "string",
}
TYPED = ("v_item", "v_text", "v_amount", "v_unit", "v_date", "v_place", "parse_error", "value")


def _wanted(fields: Sequence[Field]) -> tuple[list[str], list[int]]:
    """Names of all parameters that the fields read, and numbers from which on they read unnamed ones."""
    names, runs = set(), set()
    for f in fields:
        s = f.spec
        names |= {n for n in (*s.parameters, *(s.date_parameters or ()), *(s.coordinate_parameters or ())) if n}
        names |= set(re.findall(r"\{([^{}]*)\}", s.value_pattern))
        names |= {n for _, kind, text in s.qualifiers if kind == "param" for n in text.split(",")}
        if f.datatype == "globe-coordinate":
            runs |= {int(n.strip()) for n in s.parameters if n.strip().isdigit()}
    return sorted(n.strip() for n in names), sorted(runs)


def _raw(f: Field, catalog: Catalog) -> tuple[list[Column], Column]:
    """(what the value is read from: one text, or the parts of a date or of a coordinate; is there none?)"""
    spec, raw, clean = f.spec, F.col("_raw"), F.col("_clean")
    if spec.use_page_title:
        space = catalog.namespaces.get(spec.namespace)
        parts = [F.when(F.startswith("title", F.lit(f"{space}:")), F.substr("title", F.lit(len(space) + 2))).otherwise(F.col("title")) if space else F.col("title")]
        return parts, F.lit(False)
    if spec.date_parameters:
        parts = [F.try_element_at(clean, F.lit(n.strip())) if n else F.lit(None).cast("string") for n in spec.date_parameters]
        return parts, parts[0].isNull()
    if spec.coordinate_parameters:
        parts = [W.first_of(raw, [n]) for n in spec.coordinate_parameters]
        return parts, parts[0].isNull() | parts[1].isNull()
    if spec.value_pattern:
        part = W.value_pattern(clean, spec.value_pattern)
    elif f.datatype == "globe-coordinate":  # an unnamed parameter brings the unnamed ones after it along
        run = lambda n: F.array_join(F.transform(F.sequence(F.lit(int(n)), _run_end(raw, int(n))), lambda i: F.try_element_at(raw, i.cast("string"))), " ")
        part = F.coalesce(*(F.when(W.first_of(raw, [n]).isNotNull(), run(n.strip()) if n.strip().isdigit() else W.first_of(raw, [n])) for n in spec.parameters))
    else:
        # the first parameter with a value decides, even if nothing is left of it
        part = F.nullif(F.coalesce(*(F.when(W.first_of(raw, [n]).isNotNull(), F.try_element_at(clean, F.lit(n.strip()))) for n in spec.parameters)), F.lit(""))
    return [part], part.isNull()


def _run_end(raw: Column, first: int) -> Column:
    """The last number of an unbroken run of unnamed parameters."""
    numbers = F.array_sort(F.filter(F.transform(F.map_keys(raw), lambda k: F.when(k.rlike(r"^[1-9][0-9]{0,8}\z"), k.cast("int"))), lambda k: k >= first))
    return F.aggregate(numbers, F.lit(first), lambda end, k: F.when(k == end + 1, k).otherwise(end))


def _shaped(text: Column, spec: JobSpec) -> Column:
    return F.nullif(F.trim(T.transform(text, spec.add_prefix, spec.add_suffix, spec.remove_prefix, spec.remove_suffix, spec.search, spec.replacement, spec.case)), F.lit(""))


def _draft(datatype: str, spec: JobSpec, catalog: Catalog, parts: list[Column], missing: Column, place: Column | None, months: dict[str, int] | None = None, archived: bool = True) -> Column:
    """struct of DRAFT. place: of a coordinate; parts: texts, shaped already."""
    out = {c: F.lit(None).cast(kind) for c, kind in DRAFT.items()}
    text = parts[0]
    months = catalog.months if months is None else months
    out["missing"] = missing if spec.date_parameters or spec.coordinate_parameters else missing | text.isNull()
    out["text"] = text
    if datatype == "wikibase-item":
        out["link"] = T.title(T.link_target(text, spec.plain_links, spec.link_choice == "last"))
    elif datatype == "url":
        found = T.web_url(text, spec.archive_urls if archived else "keep")
        out |= {"text": found["value"], "url_error": found["rejection"]}
    elif datatype == "commonsMedia":
        out["file"] = T.file_name(text, catalog.file_prefixes)
    elif datatype == "time" and spec.date_parameters:
        date = N.date_from_parts(*parts, months, spec.julian)
        year = F.trim(T.to_ascii_digits(F.coalesce(text, F.lit("")))).rlike(r"^[+-]?[0-9]+\z")
        out |= {"date": date, "date_error": F.when(year, F.when(date.isNull(), "invalid date")).otherwise("could not find a date")}
    elif datatype == "time":
        found = N.parse_date(text, months, spec.julian)
        out |= {"date": found["date"], "date_error": found["error"]}
    elif datatype == "quantity":
        split = N.split_unit(text)
        out |= {"amount": N.amount(split["number"], spec.decimal_comma), "unit_text": split["unit"], "unit_key": N.unit_key(split["unit"])}
    elif datatype == "globe-coordinate":
        out["place"] = place
    return F.struct(*(c.cast(DRAFT[k]).alias(k) for k, c in out.items()))


def _met(rows: DataFrame, key: Column, table: DataFrame, name: str, values: dict[str, str]) -> DataFrame:
    """rows with columns of the table's row of the key (of several, the one with the greatest values); rows without a key are spread by their page, and no row is repeated."""
    known = table.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("_name")).agg(F.max(F.struct(*(F.col(c).alias(k) for k, c in values.items()))).alias("_known"))
    asked = rows.withColumn("_of", F.coalesce(key, F.concat(F.lit("\x00"), F.col("page_id").cast("string"))))
    return asked.join(known, F.col("_of") == F.col("_name"), "left").withColumns({k: F.col(f"_known.{k}") for k in values} | {"_there": F.col("_name").isNotNull()}).drop("_of", "_name", "_known")


def _typed(rows: DataFrame, d: str, datatype: Column | str, kinds: set[str], spec: JobSpec, unit: Column, catalog: Catalog, units: DataFrame | None, prefix: str = "", limit: bool = True) -> DataFrame:
    """rows with the typed columns of the drafts in column d, of the kinds; lookups are joined here. unit: what a number without one gets; units: owner, name, unit."""
    c = lambda name: F.col(f"{d}.{name}")
    is_kind = (lambda k: F.col(datatype) == k) if isinstance(datatype, str) and datatype not in kinds else (lambda k: F.lit(k in kinds))
    none = lambda kind: F.lit(None).cast(kind)
    typed = {"v_item": none("string"), "v_text": none("string"), "v_amount": none("string"), "v_unit": none("string"), "v_date": none(N.DATE), "v_place": none(PLACE)}
    errors = [c("url_error")]
    texts = kinds & {"string", "external-id", "monolingualtext", "url"}
    if texts:
        typed["v_text"] = F.coalesce(*(F.when(is_kind(k), c("text")) for k in sorted(texts)))
    if "wikibase-item" in kinds:
        rows = _met(rows, F.when(is_kind("wikibase-item"), c("link")), catalog.link_targets, "title", {"_target": "item"}).withColumnRenamed("_there", "_linked")
        named = lambda says: F.concat(F.lit("[["), c("link"), F.lit(f"]] {says}"))
        typed["v_item"] = F.when(is_kind("wikibase-item"), F.col("_target"))
        errors.append(F.when(is_kind("wikibase-item"), (
            F.when(c("link").isNull(), F.when(F.contains(c("text"), F.lit("#")), "link to a section, not a page").otherwise("no link to a target page"))
            .when(~F.col("_linked"), named("does not exist")).when(F.col("_target").isNull(), named("has no Wikidata item"))
            .when(F.col("_target") == F.col("item"), "the link points to the page itself")
        )))
    if "commonsMedia" in kinds:
        rows = _met(rows, F.when(is_kind("commonsMedia"), c("file")), catalog.files, "name", {"_shared": "shared"}).withColumnRenamed("_there", "_filed")
        typed["v_text"] = F.coalesce(typed["v_text"], F.when(is_kind("commonsMedia"), c("file")))
        errors.append(F.when(is_kind("commonsMedia"), F.when(c("file").isNull(), "not a file name").when(~F.col("_filed"), "the file does not exist").when(~F.col("_shared"), f"the file is only on {catalog.dbname}, not on Commons")))
    if "time" in kinds:
        rows = rows.withColumn("_d", F.struct(c("date").alias("date"), c("date_error").alias("error")))
        if catalog.dates is not None:
            rows = _helped(rows, F.when(is_kind("time"), c("text")), catalog)
        outside = F.lit(False) if spec.date_limit is None or not limit else ~N.within_limit(F.col("_d.date"), spec.date_limit, not spec.limit_before)
        typed["v_date"] = F.when(is_kind("time"), F.col("_d.date"))
        errors.append(F.when(is_kind("time"), F.coalesce("_d.error", F.when(outside, "date outside the configured range"))))
    if "quantity" in kinds:
        if units is not None:
            rows = _met(rows, F.when(is_kind("quantity"), F.concat(F.col("_owner"), F.lit("\x00"), c("unit_key"))), units.withColumn("_key", F.concat("owner", F.lit("\x00"), "name")), "_key", {"_named": "unit"}).drop("_there")
        else:
            rows = rows.withColumn("_named", none("string"))
        typed["v_amount"] = F.when(is_kind("quantity"), c("amount"))
        typed["v_unit"] = F.when(is_kind("quantity") & c("amount").isNotNull(), F.when(c("unit_text").isNull(), unit).otherwise(F.col("_named")))
        errors.append(F.when(is_kind("quantity"), F.when(c("amount").isNull(), "unclear number").when(c("unit_text").isNotNull() & F.col("_named").isNull(), F.concat(F.lit("unknown unit '"), c("unit_text"), F.lit("'")))))
    if "globe-coordinate" in kinds:
        typed["v_place"] = F.when(is_kind("globe-coordinate"), c("place"))
        errors.append(F.when(is_kind("globe-coordinate") & c("place").isNull(), "could not find a coordinate"))
    rows = rows.withColumns({f"{prefix}{k}": v for k, v in typed.items()} | {f"{prefix}parse_error": F.coalesce(*errors)})
    return rows.drop("_target", "_linked", "_shared", "_filed", "_d", "_named")


def _helped(rows: DataFrame, text: Column, catalog: Catalog) -> DataFrame:
    """_d with another parser's date where ours found none, or only a year in a text that says more, if it agrees on the year."""
    asked = rows.withColumn("_said", text)
    known = lookups.external_dates(asked.where("_said IS NOT NULL").select(F.col("_said").alias("text"), F.lit(catalog.language).alias("language")).distinct(), catalog.dates)
    met = _met(asked, F.col("_said"), known.where("external IS NOT NULL"), "text", {"_external": "external"}).drop("_there")
    d, other = F.col("_d"), F.col("_external")
    more = (N.precision(d["date"]) == 9) & ~F.trim("_said").rlike(r"^[0-9]*\z") & (other["year"] == d["date"]["year"]) & (N.precision(other) > 9)
    use = other.isNotNull() & ((d["error"] == "could not find a date") | F.coalesce(more, F.lit(False)))
    return met.withColumn("_d", F.when(use, F.struct(other.cast(N.DATE).alias("date"), F.lit(None).cast("string").alias("error"))).otherwise(d)).drop("_said", "_external")


def _shown(datatype: str, julian: bool, language: str, prefix: str = "") -> Column:
    """How a value is shown: dates with their calendar if it isn't the usual one, texts with their language, coordinates as precise as they are."""
    c = lambda name: F.col(f"{prefix}{name}")
    if datatype == "time":
        return F.concat(N.shown_date(c("v_date")), F.lit(" (Julian)" if julian else ""))
    if datatype == "quantity":
        return F.when(c("v_amount").isNotNull(), F.concat_ws(" ", c("v_amount"), c("v_unit")))
    if datatype == "monolingualtext":
        return F.concat(c("v_text"), F.lit(f" ({language})"))
    if datatype == "globe-coordinate":
        digits = F.least(F.greatest(F.ceil(-F.log10(c("v_place")["precision"])), F.lit(0)), F.lit(9)).cast("int")
        sized = lambda part: F.coalesce(*(F.when(digits == k, F.format_string(f"%.{k}f", c("v_place")[part])) for k in range(10)))
        return F.when(c("v_place").isNotNull(), F.concat_ws(", ", sized("latitude"), sized("longitude")))
    return F.coalesce(c("v_item"), c("v_text"))


def fixed_value(datatype: str, text: str, spec: JobSpec) -> tuple[dict[str, Column], str]:
    """(typed columns of a typed-in value, its language): it is read in English, as a whole, and no archive rule holds. A column of the value's kind that is null means that the text is no value."""
    text = text.strip()
    said, value = F.lit(text), {"v_item": "string", "v_text": "string", "v_amount": "string", "v_unit": "string", "v_date": N.DATE, "v_place": PLACE}
    out, language = {k: F.lit(None).cast(kind) for k, kind in value.items()}, spec.language
    if datatype == "wikibase-item":
        out["v_item"] = F.lit(text if re.fullmatch(r"Q[1-9][0-9]*", text) else None).cast("string")
    elif datatype == "time":
        out["v_date"] = N.parse_date(said, N.abbreviated(N.ENGLISH), spec.julian)["date"]
    elif datatype == "quantity":
        out["v_amount"] = N.amount(said)
    elif datatype == "globe-coordinate":
        out["v_place"] = N.parse_coordinate(said)
    elif datatype == "url":
        out["v_text"] = T.url(said)
    elif datatype == "monolingualtext":
        text, at, language = text.rpartition("@")
        out["v_text"] = F.lit(text if at and re.fullmatch(r"[a-z][a-z0-9-]{0,19}", language) else None).cast("string")
    else:
        out["v_text"] = F.lit(text or None).cast("string")
    return out, language


def _language(kind: str, datatype: str, text: str, spec: JobSpec) -> str:
    return fixed_value(datatype, text, spec)[1] if kind == "fixed" else spec.language


def _qualified(rows: DataFrame, main: Field, catalog: Catalog, units: DataFrame | None) -> DataFrame:
    """rows with the typed columns and the text of each qualifier of the main field, prefixed q0_, q1_, ..."""
    spec = main.spec
    for i, (prop, kind, text) in enumerate(spec.qualifiers):
        datatype = main.datatypes[prop]
        if kind == "fixed":
            typed, language = fixed_value(datatype, text, spec)
            rows = rows.withColumns({f"q{i}_{k}": v for k, v in typed.items()} | {f"q{i}_parse_error": F.lit(None).cast("string")})
            there = F.lit(True)
        else:
            language = spec.language
            rows = _typed(rows, f"_q{i}", datatype, {datatype}, spec, F.lit(None).cast("string"), catalog, units, f"q{i}_")
            there = ~F.col(f"_q{i}.missing")
        own = F.when(there & (F.col("field") == 0) & F.col(f"q{i}_parse_error").isNull(), _shown(datatype, spec.julian, language, f"q{i}_"))
        rows = rows.withColumn(f"q{i}_value", own).withColumn(f"q{i}_parse_error", F.when(there & (F.col("field") == 0), F.col(f"q{i}_parse_error"))).drop(f"_q{i}")
    return rows


def _same(datatype: str, language: str = "") -> Column:
    """Does an existing claim (c_ columns) have the row's value?"""
    if datatype == "wikibase-item":
        return F.col("v_item") == F.col("c_item_value")
    if datatype == "time":
        fine = F.coalesce("c_precision", F.lit(11))
        known = F.struct(F.col("c_year").alias("year"), F.when(fine >= 10, F.col("c_month")).otherwise(0).alias("month"), F.when(fine >= 11, F.col("c_day")).otherwise(0).alias("day"))
        return N.same_date(F.col("v_date"), known)
    if datatype == "quantity":
        return N.same_amount(F.col("v_amount"), F.col("c_amount"))
    if datatype == "globe-coordinate":
        return N.same_coordinate(F.col("v_place.latitude"), F.col("v_place.longitude"), F.col("c_latitude"), F.col("c_longitude"), F.col("v_place.precision"))
    same = F.col("v_text") == F.col("c_text_value")
    # a text in a language is the same only in that language
    return same & F.col("c_language").eqNullSafe(F.lit(language)) if datatype == "monolingualtext" else same


def _snak(prop: str, datatype: str, language: str = "", julian: bool = False, prefix: str = "") -> Column:
    """The snak of a property with the value in the typed columns."""
    c = lambda name: F.col(f"{prefix}{name}")
    kinds = {"wikibase-item": "wikibase-entityid", "time": "time", "quantity": "quantity", "monolingualtext": "monolingualtext", "globe-coordinate": "globecoordinate"}
    if datatype == "wikibase-item":
        value = F.struct(F.lit("item").alias("entity-type"), F.substr(c("v_item"), F.lit(2)).cast("bigint").alias("numeric-id"), c("v_item").alias("id"))
    elif datatype == "time":
        calendar = F.lit(f"http://www.wikidata.org/entity/{'Q1985786' if julian else 'Q1985727'}")
        value = F.struct(N.wire_time(c("v_date")).alias("time"), F.lit(0).alias("timezone"), F.lit(0).alias("before"), F.lit(0).alias("after"), N.precision(c("v_date")).alias("precision"), calendar.alias("calendarmodel"))
    elif datatype == "quantity":
        value = F.struct(c("v_amount").alias("amount"), F.coalesce(F.concat(F.lit("http://www.wikidata.org/entity/"), c("v_unit")), F.lit("1")).alias("unit"))
    elif datatype == "monolingualtext":
        value = F.struct(c("v_text").alias("text"), F.lit(language).alias("language"))
    elif datatype == "globe-coordinate":
        value = F.struct(*(c("v_place")[x].alias(x) for x in ("latitude", "longitude", "precision")), F.lit("http://www.wikidata.org/entity/Q2").alias("globe"))
    else:
        value = c("v_text")
    return _as_snak(prop, datatype, value, kinds.get(datatype, "string"))


def _as_snak(prop: str, datatype: str, value: Column, kind: str) -> Column:
    return F.struct(F.lit("value").alias("snaktype"), F.lit(prop).alias("property"), F.lit(datatype).alias("datatype"), F.struct(value.alias("value"), F.lit(kind).alias("type")).alias("datavalue"))


def statement_json(spec: JobSpec, datatype: str, catalog: Catalog, datatypes: dict[str, str]) -> Column:
    """The statement to be written, with its qualifiers and its reference: where it was read, and the revision."""
    link = T.permalink(F.lit(catalog.host), F.col("title"), F.col("revision_id"))
    snaks = {"P4656": _as_snak("P4656", "url", link, "string")}
    if catalog.edition is not None:
        edition = F.struct(F.lit("item").alias("entity-type"), F.lit(int(catalog.edition[1:])).alias("numeric-id"), F.lit(catalog.edition).alias("id"))
        snaks = {"P143": _as_snak("P143", "wikibase-item", edition, "wikibase-entityid")} | snaks
    reference = F.struct(F.struct(*(F.array(c).alias(p) for p, c in snaks.items())).alias("snaks"), F.array(*map(F.lit, snaks)).alias("snaks-order"))
    extra = []
    if spec.qualifiers:
        listed: dict[str, list[Column]] = {}
        for i, (prop, kind, text) in enumerate(spec.qualifiers):
            listed.setdefault(prop, []).append(F.when(F.col(f"q{i}_value").isNotNull(), _snak(prop, datatypes[prop], _language(kind, datatypes[prop], text, spec), spec.julian, f"q{i}_")))
        lists = {p: F.array_compact(F.array(*cs)) for p, cs in listed.items()}
        used = F.array_compact(F.array(*(F.when(F.size(v) > 0, F.lit(p)) for p, v in lists.items())))
        # to_json leaves nulls out, so only qualifiers with values are named
        extra = [F.when(F.size(used) > 0, F.struct(*(F.when(F.size(v) > 0, v).alias(p) for p, v in lists.items()))).alias("qualifiers"), F.when(F.size(used) > 0, used).alias("qualifiers-order")]
    main = _snak(spec.property, datatype, spec.language, spec.julian)
    return F.to_json(F.struct(F.lit("statement").alias("type"), F.lit("normal").alias("rank"), main.alias("mainsnak"), *extra, F.array(reference).alias("references")))


def summary_text(datatype: str, spec: JobSpec) -> Column:
    """How an edit summary writes the value; null where its form isn't known."""
    if datatype == "wikibase-item":
        return F.concat(F.lit("[["), F.col("v_item"), F.lit("]]"))
    if datatype == "time":
        month = F.element_at(F.array(*(F.lit(m.capitalize()) for m in N.ENGLISH)), F.greatest(F.col("v_date.month"), F.lit(1)))
        year = F.col("v_date.year").cast("string")
        return F.lit(None).cast("string") if spec.julian else F.when(F.col("v_date.month") == 0, year).when(F.col("v_date.day") == 0, F.concat_ws(" ", month, year)).otherwise(F.concat_ws(" ", F.col("v_date.day").cast("string"), month, year))
    return F.lit(None).cast("string") if datatype in ("quantity", "globe-coordinate") else F.col("v_text")


def drafts(pages: DataFrame, revisions: DataFrame, fields: Sequence[Field], catalog: Catalog) -> DataFrame:
    """A row per page and field: page_id, title, item, revision_id, field, property, datatype, _early (why the page gives nothing), _owner (whose units it may have), _draft, and _q0, _q1, ... of the
    main field's qualifiers that are read from the page. The revisions are scanned once and the markup is read once, whatever the number of fields."""
    main = fields[0].spec
    # (reading a page's markup costs far more than its bytes tell, and both sides come dealt alike, so the join moves nothing)
    rows = spread(pages, "page_id").join(spread(revisions, "page_id"), "page_id", "left")
    text = W.lead_section(F.col("text")) if main.lead_only else F.col("text")
    names = [main.template, *(main.template_redirects or ())] if main.template else []
    wanted, runs = _wanted(fields)
    read = W.page_values(text, names, wanted, runs, catalog.prefixes, catalog.first_letter, main.unwrap_templates) if names else F.lit(None).cast(W.VALUES)
    rows = rows.withColumn("_read", read).withColumn("_gone", F.col("text").isNull()).drop("text")
    rows = rows.withColumns({"_raw": F.col("_read.raw"), "_clean": F.col("_read.clean")}).drop("_read")
    values = [_raw(f, catalog) for f in fields]
    shaped = [parts if f.spec.date_parameters or f.spec.coordinate_parameters else [F.when(~missing, _shaped(parts[0], f.spec))] for f, (parts, missing) in zip(fields, values, strict=True)]
    asked = [(p, kind, t) for p, kind, t in main.qualifiers]
    said = [F.nullif(F.coalesce(*(F.when(W.first_of(F.col("_raw"), [n]).isNotNull(), F.try_element_at("_clean", F.lit(n.strip()))) for n in t.split(","))), F.lit("")) if kind == "param" else None for _, kind, t in asked]
    # coordinates: all their texts in one call
    places: dict[tuple[str, int], int] = {}
    texts: list[Column] = []
    for i, f in enumerate(fields):
        if f.datatype == "globe-coordinate":
            places["f", i] = len(texts)
            texts += shaped[i]
    for i, (p, kind, _) in enumerate(asked):
        if kind == "param" and fields[0].datatypes[p] == "globe-coordinate":
            places["q", i] = len(texts)
            texts.append(said[i])
    if texts:
        rows = rows.withColumn("_texts", W.coordinate_texts(F.array(*texts), catalog.prefixes))

    def place(key: str, i: int, parts: int = 1) -> Column | None:
        if (key, i) not in places:
            return None
        at = [F.get("_texts", F.lit(places[key, i] + k)) for k in range(parts)]
        return N.coordinate_from_parts(*at) if parts > 1 else N.parse_coordinate(at[0])

    listed = []
    for i, f in enumerate(fields):
        parts, missing = values[i]
        shown = F.nullif(F.concat_ws(" / ", *parts), F.lit(""))
        draft = _draft(f.datatype, f.spec, catalog, shaped[i], missing, place("f", i, len(shaped[i])))
        no_template = F.lit(False) if f.spec.use_page_title else F.col("_raw").isNull()
        listed.append(F.struct(F.lit(i).alias("field"), F.lit(f.spec.property).alias("property"), F.lit(f.datatype).alias("datatype"), F.lit(str(i)).alias("_owner"), no_template.alias("none"), draft.withField("raw_value", shown).alias("draft")))
    own = {f"_q{i}": _draft(fields[0].datatypes[p], main, catalog, [said[i]], said[i].isNull(), place("q", i)) for i, (p, kind, _) in enumerate(asked) if kind == "param"}
    rows = rows.withColumns(own).withColumn("_f", F.explode(F.array(*listed)))
    early = F.coalesce(F.when(F.col("item").isNull(), SKIPS[0]), F.when(F.col("_gone"), "the page no longer exists"), F.when(F.col("_f.none"), SKIPS[1]), F.when(F.col("_f.draft.missing"), SKIPS[2]))
    return rows.select("page_id", "title", "item", "revision_id", "_f.field", "_f.property", "_f.datatype", "_f._owner", early.alias("_early"), F.col("_f.draft").alias("_draft"), *own)


def typed_rows(pages: DataFrame, revisions: DataFrame, fields: Sequence[Field], catalog: Catalog) -> DataFrame:
    """The pages, read once: one narrow checkpointed row per page and field, with typed values and the message of the first step of reading that rejected it."""
    main = fields[0]
    rows = drafts(pages, revisions, fields, catalog)
    units = None
    for i, f in enumerate(fields):
        table = f.units if f.units is not None else catalog.units
        if table is not None:
            own = table.select(F.lit(str(i)).alias("owner"), "name", "unit")
            units = own if units is None else units.unionByName(own)
    unit = F.element_at(F.array(*(F.lit(f.spec.unit).cast("string") for f in fields)), F.col("field") + 1)
    rows = _typed(rows, "_draft", "datatype", {f.datatype for f in fields}, main.spec, unit, catalog, units)
    if main.spec.qualifiers:
        rows = _qualified(rows, main, catalog, units)
        errors = [F.concat(F.lit(f"qualifier {p}: "), F.col(f"q{i}_parse_error")) for i, (p, _, _) in enumerate(main.spec.qualifiers)]
        rows = rows.withColumn("parse_error", F.coalesce("parse_error", *errors))
    value = F.coalesce(*(F.when(F.col("field") == i, _shown(f.datatype, f.spec.julian, f.spec.language)) for i, f in enumerate(fields)))
    shown = [F.when(F.col(f"q{i}_value").isNotNull(), F.concat(F.lit(f"{p}: "), F.col(f"q{i}_value"))) for i, (p, _, _) in enumerate(main.spec.qualifiers)]
    value = F.when(F.col("parse_error").isNull() & ~F.col("_draft.missing") & value.isNotNull(), F.concat_ws("; ", value, *shown) if shown else value)
    used = [F.when(F.col(f"q{i}_value").isNotNull(), F.lit(p)) for i, (p, _, _) in enumerate(main.spec.qualifiers)]
    rows = rows.withColumn("value", value).withColumn("used", F.array_compact(F.array(*used)).cast("array<string>") if used else F.array().cast("array<string>"))
    rows = rows.withColumn("raw_value", F.col("_draft.raw_value")).withColumn("message", F.coalesce("_early", "parse_error"))
    return checkpointed(rows.drop("_draft", "_early", "_owner", "parse_error", *(f"q{i}_parse_error" for i in range(len(main.spec.qualifiers)))).withColumn("row_id", F.monotonically_increasing_id()))


def _claims(catalog: Catalog) -> DataFrame:
    missing = {c: F.lit(None).cast(kind) for c, kind in (("precision", "int"), ("language", "string")) if c not in catalog.claims.columns}
    return catalog.claims.withColumns(missing) if missing else catalog.claims


def evaluate_fields(pages: DataFrame, revisions: DataFrame, fields: Sequence[Field], catalog: Catalog) -> DataFrame:
    """pages (page_id, title, item), revisions (page_id, revision_id, text) -> one outcome per page and field (0: the main property).

    A field's rules: constraint definitions, of which the selected ones are checked (`constraints.Definition`), or (name, f) in the order of
    definition; f takes (rows, claims) and gives a condition or the violating row ids. With catalog.merges, rows are checked against, and plan to edit, the item that theirs was merged into.
    """
    rows = typed_rows(pages, revisions, fields, catalog)
    claims = _claims(catalog)
    rows = rows.withColumn("page_item", F.col("item"))
    if catalog.merges is not None or catalog.items is not None:
        current = lookups.current_items(rows.where("item IS NOT NULL").select("item").distinct(), catalog.merges, catalog.items)
        rows = _met(rows, F.col("item"), current, "item", {"_current": "current", "_exists": "exists"}).drop("_there")
        rows = rows.withColumn("message", F.coalesce("message", F.when(~F.col("_exists"), GONE))).withColumn("item", F.when(F.col("message").isNull(), F.col("_current")).otherwise(F.col("item"))).drop("_current", "_exists")
        rows = checkpointed(rows)
    # only rows that could be read meet claims, constraints and history
    read = rows.where("message IS NULL")
    listed = sorted({f.spec.property for f in fields})
    same = F.coalesce(*(F.when(F.col("field") == i, _same(f.datatype, f.spec.language)) for i, f in enumerate(fields)))
    held = existing.of_items(claims.where(F.col("property").isin(*listed)), read)
    skips = existing.already_there(read, held, same, any_value=fields[0].spec.skip_any_value).where("skip IS NOT NULL").select("row_id", "skip")
    rows = rows.join(skips, "row_id", "left")
    world = replace(catalog.world or constraints.World(claims), properties=tuple(listed))
    tests = []
    for i, f in enumerate(fields):
        for rule in f.rules if not (f.rules and isinstance(f.rules[0], constraints.Definition)) else constraints.selected(list(f.rules), f.spec.constraints):
            tests.append((i, rule))
    found = constraints.violations(read, tests, world, claims)
    rows = rows.join(found.select("row_id", F.concat(F.lit("constraint violation: "), "violation").alias("_violation")), "row_id", "left") if found is not None else rows.withColumn("_violation", F.lit(None).cast("string"))
    if fields[0].spec.skip_removed and catalog.history is not None:
        text = F.coalesce(*(F.when(F.col("field") == i, summary_text(f.datatype, f.spec)) for i, f in enumerate(fields)))
        asked = read.withColumn("_text", text).where("_text IS NOT NULL").select("row_id", "item", "property", F.col("_text").alias("value"))
        gone = existing.removed_before(asked, catalog.history).select("row_id", F.lit(True).alias("_gone")).distinct()
        rows = rows.join(gone, "row_id", "left")
    else:
        rows = rows.withColumn("_gone", F.lit(None).cast("boolean"))
    message = F.coalesce("message", "skip", "_violation", F.when(F.col("_gone"), SKIPS[6]))
    status = F.when(message.isNull(), "ready").when(message.isin(*SKIPS), "skipped").otherwise("error")
    statement = F.coalesce(*(F.when(F.col("message").isNull() & (F.col("field") == i), statement_json(f.spec, f.datatype, catalog, f.datatypes)) for i, f in enumerate(fields)))
    return rows.withColumn("message", message).select(
        "page_id", "title", F.when(F.col("message").isNull(), F.col("item")).otherwise(F.col("page_item")).alias("item"), "raw_value", "value", "message", status.alias("status"), statement.alias("statement"), "field"
    )


def evaluate(pages: DataFrame, revisions: DataFrame, spec: JobSpec, datatype: str, catalog: Catalog, rules=(), datatypes: dict[str, str] | None = None) -> DataFrame:
    """Outcomes of one property; datatypes: those of the qualifiers' properties."""
    return evaluate_fields(pages, revisions, [Field(spec, datatype, tuple(rules), datatypes or {})], catalog).drop("field")


def evaluate_all(pages: DataFrame, revisions: DataFrame, spec: JobSpec, datatypes: dict[str, str], catalog: Catalog, rules: dict[str, list] | None = None) -> DataFrame:
    """Outcomes of the main property (field 0) and the extra ones (1, 2, ...); datatypes and rules by property."""
    specs = [spec, *(for_extra(spec, i) for i in range(len(spec.extra_properties)))]
    return evaluate_fields(pages, revisions, [Field(s, datatypes[s.property], tuple((rules or {}).get(s.property, ())), datatypes) for s in specs], catalog)
