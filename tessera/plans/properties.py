"""The analysis phase: entities of properties as rows, and a specification made ready to run.

Properties come as the JSON of their entities, one row each. A run has some ten properties with some dozens of constraints, so what is
collected here is a few rows; all that grows with the wiki stays in DataFrames.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.functions.text import db_key
from tessera.operators import constraints
from tessera.sources import lookups

from .evaluate import fixed_value
from .job import DATATYPES, InvalidSpec, JobSpec, for_extra, validate

# Properties and items that describe a property.
CONSTRAINT, STATUS, MANDATORY, SUGGESTION, FORMATTER, SYMBOL, INSTANCE, SUBJECT_ITEM = "P2302", "P2316", "Q21502408", "Q62026391", "P1630", "P5061", "P31", "P2305"
DEPRECATED_CLASSES, ALLOWED_UNITS = ("Q37911748", "Q18644427"), "Q21514353"

_SNAK = "struct<snaktype:string,datavalue:struct<value:variant>>"
ENTITY = f"struct<id:string,datatype:string,labels:map<string,struct<value:string>>,claims:map<string,array<struct<rank:string,mainsnak:{_SNAK},qualifiers:map<string,array<{_SNAK}>>>>>>"


def _plain(snak: Column) -> Column:
    """A snak's value as text: id, amount, time, or the text itself; null for no value, NOW for an unknown one."""
    v = snak["datavalue"]["value"]
    said = F.coalesce(*(F.try_variant_get(v, f"$.{k}", "string") for k in ("id", "amount", "time", "text")), F.try_variant_get(v, "$", "string"))
    return F.when(snak["snaktype"] == "somevalue", F.lit(constraints.NOW)).otherwise(said)


def properties(entities: DataFrame, json_col: str = "json", language: str = "en") -> DataFrame:
    """entities (json) -> id, label (the id where there is none), datatype, supported, deprecated, formatter_url, constraints.

    constraints: array of struct(kind, status, qualifiers map<string, array<string>>), in order.
    """
    e = F.col("e")
    statements = lambda p: F.coalesce(F.try_element_at(e["claims"], F.lit(p)), F.array())
    rows = entities.select(F.from_json(json_col, ENTITY).alias("e")).where(e["id"].isNotNull())
    classes = F.transform(statements(INSTANCE), lambda s: _plain(s["mainsnak"]))
    links = F.transform(F.filter(statements(FORMATTER), lambda s: F.coalesce(s["rank"], F.lit("normal")) != "deprecated"), lambda s: _plain(s["mainsnak"]))

    def definition(s: Column) -> Column:
        qualifiers = F.transform_values(F.coalesce(s["qualifiers"], F.create_map().cast(f"map<string,array<{_SNAK}>>")), lambda _, v: F.transform(v, _plain))
        status = F.get(F.coalesce(F.try_element_at(qualifiers, F.lit(STATUS)), F.array().cast("array<string>")), F.lit(0))
        return F.struct(_plain(s["mainsnak"]).alias("kind"), F.when(status == MANDATORY, "mandatory").when(status == SUGGESTION, "suggestion").otherwise("normal").alias("status"), qualifiers.alias("qualifiers"))

    return rows.select(
        e["id"].alias("id"), F.coalesce(F.try_element_at(e["labels"], F.lit(language))["value"], e["id"]).alias("label"), e["datatype"].alias("datatype"),
        F.coalesce(e["datatype"].isin(*DATATYPES), F.lit(False)).alias("supported"), F.arrays_overlap(classes, F.array(*map(F.lit, DEPRECATED_CLASSES))).eqNullSafe(True).alias("deprecated"),
        F.get(F.filter(links, lambda x: x.isNotNull()), F.lit(0)).alias("formatter_url"), F.filter(F.transform(statements(CONSTRAINT), definition), lambda d: d["kind"].isNotNull()).alias("constraints"),
    )


def constraint_list(props: DataFrame, labels: DataFrame, language: str = "en") -> DataFrame:
    """property, position, kind, label of the kind (its id where there is none), status, known (can it be checked?)."""
    rows = props.select(F.col("id").alias("property"), F.posexplode("constraints").alias("position", "c")).select("property", "position", "c.kind", "c.status")
    return lookups.with_labels(rows, labels, "kind", language).withColumn("known", F.col("kind").isin(*constraints.NAMES))


@dataclass(frozen=True)
class Property:
    id: str
    label: str
    datatype: str
    supported: bool
    deprecated: bool
    formatter_url: str | None
    constraints: tuple[constraints.Definition, ...] = ()

    def allowed_units(self) -> list[str | None] | None:
        """Units by the property's constraint, None among them for none; None without that constraint."""
        for d in self.constraints:
            if d.kind == ALLOWED_UNITS:
                return [u if u and u.startswith("Q") else None for u in d.qualifiers.get(SUBJECT_ITEM, [])]
        return None


def load(props: DataFrame, ids: list[str]) -> dict[str, Property]:
    """The named properties; a row for each."""
    out = {}
    for r in props.where(F.col("id").isin(*ids)).dropDuplicates(["id"]).collect():
        found = tuple(constraints.Definition(c["kind"], c["status"], dict(c["qualifiers"])) for c in r["constraints"])
        out[r["id"]] = Property(r["id"], r["label"], r["datatype"], r["supported"], r["deprecated"], r["formatter_url"], found)
    return out


@dataclass(frozen=True)
class Site:
    """The wiki of a specification: where it is, how it names things, and its item."""

    host: str
    dbname: str = ""
    language: str = "en"
    edition: str | None = None
    namespaces: dict[int, str] = field(default_factory=dict)
    template_prefixes: tuple[str, ...] = ("Template",)
    file_prefixes: tuple[str, ...] = ("File", "Image")
    category_prefixes: tuple[str, ...] = ("Category",)
    first_letter: bool = True
    months: dict[str, int] = field(default_factory=dict)

    def key(self, name: str, namespace: int) -> str:
        """A name as it was typed -> the key under which the database has it: no prefix, one underscore for blanks, the first letter in upper case where the wiki has it so."""
        prefixes = {10: self.template_prefixes, 14: self.category_prefixes, 6: self.file_prefixes}.get(namespace, ())
        row = SparkSession.active().range(1).select(db_key(F.lit(name), tuple(p for p in prefixes if p), self.first_letter or namespace != 10).alias("k")).first()
        return row["k"]


def site_of(host: str, sites: DataFrame, claims: DataFrame | None = None) -> Site:
    """sites: host, info (the JSON by which a site describes itself), one row each; claims: where a wiki's own item is looked up. InvalidSpec if there is no such site."""
    found = sites.where(F.col("host") == host).select(lookups.site(F.col("info")).alias("s")).limit(1).collect()
    if not found:
        raise InvalidSpec(f"cannot reach {host}")
    s = found[0]["s"]
    if not re.fullmatch(r"[a-z0-9_]+", s["dbname"] or ""):
        raise InvalidSpec(f"{host} reports an invalid name of its database")
    language = s["language"] or "en"
    prefixes = {n: tuple(p for p in s[f"{n}_prefixes"] if p) for n in ("template", "file", "category")}
    return Site(
        host, s["dbname"], language, lookups.edition(claims, s["dbname"]) if claims is not None else None, {k: v for k, v in (s["namespaces"] or {}).items() if v},
        prefixes["template"], prefixes["file"], prefixes["category"], s["first_letter"], N.month_names(sites.sparkSession, [language])[language],
    )


def plain_site(spec: JobSpec, spark: SparkSession) -> Site:
    """What can be said of a specification's wiki without its description."""
    host = lookups.host_for(spec.siteid, spec.project)
    kind = {"wikipedia": "wiki"}.get(spec.project, spec.project)
    language = "en" if spec.project in ("commons", "species") else spec.siteid
    dbname = f"{spec.project}wiki" if spec.project in ("commons", "species") else f"{spec.siteid.replace('-', '_')}{kind}"
    return Site(host, dbname, language, "Q328" if dbname == "enwiki" else None, months=N.month_names(spark, [language])[language])


@dataclass(frozen=True)
class Prepared:
    """A specification with all that is looked up once for a run."""

    spec: JobSpec
    property: Property
    site: Site
    names: tuple[str, ...]
    rules: tuple[constraints.Definition, ...]
    datatypes: dict[str, str]
    units: DataFrame | None = None
    extras: tuple[Prepared, ...] = field(default=())

    @property
    def host(self) -> str:
        return self.site.host


def _fixed(spark: SparkSession, prop: str, datatype: str, text: str, spec: JobSpec) -> str:
    """A typed-in qualifier value, if it is one."""
    values = fixed_value(datatype, text, spec)[0]
    if not text.strip() or all(v is None for v in spark.range(1).select(*(v.alias(k) for k, v in values.items())).first()):
        raise InvalidSpec(f"qualifier {prop}: '{text.strip()}' is no value")
    return text.strip()


def prepare(
    spec: JobSpec, props: DataFrame, redirects: DataFrame, names: DataFrame | None = None, templates: DataFrame | None = None, sites: DataFrame | None = None, claims: DataFrame | None = None
) -> Prepared:
    """Check a specification against its properties and look up what a run needs; InvalidSpec says what can't work.

    redirects: from_title, to_title in the template namespace, names without prefix; templates: title of each template (None: all exist);
    names: item, language, text of units' labels and aliases, and of their symbols with a null language; sites: see `site_of` (None: what follows from the
    specification alone); claims: where the wiki's own item is found.
    """
    if spec.items_sql.strip() and not re.search(r"\bitem\b", spec.items_sql):
        raise InvalidSpec("the query must give a column item")
    if spec.value_pattern and not re.search(r"\{[^{}]+\}", spec.value_pattern):
        raise InvalidSpec("the value pattern needs a {parameter}")
    if not spec.template.strip():
        raise InvalidSpec("no template")
    host = lookups.host_for(spec.siteid, spec.project)
    site = plain_site(spec, props.sparkSession) if sites is None else site_of(host, sites, claims)
    main = _one(spec, props, redirects, names, templates, True, site)
    extras = []
    for i, (prop, _) in enumerate(spec.extra_properties):
        try:
            extras.append(_one(for_extra(spec, i), props, redirects, names, templates, False, site))
        except InvalidSpec as e:
            raise InvalidSpec(f"{prop}: {e}") from None
    return replace(main, extras=tuple(extras))


def _one(spec: JobSpec, props: DataFrame, redirects: DataFrame, names: DataFrame | None, templates: DataFrame | None, main: bool, site: Site) -> Prepared:
    if spec.property is None:
        raise InvalidSpec("no property")
    asked = [spec.property, *(p for p, _, _ in spec.qualifiers)]
    known = load(props, asked)
    if spec.property not in known:
        raise InvalidSpec(f"{spec.property} does not exist")
    prop = known[spec.property]
    if not prop.supported:
        raise InvalidSpec(f"datatype {prop.datatype} is not supported")
    validate(spec, prop.datatype, prop.deprecated)
    units = prop.allowed_units() if prop.datatype == "quantity" else None
    if main and units is not None and spec.unit not in units:
        raise InvalidSpec(f"{spec.unit or 'no unit'} is not an allowed unit for {prop.id}")
    also = lookups.template_redirects(site.key(spec.template, 10), redirects, templates, site.template_prefixes, site.first_letter) if spec.template.strip() else []
    if also is None:
        raise InvalidSpec(f"Template:{spec.template} does not exist")
    qualifiers = []
    for p, kind, text in spec.qualifiers:
        q = known.get(p)
        if q is None:
            raise InvalidSpec(f"qualifier {p} does not exist")
        if not q.supported or q.deprecated:
            raise InvalidSpec(f"qualifier {p} ({q.datatype}) is not supported")
        if kind == "param" and not _names(text):
            raise InvalidSpec(f"qualifier {p}: no parameter")
        qualifiers.append((p, kind, _fixed(props.sparkSession, p, q.datatype, text, spec) if kind == "fixed" else text))
    keep = tuple(r for r in also if spec.template_redirects is None or r in spec.template_redirects)
    wanted = [u for u in (units if units is not None else [spec.unit]) if u]
    table = None
    if prop.datatype == "quantity" and names is not None:
        said = names.where(F.col("language").isNull() | F.col("language").isin("en", site.language)).where(F.col("item").isin(*wanted) if wanted else F.lit(False))
        table = lookups.unit_names(said.select("item", "text"))
    return Prepared(replace(spec, qualifiers=tuple(qualifiers), template_redirects=keep), prop, site, (spec.template, *keep), tuple(constraints.selected(list(prop.constraints), spec.constraints)), {p: known[p].datatype for p in asked}, table)


def _names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


# what is shown of values


def value_link(datatype: Column, value: Column, formatter_url: Column) -> Column:
    """A link for a harvested value, by its datatype, without its qualifiers; null if there is none."""
    main = F.regexp_extract(value, r"^(?s)(.*?)(?:; P[0-9]+: .*)?\z", 1)
    whole = F.replace(F.url_encode(F.replace(main, F.lit(" "), F.lit("_"))), F.lit("+"), F.lit("%20"))
    piecewise = F.replace(F.replace(F.url_encode(main), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    entity = F.concat(F.lit("https://www.wikidata.org/wiki/"), F.when(F.startswith(main, F.lit("P")), "Property:").otherwise(""), main)
    return (
        F.when(datatype == "wikibase-item", entity).when(datatype == "commonsMedia", F.concat(F.lit("https://commons.wikimedia.org/wiki/File:"), whole))
        .when(datatype == "url", F.when(main.rlike("^https?://"), main)).when(datatype == "external-id", F.replace(formatter_url, F.lit("$1"), piecewise))
    )


def edit_summary(prop: Column, item: Column, shown: Column, dbname: Column, group: Column, tool: str) -> Column:
    """What is said of an edit: property, value (an item as a link, else its first 100 characters), source, and the group of the run's edits under the tool's name."""
    said = F.when(item.isNotNull(), F.concat(F.lit("[["), item, F.lit("]]"))).otherwise(F.substring(shown, 1, 100))
    return F.format_string(f"Added [[Property:%s]]: %s from %s ([[:toollabs:editgroups/b/{tool}/%s|details]])", prop, said, dbname, group)

