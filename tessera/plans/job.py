"""The job specification: a declarative description of a run, its permalink form, and its validation."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, fields, replace
from urllib.parse import parse_qsl, quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from tessera.functions.text import check_pattern

JULIAN = "Q1985786"
NO_LIMIT, DEFAULT_LIMIT = None, (1926, 0, 0)


class InvalidSpec(ValueError):
    """The specification can't be run; the text says why."""


@dataclass(frozen=True)
class JobSpec:
    siteid: str = "en"
    project: str = "wikipedia"
    namespace: int = 0
    property: str | None = None
    template: str = ""
    template_redirects: tuple[str, ...] | None = None
    parameters: tuple[str, ...] = ()
    date_parameters: tuple[str, str | None, str | None] | None = None
    coordinate_parameters: tuple[str, str] | None = None
    use_page_title: bool = False
    value_pattern: str = ""
    unwrap_templates: bool = False
    lead_only: bool = False
    add_prefix: str = ""
    add_suffix: str = ""
    remove_prefix: str = ""
    remove_suffix: str = ""
    search: str = ""
    replacement: str = ""
    case: str = ""
    archive_urls: str = "original"
    plain_links: bool = True
    link_choice: str = "first"
    julian: bool = False
    date_limit: tuple[int, int, int] | None = DEFAULT_LIMIT
    limit_before: bool = False
    unit: str | None = None
    decimal_comma: bool = False
    language: str = ""
    category: str = ""
    depth: int = 0
    manual_list: tuple[str, ...] = ()
    instance_of: tuple[str, ...] = ()
    saved_query: int | None = None
    items_sql: str = ""
    skip_any_value: bool = True
    skip_removed: bool = True
    constraints: tuple[str, ...] | None = None
    qualifiers: tuple[tuple[str, str, str], ...] = ()
    extra_properties: tuple[tuple[str, tuple[str, ...]], ...] = ()


#: Names of the fields in their order, and a specification of their defaults: made once, as they are asked for in every row of a table of permalinks.
_FIELDS, _BASE = tuple(f.name for f in fields(JobSpec)), JobSpec()
_KNOWN = frozenset(_FIELDS)


def _id(letter: str, text: str) -> str | None:
    m = re.search(rf"(?:^|/|:){letter}?([0-9]+)\s*$", text.strip(), re.I)
    return f"{letter}{int(m[1])}" if m else None


def _listed(text: str, sign: str = "|") -> tuple[str, ...]:
    return tuple(p.strip() for p in text.split(sign) if p.strip())


def _limit(text: str) -> tuple[int, int, int] | None:
    if text == "none":
        return NO_LIMIT
    parts = text.split("-")
    number = lambda i: int(parts[i]) if i < len(parts) and parts[i].isdigit() else 0
    return (number(0), number(1), number(2)) if parts[0].isdigit() else DEFAULT_LIMIT


def _number(text: str) -> int | None:
    return int(text) if re.fullmatch(r"-?[0-9]+", text) else None


# The keys of permalinks (here and in `from_query` and `to_query`), which old links hold.
# Keys that set one field: key -> (field, reader). Readers of raw keys get the text untrimmed.
_RAW = {"pattern": "value_pattern", "sparql": "items_sql", "addprefix": "add_prefix", "prefix": "add_prefix", "addsuffix": "add_suffix", "removeprefix": "remove_prefix", "removesuffix": "remove_suffix", "searchvalue": "search", "replacevalue": "replacement"}
_READ = {
    "siteid": ("siteid", str.lower), "project": ("project", str.lower), "namespace": ("namespace", lambda v: _number(v) or 0), "template": ("template", str),
    "p": ("property", lambda v: _id("P", v)), "property": ("property", lambda v: _id("P", v)), "templateredirects": ("template_redirects", _listed),
    "petscan": ("saved_query", _number), "instanceof": ("instance_of", lambda v: tuple(x for x in (_id("Q", p) for p in _listed(v)) if x)),
    "archive": ("archive_urls", lambda v: v if v in ("skip", "keep") else "original"), "unwrap": ("unwrap_templates", lambda v: v == "1"), "lead": ("lead_only", lambda v: v == "1"),
    "case": ("case", lambda v: v if v in ("lower", "upper") else ""), "pagetitle": ("use_page_title", lambda v: v == "1"), "wikisyntax": ("plain_links", lambda v: v == "1"),
    "link": ("link_choice", lambda v: "last" if v == "last" else "first"), "unit": ("unit", lambda v: None if v == "1" else _id("Q", v)), "monolanguage": ("language", str),
    "category": ("category", str), "depth": ("depth", lambda v: max(0, _number(v) or 0)), "manuallist": ("manual_list", lambda v: _listed(v, "\n")),
    "skipremoved": ("skip_removed", lambda v: v != "0"), "constraints": ("constraints", lambda v: tuple(x for x in (_id("Q", p) for p in _listed(v)) if x)),
}


def from_query(text: str) -> JobSpec:
    """Specification of a permalink's query string; unknown keys are ignored."""
    out, dates, place, relation, limit = {}, ["", None, None], ["", ""], None, None
    for key, raw in parse_qsl(text, keep_blank_values=True):
        v = raw.strip()
        if key in _RAW:
            out[_RAW[key]] = raw
        elif key in _READ:
            name, read = _READ[key]
            out[name] = read(v)
        elif key in ("parameters", "parameter"):
            out["parameters"] = out.get("parameters", ()) + (_listed(v) if key == "parameters" else ((v,) if v else ()))
        elif key.startswith("aparameter") and key[10:] in ("1", "2", "3") and v:
            dates[int(key[10:]) - 1] = v
            out["date_parameters"] = tuple(dates)
        elif key in ("latparam", "lonparam") and v:
            place[key == "lonparam"] = v
            out["coordinate_parameters"] = tuple(place)
        elif key == "calendar" and v == JULIAN:
            out["julian"] = True
        elif key == "limityear":
            limit = (_limit(v),)
        elif key == "rel":
            relation = v == "l"
        elif key == "decimalmark" and v == ",":
            out["decimal_comma"] = True
        elif (key in ("alreadyset", "set") and v == "0") or (key == "skipif" and v == "value"):
            out["skip_any_value"] = False
        elif key == "qualifier":
            parts = v.split("|", 2)
            if len(parts) == 3 and _id("P", parts[0]) and parts[1] in ("fixed", "param"):
                out["qualifiers"] = (*out.get("qualifiers", ()), (_id("P", parts[0]), parts[1], parts[2] if parts[1] == "fixed" else ",".join(_listed(parts[2], ","))))
        elif key == "also" and "|" in v and _id("P", v.split("|")[0]):
            out["extra_properties"] = (*out.get("extra_properties", ()), (_id("P", v.split("|")[0]), _listed(v.split("|", 1)[1], ",")))
    if limit is not None:
        out["date_limit"] = limit[0]
        out["limit_before"] = bool(relation) and limit[0] is not None
    return JobSpec(**out)


def to_query(spec: JobSpec) -> str:
    """Permalink query string; what is as by default is left out, but for the keys that are always written."""
    base, q = _BASE, []
    flag = lambda on: "1" if on else "0"
    put = lambda key, name, shown=lambda v: str(v): q.append((key, shown(getattr(spec, name)))) if getattr(spec, name) != getattr(base, name) else None
    q += [("siteid", spec.siteid), ("project", spec.project), ("namespace", str(spec.namespace))]
    put("p", "property")
    q.append(("template", spec.template))
    put("templateredirects", "template_redirects", "|".join)
    q.append(("parameters", "|".join(spec.parameters)))
    q += [(f"aparameter{i + 1}", v) for i, v in enumerate(spec.date_parameters or ()) if v is not None]
    q += list(zip(("latparam", "lonparam"), spec.coordinate_parameters or ()))
    for key in ("addprefix", "addsuffix", "removeprefix", "removesuffix", "searchvalue", "replacevalue", "pattern", "sparql"):
        put(key, _RAW[key])
    for key in ("monolanguage", "category", "depth", "case", "petscan", "unit"):
        put(key, _READ[key][0])
    put("manuallist", "manual_list", "\n".join)
    q += [("alreadyset", flag(spec.skip_any_value)), ("wikisyntax", flag(spec.plain_links))]
    for key, name in (("skipremoved", "skip_removed"), ("pagetitle", "use_page_title"), ("unwrap", "unwrap_templates"), ("lead", "lead_only")):
        put(key, name, flag)
    put("instanceof", "instance_of", "|".join)
    put("archive", "archive_urls")
    put("link", "link_choice")
    put("calendar", "julian", lambda _: JULIAN)
    if spec.date_limit is None:
        q.append(("limityear", "none"))
    elif (spec.date_limit, spec.limit_before) != (base.date_limit, base.limit_before):
        y, m, d = spec.date_limit
        q += [("limityear", f"{y}-{m:02d}-{d:02d}" if d else f"{y}-{m:02d}" if m else str(y)), ("rel", "l" if spec.limit_before else "geq")]
    put("decimalmark", "decimal_comma", lambda _: ",")
    put("constraints", "constraints", "|".join)
    q += [("qualifier", "|".join(x)) for x in spec.qualifiers]
    q += [("also", f"{p}|{','.join(names)}") for p, names in spec.extra_properties]
    return "&".join(f"{k}={quote(v, safe='')}" for k, v in q)


def for_extra(spec: JobSpec, index: int) -> JobSpec:
    """The specification of an extra property: the page's and the value's options stay, its own parameters replace the rest."""
    prop, names = spec.extra_properties[index]
    return replace(spec, property=prop, parameters=names, date_parameters=None, coordinate_parameters=None, use_page_title=False, value_pattern="", add_prefix="", add_suffix="", remove_prefix="", remove_suffix="", search="", replacement="", case="", unit=None, qualifiers=(), extra_properties=())


DATATYPES = ("wikibase-item", "string", "external-id", "url", "commonsMedia", "time", "quantity", "monolingualtext", "globe-coordinate")


def validate(spec: JobSpec, datatype: str, deprecated: bool = False) -> None:
    if not spec.use_page_title and not spec.template.strip():
        raise InvalidSpec("no template")
    if not (spec.parameters or spec.date_parameters or spec.coordinate_parameters or spec.use_page_title or spec.value_pattern):
        raise InvalidSpec("no source of values")
    if spec.property is None or deprecated:
        raise InvalidSpec("the property is deprecated" if deprecated else "no property")
    if datatype not in DATATYPES:
        raise InvalidSpec(f"{datatype} is not supported")
    if spec.date_parameters and datatype != "time" or spec.coordinate_parameters and datatype != "globe-coordinate":
        raise InvalidSpec("these parameters are for another datatype")
    if datatype == "monolingualtext" and not re.fullmatch(r"[a-z]+(?:-[a-z0-9]+)*", spec.language):
        raise InvalidSpec("no language")
    if spec.search:
        try:
            check_pattern(spec.search)
        except ValueError as e:
            raise InvalidSpec(str(e)) from None


def specs_of(permalinks: Column) -> Column:
    """The specification, as JSON, of each permalink's query string; null for a null one. (Old shares keep permalinks.)"""

    @pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(as_dict(from_query(t))))

    return read(permalinks)


def permalinks_of(specs: Column) -> Column:
    """The permalink's query string of each specification in JSON."""

    @pandas_udf("string")
    def write(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else to_query(from_dict(json.loads(t))))

    return write(specs)


def as_dict(spec: JobSpec) -> dict:
    return {name: getattr(spec, name) for name in _FIELDS}


def from_dict(data: dict) -> JobSpec:
    """Missing fields have their defaults, unknown ones are ignored."""
    return JobSpec(**{k: _deep(v) if v.__class__ is list or v.__class__ is tuple else v for k, v in data.items() if k in _KNOWN})


def _deep(value):
    return tuple(map(_deep, value)) if isinstance(value, list | tuple) else value
