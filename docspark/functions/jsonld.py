"""What the JSON-LD of a page says, as SQL functions over variants.

A page's scripts are parsed to variants. Their objects are taken level by level: the members
of lists and of ``@graph`` lists stand behind the objects that hold them, DEPTH levels down.
Of a field the first object counts in which it says something.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEPTH = 4
#: How deep lists of names may stand in lists.
NESTED = 3


def parsed(raw: Column) -> Column:
    """A script as a variant; commas before a closing bracket are forgiven. Null if it is no JSON."""
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(F.regexp_replace(raw, r",\s*([}\]])", "$1")))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _list(v: Column, path: str = "$") -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _below(v: Column) -> Column:
    return F.when(_kind(v).startswith("ARRAY"), _list(v)).when(_kind(v).startswith("OBJECT"), _list(v, "$['@graph']")).otherwise(F.array().cast("array<variant>"))


def objects(scripts: Column) -> Column:
    """The objects in an array of scripts, in order of their levels."""
    level = F.filter(F.transform(scripts, parsed), lambda v: v.isNotNull())

    def all_levels(state: Column, _: Column) -> Column:
        deeper = F.flatten(F.transform(state["level"], _below))
        return F.struct(F.concat(state["all"], deeper).alias("all"), deeper.alias("level"))

    start = F.struct(level.alias("all"), level.alias("level"))
    every = F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), start, all_levels)["all"]
    return F.filter(every, lambda v: _kind(v).startswith("OBJECT"))


def _says(v: Column) -> Column:
    """Whether a value is there and isn't empty, zero or false."""
    text = F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))
    return v.isNotNull() & (_kind(v) != "VOID") & ~text.isin("", "[]", "{}", "0", "0.0", "false")


def field(found: Column, name: str) -> Column:
    """The value of a field (a variant) in the first of some objects that says something of it."""
    return F.get(F.filter(F.transform(found, lambda v: F.try_variant_get(v, f"$['{name}']", "variant")), _says), 0)


def text(v: Column) -> Column:
    """A value as text; null where there is none."""
    return F.when(_says(v), F.trim(F.try_variant_get(v, "$", "string")))


def split_names(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def names(v: Column, nested: int = NESTED) -> Column:
    """Names in a value: a list in commas, an object's ``name``, or lists of these."""
    none = F.array().cast("array<string>")
    string = F.when(_kind(v) == "STRING", split_names(F.try_variant_get(v, "$", "string")))
    inner = F.try_variant_get(v, "$.name", "variant")
    if not nested:
        return F.coalesce(string, none)
    out = F.when(_kind(v) == "STRING", string).when(_kind(v).startswith("OBJECT"), names(inner, nested - 1))
    return F.coalesce(out.when(_kind(v).startswith("ARRAY"), F.flatten(F.transform(_list(v), lambda x: names(x, nested - 1)))), none)


def breadcrumbs(found: Column) -> Column:
    """The names of the first breadcrumb list, an empty one for an item without; null if there is no list."""
    of = F.filter(found, lambda v: F.coalesce(F.try_variant_get(v, "$['@type']", "string") == "BreadcrumbList", F.lit(False)))
    part = lambda i, path: F.when(_says(F.try_variant_get(i, path, "variant")), F.try_variant_get(i, path, "string"))
    name = lambda i: F.coalesce(part(i, "$.name"), part(i, "$.item.name"), F.lit(""))
    return F.when(F.size(of) > 0, F.transform(_list(F.get(of, 0), "$.itemListElement"), name))
