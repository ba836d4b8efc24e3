"""Checks of stored scene rows and of graphs stored as JSON objects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinograph.functions.graphtext import CONTEXT_FIELDS, ROLES
from kinograph.operators.outcomes import TAGS

_FIELDS = sorted((*CONTEXT_FIELDS, "entities", "actions"))
_ENTITY, _ACTION, _OLD_ACTION = (sorted(x) for x in (("id", "name", "attributes"), (*ROLES, "action"), (*(r for r in ROLES if r != "place"), "location", "action")))
_TYPE = (
    "medium string, format string, topics array<string>, entities array<struct<id: string, name: string, attributes: array<string>>>, "
    "actions array<struct<actor: string, action: string, target: string, tool: string, place: string, location: string>>"
)
_KEYS = "entities array<map<string, string>>, actions array<map<string, string>>"


def _filled(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\S"), F.lit(False))


def _first(*tests: tuple[Column, str]) -> Column:
    """The message of the first test that holds; null if none does."""
    return F.coalesce(*(F.when(F.coalesce(test, F.lit(True)), F.lit(message)) for test, message in tests))


def graph_error(json: Column) -> Column:
    """Why a JSON text is no graph object; null if it is one.

    Objects are closed: no field may lack or be more, but for the old name ``location`` in place of ``place``; an action with
    both is refused. Texts must not be blank; the roles of an action may be null.
    """
    graph, keys = F.from_json(json, _TYPE), F.from_json(json, _KEYS)
    blank = lambda x: ~_filled(x)
    roles = lambda a: [a[r] for r in (*ROLES, "location")]
    same = lambda m, *names: reduce(lambda x, y: x | y, (F.array_sort(F.map_keys(m)) == F.array(*map(F.lit, n)) for n in names))
    entity_bad = lambda e: blank(e["id"]) | blank(e["name"]) | F.coalesce(F.exists(e["attributes"], blank), F.lit(True))
    action_bad = lambda a: blank(a["action"]) | reduce(lambda x, y: x | y, (F.coalesce(blank(r) & r.isNotNull(), F.lit(False)) for r in roles(a)))
    return F.when(json.isNull() | F.json_object_keys(json).isNull(), "no object").otherwise(
        _first(
            (F.array_sort(F.json_object_keys(json)) != F.array(*map(F.lit, _FIELDS)), "fields"),
            (blank(graph["medium"]) | blank(graph["format"]) | graph["topics"].isNull() | F.exists(graph["topics"], blank), "context"),
            (F.exists(keys["entities"], lambda m: ~same(m, _ENTITY)), "entity fields"),
            (F.exists(graph["entities"], entity_bad), "entities"),
            (F.exists(keys["actions"], lambda m: F.array_contains(F.map_keys(m), "location") & F.array_contains(F.map_keys(m), "place")), "location and place"),
            (F.exists(keys["actions"], lambda m: ~same(m, _ACTION, _OLD_ACTION)), "action fields"),
            (F.exists(graph["actions"], action_bad), "actions"),
        )
    )


def stored_graph(json: Column) -> Column:
    """The graph of a valid JSON object, with ``location`` renamed and undeclared references turned into ``unknown``; else null."""
    graph = F.from_json(json, _TYPE)
    ids = F.transform(graph["entities"], lambda e: e["id"])

    def resolved(value: Column) -> Column:
        return F.when(value.isNull() | (value == "unknown") | F.array_contains(ids, value), value).otherwise("unknown")

    def renamed(a: Column) -> Column:
        named = {r: a[r] if r != "place" else F.coalesce(a["place"], a["location"]) for r in ROLES}
        return F.struct(resolved(named["actor"]).alias("actor"), a["action"].alias("action"), *(resolved(named[r]).alias(r) for r in ROLES[1:]))

    built = F.struct(graph["medium"].alias("medium"), graph["format"].alias("format"), graph["topics"].alias("topics"), graph["entities"].alias("entities"), F.transform(graph["actions"], renamed).alias("actions"))
    return F.when(graph_error(json).isNull(), built)


def row_error() -> Column:
    """Why a stored scene row, of the columns of ``sources.readers.SCENE_SCHEMA``, is refused; null for a sound one.

    A row has a content and a scene number, tokens that are null or not negative, known tags, and either an error or one
    of graph and description, not both; further columns are free.
    """
    present = [F.col(c).isNotNull().cast("int") for c in ("scene_graph", "description", "error")]
    return _first(
        (~_filled(F.col("content_id")), "content_id"),
        (F.col("scene_idx").isNull() | (F.col("scene_idx") < 0), "scene_idx"),
        (F.col("tokens").isNotNull() & (F.coalesce("tokens", F.lit(0)) < 0), "tokens"),
        (F.col("warning").isNotNull() & (F.size(F.array_except(F.coalesce("warning", F.array().cast("array<string>")), F.array(*map(F.lit, TAGS)))) > 0), "warning"),
        (sum(present[1:], present[0]) != 1, "payload"),
    )
