"""Graphs of scenes as normalised tables: nodes, edges, role states, contexts and the shared vocabulary of texts.

``scenes``: ``content_id, scene_idx, graph`` (the type of ``functions.graphtext``), one row per admitted scene. Everything is
made inside the row of a scene; only the vocabulary is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinograph.operators.indexing import dense_index, first_seen_ids

#: Slots of a role; the fourth is kept for a role that no graph has.
ROLE_SLOTS = ("actor", "target", "tool", None, "place")
ENTITY, ACTION = 0, 1
LINKED, ABSENT, UNKNOWN = -1, 0, 1


def _entities() -> Column:
    """Entities in the order of their ids; equal ids stay in the order in which they were written."""
    numbered = F.transform("graph.entities", lambda e, k: F.struct(e.id.alias("id"), k.alias("k"), e["name"].alias("name"), F.sort_array(e.attributes).alias("attributes")))
    return F.array_sort(numbered)


def nodes(scenes: DataFrame) -> DataFrame:
    """``content_id, scene_idx, node, kind, key, text``: first the entities by id, then the actions in their order."""
    sorted_rows = scenes.select("content_id", "scene_idx", "graph.actions", _entities().alias("entities"))
    entity = F.transform("entities", lambda e: F.struct(F.lit(ENTITY).alias("kind"), e.id.alias("key"), F.concat(F.lit("Name: "), e["name"], F.lit("\nAttributes: "), F.array_join(e.attributes, ", ")).alias("text")))
    action = F.transform("actions", lambda a, k: F.struct(F.lit(ACTION).alias("kind"), F.concat(F.lit("action_"), k.cast("string")).alias("key"), a.action.alias("text")))
    return sorted_rows.select("content_id", "scene_idx", F.posexplode(F.concat(entity, action)).alias("node", "n")).select("content_id", "scene_idx", "node", "n.kind", "n.key", F.btrim("n.text").alias("text"))


def role_states(scenes: DataFrame) -> DataFrame:
    """``content_id, scene_idx, action_node, role, state, entity_node``: of each action and slot whether it is linked to an
    entity (-1, with the entity's node; of equal ids the last), absent (0) or unknown (1)."""
    base = scenes.select("content_id", "scene_idx", "graph.actions", F.transform(_entities(), lambda e: e.id).alias("ids"))
    opened = base.select("content_id", "scene_idx", "ids", F.posexplode("actions").alias("k", "a"))
    values = F.array(*(F.col(f"a.{s}") if s else F.lit(None).cast("string") for s in ROLE_SLOTS))
    slots = opened.select("content_id", "scene_idx", "ids", (F.size("ids") + F.col("k")).alias("action_node"), F.posexplode(values).alias("role", "value"))
    from_end = F.array_position(F.reverse("ids"), F.col("value"))
    place = F.when(from_end > 0, F.size("ids") - from_end).cast("int")
    state = F.when(place.isNotNull(), LINKED).when(F.col("value") == "unknown", UNKNOWN).otherwise(ABSENT)
    return slots.select("content_id", "scene_idx", "action_node", "role", state.alias("state"), place.alias("entity_node"))


def edges(scenes: DataFrame) -> DataFrame:
    """``content_id, scene_idx, src, dst, role``: each link from entity to action, and back with the role plus the number of slots."""
    links = role_states(scenes).where(F.col("state") == LINKED)
    forth = links.select("content_id", "scene_idx", F.col("entity_node").alias("src"), F.col("action_node").alias("dst"), "role")
    back = links.select("content_id", "scene_idx", F.col("action_node").alias("src"), F.col("entity_node").alias("dst"), F.col("role") + len(ROLE_SLOTS))
    return forth.union(back)


def contexts(scenes: DataFrame) -> DataFrame:
    """``content_id, scene_idx, text`` of each scene's context."""
    text = F.concat(F.lit("Format: "), F.col("graph.format"), F.lit("\nMedium: "), F.col("graph.medium"), F.lit("\nTopics: "), F.array_join(F.sort_array("graph.topics"), ", "))
    return scenes.select("content_id", "scene_idx", text.alias("text"))


def vocabulary(scenes: DataFrame) -> DataFrame:
    """``text, text_id`` of all node and context texts, numbered in the order of content, scene and node; "" is 0."""
    node_texts = nodes(scenes).select("text", "content_id", "scene_idx", "node")
    context_texts = contexts(scenes).select("text", "content_id", "scene_idx", F.lit(2**31 - 1).alias("node"))
    return first_seen_ids(node_texts.unionByName(context_texts), "text", ["content_id", "scene_idx", "node"], "text_id")


def scene_offsets(scenes: DataFrame) -> DataFrame:
    """``content_id, first_scene, scenes``: where each content's scenes begin among all scenes in order."""
    numbered = dense_index(scenes.select("content_id", "scene_idx"), ["content_id", "scene_idx"], "row")
    return numbered.groupBy("content_id").agg(F.min("row").alias("first_scene"), F.count("*").alias("scenes"))


def content_statistics(scenes: DataFrame) -> DataFrame:
    """``content_id, scenes, actionless, entities, actions`` of each content."""
    return scenes.groupBy("content_id").agg(
        F.count("*").alias("scenes"), F.count_if(F.size("graph.actions") == 0).alias("actionless"), F.sum(F.size("graph.entities")).alias("entities"), F.sum(F.size("graph.actions")).alias("actions")
    )
