"""SQL of the graph reader, for the forms that the tables hold: named graphs, fenced or not, with a last action that was cut."""

from __future__ import annotations

#: ``graphs``: of each output that is a graph, whether it can be read (``ok``), ``native`` and its parts; ``ents`` and ``refs``: its
#: entities, those that are only referred to included, and its roles with the number of their entity.
GRAPHS = r"""
bodies AS (SELECT o.output_id, raw_output AS t, regexp_matches(raw_output, '^\s*```') AS fenced,
    CASE WHEN fenced THEN regexp_extract(raw_output, '(?s)^\s*```[\w-]*\s*\n(.*)\n\s*```\s*$', 1) ELSE raw_output END AS b
    FROM scene_outputs o JOIN generation_arms a USING (arm) WHERE a.representation = 'graph' AND raw_output IS NOT NULL),
lined AS (SELECT output_id, fenced, [trim(l) FOR l IN string_split(b, chr(10)) IF trim(l) <> ''] AS l, list_position(l, '[Context]') AS c, list_position(l, '[Entities]') AS e, list_position(l, '[Actions]') AS a FROM bodies),
parted AS (SELECT output_id, fenced, coalesce(c = 1 AND e = 5 AND a > e + 1 AND len(l) > a, false) AS framed, l[2:4] AS context,
    CASE WHEN l[e + 1:a - 1] = ['none'] THEN [] ELSE l[e + 1:a - 1] END AS rows_e, CASE WHEN len(l[a + 1:]) > 1 THEN [x FOR x IN l[a + 1:] IF x <> 'none'] WHEN l[a + 1] = 'none' THEN [] ELSE l[a + 1:] END AS rows_a,
    len(l[a + 1:]) > 1 AND list_contains(l[a + 1:], 'none') AS mixed FROM lined),
celled AS (SELECT output_id, fenced, framed, mixed, [trim(substr(x, 8)) FOR x IN context IF starts_with(x, 'medium:')] AS m, [trim(substr(x, 8)) FOR x IN context IF starts_with(x, 'format:')] AS f,
    [trim(substr(x, 8)) FOR x IN context IF starts_with(x, 'topics:')] AS p, [[trim(y) FOR y IN string_split(x, ';')] FOR x IN rows_e] AS cells_e,
    [regexp_replace(x, '[;\s]+$', '') <> x FOR x IN rows_a] AS tails, [[trim(y) FOR y IN string_split(regexp_replace(x, '[;\s]+$', ''), ';')] FOR x IN rows_a] AS cells_a FROM parted),
bodied AS (SELECT *, [[trim(y) FOR y IN string_split(x[1] || ' ', ' - ')] FOR x IN cells_a] AS arms_a FROM celled),
judged_graphs AS (SELECT *, framed AND len(m) = 1 AND len(f) = 1 AND len(p) = 1 AND m[1] <> '' AND f[1] <> '' AND p[1] <> ''
        AND len([1 FOR x IN cells_e IF list_contains(x, '') OR x[1] IN ('none', 'unknown')]) = 0
        AND len([1 FOR x IN arms_a IF len(x) NOT IN (2, 3) OR list_contains(x, '')]) = 0 AND len([1 FOR x IN cells_a IF len(x) > 3 OR list_contains(x, '') OR len([1 FOR y IN x[2:] IF contains(y || ' ', ' - ')]) > 0]) = 0 AS ok,
    NOT fenced AND NOT mixed AND NOT list_contains(tails, true) AND len([1 FOR x IN arms_a IF len(x) <> 3]) = 0 AND len([1 FOR x IN cells_a IF len(x) NOT IN (1, 3)]) = 0 AS written FROM bodied),
actions AS (SELECT output_id, len(cells_e) AS declared, unnest(range(1, len(cells_a) + 1)) AS k, unnest(cells_a) AS c, unnest(arms_a) AS b FROM judged_graphs WHERE ok),
values_of AS (SELECT output_id, declared, k, b[2] AS action, unnest([0, 1, 2, 4]) AS role, unnest([b[1], CASE WHEN len(b) = 2 THEN 'unknown' ELSE b[3] END, coalesce(c[2], 'none'), coalesce(c[3], 'unknown')]) AS v FROM actions),
written_ents AS (SELECT output_id, unnest(range(1, len(cells_e) + 1)) AS k, unnest(cells_e)[1] AS name, unnest(cells_e)[2:] AS attributes FROM judged_graphs WHERE ok),
lost AS (SELECT output_id, v AS name, min(k * 10 + role) AS place, any_value(declared) AS declared FROM values_of WHERE v NOT IN ('none', 'unknown')
    AND (output_id, v) NOT IN (SELECT output_id, name FROM written_ents) GROUP BY 1, 2),
ents AS (SELECT * FROM written_ents UNION ALL SELECT output_id, declared + row_number() OVER (PARTITION BY output_id ORDER BY place) AS k, name, CAST([] AS VARCHAR[]) AS attributes FROM lost),
numbers AS (SELECT output_id, name, max(k) AS k FROM ents GROUP BY 1, 2),
refs AS (SELECT r.output_id, r.k, r.action, r.role, r.v, n.k AS entity FROM values_of r LEFT JOIN numbers n ON r.output_id = n.output_id AND r.v = n.name),
graphs AS (SELECT g.*, ok AND written AND output_id NOT IN (SELECT output_id FROM lost) AS native FROM judged_graphs g)"""

#: Nodes, role states and context texts of the outputs in ``chosen`` (``output_id, content_id, scene_idx``) that can be read.
BUNDLE = r"""
sorted_ents AS (SELECT e.*, row_number() OVER (PARTITION BY output_id ORDER BY 'e' || k) - 1 AS node, count(*) OVER (PARTITION BY output_id) AS n FROM ents e JOIN chosen USING (output_id)),
sizes AS (SELECT c.*, coalesce(n, 0) AS n FROM chosen c JOIN graphs g ON c.output_id = g.output_id AND g.ok LEFT JOIN (SELECT output_id, count(*) AS n FROM ents GROUP BY 1) x ON c.output_id = x.output_id),
acts_of AS (SELECT DISTINCT s.content_id, s.scene_idx, s.output_id, r.k, r.action, CAST(n + r.k - 1 AS INTEGER) AS node FROM sizes s JOIN refs r USING (output_id)),
nodes AS (SELECT content_id, scene_idx, CAST(e.node AS INTEGER) AS node, 0 AS kind, 'e' || e.k AS key, trim('Name: ' || name || chr(10) || 'Attributes: ' || array_to_string(list_sort(attributes), ', ')) AS text
    FROM sorted_ents e JOIN chosen c USING (output_id) UNION ALL SELECT content_id, scene_idx, node, 1, 'action_' || (k - 1), trim(action) FROM acts_of),
states AS (SELECT a.content_id, a.scene_idx, a.node AS action_node, r.role, CASE WHEN e.node IS NOT NULL THEN -1 WHEN r.v = 'unknown' THEN 1 ELSE 0 END AS state, CAST(e.node AS INTEGER) AS entity_node
    FROM acts_of a JOIN refs r ON a.output_id = r.output_id AND a.k = r.k LEFT JOIN sorted_ents e ON r.output_id = e.output_id AND r.entity = e.k
    UNION ALL SELECT content_id, scene_idx, node, 3, 0, NULL FROM acts_of),
contexts AS (SELECT content_id, scene_idx, 'Format: ' || f[1] || chr(10) || 'Medium: ' || m[1] || chr(10) || 'Topics: ' ||
    CASE WHEN p[1] = 'none' THEN '' ELSE array_to_string(list_sort([trim(x) FOR x IN string_split(p[1], ';')]), ', ') END AS text FROM chosen JOIN graphs USING (output_id) WHERE ok)"""
