"""The registered queries as DuckDB SQL, where SQL can express them."""

ORACLE: dict[str, str] = {}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op5_exact_dedup"] = f"""
WITH n AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, t FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""


def _secret_sql() -> str:
    rules = (
        ("assign", 0, r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", 1, "AKIA[A-Z0-9]+", 0, 20),
        ("hex", 2, "[0-9a-f]+", 0, 24),
        ("private_key", 3, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
        ("hub_token", 4, "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
        ("chat_token", 5, "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
        ("signed_token", 6, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", 0, 1),
    )
    parts = []
    for kind, rank, pattern, group, least in rules:
        parts.append(f"""
SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s, s + len(m) AS e FROM (
  SELECT doc_id, m, v,
    sum(len(g)) OVER (PARTITION BY doc_id ORDER BY i) + coalesce(sum(len(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM (
    SELECT doc_id, unnest(regexp_extract_all(t, '{pattern}', 0)) AS m, unnest(regexp_extract_all(t, '{pattern}', {group})) AS v,
      unnest(string_split_regex(t, '{pattern}')[:len(regexp_extract_all(t, '{pattern}', 0))]) AS g,
      unnest(range(len(regexp_extract_all(t, '{pattern}', 0)))) AS i
    FROM d)) WHERE len(v) >= {least}""")
    text = "coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank){}, '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, sha256({text.format(" FILTER (rank < 3)")}) AS base_sha256, {text.format("")} AS spans
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
"""


ORACLE["op8_secret_scan"] = _secret_sql()


#: Label, text and marks of the templates; of each group of marks at least one phrase must stand in a block.
_NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0", [["apache"], ["version 2", "license 2", "v 2"]]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", [["gnu general public license"], ["version 3", "license 3", "v 3", "or 3", "and 3"]]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", [["gnu general public license"], ["version 2", "versions 2", "license 2", "v 2"]]),
    ("cc-by-nc", "licensed under cc by nc 4 0", [["by nc"]]),
    ("cc-by-sa", "licensed under cc by sa 4 0", [["by sa"]]),
    ("mit", "released under the mit license", [["mit license", "mit licence", "the mit"]]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", [["associated"]]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", [["gnu general public license"]]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", []),
    (
        "cc-by",
        "this work is licensed under a creative commons attribution 4 0 international license",
        [["attribution 1", "attribution 2", "attribution 3", "attribution 4", "attribution international", "attribution license"]],
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", [["mozilla"], ["v 2", "version 2", "license 2"]]),
)


def _license_sql() -> str:
    base = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
    phrases = ", ".join(f"({i}, '{label}', string_split('{phrase}', ' '))" for i, (phrase, label) in enumerate(base))
    marks = lambda groups: " AND ".join("(" + " OR ".join(f"contains(block, ' {p} ')" for p in g) + ")" for g in groups) or "true"
    templates = ", ".join(f"({i}, '{label}', string_split('{text}', ' '))" for i, (label, text, _) in enumerate(_NOTICES))
    marked = " ".join(f"WHEN {i} THEN {marks(groups)}" for i, (_, _, groups) in enumerate(_NOTICES))
    longest = max(len(text.split()) for _, text, _ in _NOTICES)
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH p(i, label, ws) AS (VALUES {phrases}), n(i, label, ws) AS (VALUES {templates}),
t AS (
  SELECT i, label, list_distinct(ws) AS tokens,
    list_distinct([' ' || ws[k] || ' ' || ws[k + 1] || ' ' FOR k IN range(1, len(ws))]) AS pairs,
    list_concat([' ' || x || ' ' || ws[1] || ' ' FOR x IN ['not', 'never', 'no']],
      flatten([[' ' || ws[k] || ' ' || x || ' ' || ws[k + 1] || ' ' FOR x IN ['not', 'never', 'no']] FOR k IN range(1, len(ws))])) AS denied
  FROM n),
d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS x FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(x, '{gap}'), lambda a: a <> '') AS ws FROM d),
s AS (
  SELECT doc_id, p.label, k FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS k FROM w) q JOIN p
  ON q.ws[k + 1] = p.ws[1] AND q.ws[k + 1 : k + len(p.ws)] = p.ws),
b AS (SELECT doc_id, count(*) AS n, min(k) AS first_word, max(k) AS last_word, list(DISTINCT label) AS labels FROM s GROUP BY 1),
l AS (SELECT doc_id, ws[k : k + {2 * longest - 1}] AS ws FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {longest}, 1) + 1, {longest})) AS k FROM w)),
c AS (SELECT doc_id, list_distinct(ws) AS ws, ' ' || array_to_string(ws, ' ') || ' ' AS block FROM l),
m AS (
  SELECT doc_id, label, len(list_intersect(c.ws, t.tokens)) / len(t.tokens) AS containment FROM c, t
  WHERE len(list_intersect(c.ws, t.tokens)) >= ceil(0.8 * len(t.tokens) - 1e-9) AND CASE t.i {marked} END
    AND len(list_filter(t.pairs, lambda q: contains(block, q))) >= 0.6 * len(t.pairs) - 1e-9
    AND len(list_filter(t.denied, lambda q: contains(block, q))) = 0),
a AS (SELECT doc_id, list(DISTINCT label) AS labels, max(containment) AS containment FROM m GROUP BY 1)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(a.labels, [])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
"""


ORACLE["op4_license_scan"] = _license_sql()


def _quality_sql() -> str:
    gap = r"[\x20\x09-\x0D]+"
    bucket = "(({v}) >> greatest(len(bin({v})) - 6, 0)) << greatest(len(bin({v})) - 6, 0)"
    asked = (("symbols", "n_symbols", "n_words", False), ("word_length", "word_chars", "n_words", True), ("dup_lines", "n_dup_lines", "n_lines", False))
    rates = " UNION ALL ".join(
        f"SELECT doc_id, lang, source, '{name}' AS rate, {bucket.format(v=f'1000 * {top} // {bottom}')} AS bucket FROM m WHERE NOT base_failed AND {bottom} > 0"
        for name, top, bottom, _ in asked
    )
    quart = """
  SELECT {g}, rate, min(bucket) FILTER (4 * below >= total) AS q1, min(bucket) FILTER (4 * below >= 3 * total) AS q3, max(total) AS n FROM (
    SELECT *, sum(c) OVER (PARTITION BY {g}, rate ORDER BY bucket) AS below, sum(c) OVER (PARTITION BY {g}, rate) AS total FROM (
      SELECT {g}, rate, bucket, count(*) AS c FROM r GROUP BY ALL)) GROUP BY {g}, rate"""
    over = "({s} * (1000 * {top} - {name}.{side} * {bottom}) - 3000)::DOUBLE"
    far = f"({over} > 0 AND {over} * {over} > 9000.0::DOUBLE * greatest({{name}}.{{side}} * {{bottom}}, 0)::DOUBLE)"
    fails = ", ".join(
        f"CASE WHEN {bottom} > 0 AND ("
        + far.format(s=1, side="high", name=name, top=top, bottom=bottom)
        + (" OR " + far.format(s=-1, side="low", name=name, top=top, bottom=bottom) if low else "")
        + f") THEN '{name}' END"
        for name, top, bottom, low in asked
    )
    joins = " ".join(
        f"LEFT JOIN c AS {name} ON {name}.rate = '{name}' AND {name}.lang IS NOT DISTINCT FROM m.lang AND {name}.source IS NOT DISTINCT FROM m.source"
        for name, *_ in asked
    )
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{gap}'), lambda w: w <> '') AS ws FROM documents),
k AS (SELECT doc_id, i, ws[i : i + 2] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
y AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM k) WHERE c > 1),
z AS (SELECT doc_id, sum(least(3, i - p)) AS n FROM (SELECT doc_id, i, lag(i, 1, -9) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM y) GROUP BY 1),
e AS (
  SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
    (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (
  SELECT e.* EXCLUDE (ls), len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    n_words < 50 OR 100 * coalesce(n, 0) > 50 * n_words AS base_failed FROM e LEFT JOIN z USING (doc_id)),
r AS ({rates}),
f AS ({quart.format(g="lang, source")}), g AS ({quart.format(g="lang")}),
h AS (
  SELECT f.lang, f.source, f.rate, CASE WHEN f.n >= 50 THEN f.q1 ELSE g.q1 END AS q1, CASE WHEN f.n >= 50 THEN f.q3 ELSE g.q3 END AS q3
  FROM f JOIN g ON f.lang IS NOT DISTINCT FROM g.lang AND f.rate = g.rate),
i AS (SELECT *, q3 + (1::BIGINT << greatest(len(bin(q3)) - 6, 0)) AS q3_end FROM h),
c AS (SELECT lang, source, rate, q3_end + 3 * (q3_end - q1) AS high, q1 - 3 * (q3_end - q1) AS low FROM i)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM (SELECT m.*, array_to_string(list_filter([{fails}], lambda x: x IS NOT NULL), ',') AS failed_rules FROM m {joins})
"""


ORACLE["op2_quality_rules"] = _quality_sql()

ORACLE["op9_chat_format"] = """
WITH RECURSIVE m AS (
  SELECT *, length(text) % 16 AS fault,
    CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN CASE WHEN length(text) % 17 = 5 THEN turn - 2 ELSE turn END WHEN 'assistant' THEN turn - 1 END AS id,
    CASE WHEN turn IN (4, 5) THEN [turn - 4] WHEN turn IN (6, 7) THEN [turn - 4, turn - 2] ELSE [turn - 2] END AS one,
    CASE WHEN length(text) % 23 = 4 THEN [turn + 2] ELSE [] END AS more FROM conversations),
c AS (SELECT conv_id, id, min(turn) AS turn, arg_min(list_concat(one, more), turn) AS after FROM m WHERE kind = 'call' GROUP BY conv_id, id),
x AS (SELECT conv_id, id, unnest(after) AS a FROM c),
e AS (SELECT DISTINCT x.conv_id, x.id, x.a FROM x JOIN c ON c.conv_id = x.conv_id AND c.id = x.a),
z AS (SELECT conv_id, count(*) AS n FROM c GROUP BY conv_id),
w(conv_id, id, at_id, steps) AS (
  SELECT conv_id, id, id, 0 FROM c UNION
  SELECT w.conv_id, w.id, e.a, w.steps + 1 FROM w JOIN e ON e.conv_id = w.conv_id AND e.id = w.at_id JOIN z ON z.conv_id = w.conv_id WHERE w.steps < z.n),
g AS (
  SELECT w.conv_id, w.id, max(steps) AS level, max(c.turn) AS reach, max(steps) >= max(z.n) AS cyclic
  FROM w JOIN c ON c.conv_id = w.conv_id AND c.id = w.at_id JOIN z ON z.conv_id = w.conv_id GROUP BY w.conv_id, w.id),
v AS (
  SELECT c.conv_id, c.id, c.turn AS call_turn, CASE WHEN NOT cyclic THEN level END AS level, CASE WHEN NOT cyclic THEN reach END AS reach
  FROM c JOIN g ON g.conv_id = c.conv_id AND g.id = c.id),
r AS (SELECT DISTINCT conv_id, id FROM m WHERE kind = 'result'),
j AS (
  SELECT m.*, v.id IS NOT NULL AS called, r.id IS NOT NULL AS returned, v.level, v.reach, kind = 'call' AND m.turn <> call_turn AS later, 'c' || m.conv_id || '-' || m.id AS call_id,
    CASE WHEN fault = 0 THEN 'lookup' ELSE 'answer' END AS tool
  FROM m LEFT JOIN v ON v.conv_id = m.conv_id AND v.id = m.id LEFT JOIN r ON r.conv_id = m.conv_id AND r.id = m.id)
SELECT conv_id, turn, role, kind,
  CASE WHEN kind = 'message' THEN 'plain' WHEN kind = 'result' THEN CASE WHEN called THEN 'linked' ELSE 'orphan' END
    WHEN later THEN 'duplicate' WHEN level IS NULL THEN 'cyclic' WHEN returned THEN 'answered' ELSE 'pending' END AS status,
  CASE WHEN later AND reach < turn THEN turn ELSE coalesce(reach, turn) END AS at_turn, level::BIGINT AS level, CASE WHEN kind = 'result' THEN 1 ELSE 0 END AS step,
  CASE WHEN kind = 'call' THEN CASE WHEN fault = 0 THEN 'unknown tool' WHEN fault = 1 THEN 'type: turn' WHEN fault = 3 THEN 'arguments are not an object'
    WHEN fault = 4 THEN 'unknown: note' WHEN fault = 2 OR text IS NULL THEN 'missing: text' ELSE '' END END AS errors,
  CASE WHEN kind = 'result' THEN to_json({call_id: call_id, role: role, text: text}) WHEN kind = 'message' THEN to_json({role: role, text: text})
    WHEN fault = 1 THEN to_json({arguments: {text: text, turn: turn::VARCHAR}, call_id: call_id, role: role, text: text, tool: tool})
    WHEN fault = 2 THEN to_json({arguments: {turn: turn}, call_id: call_id, role: role, text: text, tool: tool})
    WHEN fault = 3 THEN to_json({arguments: 'turn ' || turn, call_id: call_id, role: role, text: text, tool: tool})
    WHEN fault = 4 THEN to_json({arguments: {note: role, text: text, turn: turn}, call_id: call_id, role: role, text: text, tool: tool})
    ELSE to_json({arguments: {text: text, turn: turn}, call_id: call_id, role: role, text: text, tool: tool}) END::VARCHAR AS json
FROM j
"""


def _centroid_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    assign = """
a{i} AS MATERIALIZED (
  SELECT r, arg_min(k, distance * 64 + k) AS k, min(distance) AS distance FROM (
    SELECT r, k, sum((e.x - c.x) * (e.x - c.x))::BIGINT AS distance FROM e JOIN c{i} c USING (d) GROUP BY r, k) GROUP BY r)"""
    move = """
s{i} AS (SELECT k, d, sum(x)::BIGINT AS s, count(*) AS n FROM a{i} JOIN e USING (r) GROUP BY k, d),
c{j} AS MATERIALIZED (
  SELECT k, d, (s - ((s % n) + n) % n) // n AS x FROM s{i} UNION ALL SELECT k, d, x FROM c{i} WHERE k NOT IN (SELECT k FROM a{i}))"""
    steps = [x for i in range(rounds) for x in (assign.format(i=i), move.format(i=i, j=i + 1))] + [assign.format(i=rounds)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS xs FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
e AS MATERIALIZED (SELECT r, unnest(xs) AS x, unnest(range({dims})) AS d FROM v),
f AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id), xs) - 1 AS k FROM v),
c0 AS MATERIALIZED (SELECT k, d, x FROM f JOIN e USING (r) WHERE k < {k}),
{",".join(steps)},
h AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, k::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN h USING (k)
"""


ORACLE["op11_centroid_clustering"] = _centroid_sql()


def _decontamination_sql() -> str:
    words = "list_filter(string_split_regex({}, '{}'), lambda a: a <> '')".format(_LOWER.format("coalesce(text, '')"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM documents),
b AS (SELECT item_id, {words} AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, array_to_string(ws[i : i + 9], ' ') AS phrase, least(10, len(ws)) AS size
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
z AS (SELECT DISTINCT size FROM w),
p AS (SELECT r, i, size, array_to_string(ws[i : i + size - 1], ' ') AS phrase
  FROM (SELECT r, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, z)),
o AS (SELECT DISTINCT r, i, p.size, item_id FROM p JOIN w USING (phrase)),
h AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT r, i, unnest(range(size)) AS k FROM o) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM o GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


ORACLE["op12_benchmark_decontamination"] = _decontamination_sql()
