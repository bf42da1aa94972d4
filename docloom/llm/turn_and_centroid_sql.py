"""DuckDB SQL of conversation repair and centroid clustering, written from their definitions."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """The crc32 of an ASCII text, a bit at a time."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT)"
    bits = "list_reduce(list_prepend(xor(c, b), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda z, k: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {bits}), 4294967295)"


#: Role initials that fit behind each state, with the state behind them; the role an insert or reroling gives, with its state.
_KEEP = {1: {"s": 2, "u": 3}, 2: {"u": 3}, 3: {"a": 4}, 4: {"u": 3}}
_GIVE = {1: ("user", 3), 2: ("user", 3), 3: ("assistant", 4), 4: ("user", 3)}


def _way(state: str, cost: str, letter: str, line: str | None) -> str:
    """A way (cost, audit, turns) that begins with one edit."""
    text = f"{state}.t" if line is None else f"chr(10) || {line} || {state}.t"
    return f"{{'c': {state}.c + {cost}, 'a': '{letter}' || {state}.a, 't': {text}}}"


def _row_ways(s: int) -> str:
    """The least way from a state whose first edit but inserts is the row's own."""
    ways = [_way(f"v[{s}]", "3", "D", None)]
    role, to = _GIVE[s]
    ways.append(f"CASE WHEN NOT gone THEN {_way(f'v[{to}]', '2 + cut', 'R', f"'{role}:' || text")} END")
    ways += [f"CASE WHEN NOT gone AND left(role, 1) = '{x}' THEN {_way(f'v[{to}]', 'cut', 'K', "role || ':' || text")} END" for x, to in _KEEP[s].items()]
    return f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))"


def _with_inserts(s: int) -> str:
    """The least way that may begin with inserts."""
    ways, at, cost, letters, lines = [f"w[{s}]"], s, 0, "", ""
    for _ in range(2):
        role, at = _GIVE[at]
        cost, letters, lines = cost + 2, letters + "I", f"{lines}chr(10) || '{role}:' || "
        ways.append(f"{{'c': w[{at}].c + {cost}, 'a': '{letters}' || w[{at}].a, 't': {lines}w[{at}].t}}")
    return f"list_min([{', '.join(ways)}])"


REPAIR_SQL = f"""WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS z FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN z = 4 THEN 'user' ELSE role END AS role, CASE z WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE z WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM keyed),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, max(i) AS n FROM judged GROUP BY conv_id),
steps AS (SELECT conv_id, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT conv_id, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM judged) GROUP BY conv_id),
walk AS (SELECT conv_id, n AS i, [{{'c': 0, 'a': '', 't': ''}}, {{'c': 4, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}}, {{'c': 2, 'a': 'I', 't': chr(10) || 'assistant:'}}, {{'c': 0, 'a': '', 't': ''}}] AS v FROM facts
UNION ALL SELECT conv_id, i - 1, [{', '.join(_with_inserts(s) for s in range(1, 5))}] FROM (SELECT conv_id, i, [{', '.join(_row_ways(s) for s in range(1, 5))}] AS w
FROM (SELECT walk.conv_id, walk.i, v, j.role, j.text, j.fault IN ('blank', 'duplicate') AS gone, (j.fault = 'truncated')::INT AS cut FROM walk JOIN judged j ON j.conv_id IS NOT DISTINCT FROM walk.conv_id AND j.i = walk.i))),
best AS (SELECT conv_id, v[1] AS b FROM walk WHERE i = 0)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substring(b.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN steps s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id"""


def _distance(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _round(r: int) -> str:
    return f"""a{r} AS (SELECT rid, min({{'d': {_distance('v', 'c')}, 'k': k}}) AS m FROM kept, c{r} GROUP BY rid),
s{r} AS (SELECT k, pos, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT m.k AS k, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM a{r} JOIN kept USING (rid)) GROUP BY k, pos),
n{r} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS c FROM s{r} GROUP BY k),
c{r + 1} AS (SELECT c{r}.k, coalesce(n{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN n{r} USING (k)),"""


CENTROIDS_SQL = f"""WITH kept AS (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS k, v AS c FROM kept QUALIFY k < 16),
{''.join(_round(r) for r in range(3))}
a3 AS (SELECT rid, min({{'d': {_distance('v', 'c')}, 'k': k}}) AS m FROM kept, c3 GROUP BY rid)
SELECT vec_id, m.k::INT AS cluster, m.d::BIGINT AS distance, (sum(m.d) OVER (PARTITION BY m.k))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a3 JOIN kept USING (rid) JOIN c3 ON c3.k = m.k"""
