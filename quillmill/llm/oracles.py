"""DuckDB SQL of the operators whose rounds or searches SQL has to spell out."""

from __future__ import annotations

#: The spaces of the contract, as a class for regular expressions.
NO_SPACE = r"[^\x20\x09-\x0D]"


def clustering_sql(rounds: int = 5, k: int = 40, dims: int = 64) -> str:
    """k-means by comparing every vector with every centroid, round after round."""
    square = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
        near{r} AS MATERIALIZED (
            SELECT v.n, min({square}::HUGEINT * {k} + c.c) AS best FROM v, c{r} c GROUP BY v.n
        )""")
        if r < rounds:
            steps.append(f"""
        sums{r} AS MATERIALIZED (
            SELECT (best % {k})::BIGINT AS c, i, sum(v.q[i])::BIGINT AS s, count(*) AS m
            FROM near{r} JOIN v USING (n), range(1, {dims + 1}) t(i) GROUP BY ALL
        ), c{r + 1} AS MATERIALIZED (
            SELECT c.c, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN (
                SELECT c, list((s - ((s % m) + m) % m) // m ORDER BY i) AS q FROM sums{r} GROUP BY c) m ON m.c = c.c
        )""")
    return f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS n, vec_id,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
            FROM embeddings WHERE len(embedding) = {dims}
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, q
            FROM v ORDER BY sha256('2:' || vec_id) LIMIT {k}
        ), {",".join(steps).strip()}
        SELECT v.vec_id, (best % {k})::INTEGER AS cluster, (best // {k})::BIGINT AS distance,
               (sum(best // {k}) OVER (PARTITION BY best % {k}))::BIGINT AS cluster_inertia,
               (sum(best // {k}) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
        FROM near{rounds} JOIN v USING (n) JOIN c{rounds} c ON c.c = best % {k}
    """


# Paths are strings: the cost in seven digits, then the letters; so the least string is the cheapest path, of equal
# ones the first by its letters. CRC-32 runs over a list of bytes, each with eight marks (-1) for a shift.
CONVERSATIONS = rf"""
    WITH RECURSIVE raw AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
        FROM conversations
    ), drawn AS (
        SELECT *, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(key, ''),
                   lambda ch: [ascii(ch), -1, -1, -1, -1, -1, -1, -1, -1]))),
                   lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295) % 20 AS draw
        FROM (SELECT conv_id, turn, role, text, key FROM raw)
    ), harmed AS (
        SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
               CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
        FROM drawn, range(0, 2) t(copy) WHERE draw <> 0 AND (copy = 0 OR draw = 3)
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen
        FROM harmed
    ), r AS MATERIALIZED (
        SELECT conv_id, i, turn, role, text, role[1] AS o,
               coalesce(i > 1 AND lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au'), false) AS odd,
               CASE WHEN NOT regexp_matches(text, '{NO_SPACE}') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
        FROM placed
    ), counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
               count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal, max(i) AS n
        FROM r GROUP BY conv_id
    ), walk AS (
        SELECT conv_id, 0::BIGINT AS i, '0000000' AS p, NULL::VARCHAR AS ps, NULL::VARCHAR AS pu, NULL::VARCHAR AS pa FROM counts
        UNION ALL
        SELECT conv_id, i,
               plus(p, 2, 'D'),
               least(plus(ps, 2, 'D'), CASE WHEN free AND o = 's' THEN plus(p, cut, 'K') END),
               least(plus(qu, 2, 'D'), CASE WHEN NOT free THEN NULL WHEN o = 'u' THEN least(plus(p, cut, 'K'), plus(ps, cut, 'K'), plus(qa, cut, 'K'))
                     ELSE least(plus(p, 1 + cut, 'R'), plus(ps, 1 + cut, 'R'), plus(qa, 1 + cut, 'R')) END),
               least(plus(qa, 2, 'D'), CASE WHEN NOT free THEN NULL WHEN o = 'a' THEN plus(qu, cut, 'K') ELSE plus(qu, 1 + cut, 'R') END)
        FROM (SELECT r.conv_id, r.i, r.o, r.fault NOT IN ('blank', 'duplicate') AS free,
                     CASE WHEN r.fault = 'truncated' THEN 5 ELSE 0 END AS cut, p, ps, pu,
                     least(pu, plus(p, 5, 'I'), plus(ps, 5, 'I'), plus(pa, 5, 'I')) AS qu,
                     least(pa, plus(least(pu, plus(p, 5, 'I'), plus(ps, 5, 'I')), 5, 'I')) AS qa
              FROM walk w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1)
    ), best AS (
        SELECT c.conv_id, least(p, least(pa, plus(least(pu, plus(p, 5, 'I'), plus(ps, 5, 'I')), 5, 'I'))) AS path
        FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = c.n
    ), letters AS (
        SELECT conv_id, k, path[7 + k] AS e,
               sum((path[7 + k] <> 'I')::INT) OVER w AS i, sum((path[7 + k] <> 'D')::INT) OVER w AS j
        FROM best, unnest(range(1, len(path) - 6)) t(k) WINDOW w AS (PARTITION BY conv_id ORDER BY k)
    ), lines AS (
        SELECT l.*, r.role, r.text,
               max((l.j = 1 AND l.e = 'K' AND r.o = 's')::INT) OVER (PARTITION BY l.conv_id) AS s
        FROM letters l LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i WHERE l.e <> 'D'
    ), mended AS (
        SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (j - s) % 2 = 1 THEN 'user' ELSE 'assistant' END
                   || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS body
        FROM lines GROUP BY conv_id
    )
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
           coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
           coalesce(illegal, 0)::BIGINT AS illegal, coalesce(path[:7]::BIGINT, 0) AS cost,
           coalesce(path[8:], '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def conversations_sql() -> str:
    """plus(path, cost, letter) written out: a macro would have to be made beforehand."""
    out, rest = "", CONVERSATIONS
    while "plus(" in rest:
        # the innermost call first
        start = rest.rindex("plus(")
        depth, at = 1, start + 5
        while depth:
            depth += {"(": 1, ")": -1}.get(rest[at], 0)
            at += 1
        inner = rest[start + 5 : at - 1]
        path, cost, letter = inner.rsplit(",", 2)
        text = f"(lpad((left({path}, 7)::INT + {cost.strip()})::VARCHAR, 7, '0') || substr({path}, 8) || {letter.strip()})"
        rest = rest[:start] + text + rest[at:]
    return out + rest
