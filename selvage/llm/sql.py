"""SQL of operators that go by rounds or levels: each is a common table expression, written from the one before."""

from __future__ import annotations

FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def codes(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """Codes, errors and codebooks of vectors cut into equal parts."""
    steps = [f"""
kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS HUGEINT)) AS v FROM embeddings WHERE {FINITE}),
pieces AS MATERIALIZED (
    SELECT vec_id, label, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS w FROM kept, (SELECT unnest(range({parts})) AS p)),
book0 AS MATERIALIZED (
    SELECT p, e, w FROM (SELECT p, w, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM pieces) WHERE e < {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
    SELECT vec_id, label, p, w, least_of.e AS e, least_of.d AS d FROM (
        SELECT vec_id, any_value(label) AS label, x.p, any_value(x.w) AS w,
            min(struct_pack(d := list_sum(list_transform(list_zip(x.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := b.e)) AS least_of
        FROM pieces x JOIN book{r} b ON x.p = b.p GROUP BY vec_id, x.p))""")
        if r < rounds:
            steps.append(f"""
means{r} AS MATERIALIZED (
    SELECT p, e, list(CAST(floor_of AS HUGEINT) ORDER BY i) AS w FROM (
        SELECT p, e, i, (sum(w[i]) - ((sum(w[i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_of
        FROM near{r}, (SELECT unnest(range(1, 1 + (SELECT max(len(w)) FROM pieces))) AS i) GROUP BY p, e, i) GROUP BY p, e),
book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.w, b.w) AS w FROM book{r} b LEFT JOIN means{r} m ON b.p = m.p AND b.e = m.e)""")
    return f"""
WITH {",".join(steps)},
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM coded"""


def clusters(k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: str = "3:") -> str:
    """Clusters, distances and centroids after all rounds."""
    steps = [f"""
kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS HUGEINT)) AS v FROM embeddings WHERE {FINITE} AND len(embedding) = {width}),
mid0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}' || vec_id), v) - 1 AS c, v FROM kept ORDER BY c LIMIT {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
    SELECT vec_id, any_value(x.v) AS v, min(struct_pack(d := list_sum(list_transform(list_zip(x.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c := m.c)) AS best
    FROM kept x CROSS JOIN mid{r} m GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""
means{r} AS MATERIALIZED (
    SELECT c, list(floor_of ORDER BY i) AS v FROM (
        SELECT best.c AS c, i, (sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_of
        FROM near{r}, (SELECT unnest(range(1, {width + 1})) AS i) GROUP BY best.c, i) GROUP BY c),
mid{r + 1} AS MATERIALIZED (SELECT b.c, coalesce(m.v, b.v) AS v FROM mid{r} b LEFT JOIN means{r} m ON b.c = m.c)""")
    return f"""
WITH {",".join(steps)}
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
    CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM near{rounds} n JOIN mid{rounds} m ON n.best.c = m.c"""


def urls(words: list[str], rules: list[tuple[str, str]], order: int = 5, alphabet: int = 256, folds: int = 4, false_rejects: float = 0.01) -> str:
    """Hosts, paths, rules and verdicts of pages; the models are tables of probabilities by order, one of accepted URLs without each fold."""
    listed = ", ".join(f"'{w}'" for w in words)
    fits = ", ".join(f"('{rule.partition('/')[0]}', '/{rule.partition('/')[2]}', '{rule}', '{verdict}')" for rule, verdict in rules)
    steps = [f"""
p0 AS MATERIALIZED (SELECT f, '' AS gram, 1.0::DOUBLE / {alphabet} AS pr, 1.0::DOUBLE / {alphabet} AS pa FROM folds)"""]
    for k in range(order + 1):
        steps.append(f"""
g{k} AS MATERIALIZED (
    SELECT f, w[{order + 1 - k}:{order + 1}] AS gram, w[{order + 1 - k}:{order}] AS context, sum(r) AS r, coalesce(sum(a) FILTER (fold <> f), 0) AS a FROM windows CROSS JOIN folds GROUP BY ALL),
c{k} AS MATERIALIZED (SELECT f, context, sum(r) AS nr, sum(a) AS na, count(*) FILTER (r > 0) AS tr, count(*) FILTER (a > 0) AS ta FROM g{k} GROUP BY f, context),
p{k + 1} AS MATERIALIZED (
    SELECT g.f, g.gram, CASE WHEN nr = 0 THEN p.pr ELSE (r + tr * p.pr) / (nr + tr) END AS pr, CASE WHEN na = 0 THEN p.pa ELSE (a + ta * p.pa) / (na + ta) END AS pa
    FROM g{k} g JOIN c{k} c ON g.f = c.f AND g.context = c.context JOIN p{k} p ON p.f = g.f AND p.gram = g.gram[{2 if k else 99}:])""")
    return f"""
WITH folds AS (SELECT unnest(range({folds})) AS f),
ruled AS MATERIALIZED (
    SELECT page_id, lower(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '')) AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
texts AS MATERIALIZED (
    SELECT regexp_replace(host || lower(path), '[0-9]', '0', 'g') AS text, max(CAST('0x' || sha256(host)[1:4] AS INTEGER) % {folds}) AS fold,
        max(len(list_intersect(regexp_split_to_array(host, '[.-]'), [{listed}])) > 0) AS rejected
    FROM ruled GROUP BY text),
cut AS MATERIALIZED (
    SELECT text, fold, rejected, unnest(list_transform(range(1, length(text) + 2), lambda i: (repeat(chr(2), {order}) || text || chr(3))[i:i + {order}])) AS w FROM texts),
windows AS MATERIALIZED (SELECT w, fold, count(*) FILTER (rejected) AS r, count(*) FILTER (NOT rejected) AS a FROM cut GROUP BY w, fold),
{",".join(steps).strip()},
scored AS MATERIALIZED (
    SELECT text, any_value(rejected) AS rejected, sum(round((ln(pr) - ln(pa)) * 1e9)) / 1e9 / (length(text) + 1) AS score
    FROM cut JOIN p{order + 1} ON gram = w AND f = fold GROUP BY text),
bins AS (
    SELECT bin, sum(n) OVER (ORDER BY bin DESC) AS above
    FROM (SELECT ceil(score * 100) AS bin, count(*) AS n FROM scored WHERE NOT rejected AND score > 0 GROUP BY bin)),
least_of AS (SELECT coalesce(max(bin) / 100, 0) AS t FROM bins WHERE above > {false_rejects} * (SELECT count(*) FROM scored WHERE NOT rejected)),
fitting AS (
    SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(fits.verdict, length(rule)) AS verdict
    FROM ruled JOIN (VALUES {fits}) AS fits(name, lead, rule, verdict) ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, lead) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN score > t THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled JOIN scored ON text = regexp_replace(host || lower(path), '[0-9]', '0', 'g') CROSS JOIN least_of LEFT JOIN fitting USING (page_id)"""
