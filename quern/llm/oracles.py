"""DuckDB SQL for the corpus queries that SQL can express, over whole tables."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: word windows of items, found in documents, spread over the words that they cover
OP9 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  b AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
  gram AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
  hit AS (SELECT doc_id, i, m, item_id FROM gram JOIN win USING (m, g)),
  words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
  SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

#: shingle sets, their overlaps, and reachability by links
OP3 = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0))),
  n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
  l AS MATERIALIZED (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
  e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r AS (SELECT DISTINCT a AS doc_id, a AS seen FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen)
  SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(seen) AS c FROM r GROUP BY doc_id) m USING (doc_id)"""

OP5 = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS digest FROM pages),
  k AS (SELECT digest, size, max(page_id) AS keeper FROM p WHERE size >= 1000 GROUP BY digest, size)
  SELECT page_id, size AS payload_bytes, digest AS payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type, nullif(keeper, page_id) AS refers_to FROM p LEFT JOIN k USING (digest, size)"""


#: words, characters, lines and windows of three words that a text has twice
OP2_COUNTS = r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  l AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
  g AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
  p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM g) WHERE n > 1),
  c AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM p) GROUP BY r)
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(w) AS base_failed
  FROM d LEFT JOIN l ON l.r = d.r LEFT JOIN c ON c.r = d.r"""

#: matches of a pattern and the pieces between them alternate: lengths before a match are its start
_MATCHES = """SELECT r, {rank} AS rank, '{kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, s, m, v FROM (
    SELECT r, string_split_regex(t, '{pattern}') AS s, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS v FROM d)"""
_KINDS = (
    (0, "assign", r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    (1, "access", "AKIA[A-Z0-9]+", 0, 20), (2, "hex", "[0-9a-f]+", 0, 24),
)
OP4_BASE = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
  x AS ({" UNION ALL ".join(_MATCHES.format(rank=rank, kind=kind, pattern=pattern, group=group) for rank, kind, pattern, group, _ in _KINDS)}),
  y AS (SELECT r, rank, kind, (list_sum(list_transform(s[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0))::BIGINT AS start, length(m[i]) AS n, length(v[i]) AS k FROM x),
  z AS (SELECT *, start + n AS stop FROM y WHERE k >= [{", ".join(str(k[4]) for k in _KINDS)}][rank + 1]),
  a AS (SELECT r, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM z GROUP BY r)
  SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN a ON a.r = d.r"""

OP6_RULES = """WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM pages),
  p AS (SELECT page_id, translate(coalesce(regexp_extract(x, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(x, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
  k AS (SELECT unnest(['com', 'example.com', 'www.example.com', 'net', 'net']) AS h, unnest(['/', '/en/', '/en/', '/es/', '/fr/']) AS s, unnest(['allow', 'block', 'allow', 'block', 'block']) AS what)
  SELECT page_id, host, path, arg_max(h || s, length(h || s)) AS rule, arg_max(what, length(h || s)) AS verdict FROM p LEFT JOIN k ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id, host, path"""


#: equal texts, and which of them stays
OP11 = r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare FROM documents),
  r AS (SELECT doc_id, bare, row_number() OVER (PARTITION BY bare ORDER BY chars DESC, doc_id) AS place FROM d)
  SELECT doc_id, first_value(doc_id) OVER (PARTITION BY bare ORDER BY place) AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size, place = 1 AS kept, sha256(bare) AS text_sha256 FROM r"""

#: units, the two cuts, and the three forms
OP12 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || doc_id) AS h FROM documents),
  k AS (SELECT doc_id, t, w, len(w) AS n, list_transform([0, 1, 2, 3], lambda i: ('0x' || substr(h, 1 + 8 * i, 8))::UBIGINT::BIGINT) AS x FROM d),
  c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 50 THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
  p AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM c)
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def _clustering(k: int, rounds: int, dims: int, seed: int) -> str:
    """Each round two steps: the nearest centroid of each vector, then floored means."""
    near = "SELECT r, x, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (SELECT v.r, v.x, m.c, list_sum(list_transform(list_zip(v.x, m.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, m{i} m) GROUP BY r, x"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(i=i, k=k)})")
        if i < rounds:
            mean = f"SELECT c, list(floor_of ORDER BY p) AS x FROM (SELECT c, p, (s - ((s % n) + n) % n) // n AS floor_of FROM (SELECT c, p, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(x) AS y, unnest(range({dims})) AS p FROM a{i}) GROUP BY c, p)) GROUP BY c"
            steps.append(f"m{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.x, o.x) AS x FROM m{i} o LEFT JOIN ({mean}) n ON n.c = o.c)")
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = {dims}),
  m0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, x) - 1)::INTEGER AS c, x FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {k})),
  {", ".join(steps)}
  SELECT v.vec_id, a.c::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256
  FROM a{rounds} a JOIN v ON v.r = a.r JOIN m{rounds} m ON m.c = a.c"""


OP13 = _clustering(8, 10, 64, 3)


def oracle_sql() -> dict[str, str]:
    return {"quality_counts": OP2_COUNTS, "secret_base_spans": OP4_BASE, "url_rules": OP6_RULES, "op3_ngram_jaccard_join": OP3, "op5_warc": OP5, "op9_benchmark_decontamination": OP9, "op11_exact_dedup": OP11, "op12_fill_in_middle": OP12, "op13_centroid_clustering": OP13}
