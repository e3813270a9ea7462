"""DuckDB SQL of the queries whose rows need many steps: written level by level."""

from __future__ import annotations

ROUNDS = 4


def _codes() -> str:
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""near{r} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, p, any_value(x) AS x, min(d * 256 + e) AS k
  FROM (SELECT a.vec_id, a.label, a.p, a.x, b.e, CAST(list_inner_product(a.x, a.x) - 2 * list_inner_product(a.x, b.x)
    + list_inner_product(b.x, b.x) AS BIGINT) AS d FROM parts a JOIN book{r} b ON a.p = b.p) GROUP BY vec_id, p)""")
        if r < ROUNDS:
            steps.append(f"""book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM book{r} b LEFT JOIN (
  SELECT p, e, list(c ORDER BY i) AS x FROM (SELECT p, e, i, floor(sum(c) / count(*)) AS c FROM (
    SELECT p, k % 256 AS e, unnest(x) AS c, unnest(range(len(x))) AS i FROM near{r}) GROUP BY p, e, i) GROUP BY p, e) n
  ON n.p = b.p AND n.e = b.e)""")
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM kept, range(4) t(p)),
book0 AS MATERIALIZED (SELECT p, e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 256),
{",".join(steps)},
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', k % 256), '' ORDER BY p) AS code,
  CAST(sum(k // 256) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda c: CAST(c AS BIGINT)), ','), ',' ORDER BY p, e)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded"""


CODES = _codes()

CHAT = r"""
WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
  CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')),
turns AS (SELECT *, regexp_replace(replace(text, '\', '\s'), '<(/?turn|more/)', '\\l\1', 'g') AS escaped,
  replace(regexp_replace(replace(role, '\', '\s'), '<(/?turn|more/)', '\\l\1', 'g'), '>', '\g') AS mark,
  row_number() OVER w AS i, lag(role) OVER w AS before, lead(role) OVER w AS after
  FROM given WINDOW w AS (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text)),
whole AS (SELECT conv_id, alone, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS turns,
  coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS loss,
  sum(length(escaped) + CASE WHEN before IS NOT DISTINCT FROM role THEN 7 ELSE 7 + length(mark) END
    + CASE WHEN after IS NOT DISTINCT FROM role THEN 0 ELSE 8 END) AS formatted_chars FROM turns GROUP BY conv_id, alone)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM whole"""


def _levels(name: str, key: str, levels: int) -> str:
    """CTEs of the nodes of all levels above `{name}0` (key, pos, c, h) and of what stands left and right of them."""
    steps = []
    for k in range(levels):
        run = f"PARTITION BY {key}, pos // 8 ORDER BY pos ROWS BETWEEN"
        steps.append(f"""{name}_s{k} AS MATERIALIZED (SELECT {key} AS key, pos, c,
  CASE WHEN c > 1 THEN coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l,
  CASE WHEN c > 1 THEN coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r FROM {name}{k})""")
        steps.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT {key}, pos // 8 AS pos, (c + 7) // 8 AS c, sha256(string_agg(h, '' ORDER BY pos)) AS h
  FROM {name}{k} WHERE c > 1 GROUP BY {key}, pos // 8, c UNION ALL SELECT {key}, pos, c, h FROM {name}{k} WHERE c = 1)""")
    return ",\n".join(steps)


def _manifest(levels: int = 7, top_levels: int = 3) -> str:
    def field(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps, top_steps = _levels("n", "lang", levels), _levels("t", "one", top_levels)
    folds, last = [], "f0"
    for name, key, count in (("n", "lang", levels), ("t", "one", top_levels)):
        for k in range(count):
            new = f"{name}_f{k}"
            place = "x.pos" if name == "n" else "x.lang_pos"
            folds.append(f"""{new} AS MATERIALIZED (SELECT x.* REPLACE (x.proof || s.l || s.r AS proof,
  CASE WHEN s.c > 1 THEN sha256(s.l || x.fold || s.r) ELSE x.fold END AS fold) FROM {last} x JOIN {name}_s{k} s
  ON s.key IS NOT DISTINCT FROM x.{key} AND s.pos = {place} // {8 ** k})""")
            last = new
    return f"""
WITH RECURSIVE crc AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS c
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL SELECT doc_id, s, i + 1, CASE WHEN i % 9 = 0 THEN xor(c, CAST(ascii(s[i // 9 + 1]) AS BIGINT))
    ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END) END FROM crc WHERE i < 9 * len(s)),
marked AS (SELECT doc_id AS marked_id, xor(c, CAST(4294967295 AS BIGINT)) % 3 = 0 AS hit FROM crc WHERE i = 9 * len(s)),
leaves AS (SELECT doc_id, lang, sha256({head} || {field("text")}) AS h,
  sha256({head} || CASE WHEN hit THEN {field(low)} ELSE {field("text")} END) AS other FROM documents LEFT JOIN marked ON marked_id = doc_id),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h, other) - 1 AS pos,
  count(*) OVER (PARTITION BY lang) AS c FROM leaves),
n0 AS (SELECT lang, pos, c, h FROM numbered),
{steps},
subroots AS MATERIALIZED (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS c FROM n{levels}),
t0 AS (SELECT 1 AS one, pos, c, h FROM subroots),
{top_steps},
f0 AS (SELECT x.doc_id, x.lang, x.pos, x.h AS leaf, s.h AS subroot, s.pos AS lang_pos, 1 AS one, '' AS proof, x.other AS fold
  FROM numbered x JOIN subroots s ON s.lang IS NOT DISTINCT FROM x.lang),
{",".join(folds)}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
FROM {last} JOIN (SELECT h AS root FROM t{top_levels}) ON true"""


MANIFEST = _manifest()
