"""The secret scan in SQL: spans from running lengths, entropy of every window counted from scratch."""

from txnlake.llm.secrets import ALLOWED, CANDIDATE, CLASSES, KINDS, TERMS, WINDOW, limit


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _places(name: str, pattern: str) -> str:
    return f"""{name}_lists AS (
  SELECT id, regexp_extract_all(body, {_quoted(pattern)}) AS hits, string_split_regex(body, {_quoted(pattern)}) AS gaps FROM docs),
{name}_rows AS (
  SELECT id, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS k FROM {name}_lists WHERE len(hits) > 0),
{name}_at AS (
  SELECT id, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY id ORDER BY k ROWS UNBOUNDED PRECEDING) AS stop FROM {name}_rows)"""


_KINDS = ",\n".join(_places(k, p) for k, (p, _, _) in KINDS.items())
_FIXED = "\nUNION ALL ".join(
    f"SELECT id, stop - length(hit) AS start, {rank} AS rank, stop FROM {k}_at WHERE length("
    + (f"regexp_extract(hit, {_quoted(p)}, {group})" if group else "hit") + f") >= {least}"
    for rank, (k, (p, group, least)) in enumerate(KINDS.items()))
_LIMIT = " ".join(f"WHEN regexp_matches(hit, {_quoted(p)}) THEN {limit(bits)}" for _, p, bits in CLASSES)
_NAMES = "[" + ", ".join(f"'{k}'" for k in [*KINDS, "entropy"]) + "]"
_LABEL = f"({_NAMES})[rank + 1] || ':' || start || ':' || stop"

SECRET_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS body FROM documents),
{_KINDS},
{_places("candidate", CANDIDATE)},
fixed AS ({_FIXED}),
tried AS (
  SELECT id, row_number() OVER () AS c, stop - length(hit) AS start, hit,
    CASE WHEN regexp_matches(hit, {_quoted(ALLOWED)}) THEN -1 {_LIMIT} END AS most FROM candidate_at),
windows AS (SELECT c, id, start, most, hit, unnest(range(0, length(hit) - {WINDOW} + 1)) AS w FROM tried WHERE most >= 0),
letters AS (SELECT c, w, unnest(string_split(substr(hit, w + 1, {WINDOW}), '')) AS letter FROM windows),
counted AS (SELECT c, w, letter, count(*) AS n FROM letters GROUP BY ALL),
summed AS (SELECT c, w, sum(({TERMS})[n + 1]) AS total FROM counted GROUP BY ALL),
hit_windows AS (
  SELECT t.id, t.c, t.start, min(s.w) AS first, max(s.w) AS last FROM summed s JOIN tried t USING (c) WHERE s.total <= t.most GROUP BY ALL),
added AS (SELECT id, start + first AS start, {len(KINDS)} AS rank, start + last + {WINDOW} AS stop FROM hit_windows),
spans AS (
  SELECT * FROM fixed UNION ALL
  SELECT * FROM added a WHERE NOT EXISTS (SELECT 1 FROM fixed f WHERE f.id = a.id AND f.start <= a.start AND a.stop <= f.stop)),
joined AS (
  SELECT id, {", ".join(f"count(*) FILTER (rank = {i}) AS n_{k}" for i, k in enumerate(KINDS))},
    string_agg({_LABEL}, ',' ORDER BY start, rank, stop) FILTER (rank < {len(KINDS)}) AS base,
    string_agg({_LABEL}, ',' ORDER BY start, rank, stop) AS spans
  FROM spans GROUP BY id)
SELECT d.doc_id, {", ".join(f"coalesce(j.n_{k}, 0)::BIGINT AS n_{k}" for k in KINDS)},
  sha256(coalesce(j.base, '')) AS base_sha256, coalesce(j.spans, '') AS spans
FROM docs d LEFT JOIN joined j USING (id)"""
