"""DuckDB SQL of entity resolution: similarity by bit-parallel subsequences, clusters and the ordered check."""

from __future__ import annotations

from millrace.plans.scalar_queries import SORT_SQL, WORDS_SQL, bare_sql

#: Longest common subsequence of b with a, whose letters are bit masks; strings of up to 120 letters.
LCS = "(a.n - bit_count(list_reduce(list_concat([a.whole], list_transform(b.cs, lambda c: coalesce(a.masks[c], 0::HUGEINT))), lambda v, x: ((v + (v & x)) | (v - (v & x))) & a.whole)))"
TEXT = "concat_ws(' ', title_normalized, company_normalized)"


def masked(strings: str) -> str:
    """Distinct strings ``s`` with their letters and the positions of each letter as bits."""
    letter = "list_sum(list_transform(range(length(s)), lambda i: CASE WHEN substr(s, (i + 1)::INTEGER, 1) = c THEN 1::HUGEINT << i::HUGEINT ELSE 0::HUGEINT END))::HUGEINT"
    return f"SELECT s, length(s) AS n, string_split(s, '') AS cs, map_from_entries(list_transform(list_distinct(string_split(s, '')), lambda c: {{'k': c, 'v': {letter}}})) AS masks, (1::HUGEINT << length(s)::HUGEINT) - 1 AS whole FROM (SELECT DISTINCT s FROM {strings})"


def alike(left: str, right: str, threshold: int, extra: str = "true") -> str:
    """(a, b, score) of masked tables with a ratio of at least ``threshold``; edits with exchanges are no more than those without, so levenshtein loses nothing."""
    far = 100 - threshold
    return f"SELECT a.s AS a, b.s AS b, 200.0 * {LCS} / (a.n + b.n) AS score FROM {left} a JOIN {right} b ON {extra} WHERE 100 * abs(a.n - b.n) <= {far} * (a.n + b.n) AND 100 * levenshtein(a.s, b.s) <= {far} * (a.n + b.n) AND 100 * (a.n + b.n - 2 * {LCS}) <= {far} * (a.n + b.n)"


FINGERPRINTS = f"(SELECT {bare_sql('title')} || '|' || {bare_sql('company')} AS s FROM raw_postings)"
FUZZY_PAIRS = f"WITH m AS MATERIALIZED ({masked(FINGERPRINTS)}) {alike('m', 'm', 85, 'a.s < b.s')}"
CLUSTERS = f"""WITH RECURSIVE m AS MATERIALIZED ({masked(FINGERPRINTS)}), near AS MATERIALIZED ({alike('m', 'm', 85, 'a.s < b.s')}),
both_ways AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reached AS (SELECT a AS s, a AS t FROM both_ways UNION SELECT r.s, e.b FROM reached r JOIN both_ways e ON e.a = r.t),
named AS (SELECT s, min(t) AS cluster FROM reached GROUP BY s),
p AS (SELECT DISTINCT id, scraped_at, {bare_sql('title')} || '|' || {bare_sql('company')} AS s FROM raw_postings),
q AS (SELECT p.*, coalesce(named.cluster, p.s) AS cluster FROM p LEFT JOIN named USING (s))
SELECT id, cluster, (epoch_us(scraped_at), id) = min((epoch_us(scraped_at), id)) OVER (PARTITION BY cluster) AS kept FROM q"""

OLD = f"old AS MATERIALIZED (SELECT job_id AS id, row_number() OVER (ORDER BY fetched_at DESC, job_id) AS place, url, description, {SORT_SQL.format(TEXT)} AS s FROM jobs WHERE duplicate_of IS NULL)"
NEW = f"new AS MATERIALIZED (SELECT arrival_id::VARCHAR AS id, arrival_id AS place, url, description, {SORT_SQL.format(TEXT)} AS s FROM incoming_jobs)"
MET = f"mn AS MATERIALIZED ({masked('new')}), mo AS MATERIALIZED ({masked('old')}), met AS MATERIALIZED ({alike('mn', 'mo', 70)})"
BEST = """best AS (SELECT n.id AS new_id, arg_max(struct_pack(id := o.id, score := met.score), (met.score, -o.place)) AS m FROM {new} n JOIN met ON met.a = n.s JOIN old o ON o.s = met.b GROUP BY n.id)"""
BEST_MATCH = f"WITH {OLD}, {NEW}, {MET}, {BEST.format(new='new')} SELECT new_id, m.id AS old_id, m.score FROM best"


def shared(a: str, b: str) -> str:
    """Shared over all words of two descriptions."""
    x, y = WORDS_SQL.format(a), WORDS_SQL.format(b)
    union = f"len(list_distinct(list_concat({x}, {y})))"
    return f"(CASE WHEN {union} = 0 THEN 0.0 ELSE len(list_intersect({x}, {y})) / {union} END)"


CHECK = f"""WITH {OLD}, {NEW}, {MET},
exact AS (SELECT n.id AS new_id, arg_min(o.id, o.place) AS canonical_id FROM new n JOIN old o ON n.url = o.url GROUP BY n.id),
rest AS (SELECT * FROM new WHERE id NOT IN (SELECT new_id FROM exact)), {BEST.format(new='rest')},
told AS (SELECT b.new_id, b.m.id AS canonical_id, b.m.score AS score, {shared('n.description', 'o.description')} AS j FROM best b JOIN new n ON n.id = b.new_id JOIN old o ON o.id = b.m.id)
SELECT new_id, canonical_id, 'url_exact' AS match_type, NULL::DOUBLE AS match_score FROM exact
UNION ALL SELECT new_id, canonical_id, CASE WHEN score >= 90 THEN 'fuzzy_title_company' ELSE 'description_similarity' END, CASE WHEN score >= 90 THEN round_even(score / 100, 4) ELSE j END FROM told WHERE score >= 90 OR j >= 0.5"""


def in_order(old: str) -> str:
    """The ordered check of the arrivals against ``old`` and what was accepted before, one arrival after the other."""
    return f"""WITH RECURSIVE {old}, {NEW},
first_of AS (SELECT url, min(place) AS place FROM new WHERE url IS NOT NULL GROUP BY url),
again AS (SELECT id FROM new WHERE url IN (SELECT url FROM old WHERE url IS NOT NULL) UNION SELECT n.id FROM new n JOIN first_of f ON f.url = n.url AND f.place < n.place),
rows_left AS MATERIALIZED (SELECT * FROM new WHERE id NOT IN (SELECT id FROM again)),
mn AS MATERIALIZED ({masked('rows_left')}), mo AS MATERIALIZED ({masked('old')}), met AS MATERIALIZED ({alike('mn', 'mo', 70)}), among AS MATERIALIZED ({alike('mn', 'mn', 70, 'a.s <= b.s')}),
edges AS MATERIALIZED (
SELECT n.id AS new_id, o.id AS other, met.score, 0 AS kind, o.place, {shared('n.description', 'o.description')} AS j FROM rows_left n JOIN met ON met.a = n.s JOIN old o ON o.s = met.b
UNION ALL SELECT n.id, o.id, e.score, 1, o.place, {shared('n.description', 'o.description')} FROM rows_left n JOIN (SELECT a, b, score FROM among UNION SELECT b, a, score FROM among) e ON e.a = n.s JOIN rows_left o ON o.s = e.b AND o.place < n.place),
turns AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY place) AS i FROM rows_left WHERE id IN (SELECT new_id FROM edges)),
steps AS (
SELECT 0::BIGINT AS i, []::VARCHAR[] AS dropped, NULL::VARCHAR AS id, NULL::VARCHAR AS decision, NULL::STRUCT(other VARCHAR, score DOUBLE, j DOUBLE) AS m
UNION ALL
SELECT i, CASE WHEN decision <> 'canonical' THEN list_append(dropped, id) ELSE dropped END, id, decision, m FROM (
SELECT i, dropped, id, m, CASE WHEN m.score >= 90 THEN 'fuzzy_title_company' WHEN m.j >= 0.5 THEN 'description_similarity' ELSE 'canonical' END AS decision FROM (
SELECT t.i AS i, any_value(s.dropped) AS dropped, t.id AS id, arg_max(struct_pack(other := e.other, score := e.score::DOUBLE, j := e.j::DOUBLE), (e.score, -e.kind, -e.place)) FILTER (WHERE NOT list_contains(s.dropped, e.other)) AS m
FROM steps s JOIN turns t ON t.i = s.i + 1 JOIN edges e ON e.new_id = t.id GROUP BY t.i, t.id)))
SELECT id AS new_id, decision, CASE WHEN decision <> 'canonical' THEN m.other END AS canonical_id, CASE decision WHEN 'fuzzy_title_company' THEN round_even(m.score / 100, 4) WHEN 'description_similarity' THEN m.j END AS match_score FROM steps WHERE id IS NOT NULL
UNION ALL SELECT id, 'canonical', NULL, NULL FROM rows_left WHERE id NOT IN (SELECT new_id FROM edges)
UNION ALL SELECT id, 'within_run_dup', NULL, NULL FROM again"""


CROSS_RUN = in_order(OLD)
SEED = in_order(OLD.replace("WHERE duplicate_of IS NULL", "WHERE false"))
