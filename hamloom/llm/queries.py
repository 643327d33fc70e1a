"""Queries over the test tables and the SQL that must give the same rows."""

from __future__ import annotations

from hamloom.llm import abuse, increments, mixture, neighbours, proportions, quantiles, tag_groups, tokens

#: SQL of a digest's or tag's 64 hex digits, null if unreadable.
_BARE = r"regexp_replace(regexp_replace(lower({0}), '^[\s\x{{a0}}]*(0x|\\x|sha-?256[\s]*[:=]?|hex[:=])', ''), '[\s\x{{a0}}:_.,;/\-]', '', 'g')"


def hex_sql(c: str) -> str:
    bare = _BARE.format(c)
    return f"CASE WHEN regexp_full_match({bare}, '[0-9a-f]{{64}}') THEN {bare} END"


def name_sql(c: str) -> str:
    return f"lower(regexp_replace({c}, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g'))"


_MANIFEST = f"""m AS (SELECT id, max(split_id) AS split_id, max({name_sql('split_role')}) AS role, max({hex_sql('body_sha256')}) AS digest
  FROM manifest GROUP BY id)"""
_TAGS = f"""both_tags AS (
  SELECT record_id, NULL::VARCHAR AS rtype, {name_sql('type')} AS ttype, {hex_sql('tag_hex')} AS tag FROM tags
  UNION ALL SELECT record_id, {name_sql('type')}, NULL::VARCHAR, CASE WHEN octet_length(tag) = 32 THEN lower(hex(tag)) END FROM records),
record_tags AS (SELECT record_id, coalesce(max(rtype), max(ttype)) AS type, max(tag) AS tag FROM both_tags GROUP BY record_id),
distinct_tags AS (SELECT type, tag, min(record_id) AS record_id, count(*) AS n FROM record_tags WHERE tag IS NOT NULL AND type IS NOT NULL GROUP BY ALL)"""


def _words(c: str) -> str:
    return ", ".join(f"('0x' || substr({c}, {16 * i + 1}, 16))::UBIGINT AS w{i}" for i in range(4))


def _dist(a: str, b: str) -> str:
    return " + ".join(f"bit_count(xor({a}.w{i}, {b}.w{i}))::INT" for i in range(4))


_ONCE = f"""once AS (SELECT run_id, {name_sql('strategy')} AS strategy, {name_sql('type')} AS type, query_id, repeat,
  max(CASE WHEN latency_us >= 0 THEN latency_us END) AS v FROM prefuzz_verify GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY run_id, strategy, type ORDER BY v) AS r, count(*) OVER (PARTITION BY run_id, strategy, type) AS n
  FROM once WHERE v IS NOT NULL),
pct AS (SELECT run_id, strategy, type, max(n) AS n, max(v) FILTER (r = (n + 1) // 2) AS p50, max(v) FILTER (r = (95 * n + 99) // 100) AS p95 FROM ordered GROUP BY ALL)"""

#: Bounds of a double v by the upper 24 bits of its order key: the sign, 11 bits of the exponent and 12 of the mantissa.
_LOW = "CASE WHEN v = 0 THEN 0 ELSE floor(v / pow(2, floor(log2(v)) - 12)) * pow(2, floor(log2(v)) - 12) END"
_HIGH = f"CASE WHEN v = 0 THEN 0 ELSE {_LOW} + pow(2, floor(log2(v)) - 12) - 1e-9 END"

#: The order of ids in a sample: a signed integer of the first 64 bits of a hash.
_H = "('0x' || substr(sha256(coalesce(seed, '') || '/' || id), 1, 16))::UBIGINT"
_ORDER = f"CASE WHEN {_H} >= 9223372036854775808 THEN {_H}::HUGEINT - 18446744073709551616 ELSE {_H}::HUGEINT END"

_POOL = f"""{_MANIFEST},
pool AS (SELECT id, split_id, CASE WHEN digest IN (SELECT digest FROM m WHERE role = 'reference' AND digest IS NOT NULL) THEN 'exact_ref' ELSE 'no_exact_ref' END AS category
  FROM m WHERE role = 'query_pool' AND digest IS NOT NULL),
want AS (SELECT split_id, category, max(coalesce(target, 0)) AS target, max(coalesce(floor_, 0)) AS floor_ FROM (
  SELECT split_id, 'exact_ref' AS category, benchmark_groups.exact_ref AS target, verify_groups.exact_ref AS floor_ FROM split_summary
  UNION ALL SELECT split_id, 'no_exact_ref', benchmark_groups.no_exact_ref, verify_groups.no_exact_ref FROM split_summary) GROUP BY ALL),
have AS (SELECT split_id, category, count(*) AS n FROM pool GROUP BY ALL)"""

#: Seats by listing every rank's priority.
_SEATS = f"""{_POOL},
plan AS (SELECT w.split_id, w.category, target, floor_, coalesce(n, 0) AS available, least(coalesce(n, 0), floor_) AS low,
  sum(greatest(target, floor_)) OVER (PARTITION BY w.split_id) - sum(least(coalesce(n, 0), floor_)) OVER (PARTITION BY w.split_id) AS rest
  FROM want w LEFT JOIN have h ON h.split_id IS NOT DISTINCT FROM w.split_id AND h.category = w.category),
queue AS (SELECT split_id, category, rest, row_number() OVER (PARTITION BY split_id ORDER BY (r - 0.5) / target, category) AS k
  FROM plan, unnest(generate_series(low + 1, available)) AS u(r) WHERE target > 0),
extra AS (SELECT split_id, category, count(*) AS e FROM queue WHERE k <= rest GROUP BY ALL),
seats AS (SELECT plan.*, low + coalesce(e, 0) AS drawn FROM plan LEFT JOIN extra ON extra.split_id IS NOT DISTINCT FROM plan.split_id AND extra.category = plan.category)"""

_ARRIVALS = f"""{_MANIFEST}, {_TAGS},
w AS (SELECT id, min(batch_no) AS batch_no, max({name_sql('type')}) AS type, max({hex_sql('tag_hex')}) AS tag FROM queries_verify_100 GROUP BY id),
a AS (SELECT w.id, row_number() OVER (ORDER BY batch_no NULLS FIRST, w.id) AS i, digest, type, tag, {_words('tag')} FROM w LEFT JOIN m ON m.id = w.id),
t AS (SELECT type, tag, {_words('tag')} FROM distinct_tags),
old AS (SELECT id FROM a WHERE digest IN (SELECT digest FROM m WHERE role = 'reference' AND digest IS NOT NULL) OR id IN (SELECT a.id FROM a JOIN t ON a.type = t.type AND {_dist('a', 't')} <= 6)),
open_ AS (SELECT *, row_number() OVER (ORDER BY i) AS j FROM a WHERE id NOT IN (SELECT id FROM old)),
lk AS (SELECT x.j AS x, y.j AS y FROM open_ x JOIN open_ y ON y.j < x.j AND (x.digest = y.digest OR (x.type = y.type AND {_dist('x', 'y')} <= 6))),
step AS (SELECT x AS j, row_number() OVER (ORDER BY x) AS k FROM (SELECT DISTINCT x FROM lk)),
run AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS reps
  UNION ALL SELECT step.k, CASE WHEN EXISTS (SELECT 1 FROM lk WHERE lk.x = step.j AND NOT list_contains(run.reps, lk.y)) THEN list_append(run.reps, step.j) ELSE run.reps END FROM run JOIN step ON step.k = run.k + 1),
rp AS (SELECT id FROM open_ WHERE j IN (SELECT unnest(reps) FROM (SELECT reps FROM run ORDER BY k DESC LIMIT 1)) UNION ALL SELECT id FROM old)"""


def queries() -> dict:
    """All queries of this subpackage."""
    return {
        "p1_found": quantiles.p1_found,
        "p1_percentiles": quantiles.p1_percentiles,
        "p1_days": quantiles.p1_days,
        "p2_found": neighbours.p2_found,
        "p2_neighbours": neighbours.p2_neighbours,
        "p2_recall": neighbours.p2_recall,
        "p3_found": increments.p3_found,
        "p3_verdicts": increments.p3_verdicts,
        "p4_found": proportions.p4_found,
        "p4_report": proportions.p4_report,
        "p4_sample": proportions.p4_sample,
        "p6_found": tag_groups.p6_found,
        "p6_groups": tag_groups.p6_groups,
        "p7_ids": tokens.p7_ids,
        "p7_round_trip": tokens.p7_round_trip,
        "p8_found": mixture.p8_found,
        "p8_shares": mixture.p8_shares,
        "p8_schedule": mixture.p8_schedule,
        "p8_blocks": mixture.p8_blocks,
        "p9_found": abuse.p9_found,
        "p9_rates": abuse.p9_rates,
        "p9_scores": abuse.p9_scores,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; p2's is exact, where the operator may miss a few rows."""
    links = f"""t AS (SELECT type, tag, record_id, n, {_words('tag')} FROM distinct_tags),
links AS (SELECT a.record_id AS a, b.record_id AS b FROM t a JOIN t b ON a.type = b.type AND a.record_id <> b.record_id AND {_dist('a', 'b')} <= 6)"""
    groups = f"""WITH RECURSIVE {_TAGS}, {links},
reach AS (SELECT a AS node, b AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
comp AS (SELECT node, least(node, min(other)) AS group_id FROM reach GROUP BY node)"""
    near = f"""WITH {_TAGS}, t AS (SELECT type, tag, {_words('tag')} FROM distinct_tags),
d AS (SELECT a.type, a.tag, b.tag AS near, {_dist('a', 'b')} AS distance FROM t a JOIN t b ON a.type = b.type AND a.tag <> b.tag),
k AS (SELECT *, row_number() OVER (PARTITION BY type, tag ORDER BY distance, near) AS rank FROM d)"""
    return {
        "p1_found": f"WITH {_ONCE} SELECT run_id, strategy, type FROM pct WHERE p95 >= 10 * p50",
        "p1_percentiles": f"WITH {_ONCE} SELECT run_id, strategy, type, n, p50, p95 FROM pct",
        "p1_days": f"""WITH {_ONCE}, o AS (SELECT strategy, type, v::DOUBLE AS v, row_number() OVER (PARTITION BY strategy, type ORDER BY v) AS r, count(*) OVER (PARTITION BY strategy, type) AS n FROM once WHERE v IS NOT NULL),
x AS (SELECT strategy, type, n, '0.5' AS q, v FROM o WHERE r = (n + 1) // 2 UNION ALL SELECT strategy, type, n, '0.95', v FROM o WHERE r = (95 * n + 99) // 100)
SELECT strategy, type, n, q, round({_LOW}, 3) AS low, round({_HIGH}, 3) AS high FROM x""",
        "p2_found": f"{near} SELECT DISTINCT type, least(tag, near) AS tag_a, greatest(tag, near) AS tag_b FROM k WHERE rank <= 5 AND distance <= 48",
        "p2_recall": f"""WITH {_TAGS}, t AS (SELECT type, tag, {_words('tag')} FROM distinct_tags), s AS (SELECT type, tag, {_words('tag')} FROM distinct_tags WHERE record_id % 50 = 0)
SELECT s.type, count(DISTINCT s.tag) AS queries, count(DISTINCT s.tag) * least(5, max(n) - 1) AS wanted, true AS reached FROM s JOIN (SELECT type, count(*) AS n FROM t GROUP BY type) c ON c.type = s.type GROUP BY s.type HAVING max(n) > 1""",
        "p3_found": f"WITH RECURSIVE {_ARRIVALS} SELECT id FROM rp",
        "p3_verdicts": f"WITH RECURSIVE {_ARRIVALS} SELECT id, id IN (SELECT id FROM rp) AS repeat FROM a",
        "p4_found": f"WITH {_POOL} SELECT split_id, category FROM want LEFT JOIN have USING (split_id, category) WHERE coalesce(n, 0) < greatest(target, floor_)",
        "p4_report": f"WITH {_SEATS} SELECT split_id, category, available, target::BIGINT AS target, floor_ AS floor, drawn::BIGINT AS drawn, drawn < greatest(target, floor_) AS short FROM seats",
        "p4_sample": f"""WITH {_SEATS}, sd AS (SELECT split_id, max(sample_seed)::VARCHAR AS seed FROM split_summary GROUP BY split_id),
r AS (SELECT pool.*, row_number() OVER (PARTITION BY pool.split_id, category ORDER BY {_ORDER}, id) AS k FROM pool JOIN sd ON sd.split_id = pool.split_id)
SELECT r.split_id, r.category, id FROM r JOIN seats USING (split_id, category) WHERE k <= drawn""",
        "p6_found": f"{groups} SELECT group_id, r.record_id FROM comp JOIN t ON t.record_id = comp.node JOIN record_tags r ON r.type = t.type AND r.tag = t.tag",
        "p7_round_trip": "SELECT count(*) AS documents, count(*) AS restored FROM documents",
        "p6_groups": f"{groups} SELECT t.type, t.tag, t.record_id, t.n, group_id FROM comp JOIN t ON t.record_id = comp.node",
    }
