"""SQL that gives the rows of the core's queries, written for DuckDB without use of Spark's results."""

from __future__ import annotations

import math

from hamloom.functions.bits import segment_bounds
from hamloom.functions.text import RECOVERY_DOMAIN, TAG_DOMAIN, field_prefix
from hamloom.operators import filters
from hamloom.plans.registry import BENCHMARK, DELTA, PAIRS, POOL, SEED

BLANK = r"[\s\x{a0}]"


def hex_sql(c: str) -> str:
    """The 64 hex digits of a digest or tag in any spelling, null if unreadable."""
    bare = rf"regexp_replace(regexp_replace(lower({c}), '^{BLANK}*(0x|\\x|sha-?256[\s]*[:=]?|hex[:=])', ''), '[\s\x{{a0}}:_.,;/\-]', '', 'g')"
    return f"CASE WHEN regexp_full_match({bare}, '[0-9a-f]{{64}}') THEN {bare} END"


def name_sql(c: str) -> str:
    """Lower case without blanks around."""
    return f"lower(regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g'))"


def blob(data: bytes) -> str:
    return "'" + "".join(f"\\x{b:02X}" for b in data) + "'::BLOB"


def words_sql(c: str = "tag", p: str = "w") -> str:
    return ", ".join(f"('0x' || substr({c}, {16 * i + 1}, 16))::UBIGINT AS {p}{i}" for i in range(4))


def dist(a: str, b: str, words: range = range(4)) -> str:
    return "(" + " + ".join(f"bit_count(xor({a}{i}, {b}{i}))::INT" for i in words) + ")"


def weight_sql(p: str = "w") -> str:
    return "(" + " + ".join(f"bit_count({p}{i})::INT" for i in range(4)) + ")"


MANIFEST = f"""m AS (SELECT id, max(split_id) AS split_id, max({name_sql('split_role')}) AS role, max({hex_sql('body_sha256')}) AS digest
  FROM manifest GROUP BY id)"""
RECORDS = f"""both_tags AS (
  SELECT record_id, NULL::VARCHAR AS rtype, {name_sql('type')} AS ttype, {hex_sql('tag_hex')} AS tag FROM tags
  UNION ALL SELECT record_id, {name_sql('type')}, NULL::VARCHAR, CASE WHEN octet_length(tag) = 32 THEN lower(hex(tag)) END FROM records),
rec AS (SELECT * FROM (SELECT record_id, coalesce(max(rtype), max(ttype)) AS type, max(tag) AS tag FROM both_tags GROUP BY record_id) WHERE tag IS NOT NULL AND type IS NOT NULL),
r AS (SELECT type, tag, count(*) AS n, {words_sql()} FROM rec GROUP BY type, tag)"""
ARRIVING = f"""arr AS (SELECT id AS query_id, max({name_sql('type')}) AS type, max({hex_sql('tag_hex')}) AS tag FROM queries_verify_100 GROUP BY id),
q AS (SELECT DISTINCT type, tag AS query_tag, {words_sql('tag', 'q')} FROM arr WHERE tag IS NOT NULL AND type IS NOT NULL)"""
COUNTERS = ("candidate_count", "filter_queries", "inverted_lookups", "posting_records_read", "full_tag_distance_computations")
MEASURED = f"""ms AS (SELECT run_id, {name_sql('strategy')} AS strategy, {name_sql('type')} AS type, query_id, repeat,
  max(CASE WHEN latency_us >= 0 THEN latency_us END) AS latency_us, {', '.join(f'max({c}) AS {c}' for c in COUNTERS)} FROM prefuzz_verify GROUP BY ALL)"""
POOLED = f"""{MANIFEST}, lab AS (SELECT id, CASE WHEN digest IN (SELECT digest FROM m WHERE role = 'reference' AND digest IS NOT NULL) THEN 'exact_ref' ELSE 'no_exact_ref' END AS grp
  FROM m WHERE role = 'query_pool')"""


def radius(limit: str) -> str:
    return f"hits AS (SELECT r.type, q.query_tag, r.tag, {dist('w', 'q')} AS distance, r.n FROM r JOIN q ON r.type = q.type AND {dist('w', 'q')} <= {limit})"


def tag_sql(source: str, key: str, text: str, domain: str) -> str:
    """CTEs that end in tagged (key, tag): the similarity tags of texts, bit by bit."""
    bits = ", ".join(f"sum((v[{b} + 1]::INT >> {k}) & 1) AS s{b * 8 + k}" for b in range(32) for k in range(8))
    byte = lambda b: " + ".join(f"(CASE WHEN 2 * s{8 * b + k} >= c THEN {1 << k} ELSE 0 END)" for k in range(8))
    tag = " || ".join(f"printf('%02x', ({byte(b)})::INT)" for b in range(32))
    size = "unhex(printf('%08x', strlen(f)::INT))"
    return f"""wd AS (SELECT {key}, list_transform(regexp_extract_all({text}, '[0-9A-Za-z]+'), lambda x: lower(x)) AS w FROM {source}),
ft AS (SELECT {key}, unnest(CASE WHEN len(w) = 0 THEN ['empty'] WHEN len(w) < 3 THEN [w[1]] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(31) || w[i + 1] || chr(31) || w[i + 2]) END) AS f FROM wd),
dg AS (SELECT {key}, sha256({blob(field_prefix(domain))} || {size} || f::BLOB) AS h FROM ft),
vo AS (SELECT {key}, list_transform(range(0, 32), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::INT) AS v FROM dg),
sm AS (SELECT {key}, count(*) AS c, {bits} FROM vo GROUP BY {key}),
tagged AS (SELECT {key}, {tag} AS tag FROM sm)"""


def segments_sql(source: str, cols: str, delta: int = DELTA) -> str:
    """Rows of `source` with segment and value, the value's bytes as hex."""
    each = []
    for j, (lo, hi) in enumerate(segment_bounds(256, delta + 1)):
        n = hi - lo
        pad = -n % 8
        value = f"substr(bits, {lo + 1}, {n}) || repeat('0', {pad})"
        each.append(f"SELECT {cols}, {j}::BIGINT AS segment, '{n:02x}000000' || {' || '.join(_nibble(value, i) for i in range((n + pad) // 4))} AS value FROM bitted")
    return f"bitted AS (SELECT *, {_bits('tag')} AS bits FROM {source}), seg AS ({' UNION ALL '.join(each)})"


def _bits(c: str) -> str:
    """256 characters 0 and 1."""
    return f"list_aggregate(list_transform(range(1, 65), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][(instr('0123456789abcdef', substr({c}, i::INT, 1)))::INT]), 'string_agg', '')"


def _nibble(bits: str, i: int) -> str:
    part = f"substr({bits}, {4 * i + 1}, 4)"
    return f"substr('0123456789abcdef', 1 + 8 * ({part}[1])::INT + 4 * ({part}[2])::INT + 2 * ({part}[3])::INT + ({part}[4])::INT, 1)"


def _fingerprint(value: str, bins: str, bits: int) -> str:
    """struct of bin and mini of a hex value, over 128-bit integers."""
    mod = "18446744073709551616::UHUGEINT"
    n = "(strlen({0}) // 2)".format(value)
    fnv = f"list_reduce(list_prepend({filters.FNV_OFFSET}::UHUGEINT, list_transform(range(0, {n}), lambda i: ('0x' || substr({value}, (2 * i + 1)::INT, 2))::INT::UHUGEINT)), lambda h, b: (xor(h, b) * {filters.FNV_PRIME}::UHUGEINT) % {mod})"

    def mix(x: str) -> str:
        a = f"((xor({x}, {x} >> 30) * {filters.MIX_1}::UHUGEINT) % {mod})"
        return a

    return fnv, mix, mod


_KEYS = f"""body AS (SELECT max({hex_sql('body_sha256')}) AS key_hex FROM manifest GROUP BY id),
posting AS (SELECT lower(hex(value)) AS key_hex FROM (SELECT DISTINCT type, segment, value, record_id FROM postings)),
counts AS (SELECT 'body' AS key_kind, key_hex, count(*) AS n FROM body WHERE key_hex IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'posting', key_hex, count(*) FROM posting WHERE key_hex IS NOT NULL GROUP BY ALL),
totals AS (SELECT key_kind, sum(n) AS total FROM counts GROUP BY ALL)"""


def _filter_ctes(delta: int = DELTA) -> str:
    """Fingerprints of stored (sp) and asked (ap) segment values, by the filter's sizes."""
    fnv, _, mod = _fingerprint("value", "bins", 14)
    bits, _ = filters.sizing(1, 0.01)
    step = f"""fs AS (SELECT DISTINCT value, {fnv} AS h FROM (SELECT value FROM stored UNION SELECT value FROM asked)),
f1 AS (SELECT value, h, (xor(h, h >> 30) * {filters.MIX_1}::UHUGEINT) % {mod} AS a, xor(h, {filters.GOLDEN}::UHUGEINT) AS g FROM fs),
f2 AS (SELECT value, (xor(a, a >> 27) * {filters.MIX_2}::UHUGEINT) % {mod} AS b, (xor(g, g >> 30) * {filters.MIX_1}::UHUGEINT) % {mod} AS ga FROM f1),
f3 AS (SELECT value, xor(b, b >> 31) AS hb, (xor(ga, ga >> 27) * {filters.MIX_2}::UHUGEINT) % {mod} AS gb FROM f2),
fp AS (SELECT value, hb, xor(gb, gb >> 31) % {1 << bits}::UHUGEINT AS mini FROM f3),
cap AS (SELECT type, count(*) AS n, greatest(ceil(count(*) / {filters.BIN_CAPACITY * filters.BIN_FILL}), 1)::UHUGEINT AS bins FROM rec GROUP BY type),
sp AS (SELECT DISTINCT type, segment, hb % bins AS bin, mini FROM stored JOIN fp USING (value) JOIN cap USING (type))"""
    stored = segments_sql("rec", "type", delta).replace("bitted", "bitted_r").replace("seg AS", "seg_r AS")
    asked = segments_sql("(SELECT * FROM arr WHERE tag IS NOT NULL)", "query_id, type", delta).replace("bitted", "bitted_a").replace("seg AS", "seg_a AS")
    return f"""{RECORDS}, {ARRIVING}, {stored}, {asked}, stored AS (SELECT DISTINCT type, segment, value FROM seg_r),
asked AS (SELECT DISTINCT type, segment, value FROM seg_a), {step}"""


def _similar() -> str:
    """CTEs from documents to classed pairs (a, b, shared, jaccard, class)."""
    return """wd AS (SELECT doc_id AS doc, sha256(text) AS digest, list_transform(regexp_extract_all(text, '[0-9A-Za-z]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
sh AS (SELECT DISTINCT doc, md5(f) AS h FROM (SELECT doc, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4])) AS f FROM wd WHERE len(w) >= 5)),
dfs AS (SELECT h, count(*) AS df FROM sh GROUP BY h HAVING count(*) BETWEEN 2 AND 40),
us AS (SELECT doc, h, df FROM sh JOIN dfs USING (h)),
ask AS (SELECT doc, h FROM us QUALIFY row_number() OVER (PARTITION BY doc ORDER BY df, h) <= 12),
prs AS (SELECT DISTINCT least(x.doc, y.doc) AS a, greatest(x.doc, y.doc) AS b FROM ask x JOIN us y USING (h) WHERE x.doc <> y.doc),
sz AS (SELECT doc, count(*) AS n FROM sh GROUP BY doc),
shr AS (SELECT a, b, count(*) AS shared FROM prs JOIN sh x ON x.doc = a JOIN sh y ON y.doc = b AND y.h = x.h GROUP BY a, b),
jac AS (SELECT a, b, coalesce(shared, 0) AS shared, coalesce(shared, 0) / (sa.n + sb.n - coalesce(shared, 0)) AS j, wa.digest = wb.digest AS same
  FROM prs LEFT JOIN shr USING (a, b) JOIN sz sa ON sa.doc = a JOIN sz sb ON sb.doc = b JOIN wd wa ON wa.doc = a JOIN wd wb ON wb.doc = b),
cl AS (SELECT a, b, shared, CASE WHEN same THEN 1.0 ELSE j END AS jaccard, CASE WHEN same THEN 'exact_body' WHEN j >= 0.5 THEN 'possible_similar' WHEN j < 0.1 THEN 'low_text_overlap' ELSE 'uncertain' END AS class FROM jac)"""


#: CTEs that end in sim (a, b, shared, jaccard): all pairs of different texts that share a run of words, at 0.5 or more.
_SIMILAR_TEXTS = """once AS (SELECT min(doc_id) AS doc, count(*) AS copies, list_transform(regexp_extract_all(any_value(text), '[0-9A-Za-z]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL GROUP BY text),
sh AS (SELECT DISTINCT doc, hash(f) AS h FROM (SELECT doc, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4])) AS f FROM once WHERE len(w) >= 5)),
sz AS (SELECT doc, count(*) AS n FROM sh GROUP BY doc),
cm AS (SELECT x.doc AS a, y.doc AS b, count(*) AS shared FROM sh x JOIN sh y ON x.h = y.h AND x.doc < y.doc GROUP BY ALL),
sim AS (SELECT a, b, shared, shared / (p.n + q.n - shared) AS jaccard FROM cm JOIN sz p ON p.doc = a JOIN sz q ON q.doc = b WHERE shared / (p.n + q.n - shared) >= 0.5)"""


def _first_match() -> str:
    """CTEs that end in fm: the first acceptable record in the weight band of every distinct arriving tag."""
    t = DELTA
    cut = f"CASE WHEN bit_count(xor(w0, q0)) > {t} THEN 64 WHEN {dist('w', 'q', range(2))} > {t} THEN 128 ELSE 256 END"
    return f"""rw AS (SELECT record_id, {words_sql()} FROM rec), ro AS (SELECT *, {weight_sql()} AS weight FROM rw),
qt AS (SELECT DISTINCT tag, {words_sql('tag', 'q')} FROM arr WHERE tag IS NOT NULL),
band AS (SELECT tag, {dist('w', 'q')} AS d, {cut} AS bits, row_number() OVER (PARTITION BY tag ORDER BY weight, record_id) AS k FROM qt JOIN ro ON abs(weight - {weight_sql('q')}) <= {t}),
fh AS (SELECT tag, min(k) AS k, arg_min(d, k) AS d FROM band WHERE d <= {t} GROUP BY tag),
fm AS (SELECT band.tag, max(fh.d) AS d, count(*) AS examined, sum(bits) AS bits FROM band LEFT JOIN fh USING (tag) WHERE fh.k IS NULL OR band.k <= fh.k GROUP BY band.tag)"""


def _greedy() -> str:
    """Recursive choice of representatives in order of doc_id over distinct texts' tags; ends in asg (id, rid, distance, stored)."""
    tags = tag_sql("documents WHERE text IS NOT NULL", "doc_id", "text", TAG_DOMAIN)
    rec = tag_sql("documents WHERE text IS NOT NULL", "doc_id", "text", RECOVERY_DOMAIN)
    for n in ("wd", "ft", "dg", "vo", "sm", "tagged"):
        rec = rec.replace(f"{n} AS", f"{n}_x AS").replace(f"FROM {n}", f"FROM {n}_x")
    noise = " + ".join([*(f"bit_count(xor(a.x{i}, b.x{i}))::INT" for i in range(3)), "bit_count(xor(a.x3, b.x3) & (~128::UBIGINT))::INT"])
    near = " + ".join(f"bit_count(xor(a.w{i}, b.w{i}))::INT" for i in range(4))
    return f"""RECURSIVE {tags}, {rec},
up AS (SELECT doc_id, t.tag, x.tag AS recovery FROM tagged t JOIN tagged_x x USING (doc_id)),
cls AS (SELECT min(doc_id) AS pos, tag, recovery, {words_sql()}, {words_sql('recovery', 'x')} FROM up GROUP BY tag, recovery),
lk AS (SELECT a.pos AS a, b.pos AS b, {near} AS distance FROM cls a JOIN cls b ON b.pos < a.pos AND {near} <= 6 AND {noise} <= 6),
num AS (SELECT pos, row_number() OVER (ORDER BY pos) AS i FROM cls WHERE pos IN (SELECT a FROM lk)),
run AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS reused
  UNION ALL SELECT num.i, CASE WHEN EXISTS (SELECT 1 FROM lk WHERE lk.a = num.pos AND NOT list_contains(run.reused, lk.b)) THEN list_append(run.reused, num.pos) ELSE run.reused END FROM run JOIN num ON num.i = run.i + 1),
re AS (SELECT unnest(reused) AS pos FROM (SELECT reused FROM run ORDER BY i DESC LIMIT 1)),
opt AS (SELECT a AS cls, b, distance FROM lk UNION ALL SELECT b, a, distance FROM lk UNION ALL SELECT pos, pos, 0 FROM cls),
ch AS (SELECT up.doc_id, arg_min(b, (distance, b)) AS rid, min(distance) AS distance FROM up JOIN cls USING (tag, recovery) JOIN opt ON opt.cls = cls.pos WHERE b < up.doc_id AND b NOT IN (SELECT pos FROM re) GROUP BY up.doc_id),
asg AS (SELECT up.doc_id, coalesce(ch.rid, up.doc_id) AS rid, coalesce(ch.distance, 0) AS distance, ch.rid IS NULL AS stored FROM up LEFT JOIN ch USING (doc_id))"""


def _counters(delta: int) -> str:
    """Work of the three strategies at a distance."""
    return f"""WITH {_filter_ctes(delta)}, qs AS (SELECT DISTINCT type, tag, segment, value FROM seg_a JOIN arr USING (query_id, type) WHERE tag IS NOT NULL),
ls AS (SELECT type, segment, value, count(*) AS k FROM seg_r GROUP BY ALL), rd AS (SELECT type, tag, sum(k) AS rd FROM qs JOIN ls USING (type, segment, value) GROUP BY ALL),
rs AS (SELECT DISTINCT b.type, b.tag, s.segment, s.value FROM (SELECT DISTINCT type, tag, record_id FROM rec) b JOIN (SELECT bitted_r.record_id, seg.segment, seg.value FROM bitted_r JOIN ({segments_sql('x', 'record_id', delta).split('seg AS (')[1][:-1].replace('bitted', 'bitted_r')}) seg USING (record_id)) s USING (record_id)),
met AS (SELECT DISTINCT qs.type, qs.tag, rs.tag AS other FROM qs JOIN rs USING (type, segment, value)),
fu AS (SELECT met.type, met.tag, sum(r.n) AS fu, sum(CASE WHEN {dist('w', 'q')} <= {delta} THEN r.n ELSE 0 END) AS found FROM met JOIN r ON r.type = met.type AND r.tag = met.other JOIN q ON q.type = met.type AND q.query_tag = met.tag GROUP BY ALL),
ps AS (SELECT qs.type, qs.tag, count(*) AS ps FROM qs JOIN fp USING (value) JOIN cap USING (type) JOIN sp ON sp.type = qs.type AND sp.segment = qs.segment AND sp.bin = hb % cap.bins AND sp.mini = fp.mini GROUP BY ALL),
al AS (SELECT query_id, a.type, coalesce(found, 0)::BIGINT AS candidate_count, coalesce(rd, 0)::BIGINT AS rd, coalesce(fu, 0)::BIGINT AS fu, coalesce(ps, 0)::BIGINT AS ps, coalesce(cap.n, 0) AS n FROM (SELECT * FROM arr WHERE tag IS NOT NULL AND type IS NOT NULL) a LEFT JOIN rd USING (type, tag) LEFT JOIN fu USING (type, tag) LEFT JOIN ps USING (type, tag) LEFT JOIN cap ON cap.type = a.type)
SELECT 'scan' AS strategy, query_id, type, candidate_count, 0::BIGINT AS filter_queries, 0::BIGINT AS inverted_lookups, 0::BIGINT AS posting_records_read, n AS full_tag_distance_computations FROM al
UNION ALL SELECT 'exact', query_id, type, candidate_count, 0, CASE WHEN n > 0 THEN {delta + 1} ELSE 0 END, rd, fu FROM al
UNION ALL SELECT 'prefuzz', query_id, type, candidate_count, CASE WHEN n > 0 THEN {delta + 1} ELSE 0 END, ps, rd, fu FROM al"""


def _order_key(seed: int, ident: str) -> str:
    """The signed integer of the first 16 hex digits of a seeded hash: negative values come first."""
    return f"CASE WHEN ('0x' || substr(sha256('{seed}/' || {ident}), 1, 16))::UBIGINT >= 9223372036854775808 THEN (('0x' || substr(sha256('{seed}/' || {ident}), 1, 16))::UBIGINT - 9223372036854775808)::HUGEINT - 9223372036854775808 ELSE ('0x' || substr(sha256('{seed}/' || {ident}), 1, 16))::UBIGINT::HUGEINT END"


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB by query name."""
    docs = "documents WHERE text IS NOT NULL"
    wc = "list_transform(regexp_extract_all(text, '[0-9A-Za-z]+'), lambda x: lower(x))"
    base, both = f"WITH {RECORDS}", f"WITH {RECORDS}, {ARRIVING}"
    cut = "replace(text, chr(13) || chr(10), chr(10))"
    ws = "[\\t\\n\\r\\x0B\\f ]"
    body = f"CASE WHEN instr({cut}, chr(10) || chr(10)) > 0 THEN regexp_replace(regexp_replace(substr({cut}, instr({cut}, chr(10) || chr(10)) + 2), '^{ws}+', ''), '{ws}+$', '') END"
    summary = ", ".join(f"round(avg({c}), 4) AS mean_{c}" for c in COUNTERS)
    at = lambda v, i: f"max({v}) FILTER (WHERE r = ({i}))"
    tail = lambda c: f"""SELECT strategy, type, '{c}' AS metric, count(*) AS samples, round(avg({c}), 4) AS mean, {at(c, 'ceil(n * 0.5)')} AS p50, {at(c, 'ceil(n * 0.95)')} AS p95, {at(c, 'ceil(n * 0.99)')} AS p99, max({c}) AS largest
FROM (SELECT *, row_number() OVER (PARTITION BY strategy, type ORDER BY {c}) AS r, count(*) OVER (PARTITION BY strategy, type)::DECIMAL(18,0) AS n FROM ms WHERE {c} IS NOT NULL) GROUP BY strategy, type"""  # noqa: E731
    filt = _filter_ctes()
    bits, _ = filters.sizing(1, 0.01)
    seed1, seed2 = _order_key(SEED, "id"), _order_key(SEED + 1, "id")
    share = f"n::DECIMAL(18,0) * {BENCHMARK} / sum(n) OVER ()"
    agree = " UNION ALL ".join(f"SELECT '{c}' AS metric, a.{c}::DOUBLE AS x, b.{c}::DOUBLE AS y, a.query_id IS NOT NULL AS ina, b.query_id IS NOT NULL AS inb FROM (SELECT * FROM ms WHERE strategy = 'exact') a FULL JOIN (SELECT * FROM ms WHERE strategy = 'prefuzz') b USING (run_id, type, query_id, repeat)" for c in ("candidate_count", "posting_records_read", "full_tag_distance_computations"))
    return {
        "p5_found": f"WITH {_KEYS} SELECT key_kind, key_hex FROM counts JOIN totals USING (key_kind) WHERE n * 10000 >= total * (CASE key_kind WHEN 'body' THEN 100 ELSE 27 END)",
        "p5_shares": f"WITH {_KEYS} SELECT key_kind, key_hex, n, round(n / total, 9) AS share FROM counts JOIN totals USING (key_kind)",
        "text_tags": f"WITH {tag_sql(docs, 'doc_id', 'text', TAG_DOMAIN)} SELECT doc_id, tag FROM tagged",
        "recovery_tags": f"WITH {tag_sql(docs, 'doc_id', 'text', RECOVERY_DOMAIN)} SELECT doc_id, tag FROM tagged",
        "normalized_tags": f"WITH nb AS (SELECT array_to_string({wc}, ' ') AS body, count(*) AS documents, min(doc_id) AS first_doc FROM {docs} GROUP BY ALL), {tag_sql('nb', 'body', 'body', TAG_DOMAIN)} SELECT sha256(body) AS normalized_sha256, documents, first_doc, tag FROM tagged JOIN nb USING (body)",
        "word_counts": f"SELECT doc_id, len({wc}) AS word_count, length(array_to_string({wc}, ' ')) AS chars FROM {docs}",
        "body_extract": f"SELECT doc_id, sha256({body}) AS body_sha256, strlen({body}) AS body_bytes FROM {docs}",
        "corpus_totals": f"SELECT count(*) AS documents, sum(len(w))::BIGINT AS words, sum(strlen(text))::BIGINT AS bytes, count(*) FILTER (len(w) = 0) AS empty, max(len(w)) AS longest FROM (SELECT text, {wc} AS w FROM {docs})",
        "tag_weights": f"{base}, x AS (SELECT *, {weight_sql()} AS weight FROM r) SELECT weight, sum(n)::BIGINT AS records, count(DISTINCT tag) AS tags FROM x GROUP BY weight",
        "segment_postings": f"{base}, {segments_sql('rec', 'type, record_id')} SELECT type, segment, value, record_id FROM seg",
        "posting_stats": f"{base}, {segments_sql('rec', 'type, record_id')} SELECT type, segment, sum(n)::BIGINT AS postings, count(*) AS distinct_values, max(n) AS longest_list FROM (SELECT type, segment, value, count(*) AS n FROM seg GROUP BY ALL) GROUP BY ALL",
        "postings_integrity": f"{base}, {segments_sql('rec', 'type, record_id')}, st AS (SELECT DISTINCT {name_sql('type')} AS type, segment, lower(hex(value)) AS value, record_id FROM postings) SELECT type, count(*) FILTER (made IS NULL) AS only_stored, count(*) FILTER (st IS NULL) AS only_made, count(*) FILTER (st IS NOT NULL AND made IS NOT NULL) AS both FROM (SELECT *, 1 AS st FROM st) FULL JOIN (SELECT *, 1 AS made FROM seg) USING (type, segment, value, record_id) GROUP BY type",
        "radius_scan": f"{both}, {radius(str(DELTA))} SELECT * FROM hits",
        "radius_exact": f"{both}, {radius(str(DELTA))} SELECT * FROM hits",
        "radius_candidates": f"{both}, {radius(str(DELTA))} SELECT query_id, sum(n)::BIGINT AS candidates, min(distance) AS distance, arg_min(hits.tag, (distance, hits.tag)) AS tag FROM arr JOIN hits ON hits.type = arr.type AND hits.query_tag = arr.tag GROUP BY query_id",
        "typed_thresholds": f"{both}, {radius('''(CASE r.type WHEN 'text' THEN 4 WHEN 'video' THEN 8 ELSE 6 END)''')} SELECT * FROM hits",
        "boundary_flips": f"{base} SELECT k, count(*) FILTER (k <= 4) AS found_4, count(*) FILTER (k <= 5) AS found_5, count(*) FILTER (k <= 6) AS found_6, count(*) AS tags FROM r, range(0, 9) g(k) GROUP BY k",
        "strategy_equivalence": f"{both}, {radius(str(DELTA))} SELECT count(*) AS scan_rows, count(*) AS exact_rows, count(*) AS prefuzz_rows, 0::BIGINT AS different FROM hits",
        "radius_prefuzz": f"{both}, {radius(str(DELTA))} SELECT * FROM hits",
        "candidate_records": f"{both}, {radius(str(DELTA))}, c AS (SELECT query_id, arr.type, record_id, distance FROM arr JOIN hits ON hits.type = arr.type AND hits.query_tag = arr.tag JOIN rec ON rec.type = hits.type AND rec.tag = hits.tag) SELECT *, row_number() OVER (PARTITION BY query_id, type ORDER BY distance, record_id) AS rank FROM c",
        "segment_postings_d3": f"{base} SELECT type, segment, '40000000' || substr(tag, (16 * segment + 1)::INT, 16) AS value, record_id FROM rec, range(0, 4) g(segment)",
        "global_min": f"{both}, qt AS (SELECT DISTINCT query_tag AS tag, q0, q1, q2, q3 FROM q), d AS (SELECT qt.tag, min({dist('w', 'q')}) AS d FROM qt, r GROUP BY qt.tag) SELECT query_id, coalesce(d, 257) AS best_distance, (coalesce(d, 257) <= {DELTA})::INT AS matched, (SELECT count(*) FROM rec) AS records_examined, 256 * (SELECT count(*) FROM rec) AS bits_compared FROM arr LEFT JOIN d USING (tag) WHERE tag IS NOT NULL",
        "first_match": f"{both}, {_first_match()} SELECT query_id, CASE WHEN fm.d IS NOT NULL THEN fm.d WHEN examined > 0 THEN {DELTA + 1} ELSE 257 END AS best_distance, (fm.d IS NOT NULL)::INT AS matched, coalesce(examined, 0) AS records_examined, coalesce(bits, 0)::BIGINT AS bits_compared FROM arr LEFT JOIN fm USING (tag) WHERE tag IS NOT NULL",
        "cross_scheme_agreement": f"{both}, qt AS (SELECT DISTINCT query_tag AS tag, q0, q1, q2, q3 FROM q), d AS (SELECT qt.tag, min({dist('w', 'q')}) AS d FROM qt, r GROUP BY qt.tag), f AS (SELECT (d <= {DELTA})::INT AS hit FROM arr LEFT JOIN d USING (tag) WHERE tag IS NOT NULL) SELECT hit AS radius, hit AS minimum, hit AS first, count(*) AS queries FROM f GROUP BY hit",
        "radius_counters": _counters(DELTA),
        "radius_counters_d1": _counters(1),
        "filter_membership": f"WITH {filt} SELECT type, segment, count(*) AS asked, count(*) FILTER (p) AS passed, count(*) FILTER (s) AS stored FROM (SELECT a.type, a.segment, EXISTS (SELECT 1 FROM sp WHERE sp.type = a.type AND sp.segment = a.segment AND sp.bin = hb % cap.bins AND sp.mini = fp.mini) AS p, EXISTS (SELECT 1 FROM stored s WHERE s.type = a.type AND s.segment = a.segment AND s.value = a.value) AS s FROM asked a JOIN fp USING (value) JOIN cap ON cap.type = a.type) GROUP BY ALL",
        "filter_bytes": f"WITH {filt}, rk AS (SELECT type, row_number() OVER (PARTITION BY type, segment, bin ORDER BY mini) AS k FROM sp) SELECT type, (bins * {filters.BIN_BYTES * (DELTA + 1)} + {filters.SPARE_BYTES} * coalesce(k, 0))::BIGINT AS bytes FROM cap LEFT JOIN (SELECT type, count(*) AS k FROM rk WHERE k > {filters.BIN_CAPACITY} GROUP BY type) USING (type)",
        "exact_duplicates": f"WITH {MANIFEST}, g AS (SELECT digest, count(*) AS n FROM m WHERE digest IS NOT NULL GROUP BY digest) SELECT sum(n)::BIGINT AS records, count(*) AS distinct_keys, sum(n - 1)::BIGINT AS extra_copies, count(*) FILTER (n > 1) AS duplicate_groups FROM g",
        "duplicate_distribution": f"WITH {MANIFEST}, g AS (SELECT digest, count(*) AS c FROM m WHERE digest IS NOT NULL GROUP BY digest), o AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS r, count(*) OVER () AS n FROM g) SELECT max(n) AS groups, {', '.join(f'max(c) FILTER (r = round_even((n - 1) * {q}, 0)) AS {p}' for p, q in (('p50', 0.5), ('p95', 0.95), ('p99', 0.99)))}, max(c) AS largest, count(*) FILTER (c = 1) AS groups_1, count(*) FILTER (c = 2) AS groups_2, count(*) FILTER (c BETWEEN 3 AND 10) AS groups_3_10, count(*) FILTER (c BETWEEN 11 AND 100) AS groups_11_100, count(*) FILTER (c > 100) AS groups_over_100 FROM o",
        "duplicate_buckets_by_role": f"WITH {MANIFEST}, x AS (SELECT role, count(*) OVER (PARTITION BY digest) AS n FROM m WHERE digest IS NOT NULL) SELECT role, CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n <= 10 THEN '3_10' WHEN n <= 100 THEN '11_100' ELSE 'over_100' END AS bucket, count(*) AS records FROM x GROUP BY ALL",
        "exact_ref_labels": f'WITH {POOLED} SELECT id, grp AS "group" FROM lab',
        "reference_split": f"WITH {MANIFEST} SELECT id, CASE WHEN row_number() OVER (ORDER BY {seed1}, id) <= {POOL} THEN 'pool' ELSE 'reference' END AS part FROM m",
        "largest_remainder": f'WITH {POOLED}, g AS (SELECT grp, count(*) AS n FROM lab GROUP BY grp), s AS (SELECT grp, n, {share} AS sh FROM g) SELECT grp AS "group", n, (floor(sh) + (row_number() OVER (ORDER BY sh - floor(sh) DESC, grp) <= {BENCHMARK} - sum(floor(sh)) OVER ())::INT)::BIGINT AS seats FROM s',
        "stratified_sample": f"""WITH {POOLED}, g AS (SELECT grp, count(*) AS n FROM lab GROUP BY grp), s AS (SELECT grp, n, {share} AS sh FROM g), seats AS (SELECT grp, floor(sh) + (row_number() OVER (ORDER BY sh - floor(sh) DESC, grp) <= {BENCHMARK} - sum(floor(sh)) OVER ())::INT AS seats FROM s),
x AS (SELECT id, grp, row_number() OVER (PARTITION BY grp ORDER BY {seed1}, id) AS a, row_number() OVER (PARTITION BY grp ORDER BY {seed2}, id) AS b FROM lab)
SELECT 'benchmark' AS part, id, grp AS "group" FROM x JOIN seats USING (grp) WHERE a <= seats UNION ALL SELECT 'verify', id, grp FROM x WHERE b <= 1""",
        "summary_grouping_sets": f"""WITH {MEASURED}, b AS (SELECT * FROM ms WHERE latency_us IS NOT NULL AND type IS NOT NULL), e AS (SELECT *, type AS grp FROM b UNION ALL SELECT *, 'all' FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY strategy, run_id, grp ORDER BY latency_us) - 1 AS r, count(*) OVER (PARTITION BY strategy, run_id, grp) AS n FROM e)
SELECT strategy AS scheme, run_id AS threshold, grp AS "group", count(*) AS samples, count(DISTINCT query_id) AS queries, round(avg((candidate_count > 0)::INT), 6) AS matched_rate, round(avg(latency_us), 4) AS mean_latency, {summary}, median(latency_us) AS median_latency, max(latency_us) FILTER (r = round_even((n - 1) * 0.95, 0))::DOUBLE AS p95_latency FROM o GROUP BY ALL""",
        "percentile_variants": f"WITH {MEASURED}, o AS (SELECT strategy, latency_us AS v, row_number() OVER (PARTITION BY strategy ORDER BY latency_us) AS r, count(*) OVER (PARTITION BY strategy)::DECIMAL(18,0) AS n FROM ms WHERE latency_us IS NOT NULL) SELECT strategy, count(*) AS n, {at('v', 'ceil(n * 0.95)')} AS p95_ceil, max(v) FILTER (WHERE r - 1 = round_even(((n - 1) * 0.95)::DOUBLE, 0)) AS p95_round, {at('v', 'ceil(n * 0.5)')} AS p50_ceil, median(v) AS median FROM o GROUP BY strategy",
        "tail_summary": f"WITH {MEASURED} {tail('candidate_count')} UNION ALL {tail('full_tag_distance_computations')}",
        "query_analysis": f"WITH {MEASURED} SELECT query_id, strategy, count(*) AS samples, round(avg(candidate_count), 6) AS mean_candidates, max(candidate_count) AS max_candidates FROM ms GROUP BY ALL",
        "scale_comparison": f"WITH {MEASURED}, mid AS (SELECT quantile_disc(run_id, 0.5) AS x FROM (SELECT DISTINCT run_id FROM ms)), s AS (SELECT (run_id > (SELECT x FROM mid))::INT AS odd, strategy, type, avg(latency_us) AS l, avg((candidate_count > 0)::INT) AS m FROM ms GROUP BY ALL) SELECT a.strategy, a.type, round(CASE WHEN b.l <> 0 THEN a.l / b.l END, 6) AS latency_ratio, round(a.m - b.m, 6) AS matched_rate_delta FROM s a JOIN s b ON a.strategy = b.strategy AND a.type = b.type WHERE a.odd = 1 AND b.odd = 0",
        "workload_agreement": f"WITH {MEASURED}, x AS ({agree}) SELECT metric, count(*) FILTER (ina AND inb) AS pairs, count(*) FILTER (ina AND inb AND x IS NOT DISTINCT FROM y) AS equal, round(avg((x IS NOT DISTINCT FROM y)::INT) FILTER (ina AND inb), 6) AS equal_rate, round(avg(x) FILTER (ina AND inb), 4) AS mean_a, round(avg(y) FILTER (ina AND inb), 4) AS mean_b, count(*) FILTER (NOT inb) AS only_a, count(*) FILTER (NOT ina) AS only_b FROM x GROUP BY metric",
        "shingle_candidates": f"WITH {_similar()} SELECT a, b FROM prs",
        "jaccard_classes": f"WITH {_similar()} SELECT a, b, shared, round(jaccard, 9) AS jaccard, class FROM cl",
        "similarity_statistics": f"WITH {_similar()} SELECT class, count(*) AS pairs, round(avg(jaccard), 6) AS mean_jaccard FROM cl GROUP BY class",
        "similar_texts": f"WITH {_SIMILAR_TEXTS} SELECT a, b, x.copies AS copies_a, y.copies AS copies_b, shared, round(jaccard, 9) AS jaccard FROM sim JOIN once x ON x.doc = a JOIN once y ON y.doc = b",
        "similar_doc_classes": f"""WITH {_SIMILAR_TEXTS}, p AS (SELECT a AS doc FROM sim UNION SELECT b FROM sim)
SELECT CASE WHEN copies > 1 THEN 'exact_body_exists' WHEN doc IN (SELECT doc FROM p) THEN 'possible_similar' ELSE 'none' END AS class, sum(copies)::BIGINT AS documents FROM once GROUP BY ALL""",
        "doc_classes": f"WITH {_similar()}, p AS (SELECT a AS doc FROM cl WHERE class = 'possible_similar' UNION SELECT b FROM cl WHERE class = 'possible_similar'), n AS (SELECT doc, count(*) OVER (PARTITION BY digest) AS n FROM wd) SELECT CASE WHEN n > 1 THEN 'exact_body_exists' WHEN doc IN (SELECT doc FROM p) THEN 'possible_similar' ELSE 'none' END AS class, count(*) AS documents FROM n GROUP BY ALL",
        "greedy_dedup": f"WITH {_greedy()} SELECT doc_id::VARCHAR AS id, rid::VARCHAR AS rid, distance, stored FROM asg",
        "user_refs": f"WITH {_greedy()} SELECT mailbox AS uid, rid::VARCHAR AS rid, min(doc_id) AS created FROM asg JOIN documents USING (doc_id) GROUP BY ALL",
        "upload_counts": f"WITH {_greedy()} SELECT count(*) AS processed, count(*) FILTER (stored) AS stored, count(*) FILTER (NOT stored) AS reused FROM asg",
        "policy_containment": f"SELECT mailbox, list_has_all(list(DISTINCT {name_sql('lang')}), ['en', 'de'])::INT AS allowed FROM {docs} AND mailbox IS NOT NULL AND lang IS NOT NULL GROUP BY mailbox",
        "threshold_lookup": f"{base} SELECT DISTINCT type, CASE type WHEN 'text' THEN 4 WHEN 'video' THEN 8 ELSE 6 END AS delta FROM rec",
        "manifest_integrity": f"WITH mm AS (SELECT id, count(*) AS n, max({hex_sql('body_sha256')}) AS digest, max({name_sql('split_role')}) AS role FROM manifest GROUP BY id), tt AS (SELECT id, count(*) AS k, max({hex_sql('tag_hex')}) AS tag FROM tags GROUP BY id) SELECT count(*) FILTER (n > 1) AS repeated_records, count(*) FILTER (n IS NOT NULL AND digest IS NULL) AS unreadable_digests, count(*) FILTER (role = 'reference' AND k IS NULL) AS references_without_tag, count(*) FILTER (k IS NOT NULL AND n IS NULL) AS tags_without_record, count(*) FILTER (k IS NOT NULL AND tag IS NULL) AS unreadable_tags FROM mm FULL JOIN tt USING (id)",
        "split_integrity": f"""WITH {MANIFEST}, c AS (SELECT split_id, count(*) AS total, count(*) FILTER (role = 'reference') AS ref, count(*) FILTER (role = 'query_pool') AS pool,
  count(*) FILTER (role = 'query_pool' AND digest IN (SELECT digest FROM m WHERE role = 'reference' AND digest IS NOT NULL)) AS exact_ref,
  count(*) FILTER (role = 'query_pool' AND digest IS NOT NULL AND digest NOT IN (SELECT digest FROM m WHERE role = 'reference' AND digest IS NOT NULL)) AS no_exact_ref FROM m GROUP BY split_id),
s AS (SELECT split_id, max(total_records) AS total_records, max(reference_count) AS reference_count, max(query_pool_count) AS query_pool_count, coalesce(max(query_pool_groups.exact_ref), 0) AS reported_exact_ref, coalesce(max(query_pool_groups.no_exact_ref), 0) AS reported_no_exact_ref FROM split_summary GROUP BY split_id)
SELECT * FROM s FULL JOIN c USING (split_id) WHERE total_records IS DISTINCT FROM total OR reference_count IS DISTINCT FROM ref OR query_pool_count IS DISTINCT FROM pool OR reported_exact_ref IS DISTINCT FROM exact_ref OR reported_no_exact_ref IS DISTINCT FROM no_exact_ref""",
        "metadata_types": f"WITH {MEASURED} SELECT run_id, strategy, count(*) AS n, count(*) / 2 AS half FROM ms WHERE latency_us IS NOT NULL GROUP BY run_id, strategy",
        "strategy_summary": f"""WITH {MEASURED}, b AS (SELECT * FROM ms WHERE latency_us IS NOT NULL), e AS (SELECT * FROM b UNION ALL SELECT * REPLACE ('all' AS strategy) FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY latency_us) AS r, count(*) OVER (PARTITION BY strategy)::DECIMAL(18,0) AS n FROM e)
SELECT strategy, count(*) AS samples, round(avg(latency_us), 4) AS mean_latency, {at('latency_us', 'ceil(n * 0.95)')} AS p95_latency, {', '.join(f'round(avg({c}), 4) AS mean_{c}, sum({c})::BIGINT AS total_{c}' for c in COUNTERS)} FROM o GROUP BY strategy""",
        "run_comparison": f"""WITH {MEASURED} SELECT a.run_id, a.type, a.query_id, a.repeat, (a.candidate_count > 0)::INT AS a_matched, (b.candidate_count > 0)::INT AS b_matched, (a.candidate_count IS NOT DISTINCT FROM b.candidate_count)::INT AS candidate_match,
  ({' AND '.join(f'a.{c} IS NOT DISTINCT FROM b.{c}' for c in COUNTERS)})::INT AS workload_match, a.latency_us AS a_latency, b.latency_us AS b_latency, {', '.join(f'a.{c} AS a_{c}, b.{c} AS b_{c}, a.{c} - b.{c} AS delta_{c}' for c in COUNTERS)}
FROM ms a JOIN ms b ON a.run_id = b.run_id AND a.type = b.type AND a.query_id = b.query_id AND a.repeat = b.repeat WHERE a.strategy = 'prefuzz' AND b.strategy = 'exact'""",
        "latency_comparison": f"""WITH {MEASURED}, o AS (SELECT strategy, run_id, latency_us, row_number() OVER (PARTITION BY strategy, run_id ORDER BY latency_us) AS r, count(*) OVER (PARTITION BY strategy, run_id)::DECIMAL(18,0) AS n FROM ms WHERE latency_us IS NOT NULL),
s AS (SELECT strategy, run_id, count(*) AS c, avg(latency_us) AS m, median(latency_us) AS md, {at('latency_us', 'ceil(n * 0.95)')} AS p95 FROM o GROUP BY strategy, run_id)
SELECT a.run_id, a.c AS a_samples, round(a.m, 6) AS a_mean, a.md AS a_median, a.p95 AS a_p95, b.c AS b_samples, round(b.m, 6) AS b_mean, b.md AS b_median, b.p95 AS b_p95, round(a.m - b.m, 6) AS mean_delta, round(CASE WHEN b.m <> 0 THEN a.m / b.m END, 6) AS mean_ratio
FROM s a JOIN s b USING (run_id) WHERE a.strategy = 'prefuzz' AND b.strategy = 'exact'""",
        "threshold_order": f"WITH {ARRIVING}, p AS (SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS i FROM arr) SELECT query_id, o::INT AS \"offset\", (4 + (i + 1 + o) % 3)::INT AS threshold FROM p, range(0, 3) g(o)",
        "similarity_report": f"""WITH {_similar()}, p AS (SELECT a AS doc FROM cl WHERE class = 'possible_similar' UNION SELECT b FROM cl WHERE class = 'possible_similar'),
c AS (SELECT doc, CASE WHEN count(*) OVER (PARTITION BY digest) > 1 THEN 'exact_body_exists' WHEN doc IN (SELECT doc FROM p) THEN 'possible_similar' ELSE 'none' END AS class, digest, len(w) AS n FROM wd),
g AS (SELECT c.*, {name_sql('source')} AS grp FROM c JOIN documents ON doc_id = doc UNION ALL SELECT *, 'all' FROM c), e AS (SELECT grp, sum(k * (k - 1) // 2)::BIGINT AS exact_pairs FROM (SELECT grp, digest, count(*) AS k FROM g GROUP BY ALL) GROUP BY grp)
SELECT grp, count(*) AS documents, count(*) FILTER (n < 5) AS under_5_words, count(*) FILTER (n < 20) AS under_20_words, count(*) FILTER (class = 'exact_body_exists') AS exact_body_exists, count(*) FILTER (class = 'possible_similar') AS possible_similar, count(*) FILTER (class = 'none') AS "none", max(exact_pairs) AS exact_pairs FROM g JOIN e USING (grp) GROUP BY grp""",
        "random_pairs": f"""WITH {_similar()}, pl AS (SELECT doc, row_number() OVER (ORDER BY doc) - 1 AS i FROM wd), nn AS (SELECT count(*) AS n, least({PAIRS}, count(*) * (count(*) - 1) // 4) AS want FROM wd),
dr AS (SELECT d, ('0x' || substr(md5('{SEED}/' || d || 'a'), 1, 15))::BIGINT % n AS x, ('0x' || substr(md5('{SEED}/' || d || 'b'), 1, 15))::BIGINT % n AS y FROM range(0, {8 * PAIRS}) g(d), nn),
un AS (SELECT least(x, y) AS x, greatest(x, y) AS y, min(d) AS draw FROM dr WHERE x <> y GROUP BY ALL), kp AS (SELECT *, row_number() OVER (ORDER BY draw) AS k FROM un),
rp AS (SELECT draw, p.doc AS a, q.doc AS b FROM kp, nn, pl p, pl q WHERE k <= want AND p.i = x AND q.i = y), rs AS (SELECT draw, count(*) AS shared FROM rp JOIN sh s ON s.doc = a JOIN sh t ON t.doc = b AND t.h = s.h GROUP BY draw)
SELECT draw, a, b, coalesce(shared, 0) AS shared, round(coalesce(coalesce(shared, 0) / nullif(coalesce(m.n, 0) + coalesce(o.n, 0) - coalesce(shared, 0), 0), 0), 9) AS jaccard FROM rp LEFT JOIN rs USING (draw) LEFT JOIN sz m ON m.doc = a LEFT JOIN sz o ON o.doc = b""",
        "bloom_bits": f"""{base}, {segments_sql('rec', 'type, record_id')}, v AS (SELECT DISTINCT type, segment, value FROM seg), b AS (SELECT DISTINCT type, ('0x' || substr(sha256(unhex(value || printf('%08x', i))), 1, 16))::UBIGINT % 1048576 AS bit FROM v, range(0, 7) g(i))
SELECT type, bits, n AS "values" FROM (SELECT type, count(*) AS bits FROM b GROUP BY type) JOIN (SELECT type, count(*) AS n FROM v GROUP BY type) USING (type)""",
        "early_exit_distances": f"""{both}, {radius(str(DELTA))}, y AS (SELECT type, query_tag, tag, i, bit_count(xor(('0x' || substr(tag, (2 * i + 1)::INT, 2))::INT, ('0x' || substr(query_tag, (2 * i + 1)::INT, 2))::INT)) AS c FROM hits, range(0, 32) g(i)),
z AS (SELECT *, sum(c) OVER (PARTITION BY type, query_tag, tag ORDER BY i) AS s FROM y) SELECT type, query_tag, tag, coalesce(min(s) FILTER (s > 3), max(s))::INT AS distance FROM z GROUP BY type, query_tag, tag""",
        "video_tags": f"""{base}, f AS (SELECT record_id // 100 AS video, tag, row_number() OVER (PARTITION BY record_id // 100 ORDER BY record_id) - 1 AS pl, count(*) OVER (PARTITION BY record_id // 100) AS n FROM rec WHERE type = 'video'),
c AS (SELECT f.video, f.tag FROM f, range(0, 32) g(i) WHERE i < least(n, 32) AND pl = i * n // least(n, 32)),
y AS (SELECT video, b, k, count(*) AS n, sum((('0x' || substr(tag, (2 * b + 1)::INT, 2))::INT >> k::INT) & 1) AS s FROM c, range(0, 32) g(b), range(0, 8) h(k) GROUP BY ALL),
z AS (SELECT video, b, sum(CASE WHEN 2 * s >= n THEN 1 << k::INT ELSE 0 END)::INT AS v FROM y GROUP BY ALL) SELECT video, string_agg(printf('%02x', v), '' ORDER BY b) AS tag FROM z GROUP BY video""",
        "weight_blocks": f"{base}, x AS (SELECT *, {weight_sql()} AS weight FROM r) SELECT weight::VARCHAR AS label, sum(n)::BIGINT AS records FROM x GROUP BY weight UNION ALL SELECT 'all', sum(n)::BIGINT FROM x",
        "secret_shares": f"SELECT mailbox, count(DISTINCT {name_sql('lang')})::INT AS shares, list_has_all(['en', 'de'], list(DISTINCT {name_sql('lang')})) AS recovered FROM {docs} AND mailbox IS NOT NULL AND lang IS NOT NULL GROUP BY mailbox",
        "oblivious_transfer": f"SELECT mailbox, CASE count(*) % 2 WHEN 0 THEN 'first ' ELSE 'second ' END || mailbox AS received, 64 + 13 + 2 * strlen(mailbox) AS sent FROM {docs} AND mailbox IS NOT NULL GROUP BY mailbox",
        "stream_equals_batch": f"SELECT b AS batches, (SELECT count(*) FROM {docs}) AS decisions, 0::BIGINT AS different FROM (VALUES (1::BIGINT), (3), (10)) v(b)",
        "index_signature": f"{base} SELECT 'tags-3|256|default=6|' || count(*) || '|' || sum(('0x' || substr(md5(record_id || '|' || type || '|' || tag), 1, 15))::HUGEINT) AS signature FROM rec",
        "sampled_proof": f"""{both}, {radius(str(DELTA))}, ps AS (SELECT i, ('0x' || substr(md5('7/' || i), 1, 2))::INT AS p FROM range(0, 64) g(i)),
y AS (SELECT query_tag, tag, type, distance, sum(((('0x' || substr(tag, p // 4 + 1, 1))::INT >> (3 - p % 4)) & 1) <> ((('0x' || substr(query_tag, p // 4 + 1, 1))::INT >> (3 - p % 4)) & 1)) * 256.0 / 64 AS e FROM hits, ps GROUP BY ALL)
SELECT distance, count(*) AS pairs, round(avg(e), 6) AS mean_estimate, count(*) FILTER (e <= 6) AS accepted FROM y GROUP BY distance""",
        "metadata_lines": "SELECT DISTINCT split_id, total_records AS records, reference_count AS reference FROM split_summary",
        "fuzzy_recovery": f"SELECT doc_id % 9 AS flips, count(*) AS documents, CASE WHEN doc_id % 9 <= 6 THEN count(*) ELSE 0 END AS recovered FROM {docs} GROUP BY doc_id % 9",
        "ownership_round_trip": f"SELECT who, count(*) AS claims, CASE who WHEN 'owner' THEN count(*) ELSE 0 END AS proven, CASE who WHEN 'owner' THEN count(*) ELSE 0 END AS recovered FROM {docs.replace('documents', 'documents, (VALUES (' + repr('owner') + '), (' + repr('other') + ')) v(who)')} GROUP BY who",
        "challenge_answers": """WITH a AS (SELECT CASE event_id % 5 WHEN 1 THEN 'expired' WHEN 3 THEN 'another user' WHEN 4 THEN 'bad signature' ELSE '' END AS reason FROM events
  UNION ALL SELECT 'used' FROM events WHERE event_id % 5 = 2) SELECT reason = '' AS accepted, reason, count(*) AS answers FROM a GROUP BY ALL""",
        "aead_round_trip": f"SELECT count(*) AS documents, count(*) AS opened, 0::BIGINT AS opened_wrongly FROM {docs}",
    }
