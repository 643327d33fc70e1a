import random

import pytest
from pyspark.sql import functions as F

from hamloom.operators import experiment, greedy, protocol, search, similarity, stats
from hamloom.operators.components import connected_components
from hamloom.operators.heavy_keys import key_shares, once_per
from hamloom.operators.index import TagIndex
from hamloom.operators.skew import lookup_unique, ranked, spread


def flip(tag, n, rng):
    x = int(tag, 16)
    for b in rng.sample(range(256), n):
        x ^= 1 << b
    return f"{x:064x}"


@pytest.fixture(scope="module")
def tags(spark):
    rng = random.Random(5)
    base = [f"{rng.getrandbits(256):064x}" for _ in range(30)]
    recs = [(i, rng.choice(["text", "image"]), t) for i, t in enumerate(base + [base[0]] * 40 + [flip(t, 3, rng) for t in base])]
    qs = [(f"q{i}", rng.choice(["text", "image", "none"]), flip(rng.choice(base), i % 9, rng)) for i in range(60)] + [("q_null", "text", None)]
    return recs, qs, spark.createDataFrame(recs, "record_id long, type string, tag string"), spark.createDataFrame(qs, "query_id string, type string, tag string")


def dist(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def test_strategies_find_the_same(tags):
    recs, qs, r, q = tags
    want = {(t, x, y, dist(x, y), sum(1 for _, k, z in recs if (k, z) == (t, y))) for _, t, x in qs if x for _, t2, y in recs if t == t2 and dist(x, y) <= 6}
    assert {tuple(x) for x in search.radius_exact(r, q).collect()} == want
    assert {tuple(x) for x in search.radius_scan(r, q).collect()} == want
    assert {tuple(x) for x in search.radius_scan(r, q, block=7).collect()} == want


def test_typed_thresholds(tags):
    _, _, r, q = tags
    got = search.radius_exact(r, q, "default=2,text=5").collect()
    assert {x["type"] for x in got} == {"text", "image"}
    assert all(x["distance"] <= (5 if x["type"] == "text" else 2) for x in got)
    assert got and search.differences(search.radius_exact(r, q, "default=2,text=5"), search.radius_scan(r, q, "default=2,text=5")).count() == 0


def test_global_min_and_first_match(tags, spark):
    recs, qs, r, q = tags
    got = {x["query_id"]: x for x in search.global_min(r, q).collect()}
    assert set(got) == {i for i, _, t in qs if t}
    for i, _, t in qs:
        if t:
            assert got[i]["best_distance"] == min(dist(t, y) for _, _, y in recs)
            assert got[i]["records_examined"] == len(recs)
    first = {x["query_id"]: x for x in search.first_match(r, q).collect()}
    weight = lambda t: int(t, 16).bit_count()
    for i, _, t in qs:
        if not t:
            continue
        band = sorted((weight(y), rid, y) for rid, _, y in recs if abs(weight(y) - weight(t)) <= 6)
        seen = bits = 0
        best = 257 if not band else 7
        for _, _, y in band:
            seen += 1
            d0, d1 = dist(t[:16], y[:16]), dist(t[:32], y[:32])
            bits += 64 if d0 > 6 else 128 if d1 > 6 else 256
            if dist(t, y) <= 6:
                best = dist(t, y)
                break
        assert (first[i]["best_distance"], first[i]["records_examined"], first[i]["bits_compared"]) == (best, seen, bits)
    empty = r.limit(0)
    assert {x["best_distance"] for x in search.global_min(empty, q).collect()} == {257}
    assert {x["best_distance"] for x in search.first_match(empty, q).collect()} == {257}


def test_counters(tags):
    recs, qs, r, q = tags
    got = {(x["strategy"], x["query_id"]): x for x in search.radius_counters(r, q).collect()}
    bounds = [(256 * j // 7, 256 * (j + 1) // 7) for j in range(7)]
    part = lambda t, b: bin(int(t, 16))[2:].zfill(256)[b[0] : b[1]]
    for i, t, x in qs:
        if not x:
            continue
        same = [y for _, k, y in recs if k == t]
        met = [(rid, b) for b in bounds for rid, k, y in recs if k == t and part(x, b) == part(y, b)]
        ids = {m[0] for m in met}
        n = sum(dist(x, y) <= 6 for y in same)
        scan, exact, pre = (got[s, i] for s in ("scan", "exact", "prefuzz"))
        assert scan["full_tag_distance_computations"] == len(same) and scan["candidate_count"] == n
        assert (exact["posting_records_read"], exact["full_tag_distance_computations"], exact["candidate_count"]) == (len(met), len(ids), n)
        assert exact["inverted_lookups"] == (7 if same else 0) and pre["filter_queries"] == (7 if same else 0)
        assert pre["posting_records_read"] == len(met) and pre["inverted_lookups"] >= len({m[1] for m in met})


def test_index_is_reused(tags, spark, tmp_path):
    _, _, r, _ = tags
    a = TagIndex(spark, str(tmp_path / "i")).open(r)
    assert not a.reused and a.postings().count() == 7 * r.count()
    assert TagIndex(spark, str(tmp_path / "i")).open(r).reused
    assert not TagIndex(spark, str(tmp_path / "i")).open(r.filter("record_id > 3")).reused


def test_ranks_and_running_sums(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("h"), "id").withColumn("g", F.when(F.col("g") < 2, F.col("g")))
    rows = ranked(df, ["g"], ["h", "id"]).collect()
    for g in (0, 1, None):
        mine = sorted((r["h"], r["rank"]) for r in rows if r["g"] == g)
        assert [m[1] for m in mine] == list(range(1, len(mine) + 1))
        assert {r["n_rank"] for r in rows if r["g"] == g} == {len(mine)}
    sums = sorted((r["h"], r["s"], r["id"]) for r in spread(df, ["g"], ["h"], 16, F.col("id"), "s").filter("g = 0").collect())
    total = 0
    for _, s, i in sums:
        assert s == total
        total += i


def test_lookup_of_hot_keys(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(999, None)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, v int")
    counts = left.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    got = {r["i"]: r["v"] for r in lookup_unique(left, right, ["k"], counts).collect()}
    assert len(got) == 301 and got[1] == 1 and got[3] == 2 and got[6] is None and got[999] is None
    assert lookup_unique(left, right, ["k"], counts, "inner").count() == 201


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 101), (300, 200), (200, 300)] + [(rng.randrange(500, 520), rng.randrange(500, 520)) for _ in range(40)]
    df = spark.createDataFrame([*links, (None, 3), (4, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(df.limit(0)).count() == 0


def test_key_shares(spark):
    df = spark.createDataFrame([("a",)] * 7 + [("b",)] * 2 + [("c",), (None,)], "k string")
    rows = {r["k"]: (r["n"], r["total"], r["share"]) for r in key_shares(df, "k").collect()}
    assert rows == {"a": (7, 10, 0.7), "b": (2, 10, 0.2), "c": (1, 10, 0.1)}
    assert {r["k"] for r in key_shares(df, "k", 0.2).collect()} == {"a", "b"}
    assert key_shares(df.limit(0), "k").count() == 0
    assert key_shares(df.withColumn("n", F.lit(1)).withColumn("total", F.lit(2)), "k").count() == 3
    twice = spark.createDataFrame([(1, "x"), (1, None), (2, None)], "i int, v string")
    assert sorted(map(tuple, once_per(twice, ["i"], "v").collect())) == [(1, "x"), (2, None)]


def test_rare_keys_have_a_share(spark):
    df = spark.range(2_000_000).selectExpr("CASE WHEN id < 3 THEN id ELSE 9 END AS k")
    assert {r["k"] for r in key_shares(df, "k", 1.2e-6).collect()} == {9}
    assert {r["k"] for r in key_shares(df, "k", 4e-7).collect()} == {0, 1, 2, 9}


def test_percentile_definitions(spark):
    df = spark.createDataFrame([("g", v) for v in (100, 1, 50, 95, 99)], "g string, v long")
    r = stats.tail_summary(df, ["g"], "v").first()
    assert (r["p50"], r["p95"], r["p99"], r["largest"]) == (95, 100, 100, 100)
    df = spark.createDataFrame([("g", v) for v in range(1, 101)], "g string, v long")
    r = stats.tail_summary(df, ["g"], "v").first()
    assert (r["mean"], r["p50"], r["p95"], r["p99"]) == (50.5, 50, 95, 99)


def test_buckets_and_distribution(spark):
    df = spark.createDataFrame([(k,) for k, n in (("a", 1), ("b", 2), ("c", 10), ("d", 11), ("e", 101)) for _ in range(n)] + [(None,)], "k string")
    r = stats.duplicate_distribution(df, "k").first()
    assert (r["groups"], r["largest"], r["p50"], r["groups_1"], r["groups_2"], r["groups_3_10"], r["groups_11_100"], r["groups_over_100"]) == (5, 101, 10, 1, 1, 1, 1, 1)
    assert tuple(stats.duplicate_counts(df, "k").first()) == (125, 5, 120, 4)


def test_scale_and_agreement(spark):
    new = spark.createDataFrame([("s", 10.0, 0.2), ("t", 1.0, 0.0)], "scheme string, mean_latency double, matched_rate double")
    old = spark.createDataFrame([("s", 5.0, 0.1), ("t", 0.0, 0.0), ("u", 1.0, 1.0)], "scheme string, mean_latency double, matched_rate double")
    assert sorted(map(tuple, stats.scale_comparison(new, old, ["scheme"]).collect())) == [("s", 2.0, 0.1), ("t", None, 0.0)]
    a = spark.createDataFrame([("q1", 1), ("q2", 2)], "query_id string, m int")
    b = spark.createDataFrame([("q1", 1), ("q2", 3), ("q3", 3)], "query_id string, m int")
    r = stats.agreement(a, b, ["query_id"], ["m"]).first()
    assert (r["pairs"], r["equal"], r["only_a"], r["only_b"]) == (2, 1, 0, 1)


def test_allocation_and_sample(spark):
    counts = spark.createDataFrame([("a", 65), ("b", 35)], "group string, n long")
    assert {r["group"]: r["seats"] for r in experiment.largest_remainder(counts, 10).collect()} == {"a": 7, "b": 3}
    pool = spark.createDataFrame([(f"r{i}", "exact_ref" if i < 4 else "no_exact_ref") for i in range(10)], "id string, group string")
    bench, check = experiment.stratified(pool, "id", 5, 1)
    assert {r["group"]: r["count"] for r in bench.groupBy("group").count().collect()} == {"exact_ref": 2, "no_exact_ref": 3}
    assert check.count() == 2
    a, b = experiment.split(pool, "id", 3, 9)
    assert a.count() == 3 and b.count() == 7 and a.join(b, "id").count() == 0
    assert experiment.exact_sample(["b", "a", "c"], 2, 1) == experiment.exact_sample(["c", "a", "b"], 2, 1)


def test_similarity(spark):
    long = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, long), (2, long + " eleven"), (3, long), (4, "short text"), (5, None), (6, "")], "doc_id long, text string")
    rows = similarity.shingle_rows(docs, "doc_id", "text")
    pairs = similarity.candidate_pairs(rows)
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (1, 3), (2, 3)]
    digests = docs.filter("text is not null").select(F.col("doc_id").alias("doc"), F.sha2("text", 256).alias("digest"))
    got = {(r["a"], r["b"]): (r["class"], round(r["jaccard"], 4)) for r in similarity.classify(similarity.jaccard(pairs, rows), digests).collect()}
    assert got == {(1, 2): ("possible_similar", 0.8571), (1, 3): ("exact_body", 1.0), (2, 3): ("possible_similar", 0.8571)}
    kinds = {r["doc"]: r["class"] for r in similarity.document_classes(similarity.classify(similarity.jaccard(pairs, rows), digests), digests).collect()}
    assert kinds == {1: "exact_body_exists", 2: "possible_similar", 3: "exact_body_exists", 4: "none", 6: "none"}


def test_similar_pairs_of_large_families(spark):
    rng = random.Random(3)
    body = [f"w{i}" for i in range(60)]
    texts = [" ".join(body[:k] + [f"x{i}"] + body[k + 1 :]) for i, k in enumerate(rng.choices(range(60), k=50))]
    texts += [" ".join(rng.choices(body, k=rng.choice([5, 8, 40]))) for _ in range(20)] + [" ".join(body[:40] + [f"y{j}" for j in range(n)]) for n in (5, 15, 36, 37, 60)] + ["a b", ""]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string")
    once, digests = similarity.distinct_texts(docs, "doc_id", "text")
    assert digests.count() == len(texts) + 1 and {r["doc"]: r["copies"] for r in once.collect()}[0] == 2
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(texts)) for b in range(a + 1, len(texts)) if sets[a] and sets[b]}
    rows = similarity.shingle_rows(once, "doc", "text")
    got = {(r["a"], r["b"]): r["jaccard"] for r in similarity.similar_pairs(rows).collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.5}) and len(got) >= 50 * 49 // 2
    found = {tuple(r) for r in similarity.candidate_pairs(rows).collect()}
    assert not {(a, b) for a in range(50) for b in range(a + 1, 50)} <= found


def test_greedy_reuse(spark):
    rng = random.Random(11)
    tags = [f"{rng.getrandbits(256):064x}" for _ in range(4)]
    ups = []
    for i in range(60):
        t = rng.choice(tags)
        ups.append((f"u{i}", i, "text", flip(t, rng.choice([0, 0, 2, 3, 4]), rng), flip(t, rng.choice([0, 1, 3]), rng)))
    got = {r["id"]: (r["rid"], r["distance"], r["stored"]) for r in greedy.assign(spark.createDataFrame(ups, "id string, pos long, type string, tag string, recovery string")).collect()}
    kept = []
    top = ~(1 << 7)
    for i, _, _, t, x in ups:
        can = [(dist(t, t2), p, j) for p, (j, t2, x2) in enumerate(kept) if dist(t, t2) <= 6 and ((int(x, 16) ^ int(x2, 16)) & top).bit_count() <= 6]
        if can:
            assert got[i] == (min(can)[2], min(can)[0], False)
        else:
            assert got[i] == (i, 0, True)
            kept.append((i, t, x))
    assert greedy.assign(spark.createDataFrame(ups, "id string, pos long, type string, tag string, recovery string").limit(0)).count() == 0


def test_ownership(spark):
    docs = spark.createDataFrame([("r1", "text", b"alpha beta gamma delta epsilon"), ("r2", "text", b"")], "rid string, type string, content binary")
    stored = protocol.first_upload(docs, "s")
    claims = stored.withColumn("uid", F.lit("u")).withColumn("content", F.when(F.col("rid") == "r1", F.lit(b"Alpha, beta gamma delta epsilon!")).otherwise(F.lit(b"something else here"))).withColumn("token", F.lit(b"t" * 32))
    got = {r["rid"]: r for r in protocol.recover(protocol.prove(claims)).collect()}
    assert got["r1"]["proven"] and bytes(got["r1"]["file"]) == b"alpha beta gamma delta epsilon"
    assert not got["r2"]["proven"] and got["r2"]["file"] is None
    broken = protocol.recover(protocol.prove(claims).withColumn("aad", F.lit(b"x")))
    assert broken.filter("file is not null").count() == 0
    with pytest.raises(Exception, match="no adapter"):
        protocol.first_upload(docs.withColumn("type", F.lit("image")), "s").collect()


def test_small_protocol_parts(spark):
    df = spark.createDataFrame([(["a"], ["a", "b"]), (["c"], ["a"]), ([], [])], "p array<string>, u array<string>")
    assert [r[0] for r in df.select(protocol.contains_all(F.col("p"), F.col("u"))).collect()] == [True, False, True]
    refs = spark.createDataFrame([("u", "r", 2), ("u", "r", 1)], "uid string, rid string, created long")
    assert list(map(tuple, protocol.references(refs).collect())) == [("u", "r", 1)]
    t = spark.createDataFrame([("0" * 64, "0" * 64), ("0" * 64, "f" * 64)], "a string, b string")
    assert [r[0] for r in t.select(protocol.sampled_distance(F.col("a"), F.col("b"), 64, 1)).collect()] == [0.0, 256.0]
