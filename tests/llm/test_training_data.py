import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hamloom.llm import abuse, increments, mixture, neighbours, proportions, quantiles, tag_groups, tokens


def flip(tag, n, rng):
    x = int(tag, 16)
    for b in rng.sample(range(256), n):
        x ^= 1 << b
    return f"{x:064x}"


def dist(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


# 1: percentiles


def nearest(values, q):
    v = sorted(values)
    return v[max(1, math.ceil(round(q * len(v), 9))) - 1]


@pytest.mark.parametrize("bits", [3, 10])
def test_percentiles_are_exact(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.uniform(-5, 5), -0.0, 0.0, 1e300, -1e-300, float("inf"), 7.0])) for _ in range(600)] + [("none", None), ("none", float("nan")), ("one", 3.5)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("n", F.lit("clash")).withColumn("p50", F.lit(0))
    got = {r["g"]: r for r in quantiles.radix_percentiles(df, ["g"], "v", ["0.5", "0.95", "0.999"], bits).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g, r in got.items():
        v = [x for k, x in rows if k == g and x is not None and x == x]
        assert r["n"] == len(v)
        assert (r["p50"], r["p95"], r["p99_9"]) == (nearest(v, 0.5), nearest(v, 0.95), nearest(v, 0.999))


def test_percentiles_of_integers_and_nothing(spark):
    df = spark.createDataFrame([("x", v) for v in (-(2**63), -1, 0, 5, 2**63 - 1)], "g string, v long")
    r = quantiles.radix_percentiles(df, ["g"], "v", ["0.5", "1"]).first()
    assert (r["p50"], r["p100"]) == (0, 2**63 - 1)
    assert quantiles.radix_percentiles(df.limit(0), ["g"], "v", ["0.5"]).count() == 0
    same = spark.createDataFrame([("x", 4)] * 9, "g string, v long")
    assert quantiles.radix_percentiles(same, ["g"], "v", ["0.95"]).first()["p95"] == 4


def test_percentiles_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BROADCAST_TARGETS", 0)
    df = spark.createDataFrame([(i % 7, i * 37 % 1000) for i in range(700)], "g long, v long")
    got = {r["g"]: r["p95"] for r in quantiles.radix_percentiles(df, ["g"], "v", ["0.95"], 4).collect()}
    assert got == {g: nearest([i * 37 % 1000 for i in range(700) if i % 7 == g], 0.95) for g in range(7)}


def test_states_of_days_combine(spark):
    rng = random.Random(1)
    rows = [("g", d, rng.lognormvariate(3, 2)) for d in range(4) for _ in range(200)]
    days = [quantiles.radix_state(spark.createDataFrame([r for r in rows if r[1] == d], "g string, d long, v double"), ["g"], "v", 22) for d in range(4)]
    for r in quantiles.state_percentiles(quantiles.merge_states(*days), ["g"], ["0.5", "0.95"], 22).collect():
        want = nearest([x[2] for x in rows], float(r["q"]))
        assert r["low"] <= want <= r["high"] and r["high"] - r["low"] <= abs(want) * 2.0**-9 and r["n"] == 800


def test_days_that_come_late_count_once(spark):
    rng = random.Random(5)
    reports = [("g", f"m{rng.randrange(60)}", rng.choice([1, 2, 3, None]), rng.choice([None, float("nan"), -1.0, rng.uniform(0, 9)])) for _ in range(400)]
    df = spark.createDataFrame(reports, "g string, id string, day long, v double").withColumn("key", F.lit("clash"))
    changes = quantiles.value_changes(df, ["g"], ["id"], "day", "v")
    states = quantiles.day_states(changes, ["g"], "day", 24)
    days = [None, 1, 2, 3]
    for n in range(1, 5):
        known = {}
        for _, i, d, v in reports:
            if d in days[:n] and v is not None and v == v:
                known[i] = max(v, known.get(i, v))
        part = states.filter(F.col("day").isNull() | F.col("day").isin(days[1:n]) if n > 1 else F.col("day").isNull())
        for r in quantiles.state_percentiles(quantiles.merge_states(part.drop("day")), ["g"], ["0.5", "0.95"], 24).collect():
            assert r["n"] == len(known) and r["low"] <= nearest(known.values(), float(r["q"])) <= r["high"]
    assert changes.filter("last").count() == len(known)
    # a state can stand in for the first pass
    rows = quantiles._salted(changes.filter("last").select("g", F.col("key").alias("_k")))
    got = quantiles.select_ranks(quantiles.materialise(rows), ["g"], ["0.5"], 20, rows.schema["_k"].dataType, quantiles.merge_states(states.drop("day")), 24).first()
    assert got["n"] == len(known)
    assert quantiles.value_changes(df.limit(0), ["g"], ["id"], "day", "v").count() == 0


# 2: neighbours


def near_rows(rng, n=400):
    base = [f"{rng.getrandbits(256):064x}" for _ in range(n)]
    return [("t" if i % 4 else "u", x) for i, x in enumerate(base + [flip(rng.choice(base), rng.choice([1, 5, 20, 40]), rng) for _ in range(n)])]


def truth(rows, k, radius):
    out = set()
    for t in {r[0] for r in rows}:
        tags = sorted({x for y, x in rows if y == t})
        for a in tags:
            for d, b in sorted((dist(a, b), b) for b in tags if b != a)[:k]:
                if d <= radius:
                    out.add((t, a, b, d))
    return out


def test_neighbours(spark):
    rows = near_rows(random.Random(4))
    df = spark.createDataFrame(rows + rows[:50] + [(None, rows[0][1]), ("t", None)], "type string, tag string").withColumn("rank", F.lit(0)).withColumn("far", F.lit(""))
    got = {(r["type"], r["tag"], r["near"], r["distance"]) for r in neighbours.nearest_tags(df, 5, 48).collect()}
    want = truth(rows, 5, 48)
    assert len(got & want) >= 0.97 * len(want) and all(dist(a, b) == d for _, a, b, d in got)
    assert not {x for x in got if x[3] > 48}


def test_neighbours_without_radius_and_of_few(spark):
    rows = near_rows(random.Random(6), 20)
    got = neighbours.nearest_tags(spark.createDataFrame(rows, "type string, tag string"), 3).collect()
    assert {(r["type"], r["tag"], r["near"], r["distance"]) for r in got} == truth(rows, 3, 256)
    assert {r["rank"] for r in got} == {1, 2, 3}
    df = spark.createDataFrame([("t", "0" * 64)], "type string, tag string")
    assert neighbours.nearest_tags(df).count() == 0 and neighbours.nearest_tags(df.limit(0)).count() == 0


def test_crowded_codewords(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "REGION", 16)
    monkeypatch.setattr(neighbours, "PAIRS_PER_TAG", 1)
    rng = random.Random(8)
    rows = [("t", "0" * 32 + f"{rng.getrandbits(128):032x}") for _ in range(120)]
    got = {(r["type"], r["tag"], r["near"], r["distance"]) for r in neighbours.nearest_tags(spark.createDataFrame(rows, "type string, tag string"), 2).collect()}
    assert len(got & truth(rows, 2, 256)) >= 0.9 * len(rows) * 2


def test_far_neighbours_are_found(spark):
    rng = random.Random(12)
    rows = [("t", f"{rng.getrandbits(256):064x}") for _ in range(3000)] + [("u", f"{i:064x}") for i in range(3)]
    got = {(r["type"], r["tag"], r["near"], r["distance"]) for r in neighbours.nearest_tags(spark.createDataFrame(rows, "type string, tag string"), 5).collect()}
    asked = rows[:300:3]
    x = np.array([[int(t[i : i + 16], 16) for i in range(0, 64, 16)] for _, t in rows[:3000]], np.uint64)
    want = set()
    for at in range(0, 300, 3):
        d = np.bitwise_count(x ^ x[at]).sum(1).astype(int)
        near = sorted((d[j], rows[j][1]) for j in range(3000) if j != at)[:5]
        want |= {("t", rows[at][1], t, n) for n, t in near}
    assert len(want) == 5 * len(asked) and len(got & want) >= 0.9 * len(want)
    assert {r for r in got if r[0] == "u"} == truth(rows[3000:], 5, 256)


def test_regions_split_tags_with_equal_ends(monkeypatch):
    rng = np.random.default_rng(1)
    words = np.zeros((4000, 4), np.uint64)
    words[:, 0] = rng.integers(0, 1 << 62, 4000)
    assert np.bincount((neighbours.tag_hash(words) % np.uint64(8)).astype(int), minlength=8).max() < 650
    assert neighbours.region_size(10**4) == neighbours.REGION and neighbours.region_size(10**8) > 3 * 10**5
    assert [neighbours.codewords_for(n) for n in (1, 16, 10**4, 10**8)] == [1, 1, 16, 2048]


def test_codewords_move_to_their_cells():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, (4, 2)).astype(np.uint64)
    which = rng.integers(0, 4, 200)
    sample = base[which] ^ (np.uint64(1) << rng.integers(0, 62, (200, 2)).astype(np.uint64))
    start = sample[[int(np.flatnonzero(which == i)[0]) for i in range(4)]]
    assert (neighbours.refine(start, sample) == base).all()


def test_reach_counts_cells():
    rng = np.random.default_rng(0)
    d1, d2 = rng.integers(30, 90, (50, 8)).astype(np.int16), rng.integers(30, 90, (50, 8)).astype(np.int16)
    for want in (1, 10, 64):
        far = neighbours.reach(d1, d2, want)
        sums = d1[:, :, None] + d2[:, None, :]
        assert ((sums <= far[:, None, None]).sum((1, 2)) >= want).all()
        assert ((sums < far[:, None, None]).sum((1, 2)) < want).all()


# 3: increments


def sequential(known, rows, radius=6):
    digests, tags, out = {d for d, _, _ in known if d}, [(t, x) for _, t, x in known if x and t], {}
    for i, d, t, x in rows:
        hit = (d is not None and d in digests) or (x is not None and t is not None and any(t == t2 and dist(x, y) <= radius for t2, y in tags))
        out[i] = hit
        if not hit:
            if d:
                digests.add(d)
            if x and t:
                tags.append((t, x))
    return out


def arrivals_like(rng, n):
    base = [f"{rng.getrandbits(256):064x}" for _ in range(12)]
    pick = lambda: flip(rng.choice(base), rng.choice([0, 2, 4, 5, 9]), rng)
    return [(f"d{rng.randrange(n)}" if rng.random() < 0.7 else None, rng.choice(["text", "image", None]), pick() if rng.random() < 0.8 else None) for _ in range(n)]


def test_batches_against_history(spark):
    rng = random.Random(3)
    known, new = arrivals_like(rng, 20), [(f"i{k:03}", *r) for k, r in enumerate(arrivals_like(rng, 60))]
    want = sequential(known, new)
    history = increments.History(spark, 4)
    history.append(spark.createDataFrame(known, "digest string, type string, tag string"))
    got = {}
    for part in (new[:25], new[25:40], new[40:]):
        batch = spark.createDataFrame(part, "id string, digest string, type string, tag string").withColumn("n", F.lit(1))
        old = history.known(batch)
        got |= {r["id"]: True for r in old.collect()}
        rest = increments.with_positions(batch.join(old, "id", "left_anti"), ["id"])
        verdict = increments.first_of_each(rest)
        fresh = verdict.filter("not repeat").select("id").collect()
        got |= {r["id"]: r["repeat"] for r in verdict.collect()}
        history.append(batch.join(spark.createDataFrame([tuple(r) for r in fresh], "id string"), "id", "left_semi"))
    plan = spark.table(history.whole).join(batch.select("digest").distinct(), "digest", "left_semi")._jdf.queryExecution().toString()
    assert plan.count("Exchange hashpartitioning(digest") <= 2 and "SelectedBucketsCount" in plan
    history.close()
    assert got == want


def test_history_is_opened_again(spark, tmp_path):
    rng = random.Random(9)
    known, new = arrivals_like(rng, 20), [(f"i{k:03}", k, *r) for k, r in enumerate(arrivals_like(rng, 60))]
    want = sequential(known, [(i, d, t, x) for i, _, d, t, x in new])
    schema = "id string, pos long, digest string, type string, tag string"
    first = increments.History(spark, 4, path=str(tmp_path / "history"))
    first.append(spark.createDataFrame(known, "digest string, type string, tag string"))
    got = {r["id"]: r["repeat"] for r in first.add(spark.createDataFrame(new[:30], schema)).collect()}
    first.close()
    # another session: its catalogue knows nothing of the tables
    other = spark.newSession()
    again = increments.History(other, 99, radius=1, path=str(tmp_path / "history"))
    assert (again.buckets, again.radius) == (4, 6)
    got |= {r["id"]: r["repeat"] for r in again.add(other.createDataFrame(new[30:], schema)).collect()}
    assert again.add(other.createDataFrame([], schema)).count() == 0
    again.append(spark.createDataFrame(known, "digest string, type string, tag string"))
    assert {r["repeat"] for r in again.add(other.createDataFrame([r for r in new if r[2] or (r[3] and r[4])], schema)).collect()} == {True}
    again.close()
    assert got == want


def test_chain_of_arrivals(spark):
    tag, rows = 0, []
    for k in range(12):  # each within 6 of the one before, 12 of the one before that
        rows.append((f"i{k:02}", k, None, "t", f"{tag:064x}"))
        for b in range(6 * k, 6 * k + 6):
            tag ^= 1 << b
    df = spark.createDataFrame(rows, "id string, pos long, digest string, type string, tag string")
    assert {r["id"]: r["repeat"] for r in increments.first_of_each(df).collect()} == {f"i{k:02}": k % 2 == 1 for k in range(12)}
    assert increments.first_of_each(df.limit(0)).count() == 0
    bare = spark.createDataFrame([("x", 0, None, None, None), ("y", 1, None, None, None)], df.schema)
    assert {r["repeat"] for r in increments.first_of_each(bare).collect()} == {False}


# 4: proportions


def test_seats_follow_priorities():
    rng = random.Random(0)
    for _ in range(200):
        k = rng.randrange(1, 5)
        a, t, f = [rng.randrange(0, 40) for _ in range(k)], [rng.choice([0, rng.randrange(1, 30)]) for _ in range(k)], [rng.randrange(0, 6) for _ in range(k)]
        total = rng.randrange(0, 60)
        got = proportions.seats(a, [float(x) for x in t], f, total)
        low = [min(x, y) for x, y in zip(a, f, strict=True)]
        queue = sorted(((r - 0.5) / t[i], i, r) for i in range(k) if t[i] for r in range(low[i] + 1, a[i] + 1))
        want = list(low)
        for _, i, _ in queue[: max(0, total - sum(low))]:
            want[i] += 1
        assert got == want


def test_sample_and_report(spark):
    recs = spark.createDataFrame([(1, "a", f"r{i}") for i in range(50)] + [(1, "b", f"s{i}") for i in range(3)] + [(1, None, "x"), (9, "a", "y"), (1, "a", "r0")], "grp long, category string, id string").withColumn("rank", F.lit(5)).withColumn("target", F.lit(5))
    targets = spark.createDataFrame([(1, "a", 10, 1), (1, "b", 10, None), (2, "a", None, 2), (1, "a", 10, 1)], "grp long, category string, target long, floor long")
    sample, report = proportions.proportional_sample(recs, targets)
    got = {(r["grp"], r["category"]): (r["available"], r["drawn"], r["short"]) for r in report.collect()}
    assert got == {(1, "a"): (51, 17, False), (1, "b"): (3, 3, True), (2, "a"): (0, 0, True)}
    assert {(r["category"], r["count"]) for r in sample.groupBy("category").count().collect()} == {("a", 17), ("b", 3)}
    sample, report = proportions.proportional_sample(recs.limit(0), targets.limit(0))
    assert sample.count() == 0 and report.count() == 0


# 6: groups


@pytest.mark.parametrize("limit", [1000, 3])
def test_links_are_complete(spark, limit):
    rng = random.Random(7)
    base = [f"{rng.getrandbits(256):064x}" for _ in range(30)] + ["0" * 40 + f"{rng.getrandbits(96):024x}" for _ in range(20)]
    tags = sorted({*base, *(flip(rng.choice(base), rng.randrange(1, 9), rng) for _ in range(120))})
    rows = [(i, "t" if i % 5 else "u", x) for i, x in enumerate(tags)]
    df = spark.createDataFrame(rows, "id long, type string, tag string").withColumn("key", F.lit("x"))
    got = [tuple(r) for r in tag_groups.near_links(df, 6, list_limit=limit).collect()]
    want = {(i, j) for i, t, x in rows for j, u, y in rows if i < j and t == u and dist(x, y) <= 6}
    assert set(got) == want and len(got) == len(want)


def test_groups(spark):
    a = "0" * 64
    rows = [(5, "t", a), (2, "t", "3f" + a[2:]), (9, "t", "3f3f" + a[4:]), (1, "u", a), (7, "t", "f" * 64)]
    df = spark.createDataFrame(rows, "id long, type string, tag string")
    assert {(r["id"], r["group_id"]) for r in tag_groups.tag_groups(df).collect()} == {(5, 2), (2, 2), (9, 2)}
    assert tag_groups.tag_groups(df.limit(0)).count() == 0


# 7: tokens


def test_token_ids(spark):
    rng = random.Random(0)
    texts = [None, "", " ", "Hello  world's\n\n text\t!", "é" * 50, "日本語 text 🙂", "A" * 5000, "<|endoftext|>", "a\x1cb !\x1f c", "x" * 30000 + " \n " + "word  two " * 5000, " ".join(rng.choice(["ab", "c,d", "  ", "\n", "123", " ", " z"]) for _ in range(20000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("ids0", F.lit(1))
    enc = tokens.encoder(tokens.read_ranks(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"))
    rows = {r["doc_id"]: r for r in tokens.count_tokens(tokens.decode(tokens.encode(df))).collect()}
    for i, t in enumerate(texts):
        want = enc.encode_ordinary(t) if t else []
        assert rows[i]["ids"] == want and rows[i]["tokens"] == len(want)
        assert bytes(rows[i]["bytes"]).decode() == (t or "")
    assert tokens.encode(df.limit(0)).count() == 0
    long = texts[-1]
    assert "".join(tokens.safe_pieces(long, 50)) == long and [x for p in tokens.safe_pieces(long, 50) for x in enc.encode_ordinary(p)] == enc.encode_ordinary(long)


def test_ids_equal_the_other_library():
    tk = pytest.importorskip("tokenizers")
    t = tk.Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    enc = tokens.encoder(tokens.read_ranks(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"))
    for s in ("Hello world", "l’été à la\r\n mer 12,5 %", "  two  blanks", "<|endoftext|>"):
        assert t.encode(s, add_special_tokens=False).ids == tokens.encode_text(enc, s)


# 8: mixtures


def test_mixture(spark):
    sizes = spark.createDataFrame([(i, "big" if i < 40 else "small" if i < 44 else None, 100) for i in range(46)] + [(99, "big", 0)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([(1, "BIG ", 0.5, 2, 1.0), (1, "small", 0.5, 3, 1.0), (2, "none", 0.1, 5, 1.0), (2, "big", 0.9, 1, 0.5), (2, "zero", 0.0, 1, 0.5), (3, "big", None, None, None)], "mix_id long, source string, target_weight double, max_repeats long, budget_ratio double")
    slots, report = mixture.mix(sizes, targets, 64)
    got = {(r["mix_id"], r["source"]): r for r in report.collect()}
    assert {k for k, r in got.items() if r["failed"]} == {(1, "small"), (2, "none")}
    assert got[1, "small"]["tokens"] == 3 * 400 and got[1, "small"]["repeats"] == 3
    assert abs(got[1, "big"]["tokens"] - 2300) <= 128 and got[3, "big"]["tokens"] == 0
    assert got[2, "big"]["size"] == 4000 and got[2, "none"]["tokens"] == 0
    for r in slots.groupBy("mix_id", "source", "block", "repeat").count().collect():
        assert r["count"] == 1
    assert slots.groupBy("mix_id", "slot").count().filter("count > 1").count() == 0
    parts = mixture.blocks(sizes, 64).collect()
    assert sum(r["tokens"] for r in parts) == 4600 and max(r["tokens"] for r in parts) <= 64
    full = {}
    for r in parts:
        full.setdefault((r["source"], r["block"]), []).append(r["tokens"])
    assert sorted(sum(v) for k, v in full.items() if k[0] == "small") == [16, 64, 64, 64, 64, 64, 64]
    slots, report = mixture.mix(sizes.limit(0), targets, 64)
    assert slots.count() == 0 and report.count() == 6
    assert mixture.mix(sizes, targets.limit(0), 64)[1].count() == 0


def test_slots_name_their_documents(spark):
    rows = [(i, "big" if i < 40 else "small" if i < 44 else None, 50 + i) for i in range(46)] + [(99, "big", 0)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([(1, "big", 0.5, 2, 1.0), (1, "small", 0.5, 3, 1.0), (2, None, 1.0, 4, 0.1)], "mix_id long, source string, target_weight double, max_repeats long, budget_ratio double")
    slots = mixture.mix(sizes, targets, 64)[0]
    pieces = mixture.reading_order(slots, mixture.blocks(sizes, 64)).collect()
    read, used = {}, {}
    for r in pieces:
        read[r["mix_id"], r["slot"]] = read.get((r["mix_id"], r["slot"]), 0) + r["tokens"]
        used.setdefault((r["mix_id"], r["source"], r["repeat"], r["doc_id"]), []).extend(range(r["first"], r["first"] + r["tokens"]))
    assert read == {(r["mix_id"], r["slot"]): r["tokens"] for r in slots.collect()}
    length = {i: n for i, _, n in rows}
    for (_, _, _, doc), at in used.items():
        assert len(at) == len(set(at)) and min(at) >= 0 and max(at) < length[doc]
    for doc in (40, 41, 42, 43):
        assert sorted(used[1, "small", 0, doc]) == list(range(length[doc]))
    assert {m for m, s, _, _ in used if s is None} == {2}


def test_points_of_far_slots(spark):
    slots = [0, 1, 2**31 - 1, 2**31, 2**33 + 5, 7 * 10**9, 2**61 + 12345]
    df = spark.createDataFrame([(s,) for s in slots], "slot long").select(mixture.slot_point(F.col("slot")).alias("p"))
    assert [r["p"] for r in df.collect()] == [s * mixture.GOLDEN_62 % 2**62 for s in slots]


def test_failures_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("abcd"), rng.randrange(0, 300)) for i in range(300)]
    total = sum(r[2] for r in rows)
    size = {s: sum(n for _, x, n in rows if x == s) for s in "abcde"}
    targets = []
    for mix in range(12):
        w = [rng.random() for _ in "abcde"]
        for s, x in zip("abcde", w, strict=True):
            targets.append((mix, s, round(x / sum(w), 3), rng.randrange(0, 4), rng.choice([0.1, 0.5, 1.0, 2.0])))
    # exactly enough, and one token short
    targets += [(20, "a", 1.0, 1, size["a"] / total), (21, "a", 1.0, 1, (size["a"] + 1) / total)]
    report = mixture.mix(spark.createDataFrame(rows, "doc_id long, source string, tokens long"), spark.createDataFrame(targets, "mix_id long, source string, target_weight double, max_repeats long, budget_ratio double"), 64)[1]
    got = {(r["mix_id"], r["source"]) for r in report.filter("failed").collect()}
    assert got == {(m, s) for m, s, w, r, b in targets if r * size[s] < w * b * total}


def test_schedule_keeps_shares_everywhere(spark):
    plan = spark.createDataFrame([(1, "a", 0.7, 20000.0), (1, "b", 0.3, 20000.0)], "mix_id long, source string, target_weight double, budget double")
    rows = sorted((r["slot"], r["source"], r["turn"]) for r in mixture.schedule(plan, 1).collect())
    assert [r[0] for r in rows] == list(range(20000))
    for s in ("a", "b"):
        assert [r[2] for r in rows if r[1] == s] == list(range(sum(r[1] == s for r in rows)))
    for lo in range(0, 20000, 500):
        assert abs(sum(r[1] == "a" for r in rows[lo : lo + 500]) - 350) <= 4


# 9: content


def test_canonical_spelling():
    assert abuse.canonical("V e r m i n e!!!") == abuse.canonical("vermine!")
    assert "maggot" in abuse.canonical("MАGGОT") and "slow" in abuse.canonical("sl​ow")
    assert "nackt" in abuse.canonical("N4ckt") and abuse.canonical("mx-55610") == "mx-0"
    assert abuse.windows(None) == [] and abuse.windows("") == [] and abuse.windows(" \n ") == []
    assert abuse.windows("kys") == ["kys"]
    for text in ("Die. Slut! OK.", "Re: Idiot!", "a. b. c.", "A long enough sentence here. No.", "Hm. A long enough sentence here."):
        assert set(re.findall(r"[a-z]+", text.lower())) == set(re.findall(r"[a-z]+", " ".join(abuse.windows(text))))
    long = "ab cd " * 2000
    assert max(map(len, abuse.windows(long))) <= abuse.WINDOW
    assert any("tail of it" in w for w in abuse.windows("x " * 5000 + "tail of it"))


def test_scores(spark):
    rng = random.Random(1)
    plain = ["the {} desk reviewed the {} file", "please send the {} report before {}", "we counted {} pallets and {} reels", "the {} team disputes the {} memo"]
    bad = ["you are a worthless {} and everybody hates you", "i will break your {} you filthy pig"]
    noun = ["harbour", "tax", "metering", "storage", "audit", "night", "pilot", "ferry"]
    say = lambda p: rng.choice(p).format(rng.choice(noun), rng.choice(noun))
    rows = [(i, ". ".join([say(plain) for _ in range(6)] + ([say(bad)] if i % 4 == 0 else [])) + ".", "S%d " % (i % 3)) for i in range(400)] + [(1000, None, "s0"), (1001, "", None), (1002, "  ", "s1"), (1003, "plain " * 20000 + ". You are a worthless pilot and everybody hates you.", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("score", F.lit("clash")).withColumn("y", F.lit(1))
    labels = spark.createDataFrame([(i, "Abusive " if i % 4 == 0 else "clean") for i in range(300)] + [(i, "clean") for i in (0, 4)] + [(5, None), (6, "unsure")], "doc_id long, verdict string")
    model = abuse.fit(abuse.labelled(docs, labels))
    got = {r["doc_id"]: r for r in abuse.score_documents(docs, model).collect()}
    held = range(300, 400)
    assert sum(got[i]["abusive"] == (i % 4 == 0) for i in held) >= 97
    assert not any(got[i]["abusive"] for i in (1000, 1001, 1002)) and got[1000]["score"] == -1 and got[1003]["abusive"]
    assert got[0]["source"] == "s0" and got[1001]["source"] is None
    nothing = abuse.fit(abuse.labelled(docs, labels.limit(0)))
    assert not any(r["abusive"] for r in abuse.score_documents(docs.limit(5), nothing).collect())
    assert abuse.score_documents(docs.limit(0), model).count() == 0


# queries against SQL


@pytest.mark.parametrize("name", ["p1_found", "p1_percentiles", "p1_days", "p2_recall", "p3_verdicts", "p4_found", "p4_report", "p4_sample", "p6_found", "p6_groups"])
def test_query_gives_what_sql_gives(spark, sf, name):
    from tests.test_queries import same_as_sql

    same_as_sql(spark, sf, name)
