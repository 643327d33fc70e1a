import json
import random

import pytest
from pyspark.sql import functions as F

from hamloom.plans import registry
from hamloom.functions import media
from hamloom.operators import greedy, protocol, search, similarity, stats
from hamloom.operators.index import TagIndex, WeightBlocks
from hamloom.operators.media import video_tags
from hamloom.plans import runs
from hamloom.sources import datasets, manifests
from tests.test_operators import tags  # noqa: F401


def test_copies_reuse_what_was_stored_before_them(spark):
    a, far = "0" * 64, "f" * 64
    near = lambda n: f"{(1 << n) - 1:064x}"
    # u1 can only reuse u0; u2 is too far from u0, but nearer to a copy of u1 that comes later
    ups = [("u0", 0, "text", a, a), ("u1", 1, "text", near(5), a), ("u2", 2, "text", near(8), a), ("u3", 3, "text", near(5), a), ("u4", 4, "text", far, far), ("u5", 5, None, a, a)]
    want = {"u0": ("u0", 0, True), "u1": ("u0", 5, False), "u2": ("u2", 0, True), "u3": ("u2", 3, False), "u4": ("u4", 0, True)}
    rows = spark.createDataFrame(ups, "id string, pos long, type string, tag string, recovery string")
    assert {r["id"]: (r["rid"], r["distance"], r["stored"]) for r in greedy.assign(rows).collect()} == want
    for cut in (1, 3):
        first = greedy.assign(rows.filter(F.col("pos") < cut))
        kept = rows.join(first.filter("stored").select("id"), "id", "left_semi").select(*rows.columns)
        got = first.unionByName(greedy.assign(rows.filter(F.col("pos") >= cut), stored=kept))
        assert {r["id"]: (r["rid"], r["distance"], r["stored"]) for r in got.collect()} == want


def test_small_parts(spark):
    t = spark.createDataFrame([("0" * 64, "0" * 64), ("0" * 64, "f" * 64)], "stored string, claim string")
    assert [r["accepted"] for r in protocol.sampled_proof(t, 64, 1, 6).collect()] == [True, False]
    s = spark.createDataFrame([(["a", "b", "a"], ["b", "a"], 77), (["a", "c"], ["a"], 5), ([], [], 3)], "p array<string>, u array<string>, x long")
    made = s.select("x", "u", protocol.share_secret(F.col("x"), F.col("p"), "s").alias("s"))
    assert [tuple(r) for r in made.select(F.size("s"), protocol.join_shares(F.col("s"), F.col("u"))).collect()] == [(2, 77), (2, None), (0, 0)]
    o = spark.createDataFrame([(str(i), bytearray(b"left"), bytearray(b"right!"), i % 2) for i in range(4)], "ident string, first binary, second binary, choice int")
    assert [(bytes(r["received"]), r["sent"]) for r in protocol.transfer(o, "s").orderBy("ident").collect()] == [(b"left", 74), (b"right!", 74)] * 2


def test_claims_must_fit_the_stored_tag(spark):
    docs = spark.createDataFrame([("r1", "text", bytearray(b"alpha beta gamma delta epsilon"))], "rid string, type string, content binary")
    claims = protocol.first_upload(docs, "s").join(docs.select("rid", "content"), "rid").selectExpr("*", "'u' AS uid", "unhex('00') AS token")
    proven = protocol.prove(claims)
    assert protocol.recover(proven).first()["file"] is not None
    assert protocol.recover(proven.withColumn("tag", F.unhex(F.lit("0" * 64)))).first()["file"] is None


def test_video_tags(spark):
    rng = random.Random(3)
    frames = [("v", i, f"{rng.getrandbits(256):064x}") for i in range(70)] + [("w", 5, "f" * 64), ("w", 2, "0" * 64), ("x", 1, None), (None, 1, "0" * 64)]
    got = {r["video"]: r["tag"] for r in video_tags(spark.createDataFrame(frames, "video string, frame long, tag string").withColumn("place", F.lit("clash"))).collect()}
    assert got == {v: media.video_tag([bytes.fromhex(t) for _, _, t in sorted(f for f in frames if f[0] == v)]).hex() for v in ("v", "w")}
    assert video_tags(spark.createDataFrame([], "video string, frame long, tag string")).count() == 0


def test_weight_blocks(spark, tmp_path):
    rows = spark.createDataFrame([(i, "f" * i + "0" * (64 - i)) for i in range(8)] + [(9, None)], "record_id long, tag string")
    blocks = WeightBlocks(spark, str(tmp_path / "w")).build(rows)
    assert blocks.all().count() == 8 and {r["record_id"] for r in blocks.band(4, 12).collect()} == {1, 2, 3}
    assert {r["label"]: r["records"] for r in blocks.blocks().collect()} == {"all": 8, **{str(4 * i): 1 for i in range(8)}}
    assert "PartitionFilters: [isnotnull(weight" in blocks.band(1, 2)._jdf.queryExecution().toString()


def test_random_pairs(spark):
    ids = spark.createDataFrame([(i,) for i in range(12)], "doc long")
    got = similarity.random_pairs(ids, "doc", 10, 3).collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got}) == 10 and all(r["a"] < r["b"] for r in got)
    assert similarity.random_pairs(ids, "doc", 1000, 3).count() == 33 and similarity.random_pairs(ids.limit(0), "doc", 5, 3).count() == 0


def test_candidates_and_lookups(tags, spark, tmp_path):  # noqa: F811
    _, _, r, q = tags
    hits = {(x["type"], x["query_tag"], x["tag"]): x["distance"] for x in search.radius_exact(r, q).collect()}
    assert hits == {(x["type"], x["query_tag"], x["tag"]): x["distance"] for x in search.radius_prefuzz(r, q).collect()}
    rows = search.candidates(r, q).collect()
    recs, asked = r.collect(), q.filter("tag is not null").collect()
    want = {(a["query_id"], a["type"], x["record_id"], hits[x["type"], a["tag"], x["tag"]]) for a in asked for x in recs if x["type"] == a["type"] and (x["type"], a["tag"], x["tag"]) in hits}
    assert {(x["query_id"], x["type"], x["record_id"], x["distance"]) for x in rows} == want
    for query in {x["query_id"] for x in rows}:
        mine = sorted((x["rank"], x["distance"], x["record_id"]) for x in rows if x["query_id"] == query)
        assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)
    index = TagIndex(spark, str(tmp_path / "i")).open(r)
    one = index.postings().first()
    assert one["record_id"] in {x["record_id"] for x in index.lookup(one["type"], one["segment"], bytes(one["value"])).collect()}
    assert index.record(one["record_id"]).count() == 1


def test_first_match_of_any_threshold(tags, spark):  # noqa: F811
    recs, _, r, q = tags
    rows = [(rid, int(t, 16)) for rid, _, t in recs]
    for limit in (0, 70, 130):
        got = {x["query_id"]: tuple(x)[1:] for x in search.first_match(r, q, limit).collect()}
        for x in q.filter("tag is not null").collect():
            tag = int(x["tag"], 16)
            band = sorted((t.bit_count(), rid, t) for rid, t in rows if abs(t.bit_count() - tag.bit_count()) <= limit)
            seen, cost, best = 0, 0, None
            for _, _, t in band:
                d = [((tag ^ t) >> (192 - 64 * i) & (2**64 - 1)).bit_count() for i in range(4)]
                seen, cost = seen + 1, cost + (64 if d[0] > limit else 128 if d[0] + d[1] > limit else 256)
                if sum(d) <= limit:
                    best = sum(d)
                    break
            assert got[x["query_id"]] == (best if best is not None else limit + 1 if band else 257, int(best is not None), seen, cost)


def test_run_comparisons(spark):
    schema = "k long, q string, latency long, found long, read long"
    a = spark.createDataFrame([(1, "x", 10, 1, 5), (1, "y", 30, 0, 2), (2, "x", 4, 1, 1)], schema)
    b = spark.createDataFrame([(1, "x", 5, 1, 5), (1, "y", 5, 0, 3), (3, "x", 4, 1, 1)], schema)
    got = {(r["k"], r["q"]): (r["candidate_match"], r["workload_match"], r["delta_read"], r["a_matched"]) for r in stats.run_comparison(a, b, ["k", "q"], "latency", ["found", "read"]).collect()}
    assert got == {(1, "x"): (1, 1, 0, 1), (1, "y"): (1, 0, -1, 0)}
    r = stats.latency_comparison(a, b, ["k"], "latency").collect()
    assert len(r) == 1 and (r[0]["a_mean"], r[0]["a_median"], r[0]["a_p95"], r[0]["mean_delta"], r[0]["mean_ratio"]) == (20.0, 20.0, 30, 15.0, 4.0)
    s = {x["strategy"]: (x["samples"], x["mean_latency"], x["total_read"], x["p95_latency"]) for x in stats.strategy_summary(a, "q", "latency", ["read"]).collect()}
    assert s == {"x": (2, 7.0, 6, 10), "y": (1, 30.0, 2, 30), "all": (3, 14.6667, 8, 30)}


def test_similarity_report(spark):
    docs = spark.createDataFrame([(0, "a b", "s"), (1, "a b", "s"), (2, "a b", "t"), (3, "one two three four five six", None)], "doc_id long, text string, source string")
    classes = spark.createDataFrame([(0, "exact_body_exists"), (1, "exact_body_exists"), (2, "exact_body_exists"), (3, "none")], "doc long, class string")
    got = {r["grp"]: (r["documents"], r["under_5_words"], r["under_20_words"], r["exact_pairs"], r["none"]) for r in similarity.similarity_report(docs, "doc_id", "text", "source", classes).collect()}
    assert got == {"s": (2, 2, 2, 1, 0), "t": (1, 1, 1, 0, 0), "all": (4, 3, 4, 3, 1)}


def test_lines_keep_their_order(spark, tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    for name, n in (("a.csv", 3), ("b.csv", 400), ("c.csv", 20)):
        (folder / name).write_text("".join(f"{name}{i},t,{i:04x}\n" for i in range(n)))
    rows = manifests.read_tag_manifest(spark, str(folder), 16).orderBy("record_id").collect()
    assert [r["id"] for r in rows] == [f"{f}{i}" for f, n in (("a.csv", 3), ("b.csv", 400), ("c.csv", 20)) for i in range(n)]
    assert [r["record_id"] for r in rows] == list(range(423))
    (tmp_path / "p.csv").write_text(f"id,type,tag_hex\nx,t,{'A' * 64}\nx,u,{'0' * 64}\n")
    assert [tuple(r) for r in manifests.read_plain_tags(spark, str(tmp_path / "p.csv")).orderBy("record_id").collect()] == [("x", "a" * 64, 0), ("x", "0" * 64, 1)]


def mail_folder(root, n=60):
    rng = random.Random(1)
    words = "harbour light quay storm rope anchor tide boat net sail crew deck".split()
    for i in range(n):
        body = " ".join(rng.choice(words) for _ in range(30)) if i % 3 else "the same body in every third mail of this folder"
        at = root / f"box{i % 4}" / f"{i}."
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(f"Subject: {i}\r\n\r\n{body}\r\n".encode())
    return str(root)


def test_dataset_experiment_and_comparison(spark, tmp_path):
    root, data = mail_folder(tmp_path / "mail"), str(tmp_path / "data")
    got = datasets.prepare(spark, root, data, expected=60)
    assert (got["records"], got["distinct_bodies"], got["without_words"]) == (60, 41, 0)
    with pytest.raises(FileExistsError):
        datasets.prepare(spark, root, data)
    assert datasets.edge_case_faults(spark, f"{data}/edge_cases.csv", datasets.TAG_DOMAIN).count() == 0
    assert datasets.verify(spark, data, root, str(tmp_path / "ok.json")) == {"checked": 60, "faults": {}, "samples": [], "ok": True}
    (tmp_path / "mail/box1/1.").write_bytes(b"Subject: x\n\nanother body altogether now")
    (tmp_path / "mail/box2/2.").unlink()
    bad = datasets.verify(spark, data, root, str(tmp_path / "bad.json"))
    assert bad["faults"] == {"another body": 1, "no mail": 1} and json.loads((tmp_path / "bad.json").read_text())["ok"] is False
    for name in ("one", "two"):
        assert runs.run(spark, data, str(tmp_path / name), benchmark=8, pool=20, thresholds="4,6") == {"queries": 8, "reference": 40, "thresholds": [4, 6]}
    out = spark.read.csv(str(tmp_path / "one/comparative.csv"), header=True)
    assert out.columns == runs.COMPARATIVE and out.count() == 2 * 2 * 8
    assert runs.check(spark, str(tmp_path / "one")).count() == 0
    assert runs.analyse(spark, str(tmp_path / "one"), str(tmp_path / "two"), str(tmp_path / "cmp")) == {"rows": 3 * 2 * 8, "disagreements": 0}
    part = next((tmp_path / "two/index.csv").glob("part-*"))
    part.write_text(part.read_text() + "\n")
    next((tmp_path / "two/index.csv").glob(".part-*.crc")).unlink()
    with pytest.raises(ValueError, match="changed"):
        runs.analyse(spark, str(tmp_path / "one"), str(tmp_path / "two"), str(tmp_path / "cmp2"))
    assert {r["part"] for r in datasets.sizes(spark, str(tmp_path / "one")).collect()} >= {"index.csv", "labels.csv"}
    assert datasets.environment(spark)["spark"] == spark.version


def test_disagreements_are_named(spark):
    a = spark.createDataFrame([("q1", 4, 1), ("q2", 4, 0)], "query_id string, threshold int, matched int")
    assert [tuple(r) for r in runs.disagreements(a, a.withColumn("matched", F.lit(1))).collect()] == [("q2", 4)]


def test_self_test_and_benchmark(spark):
    assert all(runs.self_test(spark).values())
    assert set(runs.benchmark(1)) == {"tag", "extract", "recover", "sign", "verify", "convergent", "transfer"}


def test_ownership_round_trip_shuffles_no_text_and_repeats_count_once_each(spark, tmp_path):
    """Documents and ciphers stay in their tasks; a doc_id of two rows gives two claims of either kind, as in SQL."""
    docs = [(1, "alpha beta gamma delta epsilon"), (2, "one two three"), (2, "four five six seven"), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = registry.ownership_round_trip(spark, str(tmp_path))
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, made.collect())) == [("other", 3, 0, 0), ("owner", 3, 3, 3)]
