import re

from hamloom.operators import search


def test_global_min_makes_no_row_per_pair(spark):
    tags = ["0" * 64, "f" * 64, "0f" * 32, "00ff" * 16]
    r = spark.createDataFrame([(i, "text", t) for i, t in enumerate(tags[:1])], "record_id long, type string, tag string")
    q = spark.createDataFrame([(str(i), "text", t) for i, t in enumerate(tags)], "query_id string, type string, tag string")
    made = search.global_min(r, q)
    assert not {"CartesianProduct", "BroadcastNestedLoopJoin"} & set(re.findall(r"[A-Z]\w+", made._jdf.queryExecution().executedPlan().toString()))
    assert {x["query_id"]: x["best_distance"] for x in made.collect()} == {"0": 0, "1": 256, "2": 128, "3": 128}


def test_candidates_are_ranked_once_by_tag_and_not_shuffled(spark):
    """Records of hot tags, of several tags at one distance, for queries of one tag in one and in several blocks."""
    tags = ["0" * 64, "0" * 63 + "1", "0" * 63 + "2", "0" * 62 + "33"]
    r = spark.createDataFrame([((7 * i) % 100, "text", tags[i % 4]) for i in range(100)], "record_id long, type string, tag string")
    q = spark.createDataFrame([(f"q{i}", "text", tags[i % 3 if i < 9 else 0]) for i in range(40)] + [("z", "text", "f" * 64)], "query_id string, type string, tag string")
    made = search.candidates(r, q)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    bits = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    records, want = r.collect(), []
    for a in q.collect():
        near = sorted((bits(a["tag"], x["tag"]), x["record_id"]) for x in records if bits(a["tag"], x["tag"]) <= 6)
        want += [(a["query_id"], "text", x, d, k) for k, (d, x) in enumerate(near, 1)]
    assert sorted(map(tuple, made.collect())) == sorted(want) == sorted(map(tuple, search.candidates(r, q, block=7).collect()))
    assert search.candidates(r, q.filter("query_id = 'z'")).count() == 0


def test_radius_exact_shuffles_words_and_no_spelled_tags(spark):
    """Tags with leading zeros and set first bits in their words come out as they went in."""
    tags = ["0" * 64, "0" * 16 + "f" * 16 + "8" + "0" * 31, "f" * 48 + "0" * 15 + "1"]
    r = spark.createDataFrame([("text", t) for t in tags], "type string, tag string")
    made = search.radius_exact(r, r)
    joined = made._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1]
    below = [x for x in joined.splitlines() if "Project [" in x]
    assert below and "tag#" not in below[0]
    assert sorted((x["query_tag"], x["tag"], x["distance"]) for x in made.collect()) == sorted((t, t, 0) for t in tags)
