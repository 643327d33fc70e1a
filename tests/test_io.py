import pytest
from pyspark.sql import functions as F

from hamloom.sources import manifests, sinks
from hamloom.streaming.uploads import UploadStore, answer_challenges, challenges


def write(path, text):
    path.write_text(text)
    return str(path)


def test_tag_manifest(spark, tmp_path):
    good = write(tmp_path / "a.csv", "id,type,tag_hex\n# note\n\n r1 , image,00FF\nid,type,tag_hex\nr2,text,0001\n")
    rows = manifests.read_tag_manifest(spark, good, 16).orderBy("record_id").collect()
    assert [tuple(r) for r in rows] == [("r1", "image", "00ff", 0), ("r2", "text", "0001", 1)]
    for bad in ("r1,text\n", "r1,text,0001,x\n", "r1,text,00zz\n", "r1,text,001\n", "r1,,0001\n", "r1,t,0001\nr1,t,0002\n", "id,type,tag_hex\n"):
        with pytest.raises(Exception):
            manifests.read_tag_manifest(spark, write(tmp_path / "b.csv", bad), 16).collect()


def test_labels_and_uploads(spark, tmp_path):
    p = write(tmp_path / "l.csv", 'query_id,group,body_sha256,source_id\nq1,exact_ref,aa,"s,1"\nq1,no_exact_ref,bb,s2\n')
    rows = manifests.read_labels(spark, p).collect()
    assert [tuple(r) for r in rows] == [("q1", "exact_ref", "aa", "s,1")]
    q = spark.createDataFrame([("q1",), ("q2",)], "query_id string")
    assert manifests.with_labels(q.limit(1), manifests.read_labels(spark, p)).first()["group"] == "exact_ref"
    with pytest.raises(Exception, match="no label"):
        manifests.with_labels(q, manifests.read_labels(spark, p)).collect()
    u = manifests.read_uploads(spark, write(tmp_path / "u.csv", "uid,type,path\nu1, text ,a.txt\nu2,text,b.txt\n")).orderBy("position").collect()
    assert [tuple(r) for r in u] == [("u1", "text", "a.txt", 0), ("u2", "text", "b.txt", 1)]
    with pytest.raises(Exception):
        manifests.read_csv(spark, p, "wrong string, group string, body_sha256 string, source_id string").collect()


def test_maildir(spark, tmp_path):
    root = tmp_path / "mail"
    for name, text in (("x/2.", "A: b\r\n\r\n one \r\n"), ("x/1.", "A: b\n\ntwo"), ("y/s/3.", "H: v\n\nthree\n")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text.encode())
    rows = manifests.read_maildir(spark, str(root), 3).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("mail_000001", "x", "x/1.", "two"), ("mail_000002", "x", "x/2.", "one"), ("mail_000003", "y", "y/s/3.", "three")]
    with pytest.raises(ValueError):
        manifests.read_maildir(spark, str(root), 4)
    (root / "flat").write_text("A: b\n\nx")
    with pytest.raises(ValueError):
        manifests.read_maildir(spark, str(root))


def test_metadata(spark, tmp_path):
    p = write(tmp_path / "m.txt", "records=4, bytes=10\n")
    row = manifests.read_metadata(spark, p, ("records",)).first()
    assert row["meta"]["bytes"] == "10" and row["typed"]["records"]["whole"] == 4
    mixed = write(tmp_path / "n.txt", "records=4, rate=0.5, name=x\n")
    assert manifests.read_metadata(spark, mixed, numbers=("records",)).first()["meta"] == {"records": "4"}
    with pytest.raises(Exception, match="whole number"):
        manifests.read_metadata(spark, mixed, numbers=("rate",)).collect()
    with pytest.raises(Exception):
        manifests.read_metadata(spark, p, ("other",)).collect()
    with pytest.raises(ValueError):
        manifests.read_object(write(tmp_path / "x.json", "[1]"))
    a, b = spark.range(1), spark.range(2)
    assert {tuple(r) for r in manifests.with_threshold({4: a, 5: b}).collect()} == {(0, 4), (0, 5), (1, 5)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b', 3)], "x int, y string, z int")
    sinks.write_csv(df, str(tmp_path / "c"), ["y", "x"])
    assert manifests.read_csv(spark, str(tmp_path / "c"), "y string, x int").first()["y"] == 'a"b'
    with pytest.raises(Exception):
        sinks.write_csv(df, str(tmp_path / "c"), ["y"])
    sinks.publish(spark, str(tmp_path / "p"), lambda s: df.write.parquet(s))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    with pytest.raises(FileExistsError):
        sinks.publish(spark, str(tmp_path / "p"), lambda s: None)

    def fail(_):
        raise ValueError("bad")

    with pytest.raises(ValueError):
        sinks.publish(spark, str(tmp_path / "q"), lambda s: df.write.parquet(s), fail)
    assert not (tmp_path / "q").exists()
    inv = sinks.inventory(spark, str(tmp_path / "c")).filter("path like '%.csv'")
    assert sinks.changed(inv, inv).count() == 0
    assert {r["problem"] for r in sinks.changed(inv, inv.withColumn("length", F.lit(0))).collect()} == {"changed"}
    sinks.write_json({"b": 1, "a": "ü"}, str(tmp_path / "j.json"))
    assert (tmp_path / "j.json").read_text("utf-8") == '{\n  "a": "ü",\n  "b": 1\n}\n'
    assert sinks.markdown(df) == '| x | y | z |\n| --- | --- | --- |\n| 1 | a"b | 3 |\n'


def test_upload_stream(spark, tmp_path):
    texts = ["alpha beta gamma delta", "Alpha beta, gamma delta!", "wholly different words in here", "alpha beta gamma delta", "wholly different words in here"]
    schema = "id string, pos long, type string, content string"
    store = UploadStore(spark, str(tmp_path / "store"))
    src = tmp_path / "in"
    for k, part in enumerate((texts[:3], texts[3:])):
        rows = [(f"u{3 * k + i}", 3 * k + i, "text", t) for i, t in enumerate(part)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = store.start(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
    got = {r["id"]: (r["rid"], r["stored"]) for r in store.decisions().collect()}
    assert got == {"u0": ("u0", True), "u1": ("u0", False), "u2": ("u2", True), "u3": ("u0", False), "u4": ("u2", False)}
    assert store.stored().count() == 2


def test_nearer_upload_of_the_same_batch_wins(spark, tmp_path):
    def word(n):
        return " ".join(f"w{i}" for i in range(n))

    rows = [("a", 0, "u", "text", word(400)), ("b", 1, "u", "text", word(399)), ("c", 2, "v", "text", word(398)), ("d", 3, "v", "text", None), ("e", 4, "v", None, "x")]
    df = spark.createDataFrame(rows, "id string, pos long, uid string, type string, content string")
    found = []
    for cut in (0, 1, 2):
        store = UploadStore(spark, str(tmp_path / f"s{cut}"), "default=40")
        for number, part in enumerate((df.filter(F.col("pos") < cut), df.filter(F.col("pos") >= cut))):
            store.add(part, number)
        found.append(sorted(map(tuple, store.decisions().drop("batch").collect())))
        assert sorted((r["uid"], r["rid"]) for r in store.refs().collect()) == sorted({(r[1], r[3]) for r in found[-1]})
    assert found[0] == found[1] == found[2] and len(found[0]) == 3
    assert store.next() == (2, 3)
    # a batch that runs again replaces its own output
    store.add(df.filter(F.col("pos") >= 2), 1)
    assert sorted(map(tuple, store.decisions().drop("batch").collect())) == found[2]


def test_store_settings(spark, tmp_path):
    store = UploadStore(spark, str(tmp_path / "s"), capacity=2)
    store.setup("default=5", 1, 0.01)
    texts = ["one two three four", "five six seven eight", "nine ten eleven twelve"]
    store.add(spark.createDataFrame([(str(i), i, "text", t) for i, t in enumerate(texts)], "id string, pos long, type string, content string"), 0)
    again = UploadStore(spark, str(tmp_path / "s"))
    assert again.spec == "default=5" and again.config["capacities"] == {"text": 4} and again.record("1").count() == 1
    assert again.filter_entries().count() == 3 * 6
    for spec, capacity in (("default=6", 100), ("default=5", 2)):
        with pytest.raises(ValueError):
            again.setup(spec, capacity, 0.01)
    with pytest.raises(ValueError):
        UploadStore(spark, str(tmp_path / "s"), "default=4")
    again.config["capacities"] = {"text": 2}
    with pytest.raises(ValueError, match="capacity"):
        again.filter_entries()
    assert UploadStore(spark, str(tmp_path / "s")).setup("default=5", 50, 0.1) is None


EVENTS = [("t1", "issue", "u", 0, True), ("t1", "answer", "u", 120, True), ("t1", "answer", "u", 121, True), ("t2", "issue", "u", 0, True), ("t2", "answer", "u", 121, True), ("t3", "answer", "u", 1, True), ("t4", "issue", "u", 0, True), ("t4", "answer", "v", 1, True), ("t4", "answer", "u", 2, True), ("t5", "issue", "u", 0, True), ("t5", "answer", "u", 1, False)]
WANT = sorted([("t1", ""), ("t1", "used"), ("t2", "expired"), ("t3", "unknown"), ("t4", "another user"), ("t4", "used"), ("t5", "bad signature")])


def test_challenges(spark, tmp_path):
    schema = "token string, kind string, uid string, at long, valid boolean"
    df = spark.createDataFrame(EVENTS, schema)
    assert sorted((r["token"], r["reason"]) for r in answer_challenges(df).collect()) == WANT
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    q = challenges(spark.readStream.schema(schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("answers").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    # with a timeout in use, batches without data follow for ever, so it is waited for a time at most
    for _ in range(60):
        if q.awaitTermination(0.5) or spark.table("answers").count() >= len(WANT):
            break
    q.stop()
    assert sorted((r["token"], r["reason"]) for r in spark.table("answers").collect()) == WANT


def test_command_line(spark, tmp_path):
    from hamloom.__main__ import main

    r = write(tmp_path / "r.csv", f"id,type,tag_hex\nr1,text,{'0' * 64}\nr2,text,{'0' * 63}f\nr3,image,{'f' * 64}\n")
    q = write(tmp_path / "q.csv", f"id,type,tag_hex\nq1,text,{'0' * 63}1\nq2,video,{'0' * 64}\n")
    assert main(["lookup", "--records", r, "--queries", q, "--out", str(tmp_path / "o"), "--verify"]) == 0
    got = {(x["strategy"], x["query_id"]): int(x["candidate_count"]) for x in spark.read.csv(str(tmp_path / "o"), header=True).collect()}
    assert got == {(s, i): n for s in ("scan", "exact", "prefuzz") for i, n in (("q1", 2), ("q2", 0))}
    assert main(["compare", "--records", r, "--queries", q, "--out", str(tmp_path / "c"), "--thresholds", "1,6"]) == 0
    rows = {(x["scheme"], x["threshold"], x["query_id"]): (x["matched"], x["best_distance"]) for x in spark.read.csv(str(tmp_path / "c"), header=True).collect()}
    assert rows["global_min", "1", "q1"] == ("1", "1") and rows["first_match", "6", "q2"] == ("1", "0") and len(rows) == 8
    labels = write(tmp_path / "l.csv", "query_id,group,body_sha256,source_id\nq1,exact_ref,aa,s\nq2,no_exact_ref,bb,s\n")
    assert main(["compare", "--records", r, "--queries", q, "--labels", labels, "--out", str(tmp_path / "d"), "--repeat", "1"]) == 0
    assert {x["group"] for x in spark.read.csv(str(tmp_path / "d"), header=True).collect()} == {"exact_ref", "no_exact_ref"}
    assert main(["lookup", "--records", r, "--queries", q, "--out", str(tmp_path / "x"), "--strategies", "none"]) == 1
    for i, t in enumerate(("one two three four", "One, two three four!", "something else in here")):
        (tmp_path / f"{i}.txt").write_text(t)
    u = write(tmp_path / "u.csv", "uid,type,path\n" + "".join(f"u,text,{tmp_path}/{i}.txt\n" for i in range(3)))
    from hamloom.__main__ import bulk_upload

    assert bulk_upload(spark, u, str(tmp_path / "s")) == {"processed": 3, "stored": 2, "reused": 1}
    assert bulk_upload(spark, u, str(tmp_path / "s"))["stored"] == 0
    store = UploadStore(spark, str(tmp_path / "s"))
    assert store.decisions().select("id").distinct().count() == 6
    assert main(["upload", "--uid", "v", "--file", f"{tmp_path}/2.txt", "--store", str(tmp_path / "s")]) == 0
    from hamloom.__main__ import list_refs

    assert list_refs(spark, "v", str(tmp_path / "s")) == ["u/0/2"] and len(list_refs(spark, "u", str(tmp_path / "s"))) == 2
    assert main(["upload", "--uid", "v", "--file", f"{tmp_path}/none.txt", "--store", str(tmp_path / "s")]) == 1
    assert main(["setup", "--store", str(tmp_path / "s"), "--threshold", "default=4"]) == 1
    assert main(["list-refs", "--uid", "v", "--store", str(tmp_path / "s")]) == 0 and main(["self-test"]) == 0
