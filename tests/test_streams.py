"""Streams against their batch twins, over files dropped into a folder."""

import json

from pyspark.sql import functions as F

from lodestone.streaming import chats


def drop(folder, rows, name="a.json"):
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def run(df, name, tmp_path, spark):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_dedup_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    drop(tmp_path / "in", [{"new_msg_id": i % 5, "ts": f"2024-01-01T00:00:{i:02d}"} for i in range(20)])
    got = run(chats.once(chats.read_messages(spark, str(tmp_path / "in"), "new_msg_id long, ts string")), "dedup", tmp_path, spark)
    assert sorted(r.new_msg_id for r in got) == [0, 1, 2, 3, 4]


def test_talk_bursts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("g|u", "how do I", "text", 0), ("g|u", "install it", "text", 5), ("g|u", "thanks a lot!", "text", 60), ("g|v", "x", "image", 3)]
    drop(tmp_path / "in", [{"user": u, "query": q, "type": k, "ts": f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}"} for u, q, k, s in rows])
    stream = chats.read_messages(spark, str(tmp_path / "in"), "user string, query string, type string, ts string")
    got = run(chats.talks(stream), "talks", tmp_path, spark)
    assert ("g|u", "how do I\ninstall it", True) in [(r.user, r.query, r.answerable) for r in got]


def test_limits_batch_twin(spark):
    r = spark.range(100).select(F.lit("k").alias("key"), F.timestamp_seconds(F.col("id")).alias("ts"), F.lit(2).alias("tokens"))
    assert [(x.n, x.limited) for x in chats.per_minute(r, 50).orderBy("slot").collect()] == [(60, True), (40, False)]


def test_matched_and_reverted_batch(spark):
    a = spark.createDataFrame([("s", 1, 0), ("s", 2, 0)], "store string, query_id long, t long").select("store", "query_id", F.timestamp_seconds("t").alias("ts"))
    b = spark.createDataFrame([("s", 1, 5, "yes"), ("s", 2, 999999, "late")], "store string, query_id long, t long, reply string").select("store", "query_id", F.timestamp_seconds("t").alias("ts"), "reply")
    assert [(r.query_id, r.reply) for r in chats.matched(a, b).collect()] == [(1, "yes")]
    sent = spark.createDataFrame([("g", 1, 0), ("g", 2, 100)], "group_id string, id long, t long").select("group_id", "id", F.timestamp_seconds("t").alias("ts"))
    cmd = spark.createDataFrame([("g", 150)], "group_id string, t long").select("group_id", F.timestamp_seconds("t").alias("ts"))
    assert [r.id for r in chats.reverted(sent, cmd).collect()] == [2]


def test_stream_stream_match(spark, tmp_path):
    for name, rows in (("a", [{"store": "s", "query_id": i, "ts": f"2024-01-01T00:00:{i:02d}"} for i in range(5)]), ("b", [{"store": "s", "query_id": i, "reply": "r", "ts": f"2024-01-01T00:01:{i:02d}"} for i in range(3)])):
        (tmp_path / name).mkdir()
        drop(tmp_path / name, rows)
    a = chats.read_messages(spark, str(tmp_path / "a"), "store string, query_id long, ts string", late=None)
    b = chats.read_messages(spark, str(tmp_path / "b"), "store string, query_id long, reply string, ts string", late=None)
    assert sorted(r.query_id for r in run(chats.matched(a, b), "matched", tmp_path, spark)) == [0, 1, 2]


def test_dispatch_and_replies(spark, tmp_path):
    (tmp_path / "in").mkdir()
    drop(tmp_path / "in", [{"type": k, "id": i, "ts": f"2024-01-01T00:00:{i:02d}"} for i, k in enumerate(["chat", "add_doc", "chat", "update_sample"])])
    tasks = lambda: chats.read_messages(spark, str(tmp_path / "in"), "type string, id long, ts string")
    seen = []
    handlers = {k: (lambda df, n, k=k: seen.append((k, sorted(r.id for r in df.collect())))) for k in ("add_doc", "update_sample", "chat")}
    chats.dispatch(tasks(), handlers, str(tmp_path / "ck")).awaitTermination(120)
    assert seen == [("add_doc", [1]), ("update_sample", [3]), ("chat", [0, 2])]
    out = str(tmp_path / "sent")

    def send(rows, out=out):
        with open(f"{out}-{rows[0]['id']}", "w") as f:
            f.write(str(len(rows)))

    chats.replies_to(tasks(), send, str(tmp_path / "ck2")).awaitTermination(120)
    assert sum(int(p.read_text()) for p in tmp_path.glob("sent-*")) == 4


def test_drained_stream_without_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert chats.drained(chats.read_messages(spark, str(tmp_path / "in"), "id long, ts string")).count() == 0
