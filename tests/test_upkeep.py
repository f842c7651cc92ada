import random
import time
from collections import Counter

from lexloom.streaming import upkeep


def rebuilt(changes):
    """Statistics of the newest versions."""
    newest = {}
    for doc, version, text, deleted in changes:
        if doc not in newest or version > newest[doc][0]:
            newest[doc] = (version, text, deleted)
    live = [Counter(upkeep.tokens_of(t)) for _, t, gone in newest.values() if not gone]
    out = {t: (sum(t in c for c in live), sum(c[t] for c in live)) for t in set().union(*live)} if live else {}
    return out | ({None: (len(live), sum(c.total() for c in live))} if live else {})


def batch(spark, path, rows):
    spark.createDataFrame(rows, upkeep.CHANGES).coalesce(1).write.mode("append").parquet(f"{path}/changes")


def stream(spark, path):
    return spark.readStream.schema(upkeep.CHANGES).parquet(f"{path}/changes")


def held(spark, path):
    return {r["token"]: (r["n_t"], r["tf"]) for r in upkeep.statistics(spark, path).collect()}


def test_three_batches_equal_a_rebuild(spark, tmp_path):
    """Changes that replace, delete, bring back, repeat and come late: the deltas add up to an index made anew."""
    rng, path, seen = random.Random(1), f"file://{tmp_path}", []
    text = lambda: rng.choice((None, "", " ".join(rng.choices("a b c d Café _ 7".split(), k=rng.randint(1, 9)))))
    assert held(spark, path) == {}
    for _ in range(3):
        rows = [(rng.randrange(25), rng.randrange(1, 10_000), text(), rng.random() < 0.25) for _ in range(40)]
        rows = list({(d, v): (d, v, t, g) for d, v, t, g in rows}.values())
        rows += seen[:5]  # repeated
        batch(spark, path, rows)
        seen += rows
        upkeep.maintain(stream(spark, path), path).awaitTermination()
        assert held(spark, path) == rebuilt(seen)


def test_timers_forget_deleted_documents(spark, tmp_path):
    """While a deletion is remembered an older version comes to nothing; once its timer has run it would count again."""
    path = f"file://{tmp_path}"
    batch(spark, path, [(1, 5, "old words", False), (1, 6, None, True), (2, 1, "stay", False)])
    q = upkeep.maintain(stream(spark, path), path, keep_deleted=1, interval="500 milliseconds")
    until = time.time() + 60
    while time.time() < until and (q.lastProgress is None or q.lastProgress["batchId"] < 2):
        time.sleep(0.3)
    assert held(spark, path) == {"stay": (1, 1), None: (1, 1)}
    batch(spark, path, [(1, 3, "again", False), (2, 1, "stay", False)])
    while time.time() < until and "again" not in held(spark, path):
        time.sleep(0.5)
    q.stop()
    assert held(spark, path) == {"stay": (1, 1), "again": (1, 1), None: (2, 2)}
