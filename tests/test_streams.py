"""Streams that stop, fail and go on, against one pass over all rows."""

from __future__ import annotations

import datetime as dt
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from parlance.streaming import ingest, periods
from parlance.streaming.ledger import Ledger

DAY = dt.timedelta(days=1)


def land(folder, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{uuid.uuid4().hex}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "t"))
    frame = lambda *x: spark.createDataFrame([(v,) for v in x], "v int")
    assert ledger.read("v int").count() == 0
    ledger.write(frame(1, 2), 0)
    ledger.write(frame(3), 1)
    ledger.write(frame(3, 4), 1)
    assert sorted((r.v, r.batch_id) for r in ledger.read("v int").collect()) == [(1, 0), (2, 0), (3, 1), (4, 1)]
    # what an attempt left that never reached the ledger isn't seen
    frame(99).write.parquet(str(tmp_path / f"t/data/attempt={2:012d}-lost"))
    assert ledger.read("v int").filter("v = 99").count() == 0
    ledger.write(frame(5), 2)
    assert not (tmp_path / f"t/data/attempt={2:012d}-lost").exists() and ledger.batches().count() == 3


def test_ingest_lands_each_key_once_over_restarts_and_failures(spark, tmp_path):
    landing, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    land(landing, [{"entry_ID": k, "t": f"thing {k}"} for k in range(10)] + [{"entry_ID": 3, "t": "again"}, {"t": "no key thing"}])
    fails = []

    def transform(batch):
        if fails:
            raise RuntimeError(fails.pop())
        return batch.filter(F.col("t").contains("thing")).select("entry_ID", "t")

    run = lambda: ingest.ingest_once(spark, str(landing), "entry_ID long, t string", transform, target, checkpoint).awaitTermination(120)
    run()
    land(landing, [{"entry_ID": k, "t": f"thing {k}"} for k in range(5, 15)] + [{"t": "no key thing"}, {"t": "other thing"}])
    fails.append("lost")
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    run()  # nothing new
    rows = Ledger(spark, target).read("entry_ID long, t string").collect()
    assert sorted((r.entry_ID, r.t) for r in rows if r.entry_ID is not None) in ([(k, f"thing {k}") for k in range(15)], [(k, f"thing {k}") for k in range(15) if k != 3])
    assert sorted(r.t for r in rows if r.entry_ID is None) == ["no key thing", "other thing"]


def expected(parts, late=7 * DAY):
    """Counts, revisions and late rows by taking the batches one after another."""
    out, newest = {}, {}
    for part in parts:
        touched, before = {}, dict(newest)
        for actor, ts in part:
            if ts is None:
                continue
            start = ts.replace(hour=0, minute=0, second=0, microsecond=0)
            touched[actor, start] = touched.get((actor, start), 0) + 1
            newest[actor] = max(newest.get(actor, ts), ts)
        for (actor, start), n in touched.items():
            total, revisions, missed = out.get((actor, start), (0, -1, 0))
            if actor in before and start + DAY <= before[actor] - late:
                out[actor, start] = (total, revisions, missed + n)
            else:
                out[actor, start] = (total + n, revisions + 1, missed)
    return {k: (n, max(r, 0), m) for k, (n, r, m) in out.items()}


def test_period_counts_with_late_rows(spark, tmp_path):
    draw = random.Random(6)
    landing, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    parts = []
    for k in range(4):
        now = dt.datetime(2024, 1, 1) + 6 * k * DAY
        rows = [(draw.choice(["hot", "hot", "a", "b", None]), now + dt.timedelta(minutes=draw.randrange(8 * 1440))) for _ in range(300)]
        rows += [("a", now - draw.randrange(1, 25) * DAY) for _ in range(20)] + [("b", None)]
        parts.append(rows)
    for rows in parts:
        land(landing, [{"actor": a, "ts": ts.isoformat() if ts else None} for a, ts in rows])
        stream = spark.readStream.schema("actor string, ts timestamp").json(str(landing))
        periods.follow(stream, "ts", "actor", target, checkpoint).awaitTermination(200)
    found = {(r.actor, r.start): (r.n, r.revisions, r.late) for r in periods.counts(spark, target).collect()}
    want = expected(parts)
    assert found == want and sum(v[2] for v in want.values()) > 20 and max(v[1] for v in want.values()) > 0
    assert sum(v[0] + v[2] for v in found.values()) == sum(ts is not None for p in parts for _, ts in p)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
