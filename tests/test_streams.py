"""The verdict stream over several batches against a plain loop."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from tessera.streaming import windows


def test_last_verdicts(spark, tmp_path):
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, rng.randint(0, 5), rng.choice(["yes", "no", "undo", None]), start + datetime.timedelta(minutes=11 * k // 2)) for k in range(1500)]
    rows += [(2000, None, "yes", start), (2001, 1, "yes", None)]
    schema = "event long, item long, verdict string, ts timestamp_ntz"
    for n in range(5):  # files in the order of time, rows of a file in none
        part = rows[300 * n : 300 * n + 300] + (rows[1500:] if n == 4 else [])
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/log/part={n}")
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(*[f"{tmp_path}/log/*"]).withColumn("ts", F.col("ts").cast("timestamp"))
    told = windows.run_updates(windows.last_verdicts(log, "undo"), f"{tmp_path}/out", f"{tmp_path}/state").collect()
    want, end = {}, max(r[3] for r in rows[:1500])
    for event, item, verdict, ts in rows[:1500]:
        key, undone = (item, ts.date()), verdict in (None, "undo")
        before = want.get(key, (None, None, 0, 0))
        want[key] = (None if undone else verdict, event, before[2] + 1, before[3] + undone)
    got, settled = {}, {}
    for r in sorted(told, key=lambda r: (r["batch"], r["settled"])):
        assert (r["item"], r["day"]) not in settled  # nothing follows a settled row
        got[r["item"], r["day"]] = (r["verdict"], r["event"], r["events"], r["undone"])
        if r["settled"]:
            settled[r["item"], r["day"]] = r["batch"]
    assert got == want and len({r["batch"] for r in told}) > 3
    done = datetime.timedelta(days=1, minutes=30)
    assert set(settled) == {k for k in want if datetime.datetime.combine(k[1], datetime.time()) + done <= end - datetime.timedelta(hours=2)}
