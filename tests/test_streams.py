import random
import time

import numpy as np
from pyspark.sql import functions as F

from lithos.operators.joins import gap_pairs
from lithos.streaming import stateful as S

MODELS = "source string, t long, params array<double>, misfit double"


def halves(spark, root, rows, schema, transform, cut):
    """What a stream tells of rows that come in parts, each after a start from the checkpoint."""
    for part in np.split(np.array(rows, dtype=object), cut):
        spark.createDataFrame([tuple(r) for r in part], schema).coalesce(2).write.mode("append").parquet(f"{root}/in")
        S.run_available(spark, f"{root}/in", spark.createDataFrame([], schema).schema, transform, f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out")


def test_density_begins_anew_and_survives_restarts(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.choice("ab"), t, [r.random() * 1.2, r.random()], r.random() * 40 - (30 if t == 170 else 0)) for t in range(300)]
    told = halves(spark, tmp_path, rows, MODELS, lambda df: S.running_density(df, [(0, 1), (0, 1)], 4), [100, 180])
    found = {(x.source, x.dim, x.bin): x.cnt for x in S.latest(told).collect()}
    expected = dict.fromkeys(((s, d, b) for s in "ab" for d in range(2) for b in range(4)), 0)
    best = {}
    for s, _, params, misfit in rows:
        if misfit < best.get(s, float("inf")) - 5:
            expected |= {k: 0 for k in expected if k[0] == s}
        best[s] = min(misfit, best.get(s, float("inf")))
        for d, x in enumerate(params):
            if 0 <= x <= 1:
                expected[s, d, min(int(x * 4), 3)] += 1
    assert found == expected


def test_top_models(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.choice("ab"), t, [0.0], float(r.randrange(30))) for t in range(200)]
    told = halves(spark, tmp_path, rows, MODELS, lambda df: S.top_models(df, 7), [90])
    for s in "ab":
        best = sorted((m, t) for x, t, _, m in rows if x == s)[:7]
        assert [(x.misfit, x.t) for x in S.latest(told).where(F.col("source") == s).orderBy("rank").collect()] == best


def test_pairs_across_restarts(spark, tmp_path):
    r = random.Random(3)
    rows = sorted({(r.choice("abc"), t) for t in r.sample(range(6000), 300)}, key=lambda x: x[1])
    told = halves(spark, tmp_path, rows, "source string, t long", S.gap_pairs, [80, 150, 151])
    whole = gap_pairs(spark.createDataFrame(rows, "source string, t long"), "source", F.col("t"))
    assert sorted(map(tuple, told.select("source", "t0", "t1").collect())) == sorted(map(tuple, whole.collect()))


def test_flush_by_timer(spark, tmp_path):
    """Counts come when the timer goes off, not with the batch."""
    spark.createDataFrame([("a", 1, [0.5], 1.0), ("a", 2, [0.6], 1.0)], MODELS).write.parquet(f"{tmp_path}/in")
    seen = []
    with S.state_store(spark):
        stream = S.running_density(spark.readStream.schema(spark.createDataFrame([], MODELS).schema).parquet(f"{tmp_path}/in"), [(0, 1)], 2, flush_ms=2000)
        q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.append((n, df.collect()))).option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        end = time.time() + 60
        while not any(rows for _, rows in seen) and time.time() < end:
            time.sleep(0.5)
    finally:
        q.stop()
    first = next((n, rows) for n, rows in seen if rows)
    assert first[0] > 0 and {(x.bin, x.cnt) for x in first[1]} == {(0, 0), (1, 2)}
