"""What the shared helpers leave on disk, and components against a brute-force version."""
import time

import numpy as np
from pyspark.sql import functions as F

from codesieve.llm import common, neardup


def shuffles(spark):
    """Names of the shuffle files that this session holds."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def left_by(spark, step):
    """The step's result and the shuffle files it leaves (they go in the background)."""
    before = shuffles(spark)
    out, left = step(), 1
    for _ in range(20):
        if not (left := len(shuffles(spark) - before)):
            break
        time.sleep(0.25)
    return out, left


def test_cut_lets_its_shuffle_files_go(spark):
    sums = lambda: spark.range(5000).repartition(8).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
    usual = spark.conf.get(common.RELEASE, "false")
    (kept, df), left = left_by(spark, lambda: (common.cut(df := sums()), df))
    assert left == 0 and spark.conf.get(common.RELEASE, "false") == usual
    assert kept.agg(F.sum("n")).first()[0] == 5000 and len(df.collect()) == len(df.collect()) == 100
    twice = spark.range(3).select("id", "id")  # names may repeat
    assert [tuple(r) for r in common.cut(twice).collect()] == [tuple(r) for r in twice.collect()]


def test_near_duplicates_leave_no_shuffle_files(spark):
    """Of the whole job only the shuffles of the last step, which the caller runs, are left."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(50)]
    texts = [" ".join(f"e{i}" if j in set(rng.choice(50, 3)) else w for j, w in enumerate(base)) for i in range(60)] + [" ".join(base)] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out, left = left_by(spark, lambda: neardup.near_duplicates(docs, 2))
    assert left == 0 and out.count() == 90


def test_components(spark):
    """Paths, stars, rings and random edges, with loops and edges given twice, either way round."""
    rng = np.random.default_rng(7)
    path = rng.permutation(np.arange(1000, 1200))
    edges = [*zip(path, path[1:]), *((2999, i) for i in range(2000, 2100)), *((3000, i) for i in range(3001, 3100)),
             *((4000 + i, 4000 + (i + 1) % 37) for i in range(37)), *rng.integers(0, 400, (260, 2)), (9, 9), (5000, 5000), (-7, 1100)]
    edges = [(int(a), int(b)) for a, b in edges]
    edges += [(b, a) for a, b in edges[::5]] + edges[::7]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    joined = {x for a, b in edges if a != b for x in (a, b)}
    got = common.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert sorted((r.node, r.root) for r in got) == sorted((x, root[x]) for x in joined)
