"""URL verdicts against plain Python, and mined rules against counted token sets."""
import re
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from codesieve.llm import url_rules as T

ODD = [None, "", "no scheme", "http://", "HTTP://A.NET", "http://a.net/", "http://net/x", "https://planet/x", "http://B.Example.NET/en/1?x#y", "http://example.net/EN/",
       "x://y://Example.org/fr/é?a=1&B2=&a=2", "http://u@example.com:80/de/", "http://example.com/de/a/b.HTML#f", "http://example.com/de", "http://a.org/fr/" + "z" * 50_000,
       "://org/fr/\n/q", "http://x.org?/fr/", "http://x.net#/", "ftp://1.2.3.4/5/6.tar.gz/"]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in T.GIVEN if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_given_rules(spark):
    urls = spark.createDataFrame([(i, u) for i, u in enumerate(ODD)], "page_id long, url string")
    rule, verdict = T.given_rule(T.host_of(F.col("url")), T.path_of(F.col("url")))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.select(
        "page_id", T.host_of(F.col("url")).alias("host"), T.path_of(F.col("url")).alias("path"), rule.alias("rule"), verdict.alias("verdict")).collect()}
    assert got == {i: brute(u) for i, u in enumerate(ODD)}


def test_tokens(spark):
    urls = spark.createDataFrame([(u,) for u in ODD], "url string")
    got = dict(zip(ODD, [r.t for r in urls.select(T.tokens_of(F.col("url")).alias("t")).collect()], strict=True))
    assert got[None] == got[""] == got["no scheme"] == got["http://"] == []
    assert got["http://example.com/de/a/b.HTML#f"] == ["scheme=http", "top=com", "site=example.com", "first=de", "second=a", "ending=html", "depth=3", "fragment=yes"]
    assert got["x://y://Example.org/fr/é?a=1&B2=&a=2"][:2] == ["scheme=x", "top=y"]  # the first :// counts
    assert got["http://B.Example.NET/en/1?x#y"] == ["scheme=http", "top=net", "site=example.net", "before=b", "first=en", "depth=2", "keys=x", "fragment=yes"]
    assert all(len({t.split("=")[0] for t in x}) == len(x) for x in got.values())


def sample(rng, n):
    out = []
    for _ in range(n):
        host = rng.choice(["blog.a.example.com", "spam-farm.example.com", "www.b.example.org", "c.example.org"])
        url = f"http{rng.choice(['', 's'])}://{host}/{rng.choice(['en', 'ads'])}/{rng.integers(0, 999)}" + str(rng.choice(["", "?utm_source=feed", "?page=2"]))
        bad = "spam-farm" in url or "b.example" in url and "/ads/" in url
        out.append((url, bad))
    return out


def test_mined_rules(spark):
    """Planted blocks are learned from noisy labels; held-out pages are judged; a large host and copies do no harm."""
    rng = np.random.default_rng(12)
    train = [(u, T.BLOCK if b != (rng.random() < 0.05) else T.ALLOW) for u, b in sample(rng, 1200)]
    train += [("http://blog.a.example.com/en/7", T.ALLOW)] * 600 + [("http://x.example.com/en/7", None), (None, T.BLOCK)]
    labelled = spark.createDataFrame(train, "url string, label string")
    kept = T.mined_rules(labelled.select(T.tokens_of(F.col("url")).alias("tokens"), "label")).collect()
    sets = [(frozenset(r.t), r.label) for r in labelled.select(T.tokens_of(F.col("url")).alias("t"), "label").collect() if r.t and r.label]
    total, every = len(sets), Counter()
    for t, label in sets:
        for size in range(1, len(t) + 1):
            for part in combinations(sorted(t), size):
                every[part] += 1
                every[part, label] += 1
    assert kept
    for r in kept:
        both, own = every[tuple(r.tokens), r.verdict], every[tuple(r.tokens)]
        assert abs(r.confidence - both / own) < 1e-9 and abs(r.support - both / total) < 1e-9 and both >= 10 and r.confidence >= 0.6
        assert not any(every[p, r.verdict] >= 10 and every[p, r.verdict] / every[p] >= r.confidence + 1e-12 and any(tuple(k.tokens) == p for k in kept)
                       for n in range(1, len(r.tokens)) for p in combinations(r.tokens, n))
    assert {("before=spam-farm",), ("before=www.b", "first=ads")} <= {tuple(r.tokens) for r in kept if r.verdict == T.BLOCK}
    test = sample(rng, 400)
    pages = spark.createDataFrame([(i, u, "x", 1) for i, (u, _) in enumerate(test)] + [(None, None, "y", 2)], "page_id long, url string, host string, rule int")
    got = T.judged(pages, labelled, given=[]).collect()
    wrong = sum((r.verdict == T.BLOCK) != test[r.page_id][1] for r in got if r.page_id is not None)
    assert len(got) == 401 and wrong <= 8
    by_id = {r.page_id: (r.verdict, r.mined) for r in got}
    small = {r.page_id: (r.verdict, r.mined) for r in T.matched(  # the index in many blocks
        pages.select("page_id", T.tokens_of(F.col("url")).alias("tokens")), spark.createDataFrame(kept), 3).select("page_id", "mined").withColumn(
        "verdict", F.coalesce(F.col("mined")["verdict"], F.lit(T.ALLOW))).collect()}
    assert small == by_id


def test_labels_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/en/5"), (2, "http://a.org/en/6.html?x=1"), (3, "http://a.org/7/"), (4, "http://a.org/"), (None, "http://a.org/en/5"), (6, None),
                                   (7, "http://a.org/9")], "page_id long, url string")
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 1), (7, 1, 0), (7, 0, 0), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    got = sorted((r.url, r.label) for r in T.labelled_urls(pages, labels).collect())
    assert got == [("http://a.org/7/", "block"), ("http://a.org/en/5", "allow"), ("http://a.org/en/5", "allow"), ("http://a.org/en/6.html?x=1", "block")]
    none = labels.where("1 = 0")
    assert T.judged(pages, T.labelled_urls(pages, none)).count() == 7
    assert T.judged(pages.where("1 = 0"), T.labelled_urls(pages, labels)).count() == 0


def test_labels_are_not_sent_out(spark, tmp_path):
    """Labels in a small file are many rows in memory: no copy of them goes through the driver."""
    spark.range(4000).selectExpr("id as doc_id", "1 as quality", "cast(id % 2 as int) as toxic").write.parquet(str(tmp_path / "labels"))
    spark.range(300).selectExpr("id as page_id", "concat('http://a.org/en/', id % 100) as url").write.parquet(str(tmp_path / "pages"))
    found = T.labelled_urls(*[spark.read.parquet(str(tmp_path / t)) for t in ("pages", "labels")])
    assert sorted(map(tuple, found.collect())) == sorted((f"http://a.org/en/{i}", T.BLOCK if i % 2 else T.ALLOW) for i in range(100) for _ in range(3))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
