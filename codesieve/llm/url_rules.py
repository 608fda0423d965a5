"""URL verdicts by given rules, and by association rules mined with FP-growth.

A given rule fits its host and all subdomains if the path starts with the rule's;
of those that fit the longest wins.  Any other URL is judged by mined rules.

A URL has at most one token of each of a fixed number of kinds (scheme, top label, site, what
stands before the site, first and second folder, extension, depth, query keys, fragment; runs of
digits count as ``#``), so that FP-growth meets at most ``2 ** kinds`` combinations a URL.
The tokens of every labelled URL and its label are one transaction.  Of the frequent sets
(``support`` of all transactions and ``least`` of them) Spark's FP-growth makes rules
``tokens -> label``; a rule is kept if its confidence reaches ``confidence``, if its
confidence less ``sigmas`` standard errors (Wilson's bound) is above the label's share of all
transactions, and if no rule of fewer of its tokens has the same label and at least its confidence.

A kept rule is filed under its rarest token, best rules first (confidence, support, fewest
tokens, tokens in order); a URL looks its own tokens up and takes the best rule whose tokens it all has.  The
index is sent out in blocks of at most ``block_rules`` rules, each a pass over the URLs.  Without a
rule the verdict is ``default``.

Edge cases: a null URL, or one without ``://``, has empty host and path, no tokens and the default verdict.
Null labels are ignored, of conflicting labels block holds.  Labels or pages that are missing give no mined rules or no
rows; repeated rows are judged each, and each counts in mining.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm import common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host, path, verdict.
GIVEN = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
BLOCK, ALLOW = "block", "allow"
LABEL = "label="
SALTS = 16


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"^(?s:.*?)://", "")), F.lit(""))


def host_of(url: Column) -> Column:
    return lowered(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def given_rule(host: Column, path: Column, rules=GIVEN) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """The URL's tokens ``kind=value``; none without a host."""
    shaped = lambda c: F.regexp_replace(lowered(c), r"\d+", "#")
    host = F.regexp_replace(host_of(url), r":\d*$", "")
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    folders = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    n, depth = F.size(labels), F.size(folders)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(query, "&"), lambda x: shaped(F.substring_index(x, "=", 1))), lambda x: x != "")))
    named = {
        "scheme": lowered(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)),
        "top": F.when(n > 0, F.element_at(labels, -1)),
        "site": F.when(n > 1, F.array_join(F.slice(labels, -2, 2), ".")),
        "before": F.when(n > 2, F.array_join(F.slice(labels, F.lit(1), n - 2), ".")),
        "first": F.when(depth > 1, shaped(F.get(folders, F.lit(0)))),
        "second": F.when(depth > 2, shaped(F.get(folders, F.lit(1)))),
        "ending": F.when(depth > 0, lowered(F.regexp_extract(F.element_at(folders, -1), r"\.([A-Za-z0-9]{1,8})$", 1))),
        "depth": F.least(depth, F.lit(9)).cast("string"),
        "keys": F.when(query != "", F.array_join(keys, "&")),
        "fragment": F.when(F.instr(url, "#") > 0, "yes")}
    listed = F.array(*[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(k + "="), v)) for k, v in named.items()])
    return F.when(host != "", F.filter(listed, lambda t: t.isNotNull())).otherwise(F.array().cast("array<string>"))


def mined_rules(labelled: DataFrame, support: float = 0.001, least: int = 10, confidence: float = 0.6, sigmas: float = 3.0) -> DataFrame:
    """(tokens, verdict, confidence, support) of the kept rules; ``labelled`` has (tokens, label)."""
    rows = C.cut(labelled.where(F.col("label").isin(BLOCK, ALLOW) & (F.size("tokens") > 0)).select("tokens", "label"))
    shares = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(shares.values())
    if total < least:
        return labelled.sparkSession.createDataFrame([], "tokens array<string>, verdict string, confidence double, support double")
    items = rows.select(F.array_append("tokens", F.concat(F.lit(LABEL), "label")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=max(support, least / total), minConfidence=confidence,
                     numPartitions=C.shuffle_width(rows.sparkSession)).fit(items)
    n = F.col("support") / F.col("confidence") * F.lit(float(total))  # URLs that hold the tokens
    p, z = F.col("confidence"), F.lit(sigmas)
    bound = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    share = F.create_map(*[x for k in (BLOCK, ALLOW) for x in (F.lit(k), F.lit(shares.get(k, 0) / total))])
    rules = model.associationRules.withColumn("verdict", F.get("consequent", F.lit(0))).where(F.col("verdict").startswith(LABEL)) \
        .withColumn("verdict", F.substring("verdict", len(LABEL) + 1, 10)).where(bound > F.element_at(share, F.col("verdict")))
    return without_redundant(C.cut(rules.select(F.array_sort("antecedent").alias("tokens"), "verdict", "confidence", "support")))


def without_redundant(rules: DataFrame) -> DataFrame:
    """The rules that no rule of fewer of their tokens, with the same verdict, equals or beats."""
    def run(batches):
        for b in C.frames(batches):
            out = [(list(part), v, list(t), c) for t, v, c in zip(b["tokens"], b["verdict"], b["confidence"], strict=True)
                   for size in range(1, len(t)) for part in combinations(t, size)]
            yield pd.DataFrame(out, columns=["tokens", "verdict", "wider", "least"])

    parts = rules.mapInPandas(run, "tokens array<string>, verdict string, wider array<string>, least double")
    beaten = parts.join(rules, ["tokens", "verdict"]).where("confidence >= least").select(F.col("wider").alias("tokens"), "verdict").distinct()
    return rules.join(beaten, ["tokens", "verdict"], "left_anti")


def _index(rules: list[tuple[list[str], str, float, float]]) -> dict[str, list[tuple[tuple, frozenset, str]]]:
    """rarest token -> (rank, tokens, verdict) of its rules, best first."""
    holders: dict[str, int] = {}
    for tokens, *_ in rules:
        for t in tokens:
            holders[t] = holders.get(t, 0) + 1
    out: dict[str, list] = {}
    for tokens, verdict, confidence, support in rules:
        rarest = min(tokens, key=lambda t: (holders[t], t))
        out.setdefault(rarest, []).append(((-confidence, -support, len(tokens), tuple(sorted(tokens))), frozenset(tokens), verdict))
    for filed in out.values():
        filed.sort(key=lambda r: r[0])
    return out


def best_rule(tokens, index: dict):
    """The best rule whose tokens all stand in ``tokens``."""
    own, best = frozenset(tokens), None
    for t in own:
        for rule in index.get(t, ()):
            if best is not None and rule[0] >= best[0]:
                break
            if rule[1] <= own:
                best = rule
                break
    return best


MATCH = "struct<verdict:string,confidence:double,support:double,tokens:array<string>>"


def matched(rows: DataFrame, rules: DataFrame, block_rules: int = 20_000) -> DataFrame:
    """``rows`` (with ``tokens``) and the best mined rule of each as ``mined``."""
    held = C.cut(rules)
    blocks = -(-held.count() // block_rules) or 1
    rows = rows.withColumn("mined", F.lit(None).cast(MATCH))
    for block in range(blocks):
        own = held.where(F.pmod(F.xxhash64("tokens", "verdict"), F.lit(blocks)) == block).collect()
        sent = rows.sparkSession.sparkContext.broadcast(_index([(r.tokens, r.verdict, r.confidence, r.support) for r in own]))

        def found(sent=sent):
            @F.pandas_udf(MATCH)
            def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
                for tokens in batches:
                    known: dict[tuple, tuple] = {}  # equal token sets of a batch
                    out = []
                    for t in tokens:
                        key = tuple(t)
                        if key not in known:
                            rule = best_rule(key, sent.value)
                            known[key] = (rule[2], -rule[0][0], -rule[0][1], list(rule[0][3])) if rule else (None, None, None, None)
                        out.append(known[key])
                    yield pd.DataFrame(out, columns=["verdict", "confidence", "support", "tokens"])

            return look(F.col("tokens"))

        rows = rows.withColumn("_new", found())
        rank = lambda c: (F.col(c)["confidence"], F.col(c)["support"], -F.size(F.col(c)["tokens"]))
        (c1, s1, n1), (c0, s0, n0) = rank("_new"), rank("mined")
        earlier = F.array_join(F.col("_new")["tokens"], " ") < F.array_join(F.col("mined")["tokens"], " ")
        better = (c1 > c0) | (c1 == c0) & ((s1 > s0) | (s1 == s0) & ((n1 > n0) | (n1 == n0) & earlier))
        rows = rows.withColumn("mined", F.when(F.col("_new")["verdict"].isNotNull() & F.coalesce(better, F.lit(True)), F.col("_new"))
                               .otherwise(F.col("mined"))).drop("_new")
        if block + 1 < blocks:
            rows = C.cut(rows)
    return rows


def judged(pages: DataFrame, labelled: DataFrame, default: str = ALLOW, given=GIVEN, id_col: str = "page_id", url_col: str = "url",
           **mining) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined) of every page; ``labelled`` has (url, label)."""
    rules = mined_rules(labelled.select(tokens_of(F.col("url").cast("string")).alias("tokens"), "label"), **mining)
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("tokens"))
    rule, verdict = given_rule(F.col("host"), F.col("path"), given)
    return matched(rows, rules).select("page_id", "host", "path", rule.alias("rule"),
                                       F.coalesce(verdict, F.col("mined")["verdict"], F.lit(default)).alias("verdict"), "mined")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, label): a page shows the document whose number is the last folder of its path, and has that document's label:
    allow for quality 1 without toxicity, else block.  Labels are copied ``SALTS`` times, so that one document with
    a third of all pages is joined in many tasks.  The join is always shuffled: Spark goes by the size of the labels' file,
    which says little about the copies' rows, and would collect them all on the driver to send them out."""
    number = F.regexp_extract(path_of(F.col("url")), r"/(\d{1,18})(?:\.[A-Za-z]+)?/?$", 1)
    shown = pages.select(F.col("url").cast("string").alias("url"), F.when(number != "", number.cast("long")).alias("doc_id"),
                         F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt")).where("doc_id is not null")
    good = (F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").cast("long").alias("doc_id")) \
        .agg(F.min(good).alias("good")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return shown.join(known.hint("merge"), ["doc_id", "salt"]).select("url", F.when(F.col("good"), ALLOW).otherwise(BLOCK).alias("label"))
