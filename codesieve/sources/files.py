"""Sources and sinks: ops 1-4."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.functions import fixed
from codesieve.functions.text import byte_len


def load_sources(spark: SparkSession, path: str, glob: str = "*.go",
                 columns: dict[str, str] | None = None) -> DataFrame:
    """Op 1: a directory of source files (one row per file, whole text) or a
    parquet corpus with ``file_id, repo, path, code``.  A missing path is an
    error (Spark raises at analysis); files with no name are rejected."""
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
        m = {"file_id": "file_id", "repo": "repo", "path": "path", "code": "code", **(columns or {})}
        pth = (F.col(m["path"]) if m["path"] in df.columns
               else F.format_string("src/f%d.go", F.col(m["file_id"])))
        return (df.select(F.col(m["file_id"]).cast("bigint").alias("file_id"), F.col(m["repo"]).alias("repo"),
                          pth.alias("path"), F.col(m["code"]).alias("code"))
                .where(F.col("path").isNotNull() & (F.col("path") != "")))
    raw = (spark.read.option("wholetext", True).option("pathGlobFilter", glob)
           .option("recursiveFileLookup", True).text(path)
           .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("code")))
    return raw.select(F.xxhash64("path").alias("file_id"),
                      F.regexp_extract("path", r"^(?:[a-z]+:)?/*(?:[^/]*/)*?([^/]+)/[^/]+$", 1).alias("repo"),
                      "path", "code").where(F.regexp_extract("path", r"([^/]*)$", 1) != "")


def request_body_bytes(code: Column) -> Column:
    """Bytes of the JSON request body ``{"code": <code>}`` as a client sends it."""
    return byte_len(F.to_json(F.struct(code.alias("code"))))


def admit_requests(df: DataFrame, code: str = "code", max_bytes: int = fixed.MAX_BODY_BYTES) -> DataFrame:
    """Op 2: every request with ``accepted`` and a quarantine ``reason``:
    body over the limit, or null / empty code.  Size wins over empty."""
    c = F.col(code)
    size = request_body_bytes(c)
    reason = (F.when(size > max_bytes, F.lit(fixed.ERR_TOO_LARGE))
              .when(c.isNull() | (c == ""), F.lit(fixed.ERR_MISSING_CODE)))
    return df.select("*", size.cast("bigint").alias("body_bytes"), reason.alias("reason"),
                     reason.isNull().alias("accepted"))


def findings_json(df: DataFrame) -> Column:
    """A finding as its JSON line: null and zero fields left out, ``type``
    always present (``omitempty`` on every field but ``type``)."""
    def nz(c):
        return F.nullif(F.col(c), F.lit(0))

    def ne(c):
        return F.nullif(F.col(c), F.lit(""))
    obj = F.struct(nz("line").alias("line"), ne("severity").alias("severity"),
                   F.coalesce(F.col("type"), F.lit("")).alias("type"), ne("description").alias("description"),
                   ne("code_snippet").alias("code_snippet"), ne("function").alias("function"),
                   nz("complexity").alias("complexity"), nz("threshold").alias("threshold"),
                   ne("status").alias("status"), ne("message").alias("message"))
    return F.to_json(obj, {"ignoreNullFields": "true"})


def write_findings_jsonl(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Op 3 (sink): findings -> JSON lines, partitioned when asked."""
    out = df.select(*(partition_by or []), findings_json(df).alias("value"))
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.text(path)


def encode_frames(events: DataFrame) -> DataFrame:
    """Op 4: event rows -> ``data: <json>\\n\\n``.  ``done`` carries
    ``fixed_code`` + ``patches`` when fixed code is non-empty, else ``report``
    + ``findings`` (an empty array, never null); ``code_generated`` carries
    ``code``; every other type carries ``message``."""
    t = F.col("type")
    empty_findings = F.lit("[]")
    payload = (F.when((t == "done") & (F.coalesce(F.col("fixed_code"), F.lit("")) != ""),
                      F.format_string('{"fixed_code":%s,"patches":%s,"type":"done"}',
                                      _json_str(F.col("fixed_code")),
                                      F.coalesce(F.col("patches_json"), F.lit("[]"))))
               .when(t == "done", F.format_string('{"findings":%s,"report":%s,"type":"done"}',
                                                  F.coalesce(F.col("findings_json"), empty_findings),
                                                  _json_str(F.coalesce(F.col("report"), F.lit("")))))
               .when(t == "code_generated", F.format_string('{"code":%s,"type":"code_generated"}',
                                                            _json_str(F.coalesce(F.col("code"), F.lit("")))))
               .otherwise(F.format_string('{"message":%s,"type":%s}', _json_str(F.coalesce(F.col("message"), F.lit(""))),
                                          _json_str(t))))
    # Go's encoder escapes <, > and & inside strings; they cannot occur outside them
    for ch, esc in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        payload = F.replace(payload, F.lit(ch), F.lit(esc))
    return events.select("*", F.concat(F.lit("data: "), payload, F.lit("\n\n")).alias("frame"))


def _json_str(c: Column) -> Column:
    """A string as a JSON string literal (Spark's own escaping)."""
    j = F.to_json(F.struct(c.alias("v")))
    return F.substring(j, 6, F.length(j) - 6)
