"""Finding algebra: ops 24-27 and 35."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.functions import fixed
from codesieve.operators import scans
from codesieve.operators.mask import mask_source

SECURITY_STEPS = {1: "sql_injection", 2: "hardcoded_credential", 3: "unsanitized_input"}
QUALITY_STEP = 4


def _with_step(arr: Column, step: int) -> Column:
    return F.transform(arr, lambda f: f.withField("step", F.lit(step)))


def audit(src: DataFrame, mode: str = "security",
          keep: tuple[str, ...] = ("file_id", "repo", "path")) -> DataFrame:
    """Op 26: the security steps (17, 18, 19), the quality step (23) or both
    as one findings table with ``step``, carrying ``repo`` and ``path``.

    Each file is masked once and every step's findings are built inside its
    row, then exploded: one map-only stage, no cache, no join back to the
    file table (the file columns ride along)."""
    keep = list(keep)
    masked = mask_source(src.select(*keep, "code"))
    parts = []
    if mode in ("security", "all"):
        both = lambda l: F.concat(_with_step(scans.sql_concat_findings(l), 1), _with_step(scans.credential_findings(l), 2))
        parts.append(scans.logical_findings(scans.file_lines(), both))
        parts.append(_with_step(scans.unsanitized_input_findings(F.col("code")), 3))
    if mode in ("quality", "all"):
        parts.append(_with_step(scans.complexity_finding_array(), QUALITY_STEP))
    if not parts:
        raise ValueError(f"unknown audit mode {mode!r}")
    allf = parts[0] if len(parts) == 1 else F.concat(*parts)
    return masked.select(*keep, F.inline(allf)).select(
        *keep, "step", *[n for n, _ in scans.FINDING_COLUMNS])


# ---- op 24 ------------------------------------------------------------------------
def severity_norm(sev: Column) -> Column:
    m = F.create_map(*[x for k, v in fixed.SEVERITY_MAP for x in (F.lit(k), F.lit(v))])
    low = F.lower(F.coalesce(sev, F.lit("")))
    return F.coalesce(F.element_at(m, low), F.nullif(low, F.lit("")), F.lit("low"))


def classify_findings(df: DataFrame) -> DataFrame:
    """Op 24: normalised severity, kind (complexity / check / security) and
    the title, badge and line label a finding card shows."""
    sev = severity_norm(F.col("severity"))
    kind = (F.when(F.col("function").isNotNull() & F.col("complexity").isNotNull(), F.lit("complexity"))
            .when(F.col("status").isNotNull() & F.col("message").isNotNull(), F.lit("check"))
            .otherwise(F.lit("security")))
    is_ok = F.col("status") == "success"
    badge = (F.when(kind == "check", F.when(is_ok, F.lit("OK")).otherwise(F.lit("ERROR")))
             .otherwise(F.upper(F.coalesce(F.nullif(F.col("severity"), F.lit("")), sev))))
    css = (F.when(kind == "check", F.when(is_ok, F.lit("ok")).otherwise(F.lit("critical")))
           .otherwise(sev))
    title = (F.when(kind == "complexity", F.format_string("%s() — complejidad %s", F.col("function"),
                                                          F.col("complexity").cast("string")))
             .when(kind == "check", F.coalesce(F.nullif(F.col("message"), F.lit("")), F.col("type")))
             .otherwise(F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("Hallazgo"))))
    detail = (F.when(kind == "complexity", F.format_string(
        "Umbral recomendado: %s", F.coalesce(F.nullif(F.col("threshold"), F.lit(0)),
                                             F.lit(fixed.COMPLEXITY_THRESHOLD)).cast("string")))
        .when(kind == "security", F.nullif(F.col("description"), F.lit(""))))
    line_label = F.when((kind == "security") & (F.coalesce(F.col("line"), F.lit(0)) != 0),
                        F.format_string("Línea %s", F.col("line").cast("string")))
    return df.select("*", sev.alias("severity_norm"), kind.alias("kind"), css.alias("css"),
                     badge.alias("badge"), title.alias("title"), detail.alias("detail"),
                     line_label.alias("line_label"))


# ---- op 25 ------------------------------------------------------------------------
RANK_NAME = {4: fixed.SEV_CRITICAL, 3: fixed.SEV_HIGH, 2: fixed.SEV_MEDIUM, 1: fixed.SEV_LOW}


def sev_rank(sev: Column) -> Column:
    m = F.create_map(*[x for r, n in RANK_NAME.items() for x in (F.lit(n), F.lit(r))])
    return F.coalesce(F.element_at(m, sev), F.lit(0))


def rank_name(rank: Column) -> Column:
    out = F.lit("NINGUNO")
    for r in (1, 2, 3, 4):
        out = F.when(rank == r, F.lit(RANK_NAME[r])).otherwise(out)
    return out


def report_line(step: Column) -> Column:
    """Text of one finding in the report format of the audited tool."""
    icon = (F.when(F.col("severity").isin(fixed.SEV_CRITICAL, fixed.SEV_HIGH), F.lit("🔴"))
            .when(F.col("severity") == fixed.SEV_MEDIUM, F.lit("🟡")).otherwise(F.lit("🟢")))
    snippet = F.when(F.col("code_snippet").isNotNull() & (F.col("line") > 0),
                     F.concat(F.lit("\n   "), F.col("code_snippet"))).otherwise(F.lit(""))
    return (F.when(F.col("status").isNotNull(),
                   F.concat(F.when(F.col("status") == "success", F.lit("✓ ")).otherwise(F.lit("✗ ")),
                            F.coalesce(F.col("message"), F.col("type"))))
            .when(F.col("function").isNotNull(),
                  F.format_string("⚠ %s(): complejidad %s (máx recomendado: %s)", F.col("function"),
                                  F.col("complexity").cast("string"), F.col("threshold").cast("string")))
            .otherwise(F.concat(icon, F.lit(" "), F.col("severity"), F.lit(" — "), F.col("type"),
                                F.when(F.col("line") > 0, F.format_string(" (línea %s)", F.col("line").cast("string")))
                                .otherwise(F.lit("")), snippet)))


def file_reports(findings: DataFrame) -> DataFrame:
    """Op 25: one report per file: header, SEGURIDAD and CALIDAD lines in
    order, RESUMEN with the risk level.  One partial-aggregated group per
    file; the group holds only that file's findings."""
    sec = F.when(F.col("step") == QUALITY_STEP, F.lit(2)).otherwise(F.lit(1))
    items = findings.select("file_id", "path", sec.alias("sec"), "step",
                            F.coalesce("line", F.lit(0)).alias("ln"), "type",
                            F.coalesce("function", F.lit("")).alias("fn"),
                            report_line(F.col("step")).alias("text"),
                            F.when(F.col("status").isNull(), sev_rank(F.col("severity")))
                            .otherwise(F.lit(0)).alias("rank"),
                            F.col("status").isNull().cast("int").alias("is_finding"))
    g = (items.groupBy("file_id", "path")
         .agg(F.array_sort(F.collect_list(F.struct("sec", "step", "ln", "type", "fn", "text"))).alias("ls"),
              F.max("rank").alias("worst"), F.sum("is_finding").alias("n")))
    ls = F.col("ls")
    body = F.transform(ls, lambda x, i: F.when(
        (i == 0) | (x["sec"] != F.get(ls, i - 1)["sec"]),
        F.concat(F.when(x["sec"] == 1, F.lit("SEGURIDAD\n")).otherwise(F.lit("CALIDAD\n")), x["text"]))
        .otherwise(x["text"]))
    report = F.concat_ws("\n", F.concat(F.lit(fixed.TERMINATION_SIGNAL + " — "), F.col("path")),
                         F.lit("================================"), F.array_join(body, "\n"), F.lit(""),
                         F.lit("RESUMEN"),
                         F.format_string("Nivel de riesgo: %s (%s hallazgos)", rank_name(F.col("worst")),
                                         F.col("n").cast("string")))
    return g.select("file_id", "path", rank_name(F.col("worst")).alias("risk"),
                    F.col("n").cast("bigint").alias("n_findings"), report.alias("report"))


# ---- op 27 ------------------------------------------------------------------------
def risk_rollup(findings: DataFrame) -> DataFrame:
    """Op 27: counts per level and per type, worst severity, per file, per
    repo and in total: ``ROLLUP(repo, file_id)`` is the grouping sets
    ((repo, file), (repo), ()); partial aggregation runs map-side."""
    f = findings.where(F.col("status").isNull())
    sev = F.col("severity")
    aggs = [F.count(F.lit(1)).alias("n_findings"),
            F.max(sev_rank(sev)).alias("worst_rank"),
            F.count_if(sev == fixed.SEV_CRITICAL).alias("n_critical"),
            F.count_if(sev == fixed.SEV_HIGH).alias("n_high"),
            F.count_if(sev == fixed.SEV_MEDIUM).alias("n_medium"),
            F.count_if(sev == fixed.SEV_LOW).alias("n_low"),
            F.count_if(F.col("type") == "SQL_INJECTION").alias("n_sql_injection"),
            F.count_if(F.col("type") == "HARDCODED_CREDENTIAL").alias("n_hardcoded_credential"),
            F.count_if(F.col("type") == "UNSANITIZED_INPUT").alias("n_unsanitized_input"),
            F.count_if(F.col("type") == "HIGH_COMPLEXITY").alias("n_high_complexity")]
    r = f.rollup("repo", "file_id").agg(*aggs, F.grouping_id().alias("gid"))
    level = F.when(F.col("gid") == 0, F.lit("file")).when(F.col("gid") == 1, F.lit("repo")).otherwise(F.lit("total"))
    return r.select(level.alias("level"), "repo", "file_id", "n_findings",
                    rank_name(F.col("worst_rank")).alias("worst_severity"),
                    "n_critical", "n_high", "n_medium", "n_low", "n_sql_injection",
                    "n_hardcoded_credential", "n_unsanitized_input", "n_high_complexity")


# ---- op 35 ------------------------------------------------------------------------
def worst_functions(fns: DataFrame, k: int = 5) -> DataFrame:
    """Op 35: the ``k`` most complex functions per repo, ties by path then
    line.  ``row_number() <= k`` is planned as a window group limit, which
    trims each partition before the sort."""
    w = Window.partitionBy("repo").orderBy(F.col("complexity").desc(), "path", "line")
    return (fns.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("repo", F.col("rank").cast("bigint").alias("rank"), "path", "function", "line",
                    "complexity"))
