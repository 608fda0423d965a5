"""Op 41: batch model-input datasets.

One row per file with the task text the web handlers would send (the code
between ``---CODE_START---`` / ``---CODE_END---``), the step budget, the
termination signal and a flag when the code itself holds a delimiter; and
per conversation the message list with roles mapped as the model client
maps them (``user`` stays, every other role becomes ``assistant``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions import fixed, tasks
from codesieve.sources.files import findings_json

MODES = {
    "analyze": ("system", tasks.ANALYZE_TASK, fixed.TERMINATION_SIGNAL),
    "security": ("security", tasks.SECURITY_TASK, fixed.TERMINATION_SIGNAL),
}


def build_prompts(files: DataFrame, mode: str = "security") -> DataFrame:
    """Task rows for ``analyze`` or ``security`` (3 steps each)."""
    prompt_id, template, signal = MODES[mode]
    code = F.col("code")
    return files.select(
        "file_id", F.lit(prompt_id).alias("system_prompt"),
        F.format_string(template.replace("%", "%%").replace("%%s", "%s"), code).alias("task"),
        F.lit(fixed.DEFAULT_MAX_STEPS).cast("bigint").alias("max_steps"),
        F.lit(signal).alias("termination_signal"),
        (code.contains(fixed.CODE_START) | code.contains(fixed.CODE_END)).alias("code_has_delimiter"))


def build_fix_prompts(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Fix-mode rows of every file: its findings as a JSON array with all ten fields (null and
    zero fields left out, ``type`` always present; ``<``, ``>`` and ``&`` escaped as the sender's encoder does), in
    order of line and type, ``[]`` without findings; ``max_steps`` = findings + 1 and at least 2."""
    key = F.struct(F.coalesce("line", F.lit(0)).alias("k"), F.coalesce("type", F.lit("")).alias("t"),
                   F.coalesce("description", F.lit("")).alias("d"), escaped(findings_json(findings)).alias("j"))
    per_file = findings.groupBy("file_id").agg(F.array_sort(F.collect_list(key)).alias("fs"))
    j = files.select("file_id", "code").join(per_file, "file_id", "left")
    fjson = F.concat(F.lit("["), F.coalesce(F.array_join(F.transform("fs", lambda x: x["j"]), ","), F.lit("")), F.lit("]"))
    n = F.coalesce(F.size("fs"), F.lit(0))
    template = tasks.FIX_TASK.replace("%", "%%").replace("%%s", "%s")
    return j.select("file_id", F.lit("fix").alias("system_prompt"),
                    F.format_string(template, fjson, F.col("code")).alias("task"),
                    F.greatest(F.greatest(n, F.lit(0)) + 1, F.lit(2)).cast("bigint").alias("max_steps"),
                    F.lit(fixed.FIX_END).alias("termination_signal"), fjson.alias("findings_json"),
                    (F.col("code").contains(fixed.CODE_START) | F.col("code").contains(fixed.CODE_END))
                    .alias("code_has_delimiter"))


def escaped(json: Column) -> Column:
    """JSON text with ``<``, ``>``, ``&`` and the two line separators of Unicode escaped (they stand in strings only)."""
    for ch in "<>&\u2028\u2029":
        json = F.replace(json, F.lit(ch), F.lit(f"\\u{ord(ch):04x}"))
    return json


def conversation_messages(msgs: DataFrame) -> DataFrame:
    """Messages per conversation in turn order, roles mapped, as JSON."""
    role = F.when(F.col("role") == "user", F.lit("user")).otherwise(F.lit("assistant"))
    g = (msgs.groupBy("conv_id")
         .agg(F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), F.col("text").alias("content"))))
              .alias("m")))
    return g.select("conv_id", F.size("m").cast("bigint").alias("n_messages"),
                    F.to_json(F.transform("m", lambda x: F.struct(x["role"].alias("role"),
                                                                  x["content"].alias("content"))))
                    .alias("messages_json"))
