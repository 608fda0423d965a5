"""Strict JSON-line acceptance with Go ``encoding/json`` rules, as Catalyst
expressions over VARIANT (no UDF).

* the line must be exactly one JSON value: ``[<line>]`` must parse to an array of
  one element.  Only a ``]`` in the line could end that array early and let other text
  follow, so lines that hold one must parse as ``{"w":<line>}`` too, which after the
  value admits only ``}``, ``,`` or the end;
* keys match without regard to case (an exact match wins);
* a wrong type for a known field rejects the whole line; ``null`` = absent;
  ``1.0``, ``1e2`` and out-of-range numbers are not integers;
* of a repeated key the last value holds (``spark.sql.variant.allowDuplicateKeys``,
  which ``codesieve.session.prepare`` sets; without it these functions refuse to work);
* known differences for a repeated key: an earlier value of a wrong type does not
  reject the line, a later ``null`` takes the place of an earlier value, and of
  ``type`` and ``Type`` the exact one holds, not the last.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from codesieve.session import REPEATED_KEYS


def wrapped(line: Column) -> Column:
    """``[line]`` as a VARIANT; null if that is not valid."""
    if SparkSession.active().conf.get(REPEATED_KEYS, "false") != "true":
        raise RuntimeError(f"{REPEATED_KEYS} is not set: call codesieve.session.prepare(spark) first")
    return F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))


def whole_value_ok(w: Column, line: Column) -> Column:
    """``w`` = ``wrapped(line)``."""
    other = F.try_parse_json(F.concat(F.lit('{"w":'), line, F.lit("}")))
    one = F.size(F.try_variant_get(w, "$", "array<variant>")) == 1
    return F.coalesce(one & F.when(line.contains("]"), other.isNotNull()).otherwise(F.lit(True)), F.lit(False))


def _field(obj: Column, name: str) -> Column:
    exact = obj.getItem(name)
    folded = F.get(F.map_values(F.map_filter(obj, lambda k, v: F.lower(k) == name)), 0)
    return F.coalesce(exact, folded)


def _kind(v: Column) -> Column:
    return F.when(v.isNull(), F.lit("ABSENT")).otherwise(F.schema_of_variant(v))


def parse_objects(df, line: Column, fields: list[tuple[str, str]], out: str = "f"):
    """struct<ok boolean, <fields>> of each row's line as column ``out``; ``fields`` = (name, 'string'|'bigint').  Staged so that the JSON text is
    parsed once and the key map is built once per line (projections whose
    results are used many times are not inlined by Catalyst)."""
    keep = [c for c in df.columns]
    w = df.select(*keep, line.alias("_l"), wrapped(line).alias("_w"))
    m = w.select(*keep, whole_value_ok(F.col("_w"), F.col("_l")).alias("_ok0"),
                 F.try_variant_get(F.col("_w"), "$[0]", "map<string,variant>").alias("_obj"))
    obj = F.col("_obj")
    k = m.select(*keep, "_ok0", "_obj",
                 F.exists(F.map_keys(obj), lambda x: x != F.lower(x)).alias("_fold"))
    vals, ok = [], F.col("_ok0") & obj.isNotNull()
    kinds = []
    for name, typ in fields:
        v = F.when(F.col("_fold"), _field(obj, name)).otherwise(obj.getItem(name))
        kinds.append((name, typ, v))
    staged = k.select(*keep, F.col("_ok0"), obj.isNotNull().alias("_isobj"),
                      *[v.alias(f"_v_{name}") for name, _, v in kinds])
    ok = F.col("_ok0") & F.col("_isobj")
    for name, typ, _ in kinds:
        want = "STRING" if typ == "string" else "BIGINT"
        kd = _kind(F.col(f"_v_{name}"))
        ok = ok & kd.isin("ABSENT", "VOID", want)
        vals.append(F.when(kd == want, F.try_variant_get(F.col(f"_v_{name}"), "$", typ)).alias(name))
    return staged.select(*keep, F.struct(ok.alias("ok"), *vals).alias(out))


def json_value_ok(s: Column) -> Column:
    """True when ``s`` is exactly one valid JSON value (any kind)."""
    return whole_value_ok(wrapped(s), s)
