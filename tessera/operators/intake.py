"""Strict reading of JSON records: rows of the asked types and, beside them, a quarantine with the reason for each row that is not.

A type is "int" (a whole number without a decimal point, within 64 bits, never a
boolean), "float" (any number, never a boolean) or "str"; ``[t]`` is a list of
them and a dict an object with at least those fields.  Nothing is converted
that is not of its type, nothing is dropped: every row has either its typed
value or at least one problem.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.naming import let

_REGION = {"start_beat": "int", "end_beat": "int", "start_time": "float", "end_time": "float", "score": "float", "ibi_cv": "float", "mean_energy": "float"}
#: A candidate of the library.
CANDIDATE = {
    "track_id": "int", "audio_path": "str", "native_bpm": "float", "energy": "float", "analysis_confidence": "float", "analysis_version": "int",
    "duration_seconds": "float", "stable_regions": [_REGION], "beat_times": ["float"], "beat_count": "int",
}
_SQL = {"int": "bigint", "float": "double", "str": "string"}
_TAKES = {"int": ("INTEGER",), "float": ("INTEGER", "NUMBER"), "str": ("STRING",)}
_PROBLEMS = "array<struct<field:string,code:string,found:string>>"


def sql_type(want) -> str:
    """The column type of a wanted type."""
    if isinstance(want, dict):
        return f"struct<{','.join(f'{k}:{sql_type(v)}' for k, v in want.items())}>"
    return f"array<{sql_type(want[0])}>" if isinstance(want, list) else _SQL[want]


def kind(v: Column) -> Column:
    """INTEGER, NUMBER, BOOLEAN, STRING, NULL, ARRAY or OBJECT; null where there is no value."""
    s = F.schema_of_variant(v)
    return (
        F.when(s == "BIGINT", "INTEGER").when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "NUMBER").when(s == "VOID", "NULL")
        .when(s.startswith("ARRAY"), "ARRAY").when(s.startswith("OBJECT"), "OBJECT").otherwise(s)
    )


def _one(field: Column, code: str, found: Column | None = None) -> Column:
    return F.array(F.struct(field.alias("field"), F.lit(code).alias("code"), (F.lit(None) if found is None else found).cast("string").alias("found"))).cast(_PROBLEMS)


def _problems(value: Column, want, field: Column) -> Column:
    none = F.array().cast(_PROBLEMS)

    def judge(x: Column) -> Column:
        v, k = x["v"], x["k"]
        if isinstance(want, dict):
            name = lambda n: F.when(field == "", n).otherwise(F.concat(field, F.lit(f".{n}")))
            takes, inside = ("OBJECT",), reduce(F.concat, [_problems(F.try_variant_get(v, f"$.{n}", "variant"), w, name(n)) for n, w in want.items()])
        elif isinstance(want, list):
            items = F.try_variant_get(v, "$", "array<variant>")
            takes, inside = ("ARRAY",), F.flatten(F.transform(items, lambda e, i: _problems(e, want[0], F.concat(field, F.lit("["), i.cast("string"), F.lit("]")))))
        else:
            takes, inside = _TAKES[want], none
        return F.when(v.isNull(), _one(field, "MISSING")).when(~k.isin(*takes), _one(field, "WRONG_TYPE", k)).otherwise(inside)

    return let(F.struct(value.alias("v"), kind(value).alias("k")), judge)


def judged(rows: DataFrame, want: dict | None = None, source: str = "record") -> DataFrame:
    """``rows`` with ``typed`` (a struct, null for a row with problems) and ``problems`` in place of the JSON text.

    One projection, no shuffle.  A problem is the field's path, a code (NOT_JSON,
    MISSING, WRONG_TYPE) and the kind that was found, in the order of the wanted
    fields.  Null, empty and malformed texts and objects with one key twice are
    NOT_JSON; fields that are not asked for are left out.  Equal rows are
    judged alike, each on its own; an empty table gives no rows.
    """
    want = CANDIDATE if want is None else want
    if clash := {"typed", "problems"} & set(rows.columns):
        raise ValueError(f"columns {sorted(clash)} are taken")
    parsed = F.try_parse_json(F.col(f"`{source}`"))
    both = let(parsed, lambda v: F.struct(v.alias("v"), F.when(v.isNull(), _one(F.lit(""), "NOT_JSON")).otherwise(_problems(v, want, F.lit(""))).alias("p")))
    # a generator of one row: what is parsed and judged here is not done again by a filter above
    found = rows.select("*", F.explode(F.array(both)).alias("problems"))
    typed = F.when(F.size("problems.p") == 0, F.try_variant_get("problems.v", "$", sql_type(want)))
    return found.withColumn("typed", typed).withColumn("problems", F.col("problems.p"))


def parted(rows: DataFrame, want: dict | None = None, source: str = "record") -> tuple[DataFrame, DataFrame]:
    """Typed rows (the fields beside the other columns) and the quarantine (all columns and the problems); together they are all rows."""
    found = judged(rows, want, source)
    fields = CANDIDATE if want is None else want
    rest = [c for c in rows.columns if c != source]
    if clash := set(rest) & set(fields):
        raise ValueError(f"columns {sorted(clash)} are fields of the record too")
    good = found.where(F.size("problems") == 0).select(*[F.col(f"`{c}`") for c in rest], "typed.*")
    return good, found.where(F.size("problems") > 0).drop("typed")


def problem_report(quarantine: DataFrame) -> DataFrame:
    """field, code, found and how many problems and rows, list places left out of the field's path."""
    keys = F.transform("problems", lambda p: F.struct(F.regexp_replace(p["field"], r"\[\d+\]", "[]").alias("field"), p["code"].alias("code"), p["found"].alias("found")))
    each = quarantine.select(F.explode(let(keys, lambda k: F.transform(k, lambda x, i: F.struct(x.alias("k"), (F.array_position(k, x) == i + 1).cast("bigint").alias("first"))))).alias("p"))
    return each.groupBy("p.k.field", "p.k.code", "p.k.found").agg(F.count("*").alias("n_problems"), F.sum("p.first").alias("n_rows"))
