"""Table schemas and the null policy of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS = T.ArrayType(T.StringType())
_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "texts": _TEXTS, "ints": T.ArrayType(T.IntegerType())}


def _fields(names: str, kind: T.DataType | str = "string") -> list[T.StructField]:
    return [T.StructField(n, _TYPES[kind] if isinstance(kind, str) else kind) for n in names.split()]


_VARS = T.ArrayType(T.StructType(_fields("var value", "texts")))

#: The nested source corpus.
FUNCTIONS = T.StructType([
    *_fields("fname func_def"), *_fields("asm", T.StructType(_fields("target code", "texts"))), *_fields("synth_deps real_deps func_head_types synth_exe_wrapper"),
    *_fields("synth_io_pairs", T.StructType([*_fields("input output", _VARS), *_fields("dummy_funcs", "texts")])),
])
#: The flat fact table. The seed's range needs a long.
PAIRS = T.StructType([
    *_fields("fname func_def technique clean_asm obfuscated_asm clean_ir obfuscated_c"), *_fields("tigress_seed", "long"),
    *_fields("exebench_split c_deps func_c_signature cpp_wrapper dummy_funcs io_pairs"),
])
PREDICTIONS = T.StructType(_fields("fname technique prediction reference"))
#: functional_pass is null where it wasn't tested.
CHECKS = T.StructType([
    T.StructField(n, _TYPES[k])
    for n, k in zip("syntax_valid syntax_error compiles compile_error links link_error functional_pass functional_detail io_pass_count io_total_count".split(), ["boolean", "string"] * 4 + ["int"] * 2, strict=True)
])
PREFERENCES = T.StructType([*_fields("prompt chosen rejected"), *_fields("score_chosen score_rejected", "int"), *_fields("fname")])
BATCH = T.StructType(_fields("input_ids attention_mask labels", "ints"))
SIDECAR = T.StructType(_fields("generation_stats", T.StructType([
    *_fields("source_rows rows_seen samples_written skipped_missing skipped_short skipped_long skipped_ir failures", "long"),
    *_fields("samples_per_transform", T.MapType(T.StringType(), T.LongType())),
])))
METADATA = ("c_deps", "func_c_signature", "cpp_wrapper", "dummy_funcs", "io_pairs")


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with just the schema's columns, cast; those that it lacks are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def blank_metadata(df: DataFrame, columns: tuple[str, ...] = METADATA) -> DataFrame:
    """Null metadata as empty strings: what a join that missed leaves."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in columns if c in df.columns})
