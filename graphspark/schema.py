"""Fixed schemas of the graph tables. An absent text is the empty string, never null, but for ``branch``."""

from __future__ import annotations

from pyspark.sql import types as T

ARG = T.StructType(
    [
        T.StructField("index", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("kw", T.StringType()),
        T.StructField("full", T.StringType()),
    ]
)
META = T.StructType(
    [
        T.StructField("args", T.ArrayType(ARG)),
        T.StructField("unknown", T.BooleanType()),
        T.StructField("decorator", T.StringType()),
        T.StructField("arg_index", T.IntegerType()),
        T.StructField("arg_kind", T.StringType()),
        T.StructField("call_edge", T.StringType()),
    ]
)


def _fields(names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names.split()]


NODE = T.StructType([*_fields("id kind name location end_location scope type_annotation source_hash"), T.StructField("is_param", T.IntegerType())])
EDGE = T.StructType([*_fields("id edge_type from_node to_node location code metadata raw_to_node")])
TRANSFORM = T.StructType([*_fields("id kind op op_node location"), T.StructField("inputs", T.ArrayType(T.StringType())), T.StructField("outputs", T.ArrayType(T.StringType())), *_fields("branch code")])
FILE = T.StructType([*_fields("path lang source_hash"), T.StructField("size", T.LongType()), T.StructField("content", T.BinaryType())])

# Fixed value: what the ids of symbols outside the tree begin with.
EXTERNAL = "#external:"
