"""Schemas of the frames that the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    return T.StructType([T.StructField(*pair) for pair in ((n, _TYPES[t]) for n, t in (x.split(":") for x in spec.split()))])


_TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
    "floats": T.ArrayType(T.FloatType()), "strings": T.ArrayType(T.StringType()), "ints": T.ArrayType(T.IntegerType()),
}

#: The columns of a formula file by position; names of the two unread ones are ours.
FORMULA_FILE = _struct("id:string post_id:string thread_id:string type:string comment_id:string old_visual_id:string visual_id:string issue:string formula:string")
FORMULA_INDEX = _struct("id:long post_id:long type:string old_visual_id:string visual_id:string latex:string opt:string slt:string")
TOPICS = _struct("topic_id:string query:string")
QRELS = _struct("topic_id:string doc_id:string grade:double")
POSTS = _struct("post_id:string text:string")
RUN = _struct("topic_id:string doc_id:string score:double rank:int")
EMBEDDINGS = _struct("id:string embedding:floats")
GRAPH = _struct("x:ints src:ints dst:ints num_nodes:int")
POST_LINES = _struct("post_id:string post_type:string title:string text:string formulas:strings")
