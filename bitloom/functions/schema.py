"""The typed pair schema shared by sources and operators."""

from pyspark.sql import types as T

PAIR_SCHEMA = T.StructType(
    [
        T.StructField("source_doc", T.StringType()),
        T.StructField("line_id", T.StringType()),
        T.StructField("fragment_id", T.StringType()),
        T.StructField("section_id", T.StringType()),
        T.StructField("chapter_id", T.StringType()),
        T.StructField("src", T.StringType()),
        T.StructField("tgt", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("sheet_name", T.StringType()),
        T.StructField("ord", T.LongType()),
    ]
)
