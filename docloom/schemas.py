"""Declared schemas; nothing is inferred from the data."""

from pyspark.sql import types as T

TOKEN_LINE = T.StructType(
    [
        T.StructField("input_ids", T.ArrayType(T.IntegerType())),
        T.StructField("attention_mask", T.ArrayType(T.ByteType())),
        T.StructField("corrupt_record", T.StringType()),
    ]
)

GOLD_FILE = T.StructType(
    [
        T.StructField(
            "application_summaries",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("folder_id", T.StringType()),
                        T.StructField("questions", T.MapType(T.StringType(), T.StringType())),
                    ]
                )
            ),
        ),
        T.StructField("corrupt_record", T.StringType()),
    ]
)
