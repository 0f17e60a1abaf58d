"""Streams of `.dta` files that arrive in a folder.

Each file is decoded once, in the micro-batch that sees it; windows, watermarks and sinks are Structured Streaming's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.buffers import decode_contents
from ..sources.datasource import Options, info_of
from ..sources.header import spark_schema

#: Schema of Spark's binaryFile source, which a stream must be told.
_BINARY = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def stream_dta(spark: SparkSession, folder: str, like: str, **options) -> DataFrame:
    """Streaming frame of the `.dta` files in a folder; `like` is a file with the same columns."""
    options = {k: str(v) for k, v in options.items()}
    per_trigger = options.pop("max_files_per_trigger", "1000")
    o = Options(options)
    info = info_of(like, o.numeric_117)
    schema = spark_schema(info, o.chosen(info), missing=o.missing, strl=o.strl, row_index=o.row_index, file=o.file)
    files = spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", "*.dta").option("maxFilesPerTrigger", per_trigger).load(folder)
    return files.select("path", "content").mapInArrow(decode_contents(options, schema.fieldNames()), schema)
