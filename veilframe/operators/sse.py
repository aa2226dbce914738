"""Server-sent events: lines with a bound, and frames of ``data`` fields.

Lines have stream_id, line_no (their order) and line. A stream's frames come before its first
error; the error itself is a row with frame and data null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fields that a stream may carry besides data.
IGNORED = ("event", "id", "retry")


def emit(events: DataFrame, order: str = "seq", data: str = "data") -> DataFrame:
    """stream_id, line_no (struct), line: a ``data:`` line for each line of ``data``, then a blank."""
    lines = F.concat(F.transform(F.split(data, "\n", -1), lambda x: F.concat(F.lit("data: "), x)), F.array(F.lit("")))
    return events.where(F.col(data).isNotNull()).select("stream_id", F.col(order).alias("_o"), F.posexplode(lines).alias("_p", "line")).select(
        "stream_id", F.struct(F.col("_o").alias("seq"), F.col("_p").alias("part")).alias("line_no"), "line"
    )


def frames(lines: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """stream_id, frame (from 0), data, error of each stream.

    Lines that start with a colon are comments; a field other than data, event, id and retry is
    an error, as are a line without a colon and the line that passes ``most_bytes``.
    """
    upto = Window.partitionBy("stream_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    name = F.substring_index("line", ":", 1)
    known = (F.col("line") == "") | F.col("line").startswith(":") | (F.col("line").contains(":") & name.isin("data", *IGNORED))
    read = lines.withColumns({"_bytes": F.sum(F.octet_length("line") + 1).over(upto), "_blank": F.sum((F.col("line") == "").cast("long")).over(upto)})
    wrong = F.when(F.col("_bytes") > most_bytes, "too_large").when(~F.col("line").contains(":") & ~known, "malformed").when(~known, "unsupported_field")
    read = read.withColumn("_error", wrong).withColumn("_errors", F.count("_error").over(upto))
    # A frame that its blank line did not end before the error is not delivered.
    value = F.when((name == "data") & ~F.col("line").startswith(":") & (F.col("line") != ""), F.regexp_replace(F.substring("line", 6, 1 << 30), r"\A ", ""))
    frame = F.col("_blank") - (F.col("line") == "").cast("long")
    parts = read.select("stream_id", frame.alias("_frame"), "line_no", value.alias("_data"), "_error", "_errors")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_data").isNotNull(), F.struct("line_no", "_data")))), lambda x: x["_data"]), "\n")
    made = parts.groupBy("stream_id", "_frame").agg(
        F.count("_data").alias("_n"), joined.alias("data"), F.max("_errors").alias("_errors"), F.min_by("_error", F.when(F.col("_error").isNotNull(), F.col("line_no"))).alias("error")
    )
    made = made.where((F.col("_errors") == 0) & (F.col("_n") > 0) | (F.col("error").isNotNull() & (F.col("_errors") > 0)))
    made = made.withColumn("_k", F.row_number().over(Window.partitionBy("stream_id", F.col("error").isNotNull()).orderBy("_frame")).cast("long") - 1)
    made = made.where(F.col("error").isNull() | (F.col("_k") == 0))
    return made.select("stream_id", F.when(F.col("error").isNull(), F.col("_k")).alias("frame"), F.when(F.col("error").isNull(), F.col("data")).alias("data"), "error")
