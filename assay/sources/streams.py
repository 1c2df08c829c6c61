"""Newline-delimited JSON records and server-sent events from text rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.text import retry_text, split_lines, split_records

#: Bytes of a stream, bytes of a line, and items.
MAX_BYTES, MAX_LINE, MAX_ITEMS = 8 << 20, 1 << 20, 10_000


def records(df: DataFrame, text_col: str, keep: list[str], max_items: int = MAX_ITEMS) -> DataFrame:
    """``keep, item, record, code``: the non-blank records of each text.

    Records end with LF or CRLF. ``code`` is ``contract.ndjson`` for a record
    with a bare CR, ``contract.budget`` for items over the limit, else null. A
    bare CR is judged before blankness. Null text has no records.
    """
    lines = df.select(*keep, F.posexplode(split_records(F.col(text_col))).alias("line", "record"))
    bare = F.col("record").contains("\r")
    lines = lines.where(bare | (F.trim(F.col("record"), F.lit(" \t\n\r\f\u000b")) != ""))
    order = Window.partitionBy(*keep).orderBy("line")
    out = lines.withColumn("item", F.row_number().over(order))
    code = F.when(bare, "contract.ndjson").when(F.col("item") > max_items, "contract.budget")
    return out.select(*keep, "item", "record", code.alias("code"))


def line_budget(df: DataFrame, text_col: str, keep: list[str], max_bytes: int = MAX_BYTES, max_line: int = MAX_LINE) -> DataFrame:
    """``keep, bytes, longest_line, code``: ``contract.budget`` where a text or a line of it is too long."""
    sizes = F.transform(split_lines(F.col(text_col)), F.octet_length)
    out = df.select(*keep, F.octet_length(text_col).alias("bytes"), F.coalesce(F.array_max(sizes), F.lit(0)).alias("longest_line"))
    over = (F.col("bytes") > max_bytes) | (F.col("longest_line") > max_line)
    return out.withColumn("code", F.when(over, "contract.budget"))


def _field(line: Column) -> Column:
    return F.when(line.contains(":"), F.substring_index(line, ":", 1)).otherwise(line)


def _value(line: Column) -> Column:
    rest = F.when(line.contains(":"), F.substr(line, F.instr(line, ":") + 1)).otherwise("")
    return F.when(rest.startswith(" "), F.substr(rest, F.lit(2))).otherwise(rest)


def events(df: DataFrame, text_col: str, keep: list[str], max_items: int = MAX_ITEMS) -> DataFrame:
    """``keep, event_no, data, event, id, retry, over``: the events of each text.

    Lines end with LF, CR or CRLF; a byte order mark counts on the first line
    only. A blank line ends a frame; frames without data, and the last frame
    without a blank line, give no event. Within a frame data lines are joined
    and the last ``event``, ``id`` (without NUL) and ``retry`` (digits) count.
    ``over`` marks events beyond ``max_items``. A text's lines stay in its row
    until frames are cut, so texts, not lines, are shuffled to their keys.
    """
    lines = df.select(*keep, F.posexplode(split_lines(F.col(text_col))).alias("line_no", "line"))
    first = (F.col("line_no") == 0) & F.col("line").startswith("\ufeff")
    lines = lines.withColumn("line", F.when(first, F.substr("line", F.lit(2))).otherwise(F.col("line")))
    order = Window.partitionBy(*keep).orderBy("line_no")
    blank = F.col("line") == ""
    # a blank line belongs to the frame that it ends
    frame = F.coalesce(F.sum(blank.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fields = lines.withColumn("frame", frame).select(
        *keep,
        "frame",
        "line_no",
        blank.alias("ends"),
        F.when(~F.col("line").startswith(":") & ~blank, _field(F.col("line"))).alias("name"),
        _value(F.col("line")).alias("value"),
    )
    name, value = F.col("name"), F.col("value")
    data = F.array_sort(F.collect_list(F.when(name == "data", F.struct("line_no", "value"))))

    def last(test: Column, of: Column) -> Column:
        return F.max_by(F.when(test, of), F.when(test, F.col("line_no")))

    frames = fields.groupBy(*keep, "frame").agg(
        F.max("ends").alias("ended"),
        data.alias("data_lines"),
        last(name == "event", value).alias("event"),
        last((name == "id") & ~value.contains("\u0000"), value).alias("id"),
        last((name == "retry") & retry_text(value).isNotNull(), retry_text(value)).alias("retry"),
    )
    kept = frames.where(F.col("ended") & (F.size("data_lines") > 0))
    number = F.row_number().over(Window.partitionBy(*keep).orderBy("frame"))
    joined = F.array_join(F.transform("data_lines", lambda x: x["value"]), "\n")
    out = kept.select(*keep, number.alias("event_no"), joined.alias("data"), "event", "id", "retry")
    return out.withColumn("over", F.col("event_no") > max_items)
