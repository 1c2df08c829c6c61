"""Record validation and event framing over unbounded input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assay.operators.schema import violations


def read_records(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """``record`` rows of newline-delimited files as they arrive; blank records are left out."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).option("lineSep", "\n").text(folder)
    record = F.regexp_replace("value", "\r$", "").alias("record")
    return lines.select(record).where(F.trim(F.col("record"), F.lit(" \t\r\f\u000b")) != "")


def invalid_records(stream: DataFrame, schema) -> DataFrame:
    """Stateless: failed checks of each record, with a bare CR as ``contract.ndjson``."""
    bare = stream.where(F.col("record").contains("\r")).select(
        "record", F.lit("").alias("path"), F.lit("contract.ndjson").alias("keyword")
    )
    clean = stream.where(~F.col("record").contains("\r"))
    return bare.unionByName(violations(clean, "record", schema, ["record"]))


def _frames(text: str) -> tuple[list[dict], str]:
    """Events that are complete in ``text``, and what is left of it."""
    out, fields, data, rest, i = [], {}, [], 0, 0
    while i < len(text):
        ends = [p for p in (text.find("\n", i), text.find("\r", i)) if p >= 0]
        if not ends:
            break
        end = min(ends)
        if text[end] == "\r" and end + 1 == len(text):
            break  # an LF may follow in the next chunk
        line, i = text[i:end], end + (2 if text[end : end + 2] == "\r\n" else 1)
        if line == "":
            if data:
                out.append({"data": "\n".join(data), "event": fields.get("event"), "id": fields.get("id"), "retry": fields.get("retry")})
            fields, data, rest = {}, [], i
            continue
        if line.startswith(":"):
            continue
        name, _, value = line.partition(":")
        value = value.removeprefix(" ")
        if name == "data":
            data.append(value)
        elif name == "event" or name == "id" and "\0" not in value:
            fields[name] = value
        elif name == "retry" and value and value.isascii() and value.isdigit():
            fields[name] = value.lstrip("0") or "0"
    return out, text[rest:]


def framed_events(chunks: DataFrame) -> DataFrame:
    """``stream, event_no, data, event, id, retry`` from a stream of ``stream, seq, chunk`` rows.

    The state of a stream is the part of its text that no blank line has ended
    yet, and the number of events so far. Chunks of one trigger are taken in
    the order of ``seq``; a chunk may end anywhere.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, number, begun = state.get if state.exists else ("", 0, False)
        rows = pd.concat(list(batches)).sort_values("seq")
        text = "".join(rows["chunk"])
        if not begun and text:
            text, begun = text.removeprefix("\ufeff"), True
        found, rest = _frames(rest + text)
        out = pd.DataFrame(found, columns=["data", "event", "id", "retry"])
        out.insert(0, "event_no", range(number + 1, number + 1 + len(out)))
        out.insert(0, "stream", key[0])
        state.update((rest, number + len(found), begun))
        yield out

    return chunks.groupBy("stream").applyInPandasWithState(
        step,
        "stream string, event_no long, data string, event string, id string, retry string",
        "rest string, number long, begun boolean",
        "append",
        GroupStateTimeout.NoTimeout,
    )
