"""Streams of registrations and of document events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: States a document moves through on good events, and the attempts it has.
NEXT = {"pending": "downloading", "downloading": "downloaded", "downloaded": "processing", "processing": "ocr_done", "ocr_done": "parsing", "parsing": "parsed"}
BACK = {"downloading": "pending", "processing": "downloaded", "parsing": "ocr_done"}
MAX_ATTEMPTS = 3


def register_once(stream: DataFrame, key: str = "download_url") -> DataFrame:
    """First row of each key over the whole stream; the state holds the keys."""
    return stream.where(F.col(key).isNotNull()).dropDuplicates([key])


def pages_once(stream: DataFrame) -> DataFrame:
    """First row of each page (document_id, page_number) over the whole stream: pages read again are not stored again."""
    return stream.where("document_id is not null and page_number is not null").dropDuplicates(["document_id", "page_number"])


def parse_once(stream: DataFrame) -> DataFrame:
    """(id) of each document when it is first ready (id, ready): later pages and edits do not parse it again."""
    return stream.where("ready and id is not null").select("id").dropDuplicates(["id"])


def advance(status: str, attempts: int, event: str) -> tuple[str, int]:
    """State and attempts after an event: ok moves on, fail goes back and counts, an interruption goes back uncounted."""
    if event == "ok":
        return NEXT.get(status, status), 0 if status == "downloading" else attempts
    if status not in BACK:
        return status, attempts
    if event == "interrupted":
        return BACK[status], attempts
    return ("failed", attempts + 1) if attempts + 1 >= MAX_ATTEMPTS else (BACK[status], attempts + 1)


def status_machine(stream: DataFrame) -> DataFrame:
    """(id, status, attempts, seen) after each batch for every document with events (id, at, event), taken in order of
    at, then event, within a batch."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts, seen = state.get if state.exists else ("pending", 0, 0)
        for event in pd.concat(list(parts)).sort_values(["at", "event"])["event"]:
            status, attempts = advance(status, attempts, event)
            seen += 1
        state.update((status, attempts, seen))
        yield pd.DataFrame({"id": [key[0]], "status": [status], "attempts": [attempts], "seen": [seen]})

    return stream.groupBy("id").applyInPandasWithState(step, "id long, status string, attempts int, seen long", "status string, attempts int, seen long", "update", GroupStateTimeout.NoTimeout)


#: How long the loops of registration, recognition and parsing wait between looks.
POLL = {"register": "2 minutes", "recognise": "30 seconds", "parse": "15 seconds"}


def _write(stream: DataFrame, path: str, checkpoint: str, mode: str):
    """A writer that puts each batch into a folder of its own, so a batch that runs again replaces what it wrote."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode(mode)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and give what was written."""
    _write(stream, path, checkpoint, mode).trigger(availableNow=True).start().awaitTermination()
    # folders that begin with an underscore are read only as partitions
    return stream.sparkSession.read.option("basePath", path).schema(stream.schema).parquet(f"{path}/_batch=*")


def poll(stream: DataFrame, path: str, checkpoint: str, loop: str, mode: str = "append"):
    """Keep a stream running at the pace of a loop of POLL; stop() of what it gives ends it after the batch at hand."""
    return _write(stream, path, checkpoint, mode).trigger(processingTime=POLL[loop]).start()
