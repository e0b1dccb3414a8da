"""Handing batches to a receiver, each acknowledged once.

A batch has a key, made from what it holds. As soon as the receiver has taken
it, a note with its key is written to the ledger's folder; a task that runs
again finds the notes and skips these batches. A finished run turns its notes
into rows of the ledger; after an unfinished one the next run does so. Batches
whose key is in the ledger are never sent again.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

LEDGER = T.StructType([
    T.StructField("batch_key", T.StringType()), T.StructField("users", T.IntegerType()),
    T.StructField("acknowledged_at", T.TimestampType())])

Send = Callable[[str, list[dict]], None]


class _Folder:
    """The ledger's folder: ``taken/`` has its rows, ``notes/`` a file per batch of an unfinished run."""

    def __init__(self, uri: str):
        # Hadoop writes local folders as file:/x; Arrow reads file:///x.
        self.system, path = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
        self.taken, self.notes, self.waiting = (f"{path}/{name}" for name in ("taken", "notes", "waiting"))

    def make(self) -> None:
        for path in (self.taken, self.notes, self.waiting):
            self.system.create_dir(path, recursive=True)

    def noted(self, key: str) -> bool:
        return self.system.get_file_info(f"{self.notes}/{key}").type == fs.FileType.File

    def note(self, key: str, users: int) -> None:
        with self.system.open_output_stream(f"{self.notes}/{key}") as out:
            out.write(f"{key} {users} {dt.datetime.now(dt.timezone.utc).isoformat()}".encode())

    def leftover(self) -> bool:
        return bool(self.system.get_file_info(fs.FileSelector(self.notes)))

    def clear(self) -> None:
        for path in (self.notes, self.waiting):
            self.system.delete_dir_contents(path)


@dataclass
class _Rows(WriterCommitMessage):
    """The file with a task's rows of the ledger."""
    name: str | None


class _Writer(DataSourceWriter):
    def __init__(self, ledger: str, send: Send):
        self.ledger, self.send = ledger, send

    def write(self, iterator: Iterator[Row]) -> _Rows:
        folder, keys, users = _Folder(self.ledger), [], []
        for row in iterator:
            payload = [user.asDict() for user in row["batch_request_payload"]]
            if not folder.noted(row["batch_key"]):
                self.send(row["batch_key"], payload)
                folder.note(row["batch_key"], len(payload))
            keys.append(row["batch_key"])
            users.append(len(payload))
        if not keys:
            return _Rows(None)
        name = f"{uuid.uuid4().hex}.parquet"
        now = pa.array([dt.datetime.now(dt.timezone.utc)] * len(keys), pa.timestamp("us", "UTC"))
        with folder.system.open_output_stream(f"{folder.waiting}/{name}") as out:
            pq.write_table(pa.table({"batch_key": keys, "users": pa.array(users, pa.int32()),
                                     "acknowledged_at": now}), out)
        return _Rows(name)

    def commit(self, messages: list[_Rows | None]) -> None:
        folder = _Folder(self.ledger)
        for message in messages:
            if message is not None and message.name:
                folder.system.move(f"{folder.waiting}/{message.name}", f"{folder.taken}/{message.name}")
        folder.clear()

    def abort(self, messages: list[_Rows | None]) -> None:
        """Notes stay: they say what the receiver has."""


def acknowledged(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger: batch_key, users, acknowledged_at of every batch that was taken."""
    return spark.read.schema(LEDGER).parquet(f"{ledger}/taken").dropDuplicates(["batch_key"])


def _settle(spark: SparkSession, ledger: str) -> None:
    """Turn what an unfinished run has noted into rows of the ledger."""
    folder = _Folder(ledger)
    if not folder.leftover():
        return
    part = F.split("value", " ")
    notes = spark.read.text(f"{ledger}/notes").select(
        part[0].alias("batch_key"), part[1].cast("int").alias("users"),
        F.to_timestamp(part[2]).alias("acknowledged_at"))
    notes.write.mode("append").parquet(f"{ledger}/taken")
    folder.clear()


def with_keys(batches: DataFrame, label: str = "") -> DataFrame:
    """Add ``batch_key``: a hash of the label, the batch's number and its users in order."""
    users = F.array_sort("batch_request_payload")
    return batches.withColumn("batch_key", F.sha2(
        F.to_json(F.struct(F.lit(label).alias("label"), "batch_request_num", users.alias("users"))), 256))


def deliver(batches: DataFrame, send: Send, ledger: str, label: str = "") -> DataFrame:
    """Send every batch that the ledger lacks, on the executors; returns the ledger.

    ``send(key, users)`` is called once per batch and returns when the receiver
    has taken it. It is called again with the same key only if the task or its
    machine ends between the receiver's answer and the note: pass the key on,
    and a receiver that knows it can tell. If ``send`` raises, the run fails;
    what was taken before is noted, and the next call goes on from there.

    ``ledger`` is a folder that driver and executors share, such as one on the
    cluster's storage. ``label`` names the delivery (a date, a campaign): the
    same users under another label are another delivery. One call at a time
    per ledger, and no speculative tasks, which would run side by side.
    """
    spark = batches.sparkSession
    if spark.sparkContext.getConf().get("spark.speculation", "false") == "true":
        raise ValueError("two speculative tasks could send one batch; set spark.speculation to false")
    _Folder(ledger).make()
    _settle(spark, ledger)
    missing = with_keys(batches, label).join(acknowledged(spark, ledger).select("batch_key"), "batch_key", "left_anti")

    class Acknowledged(DataSource):
        """Write-only: hands each row's users to ``send``."""

        @classmethod
        def name(cls) -> str:
            return "acknowledged_batches"

        def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
            return _Writer(ledger, send)

    spark.dataSource.register(Acknowledged)
    missing.select("batch_key", "batch_request_payload").write.format("acknowledged_batches").mode("append").save()
    return acknowledged(spark, ledger)
