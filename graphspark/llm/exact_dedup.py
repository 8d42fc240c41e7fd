"""Exact deduplication by Grace hashing, with tables that compare complete contents.

Map side: every task collapses equal texts among its own rows in a table of bounded size, which it empties whenever it is
full, so a text with any number of copies leaves a task as a few records. Records then go to tasks by a hash of the
content. There a table takes the distinct contents; if they don't fit, contents and further records are dealt out to
spill files by the next bits of the hash, file by file again, until each fits.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.llm.words import NOT_SPACE, raw, slices

SPACE = r"[\x20\x09-\x0D]+"
FAN_BITS = 4


class ContentTable:
    """Open addressing with linear probing; equal hashes are told apart by the complete content."""

    def __init__(self):
        self.slots, self.mask = np.full(1024, -1, dtype=np.int64).tolist(), 1023
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.least: list[int | None] = []
        self.copies: list[int] = []
        self.held = 0

    def add(self, hash_: int, content: bytes, least: int | None, copies: int) -> None:
        at = hash_ & self.mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == hash_ and self.contents[e] == content:
                self.copies[e] += copies
                if least is not None and (self.least[e] is None or least < self.least[e]):
                    self.least[e] = least
                return
            at = (at + 1) & self.mask
        self.slots[at] = len(self.hashes)
        for column, value in ((self.hashes, hash_), (self.contents, content), (self.least, least), (self.copies, copies)):
            column.append(value)
        self.held += len(content) + 200
        if 3 * len(self.hashes) > 2 * self.mask:
            self._grow()

    def _grow(self) -> None:
        self.mask = 4 * self.mask + 3
        self.slots = [-1] * (self.mask + 1)
        for e, hash_ in enumerate(self.hashes):
            at = hash_ & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = e

    def records(self) -> Iterator[tuple[int, bytes, int | None, int]]:
        return zip(self.hashes, self.contents, self.least, self.copies, strict=True)


def _read(path: str) -> Iterator[tuple[int, bytes, int | None, int]]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def grace(records: Iterable[tuple[int, bytes, int | None, int]], most: int, folder: str, level: int = 0) -> Iterator[ContentTable]:
    """Tables that hold about ``most`` bytes each and, taken together, every distinct content once."""
    table, records = ContentTable(), iter(records)
    for record in records:
        table.add(*record)
        if table.held > most and len(table.hashes) > 1 and level * FAN_BITS < 48:
            break
    else:
        yield table
        return
    paths = [os.path.join(folder, f"{level}-{k}") for k in range(1 << FAN_BITS)]
    files = [open(p, "wb") for p in paths]  # noqa: SIM115
    try:
        shift = 60 - FAN_BITS * level  # the upper bits: the lower ones place contents in tables and rows in tasks
        for source in (table.records(), records):
            for record in source:
                pickle.dump(record, files[(record[0] >> shift) & ((1 << FAN_BITS) - 1)], protocol=5)
    finally:
        for f in files:
            f.close()
    del table
    for k, path in enumerate(paths):
        inner = os.path.join(folder, f"{level}.{k}")
        os.mkdir(inner)
        yield from grace(_read(path), most, inner, level + 1)
        os.remove(path)


def collapse_space(texts: pa.Array) -> list[bytes]:
    """The UTF-8 texts with every run of white space replaced by one space; null gives an empty text."""
    data, offsets = raw(texts)
    if not len(data):
        return [b""] * (len(offsets) - 1)
    space = ~NOT_SPACE[data]
    again = np.append(False, space[:-1])
    firsts = offsets[:-1]
    again[firsts[firsts < len(data)]] = False
    kept = ~(space & again)
    ends = np.append(0, np.cumsum(kept))[offsets]
    body = np.where(space, np.uint8(0x20), data)[kept].tobytes()
    return [body[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _hash(content: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(content)


def scratch_folder() -> str:
    """A new folder for the spill files of one task, where the executor keeps its own shuffle and spill files.

    No other task reads it; if the executor is lost, the task starts anew elsewhere.
    """
    return tempfile.mkdtemp(prefix="grace-", dir=os.environ["SPARK_LOCAL_DIRS"].split(",")[0])


def content_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", table_bytes: int = 48 << 20, contents: bool = True) -> DataFrame:
    """One row for each distinct normalised text: ``sha256`` (binary), ``content``, ``keep`` (least key) and ``copies``.

    Without ``contents`` the column is null; contents are compared all the same.
    """

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(table: ContentTable) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.array(table.hashes, dtype=np.uint64).view(np.int64)), pa.array(table.contents, pa.binary()), pa.array(table.least, pa.int64()), pa.array(table.copies, pa.int64())], ["hash", "content", "least", "copies"])

        table = ContentTable()
        for batch in batches:
            for part in slices(batch, text):
                for content, least in zip(collapse_space(part.column(1)), part.column(0).to_pylist(), strict=True):
                    table.add(_hash(content), content, least, 1)
                if table.held > table_bytes // 2:
                    yield out(table)
                    table = ContentTable()
        yield out(table)

    def final(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple[int, bytes, int | None, int]]:
            for batch in batches:
                for start in range(0, batch.num_rows, 1000):
                    part = batch.slice(start, 1000)
                    yield from zip(part.column(0).to_numpy().view(np.uint64).tolist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)

        folder = scratch_folder()
        try:
            for table in grace(records(), table_bytes, folder):
                for start in range(0, len(table.contents), 2000):
                    part = slice(start, start + 2000)
                    digests = [hashlib.sha256(c).digest() for c in table.contents[part]]
                    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(table.contents[part] if contents else [None] * len(digests), pa.binary()), pa.array(table.least[part], pa.int64()), pa.array(table.copies[part], pa.int64())], ["sha256", "content", "keep", "copies"])
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    records = docs.select(F.col(key).cast("long"), text).mapInArrow(local, "hash long, content binary, least long, copies long")
    return records.repartition("hash").mapInArrow(final, "sha256 binary, content binary, keep long, copies long")


def decide(docs: DataFrame, *, key: str = "doc_id", text: str = "text", table_bytes: int = 48 << 20) -> DataFrame:
    """One row for each row of ``docs``: the key, ``keep_id group_size kept text_sha256``.

    Texts are equal if they are after each run of white space became one space; null counts as empty. The row with the
    least key, an integer, stays; a null key stays only where no other key has the text. Of rows repeated with the same key one stays.
    An empty table gives an empty table.
    """
    groups = content_groups(docs, key=key, text=text, table_bytes=table_bytes, contents=False).where("copies > 1").select("sha256", "keep", "copies")
    normal = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.unhex(F.sha2(normal.cast("binary"), 256)).alias("sha256")).groupBy("key", "sha256").agg(F.count(F.lit(1)).alias("n"))
    joined = rows.join(groups, "sha256", "left").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    single = F.col("copies").isNull()
    keep = F.when(single, F.col("key")).otherwise(F.col("keep"))
    return joined.select(
        F.col("key").alias(key), keep.alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        (F.col("key").eqNullSafe(keep) & (F.col("nth") == 1)).alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"),
    )
