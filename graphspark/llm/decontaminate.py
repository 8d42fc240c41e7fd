"""Benchmark decontamination as a prefix-filtered set join of item windows against documents.

A window is a run of up to 13 words of an item. A document that contains the window contains all its words, so a prefix
of one word is enough: the one that is rarest over all documents. Documents send each occurrence of a prefix word with
the words around it, windows wait at their prefix word, and a join by that word brings both together. There the length
bound (the document has room for the window) and the positional bound (enough words before and after the occurrence)
leave few pairs, and these are compared word by word.

Windows, vocabulary and counts stay tables, whatever the size of the benchmark; the only thing every task gets is a
bitmap of fixed size that tells most words that are no prefix. Equal texts are known by their digest and searched once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.llm.near_dedup import digest
from graphspark.llm.storage import materialise, whole_row
from graphspark.llm.words import ALNUM, hashes, slices, tokenise, trim

WINDOW = 13
#: Bits of the bitmap of words, as a power of two: 512 KB, which the driver gathers in at most 65,536 rows.
FILTER_BITS = 22
#: Words, as runs of bytes that are no ASCII separators; upper and lower case are counted alike.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Occurrences in a batch on their way to the join.
PLACES = 20_000


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """``(window, n, item)`` of ``(item, text)`` rows: the words of each window, joined by spaces, and their number."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, counts = tokenise(part.column(1), ALNUM, lower=True)
                words, at = tokens.to_pylist(), 0
                for item, n in zip(part.column(0).to_pylist(), counts.tolist(), strict=True):
                    own, at = words[at : at + n], at + n
                    found = sorted({" ".join(own[k : k + size]) for k in range(max(1, n - size + 1))}) if n else []
                    yield pa.RecordBatch.from_pydict({"window": pa.array(found, pa.string()), "n": pa.array([min(n, size)] * len(found), pa.int32()), "item": pa.array([item] * len(found), pa.string())})

    return items.mapInArrow(cut, "window string, n int, item string").distinct()


class WordFilter:
    """A bitmap of word hashes: no for most words that are not in the table it comes from, yes for all that are."""

    def __init__(self, words: DataFrame):
        bits = FILTER_BITS

        def slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = hashes(batch.column(0)) & np.uint64((1 << bits) - 1)
                yield pa.RecordBatch.from_pydict({"slot": pa.array((place >> np.uint64(6)).astype(np.int64)), "bits": pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))})

        self.table = np.zeros(1 << bits - 6, dtype=np.int64)
        for r in words.mapInArrow(slots, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).collect():
            self.table[r.slot] = r.bits

    def passes(self, words: pa.Array) -> np.ndarray:
        place = hashes(words) & np.uint64(64 * len(self.table) - 1)
        return (self.table.view(np.uint64)[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def word_counts(docs: DataFrame, wanted: WordFilter) -> DataFrame:
    """``(word, n)`` over ``(text)`` rows for the words that the filter lets pass, summed in each task first."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        out = lambda: pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})
        for batch in batches:
            for part in slices(batch, "text"):
                coded = tokenise(part.column(0), ALNUM, lower=True)[0].dictionary_encode()
                if not len(coded):
                    continue
                n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
                mine = np.flatnonzero(shared.value.passes(coded.dictionary))
                for word, k in zip(coded.dictionary.take(pa.array(mine)).to_pylist(), n[mine].tolist(), strict=True):
                    total[word] = total.get(word, 0) + k
                if len(total) > 500_000:
                    yield out()
                    total = {}
        yield out()
        trim()

    return docs.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def prefix_index(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """``(word, offset, n, words, window)``: every distinct window under the first place of its rarest word."""
    words = windows.select("window", "n").distinct().select("window", "n", F.posexplode(F.split("window", " ")).alias("offset", "word"))
    counts = word_counts(docs, WordFilter(words.select("word").distinct()))
    ranked = words.join(counts.withColumnRenamed("n", "occurs"), "word", "left")
    rarest = ranked.groupBy("window", "n").agg(F.min(F.struct(F.coalesce("occurs", F.lit(0)).alias("occurs"), "word", "offset")).alias("x"))
    return rarest.select("x.word", "x.offset", "n", F.split("window", " ").alias("words"), "window")


def occurrences(docs: DataFrame, wanted: WordFilter, size: int) -> DataFrame:
    """``(word, digest, place, around, middle)``: words that the filter lets pass, with the words around each.

    ``around`` reaches ``size - 1`` words to both sides within the text; ``around[middle]``, from 0, is the word itself.
    """
    shared, most = docs.sparkSession.sparkContext.broadcast(wanted), PLACES

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, counts = tokenise(part.column(0), ALNUM, lower=True)
                coded = tokens.dictionary_encode()
                if not len(coded):
                    continue
                places = np.flatnonzero(shared.value.passes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)])
                ends = np.cumsum(counts)
                text = np.searchsorted(ends, places, side="right")
                held = {}
                for t in np.unique(text).tolist():
                    mark = hashlib.sha256((part.column(0)[t].as_py() or "").encode()).digest()[:16]
                    if mark not in seen:
                        seen.add(mark)
                        held[t] = mark
                if len(seen) > 1_000_000:
                    seen.clear()
                new = np.isin(text, list(held))
                places, text = places[new], text[new]
                for start in range(0, len(places), most):
                    p, t = places[start : start + most], text[start : start + most]
                    low, high = np.maximum(p - size + 1, ends[t] - counts[t]), np.minimum(p + size, ends[t])
                    offsets = np.append(0, np.cumsum(high - low))
                    index = np.arange(offsets[-1]) + np.repeat(low - offsets[:-1], high - low)
                    around = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens.take(pa.array(index)).cast(pa.string()))
                    yield pa.RecordBatch.from_arrays([tokens.take(pa.array(p)).cast(pa.string()), pa.array([held[k] for k in t.tolist()], pa.binary()), pa.array(p - (ends[t] - counts[t])), around, pa.array((p - low).astype(np.int32))], ["word", "digest", "place", "around", "middle"])
        trim()

    return docs.mapInArrow(run, "word string, digest binary, place long, around array<string>, middle int")


def occurring_windows(texts: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """``(digest, start, n, window)``: where which windows occur in the texts; ``start`` counts words from 0."""
    index = materialise(prefix_index(windows, texts), "decontaminate-index")
    places = occurrences(texts, WordFilter(index.select("word").distinct()), size)
    fits = (F.col("middle") >= F.col("offset")) & (F.size("around") - F.col("middle") >= F.col("n") - F.col("offset"))
    same = F.expr("CASE WHEN middle >= offset THEN slice(around, middle - offset + 1, n) = words ELSE false END")
    found = places.join(index, "word").where(fits & same).select("digest", (F.col("place") - F.col("offset")).alias("start"), "n", "window")
    return materialise(found.distinct(), "decontaminate-found")


def contamination(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, share: int = 20) -> DataFrame:
    """Adds to every row what it holds of the items: ``n_words n_hit n_items items_sha256 contaminated``.

    A row is contaminated if ``n_hit > 0 and share * n_hit >= n_words``. Null and empty texts have no words and are clean.
    Repeated rows each get their result. Items without words have no windows; repeated items count once; those without
    an id count as one item, which the digest of ids leaves out. Columns of these names are replaced; other columns stay,
    whatever their names. Empty tables of documents or items are fine.
    """
    added = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    asked = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL").distinct()
    windows = materialise(item_windows(asked, size), "decontaminate-windows")
    found = occurring_windows(docs.select(F.col(text).alias("text")), windows, size)

    hits = found.select("digest", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("at")).distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("n_hit"))
    of_text = found.select("digest", "window").distinct().join(windows.select("window", "item"), "window").select("digest", "item").distinct()
    names = of_text.groupBy("digest").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ",").cast("binary"), 256).alias("items_sha256"))
    per_text = materialise(hits.join(names, "digest"), "decontaminate-texts").withColumnRenamed("digest", "hit_digest")

    own = kept.select(whole_row(kept), digest(f"`{text}`").alias("own_digest"), F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    joined = own.join(per_text, F.col("own_digest") == F.col("hit_digest"), "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select("row.*", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", nothing).alias("items_sha256"), ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"))
