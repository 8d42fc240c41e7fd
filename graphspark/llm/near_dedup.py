"""Near-duplicate classes by ProbMinHash signatures over word shingles, banding and exact verification.

A document is its runs of five words with weights. Shingle ``s`` of weight ``w`` sends arrivals of a Poisson process of
rate ``w``, each to a random register; a register keeps the shingle that arrived first. Two documents agree in a register
with the probability Jaccard similarity of their weights. Arrivals of a shingle end as soon as they come later than the
latest register of the document, so long documents cost about one arrival a shingle.

Two weightings are signed: ``set`` (every shingle weighs one; the similarity is then the Jaccard similarity of sets) and
``count`` (a shingle weighs as often as it occurs). They differ only in texts that repeat a shingle, so only these get a
second signature. A pair is linked if its exact similarity under one of the weightings asked for is high enough; what
finds candidates, what drops them early and what verifies them are the same similarity.

Registers in bands give buckets; in a bucket every document is compared with one leader. What is alike by signature and
still in different components after that is compared text by text: the rows of the largest component of a group meet the
others' rows, never each other, in blocks of bounded rows and bytes. No link that banding finds is lost, and only links
that join components come out, never all pairs of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspark.llm.components import connected_components, merged_components
from graphspark.llm.storage import first_of, materialise, whole_row
from graphspark.llm.words import NOT_SPACE, slices, tokenise, trim

WORDS, SIMILARITY = 5, 0.8
WEIGHTINGS = ("set", "count")
BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
#: What is in memory at a time; signatures of many short texts need more than the texts.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 1000
#: Rows of a block of signatures, rows and shingles of a block of texts, that are compared with those of another.
SKETCH_ROWS, BLOCK_ROWS, BLOCK_SHINGLES = 2048, 512, 1 << 20
#: Signatures that agree in fewer registers are not verified: six standard deviations under the similarity asked for.
SKETCH_MARGIN = 6 * (0.16 / REGISTERS) ** 0.5
_ODD = (np.random.default_rng(7).integers(1 << 62, size=64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts: the text they are in, a 64-bit hash and how often they occur there.

    Words are what white space ends, with A-Z in lower case. A text of fewer words, but not none, is one shingle.
    """
    import xxhash

    tokens, counts = tokenise(texts, NOT_SPACE, lower=True)
    if not len(tokens):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    coded = tokens.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))[coded.indices.to_numpy(zero_copy_only=False)]
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    left = ends[text] - np.arange(len(tokens))  # words from here to the end of the text
    value = hashes * _ODD[0]
    for k in range(1, min(words, len(value))):
        value[: len(value) - k] += np.where(left[: len(value) - k] > k, hashes[k:] * _ODD[k], np.uint64(0))
    starts = (left >= words) | ((counts[text] < words) & (left == counts[text]))
    text, value = text[starts], mix(value[starts])
    own = mix(value + text.astype(np.uint64) * _ODD[9])
    order = np.argsort(own)
    own = own[order]
    first = np.append(True, own[1:] != own[:-1])
    at = np.flatnonzero(first)
    return text[order][first], value[order][first], np.diff(np.append(at, len(own)))


def signatures(n_texts: int, text: np.ndarray, value: np.ndarray, weight: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """For every text the shingle that came first in each register."""
    first = np.full(n_texts * registers, np.inf)
    holder = np.zeros(n_texts * registers, dtype=np.uint64)
    latest = np.full(n_texts, np.inf)
    rate = weight.astype(np.float64)
    state, time = value, np.zeros(len(value))
    while len(state):
        state = state + np.uint64(0x9E3779B97F4A7C15)
        draw = mix(state)
        time = time - np.log(((draw >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / rate
        alive = time < latest[text]
        if not alive.all():
            state, draw, time, rate, text, value = (x[alive] for x in (state, draw, time, rate, text, value))
        where = text * registers + ((draw & np.uint64(0xFFFFFF)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, where, time)
        won = first[where] == time
        holder[where[won]] = value[won]
        touched = np.unique(text[won])
        latest[touched] = first.reshape(n_texts, registers)[touched].max(axis=1)
    return holder.reshape(n_texts, registers)


def band_keys(holder: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = holder[:, : bands * rows].reshape(len(holder), bands, rows)
    value = np.zeros(parts.shape[:2], dtype=np.uint64)
    for k in range(rows):
        value = mix(value * _ODD[20] + parts[:, :, k] * _ODD[21 + k])
    return mix(value + np.arange(bands, dtype=np.uint64) * _ODD[40]).view(np.int64)


def jaccard(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Exact Jaccard similarity of the shingle sets of the texts in a row of ``a`` and ``b``."""
    return similarities(shingles(a), shingles(b), len(a), ("set",))


def similarities(left: tuple, right: tuple, pairs: int, weightings: tuple[str, ...] = WEIGHTINGS) -> np.ndarray:
    """The exact similarity of pairs, the greatest of the weightings, from the shingles (pair, hash, count) of both sides."""
    (ta, va, ca), (tb, vb, cb) = left, right
    keys = np.concatenate([mix(va + ta.astype(np.uint64) * _ODD[9]), mix(vb + tb.astype(np.uint64) * _ODD[9])])
    _, first, place = np.unique(keys, return_index=True, return_inverse=True)
    pair = np.concatenate([ta, tb])[first]
    x, y = np.zeros(len(first)), np.zeros(len(first))
    x[place[: len(ta)]], y[place[len(ta) :]] = ca, cb
    both = (x > 0) & (y > 0)
    total = np.bincount(pair, minlength=pairs)
    out = np.divide(np.bincount(pair[both], minlength=pairs), total, out=np.zeros(pairs), where=total > 0) if "set" in weightings else np.zeros(pairs)
    if "count" in weightings:
        # With equal weights throughout, both similarities are the same; the others are worked out shingle by shingle.
        uneven = np.zeros(pairs, dtype=bool)
        uneven[pair[(x > 1) | (y > 1)]] = True
        if "set" in weightings:
            asked = uneven[pair]
            pair, x, y = pair[asked], x[asked], y[asked]
        out = np.maximum(out, probability_jaccard(pair, x, y, pairs))
    return out


def probability_jaccard(pair: np.ndarray, x: np.ndarray, y: np.ndarray, pairs: int) -> np.ndarray:
    """For every pair the sum over common elements i of 1 / sum over all j of max(x[j] / x[i], y[j] / y[i]).

    Sorted by x / y, the maximum is the first quotient for all j up to i and the second for those behind it.
    """
    with np.errstate(divide="ignore"):
        order = np.lexsort((-(x / y), pair))
    pair, x, y = pair[order], x[order], y[order]
    if not len(pair):
        return np.zeros(pairs)
    size = np.bincount(pair, minlength=pairs)
    ends = np.cumsum(size)
    sum_x, sum_y = np.append(0, np.cumsum(x)), np.append(0, np.cumsum(y))
    before = sum_x[1:] - sum_x[(ends - size)[pair]]
    behind = sum_y[ends[pair]] - sum_y[1:]
    common = (x > 0) & (y > 0)
    return np.bincount(pair[common], weights=1 / (before[common] / x[common] + behind[common] / y[common]), minlength=pairs)


def _signed(docs: DataFrame, key: str, text: str, weightings: tuple[str, ...]) -> DataFrame:
    """A row for each row: key, digest of the text, and where the digest is new to the task size, signatures and buckets.

    A text in which no shingle recurs has the same signature under every weighting and carries it once.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES, SLICE_ROWS):
                texts = part.column(1)
                digests = [hashlib.sha256((t or "").encode()).digest()[:16] for t in texts.to_pylist()]
                new = np.zeros(len(digests), dtype=bool)
                for k, d in enumerate(digests):
                    if d not in seen:
                        new[k] = True
                        seen.add(d)
                if len(seen) > 1_000_000:
                    seen.clear()
                of, value, count = shingles(texts.filter(pa.array(new)))
                at, n = np.flatnonzero(new), np.bincount(of, minlength=int(new.sum()))
                buckets: list = [None] * len(digests)
                sketch: list = [None] * len(digests)
                holder = signatures(len(at), of, value, np.ones(len(value)) if weightings[0] == "set" else count)
                short, keys = (holder & np.uint64(0xFFFF)).astype(np.uint16), band_keys(holder)
                for row, j, ok in zip(at.tolist(), range(len(at)), (n > 0).tolist(), strict=True):
                    if ok:
                        buckets[row], sketch[row] = keys[j], short[j].tobytes()
                uneven = np.unique(of[count > 1]) if len(weightings) > 1 else ()
                if len(uneven):
                    mine = np.isin(of, uneven)
                    holder = signatures(len(uneven), np.searchsorted(uneven, of[mine]), value[mine], count[mine])
                    short, keys = (holder & np.uint64(0xFFFF)).astype(np.uint16), band_keys(holder)
                    for row, j in zip(at[uneven].tolist(), range(len(uneven)), strict=True):
                        buckets[row], sketch[row] = np.union1d(buckets[row], keys[j]), sketch[row] + short[j].tobytes()
                size = np.zeros(len(digests), dtype=np.int64)
                size[at] = n
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(size), pa.array(sketch, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], ["key", "digest", "size", "sketch", "buckets"])
        trim()

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, digest binary, size long, sketch binary, buckets array<long>")


def _sketches(values: list[bytes], weightings: tuple[str, ...]) -> np.ndarray:
    """Signatures as (row, weighting, register)."""
    width = 2 * REGISTERS * len(weightings)
    return np.frombuffer(b"".join(v if len(v) == width else v * len(weightings) for v in values), dtype=np.uint16).reshape(len(values), len(weightings), REGISTERS)


def _may_link(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, similarity: float, weightings: tuple[str, ...]) -> np.ndarray:
    """Whether signatures, and for sets their sizes, allow the similarity under one of the weightings."""
    near = (a == b).mean(axis=-1) >= similarity - SKETCH_MARGIN
    if weightings[0] == "set":
        near[..., 0] &= np.minimum(size_a, size_b) >= similarity * np.maximum(size_a, size_b) - 1e-9
    return near.any(axis=-1)


def _alike(pairs: DataFrame, nodes: DataFrame, similarity: float, weightings: tuple[str, ...]) -> DataFrame:
    """Pairs ``(a, b)`` whose signatures allow the similarity."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (_sketches(batch.column(k).to_pylist(), weightings) for k in (4, 5))
            near = _may_link(left, right, batch.column(2).to_numpy(), batch.column(3).to_numpy(), similarity, weightings)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near))

    one = lambda k: nodes.select(F.col("node").alias(k), F.col("size").alias(f"size_{k}"), F.col("sketch").alias(f"sketch_{k}"))
    joined = pairs.join(one("a"), "a").join(one("b"), "b")
    return joined.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """The text of each wanted node, once."""
    asked = wanted.join(nodes.select("node", "digest", "least"), "node")
    own = docs.select(F.col(key).cast("long").alias("least"), F.col(text).alias("text")).withColumn("digest", digest("text"))
    found = own.join(asked, (own["digest"] == asked["digest"]) & own["least"].eqNullSafe(asked["least"])).select("node", "text")
    return materialise(found.groupBy("node").agg(F.first("text").alias("text")), "near-texts")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, similarity: float, weightings: tuple[str, ...]) -> DataFrame:
    """The pairs whose texts have the similarity, from the texts themselves."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a", SLICE_BYTES, SLICE_ROWS):
                near = similarities(shingles(part.column(2)), shingles(part.column(3)), part.num_rows, weightings) >= similarity - 1e-12
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(near))

    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, docs, key, text)
    one = lambda k: texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}"))
    return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def digest(text: str) -> Column:
    """The first 16 bytes of the SHA-256 of the text; null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256), 1, 32))


def _dealt(rows: DataFrame, group: str, block_rows: int, block_shingles: int) -> DataFrame:
    """Rows ``(group, node, component, size)`` for ``groupBy(group, "i", "j")``, marked ``left`` or not.

    In a group of several components the rows outside the largest one (left) meet all rows; rows of the largest one never
    meet each other. Both sides come in blocks of about ``block_rows`` rows and ``block_shingles`` shingles, so a row is
    repeated once for each block of the other side: a large class with a few strangers moves once.
    """
    parts = rows.groupBy(group, "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"))
    order = F.struct("n", -F.col("component"))
    whole = parts.groupBy(group).agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.max_by("component", order).alias("major"), F.max_by("n", order).alias("n_major"), F.max_by("weight", order).alias("w_major")).where("parts > 1")
    blocks = lambda n, weight: F.greatest(F.ceil(n / block_rows), F.ceil(weight / block_shingles)).cast("int")
    sized = whole.select(group, "major", blocks(F.col("n") - F.col("n_major"), F.col("weight") - F.col("w_major")).alias("lefts"), blocks(F.col("n"), F.col("weight")).alias("rights"))
    placed = rows.join(sized, group)
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = placed.withColumn("j", mine("rights")).withColumn("i", every("lefts")).withColumn("left", F.lit(False))
    left = placed.where("component <> major").withColumn("i", mine("lefts")).withColumn("j", every("rights")).withColumn("left", F.lit(True))
    names = [group, "i", "j", "left", "node", "component"]
    return right.select(*names).union(left.select(*names))


class Forest:
    """Joins rows of a group into trees; only the links that join two of them are kept."""

    def __init__(self, node: np.ndarray, label: np.ndarray):
        self.node, self.label, self.links = node, label.copy(), []

    def join(self, row: int, others: np.ndarray) -> None:
        label, first = np.unique(self.label[others], return_index=True)
        new = label != self.label[row]
        if new.any():
            self.links.extend((int(self.node[row]), int(self.node[others[k]])) for k in first[new])
            self.label[np.isin(self.label, label[new])] = self.label[row]

    def table(self) -> pa.Table:
        return pa.table({"a": pa.array([min(x) for x in self.links], pa.int64()), "b": pa.array([max(x) for x in self.links], pa.int64())})


def _suspected(members: DataFrame, nodes: DataFrame, component: DataFrame, similarity: float, weightings: tuple[str, ...], block: int = SKETCH_ROWS) -> DataFrame:
    """Links that make trees of what signatures find alike in each bucket, across the clusters so far.

    All pairs of a bucket count, but comparing goes over signatures in memory, passes over what a tree already holds,
    and leaves at most one link for each document of a bucket.
    """
    placed = members.join(component, "node", "left").withColumn("component", F.coalesce("component", "node")).select("bucket", "node", "component", F.lit(0).alias("size"))
    rows = _dealt(materialise(placed, "near-placed"), "bucket", block, BLOCK_SHINGLES).join(nodes.select("node", "size", "sketch"), "node")

    def run(_: tuple, table: pa.Table) -> pa.Table:
        left, node, comp, size = (table.column(c).to_numpy() for c in ("left", "node", "component", "size"))
        sketch = _sketches(table.column("sketch").to_pylist(), weightings)
        forest, cols = Forest(node, comp), np.flatnonzero(~left)
        for r in np.flatnonzero(left).tolist():
            fit = cols[forest.label[cols] != forest.label[r]]
            if len(fit):
                forest.join(r, fit[_may_link(sketch[fit], sketch[r], size[fit], size[r], similarity, weightings)])
        return forest.table()

    return rows.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _proved(cluster: DataFrame, nodes: DataFrame, component: DataFrame, docs: DataFrame, key: str, text: str, similarity: float, weightings: tuple[str, ...], block: int = BLOCK_ROWS, shingles_each: int = BLOCK_SHINGLES) -> DataFrame:
    """Exact links between the components inside each cluster of suspicion, from their texts; trees of links come out."""
    rows = cluster.withColumnRenamed("component", "cluster").join(component, "node", "left").withColumn("component", F.coalesce("component", "node")).join(nodes.select("node", "size"), "node")
    dealt = materialise(_dealt(materialise(rows, "near-rows"), "cluster", block, shingles_each), "near-clusters")
    texts = _texts(dealt.select("node").distinct(), nodes, docs, key, text)

    def run(_: tuple, table: pa.Table) -> pa.Table:
        left, node, comp = (table.column(c).to_numpy() for c in ("left", "node", "component"))
        of, value, count = shingles(table.column("text").combine_chunks())
        sketch = _sketches(table.column("sketch").to_pylist(), weightings)
        size = np.bincount(of, minlength=len(node))
        uneven = np.bincount(of[count > 1], minlength=len(node)) > 0
        order = np.argsort(of, kind="stable")
        starts = np.cumsum(size) - size
        one = lambda row: order[starts[row] : starts[row] + size[row]]
        forest, cols = Forest(node, comp), np.flatnonzero(~left & (size > 0))
        lefts = np.flatnonzero(left & (size > 0))
        for start in range(0, len(lefts), 256):
            rows = lefts[start : start + 256]
            near = np.zeros((len(rows), len(cols)), dtype=bool)
            if "set" in weightings:
                common = common_shingles(of, value, rows, cols)
                near = common >= similarity * (size[rows][:, None] + size[cols] - common) - 1e-9
            for r, hits in zip(rows.tolist(), near, strict=True):
                forest.join(r, cols[hits])
                # Weighted by counts, text by text: only where counts differ from one, and never inside a component.
                open_ = cols[(forest.label[cols] != forest.label[r]) & (uneven[cols] | uneven[r])] if "count" in weightings else cols[:0]
                for c in open_[(sketch[open_, -1] == sketch[r, -1]).mean(axis=1) >= similarity - SKETCH_MARGIN].tolist():
                    if forest.label[c] != forest.label[r]:
                        a, b = ((np.zeros(len(x), np.int64), value[x], count[x]) for x in (one(r), one(c)))
                        if similarities(a, b, 1, ("count",))[0] >= similarity - 1e-9:
                            forest.join(r, np.array([c]))
        return forest.table()

    ready = dealt.join(texts, "node").join(nodes.select("node", "sketch"), "node").select("cluster", "i", "j", "left", "node", "component", "text", "sketch")
    return ready.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long").distinct()


def common_shingles(of: np.ndarray, value: np.ndarray, rows: np.ndarray, cols: np.ndarray, width: int = 4096) -> np.ndarray:
    """How many shingles each text of ``rows`` has in common with each of ``cols``."""
    out = np.zeros((len(rows), len(cols)), dtype=np.float32)
    place = [np.full(int(of.max(initial=0)) + 1, -1), np.full(int(of.max(initial=0)) + 1, -1)]
    for p, texts in zip(place, (rows, cols), strict=True):
        inside = texts[texts < len(p)]
        p[inside] = np.arange(len(texts))[texts < len(p)]
    left, right = place[0][of] >= 0, place[1][of] >= 0
    both = np.intersect1d(value[left], value[right])
    for start in range(0, len(both), width):
        part = both[start : start + width]
        sides = []
        for p, which, n in ((place[0], left, len(rows)), (place[1], right, len(cols))):
            at = np.searchsorted(part, value[which])
            hit = part[np.minimum(at, len(part) - 1)] == value[which]
            side = np.zeros((n, len(part)), dtype=np.float32)
            side[p[of[which][hit]], at[hit]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, weightings: tuple[str, ...] = WEIGHTINGS) -> DataFrame:
    """One row for each row of ``docs``: the key, ``digest``, ``nth``, ``class_id``, ``class_size`` and ``kept``.

    A class holds the documents that links of at least ``similarity`` connect: the exact probability Jaccard similarity of
    their shingles of five words, the greatest of the ``weightings`` (``set``, ``count`` or both, in this order). Equal
    texts are one node from the start, whatever their number; texts without words are alike only if equal. ``class_id``
    is the least key of the class (null keys count only where there is no other; a class of null keys alone has a
    negative id), ``class_size`` its number of rows. ``kept`` marks the row with the least key, of several such the one
    with the least digest; rows repeated with key and text are told apart by ``nth``, from 1, and the first counts. Keys
    are integers. Null texts count as empty. An empty table gives no rows.
    """
    if tuple(weightings) not in (("set",), ("count",), WEIGHTINGS):
        raise ValueError(f"weightings are {WEIGHTINGS} or one of them")
    signed = _signed(docs, key, text, weightings)
    nodes = signed.groupBy("digest").agg(F.min("key").alias("least"), F.max("size").alias("size"), F.first("sketch", True).alias("sketch"), F.first("buckets", True).alias("buckets"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")

    spread = nodes.where("buckets IS NOT NULL").select("node", F.explode("buckets").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").select("bucket", "leader")
    members = materialise(spread.join(shared, "bucket"), "near-members")
    stars = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    alike = materialise(_alike(stars, nodes, similarity, weightings), "near-pairs")
    links = materialise(_verified(alike, nodes, docs, key, text, similarity, weightings), "near-links")
    # What leaders connect by signature is compared no more by signature; verified links are among these pairs.
    cluster = connected_components(alike)
    suspects = materialise(_suspected(members, nodes, cluster, similarity, weightings), "near-suspects")
    cluster, component = materialise(merged_components(cluster, suspects), "near-cluster"), connected_components(links)
    component = merged_components(component, materialise(_proved(cluster, nodes, component, docs, key, text, similarity, weightings), "near-proved"))

    placed = nodes.select("digest", "least", "node").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = docs.select(F.col(key).cast("long").alias("key"), digest(text).alias("digest")).groupBy("key", "digest").agg(F.count(F.lit(1)).alias("copies"))
    per_node = rows.groupBy("digest").agg(F.sum("copies").alias("n"))
    sized = placed.join(per_node, "digest")
    of_class = sized.groupBy("component").agg(F.min("least").alias("least_key"), F.min_by("digest", F.struct(F.col("least").isNull(), "least", "digest")).alias("kept_digest"), F.sum("n").alias("class_size"))
    of_node = sized.select("digest", "component", F.col("least").alias("own")).join(of_class, "component")
    joined = rows.join(of_node, "digest").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return joined.select(
        F.col("key").alias(key), "digest", "nth", F.coalesce("least_key", -1 - F.col("component")).alias("class_id"), "class_size",
        (F.col("key").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("kept_digest")) & (F.col("nth") == 1)).alias("kept"),
    )


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, weightings: tuple[str, ...] = WEIGHTINGS) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, with the columns of ``docs``, whatever their names.

    Of rows that agree in key and text but not in other columns, the one with the least hash of all its columns stays.
    An empty table gives an empty table.
    """
    kept = classes(docs, key=key, text=text, similarity=similarity, weightings=weightings).where("kept").select(F.col(key).alias("key"), "digest")
    own = docs.select(whole_row(docs), F.col(key).cast("long").alias("own_key"), digest(text).alias("own_digest"))
    joined = own.join(kept, own["own_key"].eqNullSafe(kept["key"]) & (own["own_digest"] == kept["digest"]))
    return first_of(joined, "own_key", "own_digest").select("row.*")
