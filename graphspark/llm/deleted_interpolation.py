"""A word bigram model by deleted interpolation, counted and applied without a copy of the model anywhere.

    P(w | v) = a(b) c(v, w) / c(v) + d(b) c(w) / N + e(b) / (V + 1),    b: the bucket of c(v)

The weights of each context-frequency bucket are learned by expectation-maximisation on the counts of a fold of the
training documents that was deleted from the estimates; then the estimates take in that fold as well.

Documents are packed into chunks. A chunk asks for the counts of its own distinct words and word pairs: every shard of
the key space gets the sorted keys with the counts that the chunk adds, sums them over all chunks and answers each chunk
in the order of its question. So no table of counts is ever broadcast or collected, and a frequent pair moves once for
each chunk, however often it occurs. Words and pairs are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspark.llm.packing import pack, unpack
from graphspark.llm.storage import materialise
from graphspark.llm.words import NOT_SPACE, per_text, slices, tokenise, trim

FOLDS, HELD_OUT, DELETED = 5, 1, 4
BUCKETS, STEPS, NEVER = 32, 8, 512
END, BEGIN = np.uint64(1), np.uint64(2)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def fold(key: str) -> Column:
    """crc32 of the key as text, modulo 5; a null key counts as empty text."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * _A + right * _B
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_CHUNK = "chunk long, deleted boolean, n_keys long, keys binary, n_ids long, ids binary, lengths array<long>, doc_keys array<long>, folds array<int>"


def chunks(docs: DataFrame, key: str, text: str, chunk_bytes: int) -> DataFrame:
    """Documents in chunks of about ``chunk_bytes`` of text: sorted word hashes, and the words as places among them."""
    import xxhash

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 40, 0
        pending: dict[bool, list] = {True: [], False: []}
        held = {True: 0, False: 0}

        def out(deleted: bool) -> pa.RecordBatch:
            nonlocal made
            words = [w for w, *_ in pending[deleted]]
            lengths = np.concatenate([n for _, n, _, _ in pending[deleted]])
            doc_keys = [k for _, _, ks, _ in pending[deleted] for k in ks]
            folds = [f for _, _, _, fs in pending[deleted] for f in fs]
            keys, ids = np.unique(np.concatenate(words), return_inverse=True)
            pending[deleted], held[deleted], made = [], 0, made + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([base + made]), pa.array([deleted]), pa.array([len(keys)]), pa.array([pack(keys, delta=True)], pa.binary()), pa.array([len(ids)]), pa.array([pack(ids.astype(np.uint32))], pa.binary()), pa.array([lengths.tolist()], pa.list_(pa.int64())), pa.array([doc_keys], pa.list_(pa.int64())), pa.array([folds], pa.list_(pa.int32()))],
                ["chunk", "deleted", "n_keys", "keys", "n_ids", "ids", "lengths", "doc_keys", "folds"],
            )

        for batch in batches:
            for whole in slices(batch, "text", 1 << 20):
                of = whole.column(1).to_numpy(zero_copy_only=False)
                for deleted in (True, False):
                    part = whole.filter(pa.array((of == DELETED) == deleted))
                    if not part.num_rows:
                        continue
                    tokens, counts = tokenise(part.column(2), NOT_SPACE, lower=True)
                    coded = tokens.dictionary_encode()
                    # 0, 1 and 2 are kept for what is no word.
                    hashes = np.fromiter((max(3, xxhash.xxh3_64_intdigest(w)) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
                    words = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(tokens) else np.zeros(0, np.uint64)
                    lengths = counts + 1
                    every = np.full(int(lengths.sum()), END)
                    place = np.ones(len(every), dtype=bool)
                    place[np.cumsum(lengths) - 1] = False
                    every[place] = words
                    pending[deleted].append((every, lengths, part.column(0).to_pylist(), part.column(1).to_pylist()))
                    held[deleted] += part.column(2).nbytes
                    if held[deleted] >= chunk_bytes:
                        yield out(deleted)
        for deleted in (True, False):
            if pending[deleted]:
                yield out(deleted)
        trim()

    return docs.select(F.col(key).cast("long").alias("key"), fold(key).alias("fold"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, _CHUNK)


class Chunk:
    """An unpacked chunk: tokens, their contexts, and the distinct words and pairs that it asks for."""

    def __init__(self, row: dict):
        self.id, self.doc_keys = row["chunk"], row["doc_keys"]
        self.keys = unpack(row["keys"], row["n_keys"], np.uint64, delta=True)
        self.ids = unpack(row["ids"], row["n_ids"], np.uint32).astype(np.int64)
        self.lengths, self.folds = np.array(row["lengths"], dtype=np.int64), np.array(row["folds"], dtype=np.int64)
        first = np.zeros(len(self.ids), dtype=bool)
        first[np.cumsum(self.lengths) - self.lengths] = True
        # The begin of a text is a word that only contexts have; it gets a place behind the others.
        self.begin = len(self.keys)
        self.context = np.where(first, self.begin, np.append(0, self.ids[:-1]))
        both = np.append(self.keys, BEGIN)
        local, pair = np.unique(self.context << 32 | self.ids, return_inverse=True)
        keys = pair_keys(both[local >> 32], both[local & 0xFFFFFFFF])
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.pair = place[pair]
        self.words = both
        self.fold_of = np.repeat(self.folds, self.lengths)

    def added(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys with the counts that the chunk adds from the folds of the estimates and from the deleted one."""
        kept, gone = (self.fold_of != HELD_OUT) & (self.fold_of != DELETED), self.fold_of == DELETED
        if order == 2:
            count = lambda which: np.bincount(self.pair[which], minlength=len(self.pair_keys))
            return self.pair_keys, count(kept), count(gone)
        docs = [int(((self.folds != HELD_OUT) & (self.folds != DELETED)).sum()), int((self.folds == DELETED).sum())]
        counts = [np.append(np.bincount(self.ids[which], minlength=self.begin), n) for which, n in zip((kept, gone), docs, strict=True)]
        sort = np.argsort(self.words)
        return self.words[sort], counts[0][sort], counts[1][sort]

    def answers(self, rows: list[dict], order: int) -> tuple[np.ndarray, np.ndarray]:
        """The counts of all chunks for this chunk's words or pairs, as (estimates, with the deleted fold)."""
        mine = sorted((r for r in rows if r["ord"] == order), key=lambda r: r["shard"])
        got = [np.concatenate([unpack(r[c], r["n"], np.int64) for r in mine]) for c in ("kept", "total")]
        if order == 1:
            back = np.argsort(np.argsort(self.words))
            got = [g[back] for g in got]
        return got[0], got[1]


def questions(packed: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk, out = Chunk(row), []
                for order in (1, 2):
                    keys, kept, gone = chunk.added(order)
                    shard = ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                    cuts = np.searchsorted(shard, np.arange(shards + 1))
                    for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                        if a < b:
                            out.append((s, order, chunk.id, b - a, pack(keys[a:b], delta=True), pack(kept[a:b].astype(np.int64)), pack(gone[a:b].astype(np.int64))))
                yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, t), v in zip((("shard", pa.int64()), ("ord", pa.int32()), ("chunk", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("kept", pa.binary()), ("gone", pa.binary())), zip(*out, strict=True), strict=True)})
                del chunk, out, keys, kept, gone, shard  # before the next chunk is unpacked
                trim()

    return packed.mapInArrow(run, "shard long, ord int, chunk long, n long, keys binary, kept binary, gone binary")


def answers(asked: DataFrame) -> DataFrame:
    """A row for each question, with the summed counts in its order; of order 0, the totals of a shard of words."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.select(["chunk", "n", "keys", "kept", "gone"]).to_pylist()
        order, shard = key[1].as_py(), key[0].as_py()
        keys = [unpack(r["keys"], r["n"], np.uint64, delta=True) for r in rows]
        distinct = np.unique(np.concatenate(keys))
        kept, gone = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        for r, own in zip(rows, keys, strict=True):
            mine = np.searchsorted(distinct, own)
            np.add.at(kept, mine, unpack(r["kept"], r["n"], np.int64))
            np.add.at(gone, mine, unpack(r["gone"], r["n"], np.int64))
        total, out = kept + gone, []
        del gone
        for r, own in zip(rows, keys, strict=True):
            mine = np.searchsorted(distinct, own)
            out.append((r["chunk"], order, shard, r["n"], pack(kept[mine]), pack(total[mine]), None))
        del keys
        if order == 1:
            word = distinct != BEGIN
            sums = [int((kept[word] > 0).sum()), int(kept[word].sum()), int((total[word] > 0).sum()), int(total[word].sum())]
            out.append((None, 0, shard, 0, None, None, sums))
        del distinct, kept, total
        trim()
        return pa.table({c: pa.array(v, t) for (c, t), v in zip((("chunk", pa.int64()), ("ord", pa.int32()), ("shard", pa.int64()), ("n", pa.int64()), ("kept", pa.binary()), ("total", pa.binary()), ("sums", pa.list_(pa.int64()))), zip(*out, strict=True), strict=True)})

    return asked.groupBy("shard", "ord").applyInArrow(run, "chunk long, ord int, shard long, n long, kept binary, total binary, sums array<long>")


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, then one bucket for each power of two."""
    return np.minimum(np.ceil(np.log2(count + 1.0)), BUCKETS - 1).astype(np.int64)


def _steps(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.round(-STEPS * np.log2(p)), NEVER - 1), NEVER).astype(np.int64)


def learn_weights(rows: list[tuple[int, int, int, int]], vocabulary: int, rounds: int = 60) -> np.ndarray:
    """Weights of pair, word and uniform estimate for each bucket, from (bucket, steps of both estimates, count) rows."""
    weights = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    weights[0] = [0.0, 0.7, 0.3]
    if not rows:
        return weights
    table = np.array(rows, dtype=np.int64)
    of, n = table[:, 0], table[:, 3].astype(float)
    p = np.stack([np.where(table[:, k] == NEVER, 0.0, 2.0 ** (-table[:, k] / STEPS)) for k in (1, 2)] + [np.full(len(table), 1.0 / (vocabulary + 1))], axis=1)
    for _ in range(rounds):
        share = weights[of] * p
        share *= (n / share.sum(axis=1))[:, None]
        mass = np.stack([np.bincount(of, weights=share[:, k], minlength=BUCKETS) for k in range(3)], axis=1)
        mass += 0.5 * weights  # a bucket that the deleted fold hardly has stays near its start
        mass[:, 2] += 1e-3
        weights = mass / mass.sum(axis=1, keepdims=True)
    return weights


def score(docs: DataFrame, *, key: str = "doc_id", text: str = "text", chunk_bytes: int = 4 << 20, shard_bytes: int = 6 << 20) -> DataFrame:
    """One row for each row of ``docs``: the key, ``held_out n_tokens n_known train_tokens base_score score``.

    Words are what white space ends, with A-Z in lower case; an end follows the last word and counts as a token. Null and
    empty texts are the end alone. Repeated rows are scored and counted as often as they come. ``base_score`` is the
    unigram model with half a count added, ``score`` the log10 probability under deleted interpolation. Keys are integers. Without training
    documents all counts are 0 and every token has probability 1. An empty table gives an empty table.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = int(-(-size // shard_bytes)) or 1
    packed = materialise(chunks(docs, key, text, chunk_bytes), "lm-chunks")
    answered = materialise(answers(questions(packed, shards)), "lm-counts")
    sums = answered.where("ord = 0").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(4)]).first()
    v_kept, n_kept, v_all, n_all = (int(sums[k] or 0) for k in range(4))
    replies = answered.where("ord > 0").select("chunk", "ord", "shard", "n", "kept", "total")

    def events(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        got: dict[tuple[int, int, int], int] = {}
        rows = right.to_pylist()
        for row in left.to_pylist():
            chunk = Chunk(row)
            (words, _), (pairs, _) = chunk.answers(rows, 1), chunk.answers(rows, 2)
            context = words[chunk.context]
            p2 = np.divide(pairs[chunk.pair], context, out=np.zeros(len(context)), where=context > 0)
            code = (bucket(context) * 1024 + _steps(p2)) * 1024 + _steps(words[chunk.ids] / max(1, n_kept))
            found, n = np.unique(code, return_counts=True)
            got = {c: got.get(c, 0) + k for c, k in zip(found.tolist(), n.tolist(), strict=True)}
        trim()
        return pa.table({"b": pa.array([c >> 20 for c in got], pa.int64()), "p2": pa.array([c >> 10 & 1023 for c in got], pa.int64()), "p1": pa.array([c & 1023 for c in got], pa.int64()), "n": pa.array(list(got.values()), pa.int64())})

    gone = packed.where("deleted")
    asked_for = replies.join(gone.select("chunk"), "chunk", "left_semi")
    counted = gone.groupBy("chunk").cogroup(asked_for.groupBy("chunk")).applyInArrow(events, "b long, p2 long, p1 long, n long").groupBy("b", "p2", "p1").agg(F.sum("n").alias("n"))
    weights = learn_weights([(r.b, r.p2, r.p1, r.n) for r in counted.collect()], v_kept)

    def scores(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        parts, rows = [], right.to_pylist()
        for row in left.to_pylist():
            chunk = Chunk(row)
            (_, words), (_, pairs) = chunk.answers(rows, 1), chunk.answers(rows, 2)
            own, context = words[chunk.ids], words[chunk.context]
            of = bucket(context).astype(np.int8)
            p = np.divide(pairs[chunk.pair], context, out=np.zeros(len(context)), where=context > 0)
            p *= weights[of, 0]
            p += weights[of, 1] / max(1, n_all) * own
            p += weights[of, 2] / (v_all + 1)
            del of, context, words, pairs
            base = np.log10((own + 0.5) / (n_all + 0.5 * (v_all + 1)))
            parts.append(pa.table([pa.array(chunk.doc_keys, pa.int64()), pa.array(chunk.folds == HELD_OUT), pa.array(chunk.lengths), pa.array(per_text((own > 0).astype(np.int64), chunk.lengths)), pa.array(np.full(len(chunk.lengths), n_all)), pa.array(np.add.reduceat(base, np.cumsum(chunk.lengths) - chunk.lengths)), pa.array(np.add.reduceat(np.log10(p), np.cumsum(chunk.lengths) - chunk.lengths))], names))
            del chunk, own, p, base
        trim()
        return pa.concat_tables(parts)

    names = ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    scored = packed.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(scores, "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("key", key)
