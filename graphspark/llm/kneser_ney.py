"""Quality by the perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over runs of four characters, so it needs no vocabulary and works for every language and every length of
text. It is trained on four fifths of all trusted documents, by hash; the others, which it has not seen, set the
thresholds. Its tables of counts stay sharded by n-gram: a chunk of documents asks for its own distinct n-grams, joins
with the shards of every order give their probabilities, and the answers return to the chunk.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspark.llm.packing import pack, unpack
from graphspark.llm.storage import drop, materialise, whole_row
from graphspark.llm.words import raw, slices, trim

ORDER = 4
BEGIN, END, OTHER = 1, 2, 0xFFFE
#: A text counts as if this many characters of average text of the sample came before it: short texts say little.
PRIOR_CHARACTERS = 160
#: Bytes of text whose n-grams are in memory at a time.
SLICE = 1 << 20
#: Ids that one broadcast holds when texts are picked by id, and how many such there may be; more ids are joined by a shuffle.
LEARNT_PIECE, LEARNT_PIECES = 1 << 20, 8
_ASKED = (("shard", pa.int32()), ("_chunk", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()))


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Runs of four characters, 16 bits each, one for every character of a text and one for its end; and texts' lengths.

    Characters beyond the basic plane share the codes of the surrogates, which no text has.
    """
    texts = pc.fill_null(texts, "")
    points = np.frombuffer(raw(texts)[0].tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.where(points > 0xFFFF, 0xD800 | (points & 0x7FF), np.where((points == BEGIN) | (points == END), OTHER, points)).astype(np.uint64)
    n = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    wide = n + ORDER
    starts = np.cumsum(wide) - wide
    line = np.full(int(wide.sum()), BEGIN, dtype=np.uint64)
    text = np.repeat(np.arange(len(n)), n)
    line[np.arange(len(points)) + ORDER * text + ORDER - 1] = points
    line[starts + wide - 1] = END
    out = np.zeros(max(0, len(line) - ORDER + 1), dtype=np.uint64)
    for k in range(ORDER):
        out |= line[k : len(line) - ORDER + 1 + k] << np.uint64(16 * (ORDER - 1 - k))
    real = np.ones(len(out), dtype=bool)
    for k in range(1, ORDER):  # the runs that would reach from a text into the next
        at = starts[1:] - k
        real[at] = False
    return out[real], n + 1


def count_grams(docs: DataFrame, text: str) -> DataFrame:
    """``(gram, n)`` over all rows of ``docs``, summed in each task before anything moves."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, text, SLICE):
                found, n = np.unique(grams(part.column(0))[0], return_counts=True)
                both = np.concatenate([known, found])
                known, place = np.unique(both, return_inverse=True)
                total = np.bincount(place, weights=np.concatenate([total, n]), minlength=len(known)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(known.view(np.int64)), "n": pa.array(total)})

    return docs.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    row = counts.agg(*[F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n = [0, *(row[f"n{k}"] or 0 for k in (1, 2, 3, 4))]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    return tuple(min(k, max(0.1 * k, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.5 * k for k in (1, 2, 3))


def suffix(gram: Column, order: int) -> Column:
    return gram if order == ORDER else gram.bitwiseAND(F.lit((1 << 16 * order) - 1))


@dataclass(frozen=True)
class Model:
    """``table`` has ``(ord, part, key, value)``: ``alpha`` of an n-gram, and of orders above one ``gamma`` of a context.

    ``gamma`` is that of the one context that order 1 has, ``floor`` the uniform probability below.
    """

    table: DataFrame
    gamma: float
    floor: float


def train(docs: DataFrame, text: str) -> Model:
    """The model of a text column.

    The counts of the highest order are those of the text; below, a count is the number of different characters before
    the n-gram. All tables come from grouping and joining counts by their keys.
    """
    highest = counts = materialise(count_grams(docs, text), "kn-counts")
    parts = []
    row = lambda order, part, key, value: (F.lit(order).alias("ord"), F.lit(part).alias("part"), F.col(key).alias("key"), value.alias("value"))
    for order in range(ORDER, 1, -1):
        d1, d2, d3 = _discounts(counts)
        keyed = counts.withColumn("context", F.shiftrightunsigned("gram", 16))
        less = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        contexts = keyed.groupBy("context").agg(F.sum("n").alias("total"), (F.sum(less) / F.sum("n")).alias("gamma"))
        parts.append(keyed.join(contexts, "context").select(*row(order, "alpha", "gram", (F.col("n") - less) / F.col("total"))))
        parts.append(contexts.select(*row(order, "gamma", "context", F.col("gamma"))))
        counts = counts.groupBy(suffix(F.col("gram"), order - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    d1, d2, d3 = _discounts(counts)
    less = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
    whole = counts.agg(F.sum("n").alias("total"), F.sum(less).alias("less"), F.count(F.lit(1)).alias("kinds")).first()
    total = whole["total"] or 1
    parts.append(counts.select(*row(1, "alpha", "gram", (F.col("n") - less) / F.lit(float(total)))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    table = materialise(out, "kn-model")
    drop(highest)
    return Model(table, (whole["less"] or 0.0) / total, 1.0 / (whole["kinds"] + 1))


def log_probabilities(asked: DataFrame, model: Model) -> DataFrame:
    """``(gram, bits)`` of every asked n-gram: minus the logarithm of its interpolated probability."""
    shard = lambda order, part, key: model.table.where((F.col("ord") == order) & (F.col("part") == part)).select(F.col("key").alias(key), F.col("value").alias(part))
    first = asked.withColumn("last", suffix(F.col("gram"), 1)).join(shard(1, "alpha", "last"), "last", "left")
    df = first.select("gram", (F.coalesce("alpha", F.lit(0.0)) + F.lit(model.gamma * model.floor)).alias("p"))
    for order in range(2, ORDER + 1):
        own = suffix(F.col("gram"), order)
        df = df.withColumn("own", own).join(shard(order, "alpha", "own"), "own", "left")
        df = df.withColumn("context", F.shiftrightunsigned(own, 16)).join(shard(order, "gamma", "context"), "context", "left")
        df = df.select("gram", (F.coalesce("alpha", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("p")).alias("p"))
    return df.select("gram", (-F.log2("p")).alias("bits"))


def perplexities(docs: DataFrame, model: Model, *, text: str, chunk_bytes: int = 12 << 20) -> DataFrame:
    """``docs`` with ``_bits`` (minus the logarithm of the probability of the text) and ``_n`` (characters and end)."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_chunks = int(-(-size // chunk_bytes)) or 1
    salt = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if t in ("string", "bigint", "int")])
    shards = n_chunks | 1
    chunked = docs.withColumn("_chunk", F.pmod(salt, F.lit(n_chunks)).cast("int"))
    names = chunked.columns
    place = names.index(text)

    def ask(table: pa.Table) -> pa.Table:
        known = np.zeros(0, np.uint64)
        for batch in table.select([text]).to_batches():
            for part in slices(batch, text, SLICE):
                known = np.union1d(known, pa.array(grams(part.column(0))[0]).unique().to_numpy())
        shard = known.view(np.int64) % shards
        rows = [(s, table.column("_chunk")[0].as_py(), int((shard == s).sum()), pack(known[shard == s], delta=True)) for s in np.unique(shard).tolist()]
        return pa.table({c: pa.array(v, t) for (c, t), v in zip(_ASKED, zip(*rows, strict=True), strict=True)})

    def distinct(key: tuple, table: pa.Table) -> pa.Table:
        known = np.zeros(0, np.uint64)
        for n, keys in zip(table.column("n").to_pylist(), table.column("keys").to_pylist(), strict=True):
            known = np.union1d(known, unpack(keys, n, np.uint64, delta=True))
        return pa.table({"gram": pa.array(known.view(np.int64))})

    def reply(left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.column("gram").to_numpy()
        order = np.argsort(known.view(np.uint64))
        known, bits = known.view(np.uint64)[order], right.column("bits").to_numpy()[order].astype(np.float32)
        found = [pack(bits[np.searchsorted(known, unpack(keys, n, np.uint64, delta=True))]) for n, keys in zip(left.column("n").to_pylist(), left.column("keys").to_pylist(), strict=True)]
        return pa.table({"_chunk": left.column("_chunk"), "n": left.column("n"), "keys": left.column("keys"), "bits": pa.array(found, pa.binary())})

    asked = chunked.groupBy("_chunk").applyInArrow(ask, "shard int, _chunk int, n long, keys binary")
    bits = log_probabilities(asked.groupBy("shard").applyInArrow(distinct, "gram long"), model).withColumn("shard", F.pmod("gram", F.lit(shards)).cast("int"))
    answered = asked.groupBy("shard").cogroup(bits.groupBy("shard")).applyInArrow(reply, "_chunk int, n long, keys binary, bits binary")

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([], schema=pa.schema([*left.schema, ("_bits", pa.float64()), ("_n", pa.int64())]))
        sizes = right.column("n").to_pylist()
        known = np.concatenate([unpack(k, n, np.uint64, delta=True) for n, k in zip(sizes, right.column("keys").to_pylist(), strict=True)])
        of = np.concatenate([unpack(x, n, np.float32) for n, x in zip(sizes, right.column("bits").to_pylist(), strict=True)])
        order = np.argsort(known)
        known, of = known[order], of[order].astype(np.float64)
        out = []
        for batch in left.to_batches():
            for part in slices(batch, text, SLICE):
                found, n = grams(part.column(place))
                coded = pa.array(found).dictionary_encode()
                each = of[np.searchsorted(known, coded.dictionary.to_numpy())][coded.indices.to_numpy()]
                out.append(pa.RecordBatch.from_arrays([*part.columns, pa.array(np.add.reduceat(each, np.cumsum(n) - n)), pa.array(n)], [*names, "_bits", "_n"]))
        del known, of
        trim()
        return pa.Table.from_batches(out)

    schema = chunked.withColumns({"_bits": F.lit(0.0), "_n": F.lit(0).cast("long")}).schema
    return chunked.groupBy("_chunk").cogroup(answered.groupBy("_chunk")).applyInArrow(judge, schema).drop("_chunk")


def _of_language(values: dict[str, float], other: float):
    """A function from the name of a language column to a value for each language, ``other`` for languages not listed."""

    def column(language: str) -> Column:
        out = F.lit(other)
        for name, x in sorted(values.items()):
            out = F.when(F.col(f"`{language}`") == name, F.lit(x)).otherwise(out)
        return out

    return column


def quantiles(rows: DataFrame, group: str, value: str, quantile: float, least: int) -> dict[str | None, float]:
    """The exact quantile of each group of at least ``least`` rows, and under None that over all rows, if there are any.

    Counts in narrow bins find the ranks; only the distinct values in the bins that hold them come to the driver.
    """
    binned = rows.withColumn("_bin", F.floor(F.col(value) * 1024))
    bins: dict[str | None, Counter] = defaultdict(Counter)
    for r in binned.groupBy(group, "_bin").agg(F.count(F.lit(1)).alias("n")).collect():
        for name in {r[group], None}:
            bins[name][r["_bin"]] += r["n"]

    def holder(counts: list[tuple], rank: int) -> tuple:
        """The first entry at which the counts reach beyond the rank, and the rank inside it."""
        for at, n in counts:
            if rank < n:
                return at, rank
            rank -= n
        raise ValueError("rank beyond the rows")

    ranks = {}
    for name, counts in bins.items():
        total = sum(counts.values())
        if name is None or total >= least:
            at = quantile * (total - 1)
            ranks[name] = at - int(at), [holder(sorted(counts.items()), k) for k in (int(at), min(int(at) + 1, total - 1))]
    wanted = {b for _, places in ranks.values() for b, _ in places}
    values: dict[tuple, Counter] = defaultdict(Counter)
    for r in binned.where(F.col("_bin").isin(sorted(wanted))).groupBy(group, "_bin", value).agg(F.count(F.lit(1)).alias("n")).collect() if wanted else ():
        for name in {r[group], None}:
            values[name, r["_bin"]][r[value]] += r["n"]
    out = {}
    for name, (share, places) in ranks.items():
        low, high = (holder(sorted(values[name, b].items()), k)[0] for b, k in places)
        out[name] = low + share * (high - low)
    return out


def training_ids(labels: DataFrame, key: str, quality: str, trusted: int | None = None) -> DataFrame:
    """``id`` of the trusted documents that the model is fitted on: four fifths of all, or of ``trusted`` at most, by hash."""
    chosen = labels.where((F.col(quality) == 1) & F.col(key).isNotNull()).select(F.col(key).alias("id")).distinct()
    if trusted is not None:
        chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(trusted)
    return chosen.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(5)) != 0)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``text`` of the rows whose ``key`` is among the distinct ``id``; texts are shuffled only where ids are too many."""
    pieces = -(-ids.count() // LEARNT_PIECE) or 1
    among = lambda few: docs.select("key", "text").join(few, F.col("key") == F.col("id"), "left_semi").select("text")
    if pieces > LEARNT_PIECES:
        return among(ids)
    parts = [among(F.broadcast(ids.where(F.pmod(F.xxhash64("id"), F.lit(pieces)) == k))) for k in range(pieces)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def judge(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", quality: str = "quality", trusted: int | None = None, quantile: float = 0.995, least: int = 50, chunk_bytes: int = 12 << 20, columns: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` with ``perplexity``, ``quality_bits``, ``threshold`` (of bits) and ``kept``, in place of columns so named.

    ``perplexity`` is that of the model, by character. ``quality_bits`` is its logarithm after as many characters of
    average text of the language were put before the text as short texts need to say anything. A row stays if its bits
    are at most the ``quantile`` of all trusted documents of its language that the model has not seen; languages with
    fewer than ``least`` of these, and null, take the quantile over all of them. Null and empty texts are rejected.
    Repeated rows are judged alike. Without trusted documents every text that is not empty stays, with perplexity 1. An
    empty table gives an empty table. Other columns stay, whatever their names, or of them the ``columns`` asked for: what
    is left out, such as the text, moves once less.
    """
    added = ("perplexity", "quality_bits", "threshold", "kept")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    own = docs.select(whole_row(docs if columns is None else docs.select(*[F.col(f"`{c}`") for c in columns])), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    learnt = materialise(training_ids(labels, key, quality, trusted), "kn-learnt")
    sample = texts_of(own, learnt).where("text IS NOT NULL")
    if sample.limit(1).count() == 0:
        return own.select("row.*", F.lit(1.0).alias("perplexity"), F.lit(0.0).alias("quality_bits"), F.lit(float("inf")).alias("threshold"), (F.length(F.coalesce("text", F.lit(""))) > 0).alias("kept"))
    # One pass scores every row; what it finds is kept without the text, by key and hash of the text.
    scored = perplexities(own.select("key", "text", "lang"), train(sample, "text"), text="text", chunk_bytes=chunk_bytes)
    scored = materialise(scored.select("key", F.xxhash64("text").alias("hash"), F.col("text").isNull().alias("none"), "lang", "_bits", "_n"), "kn-scored")

    judges = labels.where((F.col(quality) == 1) & F.col(key).isNotNull()).select(F.col(key).alias("id")).join(learnt, "id", "left_anti")
    unseen = materialise(scored.where("NOT none").join(judges, F.col("key") == F.col("id"), "left_semi").select("lang", "_bits", "_n"), "kn-unseen")
    sums = unseen.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.sum("_bits").alias("bits"), F.sum("_n").alias("n")).collect()
    centre = _of_language({r["lang"]: r["bits"] / r["n"] for r in sums if r["rows"] >= least and r["lang"] is not None}, sum(r["bits"] for r in sums) / sum(r["n"] for r in sums) if sums else 0.0)("lang")
    shrunk = ((F.col("_bits") + PRIOR_CHARACTERS * centre) / (F.col("_n") + PRIOR_CHARACTERS)).alias("quality_bits")
    found = quantiles(unseen.select("lang", shrunk), "lang", "quality_bits", quantile, least)
    overall = found.pop(None, float("inf"))
    limit = _of_language(found, overall)("lang")
    once = scored.groupBy(F.col("key").alias("scored_key"), F.col("hash").alias("scored_hash")).agg(F.first("_bits").alias("_bits"), F.first("_n").alias("_n"))
    marked = own.select("row", "key", "lang", F.xxhash64("text").alias("hash"))
    judged = marked.join(once, F.col("key").eqNullSafe(F.col("scored_key")) & (F.col("hash") == F.col("scored_hash")))
    told = judged.select("row", F.pow(F.lit(2.0), F.col("_bits") / F.col("_n")).alias("perplexity"), shrunk, limit.alias("threshold"), (F.col("_n") > 1).alias("full"))
    return told.select("row.*", "perplexity", "quality_bits", "threshold", ((F.col("quality_bits") <= F.col("threshold")) & F.col("full")).alias("kept"))
