"""Token counts of whole texts by a two-tier lookup on the map side; no pre-token is shuffled.

A text falls into pre-tokens that no piece of the vocabulary reaches across, so its number of tokens is the sum of
theirs. The lengths of the frequent pre-tokens travel in one compact broadcast table of at most ``frequent`` entries;
what it misses a worker encodes once and keeps in a cache of at most ``cache`` entries.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.llm.words import per_text, raw, slices, string_array

_SPACE_MARK = "▁"


class PieceCounter:
    """Counts the pieces of a SentencePiece BPE model, by pre-tokens where that is exact, by whole texts elsewhere."""

    def __init__(self, model_file: str, known: dict[str, int], cache: int):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.known, self.cache, self.most = known, {}, cache
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: Pre-tokens are exact only if no piece runs from a word into the white space after it.
        self.exact = not any(_SPACE_MARK in p.lstrip(_SPACE_MARK) for p in pieces) and self._plain()
        used = {c for p in pieces if not p.startswith("<0x") for c in p}
        #: Control bytes that no piece holds: each is a token of its own and ends a pre-token.
        self.single = np.array([b < 0x20 and chr(b) not in used for b in range(256)])

    def _plain(self) -> bool:
        """The model keeps white space as it is, puts one mark before a text and has a token for every byte."""
        length = lambda text: len(self.model.encode(text))
        return length("") == 0 and self.model.decode(self.model.encode("a  b ")) == "a  b " and length("\n") == 2 and length("  ") == length(" \n ") - 2 + length("  ") - length(" ") and all(self.model.is_byte(self.model.piece_to_id(f"<0x{b:02X}>")) for b in (0, 10, 255))

    def lengths(self, tokens: list[str]) -> np.ndarray:
        known, cache = self.known, self.cache
        out = [known.get(t) or cache.get(t) or 0 for t in tokens]
        if missing := [i for i, n in enumerate(out) if not n]:
            # The model puts a mark before the text by itself; after a line feed it puts none.
            asked = [t[1:] if (t := tokens[i])[:1] == " " else "\n" + t for i in missing]
            for i, got in zip(missing, self.model.encode(asked, num_threads=1), strict=True):
                out[i] = cache[tokens[i]] = len(got) if tokens[i][0] == " " else len(got) - 2
                if tokens[i] == " ":
                    out[i] = cache[" "] = 1
            if len(cache) > self.most:
                self.cache = dict(list(cache.items())[len(cache) // 2 :])
        return np.array(out, dtype=np.int64)

    def pre_tokens(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Pre-tokens (spaces, then what is no space), how many each text has, and its number of single bytes."""
        texts = pc.fill_null(texts, "")
        marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)))
        data, offsets = raw(marked)
        if not len(data):
            return pa.array([], pa.large_string()), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        single, space = self.single[data], data == 0x20
        first = np.zeros(len(data), dtype=bool)
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        behind_single = np.append(False, single[:-1]) | first
        behind_space = np.append(False, space[:-1]) & ~first
        begins = ~single & ((space & ~behind_space) | (~space & behind_single))
        starts = np.flatnonzero(begins)
        rank = np.cumsum(~single)[starts] - 1
        lengths = np.diff(np.append(rank, int(np.count_nonzero(~single))))
        counts = np.diff(np.searchsorted(starts, offsets))
        singles = np.diff(np.append(0, np.cumsum(single))[offsets])
        return string_array(data[~single], lengths), counts, singles

    def count(self, texts: pa.Array) -> np.ndarray:
        if not self.exact:
            return np.array([len(x) for x in self.model.encode([t or "" for t in texts.to_pylist()], num_threads=1)], dtype=np.int64)
        tokens, counts, singles = self.pre_tokens(texts)
        coded = tokens.dictionary_encode()
        of_each = self.lengths(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)] if len(tokens) else np.zeros(0, np.int64)
        out = per_text(of_each, counts) + singles
        for i in np.flatnonzero(pc.fill_null(pc.match_substring(texts, _SPACE_MARK), False).to_numpy(zero_copy_only=False)):
            out[i] = len(self.model.encode(texts[int(i)].as_py()))  # the mark itself in a text is rare: no pre-tokens then
        return out


def frequent_pre_tokens(docs: DataFrame, text: str, model_file: str, frequent: int, per_task: int = 2048) -> dict[str, int]:
    """Lengths of pre-tokens that are frequent over all texts.

    Each task sends its ``per_task`` most frequent ones, so this reads the whole corpus and moves a bounded summary.
    Which entries it holds decides only how often a worker encodes for itself.
    """

    def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = PieceCounter(model_file, {}, 0), {}
        for batch in batches:
            for part in slices(batch, text):
                got = counter.pre_tokens(part.column(0))[0].value_counts()
                got = got.filter(pc.greater(got.field("counts"), 3))
                for token, n in zip(got.field("values").to_pylist(), got.field("counts").to_pylist(), strict=True):
                    seen[token] = seen.get(token, 0) + n
                if len(seen) > 50 * per_task:
                    seen = dict(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: 10 * per_task])
        top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:per_task]
        yield pa.RecordBatch.from_pydict({"token": pa.array([t for t, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    top = docs.select(text).mapInArrow(summarise, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(frequent)
    tokens = [r.token for r in top.collect() if len(r.token) < 64]
    return dict(zip(tokens, PieceCounter(model_file, {}, frequent).lengths(tokens).tolist(), strict=True)) if tokens else {}


def count_tokens(docs: DataFrame, model_file: str, *, text: str = "text", limit: int = 4096, frequent: int = 32768, cache: int = 400_000) -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens`` and ``over_limit`` to every row, in place of columns of those names.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows stay, each with its own count. An empty table gives
    an empty table. ``model_file`` is a path that every executor can read. Texts are never cut.
    """
    added = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in docs.columns if c not in added]
    known = docs.sparkSession.sparkContext.broadcast(frequent_pre_tokens(docs, text, model_file, frequent))
    schema = docs.select(*kept, F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens"), F.lit(True).alias("over_limit")).schema

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model_file, known.value, cache)
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(part.schema.get_field_index(text))
                n = counter.count(texts)
                size = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0)
                yield pa.RecordBatch.from_arrays([*part.columns, size, pa.array(n), pa.array(n > limit)], [*kept, *added])

    return docs.select(*kept).mapInArrow(count, schema)
