"""Mixture-controlled packing: deficit round-robin over source queues.

All documents of a source form a queue of tokens. In each round a queue's deficit grows by its
quantum, ``window * weight`` tokens, and it sends its deficit in pieces of ``grain`` tokens; what is
less than a piece is carried to the next round. Rounds follow one another in one stream of tokens
that is cut into windows, so every window is full and holds each source to its weight, within a
piece and what is carried.

What a queue has sent by round i is grain * floor(i * window * w / grain): a closed form. So the
deficits that one partition hands to the next need no order of execution: a document's place follows
from its queue, its first token's number in the queue and the queues' totals. Tokens are made once and
written to the shared scratch folder; numbers within a partition and source become numbers in the
queue by a small running total over partitions.

With more than MOST_QUEUES sources the queues nest: sources are dealt to groups, a group's weight is the sum of
its sources', and a group's queue is itself the deficit round-robin stream of its sources. Every source keeps
its weight at any number of them.

Rounds and totals are 64-bit numbers; products of them are split, so that places are exact up to MOST_TOKENS.

The stream's last, incomplete window is cut into sequences whose lengths are powers of two, so that
nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.words import Words, slices
from quire.plans import scratch

WINDOW = 4096
GRAIN = 128
END_ID = 2
MOST_QUEUES = 200
WEIGHT_STEPS = 1 << 16
MOST_TOKENS = 1 << 56
_AS_IS = np.arange(256, dtype=np.uint8)
_SPACES = np.isin(_AS_IS, [32, 9, 10, 13])
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokens:
    """Token ids of texts, word by word, with a cache of words that is bounded in bytes.

    The vocabulary never joins characters across white space, so a text's ids are those of its words. Known words
    are packed arrays: sorted hashes, and where a word's ids lie. New words of a slice are encoded in one text,
    parted by one of the vocabulary's special tokens.
    """

    MOST_BYTES = 48 << 20
    _made: dict[str, WordTokens] = {}

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        self.encode_batch = getattr(model, "encode_batch_fast", model.encode_batch)
        self.special = {t.content: i for i, t in model.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)}
        self.clear()

    @classmethod
    def get(cls, path: str) -> WordTokens:
        """One for each Python worker."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def clear(self) -> None:
        self.key, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the words' numbers of ids."""
        part, mark = next(iter(self.special.items()), ("", None))
        ids, sizes = [np.zeros(0, np.uint32)], np.zeros(len(words), np.int32)
        plain = np.array([mark is not None and not any(t in w for t in self.special) for w in words], bool)
        for a in range(0, len(words), 5000):
            some = np.flatnonzero(plain[a : a + 5000]) + a
            if len(some):
                got = np.array(self.encode_batch([part.join(words[i] for i in some)], add_special_tokens=False)[0].ids, np.uint32)
                ends = np.append(np.flatnonzero(got == mark), len(got))
                sizes[some] = np.diff(np.concatenate(([-1], ends))) - 1
                got = got[got != mark]
            else:
                got = np.zeros(0, np.uint32)
            odd = np.flatnonzero(~plain[a : a + 5000]) + a
            if len(odd):
                each = [e.ids for e in self.encode_batch([words[i] for i in odd], add_special_tokens=False)]
                at = np.cumsum(sizes[a : a + 5000])[odd - a]
                got = np.insert(got, np.repeat(at, [len(x) for x in each]), np.concatenate(each).astype(np.uint32))
                sizes[odd] = [len(x) for x in each]
            ids.append(got)
        return np.concatenate(ids), sizes

    def _learn(self, key: np.ndarray, words: list[str]) -> None:
        """Add new words by their sorted hashes."""
        ids, size = self._ids(words)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        begin = self.used + np.cumsum(size) - size
        self.used += len(ids)
        at = np.searchsorted(self.key, key)
        self.key, self.size, self.begin = np.insert(self.key, at, key), np.insert(self.size, at, size), np.insert(self.begin, at, begin.astype(np.int32))

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice in a row, each text closed by END_ID, and the texts' lengths."""
        if 4 * len(self.flat) + 16 * len(self.key) > self.MOST_BYTES:
            self.clear()
        w = Words(data, offs, _AS_IS, _SPACES)
        key, first = np.unique(w.hash, return_index=True)
        new = np.ones(len(key), bool)
        if len(self.key):
            new = self.key[np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)] != key
        if new.any():
            whole = data.tobytes()
            self._learn(key[new], [whole[x:y].decode() for x, y in zip(w.start[first[new]].tolist(), w.end[first[new]].tolist(), strict=True)])
        at = np.searchsorted(self.key, w.hash)
        size, begin = self.size[at].astype(np.int64), self.begin[at].astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(size)))
        each = np.arange(upto[-1]) + np.repeat(begin - upto[:-1], size)
        close = upto[w.first[1:]]
        return np.insert(self.flat[each], close, END_ID), np.diff(np.concatenate(([0], close))) + 1


def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, sent, model = TaskContext.get().partitionId(), {}, WordTokens.get(path)
        for batch in batches:
            docs, names = batch.column(0), batch.column(1).to_pylist()
            for a, b, data, offs in slices(batch.column(2)):
                ids, sizes = model.encode(data, offs)
                wide = ids.astype("<u2" if len(ids) and int(ids.max()) < 1 << 16 else "<u4")
                cut = np.concatenate(([0], np.cumsum(sizes)))
                off = []
                for s, n in zip(names[a:b], sizes.tolist(), strict=True):
                    off.append(sent.get(s, 0))
                    sent[s] = off[-1] + n
                blobs = [wide[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [docs.slice(a, b - a), pa.array(names[a:b], pa.string()), pa.array([part] * len(off), pa.int32()), pa.array(off, pa.int64()), pa.array(sizes), pa.array(blobs, pa.binary())],
                    names=["doc_id", "queue", "part", "off", "n", "ids"],
                )

    return run


class Queues:
    """One deficit round-robin stream of queues, from their totals and whole-number weights."""

    def __init__(self, totals: list[int], weights: list[int], window: int = WINDOW, grain: int = GRAIN):
        self.n, self.sum = sum(totals), sum(weights)
        if self.n > MOST_TOKENS:
            raise OverflowError(f"{self.n} tokens are more than {MOST_TOKENS}")
        steps = window // grain
        if min(weights, default=1) < 1 or self.sum * steps * max(weights, default=1) >= 1 << 62 or self.n // grain * self.sum // min(weights, default=1) >= 1 << 62:
            raise OverflowError("weights need more than 64 bits")
        self.total, self.weight, self.grain = np.array(totals, np.int64), np.array(weights, np.int64), grain
        self.step = self.weight * steps  # grains that a queue earns in ``sum`` rounds

    def sent(self, rounds: np.ndarray, q: int) -> np.ndarray:
        """Tokens that queue q has sent before each round: grain * floor(round * step / sum), up to its total."""
        whole, rest = np.divmod(rounds, self.sum)
        upto = whole * self.step[q] + rest * self.step[q] // self.sum
        return np.minimum(np.minimum(upto, self.total[q] // self.grain + 1) * self.grain, self.total[q])

    def round_of(self, grains: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The round in which a queue sends its grain of that number (from 0): ceil((m + 1) * sum / step) - 1."""
        whole, rest = np.divmod(grains + 1, self.step[q])
        return whole * self.sum - (-rest * self.sum // self.step[q]) - 1

    def place(self, queue: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start, length, position in the stream) of the pieces of runs of tokens of a queue."""
        g = self.grain
        m0 = first // g
        count = (first + size - 1) // g - m0 + 1
        row = np.repeat(np.arange(len(first)), count)
        m = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + m0[row]
        low, high = np.maximum(first[row], m * g), np.minimum((first + size)[row], (m + 1) * g)
        q = queue[row]
        i = self.round_of(m, q)
        new = np.ones(len(row), bool)  # neighbouring pieces of one run in one round are one piece
        new[1:] = (row[1:] != row[:-1]) | (i[1:] != i[:-1])
        at = np.flatnonzero(new)
        high = high[np.append(at[1:], len(row)) - 1] if len(row) else high
        row, low, i, q = row[at], low[at], i[at], q[at]
        pos = np.zeros(len(row), np.int64)
        for k in range(len(self.total)):
            now = self.sent(i, k)
            pos += now
            pos += np.where(k < q, self.sent(i + 1, k) - now, 0)
            pos += np.where(k == q, low - now, 0)
        return row, low - first[row], high - low, pos


class Layout:
    """Places of tokens in sequences: one stream of queues, or of groups of queues, cut into windows."""

    def __init__(self, totals: list[int], weights: list[int], window: int = WINDOW, grain: int = GRAIN, most: int = MOST_QUEUES):
        self.window, self.n = window, sum(totals)
        groups = -(-len(totals) // most) if len(totals) > most else len(totals)
        self.group = np.arange(len(totals)) % max(1, groups)
        self.inner = []
        self.within = np.arange(len(totals)) // max(1, groups)
        if groups < len(totals):
            self.inner = [Queues(totals[k::groups], weights[k::groups], window, grain) for k in range(groups)]
        self.outer = Queues([sum(totals[k::groups]) for k in range(groups)], [sum(weights[k::groups]) for k in range(groups)], window, grain)
        full = self.n // window * window
        tail, at = [], full
        for bit in reversed(range(window.bit_length())):
            if (self.n - full) >> bit & 1:
                tail.append(at)
                at += 1 << bit
        self.full, self.tail = full, np.array([*tail, self.n], np.int64)

    def place(self, queue: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document's row, start, length, sequence, offset) of the pieces of documents."""
        if not self.inner:
            row, start, length, pos = self.outer.place(queue, first, size)
        else:
            group, found = self.group[queue], []
            for k in np.unique(group).tolist():
                rows = np.flatnonzero(group == k)
                r, a, n, at = self.inner[k].place(self.within[queue[rows]], first[rows], size[rows])
                piece, more, length, pos = self.outer.place(np.full(len(r), k), at, n)
                found.append((rows[r[piece]], a[piece] + more, length, pos))
            row, start, length, pos = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (first,) * 4
        seq, off = self.sequence(pos)
        done = []
        while len(row):
            room = self.room(pos, off)
            done.append((row, start, np.minimum(length, room), seq, off))
            more = length > room
            row, start, length, pos = row[more], (start + room)[more], (length - room)[more], (pos + room)[more]
            seq, off = self.sequence(pos)
        return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (row, start, length, seq, off)

    def sequence(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = np.maximum(np.searchsorted(self.tail, pos, side="right") - 1, 0)
        last = pos >= self.full
        return np.where(last, self.full // self.window + t, pos // self.window), np.where(last, pos - self.tail[t], pos % self.window)

    def room(self, pos: np.ndarray, off: np.ndarray) -> np.ndarray:
        t = np.minimum(np.searchsorted(self.tail, pos, side="right"), len(self.tail) - 1)
        return np.where(pos >= self.full, self.tail[t] - pos, self.window - off)


def _pieces(layout: Layout, number: dict[str, int], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = np.array([number[s] for s in batch.column(1).to_pylist()], np.int64)
            first, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            row, start, length, seq, off = layout.place(q, first, size)
            blobs = [np.frombuffer(x.as_buffer(), "<u2" if x.as_buffer().size == 2 * n else "<u4") for x, n in zip(batch.column(4), size.tolist(), strict=True)]
            crc, ids = np.zeros(len(row), np.int64), []
            for j, (r, a, n) in enumerate(zip(row.tolist(), start.tolist(), length.tolist(), strict=True)):
                piece = blobs[r][a : a + n].astype("<u4")
                crc[j] = zlib.crc32(piece.tobytes())
                if with_ids:
                    ids.append(piece.astype(np.int32))
            at = pa.array(row)
            out = [batch.column(0).take(at), *(pa.array(x) for x in (start, length, crc)), batch.column(3).take(at), pa.array(seq), pa.array(off)]
            names = [x.split()[0] for x in PIECE.split(", ")]
            if with_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Weights as whole numbers, at least 1, that add up to about WEIGHT_STEPS or 64 for each source."""
    total, steps = sum(weights.values()) or 1.0, max(WEIGHT_STEPS, 64 * len(weights))
    return {s: max(1, round(w / total * steps)) for s, w in weights.items()}


def pack(
    docs: DataFrame,
    tokenizer: str,
    weights: dict[str, float] | None = None,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``tokenizer``: path of a vocabulary file of the tokenizers library. ``weights``: target token
    shares by source; None: the corpus' own, so that all queues end together. A source without a
    weight gets the smallest one given. An empty queue sends nothing and the others go on.

    Null texts are empty and have one token, the closing one. Null and empty sources are one queue. Rows with
    null or repeated ids are packed like any other, each with its id. An empty input gives an empty result.
    Other columns are ignored. One row per source passes through the driver.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("queue"),
        F.col(text_col).cast("string").alias("text"),
    )
    made = scratch.write(
        rows.mapInArrow(_tokenize(tokenizer), "doc_id long, queue string, part int, off long, n long, ids binary"),
        "tokens",
    )
    parts = scratch.write(made.groupBy("part", "queue").agg(F.sum("n").alias("n")), "parts")
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"))
    starts = scratch.write(starts, "starts")
    totals = {r["queue"]: r["n"] for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    least = min((w for s, w in (weights or {}).items() if s in totals and w > 0), default=1.0)
    share = whole_weights({s: max(0, weights.get(s, 0)) or least for s in totals} if weights else dict(totals))
    names = sorted(totals)
    layout = Layout([totals[s] for s in names], [share[s] for s in names])
    placed = made.join(starts, ["part", "queue"]).select("doc_id", "queue", (F.col("at") + F.col("off")).alias("first"), "n", "ids")
    return placed.mapInArrow(_pieces(layout, {s: i for i, s in enumerate(names)}, with_ids), PIECE + ", ids array<int>" * with_ids)
