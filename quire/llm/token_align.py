"""Alignment of two tokenizers over a corpus, by id-striped dense count matrices.

Every text is encoded twice. Byte offsets where tokens of both end cut it into groups, and the two tokens that end
at one are a link.

1. *Encode.* A text is cut before single spaces and line feeds between other characters. No token of either
   vocabulary crosses these places (that of the second is checked), so a piece's ids and groups do not depend on
   the text, and each worker keeps them by the piece's hash. Links are packed by id pair and text.
2. *Count.* Pairs are partitioned by the second side's id: STRIPE of its ids are a stripe. ``np.add.at`` adds up its
   pairs in one dense block, STRIPE rows by all ids of the first side, and row maxima tell each id's best count. Equal
   pairs are added up before they move; LOT packed rows are one task, and what tasks count is added up again by
   LOT, until a stripe has one row.
3. *Score.* Links are partitioned like the counts, by stripe and lot, and meet them there; the texts' sums of each
   stripe are added up by the rows that the texts came in.

A block has the same size for any input, and no task gathers more than LOT packed rows of a stripe.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.words import Spans, slices
from quire.plans import scratch

STRIPE = 64
LOT = 64
FLUSH_LINKS = 1 << 20
MOST_DOCS = 1 << 16
_AS_IS = np.arange(256, dtype=np.uint8)
#: First bytes of characters that may be white space beyond ASCII.
_MAYBE_SPACE = np.isin(_AS_IS, [0xC2, 0xE1, 0xE2, 0xE3])
_NO_SPACE = ~np.isin(_AS_IS, [*range(33), 127])


def piece_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where pieces start: each text, and single spaces and line feeds between characters that are no white space."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 2:
        here = (data == 32) | (data == 10)
        after = np.zeros(n, bool)
        after[:-1] = (_NO_SPACE & ~_MAYBE_SPACE)[data[1:]]
        before = np.zeros(n, bool)
        before[1:] = _NO_SPACE[data[:-1]]
        before[2:] &= ~((data[1:-1] >= 128) & (data[:-2] == 0xC2))
        before[3:] &= ~((data[2:-1] >= 128) & (data[1:-2] >= 128) & _MAYBE_SPACE[data[:-3]] & (data[:-3] != 0xC2))
        cut = here & after & before
        ends = offs[1:-1]
        cut[ends[ends < n] - 1] = False  # a text's last byte is followed by another text
    starts = offs[:-1][np.diff(offs) > 0]
    cut[starts] = True
    return np.flatnonzero(cut)


def byte_level() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Both tokenizers, and the pieces that they have met: ids' groups as text, counts, and packed links."""

    MOST_BYTES = 64 << 20
    _made: dict[tuple[str, str], Aligner] = {}

    def __init__(self, first: str, second: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(first)
        a.encode_special_tokens = True
        self.encode_a = getattr(a, "encode_batch_fast", a.encode_batch)
        chars = byte_level()
        self.size_a = a.get_vocab_size()
        self.bytes_a = [b""] * self.size_a
        for token, i in a.get_vocab().items():
            self.bytes_a[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in x.lstrip("▁") or "\n" in x for x in names):
            raise ValueError("a piece holds a space or a line feed after other characters")
        if len(names) * self.size_a >= 1 << 32:
            raise ValueError("id pairs need more than 32 bits")
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.clear()

    @classmethod
    def get(cls, first: str, second: str) -> Aligner:
        """One for each Python worker."""
        if (first, second) not in cls._made:
            cls._made[first, second] = cls(first, second)
        return cls._made[first, second]

    def clear(self) -> None:
        self.key, self.index = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        #: By piece: groups as text, whether both sides' bytes are the piece, (n_a, n_b, n_groups), and where its links are.
        self.groups: list[bytes] = []
        self.good = np.zeros(1024, bool)
        self.nums = np.zeros((1024, 3), np.int32)
        self.begin = np.zeros(1025, np.int64)
        self.links, self.held = np.zeros(1 << 12, np.uint32), 0

    def _align(self, piece: bytes, a: list[int], b: list[int]) -> tuple[bytes, bool, tuple[int, int, int], list[int]]:
        if b"".join(self.bytes_a[i] for i in a) != piece or b"".join(self.bytes_b[i] for i in b) != piece:
            return b"", False, (0, 0, 0), []
        groups, links = [], []
        i = j = at_a = at_b = from_i = from_j = 0
        while i < len(a):
            at_a += len(self.bytes_a[a[i]])
            i += 1
            while at_b < at_a:
                at_b += len(self.bytes_b[b[j]])
                j += 1
            if at_b == at_a:
                groups.append(f"{','.join(map(str, a[from_i:i]))}|{','.join(map(str, b[from_j:j]))}")
                links.append(b[j - 1] * self.size_a + a[i - 1])
                from_i, from_j = i, j
        return ";".join(groups).encode(), True, (len(a), len(b), len(groups)), links

    def _learn(self, key: np.ndarray, pieces: list[bytes]) -> None:
        """Add new pieces by their sorted hashes."""
        texts = [p.decode() for p in pieces]
        a = [e.ids for e in self.encode_a(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        # The second side puts a space before a text; a piece that starts with a line feed has none.
        b = [x if t[0] == " " else x[1:] for t, x in zip(texts, b, strict=True)]
        n = len(self.groups)
        while n + len(pieces) + 1 > len(self.begin):
            self.good, self.nums = np.append(self.good, np.zeros_like(self.good)), np.append(self.nums, np.zeros_like(self.nums), 0)
            self.begin = np.append(self.begin, np.zeros(len(self.begin) - 1, np.int64))
        found = []
        for k, (piece, x, y) in enumerate(zip(pieces, a, b, strict=True), n):
            groups, self.good[k], self.nums[k], links = self._align(piece, x, y)
            self.groups.append(groups)
            self.held += len(groups) + 120
            found += links
            self.begin[k + 1] = self.begin[k] + len(links)
        while self.begin[n + len(pieces)] > len(self.links):
            self.links = np.append(self.links, np.zeros_like(self.links))
        self.links[self.begin[n] : self.begin[n + len(pieces)]] = found
        at = np.searchsorted(self.key, key)
        self.key, self.index = np.insert(self.key, at, key), np.insert(self.index, at, np.arange(n, n + len(pieces)))

    def run(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of a slice of texts: (n_a, n_b, n_groups) and digest of each, and the text and id pair of each link."""
        if self.held + 12 * len(self.key) + 4 * len(self.links) > self.MOST_BYTES:
            self.clear()
        # The first side meets a space before each text.
        filled = np.diff(offs) > 0
        data = np.insert(data, offs[:-1][filled], 32)
        offs = offs + np.concatenate(([0], np.cumsum(filled)))
        start = piece_starts(data, offs)
        end = np.append(start[1:], len(data))[: len(start)]
        hashes = Spans(data, _AS_IS).span(start, end)
        key, first = np.unique(hashes, return_index=True)
        new = np.ones(len(key), bool)
        if len(self.key):
            new = self.key[np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)] != key
        if new.any():
            whole = data.tobytes()
            self._learn(key[new], [whole[x:y] for x, y in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
        piece = self.index[np.searchsorted(self.key, hashes)]
        edge = np.searchsorted(start, offs)
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(edge))
        bad = np.zeros(len(offs) - 1, bool)
        bad[doc[~self.good[piece]]] = True
        upto = np.concatenate((np.zeros((1, 3), np.int64), np.cumsum(self.nums[piece], 0, dtype=np.int64)))
        nums = upto[edge[1:]] - upto[edge[:-1]]
        nums[bad] = 0
        groups, order = self.groups.__getitem__, piece.tolist()
        digests = [
            "" if skip or a == b else hashlib.sha256(b";".join(map(groups, order[a:b]))).hexdigest()
            for skip, a, b in zip(bad.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True)
        ]
        kept = ~bad[doc]
        doc, piece = doc[kept], piece[kept]
        size = self.begin[piece + 1] - self.begin[piece]
        before = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(self.begin[piece] - before, size)
        return nums, digests, np.repeat(doc, size), self.links[at]


ALIGNED = "flush long, stripe int, ids array<long>, nums binary, digests array<string>, codes binary, spread binary, docs binary, times binary"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _rows(rows: list[dict], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _KINDS[k]) for n, k in zip(names, kinds, strict=True)], names=list(names))


def _packed(keys: list, times: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their added times."""
    keys, times = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def _encode(first: str, second: str):
    """One row of texts' numbers, and one row of links for each stripe, for about FLUSH_LINKS links at a time."""

    def flush(name: int, size_a: int, ids: list, nums: list, digests: list, keys: list, times: list) -> pa.RecordBatch:
        rows = [{"flush": name, "stripe": -1, "ids": ids, "nums": np.concatenate(nums).astype(np.int64).tobytes(), "digests": digests}]
        key, n = _packed(keys, times)
        code, doc = (key >> np.uint64(16)).astype(np.int64), (key & np.uint64(MOST_DOCS - 1)).astype(np.uint16)
        stripe = code // (size_a * STRIPE)
        for lo, hi in _runs(stripe):
            own, spread = np.unique(code[lo:hi], return_counts=True)
            packed = {"codes": own.astype(np.uint32), "spread": spread.astype(np.uint32), "docs": doc[lo:hi], "times": n[lo:hi].astype(np.uint32)}
            rows.append({"flush": name, "stripe": int(stripe[lo])} | {k: v.tobytes() for k, v in packed.items()})
        return _rows(rows, ALIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, model = TaskContext.get().partitionId() << 32, Aligner.get(first, second)
        ids, nums, digests, keys, times, held = [], [], [], [], [], 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b, data, offs in slices(batch.column(1)):
                if held >= FLUSH_LINKS or len(ids) + b - a > MOST_DOCS:
                    yield flush(name, model.size_a, ids, nums, digests, keys, times)
                    ids, nums, digests, keys, times, held = [], [], [], [], [], 0
                    name += 1
                for low in range(a, b, MOST_DOCS):  # a slice of very short texts
                    high = min(b, low + MOST_DOCS)
                    part = offs[low - a : high - a + 1]
                    n, d, doc, code = model.run(data[part[0] : part[-1]], part - part[0])
                    if len(ids) + high - low > MOST_DOCS:
                        yield flush(name, model.size_a, ids, nums, digests, keys, times)
                        ids, nums, digests, keys, times, held = [], [], [], [], [], 0
                        name += 1
                    key, many = _packed([code.astype(np.uint64) << np.uint64(16) | (doc + len(ids)).astype(np.uint64)], [np.ones(len(code), np.int64)])
                    ids += names[low:high]
                    nums.append(n)
                    digests += d
                    keys.append(key)
                    times.append(many)
                    held += len(key)
        if ids:
            yield flush(name, model.size_a, ids, nums, digests, keys, times)

    return run


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of runs of equal numbers."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
    return list(zip(first.tolist(), np.append(first[1:], len(x)).tolist(), strict=True))


PAIRS = "stripe int, lot long, codes binary, counts binary"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a row without their texts: one count for each id pair."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            spread = np.frombuffer(r["spread"], np.uint32).astype(np.int64)
            counts = np.add.reduceat(np.frombuffer(r["times"], np.uint32).astype(np.int64), np.cumsum(spread) - spread)
            rows.append({"stripe": r["stripe"], "lot": r["lot"], "codes": r["codes"], "counts": counts.tobytes()})
        yield _rows(rows, PAIRS)


def _count(size_a: int):
    """A stripe's pairs added up in one dense block; non-zero cells go on."""

    def run(table: pa.Table) -> pa.Table:
        stripe = table.column("stripe")[0].as_py()
        block = np.zeros((STRIPE, size_a), np.int64)
        for codes, counts in zip(table.column("codes").to_pylist(), table.column("counts").to_pylist(), strict=True):
            b, a = np.divmod(np.frombuffer(codes, np.uint32).astype(np.int64), size_a)
            np.add.at(block, (b - stripe * STRIPE, a), np.frombuffer(counts, np.int64))
        b, a = np.nonzero(block)
        codes = ((b + stripe * STRIPE) * size_a + a).astype(np.uint32)
        row = {"stripe": stripe, "lot": table.column("lot")[0].as_py() // LOT, "codes": codes.tobytes(), "counts": block[b, a].tobytes()}
        return pa.Table.from_batches([_rows([row], PAIRS)])

    return run


SCORES = "flush long, docs binary, best binary, sums binary"


def _score(size_a: int):
    """For each row of links its texts' links that are best, and sums of counts, from the stripe's dense block."""

    def run(links: pa.Table, counted: pa.Table) -> pa.Table:
        if not len(links):
            return pa.Table.from_batches([_rows([], SCORES)])
        stripe = links.column("stripe")[0].as_py()
        block = np.zeros((STRIPE, size_a), np.int64)
        for codes, counts in zip(counted.column("codes").to_pylist(), counted.column("counts").to_pylist(), strict=True):
            b, a = np.divmod(np.frombuffer(codes, np.uint32).astype(np.int64), size_a)
            block[b - stripe * STRIPE, a] = np.frombuffer(counts, np.int64)
        most = block.max(axis=1)
        rows = []
        for r in links.select(["flush", "codes", "spread", "docs", "times"]).to_pylist():
            b, a = np.divmod(np.frombuffer(r["codes"], np.uint32).astype(np.int64), size_a)
            b -= stripe * STRIPE
            spread, doc = np.frombuffer(r["spread"], np.uint32), np.frombuffer(r["docs"], np.uint16)
            times = np.frombuffer(r["times"], np.uint32).astype(np.int64)
            count, best = block[b, a], block[b, a] == most[b]
            who, at = np.unique(doc, return_inverse=True)
            n_best, sums = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)
            np.add.at(n_best, at, times * np.repeat(best, spread))
            np.add.at(sums, at, times * np.repeat(count, spread))
            rows.append({"flush": r["flush"], "docs": who.tobytes(), "best": n_best.tobytes(), "sums": sums.tobytes()})
        return pa.Table.from_batches([_rows(rows, SCORES)])

    return run


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _gather(texts: pa.Table, scores: pa.Table) -> pa.Table:
    """The rows of one flush: what stripes scored, added up by text."""
    ids = texts.column("ids")[0].as_py()
    nums = np.frombuffer(texts.column("nums")[0].as_py(), np.int64).reshape(-1, 3)
    best, sums = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    for d, b, s in zip(*(scores.column(c).to_pylist() for c in ("docs", "best", "sums")), strict=True):
        d = np.frombuffer(d, np.uint16)
        best[d] += np.frombuffer(b, np.int64)
        sums[d] += np.frombuffer(s, np.int64)
    columns = [pa.array(ids, pa.int64()), *(pa.array(nums[:, k]) for k in (0, 1, 2, 2)), pa.array(best), pa.array(sums), texts.column("digests")[0].values]
    return pa.table(columns, names=[x.split()[0] for x in RESULT.split(", ")])


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``first``: path of a byte-level vocabulary of the tokenizers library, which gets the text after a space;
    ``second``: path of a sentencepiece model, which adds the space itself. Special tokens in texts are text.
    ``n_best`` counts the links whose id pair is linked as often in all texts as its second id is with any,
    ``count_sum`` adds up the links' numbers in all texts. No two tokens of a side end at one byte, so every group
    has one link. Groups are digested as ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and those that a side does not give back byte by byte, have zeros and an empty digest.
    Rows of null or repeated ids are rows like any other; an empty input gives an empty result; other columns are
    ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    made = scratch.write(rows.mapInArrow(_encode(first, second), ALIGNED), "aligned")
    size_a = Aligner.get(first, second).size_a
    texts = made.where("stripe < 0").select("flush", "ids", "nums", "digests")
    lots = max(1, -(-texts.count() // LOT))
    links = made.where("stripe >= 0").withColumn("lot", F.pmod(F.xxhash64("flush"), F.lit(lots)))
    counts, left = links.select("stripe", "lot", "codes", "spread", "times").mapInArrow(_fold, PAIRS), lots
    while True:
        counts = counts.groupBy("stripe", "lot").applyInArrow(_count(size_a), PAIRS)
        if left == 1:
            break
        left = -(-left // LOT)
    counts = scratch.write(counts.select("stripe", "codes", "counts"), "pair_counts")
    each = counts.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))))
    met = links.select("stripe", "lot", "flush", "codes", "spread", "docs", "times").groupBy("stripe", "lot").cogroup(each.groupBy("stripe", "lot"))
    scores = met.applyInArrow(_score(size_a), SCORES)
    return texts.groupBy("flush").cogroup(scores.groupBy("flush")).applyInArrow(_gather, RESULT)
