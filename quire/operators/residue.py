"""Search texts that can still be found somewhere: many needles over many texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import ALNUM
from quire.plans import scratch
from quire.plans.joins import join_small

#: Needles up to this size meet what is found by broadcast, more of them by shuffle.
MOST_NEEDLE_BYTES = 1 << 20
#: Bits of a filter for each hash, which sets two of them.
FILTER_BITS = 32
#: Distinct strings found that a task holds before it sends their counts on.
MOST_HELD = 200_000
#: Letters whose windows are hashed at once.
STEP = 1 << 18
#: Stands before, between and after texts; no letter or digit.
EDGE = "\U0010ffff"

_letters: list[tuple[np.ndarray, np.ndarray]] = []


def letters(spark: SparkSession) -> tuple[np.ndarray, np.ndarray]:
    """Rows (letter, least letter that matches it without regard to case), and first and last of ranges of ``ALNUM``.

    Code points; both are what Spark's patterns say of them, asked once.
    """
    if not _letters:
        code = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        points = spark.range(0x110000).where("id < 55296 or id > 57343").where(F.regexp_like(code, F.lit(ALNUM)))
        alnum = np.sort(points.toArrow().column(0).to_numpy())
        gap = np.flatnonzero(np.diff(alnum) > 1)
        ranges = np.stack((alnum[np.append(0, gap + 1)], alnum[np.append(gap, len(alnum) - 1)]), 1)
        maybe = {(c, m[0]) for c in map(chr, (i for i in range(0x110000) if not 0xD800 <= i < 0xE000)) for m in (c.lower(), c.upper(), c.upper().lower(), c.title(), c.casefold()) if m[0] != c}
        columns = [pa.array(x, pa.string()) for x in zip(*sorted(maybe), strict=True)]
        same = spark.createDataFrame(pa.table(columns, names=["a", "b"]))
        same = same.where(F.regexp_like(F.concat(F.lit("x"), "b"), F.concat(F.lit("^(?iu)x"), "a", F.lit("$")))).toArrow().to_pylist()
        least: dict[str, str] = {}

        def find(c: str) -> str:
            while c in least:
                c = least[c]
            return c

        for r in same:
            a, b = sorted((find(r["a"]), find(r["b"])))
            if a != b:
                least[b] = a
        _letters.append((np.array([(ord(c), ord(find(c))) for c in sorted(least)], np.uint32).reshape(-1, 2), ranges))
    return _letters[0]


def _folds(pairs: np.ndarray) -> np.ndarray:
    fold = np.arange(0x110000, dtype=np.uint32)
    fold[pairs[:, 0]] = pairs[:, 1]
    return fold


_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> _U(29))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(32))


def _windows(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(k, hashes of all windows of 2 ** k letters) for k from 0 on while there are any."""
    k, at = 0, _mix(codes.astype(_U) + _U(1))
    while len(at):
        yield k, at
        with np.errstate(over="ignore"):
            at = _mix(at[: -(1 << k)] * _U(3) + at[1 << k :])
        k += 1


def _first(at: np.ndarray, k: int) -> np.ndarray:
    """Keys of needles' starts: their first 2 ** k letters."""
    return _mix(at ^ _U(k + 1))


def _whole(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Keys of needles of n letters: two windows of more than half of it cover it."""
    with np.errstate(over="ignore"):
        return _mix(start * _U(5) + end + _U(n))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _text(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


def _class(n: int) -> int:
    return n.bit_length() - 1


KEYED = "needle string, match_case boolean, whole_words boolean, fold string, n int, key long, first long"


def _keys(pairs: np.ndarray):
    """Needles with what they match without regard to case, and their keys: of the whole and of the start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _folds(pairs)
        for batch in batches:
            needles = batch.column(0).to_pylist()
            sizes = np.array([len(x) for x in needles], np.int64)
            lot = np.cumsum(sizes) // STEP
            for a in np.flatnonzero(np.append(True, lot[1:] != lot[:-1])).tolist() if len(lot) else []:
                b = int(np.searchsorted(lot, lot[a], "right"))
                codes, n = fold[_codes("".join(needles[a:b]))], sizes[a:b]
                at, of = np.cumsum(n) - n, np.array([_class(int(x)) for x in n])
                key, first = np.zeros(b - a, _U), np.zeros(b - a, _U)
                for k, windows in _windows(codes):
                    if k > of.max():
                        break
                    own = np.flatnonzero(of == k)
                    start, end = windows[at[own]], windows[at[own] + n[own] - (1 << k)]
                    first[own] = _first(start, k)
                    for size in np.unique(n[own]).tolist():
                        here = n[own] == size
                        key[own[here]] = _whole(start[here], end[here], size)
                whole = _text(codes)
                folds = pa.array([whole[i : i + m] for i, m in zip(at.tolist(), n.tolist(), strict=True)], pa.string())
                columns = [c.slice(a, b - a) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*columns, folds, pa.array(n.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (key, first))], names=[x.split()[0] for x in KEYED.split(", ")])

    return run


def _filter(hashes: DataFrame) -> np.ndarray:
    """FILTER_BITS bits for each hash h, a power of two of them: those of its lower and upper half are set."""
    hashes = hashes.distinct()
    words = 1 << max(0, (hashes.count() * FILTER_BITS - 1) // 64).bit_length()
    place = hashes.select(F.explode(F.array(*(x.bitwiseAND(F.lit(words * 64 - 1)) for x in (F.col("h"), F.shiftrightunsigned("h", 32)))).cast("array<long>")).alias("p"))
    filled = place.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    bits = np.zeros(words, _U)
    bits[filled.column("w").to_numpy()] = filled.column("b").to_numpy().view(_U)
    return bits


def _known(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    hit = _U(1)
    for half in (keys, keys >> _U(32)):
        place = half & _U(len(bits) * 64 - 1)
        hit = hit & (bits[(place >> _U(6)).astype(np.int64)] >> (place & _U(63)))
    return hit > 0


def _finder(lengths: list[int], starts: np.ndarray, plain: np.ndarray, cased: np.ndarray, pairs: np.ndarray, ranges: np.ndarray):
    """Strings of texts that may be needles, with the number of a task's texts that hold them and their least id.

    ``starts``, ``plain`` and ``cased`` are filters: of starts of needles, of whole needles without and with regard to
    case. Strings are folded in the kinds 0 and 1, as they are in 2 and 3; those of 1 and 3 stand between no letters or
    digits. Where an id has several texts (``many``), each string of a text is a row without a number.
    """
    by_class: dict[int, list[int]] = {}
    for n in lengths:
        by_class.setdefault(_class(n), []).append(n)
    top, overlap = max(by_class, default=-1), max(lengths, default=1) - 1

    def windows(folded: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(n, starts of windows of n letters, whether plain needles, whether cased ones)."""
        for j in range(0, len(folded), STEP):
            piece = folded[j : j + STEP + overlap]
            for k, at in _windows(piece):
                if k > top:
                    break
                if k in by_class:
                    begin = np.flatnonzero(_known(starts, _first(at[:STEP], k)))
                    for n in by_class[k]:
                        some = begin[begin + n <= len(piece)]
                        keys = _whole(at[some], at[some + n - (1 << k)], n)
                        p, c = _known(plain, keys), _known(cased, keys)
                        met = np.flatnonzero(p | c)
                        yield n, some[met] + j, p[met], c[met]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, inner, serial = _folds(pairs), np.zeros(0x110000, bool), 0
        for a, b in ranges.tolist():
            inner[a : b + 1] = True
        held: list[dict[str, list]] = [{} for _ in range(4)]
        single: set[tuple] = set()
        kind_of_id = pa.string()

        def sent() -> pa.RecordBatch:
            rows = [(k, t, n, i) for k, of in enumerate(held) for t, (n, i, _) in of.items()] + [(k, t, None, i) for k, t, i in single]
            for of in held:
                of.clear()
            single.clear()
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = (pa.int32(), pa.string(), pa.int64(), kind_of_id)
            return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, kinds, strict=True)], names=["kind", "found", "n", "id"])

        for batch in batches:
            ids, texts, many = (c.to_pylist() for c in batch.columns)
            kind_of_id = batch.column(0).type
            if not texts:
                continue
            whole = EDGE + EDGE.join(texts) + EDGE
            codes = _codes(whole)
            folded = fold[codes]
            text = _text(folded)
            size = np.array([len(t) for t in texts], np.int64)
            ends = np.cumsum(size + 1)
            for n, at, p, c in windows(folded):
                own = np.searchsorted(ends, at)  # the first text that ends at the window's start or later
                whole_in = np.flatnonzero((at > 0) & (at + n <= ends[np.minimum(own, len(ends) - 1)]))
                at, own, p, c = at[whole_in], own[whole_in], p[whole_in], c[whole_in]
                word = ~(inner[codes[at - 1]] | inner[codes[at + n]])
                for i, o, w, is_p, is_c in zip(at.tolist(), own.tolist(), word.tolist(), p.tolist(), c.tolist(), strict=True):
                    for kind, given in ((0, text), (2, whole)):
                        if is_c if kind else is_p:
                            t, x = given[i : i + n], ids[o]
                            for k in (kind, kind + 1) if w else (kind,):
                                if many[o]:
                                    single.add((k, t, x))
                                    continue
                                e = held[k].get(t)
                                if e is None:
                                    e = held[k][t] = [0, None, -1]
                                if e[2] != serial + o:
                                    e[2] = serial + o
                                    if x is not None:
                                        e[0] += 1
                                        e[1] = x if e[1] is None else min(x, e[1])
            serial += len(texts)
            if sum(map(len, held)) + len(single) > MOST_HELD:
                yield sent()
        yield sent()

    return run


def residue(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle, match_case, whole_words, n_texts, first_id): needles that texts still hold.

    ``texts`` are (id, text), ``needles`` (needle, match_case, whole_words); white space of a needle counts as one
    space, empty ones are left out, nulls are false. Each text is read once, however many needles there are: hashes
    of its windows are looked up in filters of the needles' hashes, and the strings of those that may be needles are
    counted in the task. Only counts leave it and meet the needles, by the whole string; no text does. What letters match
    is asked from Spark's patterns. The filters, FILTER_BITS bits a hash, pass through the driver. No needle is left out.
    """
    pairs, ranges = letters(texts.sparkSession)
    plain = F.trim(F.regexp_replace("needle", r"\s+", " "))
    asked = needles.select(plain.alias("needle"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("match_case", "whole_words"))).where("needle != ''").distinct()
    asked = scratch.write(asked.mapInArrow(_keys(pairs), KEYED), "needles")
    filters = [_filter(asked.select(F.col(c).alias("h")).where(x)) for c, x in (("first", F.lit(True)), ("key", ~F.col("match_case")), ("key", F.col("match_case")))]
    lengths = sorted(r["n"] for r in asked.select("n").distinct().collect())

    texts = texts.select("id", "text").where("text is not null")
    twice = scratch.write(texts.groupBy("id").count().where("count > 1 and id is not null").select(F.col("id").alias("twice")), "twice")
    if n := twice.count():
        texts = join_small(texts, twice, F.col("id") == F.col("twice"), "left", n, 40)
        texts = texts.select("id", "text", F.col("twice").isNotNull().alias("many"))
    else:
        texts = texts.withColumn("many", F.lit(False))
    schema = f"kind int, found string, n long, id {texts.schema['id'].dataType.simpleString()}"
    found = texts.mapInArrow(_finder(lengths, *filters, pairs, ranges), schema)
    found = scratch.write(found.groupBy("kind", "found", F.when(F.col("n").isNull(), F.col("id")).alias("one")).agg(F.coalesce(F.sum("n"), F.lit(1)).alias("n"), F.min("id").alias("id")), "found")
    found = found.groupBy("kind", "found").agg(F.sum("n").alias("n_texts"), F.min("id").alias("first_id"))

    kind = F.col("match_case").cast("int") * 2 + F.col("whole_words").cast("int")
    rules = asked.select("needle", "match_case", "whole_words", kind.alias("kind"), F.when(F.col("match_case"), F.col("needle")).otherwise(F.col("fold")).alias("found"))
    size = rules.agg(F.sum(F.octet_length("needle") + F.octet_length("found")).alias("b"), F.count("*").alias("n"), F.max(F.octet_length("needle")).alias("most")).first()
    small = size["n"] if (size["b"] or 0) <= MOST_NEEDLE_BYTES else 1 << 40
    held = join_small(found, rules, ["kind", "found"], "inner", small, 2 * (size["most"] or 0) + 16)
    return held.select("needle", "match_case", "whole_words", "n_texts", "first_id")


def ascii_contains(content: Column, needle: Column, match_case: Column) -> Column:
    """Whether raw content holds a needle of ASCII letters; A-Z count as a-z unless ``match_case``, other bytes as they are."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.octet_length(needle) == F.char_length(needle)
    fold = F.contains(F.translate(content, upper, lower), F.translate(needle, upper, lower))
    return plain & (needle != "") & F.when(match_case, F.contains(content, needle)).otherwise(fold)
