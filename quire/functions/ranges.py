"""Page ranges: ``1-3,7,last`` selects pages in the given order, repeats included."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class RangeError(ValueError):
    """A range that names no page or is not understood."""


def _parts(spec: str) -> list[tuple[str, str | None, str | None]]:
    """(word or '-', low, high) of each part; low and high are digits, 'last' or None."""
    out = []
    for part in (p.strip().lower() for p in re.split("[,;]", spec)):
        if not part:
            continue
        if part in ("all", "odd", "even"):
            out.append((part, None, None))
        elif m := re.fullmatch(r"(\d+|last|end)?\s*(-)?\s*(\d+|last|end)?", part):
            low, dash, high = m.groups()
            if not dash and (low is None or high is not None):
                raise RangeError(f"'{part}' is not a page range")
            low, high = ("last" if b == "end" else b for b in (low, high))
            out.append(("-", low, high) if dash else ("-", low, low))
        else:
            raise RangeError(f"'{part}' is not a page range")
    return out


def parse(spec: str, n: int) -> list[int]:
    """Pages of a file of ``n`` pages; an empty spec is all of them."""
    parts = _parts(spec)
    if not parts:
        return list(range(1, n + 1))
    out: list[int] = []
    for word, low, high in parts:
        if word != "-":
            out += [p for p in range(1, n + 1) if word == "all" or p % 2 == (word == "odd")]
            continue
        a, b = (default if x is None else n if x == "last" else int(x) for x, default in ((low, 1), (high, n)))
        if not (1 <= a <= n and 1 <= b <= n):
            raise RangeError(f"pages {a}-{b} are not all in 1-{n}")
        out += range(a, b + 1) if a <= b else range(a, b - 1, -1)
    if not out:
        raise RangeError("the range has no pages")
    return out


def pages_of(spec: str, n: Column) -> Column:
    """The same as an array column for files of ``n`` pages; null where ``parse`` would raise."""
    parts = _parts(spec)
    every = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    if not parts:
        return every
    arrays, valid = [], F.lit(True)
    for word, low, high in parts:
        if word != "-":
            arrays.append(every if word == "all" else _parity(every, word))
            continue
        a = F.lit(1) if low is None else n if low == "last" else F.lit(int(low))
        b = n if high in (None, "last") else F.lit(int(high))
        fits = (a >= 1) & (a <= n) & (b >= 1) & (b <= n)
        valid = valid & fits
        arrays.append(F.when(fits, F.sequence(a, b)))
    found = F.concat(*arrays)
    return F.when(valid & (F.size(found) > 0), found)


def _parity(pages: Column, word: str) -> Column:
    want = 1 if word == "odd" else 0
    return F.filter(pages, lambda p: p % 2 == want)


def format_pages(pages: list[int]) -> str:
    """``1-3, 7``: runs that go up by one, in the given order."""
    runs: list[list[int]] = []
    for p in pages:
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return ", ".join(str(a) if a == b else f"{a}-{b}" for a, b in runs)


def format_ranges(rows, key: str = "doc_id", order: str = "ord", page: str = "page_no"):
    """The same per key, for rows (key, order, page): gaps and islands on neighbours, not on page - rank."""
    by = Window.partitionBy(key).orderBy(order)
    new = F.when(F.lag(page).over(by) + 1 == F.col(page), 0).otherwise(1)
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(by))
    ends = runs.groupBy(key, "_run").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return ends.groupBy(key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_run", text.alias("t")))), lambda x: x["t"]), ", ").alias("ranges")
    )
