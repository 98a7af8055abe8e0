"""URL filter: rules first, then word segmentation of hosts and naive Bayes.

Names in urls are written without spaces. A unigram model, counted over all words of all texts, splits a run of
letters into the words of the greatest total probability (Viterbi). Host words and path tokens, told apart by a
prefix, are the tokens of a multinomial naive Bayes classifier. It learns from the urls that the rules decide
and judges the others.

Neither vocabulary is cut or broadcast whole. Each distinct run of letters meets, in a Spark join, the counts of
the words that stand in it: its own stretches of up to ANCHOR letters, and longer words by their first ANCHOR
letters. It is split once, with those words; urls then look up their runs. Token counts come from counts of
runs, so a run that a third of all urls have is counted before anything is joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.exact_dedup import LOWER, UPPER
from quire.plans import scratch
from quire.plans.joins import join_small

ANCHOR = 24

#: (verdict, host suffix, start of the path)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ? or #, A-Z lower-cased; path: then up to ? or #; else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def by_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits host or a parent of it and starts the path; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, suffix, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == suffix) | F.endswith(host, F.lit("." + suffix))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(suffix + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of all words of all texts: lower-cased runs of letters."""
    word = F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+")).alias("word")
    return texts.select(word).where("word != ''").groupBy("word").agg(F.count("*").alias("n"))


def runs_of(host: Column, path: Column) -> Column:
    """(kind, run) of a url in order: letters or digits of the host's labels but the last, then of the path."""
    labels = F.split(host, r"\.")
    labels = F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0)))

    def runs(names: Column, kind: str) -> Column:
        found = F.flatten(F.transform(names, lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"\p{N}+|\p{L}+"), F.lit(0))))
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("run")))

    return F.concat(runs(labels, "h"), runs(F.array(path), "p"))


def segment(name: str, cost: dict[str, float], unknown: float) -> list[str]:
    """The words of least total cost; a letter that no word covers costs ``unknown``."""
    n, sizes = len(name), sorted({1, *map(len, cost)})
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        for size in sizes:
            i = j - size
            if i < 0:
                break
            c = cost.get(name[i:j])
            if c is None:
                if size > 1:
                    continue
                c = unknown
            if best[i] + c < best[j]:
                best[j], back[j] = best[i] + c, i
    out, j = [], n
    while j:
        i = back[j]
        out.append(name[i:j])
        j = i
    return out[::-1]


def _segment_all(total: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.append(segment(name, {w["word"]: math.log(total / w["n"]) for w in words or []}, math.log(total) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["run", "words"])

    return run


def segments(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) of distinct runs of letters, by the counts (word, n) of all words."""
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 1
    size = F.char_length("run")
    at = runs.select("run", size.alias("size"), F.explode(F.sequence(F.lit(1), size)).alias("at"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(ANCHOR), F.col("size") - F.col("at") + 1))
    short = at.select("run", F.explode(F.transform(lengths, lambda k: F.substring("run", F.col("at"), k))).alias("word")).distinct()
    short = short.join(counts, "word").select("run", "word", "n")
    long = counts.where(F.char_length("word") > ANCHOR).withColumn("start", F.substring("word", 1, ANCHOR))
    fits = F.substring("run", F.col("at"), F.char_length("word")) == F.col("word")
    anchors = at.where(F.col("size") - F.col("at") >= ANCHOR).withColumn("start", F.substring("run", F.col("at"), F.lit(ANCHOR)))
    long = anchors.join(long, "start").where(fits).select("run", "word", "n").distinct()
    found = short.union(long).groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    return runs.join(found, "run", "left").mapInArrow(_segment_all(float(total)), "run string, words array<string>")


def judge(
    pages: DataFrame,
    texts: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    text_col: str = "text",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score, words.

    ``score`` is the classifier's log odds for block (of every page), ``words`` its tokens: h:word of each host
    label but the last, p:word of the path; digits count as their number. Without a rule, block is the verdict if
    the score is above 0. A null url, or one without ://, has an empty host and path and no tokens; it gets the
    prior's verdict. If the rules decide no url as one of the two verdicts, all scores are 0 and the others are
    allowed. Urls of any length are split whole. Rows are judged one by one: null and repeated ids come back as
    they are. An empty input gives an empty result.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", by_rule(F.col("host"), F.col("path"), rules)).withColumn("no", F.monotonically_increasing_id())
    rows = scratch.write(rows, "urls")
    each = rows.select("no", "found", F.posexplode(runs_of(F.col("host"), F.col("path"))).alias("at", "x")).select("no", "found", "at", "x.*")
    block = F.col("found.verdict") == "block"
    runs = each.groupBy("kind", "run").agg(F.count_if(block).alias("b"), F.count_if(~block).alias("a"))
    runs = scratch.write(runs, "runs")
    letters = runs.where(~F.col("run").rlike(r"^\p{N}")).select("run").distinct()
    split = segments(letters, scratch.write(word_counts(texts, text_col), "words"))
    digits = F.array(F.concat(F.lit("#"), F.least(F.char_length("run"), F.lit(9)).cast("string")))
    split = runs.join(split, "run", "left").withColumn("words", F.coalesce("words", digits))
    tokens = F.transform("words", lambda w: F.concat("kind", F.lit(":"), w))
    split = scratch.write(split.select("kind", "run", "a", "b", tokens.alias("tokens")), "split")

    n = {r["block"]: r["n"] for r in rows.where("found is not null").groupBy(block.alias("block")).agg(F.count("*").alias("n")).collect()}
    seen = split.select(F.explode("tokens").alias("token"), "a", "b").groupBy("token").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    seen = scratch.write(seen.where("a + b > 0"), "tokens")
    size, all_a, all_b = seen.agg(F.count("*") + 1, F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    start, odds = 0.0, F.lit(0.0)
    if len(n) == 2:
        start = math.log(n[True] / n[False])
        a, b = (F.coalesce(c, F.lit(0)) + 1 for c in ("a", "b"))
        odds = F.log(b / (all_b + size)) - F.log(a / (all_a + size))
    scores = split.select("kind", "run", F.explode("tokens").alias("token")).join(seen, "token", "left").groupBy("kind", "run").agg(F.sum(odds).alias("odds"))
    scored = scratch.write(split.select("kind", "run", "tokens").join(scores, ["kind", "run"]), "scored")
    about = scored.agg(F.count("*"), F.max(F.octet_length("run") + F.octet_length(F.array_join("tokens", " ")))).first()
    met = join_small(each.select("no", "at", "kind", "run"), scored, ["kind", "run"], "inner", about[0], 100 + (about[1] or 0))
    by_row = met.groupBy("no").agg(F.sum("odds").alias("odds"), F.sort_array(F.collect_list(F.struct("at", "tokens"))).alias("t"))
    whole = rows.join(by_row, "no", "left")
    whole = whole.withColumn("score", F.lit(start) + F.coalesce("odds", F.lit(0.0)))
    return whole.select(
        "page_id",
        "host",
        "path",
        "found.rule",
        F.coalesce("found.verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"),
        "score",
        F.coalesce(F.array_join(F.flatten("t.tokens"), " "), F.lit("")).alias("words"),
    )
