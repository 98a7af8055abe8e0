"""I-Match fingerprints, in DataFrame operations only.

The lexicon holds the terms whose document frequency lies in a band: at least LEAST and at most MOST
of all documents. Since a document with T distinct terms counts for T of them, the lexicon has at most
(mean distinct terms) / LEAST terms, whatever the number of documents; that is what is broadcast.
Randomised sub-lexicons keep a term with probability 1/8, 1/16, ... 1/1024, several of each rate,
decided by hashes of the term. For each one the document's sorted distinct terms in it are hashed.
Long documents agree on the sparse ones, short documents on the dense ones.

Likeness is the share of equal hashes among the sub-lexicons that either text has terms in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.plans import scratch
from quire.plans.blocks import blocks_of
from quire.plans.joins import is_small, join_small

LEAST, MOST = 0.002, 0.05
RATES = 8
COPIES = 8
DENSEST = 8
SEED = 17
ABOUT = "struct<doc_id:bigint,ghost:int,n_chars:bigint,edited_sha256:string,whole0:bigint,whole1:bigint>"


def terms(text: Column) -> Column:
    """Distinct lower-cased words of a text, split at ASCII white space."""
    return F.array_distinct(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+"))


def lexicon(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, subs): terms in the band over all documents, and the sub-lexicons that keep each.

    The empty term stands in for each text, in no sub-lexicon, so that a broadcast join keeps every text.
    """
    n = docs.count()
    often = (
        docs.select(F.explode(terms(F.col(text_col))).alias("term"))
        .where("term != ''")
        .groupBy("term")
        .agg(F.count("*").alias("df"))
        .where((F.col("df") >= max(2, LEAST * n)) & (F.col("df") <= max(2, MOST * n)))
    )
    # Written here, or Catalyst moves the filter on ``subs`` below the count, to every word of the corpus.
    often = scratch.write(often.select("term"), "band")
    subs = F.array_compact(
        F.array(
            *(
                F.when(F.pmod(F.xxhash64("term", F.lit(SEED + r * COPIES + c)), F.lit(DENSEST << r)) == 0, F.lit(r * COPIES + c))
                for r in range(RATES)
                for c in range(COPIES)
            )
        )
    )
    none = docs.sparkSession.range(1).select(F.lit("").alias("term"), F.array().cast("array<int>").alias("subs"))
    return scratch.write(often.select("term", subs.alias("subs")).where(F.size("subs") > 0).union(none), "lexicon")


def _code(found: Column, whole: Column) -> Column:
    """Sorted (sub-lexicon, hash of its terms in the text) of a (term, subs) list; if empty, one hash of the text."""
    rows = F.sort_array(F.flatten(F.transform(found, lambda t: F.transform(t["subs"], lambda s: F.struct(s.alias("sub"), t["term"].alias("term"))))))

    def entry(sub: Column, h: Column) -> Column:
        return F.struct(sub.alias("sub"), F.pmod(h, F.lit(1 << 32)).alias("h"))

    def state(sub: Column, h: Column, out: Column) -> Column:
        return F.struct(sub.cast("int").alias("sub"), h.cast("long").alias("h"), out.alias("out"))

    empty = F.array().cast("array<struct<sub:int,h:bigint>>")
    code = F.aggregate(
        rows,
        state(F.lit(-1), F.lit(0), empty),
        lambda s, x: F.when(s["sub"] == x["sub"], state(x["sub"], F.xxhash64(s["h"], x["term"]), s["out"])).otherwise(
            state(x["sub"], F.xxhash64(x["sub"], x["term"]), F.when(s["sub"] < 0, s["out"]).otherwise(F.concat(s["out"], F.array(entry(s["sub"], s["h"])))))
        ),
        lambda s: F.concat(s["out"], F.array(entry(s["sub"], s["h"]))),
    )
    return F.when(F.size(found) > 0, code).otherwise(F.array(entry(F.lit(-1), whole)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the sub-lexicons that either has."""
    used = F.size(F.array_distinct(F.concat(a["sub"], b["sub"])))
    return F.coalesce(F.size(F.array_intersect(a, b)) / used, F.lit(0.0))


def _text_code(code: Column) -> Column:
    return F.array_join(F.transform(code, lambda x: F.concat_ws(":", x["sub"].cast("string"), F.lower(F.hex(x["h"])))), " ")


def imatch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all,
    of the next document by descending id (after the last one: the first). Null texts are empty. A null
    id comes last in that order; rows of one id follow each other by a hash of their text. A text
    without lexicon terms is fingerprinted by its distinct terms as a whole. A single document is its
    own next. An empty input gives an empty result. Other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    lex = lexicon(rows)
    # A null id counts as the smallest one. Order: id, then a hash of the text, both descending.
    keyed = rows.withColumn("at", F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("h")))
    keyed = keyed.withColumn("blk", blocks_of(rows, "doc_id")("doc_id"))
    # Each block also gets the first document of the next block below it (the last one: of the first). Blocks
    # grow in number with the rows; this window sees one narrow row for each.
    firsts = keyed.groupBy("blk").agg(F.max("at").alias("at"))
    above = F.lag("blk").over(Window.orderBy(F.col("blk").desc()))
    lowest = F.min("blk").over(Window.orderBy(F.col("blk").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = scratch.write(firsts.select(F.col("at").alias("end"), F.coalesce(above, lowest).alias("home")), "ends")
    ghosts = (
        join_small(keyed, ends, F.col("at") == F.col("end"), "inner", ends.count(), 40)
        .dropDuplicates(["home"])
        .select("doc_id", "text", "at", F.col("home").alias("blk"), F.lit(1).alias("ghost"))
    )
    every = keyed.withColumn("ghost", F.lit(0)).select("doc_id", "text", "at", "blk", "ghost").unionByName(ghosts)
    below = Window.partitionBy("blk").orderBy("ghost", F.col("at").desc())
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    pairs = (
        every.withColumn("no", F.row_number().over(below))
        .withColumn("next", F.lead("text").over(below))
        .withColumn("edited", F.concat(F.expr("left(text, char_length(text) - floor(char_length(text) / 2))"), F.expr("left(coalesce(next, ''), cast(floor(char_length(text) / 2) as int))")))
    )
    versions = pairs.select(
        "blk", "no", "doc_id", "ghost", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        terms(F.col("text")).alias("t0"), F.when(F.col("ghost") == 0, terms(F.col("edited"))).alias("t1"),
    ).withColumns({f"whole{w}": F.xxhash64(F.sort_array(f"t{w}")) for w in (0, 1)})
    # One narrow row per term; what belongs to the document rides on the row of the empty term only.
    about = F.struct("doc_id", "ghost", "n_chars", "edited_sha256", "whole0", "whole1")

    def of_text(w: int) -> Column:
        own = F.array_remove(F.coalesce(f"t{w}", F.array().cast("array<string>")), "")
        return F.transform(own, lambda t: F.struct(F.lit(w).alias("which"), t.alias("term"), F.lit(None).cast(ABOUT).alias("about")))

    every_term = F.concat(
        F.array(F.struct(F.lit(0).alias("which"), F.lit("").alias("term"), about.alias("about"))),
        of_text(0), of_text(1),
    )
    one = versions.select("blk", "no", F.explode(every_term).alias("x")).select("blk", "no", "x.*")
    n_terms = lex.count()
    if is_small(n_terms, 80):
        with_subs = join_small(one, lex, "term", "inner", n_terms, 80)
    else:  # by shuffle: the empty term, which every text has, stays out of the exchange by terms
        heads = one.where("term = ''").withColumn("subs", F.array().cast("array<int>"))
        with_subs = one.where("term != ''").join(lex, "term").unionByName(heads)
    coded = with_subs.groupBy("blk", "no").agg(
        F.max("about").alias("about"),
        *(F.collect_list(F.when((F.col("which") == w) & (F.col("term") != ""), F.struct("term", "subs"))).alias(f"found{w}") for w in (0, 1)),
    ).select("blk", "no", "about.*", "found0", "found1")
    made = coded.select("blk", "no", "doc_id", "ghost", "n_chars", "edited_sha256", _code(F.col("found0"), F.col("whole0")).alias("f"), _code(F.col("found1"), F.col("whole1")).alias("e"))
    made = made.withColumn("f_next", F.lead("f").over(Window.partitionBy("blk").orderBy("no"))).where("ghost = 0")
    return made.select(
        "doc_id", "n_chars", "edited_sha256",
        _text_code(F.col("f")).alias("fingerprint"), _text_code(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.coalesce("f_next", "f")).alias("near_next"),
    )
