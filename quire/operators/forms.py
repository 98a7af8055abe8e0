"""Form fields and their places, and the text layer of recognised words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import glyphs
from quire.functions.text import upper_median
from quire.operators import trees
from quire.operators.fields import keep_with_descendants


def annotation_pages(listed: DataFrame, annotations: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, page_no): the first page that lists an annotation, else the one it names itself; null if neither is a page.

    ``listed`` are (page, id), ``annotations`` (id, page), ``pages`` (page, page_no).
    """
    first = listed.join(pages, "page").groupBy("id").agg(F.min("page_no").alias("listed_no"))
    own = pages.select("page", F.col("page_no").alias("own_no"))
    found = annotations.join(own, "page", "left").join(first, "id", "left")
    return found.select("id", F.coalesce("listed_no", "own_no").alias("page_no"))


def settle_fields(fields: DataFrame, on_page: DataFrame) -> DataFrame:
    """(node) of fields (node, parent, widget) that stay when pages are taken: those above a widget on a page (node) held.

    A field without anything below it stays unless it is a widget on no page held.
    """
    inner = fields.select(F.col("parent").alias("p")).where("p is not null").distinct()
    leaves = fields.join(inner, F.col("node") == F.col("p"), "left_anti")
    held = leaves.where("widget").join(on_page.select("node").distinct(), "node", "left_semi").select("node")
    return keep_with_descendants(fields, held.union(leaves.where(~F.coalesce("widget", F.lit(False))).select("node")))


def signed_counts(fields: DataFrame) -> DataFrame:
    """(node, signed) of top fields (node, parent, signature, has_value): signatures with a value in and below them."""
    own = (F.coalesce("signature", F.lit(False)) & F.coalesce("has_value", F.lit(False))).cast("long")
    below = trees.subtree_sums(fields, own)
    top = fields.where("parent is null").select(F.col("node").alias("n"), own.alias("own"))
    return below.join(top, F.col("node") == F.col("n")).select("node", (F.col("total") + F.col("own")).alias("signed"))


def detach_places(fields: DataFrame, places: DataFrame) -> DataFrame:
    """(field, place, name, value, problem): places of shared fields that become fields of their own, with their names.

    ``fields`` are (field, kind, n_places), ``places`` (ord, field, place from 1, value). A field in one place keeps its
    name. Others get the field's name with the place's number, or the next number whose name is free; places of one field
    are named in their order. A name that is a field's already is never free, so fields do not wait for each other
    unless one's name is made from another's, which the number after the space tells. Only text and choice fields can
    be filled by place.
    """
    asked = places.join(fields, "field", "left")
    problem = F.when(F.col("kind").isNull(), "no such field").when((F.col("place") < 1) | (F.col("place") > F.col("n_places")), "no such place")
    problem = problem.when(~F.col("kind").isin("text", "choice"), "cannot be filled by place")
    asked = asked.withColumn("problem", problem)
    number = F.regexp_extract("field", r"^(.*) ([1-9][0-9]{0,8})$", 2)
    taken = fields.where(number != "").select(F.regexp_extract("field", r"^(.*) ([1-9][0-9]{0,8})$", 1).alias("field"), number.cast("int").alias("n"))
    taken = taken.groupBy("field").agg(F.collect_set("n").alias("taken"))
    moved = asked.where("problem is null and n_places > 1").groupBy("field").agg(F.array_sort(F.collect_list(F.struct("ord", "place", "value"))).alias("p"))
    moved = moved.join(taken, "field", "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<int>")))
    none = F.array().cast("array<struct<place:int,value:string,n:int>>")

    def name(state, p):
        # Of at most size + 1 numbers from the place on, one is free.
        near = F.sequence(p["place"], p["place"] + F.size(state["taken"]))
        n = F.get(F.filter(near, lambda k: ~F.array_contains(state["taken"], k)), F.lit(0)).cast("int")
        return F.struct(F.concat(state["taken"], F.array(n)).alias("taken"), F.concat(state["made"], F.array(F.struct(p["place"].alias("place"), p["value"].alias("value"), n.alias("n")))).alias("made"))

    made = moved.select("field", F.explode(F.aggregate("p", F.struct(F.col("taken"), none.alias("made")), name, lambda s: s["made"])).alias("m"))
    named = made.select("field", "m.place", F.concat("field", F.lit(" "), F.col("m.n").cast("string")).alias("name"), "m.value", F.lit(None).cast("string").alias("problem"))
    rest = asked.where("problem is not null or n_places = 1").select("field", "place", F.when(F.col("problem").isNull(), F.col("field")).alias("name"), "value", "problem")
    return named.union(rest)


#: Parts of the em square above the baseline, of tall and of low letters, and below it.
TALL, LOW, BELOW = 0.72, 0.52, 0.21
TALL_LETTERS, LOW_LETTERS = r"[\p{Lu}0-9bdfhklt()\[\]{}/|!?$%&#@]|[^\x00-\x7F]", r"[gjpqy,;()\[\]{}|]"


def text_layer(words: DataFrame, px_per_point: float, page_height: float) -> DataFrame:
    """(page, seq, run, shown, size, stretch, x, y) of recognised words (page, seq, line, text, x, y, w, h), in points.

    Neighbouring words of one line number are a run; a run has one size and one baseline, the upper medians of what its
    words' boxes imply. The stretch brings a word's own width to its box. A word is followed by a space if another
    comes in its run; words of white space show nothing, but count for the run.
    """
    order = Window.partitionBy("page").orderBy("seq")
    new = F.coalesce(F.lag("line").over(order) != F.col("line"), F.lit(True))
    rows = words.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    tall, below = F.col("text").rlike(TALL_LETTERS), F.when(F.col("text").rlike(LOW_LETTERS), BELOW).otherwise(0.0)
    size = F.col("h") / (F.when(tall, TALL).otherwise(LOW) + below)
    rows = rows.withColumn("own_size", size).withColumn("own_base", F.col("y") + F.col("h") - below * size)
    run = Window.partitionBy("page", "run")
    rows = rows.withColumn("size_px", upper_median(F.collect_list("own_size").over(run))).withColumn("base_px", upper_median(F.collect_list("own_base").over(run)))
    rows = rows.withColumn("last", F.col("seq") == F.max("seq").over(run)).withColumn("plain", F.trim("text")).where("plain != ''")
    size = F.least(F.greatest(F.col("size_px") / px_per_point, F.lit(1.0)), F.lit(800.0))
    natural = F.nullif(glyphs.text_width(F.col("plain"), size), F.lit(0.0))
    stretch = F.coalesce(F.least(F.greatest(100 * (F.col("w") / px_per_point) / natural, F.lit(5.0)), F.lit(2000.0)), F.lit(100.0))
    shown = F.concat("plain", F.when(F.col("last"), "").otherwise(" "))
    return rows.select("page", "seq", "run", shown.alias("shown"), size.alias("size"), stretch.alias("stretch"), (F.col("x") / px_per_point).alias("x"), (page_height - F.col("base_px") / px_per_point).alias("y"))
