"""Fonts and colours that drawing operations use, through forms that draw forms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans import scratch
from quire.plans.joins import join_small

SHOWS = ("Tj", "TJ", "'", '"')
INVISIBLE = 3
EFFECTS = "stream string, kind string, name string, font string, own_font boolean, mode int, cmyk boolean"


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What streams do, whatever state they start in: text shown, forms drawn, CMYK set; a null mode is the caller's.

    Rows come stream by stream in their order; only the distinct effects of one stream are held.
    """
    names = [c.split()[0] for c in EFFECTS.split(", ")]
    types = [pa.string()] * 4 + [pa.bool_(), pa.int32(), pa.bool_()]
    made: list[tuple] = []

    def packed() -> pa.RecordBatch:
        columns = list(zip(*made, strict=True)) if made else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    at, started, font, own, mode, saved, out = None, False, None, False, None, [], set()
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("stream", "op", "name", "number")]
        for stream, op, name, number in zip(*columns, strict=True):
            if not started or stream != at:
                made += [(at, *effect) for effect in sorted(out, key=repr)]
                at, started, font, own, mode, saved, out = stream, True, None, False, None, [], set()
            if op == "q":
                saved.append((font, own, mode))
            elif op == "Q":
                font, own, mode = saved.pop() if saved else (font, own, mode)
            elif op == "Tr":
                mode = 0 if number is None or number != number else int(number)
            elif op == "Tf":
                font, own = name, True
            elif op in SHOWS:
                out.add(("show", None, font, own, mode, False))
            elif op == "Do" and name is not None:
                out.add(("draw", name, font, own, mode, False))
            elif op in ("k", "K") or op in ("cs", "CS") and name == "DeviceCMYK":
                out.add(("colour", None, None, True, 0, True))
        yield packed()
        made = []
    made = [(at, *effect) for effect in sorted(out, key=repr)]
    yield packed()


def effects(ops: DataFrame) -> DataFrame:
    """Distinct effects of streams of operations (stream, seq, op, name, number), each stream read once.

    q saves font and mode, Q brings them back (nothing if none is saved), Tr sets the mode (0 without a number), Tf the
    font's name. A stream is folded row by row in one task that holds no stream; what follows is joins over its few
    distinct effects.
    """
    rows = ops.select(F.col("stream").cast("string").alias("stream"), "seq", "op", "name", "number")
    return rows.repartition("stream").sortWithinPartitions("stream", F.col("seq").asc_nulls_last()).mapInArrow(_effects, EFFECTS)


def _same(a: str, b: str, columns: tuple[str, ...]) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return same


#: A use is one number: font * 4 + look, where font 0 is the caller's, and CMYK is a use of its own.
CMYK, UNSEEN, SEEN, CALLERS = -1, 0, 1, 2


def _look(mode: str) -> Column:
    return F.when(F.col(mode).isNull(), CALLERS).when(F.col(mode) == INVISIBLE, UNSEEN).otherwise(SEEN)


def font_use(ops: DataFrame, starts: DataFrame, forms: DataFrame, fonts: DataFrame, deepest: int = 12) -> DataFrame:
    """(root, font, visible, cmyk): fonts that each root's text uses, and one row with a null font if CMYK is set.

    ``starts`` are (root, stream, scope), ``fonts`` (scope, name, font) and ``forms`` (scope, name, stream, own_scope):
    what names stand for in a resource scope; a form with its own resources (``own_scope``) starts a new scope, else its
    caller's holds. Fonts are looked up where Tf stands, and font and mode go into the forms drawn after it. Text in
    mode INVISIBLE is not visible, all other is; a font may be both. Names that stand for nothing set no font and
    draw nothing. Forms are followed ``deepest`` levels down; one that draws itself again adds nothing new.

    What a stream in a scope shows is the same for all roots but for the font and mode it is called with, so uses go
    up from forms to their callers, once for each (stream, scope): a use whose font or look is the caller's takes it
    from the draw. Each level only sends up what is new. Roots meet the uses of their own stream at the end.
    """
    does = scratch.write(effects(ops), "effects").withColumnRenamed("stream", "s")
    fonts, forms = fonts.select("scope", "name", "font").distinct(), forms.select("scope", "name", "stream", "own_scope").distinct()
    numbers = scratch.write(fonts.where("font is not null").select("font").distinct().withColumn("no", F.monotonically_increasing_id() + 1), "fonts")
    n_effects, n_forms, n_fonts, n_named = does.count(), forms.count(), numbers.count(), fonts.count()
    named = join_small(fonts, numbers, "font", "inner", n_fonts, 60).select(F.col("scope").alias("fs"), F.col("name").alias("fn"), F.col("no").alias("found"))
    drawn = forms.select(F.col("scope").alias("ds"), F.col("name").alias("dn"), F.col("stream").alias("to"), "own_scope")
    starts = starts.select("root", "stream", "scope").distinct()

    def follow(draws: DataFrame) -> DataFrame:
        met = join_small(draws, drawn, (F.col("scope") == F.col("ds")) & (F.col("name") == F.col("dn")), "inner", n_forms, 120)
        return met.withColumn("scope", F.coalesce("own_scope", "scope")).withColumn("stream", F.col("to")).drop("ds", "dn", "to", "own_scope")

    place = ("stream", "scope")
    names = scratch.write(does.where("kind = 'draw'").select("s", "name").distinct(), "names")
    front = scratch.write(starts.select(*place).distinct(), "places")
    nodes = front
    for _ in range(deepest):
        nxt = follow(join_small(front, names, F.col("stream") == F.col("s"), "inner", n_effects, 60).select("scope", "name")).select(*place).distinct()
        front = scratch.write(nxt.alias("n").join(nodes.alias("s"), _same("n", "s", place), "left_anti"), "places")
        if front.isEmpty():
            break
        nodes = nodes.union(front)
    nodes = scratch.write(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    met = join_small(nodes, does, F.col("stream") == F.col("s"), "inner", n_effects, 120)
    met = join_small(met, named, (F.col("scope") == F.col("fs")) & (F.col("font") == F.col("fn")), "left", n_named, 120)
    met = met.select("node", "scope", "kind", "name", F.when(F.col("own_font"), F.coalesce("found", F.lit(-1))).otherwise(0).alias("font"), _look("mode").alias("look"), "cmyk")
    met = scratch.write(met, "met")
    # A font of -1 is none; text shown in it is no use.
    own = met.where("kind = 'show' and font >= 0").select("node", (F.col("font") * 4 + F.col("look")).alias("use"))
    own = own.union(met.where("cmyk").select("node", F.lit(CMYK).cast("long"))).distinct()
    edges = follow(met.where("kind = 'draw'").select("node", "scope", "name", "font", "look")).distinct()
    children = nodes.withColumnRenamed("node", "child")
    edges = edges.alias("e").join(children.alias("c"), _same("e", "c", place)).select("node", "child", "font", "look").distinct()
    edges = scratch.write(edges, "draws")
    plain = scratch.write(edges.select("node", "child").distinct(), "callers")
    sizes = edges.count(), plain.count()

    fresh = scratch.write(own, "uses")
    uses = fresh
    look, font = F.col("use") % 4, F.floor(F.col("use") / 4)
    open_ = (F.col("use") >= 0) & ((look == CALLERS) | (font == 0))
    for _ in range(deepest):
        below = fresh.withColumnRenamed("node", "child")
        up = join_small(below.where(~open_), plain, "child", "inner", sizes[1], 16).select("node", "use")
        taken = join_small(below.where(open_).select("child", font.alias("f"), look.alias("l")), edges, "child", "inner", sizes[0], 32)
        taken = taken.withColumn("f", F.when(F.col("f") == 0, F.col("font")).otherwise(F.col("f"))).where("f >= 0")
        taken = taken.select("node", (F.col("f") * 4 + F.when(F.col("l") == CALLERS, F.col("look")).otherwise(F.col("l"))).alias("use"))
        fresh = scratch.write(up.union(taken).distinct().join(uses, ["node", "use"], "left_anti"), "uses")
        if fresh.isEmpty():
            break
        uses = uses.union(fresh)
    # A root starts without a font, in mode 0.
    ended = uses.where(~open_ | (font > 0)).select("node", F.when(look == CALLERS, F.col("use") - CALLERS + SEEN).otherwise(F.col("use")).alias("use"))
    heads = starts.alias("r").join(nodes.alias("c"), _same("r", "c", place)).select("root", "node")
    every = heads.join(ended, "node").select("root", "use").distinct()
    every = every.select("root", F.when(F.col("use") >= 0, font).alias("no"), F.when(F.col("use") >= 0, look == SEEN).alias("visible"), (F.col("use") == CMYK).alias("cmyk"))
    return join_small(every, numbers, "no", "left", n_fonts, 60).select("root", "font", "visible", "cmyk")
