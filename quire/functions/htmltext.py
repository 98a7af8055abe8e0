"""HTML sources as native string expressions: remote references, base and style injection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a reference to another host looks like in lower-cased source.
REMOTE = [
    'src="http', "src='http", "src=http", 'src="//', "src='//", "url(http", 'url("http', "url('http", "url(//", '@import "http', "@import 'http", 'rel="stylesheet" href="http',
]


def refers_to_remote(source: Column) -> Column:
    """True if the page would load something from another host."""
    low = F.lower(source)
    out = F.lit(False)
    for piece in REMOTE:
        out = out | F.contains(low, F.lit(piece))
    return out


def inject(source: Column, base: str, style: str) -> Column:
    """<base> after <head>, else after <html>, else after the doctype, else first; <style> before </head>, else
    before </body>, else last. An existing <base> is kept."""
    low = F.lower(source)

    def after(pattern: str) -> Column:
        return F.regexp_extract(source, f"(?is)^(.*?{pattern})", 1)

    tag = F.lit(f'<base href="{base}">')
    head = F.coalesce(*(F.nullif(after(p), F.lit("")) for p in (r"<head(?:\s[^>]*)?>", r"<html(?:\s[^>]*)?>", r"<!doctype[^>]*>")), F.lit(""))
    based = F.when(low.rlike(r"<base[\s>]"), source).otherwise(F.concat(head, tag, F.substr(source, F.char_length(head) + 1)))
    lower = F.lower(based)
    sheet = F.lit(f"<style>{style}</style>")
    close, body = (F.regexp_instr(lower, F.lit(rf"</{t}\s*>")) for t in ("head", "body"))
    end = F.when(close > 0, close).otherwise(body)
    return F.when(end > 0, F.concat(F.substr(based, F.lit(1), end - 1), sheet, F.substr(based, end))).otherwise(F.concat(based, sheet))
