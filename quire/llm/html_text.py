"""Main text of web pages by container paths on which the pages of a host agree.

1. Each page's containers are scored: a container's share of the page's running text outside links, own
   blocks in full, those of its children by half. The best one is lifted to an enclosing article or main, or
   to a parent that adds headings only.
2. Its path of generalised tags (tag.class without digits) is the page's vote; votes are weighted by how
   much of the page's text the container holds, and added up per host in Spark.
3. Pages are extracted again with their host's winning path. A page without that path uses its own best one.

Menus, headers, footers, side bars, notices, adverts, forms and reader comments are candidates by tag, by role, or
by a class or id name all of whose words say so (``sidebar``, ``ad-slot``, but not ``has-sidebar``). A candidate is
left out unless it holds a main element, or holds most of the page's text while next to nothing stands outside
the candidates: then it is the page, and what lies in it is judged by itself.

One pass reads a page. Open elements are at most DEEPEST; start tags beyond that do not nest, as in browsers.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.url_filter import host_and_path
from quire.plans import scratch
from quire.plans.joins import join_small

# Tags of HTML by kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template textarea title iframe noscript svg math object canvas audio video".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
CONTAINER = set("article body div main section td".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
DROPPED = set("nav footer aside form button select menu dialog label".split())
# Words of class and id names, and roles, of what is not the article.
NOISE = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices "
    "pager pagination popup promo promotion promoted recommended related reply replies respond search share sharing sidebar "
    "signup social sponsor sponsored subscribe toolbar widget widgets alert overlay paywall".split()
)
COMMENTS = set("comment comments disqus reply replies respond".split())
#: Words that may stand next to those in a name that still says noise.
NEUTRAL = set(
    "area article articles bar block blog body bottom box button buttons col column container content footer form global group "
    "inner item items l left links list main module page post posts primary r right row secondary section site slot sticky the top "
    "unit user users wrap wrapper".split()
)
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu navigation search".split())
DEEPEST = 400
#: An end tag of an inline element, and what a new paragraph ends, stays inside these.
BARRIER = CONTAINER | set("li dd dt th blockquote".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)>""", re.S)
#: One attribute, its name and its value: what stands in a value is no name.
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_READ = set("class id role hidden".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def says_noise(name: str) -> str:
    """'' for a class or id name of the page's own; else 'noise', 'comments' or 'header'."""
    words = {w.lower() for w in _WORD.findall(name)}
    telling = words & NOISE
    if not telling or words - NOISE - NEUTRAL:
        return ""
    return "comments" if telling & COMMENTS else "header" if telling <= {"header", "masthead"} else "noise"


class _Open:
    """An open element: its tag, container, innermost candidate for noise, and what holds for text in it."""

    __slots__ = ("article", "box", "heading", "heads", "link", "noise", "tag")

    def __init__(self, tag: str, box: int, noise: int, link: bool, heading: bool, heads: bool, article: bool):
        self.tag, self.box, self.noise, self.link, self.heading, self.heads, self.article = tag, box, noise, link, heading, heads, article


class Page:
    """Containers (tag, path, parent) and text blocks (text, container, letters in links, heading) of one page."""

    def __init__(self, source: str):
        self.tags, self.labels, self.parents = ["html"], [""], [-1]
        self.keys = [b""]
        #: Candidates for noise: the one around it, whether of comments, whether a main stands in it.
        self.around, self.comments, self.holds_main = [-1], [False], [False]
        found: list[tuple[str, int, int, bool, int]] = []
        self._found = found
        self._stack = [_Open("html", 0, 0, False, False, False, False)]
        self._open = Counter(["html"])
        self._text: list[str] = []
        self._link = 0
        self._read(source)
        stands = self._standing()
        self.blocks = [x[:4] for x in found if not stands[x[4]]]

    def _standing(self) -> list[bool]:
        """For each candidate whether text in it is left out (0 stands for no candidate)."""
        n = len(self.around)
        inside = [0] * n
        for text, _, _, _, k in self._found:
            inside[k] += len(text)
        own = list(inside)
        children: list[list[int]] = [[] for _ in range(n)]
        for k in range(n - 1, 0, -1):
            inside[self.around[k]] += inside[k]
            children[self.around[k]].append(k)
            self.holds_main[self.around[k]] |= self.holds_main[k]
        out, free = [True] * n, own[0]
        out[0] = False
        todo = list(children[0])
        for k in todo:  # a candidate with a main is the page
            if self.holds_main[k]:
                out[k], free = False, free + own[k]
                todo += children[k]
        todo = [k for k in todo if out[k]]
        while todo:
            most = max(todo, key=lambda k: (inside[k], -k))
            if self.comments[most] or 2 * inside[most] <= inside[0] or 5 * free >= inside[0]:
                break
            out[most], free = False, free + own[most]
            todo = children[most]  # it holds more than half, so no other outer one can
        return out

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                top = self._stack[-1]
                self._found.append((text, top.box, self._link, top.heading, top.noise))
            self._text, self._link = [], 0

    def _say(self, text: str) -> None:
        top = self._stack[-1]
        if text and (not top.heads or top.heading):
            text = entities.unescape(text) if "&" in text else text
            self._text.append(text)
            if top.link:
                self._link += len(text.strip())

    def _pop_to(self, at: int) -> None:
        for e in self._stack[at:]:
            self._open[e.tag] -= 1
        del self._stack[at:]

    def _close_before(self, tag: str) -> None:
        """What the start of a block ends: an open paragraph or heading, an item of the same list, a cell."""
        for i in range(len(self._stack) - 1, 0, -1):
            kind = self._stack[i].tag
            if kind == "p" or (kind in HEADING and tag in HEADING):
                self._pop_to(i)
                break
            if kind in BARRIER:
                break
        if tag in ("li", "dd", "dt", "td", "th", "tr"):
            same = ("dd", "dt") if tag in ("dd", "dt") else ("td", "th") if tag in ("td", "th") else (tag,)
            stop = ("ul", "ol", "menu", "dl", "table", "tbody", "thead", "tfoot", *(("tr",) if tag in ("td", "th") else ()))
            if any(self._open[t] for t in same):
                for i in range(len(self._stack) - 1, 0, -1):
                    if self._stack[i].tag in same:
                        self._pop_to(i)
                        break
                    if self._stack[i].tag in stop:
                        break

    def _start(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self._flush()
            self._close_before(tag)
        top = self._stack[-1]
        names: dict[str, str] = {}
        if attrs and ("=" in attrs or "hidden" in attrs.lower()):
            for k, a, b, c in _ATTR.findall(attrs):
                if (k := k.lower()) in _READ:
                    names.setdefault(k, entities.unescape(a or b or c))
        if tag in VOID:
            if tag == "br":
                self._say(" ")
            return
        kinds = {says_noise(x) for k in ("class", "id") for x in names.get(k, "").split()} - {""}
        noise, heads = False, top.heads
        if tag in ("article", "main"):
            noise = tag == "article" and "comments" in kinds or "hidden" in names
            self.holds_main[top.noise] |= tag == "main" and not noise
        elif tag not in ("html", "body"):
            role = names.get("role", "").lower()
            noise = tag in DROPPED or bool(kinds - {"header"}) or role in ROLES or "hidden" in names
            if tag == "header" or ("header" in kinds and tag not in HEADING):
                heads |= top.article
                noise |= not top.article
        if len(self._stack) > DEEPEST:
            return
        inner = top.noise
        if noise:
            self.around.append(top.noise)
            self.comments.append("comments" in kinds or self.comments[top.noise])
            self.holds_main.append(False)
            inner = len(self.around) - 1
        box = top.box
        if tag in CONTAINER:
            label = tag + "".join(f".{x}" for x in sorted({re.sub(r"\d+", "", c) for c in names.get("class", "").lower().split()} - {""}))
            self.tags.append(tag)
            self.labels.append(label)
            self.keys.append(hashlib.blake2b(self.keys[box] + b">" + label.encode(errors="replace"), digest_size=16).digest())
            self.parents.append(box)
            box = len(self.tags) - 1
        article = top.article or tag in ("article", "main")
        self._stack.append(_Open(tag, box, inner, top.link or tag == "a", top.heading or tag in HEADING, heads, article))
        self._open[tag] += 1

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        if tag == "html" or not self._open[tag]:
            return
        inline = tag not in BLOCK or tag == "p" or tag in HEADING
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i].tag == tag:
                self._pop_to(i)
                return
            if inline and self._stack[i].tag in BARRIER:
                return

    def _chain(self, box: int) -> Iterator[int]:
        while box >= 0:
            yield box
            box = self.parents[box]

    def _read(self, source: str) -> None:
        at, last = 0, source.rfind(">")
        while True:
            m = _TAG.search(source, at) if at <= last or source.find("<!--", at) >= 0 else None
            if m is None:
                self._say(source[at:])
                break
            self._say(source[at : m.start()])
            at = m.end()
            tag = m[2]
            if not tag:
                continue
            tag = tag.lower()
            if m[1]:
                self._end(tag)
            elif tag in RAW:
                if not m[3].endswith("/"):
                    found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                    end = -1 if found is None else source.find(">", found.end())
                    if end < 0:
                        break
                    at = end + 1
            else:
                self._start(tag, m[3])
                if m[3].endswith("/") and tag not in VOID and tag not in BLOCK and len(self._stack) > 1 and self._stack[-1].tag == tag:
                    self._pop_to(len(self._stack) - 1)
        self._flush()

    def best(self) -> tuple[int, float]:
        """The best container and its share of the text (no text: 0, 0)."""
        own: dict[int, float] = defaultdict(float)
        heads_only: dict[int, bool] = defaultdict(lambda: True)
        held = [0] * len(self.parents)
        for text, box, link, heading in self.blocks:
            own[box] += max(0, len(text) - 2 * link) * (0.5 if heading else 1)
            held[box] += len(text)
            heads_only[box] &= heading
        for box in range(len(held) - 1, 0, -1):
            held[self.parents[box]] += held[box]
        if not held[0]:
            return 0, 0.0
        score = dict(own)
        for box, w in own.items():
            if self.parents[box] >= 0:
                score[self.parents[box]] = score.get(self.parents[box], 0) + w / 2
        box = max(score, key=lambda b: (score[b], -b))
        chain = list(self._chain(box))
        inside = next((b for kind in ("article", "main") for b in chain if self.tags[b] == kind), None)
        if inside is not None:
            box = inside
        else:
            if self.tags[box] == "section" and self._has_peer(box, held):
                box = self.parents[box]
                chain = list(self._chain(box))
            for up in chain[1:]:
                if self.tags[up] in ("body", "html") or up not in own or not heads_only[up]:
                    break
                box = up
        return box, held[box] / held[0]

    def _has_peer(self, box: int, held: list[int]) -> bool:
        """Whether a section beside this one holds a quarter as much text or more: then both are parts of one article."""
        up = self.parents[box]
        return any(b != box and self.tags[b] == "section" and 4 * held[b] >= held[box] for b, p in enumerate(self.parents) if p == up)

    def path(self, box: int) -> str:
        """The container's path in words, at most 300 characters of its end."""
        return ">".join(self.labels[b] for b in reversed(list(self._chain(box))))[-300:]

    def text(self, key: bytes | None) -> str:
        """The blocks below the containers with that path, else of the page's own best one."""
        if key is None or key not in self.keys:
            key = self.keys[self.best()[0]]
        keep = [False] * len(self.keys)
        for b, k in enumerate(self.keys):
            keep[b] = k == key or (self.parents[b] >= 0 and keep[self.parents[b]])
        return "\n".join(t for t, b, _, _ in self.blocks if keep[b])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: dict[tuple[str, bytes], float] = defaultdict(float)
        label: dict[bytes, str] = {}
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            page = Page(source.as_py() or "")
            box, share = page.best()
            if share:
                votes[host, page.keys[box]] += share
                label[page.keys[box]] = page.path(box)
        rows = [(host, key, label[key], v) for (host, key), v in votes.items()]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.string(), pa.float64()), strict=True)], names=["host", "path", "label", "vote"]
        )


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [Page(source.as_py() or "").text(path) for source, path in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "text"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null html is empty and gives an empty text. Pages without a host (null url, no ://) vote together as host
    ''. Of equal votes the path with the greater digest wins. Null and repeated ids come back as they are. An
    empty input gives an empty result; other columns are ignored.
    """
    scratch.bound_arrow(pages.sparkSession)
    rows = pages.select(
        F.struct(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).alias("row"),
        host_and_path(F.col(url_col).cast("string"))[0].alias("host"),
        F.col(html_col).cast("string").alias("html"),
    )
    votes = rows.select("host", "html").mapInArrow(_vote, "host string, path binary, label string, vote double")
    votes = votes.groupBy("host", "path").agg(F.sum("vote").alias("votes"), F.max("label").alias("label"))
    order = F.struct(F.round("votes", 6), F.col("path"))
    winners = scratch.write(votes.groupBy("host").agg(F.max_by("path", order).alias("path"), F.max_by("label", order).alias("label")), "paths")
    joined = join_small(rows, winners.select("host", "path"), "host", "left", winners.count(), 160).select("row", "html", "path")
    kind = rows.schema["row"].dataType.simpleString()
    return joined.mapInArrow(_extract, f"row {kind}, text string").select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))
