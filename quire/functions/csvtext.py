"""Delimited text: decoding, sniffing, parsing, wrapping."""

from __future__ import annotations

import re

SEPARATORS = [",", ";", "\t", "|"]
_PIECE = re.compile(r'"(?:[^"]|"")*"?|[^"\n]+|\n|"')


def decode(data: bytes) -> str:
    """UTF-8 or UTF-16 by byte-order mark, else UTF-8, else Windows-1252; unknown bytes are U+FFFD."""
    if data.startswith(b"\xef\xbb\xbf"):
        return data[3:].decode("utf-8", "replace")
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data[2:].decode("utf-16-le" if data[0] == 0xFF else "utf-16-be", "replace")
    if b"\0" in data[:8000]:
        raise ValueError("this is not a text file")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def logical_lines(text: str, most: int = 20) -> list[str]:
    """The first records that are not empty; a line break within quotes does not end one."""
    out, now, quoted = [], [], False
    for piece in re.split(r'(["\n])', text):
        if piece == "\n" and not quoted:
            line = "".join(now).rstrip("\r")
            now = []
            if line:
                out.append(line)
                if len(out) == most:
                    return out
            continue
        quoted ^= piece == '"'
        now.append(piece)
    last = "".join(now).rstrip("\r")
    return out + [last] if last else out


def sniff(text: str) -> str:
    """The separator that cuts the first lines alike, into most fields; else the one that occurs most."""
    lines = [re.sub('"[^"]*("|$)', "", x) for x in logical_lines(text)]
    counts = {s: [x.count(s) for x in lines] for s in SEPARATORS}
    ranked = [(len(set(c)) == 1 and c[0] > 0, c[0] if len(set(c)) == 1 and c and c[0] > 0 else sum(c), -i, s) for i, (s, c) in enumerate(counts.items()) if c]
    best = max(ranked, default=(False, 0, 0, ","))
    return best[3] if best[1] else ","


def parse(text: str, sep: str) -> list[list[str]]:
    """Rows of fields. A quote is special only where a field starts; blank lines are dropped."""
    field = re.compile(rf'(?:"((?:[^"]|"")*)(?:"|\Z))?([^{re.escape(sep)}\r\n]*)({re.escape(sep)}|\r\n|\n|\r|\Z)')
    rows, row, at = [], [], 0
    while at < len(text) or row:
        m = field.match(text, at)
        row.append((m[1] or "").replace('""', '"') + m[2])
        at = m.end()
        if m[3] != sep:
            if row != [""]:
                rows.append(row)
            row = []
    return rows


def wrap(text: str, width: int) -> list[str]:
    """Lines of at most ``width`` characters, broken at spaces; longer words are cut."""
    lines, now = [], ""
    for word in text.split():
        if now and len(now) + 1 + len(word) <= width:
            now += " " + word
            continue
        if now:
            lines.append(now)
        while len(word) > width:
            lines.append(word[:width])
            word = word[width:]
        now = word
    return [*lines, now] if now or not lines else lines
