"""Alignment of two tokenizers against whole texts encoded one by one."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quire.llm import token_align
from tests.llm.common import awkward, empty

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "a  b", " lead", "  two", "trail ", "\n", "a\nb", "a\n\nb", "a \n b", "\na", "x\r\ny", "tab\there", "nb sp   x", "wide　 space 　x", "a  b c",
    "low▁line ▁ x", "<|endoftext|> and <s> </s> <unk> <0x0A>", "\U0001f600 emoji \U0001f469‍\U0001f469‍\U0001f467", "don't 's we'll\n's", "漢字 テスト 中", "é ́ x",
    "\x00 nul \x01", "\x1f x\x7f y", "café au lait\nnaïve", "1 234 5678\n9", "“quoted” — dash", "a" * 3000, "word " * 500 + "end", "﻿bom", "\u0085 x \u0085y", "x  y", ".\n-\n*",
]


def brute(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    chars = token_align.byte_level()
    names = {i: t for t, i in a.get_vocab().items()}
    docs, counts = [], Counter()
    for i, text in rows:
        x = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        bx = [bytes(chars[c] for c in names[t]) for t in x]
        by = [bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in y]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bx) != whole or b"".join(by) != whole:
            docs.append((i, 0, 0, [], []))
            continue
        ex, ey = [0], [0]
        for t in bx:
            ex.append(ex[-1] + len(t))
        for t in by:
            ey.append(ey[-1] + len(t))
        cuts = sorted(set(ex[1:]) & set(ey[1:]))
        at_x, at_y = ({e: k for k, e in enumerate(ends)} for ends in (ex, ey))
        groups = []
        for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True):
            groups.append((x[at_x[lo] : at_x[hi]], y[at_y[lo] : at_y[hi]]))
        links = [(g[-1], k[-1]) for g, k in groups]
        counts.update(links)
        docs.append((i, len(x), len(y), groups, links))
    most = defaultdict(int)
    for (_, k), n in counts.items():
        most[k] = max(most[k], n)
    out = Counter()
    for i, na, nb, groups, links in docs:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, k)) for g, k in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out[i, na, nb, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), sha] += 1
    return out


@pytest.mark.parametrize("flush", [1 << 20, 1])
def test_alignment_brute_force(spark, monkeypatch, flush):
    docs = awkward(spark, [(100 + i, t) for i, t in enumerate(ODD)])
    if flush == 1:  # many rows of links, and counts added up twice
        docs = docs.repartition(9)
        monkeypatch.setattr(token_align, "LOT", 2)
    got = Counter(map(tuple, token_align.align(docs, A, B).collect()))
    want = brute((r["doc_id"], r["text"]) for r in docs.collect())
    assert got == want, (got - want, want - got)
    assert sum(not r[7] for r in want) < 12


def test_alignment_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = Counter(map(tuple, token_align.align(docs, A, B).collect()))
    assert got == brute((r["doc_id"], r["text"]) for r in docs.collect())
    assert token_align.align(empty(spark), A, B).count() == 0


def test_joined_pieces_are_the_text(spark):
    """Pieces cut as one slice are those of each text alone, and a piece starts only where no token can cross."""
    import numpy as np

    texts = [(" " + t).encode() for t in ODD]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    starts = set(token_align.piece_starts(data, offs).tolist())
    assert set(offs[:-1].tolist()) <= starts
    for lo, hi in zip(offs[:-1], offs[1:], strict=True):
        alone = token_align.piece_starts(data[lo:hi], np.array([0, hi - lo]))
        assert set((alone + lo).tolist()) == {s for s in starts if lo <= s < hi}
