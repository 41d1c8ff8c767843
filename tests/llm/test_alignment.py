"""Alignment of two tokenizers against the libraries, whole texts at a time."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from spanwarden.llm import alignment, bpe, queries

rng = random.Random(9)
ODD = ["", " ", "\n", "  ", "a", " a", "a ", "two  blanks  ", "▁ mark▁", "mark ▁", "<|endoftext|> x <s> </s> <0x0A>", "don't I'LL 3½", "日本語　テスト です", "a\tb \r\n c\x1cd\x85e\xa0f \xa0 g", "😀\u0000 \u0000", "é é", "line\n next\n\nline \n x", "tab\t x", "x" * 900, "\n\n\n", "a​ b﻿ c᠎ d"]
WORDS = ["the", "Then", "näh,", "of.\n", "zeta\n\n", "12.5", "x", "end.", "Öl", "日本", "😀", "\t", "", "(a)", "don't"]


def text(n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "a", "bi", "cco", "\n"]) for _ in range(n))


def whole(body):
    """a ids, b ids, groups as the libraries give whole texts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not hasattr(whole, "a"):
        whole.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        whole.a.encode_special_tokens = True
        whole.b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        letters = {c: b for b, c in enumerate(bpe.byte_letters())}
        whole.bytes_a = {i: bytes(letters[c] for c in s) for s, i in whole.a.get_vocab().items() if all(c in letters for c in s)}
    if not body:
        return [], [], []
    a, b = whole.a.encode(" " + body, add_special_tokens=False).ids, whole.b.encode(body)
    a_bytes = [whole.bytes_a[i] for i in a]
    b_bytes = [bytes([int(p[3:5], 16)]) if whole.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, whole.b.id_to_piece(b), strict=True)]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + body).encode():
        return [], [], []
    groups, x, y, i, j, p, q = [], 0, 0, 0, 0, 0, 0
    while x < len(a) or y < len(b):
        if p <= q:
            p, x = p + len(a_bytes[x]), x + 1
        else:
            q, y = q + len(b_bytes[y]), y + 1
        if p == q:
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
    return a, b, groups


def brute(rows):
    found = [(i, *whole(t)) for i, t in rows]
    counts = Counter((g[0][-1], g[1][-1]) for *_, groups in found for g in groups)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for i, a, b, groups in found:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        digest = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(digest.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_a int")


@pytest.mark.parametrize("chunk", [65_536, 40, 7])
def test_aligned_brute_force(spark, chunk):
    rows = [(i, t) for i, t in enumerate(ODD + [text(n) for n in (1, 5, 30, 30, 200)])] + [(50, None), (None, "the of"), (51, "the of"), (51, "the of"), (52, "z" * 300 + "\n" + "y" * 300), (53, text(40) + "▁" + text(40))]
    rows += [(100 + i, "the näh, of " * (i % 4)) for i in range(40)]
    got = alignment.aligned(table(spark, rows), queries.byte_and_piece(), chunk=chunk).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_random_strings_align_as_whole_texts():
    coder = alignment.Coder(**queries.byte_and_piece())
    for _ in range(4000):
        t = "".join(rng.choice(["a", "b", " ", " ", "\n", "'s", "é", "日", ".", "😀", "1", "\t", "\xa0", "\x1c", "\r", "the", "▁"]) for _ in range(rng.randint(1, 40)))
        units = alignment.units_of(t)
        coder.learn([u for u in set(units) if u not in coder.units])
        at = [coder.units[u] for u in units]
        a, b, groups = whole(t)
        got = ";".join(coder.text[i] for i in at) if all(coder.n_groups[i] for i in at) else ""
        assert got == ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups), ascii(t)


@pytest.mark.parametrize("chunk", [3, 11, 50])
def test_fragments_are_a_monoid(chunk):
    coder = alignment.Coder(**queries.byte_and_piece())
    import numpy as np

    for _ in range(60):
        t = text(rng.randint(5, 60)).replace("▁", "")
        parts = []
        for _, a0, _, b0, _, a_text, b_text in alignment.cut(t, chunk):
            a, b = coder.a_ids(a_text), coder.b_ids(b_text)
            parts.append(alignment.fragment(a, a0 + np.cumsum([len(coder.a_bytes[i]) for i in a]), b, b0 + np.cumsum([len(coder.b_bytes[i]) for i in b])))
        want = [",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in whole(t)[2]]

        def tree(lo, hi):
            """closed, prefix, groups, suffix of parts lo .. hi - 1, split anywhere."""
            if hi - lo == 1:
                closed, prefix, inner, suffix = parts[lo]
                return (closed, prefix, suffix), alignment.grouped(*inner)[0]
            mid = rng.randint(lo + 1, hi - 1)
            (left, x), (right, y) = tree(lo, mid), tree(mid, hi)
            state, stretch = alignment.compose(left, right)
            return state, x + (alignment.grouped(*stretch)[0] if stretch else []) + y

        for _ in range(3):
            (_, prefix, suffix), inner = tree(0, len(parts))
            assert alignment.grouped(*prefix)[0] + inner + alignment.grouped(*suffix)[0] == want


def test_no_rows(spark):
    assert alignment.aligned(table(spark, []), queries.byte_and_piece()).collect() == []


def test_blocks_are_read_a_few_at_once(spark, monkeypatch):
    """A row group holds few blocks, also where a task writes many: readers decode all rows of one at once."""
    from pathlib import Path

    import pyarrow.parquet as pq

    monkeypatch.setitem(alignment.WIDE, "parquet.block.size", 1024)
    seen = []
    keep = alignment.Scratch.keep
    monkeypatch.setattr(alignment.Scratch, "keep", lambda self, df, name: (keep(self, df, name), seen.append((name, self.path(name))))[0])
    docs = spark.range(9000).selectExpr("id AS doc_id", "concat('the of ', id % 7) AS text").coalesce(1)
    assert alignment.aligned(docs, queries.byte_and_piece()).count() == 9000
    files = [pq.ParquetFile(f).metadata for f in Path(dict(seen)["blocks"].removeprefix("file://")).glob("*.parquet")]
    assert sum(f.num_rows for f in files) >= 5
    assert max(f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)) == 1
