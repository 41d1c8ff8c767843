"""Alignment of two tokenizers' tokens: groups between byte offsets where tokens of both end, and links of ids.

Tokens of A (byte-level) and B (pieces) cover the same bytes. Where a token of each ends at one offset, a group
closes and the two are linked. Groups are kept as text `a1,a2|b1;a3|b2,b3`. An id pair counts its links in the corpus.

Short texts are read as units, a word with the blank before it: neither tokenizer joins bytes across such a blank, so a
unit's tokens and groups are the same in every text and are found once. Texts of over CHUNK characters are cut into
chunks, each tokenizer's at the first place after a multiple of CHUNK where it never joins bytes; the two may differ.
Chunks are dealt to tasks. A chunk yields a fragment: an open prefix (tokens up to its first common end), closed
groups, and an open suffix (tokens after its last common end). Fragments form a monoid: the left one's suffix
and the right one's prefix make closed groups, and a fragment without a common end adds to its neighbour's open part.
A tree of FAN fragments a node reduces them; closed groups stay in rows of their own, and the text that is
hashed streams over them in order.

Counts: texts are kept in blocks of a batch, each a row with the distinct pairs of its units and how often each is
linked. These are summed over the corpus, compared with the highest count of their B id, and joined back, once
a block and pair; the block's texts then look them up. No pair's rows meet but those of one block each.

Defined results: null and empty texts, and texts whose joined tokens of A or B differ from blank + text (as with
U+2581), have no tokens: zeros and ''. Their links don't count. Texts of any length are read whole. A null id stays
null, repeated rows and ids each give a row and count each, ties for the highest count are all best, and an empty
table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, once, per_batch, texts, tune

#: Characters beyond which a text is cut into chunks, and of a chunk.
CHUNK = 65_536
#: Fragments that a node of the tree takes.
FAN = 16
#: Units that a worker remembers; at the bound it starts anew.
REMEMBERED = 100_000
#: Bytes of text that a block takes, about.
SLICE = 2 << 20
#: Rows of blocks are large, and readers decode all rows of a row group at once: it is closed at so many bytes, looked at after each row.
WIDE = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1}
#: Units that are encoded as one text.
LEARNT = 20_000
MARK = "▁"
#: What may be white space to one of the tokenizers.
_BLANK = r"\s\x1c-\x1f\x85᠎​﻿▁"
_ODD_BLANKS = "\u180e\u200b\ufeff" + MARK
#: Places where a tokenizer surely begins a token: A before white space, B before blanks and line feeds.
_CUTS = (re.compile(rf"(?<=[^{_BLANK}])(?=[ \t\r\n])"), re.compile(r"(?<=[^ ▁\n])(?=[ \n])"))


def ends_blank(word: str) -> bool:
    """Does a word end with what may be white space to one of the tokenizers, or is it empty?"""
    return not word or word[-1].isspace() or word[-1] in _ODD_BLANKS


class Coder:
    """Ids and byte lengths of tokens of both vocabularies."""

    def __init__(self, ranks_file: str, pattern: str, model: str):
        import sentencepiece
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.a = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.a_bytes[i] = b
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = self.b.id_to_piece(list(range(self.b.get_piece_size())))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        self.a_shown = [f"{i}{end}" for i in range(len(self.a_bytes)) for end in (",", "|")]
        self.b_shown = [f"{i}{end}" for i in range(len(self.b_bytes)) for end in (",", ";", "")]
        self.clear()

    def clear(self) -> None:
        self.units: dict[str, int] = {}
        self.n_a, self.n_b, self.n_groups = array("i"), array("i"), array("i")
        self.text: list[str] = []
        self.pairs: list[bytes] = []

    def a_ids(self, text: str) -> list[int]:
        return self.a.encode_ordinary(text)

    def b_ids(self, text: str) -> list[int]:
        """Ids of a text that begins with a blank, which is the library's own if more follows, or with a line feed."""
        if text[:1] == " " and text != " ":
            return self.b.encode(text[1:], num_threads=1)
        return self.b.encode("\n" + text, num_threads=1)[2:] if text == " " else self.b.encode(text, num_threads=1)[1:] if text else []

    def same(self, ids: list[int], data: bytes) -> bool:
        return b"".join(map(self.b_bytes.__getitem__, ids)) == data

    def learn(self, words: list[str]) -> None:
        """Remembers units, each a word after one blank. A word whose bytes B changes has no groups."""
        plain = [w for w in words if MARK not in w and not ends_blank(w)]
        for at in range(0, len(plain), LEARNT):
            part = plain[at : at + LEARNT]
            if not self._learn_together(part):
                self._learn_each(part)
        if len(plain) < len(words):
            self._learn_each([w for w in words if w not in self.units])

    def _learn_each(self, words: list[str]) -> None:
        bare = [w[1:] if ends_blank(w) else w for w in words]
        for key, word, b in zip(words, bare, self.b.encode(bare, num_threads=1), strict=True):
            a, b = self.a.encode_ordinary(" " + word), b if word else self.b_ids(" ")
            if not self.same(b, b" " + word.encode()):
                a = b = []
            found = grouped(a, list(accumulate(map(len, map(self.a_bytes.__getitem__, a)))), b, list(accumulate(map(len, map(self.b_bytes.__getitem__, b)))))
            self._add([key], [len(a)], [len(b)], [len(found[0])], [";".join(found[0])], [array("q", found[1]).tobytes()])

    def _add(self, words: list[str], n_a, n_b, n_groups, text: list[str], pairs: list[bytes]) -> None:
        self.units.update(zip(words, range(len(self.text), len(self.text) + len(words)), strict=True))
        for have, new in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups), (self.text, text), (self.pairs, pairs)):
            have.extend(new)

    def _learn_together(self, words: list[str]) -> bool:
        """All words as one text, which is each word's tokens in turn; False if its bytes say otherwise."""
        text = " " + " ".join(words)
        a, b = np.array(self.a.encode_ordinary(text)), np.array(self.b.encode(text[1:], num_threads=1))
        if not self.same(b.tolist(), text.encode()):
            return False
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        bounds = np.searchsorted(common, ends)
        if bounds[-1] >= len(common) or (common[bounds] != ends).any():
            return False
        group_a, group_b = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        last_a, last_b = a_ends == common[group_a], b_ends == common[group_b]
        pairs = (a[last_a].astype(np.int64) << 32 | b[last_b]).tobytes()
        until = bounds + 1
        sizes = [np.diff(x, prepend=0) for x in (np.searchsorted(a_ends, ends, "right"), np.searchsorted(b_ends, ends, "right"), until)]
        # a token's text and what follows it, in order of groups and A before B
        of_b = b * 3 + last_b + np.isin(b_ends, ends, assume_unique=True)
        shown = list(map(self.a_shown.__getitem__, (a * 2 + last_a).tolist())) + list(map(self.b_shown.__getitem__, of_b.tolist()))
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        shown = list(map(shown.__getitem__, order.tolist()))
        stops = np.cumsum(sizes[0] + sizes[1]).tolist()
        texts_ = ["".join(shown[i:j]) for i, j in zip([0, *stops], stops, strict=False)]
        cuts = (until * 8).tolist()
        self._add(words, *(x.tolist() for x in sizes), texts_, [pairs[i:j] for i, j in zip([0, *cuts], cuts, strict=False)])
        return True


def grouped(a: list[int], a_ends: list[int], b: list[int], b_ends: list[int]) -> tuple[list[str], list[int]]:
    """Texts of the groups and linked pairs (a << 32 | b) of a stretch of tokens that ends with a common end."""
    common = set(a_ends).intersection(b_ends)
    groups, pairs, i, j, x, y = [], [], 0, 0, 0, 0
    for end in sorted(common):
        while x < len(a) and a_ends[x] <= end:
            x += 1
        while y < len(b) and b_ends[y] <= end:
            y += 1
        groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        pairs.append(a[x - 1] << 32 | b[y - 1])
        i, j = x, y
    return groups, pairs


def units_of(text: str) -> list[str]:
    """The words of the units of blank + text: a blank that follows white space stays inside.

    A last word that ends with white space comes with its blank, as it is a unit at the end of a text only.
    """
    out, open_ = [], []
    for word in text.split(" "):
        open_.append(word)
        if not ends_blank(word):
            out.append(" ".join(open_))
            open_ = []
    return [*out, " " + " ".join(open_)] if open_ else out


_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def arrow(ddl: str) -> pa.Schema:
    """The Arrow schema of plain columns; tasks have no session that could read it."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


BLOCK = "block string, whole boolean, id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, sha array<string>, at binary, unit binary, pair_at binary, pair_of binary, pairs array<long>, links array<long>"
_BLOCK = arrow(BLOCK)


def block_row(name: str, whole: bool, ids: list, n_a: list, n_b: list, n_groups: list, sha: list, units: list[np.ndarray], pairs_of) -> pa.RecordBatch:
    """A block of texts (whole) or parts of them: each has units, and pairs_of(units) gives their pairs and how many each has."""
    flat = np.concatenate(units) if units else np.zeros(0, np.int64)
    used, unit, times = np.unique(flat, return_inverse=True, return_counts=True)
    pairs, n = pairs_of(used)
    distinct, of = np.unique(pairs, return_inverse=True)
    links = np.bincount(of, np.repeat(times, n), len(distinct)).astype(np.int64) if len(pairs) else np.zeros(0, np.int64)
    row = [name, whole, ids, n_a, n_b, n_groups, sha, _bytes([0, *accumulate(map(len, units))], "<i8"), _bytes(unit, "<i4"), _bytes([0, *np.cumsum(n).tolist()], "<i8"), _bytes(of, "<i4"), distinct.tolist(), links.tolist()]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)


def _bytes(values, kind: str) -> bytes:
    return np.asarray(values).astype(kind).tobytes()


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about SLICE bytes of text, so that a worker holds the units of few texts at once."""
    for batch in batches:
        if batch.num_rows:
            ends = np.cumsum(np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1)]))
            cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE)) + 1).tolist(), batch.num_rows]
            yield from (batch.slice(i, j - i) for i, j in zip(cuts, cuts[1:], strict=False))


def _short(bpe: dict):
    """Batches of doc_id and text to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder = once(("alignment", bpe["model"]), lambda: Coder(**bpe))
        for k, batch in enumerate(sliced(batches)):
            if len(coder.text) > REMEMBERED:
                coder.clear()
            bodies = [t or "" for t in batch.column(1).to_pylist()]
            words = [t.split(" ") if t else [] for t in bodies]
            new = set().union(*words).difference(coder.units)
            odd = set(filter(ends_blank, new))  # never remembered so: no units
            if odd:
                words = [units_of(t) if t and not odd.isdisjoint(w) else w for t, w in zip(bodies, words, strict=True)]
                new = set().union(*words).difference(coder.units)
            coder.learn(sorted(new))
            n_a, n_b, n_groups = (np.array(x, np.int64) for x in (coder.n_a, coder.n_b, coder.n_groups))
            out, units = ([], [], [], []), []
            for w in words:
                u = np.fromiter(map(coder.units.__getitem__, w), np.int64, len(w))
                if len(u) and not n_groups[u].all():
                    u = u[:0]
                units.append(u)
                for o, have in zip(out, (n_a, n_b, n_groups), strict=False):
                    o.append(int(have[u].sum()))
                out[3].append(hashlib.sha256(";".join(map(coder.text.__getitem__, u.tolist())).encode()).hexdigest() if len(u) else "")

            def pairs_of(used: np.ndarray):
                return np.frombuffer(b"".join(map(coder.pairs.__getitem__, used.tolist())), np.int64), n_groups[used].astype(np.int64)

            yield block_row(f"{part}-{k}", True, batch.column(0).to_pylist(), *out, units, pairs_of)

    return run


def cut(text: str, chunk: int) -> list[tuple[int, int, int, int, int, str, str]]:
    """Chunks of blank + text: number, the byte offsets where each tokenizer's stretch begins and ends, and the stretches."""
    text = " " + text
    stretches = []
    for rule in _CUTS:
        cuts = [0]
        for target in range(chunk, len(text), chunk):
            if cuts[-1] < target:
                found = rule.search(text, target)
                cuts.append(found.start() if found else len(text))
            else:
                cuts.append(cuts[-1])
        parts = [text[i:j] for i, j in zip(cuts, [*cuts[1:], len(text)], strict=True)]
        ends = list(accumulate(len(p.encode()) for p in parts))
        stretches.append(list(zip([0, *ends[:-1]], ends, parts, strict=True)))
    return [(i, a[0], a[1], b[0], b[1], a[2], b[2]) for i, (a, b) in enumerate(zip(*stretches, strict=True))]


_OPEN = [f"{end}_{x}" for end in ("prefix", "suffix") for x in ("a", "a_ends", "b", "b_ends")]
#: Fragments (closed is not null) and closed groups (text is not null); seam 0: within a chunk, 1: after it, -1 and 2: around the text.
FRAGMENT = "key long, at long, last long, good boolean, closed boolean, " + ", ".join(f"{c} array<long>" for c in _OPEN) + ", seam int, n_a long, n_b long, n_groups long, text string, pairs array<long>"
_FRAGMENT = arrow(FRAGMENT)

Open = tuple[list[int], list[int], list[int], list[int]]


def fragment(a: list[int], a_ends: np.ndarray, b: list[int], b_ends: np.ndarray) -> tuple[bool, Open, Open, Open]:
    """Is there a common end; the open prefix, the closed stretch and the open suffix of a chunk's tokens."""
    common = np.intersect1d(a_ends, b_ends)
    if not len(common):
        return False, (a, a_ends.tolist(), b, b_ends.tolist()), ([],) * 4, ([],) * 4
    edges = [np.searchsorted(x, [common[0], common[-1]], side="right") for x in (a_ends, b_ends)]

    def stretch(i, j, k, m) -> Open:
        return a[i:j], a_ends[i:j].tolist(), b[k:m], b_ends[k:m].tolist()

    (a1, a2), (b1, b2) = edges
    return True, stretch(0, a1, 0, b1), stretch(a1, a2, b1, b2), stretch(a2, len(a), b2, len(b))


def joined(x: Open, y: Open) -> Open:
    return tuple(p + q for p, q in zip(x, y, strict=True))


def compose(left: tuple[bool, Open, Open], right: tuple[bool, Open, Open]) -> tuple[tuple[bool, Open, Open], Open | None]:
    """The product of two neighbouring fragments (closed, prefix, suffix), and the stretch that closes between them."""
    (lc, lp, ls), (rc, rp, rs) = left, right
    if not lc:
        return (rc, joined(lp, rp), rs), None
    if not rc:
        return (True, lp, joined(ls, rp)), None
    return (True, lp, rs), joined(ls, rp)


def _closed(key: int, at: int, seam: int, stretch: Open) -> dict:
    groups, pairs = grouped(*stretch)
    return {"key": key, "at": at, "seam": seam, "n_a": len(stretch[0]), "n_b": len(stretch[2]), "n_groups": len(groups), "text": ";".join(groups), "pairs": pairs}


def _open(key: int, at: int, last: int, good: bool, state: tuple[bool, Open, Open]) -> dict:
    return {"key": key, "at": at, "last": last, "good": good, "closed": state[0]} | dict(zip(_OPEN, [*state[1], *state[2]], strict=True))


def _table(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_FRAGMENT)


def _fragments(bpe: dict):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = once(("alignment", bpe["model"]), lambda: Coder(**bpe))
        rows = []
        for r in batch.to_pylist():
            a, b = coder.a_ids(r["a_text"]), coder.b_ids(r["b_text"])
            good = coder.same(b, r["b_text"].encode())
            ends = r["a_from"] + np.cumsum(coder.a_sizes[a] if a else np.zeros(0, np.int64)), r["b_from"] + np.cumsum(coder.b_sizes[b] if b else np.zeros(0, np.int64))
            closed, prefix, inner, suffix = fragment(a, ends[0], b, ends[1])
            rows.append(_open(r["key"], r["at"], r["at"], good, (closed, prefix, suffix)))
            if inner[0]:
                rows.append(_closed(r["key"], r["at"], 0, inner))
        return _table(rows)

    return work


def _reduced(table: pa.Table) -> pa.Table:
    """A node of the tree: the product of its fragments in order, and what closed between them."""
    rows = sorted(table.to_pylist(), key=lambda r: r["last"])
    out, state = [], None
    for r in rows:
        own = (r["closed"], tuple(r[c] for c in _OPEN[:4]), tuple(r[c] for c in _OPEN[4:]))
        if state is None:
            state = own
        else:
            state, stretch = compose(state, own)
            if stretch is not None and stretch[0]:
                out.append(_closed(r["key"], last, 1, stretch))
        last = r["last"]
    out.append(_open(rows[0]["key"], rows[0]["at"] // FAN, last, all(r["good"] for r in rows), state))
    return pa.Table.from_batches([_table(out)])


def _finished(batch: pa.RecordBatch) -> pa.RecordBatch:
    """What is open at a text's beginning and end closes there."""
    rows = []
    for r in batch.to_pylist():
        for at, seam, names in ((-1, -1, _OPEN[:4]), (r["last"], 2, _OPEN[4:])):
            if r[names[0]]:
                rows.append(_closed(r["key"], at, seam, tuple(r[c] for c in names)))
    return _table(rows)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's texts in order, joined by semicolons."""
    key, state = None, None

    def rows(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in found], pa.int64()), "groups_sha256": pa.array([h for _, h in found], pa.string())})

    for b in batches:
        found = []
        for k, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
            if k == key:
                state.update(b";" + text.encode())
                continue
            if key is not None:
                found.append((key, state.hexdigest()))
            key, state = k, hashlib.sha256(text.encode())
        yield rows(found)
    if key is not None:
        yield rows([(key, state.hexdigest())])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Closed groups of long texts to blocks; a link is a unit there."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for k, b in enumerate(b for b in batches if b.num_rows):
        units = [np.array(p, np.int64) for p in b.column("pairs").to_pylist()]
        yield block_row(f"part-{part}-{k}", False, *(b.column(c).to_pylist() for c in ("key", "n_a", "n_b", "n_groups")), [None] * len(units), units, lambda used: (used, np.ones(len(used), np.int64)))


FOUND = "id long, whole boolean, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long"


def _looked_up(batch: pa.RecordBatch) -> dict:
    """Texts of blocks with the sums over their links. news: twice a pair's count, and one more if it is its B id's highest."""
    out: dict[str, list] = {f.split()[0]: [] for f in FOUND.split(", ")}

    def numbers(name: str, i: int) -> np.ndarray:
        value = batch.column(name)[i]
        return value.values.to_numpy(zero_copy_only=False) if value.is_valid else np.zeros(0, np.int64)

    for i in range(batch.num_rows):
        news = numbers("news", i)
        at, unit, pair_at, pair_of = (np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in (("at", "<i8"), ("unit", "<i4"), ("pair_at", "<i8"), ("pair_of", "<i4")))
        for name, values in (("count_sum", news >> 1), ("n_best", news & 1)):
            of_unit = np.diff(np.concatenate([[0], np.cumsum(values[pair_of])])[pair_at])
            out[name] += np.diff(np.concatenate([[0], np.cumsum(of_unit[unit])])[at]).tolist()
        out["id"] += batch.column("id")[i].as_py()
        out["whole"] += [batch.column("whole")[i].as_py()] * (len(at) - 1)
        for c in ("n_a", "n_b", "n_groups"):
            out[c] += numbers(c, i).tolist()
        out["groups_sha256"] += batch.column("sha")[i].as_py()
    return out


def long_parts(long: DataFrame, bpe: dict, chunk: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Closed groups of long texts (key, at, seam, counts, text, pairs), and their keys (key, doc_id, good)."""
    spark = long.sparkSession

    def chunks(batch: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("key", "doc_id", "at", "a_from", "a_to", "b_from", "b_to", "a_text", "b_text")}
        for key, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for row in cut(text, chunk):
                for name, value in zip(out, (key, doc_id, *row), strict=True):
                    out[name].append(value)
        return out

    numbered = long.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    pieces = scratch.keep(per_batch(numbered, "key long, doc_id long, at long, a_from long, a_to long, b_from long, b_to long, a_text string, b_text string", chunks), "chunks")
    n, most = pieces.agg(F.count("*"), F.max("at")).first()
    if not n:
        return spark.createDataFrame([], FRAGMENT), spark.createDataFrame([], "key long, doc_id long, good boolean")
    dealt = pieces.drop("doc_id").repartition(max(spark.sparkContext.defaultParallelism, n // 64), "key", "at")
    levels = [scratch.keep(per_batch(dealt, FRAGMENT, _fragments(bpe)), "fragments-0")]
    while most:
        most //= FAN
        nodes = levels[-1].where("closed IS NOT NULL").groupBy("key", F.expr(f"at div {FAN}"))
        levels.append(scratch.keep(nodes.applyInArrow(_reduced, FRAGMENT), f"fragments-{len(levels)}"))
    top = levels[-1].where("closed IS NOT NULL")
    closed = per_batch(top, FRAGMENT, _finished)
    for level in levels:
        closed = closed.unionByName(level.where("text IS NOT NULL"))
    keys = pieces.where("at = 0").select("key", "doc_id").join(top.select("key", "good"), "key")
    closed = closed.join(keys.where("good").select("key"), "key", "left_semi").coalesce(max(spark.sparkContext.defaultParallelism, n // 64))
    return scratch.keep(closed, "closed"), keys


def aligned(docs: DataFrame, bpe: dict, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs (doc_id, text).

    bpe: ranks_file and pattern of A, model of B.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "alignment", **WIDE)
    plain = texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "text")
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    closed, keys = long_parts(plain.where(is_long), bpe, chunk, scratch)
    blocks = plain.where(~is_long).mapInArrow(_short(bpe), BLOCK).unionByName(closed.select("key", "n_a", "n_b", "n_groups", "pairs").mapInArrow(_parts, BLOCK))
    blocks = scratch.keep(blocks, "blocks")
    linked = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "links"))).select("block", "pos", F.col("col.pairs").alias("pair"), F.col("col.links").alias("links"))
    counts = linked.groupBy("pair").agg(F.sum("links").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))
    counts = counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))
    news = linked.join(counts, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "best"))).alias("news"))  # a batch's pairs
    news = news.select("block", F.transform("news", lambda x: x["n"] * 2 + x["best"]).alias("news"))
    joined_ = blocks.drop("pairs", "links").join(news, "block", "left")
    whole, parts = (per_batch(joined_.where(F.col("whole") == F.lit(w)), FOUND, _looked_up) for w in (True, False))
    numbers = ("n_a", "n_b", "n_groups", "n_best", "count_sum")
    hashes = closed.select("key", "at", "seam", "text").repartition("key").sortWithinPartitions("key", "at", "seam").mapInArrow(_hashes, "key long, groups_sha256 string")
    sums = parts.groupBy(F.col("id").alias("key")).agg(*(F.sum(c).alias(c) for c in numbers))
    long = keys.join(sums.join(hashes, "key"), "key", "left").select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    both = whole.select(F.col("id").alias("doc_id"), *numbers, "groups_sha256").unionByName(long)
    return both.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
