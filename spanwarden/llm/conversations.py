"""Prefix trie of conversations: every shared beginning of turns is one node, with what it spares.

Conversations are first rebuilt: the first h turns of the group's first conversation, then the own turns after the
first h (see rebuilt). A node is a distinct sequence of (role, text) turns; the conversations that begin with it are
its members. Turns are known by 128 bits of their SHA-256, nodes by those of their path.

A conversation comes as units of at most BAND turns (depths of a band), so no row holds a conversation of any length.
Units of a band, sorted by path, are dealt to shards. Each shard writes its trie as balanced parentheses, an open and
a close a node in preorder; blocks of the running excess with a tree of their minima find the close of every open
(findclose), which delimits its subtree. Ranks of units, of leaf pairs "()" and cumulative arrays of savings then give
each node's sums as two look-ups. Nodes on a shard's first or last path may have members in other shards: these spines
merge by key. One shard owns such a node and counts it, so partial sums of shards add up. Bands are read from the
deepest to the first, and a band's roots hand their sums to the nodes that they continue. Where one conversation alone
goes on, its nodes are known without a trie.

Members that end at a node are hashed in order: ids are joined in blocks in their tasks, and blocks stream through one
hash a node.

Defined results: turns come by turn, null first, turns that are alike in turn by their digest; a null role or text is
empty; rows of null conv_id belong to no conversation and are not read; conversations without turns are members of the
root. Repeated rows are turns each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, per_batch, tune

#: Turns of a conversation that a row holds.
BAND = 1024
#: Turns that a shard takes, about.
SHARD = 200_000
#: Ids that one block of a node's ends holds.
ENDS = 2000
GROUP, SHARED = 5, 9
#: Positions of a block of excesses.
BLOCK = 64
_PATH = 32  # hexadecimal digits of a turn's digest


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, depth, digest, bytes) and conversations (conv_id, n) of turns (conv_id, turn, role, text).

    Conversation c has the first h turns of c - c % 5, then its own after the first h; h = crc32(c) % 9.
    """
    raw = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    digest = F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256), 1, _PATH)
    raw = raw.select("conv_id", "turn", digest.alias("digest"), F.octet_length("text").alias("bytes"), F.monotonically_increasing_id().alias("at"))
    # a frequent conversation is spread over ranges; places are the count of the ranges before and the place within
    order = [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("at")]
    spread = raw.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())
    spread = scratch.keep(spread, "turns")
    ranges = spread.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    convs = ranges.groupBy("conv_id").agg(F.sum("n").alias("own")).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", h)
    convs = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base")), "base", "left")
    convs = convs.withColumn("shared", F.least("h", F.coalesce("of_base", F.lit(0)))).withColumn("n", F.col("shared") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = scratch.keep(convs.select("conv_id", "base", "h", "shared", "n"), "convs")
    ranges = ranges.withColumn("before", before).join(convs.select("conv_id", "h", "shared"), "conv_id").drop("n")
    within = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    placed = scratch.keep(spread.withColumn("k", within).join(ranges, ["conv_id", "part"]).withColumn("k", F.col("k") + F.col("before")).select("conv_id", "k", "h", "shared", "digest", "bytes"), "placed")
    own = placed.where("k > h").select("conv_id", (F.col("shared") + F.col("k") - F.col("h")).alias("depth"), "digest", "bytes")
    lent = placed.where(F.col("k") < SHARED).select(F.col("conv_id").alias("base"), F.col("k").alias("depth"), "digest", "bytes")
    lent = lent.join(convs.select("conv_id", "base", "h"), "base").where("depth <= h").select("conv_id", "depth", "digest", "bytes")
    return own.unionByName(lent), convs.select("conv_id", "n")


def _long(digits) -> F.Column:
    """16 hexadecimal digits as a long."""
    return F.conv(digits, 16, -10).cast("long")


def units(turns: DataFrame, convs: DataFrame, band: int) -> DataFrame:
    """A row for each band of a conversation: conv_id, band, path (digests joined), sizes, the key (hi, lo) of the node above, and of the node where its turns end."""
    found = turns.groupBy("conv_id", F.expr(f"(depth - 1) div {band}").alias("band")).agg(F.sort_array(F.collect_list(F.struct("depth", "digest", "bytes"))).alias("t"))
    found = found.select("conv_id", "band", F.array_join(F.col("t.digest"), "").alias("path"), F.col("t.bytes").alias("sizes"))
    # whose turns fill their last band has an empty unit in the next, as it is a member there
    full = convs.where(F.col("n") % band == 0).select("conv_id", F.expr(f"n div {band}").alias("band"), F.lit("").alias("path"), F.array().cast("array<int>").alias("sizes"))
    mark = F.sha2(F.concat(F.col("band").cast("string"), F.lit(":"), "path").cast("binary"), 256)
    both = found.unionByName(full).withColumn("mark", mark)
    own = [F.when(F.col("path") == "", 0).otherwise(_long(F.substring("mark", at, 16))) for at in (1, 17)]
    above = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("x", own[0]).withColumn("y", own[1])
    both = both.withColumn("hi", F.coalesce(F.bit_xor("x").over(above), F.lit(0))).withColumn("lo", F.coalesce(F.bit_xor("y").over(above), F.lit(0)))
    return both.select("conv_id", "band", "path", "sizes", "hi", "lo", F.col("hi").bitwiseXOR(F.col("x")).alias("end_hi"), F.col("lo").bitwiseXOR(F.col("y")).alias("end_lo"))


class Parentheses:
    """A forest in preorder as balanced parentheses (1 opens, 0 closes), with range min-max blocks over the excess."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits.astype(np.int8)
        self.opens = np.flatnonzero(self.bits)
        self.excess = np.cumsum(2 * self.bits.astype(np.int64) - 1)
        blocks = max(1, 1 << (-(-len(bits) // BLOCK) - 1).bit_length())
        padded = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        padded[: len(bits)] = self.excess
        self.rows = padded.reshape(blocks, BLOCK)
        self.levels = [self.rows.min(axis=1)]  # minima of blocks, then of pairs of them up to all
        while len(self.levels[-1]) > 1:
            self.levels.append(self.levels[-1].reshape(-1, 2).min(axis=1))

    def close(self) -> np.ndarray:
        """The position of each open's close: the next position whose excess is one below the open's."""
        want, block, found = self.excess[self.opens] - 1, self.opens // BLOCK, np.full(len(self.opens), -1)
        for at in range(0, len(self.opens), 1 << 16):
            part = slice(at, at + (1 << 16))
            hit = (self.rows[block[part]] <= want[part, None]) & (np.arange(BLOCK) > (self.opens[part] % BLOCK)[:, None])
            found[part] = np.where(hit.any(axis=1), block[part] * BLOCK + hit.argmax(axis=1), -1)
        rest = np.flatnonzero(found < 0)
        node, level = block[rest].copy(), np.zeros(len(rest), np.int64)
        going = np.ones(len(rest), bool)
        for k in range(len(self.levels) - 1):  # up until the block to the right goes low enough
            right = np.where(node % 2 == 0, node + 1, 0)
            turn = going & (node % 2 == 0) & (self.levels[k][np.minimum(right, len(self.levels[k]) - 1)] <= want[rest])
            node = np.where(turn, node + 1, np.where(going & ~turn, node // 2, node))
            level = np.where(going & ~turn, k + 1, level)
            going &= ~turn
        for k in range(len(self.levels) - 1, 0, -1):  # down to the leftmost block that does
            here = level == k
            left = node * 2
            low = self.levels[k - 1][np.minimum(left, len(self.levels[k - 1]) - 1)] <= want[rest]
            node = np.where(here, np.where(low, left, left + 1), node)
            level = np.where(here, k - 1, level)
        for at in range(0, len(rest), 1 << 16):
            part = rest[at : at + (1 << 16)]
            found[part] = node[at : at + (1 << 16)] * BLOCK + (self.rows[node[at : at + (1 << 16)]] <= want[part, None]).argmax(axis=1)
        return found


#: A shard's trie; arrays are little-endian, an entry a node in preorder.
TRIE = "shard int, n_nodes long, bits binary, hi binary, lo binary, depth binary, first binary, members binary, sizes binary, shared binary"
_KINDS = {"hi": "<i8", "lo": "<i8", "depth": "<i8", "first": "<i8", "members": "<i8", "sizes": "<i8", "shared": "u1"}


def build(ids: list[int], tops: list[tuple[int, int]], paths: list[str], sizes: list, band: int, base: int) -> dict:
    """The trie of sorted units: members are ids, tops the keys of the nodes that they continue at depth base."""
    n = len(ids)
    length = np.array([len(p) // _PATH for p in paths])
    common = np.zeros(n, np.int64)  # turns that a unit shares with the one before; -1: not even the node above
    common[0] = -1
    for i in range(1, n):
        if tops[i] != tops[i - 1]:
            common[i] = -1
            continue
        a, b, k, most = paths[i - 1], paths[i], 0, min(length[i - 1], length[i])
        if a == b:
            k = most
        else:
            step = int(most)
            while step:  # the longest common path, by halves
                if k + step <= most and a[k * _PATH : (k + step) * _PATH] == b[k * _PATH : (k + step) * _PATH]:
                    k += step
                else:
                    step //= 2
        common[i] = k
    opens = length - common
    closes = np.append(length[:-1] - common[1:], length[-1] + 1)
    bits = np.repeat(np.tile(np.array([1, 0], np.int8), n), np.stack([opens, closes], axis=1).reshape(-1))
    hi, lo, depth, byte, creator = [], [], [], [], np.repeat(np.arange(n), opens)
    for i in range(n):
        x, y = tops[i]
        if common[i] < 0:
            hi.append(x), lo.append(y), depth.append(base), byte.append(0)
        k = max(0, int(common[i]))
        if k < length[i]:
            state = hashlib.sha256(f"{band}:{paths[i][: k * _PATH]}".encode())
            for d in range(k, int(length[i])):
                state.update(paths[i][d * _PATH : (d + 1) * _PATH].encode())
                mark = state.digest()
                hi.append(x ^ int.from_bytes(mark[:8], "big", signed=True))
                lo.append(y ^ int.from_bytes(mark[8:16], "big", signed=True))
                depth.append(base + d + 1)
                byte.append(int(sizes[i][d]))
    tree = Parentheses(bits)
    # units up to each position: unit i ends right after its opens
    last = np.cumsum(opens) + np.insert(np.cumsum(closes)[:-1], 0, 0) - 1
    stop = np.searchsorted(last, tree.close())  # the units of a node are creator .. stop - 1
    members = stop - creator
    own = np.append(np.array(ids, np.int64), 0)
    first = np.minimum.reduceat(own, np.stack([creator, stop], axis=1).reshape(-1))[::2]
    return {"bits": bits, "hi": hi, "lo": lo, "depth": depth, "first": first, "members": members, "sizes": byte, "start": creator, "stop": stop}


def _tries(band: int, base: int, head: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, tops, paths, sizes = [], [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            tops += zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            paths += b.column(3).to_pylist()
            sizes += b.column(4).to_pylist()
        if not ids:
            return
        t = build(ids, tops, paths, sizes, band, base)
        # units of the first and of the last range key may go on in other shards, and so may all nodes that hold one
        key = [(x, p[:head]) for x, p in zip(tops, paths, strict=True)]
        low = next((i for i, k in enumerate(key) if k != key[0]), len(key))
        high = next((i for i in range(len(key) - 1, -1, -1) if key[i] != key[-1]), -1) + 1
        t["shared"] = (t["start"] < low) | (t["stop"] > high)
        row = {"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "n_nodes": pa.array([len(t["hi"])], pa.int64()), "bits": pa.array([np.packbits(t["bits"]).tobytes()])}
        yield pa.RecordBatch.from_pydict(row | {k: pa.array([np.asarray(t[k]).astype(kind).tobytes()]) for k, kind in _KINDS.items()})

    return run


def _unpacked(batch: pa.RecordBatch, i: int) -> dict:
    row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
    out = {k: np.frombuffer(row[k], kind) for k, kind in _KINDS.items()}
    out["bits"] = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: 2 * row["n_nodes"]]
    return row | out


def _marked(deepest: int):
    """Nodes of a shard that need news of others: shared ones, and those that the next band continues."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        out = {k: [] for k in ("shard", "node", "hi", "lo", "first", "members", "childless", "shared")}
        for i in range(batch.num_rows):
            t = _unpacked(batch, i)
            opens = np.flatnonzero(t["bits"])
            some = np.flatnonzero((t["shared"] == 1) | (t["depth"] == deepest))
            out["shard"] += [t["shard"]] * len(some)
            out["node"] += some.tolist()
            out["childless"] += (t["bits"][opens[some] + 1] == 0).tolist()
            out["shared"] += (t["shared"][some] == 1).tolist()
            for k in ("hi", "lo", "first", "members"):
                out[k] += t[k][some].tolist()
        return out

    return work


NODES = "hi long, lo long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, shared boolean"


def _summed(batch: pa.RecordBatch) -> dict:
    """Nodes of shards, each row a shard with the news of its marked nodes; sums of shared nodes are partial."""
    out: dict[str, list] = {f.split()[0]: [] for f in NODES.split(", ")}
    trie = batch.select([f.split()[0] for f in TRIE.split(", ")])
    for i in range(batch.num_rows):
        t, news = _unpacked(trie, i), batch.column("news")[i].as_py() or []
        tree = Parentheses(t["bits"])
        close, opens, n = tree.close(), tree.opens, len(tree.opens)
        first, members, pair = t["first"].copy(), t["members"].copy(), t["bits"][opens + 1] == 0
        mine, childless = np.ones(n, bool), pair.copy()
        leaves, below, further = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for x in news:
            k = x["node"]
            first[k], members[k], mine[k], childless[k] = x["first"], x["members"], x["owner"] == t["shard"], x["childless"]
            if x["carried"]:
                leaves[k], below[k], further[k] = x["n_leaves"], x["below"], x["n_children"]
        leaves = np.where(leaves > 0, leaves, childless)
        # cumulative over positions: leaf pairs' rank, savings; a shared node counts in the shard that owns it
        rank = np.concatenate([[0], np.cumsum(np.where(mine, leaves, 0))])
        spared = np.concatenate([[0], np.cumsum(np.where(mine, (members - 1) * t["sizes"] + below, 0))])
        end = np.searchsorted(opens, close)  # nodes of the subtree are node .. end - 1
        here = np.arange(n)
        parent = np.full(n, -1)
        stack: list[int] = []
        for k, last in enumerate(end.tolist()):
            while stack and end[stack[-1]] <= k:
                stack.pop()
            parent[k] = stack[-1] if stack else -1
            stack.append(k)
        inner = parent >= 0
        children = np.bincount(parent[inner], mine[inner], n).astype(np.int64) + np.where(mine, further, 0)
        out["hi"] += t["hi"].tolist()
        out["lo"] += t["lo"].tolist()
        out["depth"] += t["depth"].tolist()
        out["conv_id"] += first.tolist()
        out["parent_conv_id"] += [int(first[p]) if p >= 0 else None for p in parent.tolist()]
        out["n_convs"] += members.tolist()
        out["n_children"] += children.tolist()
        out["n_leaves"] += (rank[end] - rank[here]).tolist()
        out["saved_tokens"] += (spared[end] - spared[here]).tolist()
        out["shared"] += (t["shared"] == 1).tolist()
    return out


def _ends(found: DataFrame) -> DataFrame:
    """hi, lo, ends_sha256 of the nodes where conversations end (end_hi, end_lo, conv_id)."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hi, lo, ids = (b.column(i).to_numpy() for i in range(3))
            cut = np.flatnonzero((np.diff(hi) != 0) | (np.diff(lo) != 0)) + 1
            starts = np.unique(np.concatenate([[0], cut, np.arange(0, len(ids), ENDS)]))
            text = list(map(str, ids.tolist()))
            joined = [",".join(text[a:z]) for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True)]
            yield pa.RecordBatch.from_pydict({"hi": pa.array(hi[starts]), "lo": pa.array(lo[starts]), "first": pa.array(ids[starts]), "ids": pa.array(joined)})

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out = []
            for hi, lo, ids in zip(*(b.column(c).to_pylist() for c in ("hi", "lo", "ids")), strict=True):
                if (hi, lo) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (hi, lo), hashlib.sha256(ids.encode())
            yield _rows(out)
        if key is not None:
            yield _rows([(*key, state.hexdigest())])

    def _rows(out: list) -> pa.RecordBatch:
        kinds = {"hi": pa.int64(), "lo": pa.int64(), "ends_sha256": pa.string()}
        return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(kinds.items())})

    sorted_ = found.select("end_hi", "end_lo", "conv_id").repartitionByRange("end_hi", "end_lo", "conv_id").sortWithinPartitions("end_hi", "end_lo", "conv_id")
    joined = sorted_.mapInArrow(blocks, "hi long, lo long, first long, ids string")
    return joined.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first").mapInArrow(hashes, "hi long, lo long, ends_sha256 string")


def prefix_trie(turns: DataFrame, band: int = BAND, shard: int = SHARD) -> DataFrame:
    """A row for every node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    tune(spark)
    scratch = Scratch(spark, "prefix-trie")
    found, convs = rebuilt(turns, scratch)
    every = scratch.keep(units(found, convs, band), "units")
    last = every.groupBy("conv_id").agg(F.max("band").alias("band")).groupBy("band").agg(F.count("*").alias("n"))
    deepest = last.agg(F.max("band")).first()[0]
    nodes: list[DataFrame] = []
    carry = None
    if deepest:  # beyond the first band: units whose node above has no other member go on alone
        tops = every.where("band > 0").groupBy("band", "hi", "lo").agg(F.count("*").alias("n"))
        single = scratch.keep(every.where("band > 0").join(tops.where("n = 1").drop("n"), ["band", "hi", "lo"]), "single")
        more = F.lead("band").over(Window.partitionBy("conv_id").orderBy("band")).isNotNull()
        ends = F.transform("sizes", lambda x, i: i + F.col("band") * band + 1)
        tail = single.withColumn("more", more).select("*", F.explode(ends).alias("depth"))
        nodes.append(tail.join(convs, "conv_id").select(F.when(F.col("depth") == F.col("n"), F.col("end_hi")).alias("hi"), F.when(F.col("depth") == F.col("n"), F.col("end_lo")).alias("lo"), "depth", "conv_id", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(F.col("depth") < F.col("n"), 1).otherwise(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens")))
        alone = single.select("band", "hi", "lo", F.when(F.col("path") == "", 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("below"))
    for k in range(deepest or 0, -1, -1) if deepest is not None else ():
        here = every.where(F.col("band") == k)
        if k:
            here = here.join(tops.where((F.col("n") > 1) & (F.col("band") == k)).drop("n", "band"), ["hi", "lo"])
        head = 8 * _PATH
        count = here.agg(F.count("*"), F.sum(F.size("sizes"))).first()
        roots = None
        if count[0]:
            parts = -(-(count[0] + count[1]) // shard)
            parts = max(parts, spark.sparkContext.defaultParallelism if count[0] > 1000 else 1)
            dealt = here.repartitionByRange(parts, "hi", "lo", F.substring("path", 1, head), "conv_id").sortWithinPartitions("hi", "lo", "path", "conv_id")
            tries = scratch.keep(dealt.select("conv_id", "hi", "lo", "path", "sizes").mapInArrow(_tries(k, k * band, head), TRIE), f"tries-{k}")
            marked = per_batch(tries, "shard int, node int, hi long, lo long, first long, members long, childless boolean, shared boolean", _marked((k + 1) * band if carry is not None else -1))
            marked = scratch.keep(marked, f"marked-{k}")
            merged = marked.groupBy("hi", "lo").agg(F.min("first").alias("first"), F.sum("members").alias("members"), F.min("childless").alias("childless"), F.min("shard").alias("owner"))
            if carry is not None:
                merged = merged.join(carry, ["hi", "lo"], "left").withColumn("carried", F.col("n_leaves").isNotNull())
                merged = merged.withColumn("childless", F.col("childless") & (F.coalesce("n_children", F.lit(0)) == 0))
            else:
                merged = merged.withColumns({"n_children": F.lit(None).cast("long"), "n_leaves": F.lit(None).cast("long"), "below": F.lit(None).cast("long"), "carried": F.lit(False)})
            news = marked.select("shard", "node", "hi", "lo").join(merged, ["hi", "lo"])
            news = news.groupBy("shard").agg(F.collect_list(F.struct("node", "first", "members", "childless", "owner", "carried", "n_children", "n_leaves", "below")).alias("news"))  # at most a shard's nodes
            sums = scratch.keep(per_batch(tries.join(news, "shard", "left"), NODES, _summed), f"nodes-{k}")
            whole = sums.where("shared").groupBy("hi", "lo").agg(F.first("depth").alias("depth"), F.first("conv_id").alias("conv_id"), F.first("parent_conv_id").alias("parent_conv_id"), F.first("n_convs").alias("n_convs"), *(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")))
            both = sums.where("NOT shared").drop("shared").unionByName(whole)
            nodes.append(both if k == 0 else both.where(F.col("depth") > k * band))
            roots = both.where(F.col("depth") == k * band).select("hi", "lo", "n_children", "n_leaves", F.col("saved_tokens").alias("below"))
        if k:
            own = alone.where(F.col("band") == k).drop("band")
            carry = scratch.keep(own if roots is None else own.unionByName(roots), f"carry-{k}")
    if not nodes:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    joined = nodes[0]
    for more in nodes[1:]:
        joined = joined.unionByName(more)
    final = Window.partitionBy("conv_id")
    ends = every.withColumn("last", F.max("band").over(final)).where("band = last")
    joined = joined.join(_ends(ends), ["hi", "lo"], "left")
    return joined.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
