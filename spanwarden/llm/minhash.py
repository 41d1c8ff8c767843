"""Near-duplicate documents by a signature-coordinate inverted join.

Each document's set of word shingles gets a MinHash signature. Documents are posted under their
(coordinate, value) pairs, and a distributed count tells how many documents hold each pair. Two documents
whose signatures agree in at least MATCHES of COORDINATES places share one of the PREFIX rarest pairs of
either, so only these are joined; pairs that one document alone holds never leave it. The longer lists
outside the prefix are skipped: their collisions are counted from a packed copy of the signature, four bits
a coordinate, by XOR and a bit count inside the join condition. Pairs above the match threshold are
confirmed on full sets.

Equal sets fold into their smallest id first. A list gives pairs with its first member only; components
follow, pairs with its few hubs where they are in other components, and a last join takes what the hubs left: members of
lists that lie in different components and share one of the rarest shingles of their full sets, as similar sets do. Both
steps compare parities of the full sets, which tell how much two sets differ at least. So every pair that the threshold
retains is either inside one component already, or confirmed by itself, or too different for certain; a large group of near copies
costs few rows a member. Long lists of shingles meet in blocks of bounded size.

The threshold is on signatures: a pair at a similarity of exactly 0.8 falls short of it with odds of about
3 in 100,000, one at 0.85 with odds below 1 in 10 million. Nothing else loses a pair.

Defined results: null, empty and blank texts have an empty set and link with nothing; a text of fewer words
than a shingle is one shingle; texts of any length are read whole. A null id is a component of its own
(null) and kept. Rows that share an id are one document: it links where any of its texts does, and all its
rows with words get one component. Repeated rows stay as rows; ties go to the smallest id; an empty table gives an
empty result; columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, per_batch, small, texts, tune

COORDINATES = 64
#: Matches that a pair needs.
MATCHES = 38
PREFIX = COORDINATES - MATCHES + 1
HUBS = 8
#: Where a component with more documents than FEW shares a shingle, others face it in slices of about SLICE documents;
#: else they meet in blocks of about BLOCK documents.
FEW, SLICE, BLOCK = 32, 1024, 256
PACKED = ("f0", "f1", "f2", "f3")
#: Bits of a set, each the parity of how many of its shingles fall there: two sets differ in as many shingles at least as in bits.
PARITY = tuple(f"g{k}" for k in range(16))
_SEEDS = np.random.default_rng(20240611).integers(1, 2**63, (3, COORDINATES), dtype=np.uint64)
_XOR, _ODD = _SEEDS[0], _SEEDS[1] | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """64-bit hashes of words, made once for each."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int, hashes: Hashes) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; of fewer words, of the whole sequence."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    acc = np.full(len(h) - k + 1, np.uint64(k))
    for j in range(k):
        acc = _mix(acc * _P + h[j : len(h) - k + 1 + j])
    return np.unique(acc)


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        low = np.minimum(low, ((s[None, at : at + 4096] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1))
    return low


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, digest of the set, packed signature and the keys of each document, one a coordinate."""

    def work(batch: pa.RecordBatch, hashes: Hashes):
        ids, bodies = batch.column(0), batch.column(1).to_pylist()
        n, digest, sigs = [], [], np.zeros((len(bodies), COORDINATES), np.uint64)
        for i, text in enumerate(bodies):
            s = shingles(text, width, hashes)
            n.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            if len(s):
                sigs[i] = signature(s)
        keys = _mix(sigs + np.arange(1, COORDINATES + 1, dtype=np.uint64) * _P)
        nibbles = (_mix(sigs) >> np.uint64(60)).reshape(len(bodies), 4, 16)
        packed = (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bodies) * COORDINATES + 1, COORDINATES), pa.int32()), pa.array(keys.view(np.int64).ravel()))
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), *(pa.array(packed[:, j].copy()) for j in range(4)), lists], names=["doc_id", "n", "digest", *PACKED, "keys"])

    schema = "doc_id long, n long, digest binary, " + ", ".join(f"{f} long" for f in PACKED) + ", keys array<long>"
    return per_batch(texts(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), schema, work, lambda: (Hashes(),))


def postings(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each of a set's PREFIX rarest keys that another set holds too: key, doc_id, n and packed signature.

    Keys are ordered by how many sets hold them, then by value; those of one set alone come first and need no row.
    """
    keys = sets.select("doc_id", "other", F.explode("keys").alias("key"))
    counts = scratch.keep(keys.groupBy("key").agg(F.count("*").cast("int").alias("held")).where("held > 1"), "counts")
    shared = keys.join(counts.hint("shuffle_hash"), "key").groupBy("doc_id", "other").agg(F.sort_array(F.collect_list(F.struct("held", "key"))).alias("__keys"))
    rarest = F.slice("__keys", 1, F.greatest(F.lit(0), PREFIX - COORDINATES + F.size("__keys")))
    lists = shared.select("doc_id", "other", rarest.alias("__keys")).where(F.size("__keys") > 0).join(sets.drop("keys"), ["doc_id", "other"])
    return lists.select(F.explode("__keys.key").alias("key"), "doc_id", "n", *PACKED)


def _alike(a: str, b: str, percent: int):
    """Sizes that allow the similarity, and enough matching coordinates in the packed signatures."""
    differing = F.lit(0)
    for f in PACKED:
        x = F.col(f"{a}.{f}").bitwiseXOR(F.col(f"{b}.{f}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))  # now a nibble's lowest bit tells if any of its bits differed
        differing = differing + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    matches = COORDINATES - differing
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (matches >= MATCHES)


def _near_enough(a: str, b: str, percent: int):
    """What the parities of two sets allow: sets that differ in d shingles have (n + n' - d) / 2 in common."""
    both, differing = F.col(f"{a}.n") + F.col(f"{b}.n"), F.lit(0)
    for g in PARITY:
        differing = differing + F.bit_count(F.col(f"{a}.{g}").bitwiseXOR(F.col(f"{b}.{g}")))
    return (100 + percent) * (both - differing) >= 2 * percent * both


def parity(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s & np.uint64(64 * len(PARITY) - 1)).astype(np.int64), minlength=64 * len(PARITY)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def full_sets(docs: DataFrame, ids: DataFrame, width: int, bits: bool = False) -> DataFrame:
    """doc_id and s, the whole shingle set, of the documents in ids (doc_id); with bits their parities, too."""
    named = texts(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))

    def work(batch: pa.RecordBatch, hashes: Hashes):
        sets = [shingles(t, width, hashes) for t in batch.column(1).to_pylist()]
        ends = np.cumsum([0, *map(len, sets)])
        odd = np.array([parity(s) for s in sets]) if bits else np.empty((len(sets), 0), np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64))), *(pa.array(odd[:, k].copy()) for k in range(odd.shape[1]))], names=["doc_id", "s", *marks])

    marks = PARITY if bits else ()
    schema = ", ".join(["doc_id long, s array<long>", *(f"{g} long" for g in marks)])
    return per_batch(named.join(small(ids), "doc_id", "left_semi"), schema, work, lambda: (Hashes(),))


def confirmed(docs: DataFrame, pairs: DataFrame, width: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. No aggregate follows the joins, so Spark can split a hub's pairs."""
    ids = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{name}-ids")
    sets = scratch.keep(full_sets(docs, ids, width), f"{name}-sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return scratch.keep(both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b"), name)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node of edges (a, b): alternating large-star and small-star rounds until nothing changes."""
    e = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), f"{name}-0")
    before = None
    for k in itertools.count(1):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = scratch.keep(large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct(), f"{name}-{k}")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(f"{name}-{k - 1}")
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def sets_of(sig: DataFrame, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct sets of at least `least` shingles; the smallest id of each digest; ids whose rows hold several sets, as links.

    Sets have (doc_id, other) as their name: other is 0 but for further sets of an id that stands for several.
    """
    some = sig.where("n > 0 AND doc_id IS NOT NULL").withColumn("d", F.xxhash64("digest"))
    owners = scratch.keep(some.groupBy("digest", "d").agg(F.min("doc_id").alias("rep")), "owners")
    crowded = owners.groupBy("rep").agg(F.min("d").alias("first"), F.count("*").alias("sets")).where("sets > 1").select("rep", "first")
    other = F.when(F.coalesce(F.col("first"), F.col("d")) == F.col("d"), F.lit(0).cast("long")).otherwise(F.col("d"))
    named = owners.join(crowded, "rep", "left").select("digest", F.col("rep").alias("doc_id"), other.alias("other"))
    sets = sig.where(F.col("n") >= least).join(named, ["digest", "doc_id"]).dropDuplicates(["doc_id", "digest"]).select("doc_id", "other", "n", *PACKED, "keys")
    several = some.groupBy("doc_id").agg(F.min("d").alias("x"), F.max("d").alias("y")).where("x <> y").select("doc_id")
    links = some.select("doc_id", "digest").join(several, "doc_id", "left_semi").join(owners, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    return scratch.keep(sets, "sets"), owners, scratch.keep(links, "same-id")


def apart_and_alike(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Distinct pairs (a, b) of members (doc_id, n, packed signature, parities, part) of different parts whose signatures agree and whose sets (doc_id, s) share a rare shingle.

    Sets of n shingles that are similar enough share one of the n - ceil(n * percent / 100) + 1 rarest of either, and the first
    that they share leaves enough of both behind it. So what a whole group has, a passage or most of a copy, brings none of
    its documents together. A shingle's largest part stays in its place; the others face it and each other.
    """
    words = sets.join(members.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "s").distinct()
    words = words.select("doc_id", F.xxhash64("s").alias("own"), F.size("s").cast("long").alias("n"), F.explode("s").alias("shingle"))
    held = words.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1")
    shared = words.join(held, "shingle").groupBy("doc_id", "own", "n").agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("ws"))
    alone = F.col("n") - F.size("ws")  # these come first, and no other set has them
    rarest = F.slice("ws", F.lit(1), F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1 - alone).cast("int"))
    rare = shared.select("doc_id", "n", alone.alias("alone"), F.posexplode(F.transform(rarest, lambda w: w["shingle"])).alias("at", "shingle"))
    rare = scratch.keep(rare.join(members, ["doc_id", "n"]).withColumn("after", F.col("n") - F.col("alone") - F.col("at")).drop("alone", "at"), "rare")

    parts = rare.groupBy("shingle", "part").count().groupBy("shingle").agg(F.max_by("part", F.struct("count", "part")).alias("largest"), F.max("count").alias("most"), F.sum("count").alias("all"), F.count("*").alias("parts"))
    blocks = F.ceil(F.col("all") / F.when(F.col("most") > FEW, float(SLICE)).otherwise(float(BLOCK))).cast("int")
    rare = scratch.keep(rare.join(parts.where("parts > 1").select("shingle", "largest", blocks.alias("blocks")), "shingle"), "rare-apart")  # both sides of the join read it
    unit, spread = ("shingle", "block"), int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
    x = rare.where("part <> largest").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).repartition(spread, *unit).alias("x")
    y = rare.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).repartition(spread, *unit).alias("y")
    met = (
        (F.col("x.shingle") == F.col("y.shingle"))
        & (F.col("x.block") == F.col("y.block"))
        & (F.col("x.part") != F.col("y.part"))
        & ((F.col("y.part") == F.col("y.largest")) | (F.col("x.doc_id") < F.col("y.doc_id")))
        & ((100 + percent) * F.least("x.after", "y.after") >= percent * (F.col("x.n") + F.col("y.n")))
        & _alike("x", "y", percent)
        & _near_enough("x", "y", percent)
    )
    return x.join(y, met).select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    spark: SparkSession = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "near-duplicates")
    sig = scratch.keep(signatures(docs, width), "signatures")
    # sets of less than 4 shingles that differ are less similar than 0.8 for certain
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62
    sets, owners, same = sets_of(sig, least, scratch)
    lists = scratch.keep(postings(sets, scratch), "lists")
    for done in ("sets", "counts"):
        scratch.drop(done)

    # a list's first member in a fixed random order meets the others, so a group of near copies costs few pairs a member;
    # what this leaves in different components meets the list's hubs, its first HUBS members in that order
    ends = (F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"))
    one = lists.groupBy("key").agg(F.min(F.struct(F.xxhash64("doc_id"), "doc_id", "n", *PACKED)).alias("f"), F.count("*").alias("members")).where("members > 1")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.doc_id") != F.col("y.doc_id")) & _alike("x", "y", percent)
    pairs = lists.alias("x").join(one.select("key", "f.doc_id", "f.n", *(f"f.{c}" for c in PACKED)).alias("y"), met).select(*ends)
    met_before = scratch.keep(pairs.distinct(), "first-pairs")
    edges = confirmed(docs, met_before, width, percent, scratch, "first-links").union(same)
    found = components(edges, scratch, "first")

    def in_parts(rows: DataFrame) -> DataFrame:
        return rows.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("part", F.coalesce("root", "doc_id")).drop("root")

    lists = scratch.keep(in_parts(lists), "lists-in-parts")
    scratch.drop("lists")
    order = Window.partitionBy("key").orderBy(F.xxhash64("doc_id"), "doc_id")  # row_number <= HUBS is limited before the shuffle
    apart = lists.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    lists = scratch.keep(lists.join(apart, "key", "left_semi"), "lists-apart")
    sets = scratch.keep(full_sets(docs, lists.select("doc_id").distinct(), width, bits=True), "apart-sets")
    lists = scratch.keep(lists.join(sets.select("doc_id", F.size("s").cast("long").alias("n"), *PARITY).distinct(), ["doc_id", "n"]), "lists-with-bits")
    hubs = scratch.keep(lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= HUBS).drop("rank"), "hubs")
    pairs = lists.alias("x").join(hubs.alias("y"), met & (F.col("x.part") != F.col("y.part")) & _near_enough("x", "y", percent)).select(*ends)
    pairs = scratch.keep(pairs.distinct().join(met_before, ["a", "b"], "left_anti"), "hub-pairs")
    if not pairs.isEmpty():
        edges = confirmed(docs, pairs, width, percent, scratch, "hub-links")
        found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(edges), scratch, "hubs")
        lists = in_parts(lists.drop("part"))

    # what the hubs left: in lists that have further members, those of different components
    longer = lists.groupBy("key").count().where(F.col("count") > HUBS).select("key")
    placed = scratch.keep(lists.join(longer, "key", "left_semi"), "longer-lists")
    mixed = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    facing = scratch.keep(placed.join(mixed, "key", "left_semi").select("doc_id", "n", *PACKED, *PARITY, "part").distinct(), "facing")
    among = apart_and_alike(facing, sets, percent, scratch)
    # pairs that were refused before are not tried again
    left = scratch.keep(among.join(met_before.union(pairs), ["a", "b"], "left_anti"), "left-pairs")
    if not left.isEmpty():
        more = confirmed(docs, left, width, percent, scratch, "left-links")
        found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), scratch, "second")

    own = F.coalesce("root", "rep", "doc_id")
    return (
        sig.select("doc_id", "n", "digest")
        .join(owners.drop("d"), "digest", "left")
        .join(found, F.col("rep") == F.col("node"), "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, own).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near duplicates, the one of the smallest id; all columns stay.

    Of rows that repeat an id, all stay if the id stays.
    """
    gone = near_duplicates(docs, width, percent).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    gone = Scratch(docs.sparkSession, "deduplicated").keep(gone, "gone")
    return docs.join(small(gone), docs["doc_id"].cast("long") == F.col("__gone"), "left_anti")
