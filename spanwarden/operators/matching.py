"""Documents that hold a known text whole."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a known text that documents are probed with.
PROBE = 48
#: Characters at the start of a shorter one that documents are probed with, and how many of these one expression looks for.
START, LISTED = 8, 2000


def containing(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, item_id for each document (doc_id, text) that contains a known text (item_id, known).

    Every known text is posted under the hash of the PROBE characters after its first blank; documents under the
    hashes of the PROBE characters after each of theirs, ids alone. What meets is checked on the whole texts, which
    are fetched by id. Texts without so much after a blank are looked for by one expression if they are at most LISTED,
    and else meet documents on their first START characters, or all of them if they are shorter.
    """
    at = F.instr("known", " ")
    posted = known.withColumn("probe", F.when((at > 0) & (F.char_length("known") >= at + PROBE), F.xxhash64(F.substring(F.col("known"), at + 1, F.lit(PROBE)))))
    short = posted.where("probe IS NULL AND known <> ''")
    long = posted.where("probe IS NOT NULL")
    after_blank = F.regexp_extract_all("text", F.lit(f"(?s) (?=(.{{{PROBE}}}))"), F.lit(1))  # the look-ahead keeps every blank a start
    probes = docs.select("doc_id", F.explode(F.array_distinct(F.transform(after_blank, lambda p: F.xxhash64(p)))).alias("probe"))
    met = probes.join(long.select("probe", "item_id"), "probe").select("doc_id", "item_id").distinct()
    near = met.join(docs.select("doc_id", "text"), "doc_id").join(long.select("item_id", "known"), "item_id").where(F.contains(F.col("text"), F.col("known"))).select("doc_id", "item_id")
    return near.union(_short(docs, short.select("item_id", "known"))).distinct()


def _short(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, item_id of documents and the short known texts that they contain."""
    rows = known.limit(LISTED + 1).collect()
    if not rows:
        return docs.limit(0).select("doc_id", F.lit(None).cast(known.schema["item_id"].dataType).alias("item_id"))
    if len(rows) <= LISTED:
        kind = known.schema["item_id"].dataType.simpleString()
        listed = F.from_json(F.lit(json.dumps([{"item_id": r.item_id, "known": r.known} for r in rows])), f"array<struct<item_id:{kind},known:string>>")
        return docs.select("doc_id", F.explode(F.filter(listed, lambda k: F.contains(F.col("text"), k["known"]))).alias("k")).select("doc_id", "k.item_id")
    size = F.least(F.char_length("known"), F.lit(START))
    posted = known.select("item_id", "known", size.alias("size"), F.xxhash64(F.substring(F.col("known"), F.lit(1), size)).alias("probe"))
    met = None
    for r in posted.select("size").distinct().collect():  # at most START lengths
        n = F.char_length("text") - r.size + 1
        starts = F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), _hash_of(r.size))))
        probes = docs.select("doc_id", F.explode(starts).alias("probe"))
        found = probes.join(posted.where(F.col("size") == r.size).select("probe", "item_id"), "probe").select("doc_id", "item_id")
        met = found if met is None else met.union(found)
    checked = met.distinct().join(docs.select("doc_id", "text"), "doc_id").join(known, "item_id")
    return checked.where(F.contains(F.col("text"), F.col("known"))).select("doc_id", "item_id")


def _hash_of(size: int):
    """The hash of so many characters of the text from a place on."""
    return lambda i: F.xxhash64(F.substring(F.col("text"), i, F.lit(size)))
