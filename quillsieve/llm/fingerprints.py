"""I-Match fingerprints, in DataFrame operations only.

Terms are lower-cased runs of letters and digits. The lexicon holds the terms whose inverse document frequency lies in a
band. It goes to every task as one constant of the plan, so its size is bounded: at first by the mean number of terms of a
document over the band's least share of documents, and where that is more than `largest` terms, by a higher least share. A
fingerprint has one hash for each of several randomised subsets of the lexicon, large and small: the hash of the document's
sorted distinct terms in that subset, or nothing if it has none there. Two texts are near-duplicates by alike() if
two of the hashes are the same.
"""

from __future__ import annotations

import json
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import Scratch

#: Shares of the lexicon that the subsets hold.
KEEP = (1.0, *[2 / 3] * 3, *[1 / 4] * 4, *[1 / 16] * 4, *[1 / 64] * 4)
_BUCKETS = 1 << 14


def terms(text: Column) -> Column:
    """Distinct terms; none for a null or empty text."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def lexicon(docs: DataFrame, text: str = "text", least: float = 0.005, most: float = 0.25, largest: int = 100_000) -> Column:
    """The terms that between `least` and `most` of all documents have, as 16,384 lists by hash. If these are more than
    `largest` terms, those of the smallest document frequencies are not in the lexicon either; of one frequency all are or none.
    Each document counts once for a term; null and empty texts have none; without documents the lexicon is empty."""
    total = docs.count()
    df = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = Scratch(docs.sparkSession, "lexicon").save(df.where((F.col("df") >= total * least) & (F.col("df") <= total * most)), "band")
    if band.count() > largest:
        by_df = band.groupBy("df").agg(F.count("*").alias("n")).withColumn("above", F.sum("n").over(Window.orderBy(F.desc("df"))))
        lowest = by_df.where(F.col("above") <= largest).agg(F.min("df")).first()[0]
        band = band.where(F.col("df") >= F.lit(lowest if lowest is not None else 1 << 62))
    lists = band.groupBy(F.pmod(F.xxhash64("term"), F.lit(_BUCKETS)).alias("b")).agg(F.collect_list("term").alias("ts"))
    every = docs.sparkSession.range(_BUCKETS).withColumnRenamed("id", "b").join(lists.hint("merge"), "b", "left")
    rows = F.sort_array(F.collect_list(F.struct("b", F.coalesce("ts", F.array().cast("array<string>")).alias("ts"))))
    found = every.agg(F.to_json(F.transform(rows, lambda x: x.ts)).alias("lexicon")).first()
    return F.from_json(F.lit(found.lexicon), "array<array<string>>")


def fingerprint(text: Column, lists: Column, keep: tuple[float, ...] = KEEP) -> Column:
    """Hashes of the text's terms in each subset of the lexicon, in hexadecimal, joined by `:`; equal texts have equal ones.

    A text without a term in the lexicon has one hash of all its distinct terms, or of itself if it has none, in the first place."""
    inside = F.array_sort(F.filter(terms(text), lambda t: F.array_contains(F.get(lists, F.pmod(F.xxhash64(t), F.lit(_BUCKETS)).cast("int")), t)))
    own = F.concat(F.lower(F.hex(F.xxhash64(F.lit("outside"), F.array_sort(terms(text)), F.when(F.size(terms(text)) == 0, text)))), F.lit(":" * (len(keep) - 1)))
    return F.transform(F.array(inside), lambda ts: F.when(F.size(ts) == 0, own).otherwise(F.array_join(F.array(*[_hash(ts, k, share) for k, share in enumerate(keep)]), ":")))[0]


def _hash(ts: Column, k: int, share: float) -> Column:
    some = ts if share == 1 else F.filter(ts, lambda t: F.pmod(F.xxhash64(t, F.lit(k)), F.lit(1 << 20)) < int(share * (1 << 20)))
    return F.transform(F.array(some), lambda s: F.when(F.size(s) > 0, F.lower(F.hex(F.xxhash64(s)))).otherwise(""))[0]


def likeness(a: Column, b: Column) -> Column:
    """Of the subsets in which either has terms, the share in which both have the same; 1 for equal fingerprints."""
    pairs = F.filter(F.zip_with(F.split(a, ":"), F.split(b, ":"), lambda x, y: F.concat_ws(":", x, y)), lambda x: x != ":")
    same = F.filter(pairs, lambda x: F.substring_index(x, ":", 1) == F.substring_index(x, ":", -1))
    return F.when(a == b, 1.0).otherwise(F.size(same) / F.greatest(F.size(pairs), F.lit(1)))


def alike(a: Column, b: Column, least: int = 2) -> Column:
    """Whether two fingerprints are those of near-duplicates: equal ones, or `least` hashes in common. With one word in twenty
    replaced, nine texts of ten are still alike, and hardly any two unlike ones (measured in the tests)."""
    same = F.zip_with(F.split(a, ":"), F.split(b, ":"), lambda x, y: (x == y) & (x != ""))
    return (a == b) | (F.size(F.filter(same, lambda x: x)) >= least)


def _ranges(docs: DataFrame, size: int, most: int = 1 << 16) -> Column:
    """Number of the range of document ids that a row is in, from 0, for ranges of about `size` bytes of text. The limits of
    the ranges are a constant of the plan of eight bytes each; from `most` ranges on (1.5 TB of text) the ranges grow instead."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = max(1, min(most, total // size))
    if many == 1:
        return F.lit(0)
    found = docs.agg(F.percentile_approx("doc_id", [k / many for k in range(1, many)], max(10_000, 4 * many)).alias("q")).first().q
    cuts = sorted(set(found or []))
    if not cuts:
        return F.lit(0)
    step = ceil(len(cuts) ** 0.5)
    fine = [cuts[a : a + step] for a in range(0, len(cuts), step)]
    below = lambda values: F.size(F.filter(values, lambda c: c <= F.coalesce("doc_id", F.lit(-(1 << 63)))))
    constant = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    coarse = below(constant([c[0] for c in fine], "array<bigint>"))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + below(F.get(constant(fine, "array<array<bigint>>"), coarse - 1)))


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_bytes: int = 24 << 20) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document, and their likeness.

    The next document is that with the next smaller id; after the last comes the first. The edited text has its last
    floor(n/2) characters replaced by the next document's first as many, or all. Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    A null text counts as empty. Rows with one id follow each other by a hash of their text; null ids come last; a single
    row is its own next document. An empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    lists = lexicon(docs)
    rows = docs.withColumn("range", _ranges(docs, range_bytes)).withColumn("h", F.xxhash64("text"))
    heads = rows.groupBy("range").agg(F.max_by("text", F.struct("doc_id", "h")).alias("head"))
    # one row for each range: the first text of the range below it, or of the highest for the lowest
    down = Window.orderBy(F.desc("range"))
    heads = heads.select("range", F.coalesce(F.lead("head").over(down), F.first("head").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    # in each range this text stands after the last document
    after = heads.select("range", F.lit(None).cast("long").alias("doc_id"), F.col("head").alias("text"), F.lit(0).cast("long").alias("h"), F.lit(True).alias("after"))
    order = Window.partitionBy("range").orderBy("after", F.desc_nulls_last("doc_id"), F.desc("h"))
    rows = rows.withColumn("after", F.lit(False)).unionByName(after)
    rows = rows.withColumn("fingerprint", fingerprint(F.col("text"), lists)).withColumn("next", F.lead("text").over(order)).withColumn("next_fingerprint", F.lead("fingerprint").over(order)).where("not after")
    edited = F.expr("concat(substring(text, 1, length(text) - cast(floor(length(text) / 2) as int)), substring(next, 1, cast(floor(length(text) / 2) as int)))")
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    rows = rows.select("*", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited"), lists).alias("edited_fingerprint"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
