"""Jaccard self-join of documents on word n-grams with signature trees.

Documents with equal shingle sets are one class, and only its smallest id takes part. The join then has three steps.

1. Families. A class keeps its `sketch` smallest shingle hashes (all, if it has no more). Of a linked pair's sketches,
   `shared` at least are common: always for sets within the sketch, else but for a chance of P(Bin(48, 3/4) < 16) =
   2.3e-10 for a pair just at the threshold, less above it. So both contain one of the other's rarest
   `len - shared + 1` common tokens (prefix filter in order of frequency). Classes that share such a token are joined
   into families; a token that a third of all documents share is among the most frequent and hardly ever used.
2. Signature trees. A family's classes, sorted by set size and sketch, fill leaves of up to 256 near copies or
   about 85 unlike sets (of 4,096 different sketch tokens). A node holds the OR of its sketches' bitmaps, as the places of
   the bits that are set, and the range of its set sizes. The tree is traversed against itself, level by level as a Spark
   join of node pairs with their children; a pair goes on only if the sizes and the bitmaps' common bits still allow a link.
   With 2**26 bits, unlike nodes of 16,384 tokens share about 4 bits by chance, where a link needs 16, so that leaves and
   their parents prune by overlap, and all levels by size.
3. Leaf pairs. The whole shingle sets of two leaves meet in one task, which counts all intersections exactly by a
   product of 0/1 matrices, and compares `100 * intersection` with `percent * union`.
"""

from __future__ import annotations

import logging
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import connected_components
from ._scratch import Scratch, small_batches
from ._words import NOT_SPACE, grams, mix, signed, tidy, words

#: Sets and shingles of a leaf at most, sketch tokens of unlike sets in it, and the binary logarithm of a node's children.
_LEAF, _LEAF_TOKENS, _LEAF_SKETCH, _FAN = 256, 1 << 19, 1 << 12, 2
#: Bits of a node's bitmap, which is kept as the places of its set bits; a fuller one than `_FULL` can't prune and is left out.
_BITS, _FULL = 1 << 26, 1 << 14
_log = logging.getLogger(__name__)


def _sets(w, n: int):
    """For each row its sorted distinct shingle hashes."""
    g = grams(w.h, n)
    for k in range(w.hi - w.lo):
        a, b = int(w.off[k]), int(w.off[k + 1])
        if b - a >= n:
            yield np.unique(g[a : b - n + 1])
        elif b > a:
            yield mix(grams(w.h[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)


def _class(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    with np.errstate(over="ignore"):
        return tuple(int(signed(np.array([mix(s ^ np.uint64(c)).sum(dtype=np.uint64)]))[0]) for c in (0x51ED270B, 0xA3B19AC7D1F2E485))


def _sketches(n: int, sketch: int):
    def rows(batches):
        for batch in batches:
            ids = batch.column(0)
            for w in words(batch.column(1), NOT_SPACE, lower=True):
                sets = list(_sets(w, n))
                pairs = [_class(s) for s in sets]
                least = [s[:sketch] for s in sets]
                flat = signed(np.concatenate(least)) if least else np.empty(0, np.int64)
                off = np.concatenate([[0], np.cumsum([len(x) for x in least])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(w.lo, w.hi - w.lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))],
                    names=["doc_id", "n", "s1", "s2", "sketch"],
                )

    return rows


def _leaves(batches):
    """Rows sorted by family, size class and sketch: the leaf of each, numbered within the task. A leaf that has more than
    `_LEAF_SKETCH` tokens takes only sets that have half of their sketch in common with it, so that it holds near copies by
    the hundred, but fewer unlike sets, and its bitmap stays sparse."""
    part, leaf, now, held, tokens, least = TaskContext.get().partitionId(), -1, None, 0, 0, 0
    seen: set[int] = set()
    for batch in batches:
        out = []
        for family, n, sketch in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(7).to_pylist(), strict=True):
            more = seen.union(sketch)
            unlike = len(more) > _LEAF_SKETCH and 2 * (len(more) - len(seen)) > len(sketch)
            if family != now or held == _LEAF or tokens + n > _LEAF_TOKENS or n > 2 * least or unlike:
                leaf, now, held, tokens, least, more = leaf + 1, family, 0, 0, n, set(sketch)
            held, tokens, seen = held + 1, tokens + n, more
            out.append(leaf)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(out), part, np.int32)), pa.array(out, pa.int64())], names=[*batch.schema.names, "part", "leaf"])


def _nodes(leaves: DataFrame) -> DataFrame:
    """Leaves as nodes: size range, sparse bitmap of all sketches, and by how many bits fewer a sketch is told than it has tokens."""
    places = F.transform("sketch", lambda t: F.pmod(t, F.lit(_BITS)).cast("int"))
    rows = leaves.select("family", F.col("leaf").alias("node"), "n", places.alias("places"))
    return rows.groupBy("family", "node").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.size("places") - F.size(F.array_distinct("places"))).alias("slack"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("bits")
    )


def _parents(nodes: DataFrame) -> DataFrame:
    bits = F.array_distinct(F.flatten(F.collect_list("bits")))
    up = nodes.groupBy("family", F.shiftright("node", _FAN).alias("node"))
    return up.agg(F.min("least").alias("least"), F.max("most").alias("most"), F.max("slack").alias("slack"), F.when((F.count("bits") == F.count("*")) & (F.size(bits) <= _FULL), bits).alias("bits"))


def _leaf_pairs(nodes: DataFrame, deepest: int, percent: int, shared: int, scratch: Scratch) -> DataFrame:
    """Dual traversal of the trees over the leaf nodes of families with more than one leaf -> (family, x, y), x <= y.

    A pair of nodes goes on if some sizes in them allow a link and the bitmaps have as many bits in common as a linked pair's
    sketches at least. With debug logging, each level's pairs are counted: all, with fitting sizes, and with fitting bitmaps."""
    trees = [scratch.save(nodes, "nodes-0")]
    while deepest > 1:
        deepest = ceil(deepest / (1 << _FAN)) + 1  # a family's leaves need not begin at a multiple of the fan-out
        if len(trees) > 1 and deepest <= 2:
            break
        trees.append(scratch.save(_parents(trees[-1]), f"nodes-{len(trees)}"))
    top = trees[-1].select("family", "node")
    pairs = top.selectExpr("family", "node x").join(top.selectExpr("family", "node y").hint("merge"), "family").where("x <= y")
    common = "size(array_intersect(xb, yb))"
    for level in range(len(trees) - 1, -1, -1):
        down = trees[level]
        if level < len(trees) - 1:
            step = lambda side: down.selectExpr("family", f"shiftright(node, {_FAN}) {side}", f"node {side}n", f"least {side}l", f"most {side}m", f"slack {side}s", f"bits {side}b")  # noqa: E731, B023
        else:
            step = lambda side: down.selectExpr("family", f"node {side}", f"node {side}n", f"least {side}l", f"most {side}m", f"slack {side}s", f"bits {side}b")  # noqa: E731, B023
        pairs = pairs.join(step("x").hint("merge"), ["family", "x"]).join(step("y").hint("merge"), ["family", "y"])
        pairs = pairs.where("xn <= yn")
        fit = f"100 * xm >= {percent} * yl and 100 * ym >= {percent} * xl"
        bound = f"xn = yn or xb is null or yb is null or {common} + least(xs, ys) >= least({shared}, ceil(greatest(xl, yl) * {percent} / 100))"
        if _log.isEnabledFor(logging.DEBUG):
            _log.debug("level %d: %d pairs, %d by size, %d by bitmap", level, pairs.count(), pairs.where(fit).count(), pairs.where(fit).where(bound).count())
        pairs = scratch.save(pairs.where(fit).where(bound).selectExpr("family", "xn x", "yn y"), f"pairs-{level}")
    return pairs


def _whole(n: int):
    """Documents of the families with their leaves -> their shingle sets. Rows of another class under the same id drop out."""

    def rows(batches):
        for batch in batches:
            text = batch.schema.get_field_index("text")
            one, two = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("s1", "s2"))
            for w in words(batch.column(text), NOT_SPACE, lower=True):
                keep, blobs = [], []
                for k, s in enumerate(_sets(w, n)):
                    if _class(s) == (one[w.lo + k], two[w.lo + k]):
                        keep.append(w.lo + k)
                        blobs.append(s.tobytes())
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).take(at) for c in ("leaf", "id", "copies", "n")), pa.array(blobs, pa.binary())], names=["leaf", "id", "copies", "n", "tokens"])

    return rows


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections."""
    sizes = [len(s) for s in (*left, *right)]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, code, count = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    often = count > 1
    new = np.cumsum(often) - 1
    use = often[code]
    owner, code = owner[use], new[code[use]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out, step = np.zeros((len(left), len(right)), np.float32), 4096
    cuts = np.searchsorted(code, np.arange(0, int(often.sum()) + step, step))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        m = np.zeros((len(sizes), step), np.float32)
        m[owner[a:b], code[a:b] - k * step] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out.astype(np.int64)


def _links(percent: int):
    def pair(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, x, y = key
        pdf = pdf.drop_duplicates(["leaf", "id"])
        sides = [pdf[pdf["leaf"] == x], pdf[pdf["leaf"] == y]]
        sets = [[np.frombuffer(t, np.uint64) for t in s["tokens"]] for s in sides]
        ids, copies, n = ([s[c].to_numpy() for s in sides] for c in ("id", "copies", "n"))
        both = _common(*sets)
        near = 100 * both >= percent * (n[0][:, None] + n[1][None, :] - both)
        if x == y:
            np.fill_diagonal(near, False)
        out = [pd.DataFrame({"a": ids[0], "b": None, "links": near @ copies[1]})]
        if x != y:
            out.append(pd.DataFrame({"a": ids[1], "b": None, "links": near.T @ copies[0]}))
        # enough edges to keep what is connected connected
        total = near.shape[0] + (0 if x == y else near.shape[1])
        root = np.arange(total)

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        edges, base = [], 0 if x == y else near.shape[0]
        for i, j in zip(*np.nonzero(near), strict=True):
            p, q = find(i), find(base + j)
            if p != q:
                root[p] = q
                edges.append((ids[0][i], ids[1][j]))
        if edges:
            out.append(pd.DataFrame({"a": [e[0] for e in edges], "b": [e[1] for e in edges], "links": 0}))
        out = pd.concat(out)
        out["b"] = out["b"].astype("Int64")
        return out[["a", "b", "links"]]

    return pair


def _same_document(named: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between the classes of texts that share an id: they are one document, and what it reaches all of them reach."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("s1", "s2") for f in (F.min, F.max)]
    several = named.groupBy("doc_id").agg(*ends).where("min_s1 <> max_s1 or min_s2 <> max_s2").select("doc_id")
    several = scratch.save(several, "several")
    own = named.join(several.hint("merge"), "doc_id").select("doc_id", "s1", "s2").distinct().join(classes.select("s1", "s2", "id").hint("merge"), ["s1", "s2"])
    own = scratch.save(own.select("doc_id", "id"), "own")
    head = own.groupBy("doc_id").agg(F.min("id").alias("head"))
    return own.join(head.hint("merge"), "doc_id").where("id <> head").selectExpr("id a", "head b")


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75, sketch: int = 48, shared: int = 16) -> DataFrame:
    """Link documents whose sets of word n-grams have a Jaccard similarity of percent/100 or more.

    What is found is exact. Candidates are exact for sets of up to `sketch` n-grams, and for all sets where `sketch` is as
    large as the largest set (and `shared` too); with the defaults a pair of larger sets just at the threshold is missed with
    a chance of 2.3e-10.

    A-Z is lower-cased; words are runs of characters other than ASCII white space; a text of fewer words than n has its
    whole word sequence as its only shingle. Returns for each row doc_id, n_shingles, component_id (the smallest id
    reachable by links) and n_links (how many other rows it is linked with directly).

    A null or empty text, or one without words, has no shingles and is linked with nothing: its component is itself.
    Rows with one id are one document, with the words and the links of each row counted apart; what one of its texts reaches,
    all do. A null id counts as none: such rows are
    returned with a null component and zero links, and link nothing. An empty table gives an empty result; other columns
    are ignored.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = scratch.save(docs.mapInArrow(tidy(_sketches(n, sketch)), "doc_id long, n long, s1 long, s2 long, sketch array<long>"), "sketches")
    named = found.where("n > 0 and doc_id is not null")
    # a class has a number of its own, as one id may stand for texts of several classes; `least` is its smallest document
    classes = named.groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min_by("sketch", "doc_id").alias("sketch"))
    classes = scratch.save(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    tokens = classes.select("id", "n", F.explode("sketch").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    need = F.least(F.lit(shared), F.ceil(F.col("n") * percent / 100)).cast("int")
    rarest = (
        tokens.join(common.hint("merge"), "token")
        .groupBy("id", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
        .withColumn("use", F.size("t") - need + 1)
        .where("use > 0")
        .select("id", F.explode(F.slice("t", 1, F.col("use"))).alias("t"))
        .select("id", F.col("t.token").alias("token"))
    )
    rarest = scratch.save(rarest, "rarest")
    scratch.release()
    heads = rarest.groupBy("token").agg(F.min("id").alias("head"))
    families = connected_components(rarest.join(heads.hint("merge"), "token").where("id <> head").selectExpr("id a", "head b").distinct(), scratch, "families")

    placed = classes.join(families.selectExpr("node id", "component family").hint("merge"), "id")
    order = placed.select("family", F.floor(F.log("n") / F.log(F.lit(4 / 3))).alias("size_class"), "n", "id", "copies", "s1", "s2", "sketch", "least")
    leaves = order.repartitionByRange("family", "size_class", F.get("sketch", F.lit(0)), "id").sortWithinPartitions("family", "size_class", F.get("sketch", F.lit(0)), "id")
    leaves = scratch.save(leaves.mapInArrow(tidy(_leaves), "family long, size_class long, n long, id long, copies long, s1 long, s2 long, sketch array<long>, least long, part int, leaf long"), "leaves")
    # one row for each partition comes to the driver: how many leaves it has
    at, first = 0, []
    for r in sorted(leaves.groupBy("part").agg(F.max("leaf").alias("last")).collect()):
        first += [(r.part, at)]
        at += r.last + 1
    first = spark.createDataFrame(first, "part int, first long")
    leaves = leaves.join(F.broadcast(first), "part").withColumn("leaf", F.col("leaf") + F.col("first")).drop("part", "first", "size_class")
    sizes = scratch.save(leaves.groupBy("family").agg(F.min("leaf").alias("x"), (F.max("leaf") - F.min("leaf") + 1).alias("width")), "families")
    alone = sizes.where("width = 1").selectExpr("family", "x", "x y")
    # leaves become nodes before the join by family, so that no task takes the rows of a large family
    wide = _nodes(leaves).join(sizes.where("width > 1").select("family").hint("merge"), "family")
    deepest = sizes.agg(F.max("width")).first()[0] or 0
    pairs = alone.unionByName(_leaf_pairs(wide, deepest, percent, shared, scratch)) if deepest > 1 else alone

    known = docs.where("doc_id is not null").join(leaves.selectExpr("least doc_id", "id", "leaf", "copies", "n", "s1", "s2").hint("merge"), "doc_id")
    whole = scratch.save(known.mapInArrow(tidy(_whole(n)), "leaf long, id long, copies long, n long, tokens binary"), "sets")
    scratch.release()
    meet = pairs.select("family", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("leaf")).join(whole.hint("merge"), "leaf")
    links = scratch.save(meet.groupBy("family", "x", "y").applyInPandas(_links(percent), "a long, b long, links long"), "links")

    scratch.drop("sets", "leaves", "rarest")
    edges = links.where("b is not null").select("a", "b").unionByName(_same_document(named, classes, scratch))
    component = connected_components(edges, scratch, "components").join(classes.select(F.col("id").alias("node"), "least").hint("merge"), "node")
    component = scratch.save(component, "reached")
    # written, so that the adaptive skew join can split a large component
    smallest = scratch.save(component.groupBy("component").agg(F.min("least").alias("smallest")), "smallest")
    component = component.join(smallest.hint("merge"), "component").select("node", "smallest")
    degree = links.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    known = classes.select("s1", "s2", "id", "least", "copies").join(component.withColumnRenamed("node", "id").hint("merge"), "id", "left").join(degree.withColumnRenamed("a", "id").hint("merge"), "id", "left")
    known = known.select("s1", "s2", F.coalesce("smallest", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rest = found.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    out = named.join(known.hint("merge"), ["s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links").unionByName(rest)
    out = scratch.last(out, "result")
    scratch.release()
    return out
