"""Retrieval and verification: hashed embeddings, token similarity, top-k candidates, verdicts. Vectors are in vectors.py."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sql import SqlOperator, spark_sql
from ..sources.scratch import Tables

_TOKENS = "regexp_extract_all(lower(text), «[\\p{L}\\p{N}_]+», 0)"

#: Texts (id, text) -> hashed bag of tokens (id, dim, value): dim is the first 32 bits of SHA-256 modulo 64; unit length.
hashed_embedding = SqlOperator(
    "texts",
    f"""with t as (select id, unroll({_TOKENS}) as token from {{texts}}), c as (select id, hex8(token) % 64 as dim, count(*) as n from t group by id, hex8(token) % 64)
select id, dim, round(n / sqrt(sum(n * n) over (partition by id)), 9) as value from c""",
)


def hashed_vectors(texts: DataFrame, dims: int = 64) -> DataFrame:
    """Texts (id, text) -> (vec_id, embedding), the hashed bags of tokens as whole arrays; texts without tokens have none."""
    sparse = hashed_embedding(texts).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dims - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return sparse.select(F.col("id").alias("vec_id"), dense.alias("embedding"))


#: Pairs (id, a, b) of texts -> Jaccard similarity of their token sets, 0 if either is empty.
token_jaccard = SqlOperator(
    "pairs",
    f"""select id, case when items(x) = 0 or items(y) = 0 then 0.0e0 else round(1.0e0 * common(x, y)) / (items(x) + items(y) - common(x, y))), 9) end as jaccard
from (select id, uniq({_TOKENS.replace('text', 'a')}) as x, uniq({_TOKENS.replace('text', 'b')}) as y from {{pairs}}) t""",
)
#: Pairs (id, a, b) -> how many leading tokens agree, over the shorter length.
prefix_similarity = SqlOperator(
    "pairs",
    f"""with x as (select id, {_TOKENS.replace('text', 'a')} as a, {_TOKENS.replace('text', 'b')} as b from {{pairs}}), i as (select id, a, b, unroll(span(0, least(items(a), items(b)) - 1)) as k from x where items(a) > 0 and items(b) > 0),
d as (select id, min(case when AT(a, k) <> AT(b, k) then k end) as differs, max(least(items(a), items(b))) as n from i group by id)
select x.id, coalesce(round(real(coalesce(differs, n)) / n, 9), 0.0e0) as prefix from x left join d on d.id = x.id""",
)
#: Papers (paper_id, title, authors, journal, year, doi, document) -> paper_id, year, text: all parts in one.
candidate_texts = SqlOperator("papers", "select paper_id, year, concat_ws(' ', title, authors, journal, cast(year as string), doi, document) as text from {papers}")
#: The result of paper_topk by comparing every query with every paper; for the oracle and for small inputs.
paper_topk_all_pairs = SqlOperator(
    "queries papers",
    f"""with q as (select id, uniq({_TOKENS}) as x from {{queries}}), p as (select paper_id, year, uniq({_TOKENS}) as y from ({candidate_texts.sql}) c),
s as (select id, paper_id, year, round(1.0e0 * common(x, y)) / (items(x) + items(y) - common(x, y))), 9) as score, round(1.0e0 * common(x, y)) / items(y), 9) as cover from q join p on common(x, y)) > 0)
select id, paper_id, year, score, cover, cast(k as int) as k from (select *, row_number() over (partition by id order by score desc, paper_id) as k from s) r where k <= 3""",
)
#: Queries, their candidates and the papers -> verdicts: verified at 0.85 without a year at odds, needs_review at 0.65, else unverified.
#: Reasons and risk flags (joined by commas) are fixed values. Of the candidate with the largest Jaccard; the score is the largest of that, the title's and the authors'. The title's: 1 if all of it
#: stands in the query, else the largest Jaccard or share of leading tokens of the query or one of its fragments (three tokens at least, no year).
verified = SqlOperator(
    "queries candidates papers",
    f"""with b as (select q.id, coalesce(q.text, '') as text, q.years, c.paper_id, c.year, coalesce(c.score, 0.0e0) as jaccard, coalesce(p.title, '') as title, coalesce(p.authors, '') as authors
  from {{queries}} q left join {{candidates}} c on c.id = q.id and c.k = 1 left join {{papers}} p on p.paper_id = c.paper_id),
f as (select *, unroll(many(text) || regexp_extract_all(text, «[^，,。.;；\\n]+», 0)) as part from b),
t as (select *, {_TOKENS.replace('text', 'part')} as x, {_TOKENS.replace('text', 'title')} as y, {_TOKENS} as w, {_TOKENS.replace('text', 'authors')} as z from f),
u as (select *, uniq(x) as dx, uniq(y) as dy, uniq(w) as dw, uniq(z) as dz, unroll(span(0, case when items(x) > 0 and items(y) > 0 and nth(x, 0) = nth(y, 0) then least(items(x), items(y)) - 1 else 0 end)) as k from t
  where part = text or (items(x) >= 3 and not rx(part, «(?:19|20)[0-9]{{2}}»))),
v as (select id, text, years, paper_id, year, jaccard, case when items(dx) = 0 or items(dy) = 0 then 0.0e0 else 1.0e0 * common(dx, dy)) / (items(dx) + items(dy) - common(dx, dy))) end as likeness,
  case when items(x) > 0 and items(y) > 0 and leading(x, k + 1) = leading(y, k + 1) then 1.0e0 * (k + 1) / least(items(x), items(y)) else 0.0e0 end as prefix,
  case when items(y) > 0 and contains(regexp_replace(lower(text), «[^\\p{{L}}\\p{{N}}_]+», '', 'g'), regexp_replace(lower(title), «[^\\p{{L}}\\p{{N}}_]+», '', 'g')) then 1.0e0 else 0.0e0 end as inside,
  case when items(dw) = 0 or items(dz) = 0 then 0.0e0 else 1.0e0 * common(dw, dz)) / (items(dw) + items(dz) - common(dw, dz))) end as author from u),
g as (select id, text, years, paper_id, year, round(greatest(max(likeness), max(prefix), max(inside)), 9) as title_score, round(max(author), 9) as author_score, max(jaccard) as jaccard from v group by id, text, years, paper_id, year),
m as (select *, greatest(jaccard, title_score, author_score) as score, paper_id is not null and year is not null and years <> '' and not contains(years, cast(year as string)) as mismatch from g)
select id, paper_id, score, title_score, author_score, case when score >= 0.85 and not mismatch then 'verified' when score >= 0.65 and not mismatch then 'needs_review' else 'unverified' end as verdict,
  case when score >= 0.85 and not mismatch then 'high' when score >= 0.65 and not mismatch then 'medium' when score < 0.45 then 'low' else 'medium' end as confidence, mismatch as year_mismatch, paper_id is null as no_candidate,
  case when not rx(text, «\\S») then 'empty_reference' when paper_id is null then 'no_local_match' when score >= 0.85 and not mismatch then 'local_match_strong' when score >= 0.65 and not mismatch then 'local_match_partial' else 'local_match_weak' end as reason,
  case when not rx(text, «\\S») then 'empty_reference' when paper_id is null then 'no_local_match'
    else concat_ws(',', case when mismatch or score < 0.65 then 'weak_match' when score < 0.85 then 'partial_match' end, case when mismatch then 'year_mismatch' end) end as risk_flags from m""",
)
prefix_similarity.sql = prefix_similarity.sql.replace("AT(", "nth(")


# Limits of verdicts, the least tokens of a fragment, and what fragments of an entry are cut at and must not hold.
STRONG, PARTIAL, WEAK, FRAGMENT = 0.85, 0.65, 0.45, 3
_FRAGMENTS, _YEAR_IN = r"[^，,。.;；\n]+", r"(?:19|20)[0-9]{2}"


def years_of(text: Column) -> Column:
    """The years that a reference's text names, in order."""
    return F.regexp_extract_all(text, F.lit(_YEAR_IN), F.lit(0))


def _jaccard(n: Column, m: Column, common: Column) -> Column:
    return F.when((n > 0) & (m > 0), common / (n + m - common)).otherwise(F.lit(0.0))


def _leading(x: Column, y: Column) -> Column:
    """Share of the shorter array's items that agree from its beginning on; most differ in the first."""
    n = F.least(F.size(x), F.size(y))
    same = F.array_position(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda a, b: a != b), True)
    return F.when((n > 0) & (F.get(x, F.lit(0)) == F.get(y, F.lit(0))), F.when(same > 0, same - 1).otherwise(n) / n).otherwise(F.lit(0.0))


def verify(queries: DataFrame, candidates: DataFrame, papers: DataFrame) -> DataFrame:
    """Queries (id, text, and years if others than those of the text count), candidates of paper_topk and papers -> a verdict for each query, as `verified` defines it: id, paper_id,
    score, title_score, author_score, verdict, confidence, year_mismatch, no_candidate, reason, risk_flags.

    Tokens of texts, titles and authors are made once each; an entry's fragments are compared in their row, without an explode. A null
    text is empty; a query without a candidate has no paper."""
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    title, authors = F.coalesce("title", F.lit("")), F.coalesce("authors", F.lit(""))
    compact = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", "")
    known = papers.select(F.col("paper_id").alias("known_id"), tokens(title).alias("y"), F.array_distinct(tokens(authors)).alias("z"), compact(title).alias("compact"))
    best = candidates.where("k = 1").select(F.col("id").alias("best_id"), "paper_id", "year", F.col("score").alias("jaccard"))
    best = best.join(known.hint("merge"), F.col("paper_id") == F.col("known_id"), "left").drop("known_id")
    years = F.col("years") if "years" in queries.columns else F.array_join(years_of(F.coalesce("text", F.lit(""))), ",").alias("years")
    rows = queries.select("id", F.coalesce("text", F.lit("")).alias("text"), years).join(best.hint("merge"), F.col("id") == F.col("best_id"), "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"y": F.coalesce("y", none), "z": F.coalesce("z", none), "compact": F.coalesce("compact", F.lit("")), "jaccard": F.coalesce("jaccard", F.lit(0.0)), "w": tokens(F.col("text"))})
    parts = F.filter(F.transform(F.regexp_extract_all("text", F.lit(_FRAGMENTS), F.lit(0)), lambda p: F.when(~p.rlike(_YEAR_IN), tokens(p))), lambda x: F.size(x) >= FRAGMENT)
    rows = rows.withColumn("parts", F.concat(F.array("w"), parts)).withColumns({"dy": F.array_distinct("y"), "dw": F.array_distinct("w"), "both": F.size(F.array_intersect("w", "z"))})
    # in steps, as what is named twice in a lambda function is computed twice; an intersection has each item once
    sizes = F.transform("parts", lambda x: F.struct(F.size(F.array_distinct(x)).alias("n"), F.size(F.array_intersect(x, F.col("dy"))).alias("common"), _leading(x, F.col("y")).alias("leading")))
    like = F.array_max(F.transform(sizes, lambda s: F.greatest(_jaccard(s.n, F.size("dy"), s.common), s.leading)))
    inside = F.when((F.size("y") > 0) & F.contains(F.array_join("w", ""), F.col("compact")), 1.0).otherwise(0.0)
    rows = rows.withColumns({"title_score": F.round(F.greatest(like, inside), 9), "author_score": F.round(_jaccard(F.size("dw"), F.size("z"), F.col("both")), 9)})
    told = F.col("paper_id").isNotNull() & F.col("year").isNotNull() & F.coalesce((F.col("years") != "") & ~F.contains("years", F.col("year").cast("string")), F.lit(False))
    rows = rows.withColumns({"score": F.greatest("jaccard", "title_score", "author_score"), "year_mismatch": told, "no_candidate": F.col("paper_id").isNull()})
    good, fair = (F.col("score") >= STRONG) & ~F.col("year_mismatch"), (F.col("score") >= PARTIAL) & ~F.col("year_mismatch")
    blank, no = ~F.col("text").rlike(r"\S"), F.col("no_candidate")
    flags = F.concat_ws(",", F.when(F.col("year_mismatch") | (F.col("score") < PARTIAL), "weak_match").when(F.col("score") < STRONG, "partial_match"), F.when(F.col("year_mismatch"), "year_mismatch"))
    return rows.select(
        "id", "paper_id", "score", "title_score", "author_score", F.when(good, "verified").when(fair, "needs_review").otherwise("unverified").alias("verdict"),
        F.when(good, "high").when(fair, "medium").when(F.col("score") < WEAK, "low").otherwise("medium").alias("confidence"), "year_mismatch", "no_candidate",
        F.when(blank, "empty_reference").when(no, "no_local_match").when(good, "local_match_strong").when(fair, "local_match_partial").otherwise("local_match_weak").alias("reason"),
        F.when(blank, "empty_reference").when(no, "no_local_match").otherwise(flags).alias("risk_flags"),
    )


#: A group compares its queries with at most about 2 ** _BITS papers, and 2 ** _TOP pairs of them or postings at a time; a group has about _CHARS characters
#: of queries. _STEPS is not used any more; tests set it.
_BITS, _TOP, _CHARS, _STEPS = 12, 21, 4_000_000, ()


def _score(common: Column, n: Column, m: Column) -> Column:
    return F.round(common.cast("double") / (n + m - common), 9)


def _first(keys: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the k first of their key by score descending and place, and the ranks of these from 1."""
    order = np.lexsort((place, -score, keys))
    keys = keys[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    rank = np.arange(len(keys)) - np.repeat(start, np.diff(np.append(start, len(keys))))
    return order[rank < k], rank[rank < k] + 1


def _nearest(k: int, pairs: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Queries (id, words) and papers (paper_id, year, words) of a group -> id, paper_id, year, n, m, common, k: the k best of these papers for each id."""

    def counted(asked: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("paper_id")
        words = pc.split_pattern(known["words"].combine_chunks(), " ")
        m, size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64), len(known)
        vocabulary = pc.unique(words.flatten())
        token = pc.index_in(words.flatten(), value_set=vocabulary).to_numpy(zero_copy_only=False)
        lists, length = np.repeat(np.arange(size), m)[np.argsort(token, kind="stable")], np.bincount(token, minlength=len(vocabulary))
        begin = np.cumsum(length) - length
        words = pc.split_pattern(asked["words"].combine_chunks(), " ")
        n = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        token = pc.fill_null(pc.index_in(words.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
        row, token = np.repeat(np.arange(len(n)), n)[token >= 0], token[token >= 0]
        part = np.cumsum(np.bincount(row, weights=length[token], minlength=len(n)) + size) // pairs
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(n)]
        found = []
        for a, e in zip(cuts, cuts[1:], strict=False):
            i, j = np.searchsorted(row, [a, e])
            many = length[token[i:j]]
            at = np.arange(many.sum()) + np.repeat(begin[token[i:j]] - np.cumsum(many) + many, many)
            common = np.bincount(np.repeat((row[i:j] - a) * size, many) + lists[at], minlength=(e - a) * size).reshape(e - a, size)
            union = n[a:e, None] + m - common
            near = common / union
            last = np.partition(near, size - k, axis=1)[:, size - k, None] if size > k else 0.0
            r, p = np.nonzero((common > 0) & (near >= last - 1e-8))  # all that could be among the k best once rounded
            c, u = common[r, p], union[r, p]
            score = (2_000_000_000 * c + u) // (2 * u)  # nine digits, half up, exact
            kept, _ = _first(r, score, p, k)
            found.append((r[kept] + a, p[kept], c[kept], score[kept]))
        r, p, c, score = (np.concatenate(x) for x in zip(*found, strict=True))
        ids = asked["id"].to_numpy()
        kept, rank = _first(ids[r], score, p, k)
        r, p, c = r[kept], p[kept], c[kept]
        out = known.select(["paper_id", "year"]).take(pa.array(p))
        return pa.table({"id": ids[r], "paper_id": out["paper_id"], "year": out["year"], "n": n[r], "m": m[p], "common": c, "k": rank.astype(np.int32)})

    def nearest(asked: pa.Table, known: pa.Table) -> pa.Table:
        if len(asked) and len(known):
            return counted(asked, known)
        none = {c: pa.array([], pa.int64()) for c in ("id", "paper_id", "year", "n", "m", "common", "k")}
        return pa.table(none | {"year": pa.array([], known.schema.field("year").type), "k": pa.array([], pa.int32())})

    return nearest


def paper_topk(queries: DataFrame, papers: DataFrame, k: int = 3) -> DataFrame:
    """The k papers with the largest token Jaccard to each query (id, text), of those that share a token with it; ties by id.

    A paper's text is that of candidate_texts. Exact, by dealing both sides: queries are dealt by id to groups of about _CHARS characters,
    papers to blocks of about 2 ** _BITS papers (fewer if they are long). Each group of queries meets each block of papers in one cogroup, which
    counts common tokens by an inverted index of the block and keeps k papers of it for each query; with several blocks a window keeps
    the best of those. Overlaps never leave a task. What is shuffled is each query's tokens once for each block, and the papers once for each group.

    Returns id, paper_id, year, score, cover (share of the paper's tokens) and k. Queries and papers without tokens or ids are left
    out; ids of papers are unique (as after upsert_papers). To the driver go four numbers."""
    scratch = Tables(queries.sparkSession, "topk")
    words = F.array_join(F.expr(spark_sql(f"uniq({_TOKENS})")), " ")
    known = candidate_texts(papers).select(F.col("paper_id").cast("long").alias("paper_id"), "year", words.alias("words"))
    known = scratch.write(known.where("paper_id is not null"), "papers").where("words <> ''")
    year = known.schema["year"].dataType.simpleString()
    count, size = known.agg(F.count("*"), F.sum(F.length("words"))).first()
    if not count:
        return queries.sparkSession.createDataFrame([], f"id long, paper_id long, year {year}, score double, cover double, k int")
    asked = queries.select(F.col("id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + max((count - 1) // (1 << _BITS), size // _CHARS)
    groups = 1 + max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // _CHARS)
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.select("id", dealt("id", groups).alias("group"), words.alias("words"))
    asked = asked.withColumn("block", every(blocks) if blocks > 1 else F.lit(0))
    known = known.select("paper_id", "year", dealt("paper_id", blocks).alias("block"), "words", every(groups).alias("group"))
    pairs = asked.groupBy("group", "block").cogroup(known.groupBy("group", "block"))
    found = pairs.applyInArrow(_nearest(k, 1 << _TOP), f"id long, paper_id long, year {year}, n long, m long, common long, k int")
    cover = F.round(F.col("common") / F.col("m"), 9)
    found = found.select("id", "paper_id", "year", _score(F.col("common"), F.col("n"), F.col("m")).alias("score"), cover.alias("cover"), "k")
    if blocks > 1:
        found = found.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "paper_id"))).where(F.col("k") <= k)
    return found
