"""One query for each operator, over its whole table with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import Scratch
from .bpe import count_ids, decode_ids, encode_texts
from .chat import as_events, fold, read_loss, read_turns, render
from .chat_repair import FOLLOW, damage, repair_conversations
from .decontaminate import find_contamination
from .fingerprints import compare_edited
from .langid import held_out, identify, train
from .licenses import TEMPLATES, scan_licenses, size_bounds, template_words
from .ngram_join import jaccard_classes
from .packing import pack
from .phrases import mine_phrases
from .substring_dedup import remove_repeats
from .url_filter import judge
from .warc import base32_sha1, deduplicate, read_archives, write_archives


#: Rules of op4_url_filter: verdict, host and path.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    none, date = F.lit(None).cast("string"), "2024-01-01T00:00:00Z"
    records = pages.select(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"), F.lit("response").alias("record_type"), F.col("url").alias("uri"),
        F.lit(date).alias("date"), base32_sha1(F.col("payload").cast("binary")).alias("digest"), "payload", none.alias("refers_to"), none.alias("refers_to_uri"), none.alias("refers_to_date"),
    )
    write_archives(records, f"{scratch.path}/crawl")
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    rank = F.struct(page("record_id").isNull().alias("none"), page("record_id").alias("page"), "file", "offset")
    deduplicate(spark, f"{scratch.path}/crawl", f"{scratch.path}/archive", rank, date)
    scratch.drop("crawl")
    back = read_archives(spark, f"{scratch.path}/archive").select("record_id", "record_type", "digest", "length", "refers_to")
    back = scratch.save(back, "headers")
    scratch.drop("archive")
    original = scratch.save(back.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to"), "digest").agg(F.max("length").alias("full")), "lengths")
    again = back.where("record_type = 'revisit'").join(original.hint("merge"), ["refers_to", "digest"]).select("record_id", "record_type", "digest", F.col("full").alias("length"), "refers_to")
    every = again.unionByName(back.where("record_type = 'response'"))
    return every.select(page("record_id").alias("page_id"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(_table(spark, sf_dir, "pages"), URL_RULES)
    return out.withColumns({c: F.round(c, 9) for c in ("trust", "distrust")})


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    names, net = train(docs.where(~held_out()))
    out = identify(docs, names, net)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("spans")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    chats = render(fold(as_events(rows.unionByName(more), revised=True)))
    turns = F.concat_ws("", F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))))
    back = chats.select("conversation", "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(read_loss(F.col("formatted"), F.col("mask")), "").alias("loss"))
    return back.select(
        F.col("conversation").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = encode_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    back = decode_ids(coded, path)
    return back.select("doc_id", count_ids().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair_conversations(damage(_table(spark, sf_dir, "conversations")))
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n")
    return out.withColumn("repaired_sha256", F.sha2(lines, 256)).drop("repaired")


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_revisits,
        op2_license_scan,
        op3_ngram_jaccard_join,
        op4_url_filter,
        op5_language_id,
        op6_substring_dedup,
        op7_benchmark_decontamination,
        op8_chat_formatting,
        op9_imatch_fingerprints,
        op10_packing,
        op11_bpe_codec,
        op12_phrase_collocations,
        op13_conversation_repair,
    )
}

_BIGRAMS = [(name, sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})) for name, texts in TEMPLATES.items() for t in texts for w in [template_words(t)]]
_TEMPLATES = ", ".join("('{}', {}, [{}])".format(name, len(b), ", ".join(f"'{x}'" for x in b)) for name, b in _BIGRAMS)
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _url_sql(damping: float = 0.85, rounds: int = 29) -> str:
    """op4 for the oracle: rules as a chain of cases, and the propagation as a join for each round."""
    fits = []
    for verdict, rule in sorted(URL_RULES, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits.append((f"(host = '{name}' or suffix(host, '.{name}')) and starts_with(path, '{slash + rest}')", verdict, rule))
    pick = lambda k: "case " + " ".join(f"when {f[0]} then '{f[k]}'" for f in fits) + " end"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    text = rf"""
with u as (select page_id, html, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end r from pages),
h as (select page_id, html, regexp_extract(r, '^[^/?#]*') raw, r from u),
p as (select page_id, html, {lower.format('raw')} host, regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') path from h),
v as materialized (select page_id, html, host, path, {pick(2)} rule, {pick(1)} fit from p),
l as (select host src, {lower.format('x')} dst, count(*) n from (select host, unnest(regexp_extract_all(html, '(?i)<[a-z][^>]*?\shref\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)', 1)) x from v where host <> '') a where host <> {lower.format('x')} group by 1, 2),
b as (select 0 kind, src host, dst "to", n from l union all select 1, dst, src, n from l),
e as materialized (select kind, host, "to", n / sum(n) over (partition by kind, host) part from b),
n as (select case fit when 'allow' then 0 else 1 end kind, host, count(*) n from v where fit is not null and host <> '' group by 1, 2),
s as materialized (select kind, host, n / sum(n) over (partition by kind) score from n),
s0 as (from s),
"""
    for k in range(1, rounds + 1):
        text += f"""s{k} as materialized (select kind, host, sum(score) score from (select kind, host, score * {1 - damping!r} score from s
  union all select e.kind, e."to", a.score * part * {damping!r} from e join s{k - 1} a on a.kind = e.kind and a.host = e.host) x group by 1, 2),
"""
    return text + f"""t as (select host, coalesce(sum(case kind when 0 then score end), 0) trust, coalesce(sum(case kind when 1 then score end), 0) distrust from s{rounds} group by 1)
select page_id, v.host, path, rule, coalesce(fit, case when distrust > 0.5 * (trust + distrust) then 'block' else 'allow' end) verdict, round(coalesce(trust, 0), 9) trust, round(coalesce(distrust, 0), 9) distrust
from v left join t on t.host = v.host"""


def _crc_table() -> list[int]:
    """What a byte alone makes of the checksum's register, by the usual polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [(x >> 1) ^ (0xEDB88320 if x & 1 else 0) for x in table]
    return table


def _repair_sql() -> str:
    """op13 for the oracle: from row to row, the cheapest way into each state; no spans."""
    steps = ", ".join(f"('{p}', '{q}')" for p, follow in FOLLOW.items() for q in follow)
    return rf"""
with recursive src as (select conv_id, turn, coalesce(role, ' ') r, coalesce(text, ' ') t, list_reduce([4294967295::ubigint] || list_transform(string_split(concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' ')), ''), lambda x: unicode(x)::ubigint),
  lambda c, b: xor(c >> 8, {_crc_table()}[(xor(c, b) & 255)::int + 1]::ubigint)) c from conversations),
kinds as (select conv_id, turn, r, t, xor(c, 4294967295::ubigint) % 20 kind from src),
hurt as (select conv_id, turn, case kind when 4 then 'user' else r end r, case kind when 1 then '' when 2 then regexp_replace(t, '[.!?]', '', 'g') else t end t, unnest(case kind when 3 then [0, 1] else [0] end) copy from kinds where kind <> 0),
nths as (select *, row_number() over (partition by conv_id, r, t order by turn nulls first, copy) nth, rtrim(t, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) body from hurt),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, r, t, copy, nth) i from nths),
rows_ as materialized (select conv_id, turn, r, t, i, left(r, 1) c, case when body = '' then 'blank' when nth > 1 then 'duplicate' when right(body, 1) not in ('.', '!', '?') then 'truncated' end fault, lag(left(r, 1)) over (partition by conv_id order by i) c0 from numbered),
step(p, q) as (values {steps}),
ins(p, q, cost, audit) as (select p, q, 5, 'I' from step where q in ('u', 'a') union all select a.p, b.q, 10, 'II' from step a join step b on b.p = a.q where a.q in ('u', 'a') and b.q in ('u', 'a') and a.p <> b.q union all select distinct p, p, 0, '' from step),
edit as materialized (select i, conv_id, p, q, cost + case when fault = 'truncated' then 5 else 0 end cost, e from (select rows_.*, step.p, step.q, unnest([case when q = c then 0 end, case when q in ('u', 'a') then 1 end]) cost, unnest(['K', 'R']) e from rows_, step where fault is null or fault = 'truncated') x where cost is not null
  union all select i, conv_id, p, p, 2, 'D' from rows_, (select distinct p from step) s),
way as (select conv_id, 0::bigint k, 'b' q, {{'c': 0::bigint, 'a': ''}} m from rows_ where i = 1
  union all select w.conv_id, w.k + 1, e.q, min({{'c': w.m.c + n.cost + e.cost, 'a': w.m.a || n.audit || e.e}}) from way w join ins n on n.p = w.q join edit e on e.conv_id is not distinct from w.conv_id and e.i = w.k + 1 and e.p = n.q group by 1, 2, 3),
done as materialized (select w.conv_id, min({{'c': w.m.c + n.cost, 'a': w.m.a || n.audit}}) m from way w join (select conv_id, max(i) k from rows_ group by 1) l on l.conv_id is not distinct from w.conv_id and l.k = w.k join ins n on n.p = w.q where n.q in ('b', 'a') group by 1),
letters as (select conv_id, unnest(string_split(m.a, '')) e, generate_subscripts(string_split(m.a, ''), 1) j from done where m.a <> ''),
placed as (select *, count(*) filter (where e <> 'I') over (partition by conv_id order by j) i, count(*) filter (where e <> 'D') over (partition by conv_id order by j) o from letters),
turns as (select l.conv_id, l.j, l.o, l.e, case when l.e = 'K' then r.r end r, case when l.e <> 'I' then r.t else '' end t, bool_or(l.o = 1 and l.e = 'K' and r.c = 's') over (partition by l.conv_id) s from placed l left join rows_ r on r.conv_id is not distinct from l.conv_id and r.i = l.i where l.e <> 'D'),
said as (select conv_id, sha256(string_agg(coalesce(r, case when (o - case when s then 1 else 0 end) % 2 = 1 then 'user' else 'assistant' end) || ':' || t, chr(10) order by j)) x from turns group by 1),
faults as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (where fault = 'blank') blank, count(*) filter (where fault = 'duplicate') duplicate, count(*) filter (where fault = 'truncated') truncated, count(*) filter (where i > 1 and c0 || c not in ('su', 'ua', 'au')) illegal from rows_ group by 1)
select o.conv_id, cast(coalesce(gaps, 0) as bigint) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, coalesce(d.m.c, 0) cost, coalesce(d.m.a, '') audit, coalesce(said.x, sha256('')) repaired_sha256
from (select distinct conv_id from conversations) o left join faults f on f.conv_id is not distinct from o.conv_id left join done d on d.conv_id is not distinct from o.conv_id left join said on said.conv_id is not distinct from o.conv_id"""


ORACLE = {
    "op13_conversation_repair": _repair_sql(),
    "op4_url_filter": _url_sql(),
    "op1_warc_revisits": r"""
with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) x from pages),
d as (select page_id, octet_length(encode(h)) n, min(page_id) over (partition by h) m,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + cast((('0x' || substr(x, 1 + 5 * (k // 4), 5))::bigint >> (15 - 5 * (k % 4))) & 31 as int), 1)), '') g from p)
select page_id, cast(n as bigint) payload_bytes, g payload_digest, case when page_id = m then 'response' else 'revisit' end record_type,
  case when page_id <> m then m end refers_to from d""",
    "op3_ngram_jaccard_join": rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, list_distinct(case when w is null or len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) s from w),
e as (select doc_id, unnest(s) x from s),
c as (select a.doc_id a, b.doc_id b, count(*) n from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from c join s x on x.doc_id = a join s y on y.doc_id = b where 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
r as (select doc_id a, doc_id b from s union select r.a, l.b from r join l on r.b = l.a)
select s.doc_id, cast(len(s) as bigint) n_shingles, c.m component_id, cast(coalesce(k.n, 0) as bigint) n_links
from s join (select a, min(b) m from r group by 1) c on c.a = s.doc_id left join (select a, count(*) n from l group by 1) k on k.a = s.doc_id""",
    "op6_substring_dedup": r"""
with w as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w from documents),
g as (select doc_id, i, array_to_string(w[i : i + 19], ' ') x from w, unnest(range(1, len(w) - 18)) t(i)),
f as (select doc_id, i, row_number() over (partition by x order by doc_id, i) k from g),
c as (select distinct doc_id, unnest(range(i, i + 20)) i from f where k > 1),
r as (select doc_id, list(i) gone from c group by 1)
select w.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(len(gone), 0) as bigint) n_removed,
  sha256(array_to_string(case when gone is null then w else list_filter(w, lambda x, i: not list_contains(gone, i)) end, ' ')) kept_sha256
from w left join r using (doc_id)""",
    "op7_benchmark_decontamination": rf"""
with d as (select doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents),
b as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where item_id is not null),
p as (select distinct item_id, least(10, len(w)) n, array_to_string(w[i : i + 9], ' ') x
      from b, unnest(range(1, greatest(1, len(w) - 9) + 1)) t(i) where len(w) > 0),
g as (select doc_id, i, k n, array_to_string(w[i : i + k - 1], ' ') x from d, (select distinct n k from p) s, unnest(range(1, len(w) - k + 2)) t(i)),
h as (select doc_id, i, p.n, item_id from g join p on g.x = p.x and g.n = p.n),
c as (select doc_id, count(distinct j) n from (select doc_id, unnest(range(i, i + n)) j from h) group by 1),
o as (select doc_id, count(distinct item_id) n, sha256(string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar))) x from h group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(c.n, 0) as bigint) n_hit, cast(coalesce(o.n, 0) as bigint) n_items,
  coalesce(o.x, sha256('')) items_sha256, c.n is not null contaminated
from d left join c using (doc_id) left join o using (doc_id)""",
    "op2_license_scan": rf"""
with s as (select doc_id, list_distinct([text] || regexp_split_to_array(text, '\n[ \t\r]*\n') || string_split(text, chr(10))) s from documents where text is not null),
l as (select doc_id, i, x, regexp_extract_all(regexp_replace({_LOWER.replace('text', 'x')}, '^copyright[ \t]*(\(c\)|©|[0-9]).*$', ''), '[a-z0-9]+') w
  from (select doc_id, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) i from documents where text is not null) z),
h as (select doc_id, i, count(*) n, count(k.x) hits from (select doc_id, i, w[j] || ' ' || w[j + 1] x from l, unnest(range(1, len(w))) r(j)) z
  left join (select distinct unnest(t) x from (values {_TEMPLATES}) v(license, n, t)) k using (x) group by 1, 2),
o as (select l.*, coalesce(2 * hits < n, false) other from l left join h using (doc_id, i)),
f as (select doc_id, i, x, other, count(*) filter (where other) over (partition by doc_id order by i) r from o),
e as (select doc_id, unnest(s) text from s union all select doc_id, string_agg(x, chr(10) order by i) from f where not other group by doc_id, r),
w as (select doc_id, regexp_extract_all(regexp_replace({_LOWER}, '(?m)^copyright[ \t]*(\(c\)|©|[0-9])[^\n]*$', '', 'g'), '[a-z0-9]+') w from e),
b as (select doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) b from w where len(w) > 1),
n as (select row_number() over () k, doc_id, b from b where len(b) <= {max(size_bounds(len(b), 0.8)[1] for _, b in _BIGRAMS)}),
t as (select * from (values {_TEMPLATES}) v(license, n, t)),
m as (select k, doc_id, license, 2.0::double * len(list_intersect(b, t)) / (len(b) + n) dice from n join t on len(b) between n / 1.5 - 1e-9 and n * 1.5 + 1e-9),
g as (select *, row_number() over (partition by k order by dice desc, license) r from m where dice >= 0.8),
d as (select doc_id, max(dice) dice, arg_min(license, (-dice, license)) license, string_agg(distinct license, ',' order by license) licenses from g where r = 1 group by 1)
select doc_id, license, coalesce(dice, 0) dice, coalesce(licenses, '') licenses from documents left join d using (doc_id)""",
    "op12_phrase_collocations": rf"""
with w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') w from (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) p from documents where text is not null) z),
one as (select lang, x, count(*) n from (select lang, unnest(w) x from w) z group by 1, 2),
two as (select lang, a, b, count(*) n from (select lang, w[i] a, w[i + 1] b from w, unnest(range(1, len(w))) t(i)) z group by 1, 2, 3 having n >= 10),
three as (select lang, a, b, c, count(*) n from (select lang, w[i] a, w[i + 1] b, w[i + 2] c from w, unnest(range(1, len(w) - 1)) t(i)) z group by 1, 2, 3, 4 having n >= 10),
cut as (select t.lang, concat(t.a, ' ', t.b) phrase, t.n a, 1 k, x.n l, y.n r from two t join one x on x.lang = t.lang and x.x = t.a join one y on y.lang = t.lang and y.x = t.b
    where not exists (from three h where h.lang = t.lang and ((h.a = t.a and h.b = t.b) or (h.b = t.a and h.c = t.b)) and 100 * h.n >= 50 * t.n)
  union all select t.lang, concat(t.a, ' ', t.b, ' ', t.c), t.n, 1, x.n, y.n from three t join one x on x.lang = t.lang and x.x = t.a join two y on y.lang = t.lang and y.a = t.b and y.b = t.c
  union all select t.lang, concat(t.a, ' ', t.b, ' ', t.c), t.n, 2, x.n, y.n from three t join two x on x.lang = t.lang and x.a = t.a and x.b = t.b join one y on y.lang = t.lang and y.x = t.c),
s as (select *, (1000000::hugeint * a * a) // (l::hugeint * r) score from cut),
m as (select *, row_number() over (partition by lang, phrase order by score, k) best from s),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from m where best = 1)
select o.lang, rank, phrase, a, l, r, cast(t.n as bigint) n, cast(score as bigint) score from o join (select lang, sum(n) n from one group by 1) t on t.lang = o.lang where rank <= 2000""",
    "op8_chat_formatting": r"""
with c as (select conv_id, turn, role, coalesce(text, '') t from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, replace(t, '\', '\\') a from c),
f as (select *, length(a) + len(regexp_extract_all(a, '<\||</?s>|<</?SYS>>|\[/?INST\]|\|>')) n from e)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn, role, t)) turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(t) end), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then t end, '' order by turn, role, t), '')) loss_sha256,
  cast(sum(n + length(role) + 10) as bigint) formatted_chars
from f group by 1""",
}
