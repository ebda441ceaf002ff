"""The queries opN_<name> of this subpackage, and SQL for those SQL can express."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.storage import shared_folder

from . import kmeans, langid, licenses, lines, mixing, pii, quality, simhash, suffixes, tokencounts, tokenize, topk
from .common import table


#: The tokenizer that production queries use.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The tokenizer whose tokens op12 counts.
COUNTED = "byte_bpe_50k.json"


def op1_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of 64-bit SimHashes of 4-word shingles within 4 bits."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return out.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, base rule and weak-supervision verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.judge(docs, keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings that start in an earlier one."""
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document for capped weights 1, 2, 3 of its source."""
    out = mixing.mix_sizes(table(spark, sf_dir, "documents"), weights=(1, 2, 3), max_epochs=3)
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('42:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as key
  from documents
), s as (
  select source, sum(size)::bigint as source_size, 3 * sum(size)::bigint as cap,
         (1 + (row_number() over (order by encode(source) nulls last) - 1) % 3)::bigint as weight
  from d group by source
), l as (
  select *, sum(source_size) over () - coalesce(sum(cap) over w, 0) as left_words,
         sum(weight) over () - coalesce(sum(weight) over w, 0) as left_weight
  from s window w as (order by cap::double / weight, encode(source) nulls last rows between unbounded preceding and 1 preceding)
), c as (select *, left_words * weight >= cap * left_weight as clamped from l),
lev as (select max({'a': left_weight, 'b': left_words}) filter (not clamped) as v from c),
t as (
  select source, source_size,
         case when clamped then cap::double else (v.b * weight)::bigint::double / v.a::double end as target
  from c, lev
), u as (
  select *, coalesce(floor(target / nullif(source_size, 0)), 0)::bigint as whole from t
), k as (
  select d.*, u.source_size, u.target, u.whole, u.target - (u.whole * u.source_size)::double as wanted,
         sum(size) over (partition by d.source order by key rows between unbounded preceding and current row) as upto
  from d join u on d.source is not distinct from u.source
)
select doc_id, size, source_size, target,
       (size * (whole + case when wanted > 0 and whole < 3 and (2 * upto - size)::double <= 2 * wanted then 1 else 0 end))::bigint as taken
from k
"""


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and whether they decode to its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = tokenize.encode(docs, MODEL, verified="round_trip", memo=800_000)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best other vectors of every 50th vector, by integer inner product."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


OP6_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by PPM code lengths."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.identify(docs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an equal line precedes, or one within an edit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long"))
    out = lines.dedup(docs, short=True)
    return out.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join("dropped", ",").alias("dropped"), F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as pos from documents
), o as (select * from l where length(line) >= 20 or regexp_matches(line, '[\p{L}\p{N}]')),
d as (select line, min({'d': doc_id, 'a': pos}) as first, length(line) as n from o group by line),
e as (select * from d where n >= 20),
s as (
  select line, first, n, n as m, unnest(['a' || left(line, n // 2), 'b' || right(line, n - n // 2)]) as key, 0 as role from e
  union all
  select line, first, n, n - 1, unnest(['a' || left(line, (n - 1) // 2), 'b' || right(line, n - 1 - (n - 1) // 2)]), 1 from e
), p as (
  select distinct a.line as x, b.line as y, a.first as fx, b.first as fy
  from s a join s b on a.role = 0 and a.m = b.m and a.key = b.key and a.line <> b.line
), v as (
  select * from p where case when length(x) = length(y)
    then len(list_filter(range(1, length(x) + 1), lambda i: substring(x, i, 1) <> substring(y, i, 1))) <= 1
    else len(list_filter(range(1, length(y) + 1), lambda i: left(y, i - 1) || substring(y, i + 1) = x)) > 0 end
), near as (select distinct case when fx < fy then y else x end as line from v),
gone as (
  select o.doc_id, o.pos from o join d on o.line = d.line
  where o.line in (select line from near) or {'d': o.doc_id, 'a': o.pos} > d.first
)
select l.doc_id, count(*)::bigint as n_lines, count(g.pos)::bigint as n_dropped,
       coalesce(string_agg(l.pos::varchar, ',' order by l.pos) filter (g.pos is not null), '') as dropped,
       sha256(coalesce(string_agg(line, chr(10) order by l.pos) filter (g.pos is null), '')) as kept_sha256
from l left join gone g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id
"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template matches of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = licenses.scan(docs)
    base, more = F.col("phrases"), F.col("blocks")
    labels = F.array_sort(F.array_union(base["label"], more["label"]))
    score = F.greatest(F.coalesce(F.array_max(more["containment"]), F.lit(0.0)), F.when(F.size(base) > 0, 1.0).otherwise(0.0))
    return out.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base["word"]).cast("long").alias("first_word"), F.array_max(base["word"]).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base["label"])), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )


def _op9_sql() -> str:
    def starts(phrase: str) -> str:
        p = phrase.split()
        same = " and ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p))
        return f"[{{'label': '{licenses.PHRASES[phrase]}', 'word': i}} for i in range(0, len(w) - {len(p) - 1}) if {same}]"

    rows = ", ".join(f"('{label}', {tokens!r}, {need})" for label, tokens, need in licenses.sets())
    return rf"""
with w as (
  select row_number() over () as r, doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as t,
         list_filter(string_split_regex(t, '{licenses.APART}'), lambda x: x <> '') as w
  from documents
), p as (
  select r, doc_id, t, len(w) as n, list_concat({", ".join(map(starts, licenses.PHRASES))}) as hits from w
), template(label, tokens, need) as (values {rows}),
b as (select r, list_distinct(list_filter(string_split_regex(unnest(string_split(t, chr(10))), '{licenses.APART}'), lambda x: x <> '')) as own from w),
m as (
  select r, list(distinct label) as labels, max(share) as share
  from (select r, label, len(list_intersect(own, tokens)) as k, k::double / len(tokens)::double as share, need from b, template)
  where k >= need group by r
)
select doc_id, n::bigint as n_words, len(hits)::bigint as n_base, list_min([h.word for h in hits])::bigint as first_word,
       list_max([h.word for h in hits])::bigint as last_word, array_to_string(list_sort(list_distinct([h.label for h in hits])), ',') as base_labels,
       array_to_string(list_sort(list_distinct(list_concat([h.label for h in hits], coalesce(m.labels, [])))), ',') as labels,
       greatest(coalesce(share, 0.0), case when len(hits) > 0 then 1.0 else 0.0 end)::double as score
from p left join m using (r)
"""


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digests of spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs).select("doc_id", "pii")
    n = {k: F.size(F.filter("pii", pii.of_kinds(k))).cast("long").alias(f"n_{k}") for k in pii.BASE}
    base = F.filter("pii", pii.of_kinds(*pii.BASE))
    total, score = F.size("pii").cast("long").alias("n_pii"), F.coalesce(F.array_max(F.col("pii")["score"]), F.lit(0.0)).alias("score")
    return found.select("doc_id", *n.values(), F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"), total, score)


def _op10_sql() -> str:
    # the plain forms of the kinds' patterns: this engine has no look-behind
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": rf"\b(?:{pii.IBAN})\b",
        "secret": rf"\b(?:{pii.SECRET})|{pii.KEY_BLOCK}",
        "token": r"\b[A-Za-z0-9_-]{20,}",
        "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    }
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda j: (case when j % 2 = 1 then 1 else 2 end) * reverse({digits})[j]::int - case when j % 2 = 0 and reverse({digits})[j]::int > 4 then 9 else 0 end)) % 10 = 0"
    code = "replace(v, ' ', '')"
    values = f"list_transform(string_split({code}[5:] || {code}[1:4], ''), lambda c: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)"
    sound = {
        "ip": "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 or lpad(ltrim(x, '0'), 3, '0') > '255')) = 0",
        "card": f"case when length({digits}) between 13 and 19 then {luhn} else false end",
        "phone": f"length({digits}) between 9 and 15",
        "iban": f"list_reduce(list_prepend(0, {values}), lambda a, x: (a * (case when x > 9 then 100 else 10 end) + x) % 97) = 1",
        "token": "regexp_matches(v, '[A-Za-z]') and regexp_matches(v, '[0-9]')",
        "ssn": "v not like '000%' and v not like '666%' and v not like '9%' and substr(v, 5, 2) <> '00' and substr(v, 8) <> '0000'",
    }
    kinds = " union all ".join(
        f"select r, {k} as k, '{kind}' as kind, pos, v, {pii.KINDS[kind][2]} + case when regexp_matches(lower(right(piece, {pii.WINDOW})), '(^|[^a-z])(?:{pii.KINDS[kind][3]})') then 0.2 else 0 end as score "
        f"from (select r, unnest(m) as v, unnest(p[1:len(m)]) as piece, unnest(list_transform(range(1, len(m) + 1), "
        f"lambda i: (coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint)) as pos "
        f"from (select r, regexp_extract_all(t, '{x}') as m, string_split_regex(t, '{x}') as p from d where regexp_matches(t, '{x}'))) where {sound.get(kind, 'true')}"
        for k, (kind, x) in enumerate(patterns.items())
    )
    n = ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in pii.BASE)
    span = "kind || ':' || pos || ':' || (pos + length(v))"
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
s as (select * from ({kinds}) x where k < 4 or score >= {pii.THRESHOLD}),
a as (select r, {n}, count(*) as n_pii, max(least(score, 1.0))::double as score, string_agg({span}, ',' order by k, pos) filter (k < 4) as base, string_agg({span}, ',' order by k, pos) as spans from s group by r)
select doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in pii.BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
       coalesce(n_pii, 0) as n_pii, coalesce(score, 0.0)::double as score
from d left join a using (r)
"""


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of every vector after three Lloyd rounds of 16 centroids."""
    out = kmeans.lloyd(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64, seed="1")
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _op11_sql(rounds: int = 3) -> str:
    square = "list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = []
    for r in range(rounds + 1):
        parts.append(f"a{r} as (select r, vec_id, v, min(struct_pack(d := d, j := j)) as best from (select v.r, v.vec_id, v.v, c.j, {square} as d from v cross join c{r} c) x group by r, vec_id, v)")
        if r < rounds:
            whole = "(s - ((s % n) + n) % n) // n"  # // cuts towards zero
            parts.append(f"m{r} as (select j, list({whole} order by i)::bigint[] as v from (select best.j as j, i, sum(v[i])::hugeint as s, count(*) as n from a{r}, range(1, 65) t(i) group by 1, 2) x group by j)")
            parts.append(f"c{r + 1} as (select j, coalesce(m{r}.v, c{r}.v) as v from c{r} left join m{r} using (j))")
    return f"""
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c0 as (select j, v from (select row_number() over (order by sha256('1:' || vec_id::varchar) nulls last, v) - 1 as j, v from v) x where j < 16),
{", ".join(parts)}
select vec_id, best.j::int as cluster, best.d::bigint as distance, sum(best.d) over (partition by best.j)::bigint as cluster_inertia, sum(best.d) over ()::bigint as inertia,
       sha256(array_to_string(c{rounds}.v, ',')) as centroid_sha256
from a{rounds} join c{rounds} on best.j = c{rounds}.j
"""


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, through a cache that starts empty."""
    import public_tokenizers

    cache = f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    out = tokencounts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(COUNTED), cache, keep=["doc_id"])
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash_components, op2_quality_rules, op3_suffix_dedup, op4_mix_sources, op5_sentencepiece, op6_exact_top_k, op7_language_id, op8_line_dedup, op9_license_scan, op10_personal_data, op11_centroid_clusters, op12_token_counts)
}
SQL: dict[str, str] = {"op4_mix_sources": OP4_SQL, "op6_exact_top_k": OP6_SQL, "op8_line_dedup": OP8_SQL, "op9_license_scan": _op9_sql(), "op10_personal_data": _op10_sql(), "op11_centroid_clusters": _op11_sql()}
