"""The opN_<name> queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from larkspur.llm import byte_bpe, filter_audit, fingerprints, html_extract, language_id, lexical_search, merge_dropout, mixing, near_dedup, quality, toxicity, url_filters, vector_search
from larkspur.llm.common import table

#: The SentencePiece model (merge type, with byte fallback) that op2 encodes with.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The rank file, of the public tokenizers, that op13 encodes with.
BYTE_RANKS = "byte_bpe_50k.tiktoken"
#: The rules of op8: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = merge_dropout.encode_documents(table(spark, sf_dir, "documents"), merge_dropout.load_model(PIECE_MODEL))
    return coded.select("doc_id", F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_xxhash64"), "lossless")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = language_id.held_out(F.col("doc_id"), 4, 2)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held)
    model = toxicity.fit(docs, labels)
    return toxicity.score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf_dir, "embeddings"), "id % 20 = 0", k=20)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_id.held_out(F.col("doc_id"), 3, 1)
    classifier = language_id.fit(docs.select("doc_id", "text", "lang").filter(~held))
    judged = language_id.identify(docs.select("doc_id", "text"), classifier)
    return judged.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), rules)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer, _ = quality.fit(docs)
    return quality.score_quality(docs, scorer).select("doc_id", F.col("quality_score").alias("score"), (~F.col("rejected")).alias("kept"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return filter_audit.audit_filters(docs.select("doc_id", "text", "source"), labels).select("part", "filter_order", "step", *filter_audit.COUNTS, "shapley")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = byte_bpe.load_ranks(public_tokenizers.path(BYTE_RANKS)), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = byte_bpe.decode_ids(byte_bpe.encode_documents(docs, ranks, pattern), ranks, pattern)
    numbers = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(numbers, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_merge_dropout": op2_merge_dropout,
    "op3_toxicity": op3_toxicity,
    "op4_html_extract": op4_html_extract,
    "op5_vector_search": op5_vector_search,
    "op6_fingerprints": op6_fingerprints,
    "op7_language_id": op7_language_id,
    "op8_url_filters": op8_url_filters,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality": op10_quality,
    "op11_lexical_search": op11_lexical_search,
    "op12_filter_audit": op12_filter_audit,
    "op13_byte_bpe": op13_byte_bpe,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op1_mixing": r"""
with sizes as (
    select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) size from documents
), total as (
    select source, cast(sum(size) as bigint) source_size from sizes group by source
), ranked as (
    select *, cast([3, 1, 2][1 + (row_number() over (order by source asc nulls last) - 1) % 3] as double) weight, source_size * 2.0::double cap from total
), levelled as (
    select *, (sum(source_size) over ()::double * 1.5::double
               - coalesce(sum(cap) over (order by cap / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0))
              / sum(weight) over (order by cap / weight, source asc nulls last rows between current row and unbounded following) at_level
    from ranked
), level as (
    select max(at_level) l from levelled where at_level <= cap / weight
), targets as (
    select source, source_size, least(cap, coalesce(l * weight, cap)) target from ranked, level
), rated as (
    select doc_id, size, s.source, source_size, target, case when source_size > 0 then target / source_size else 0 end rate, count(*) over (partition by s.source) n_rows,
           cast(cast('0x' || substr(md5('mix-1:' || coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) as double) / 4503599627370496.0::double draw,
           cast(cast('0x' || substr(md5('mix-1-group:' || coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) as double) / 4503599627370496.0::double grouped
    from sizes s join targets t on s.source is not distinct from t.source
), spread as (
    select *, cast(floor(grouped * ceil(n_rows / 2000.0::double)) as bigint) g, rate - floor(rate) part from rated
), placed as (
    select *, cast(row_number() over (partition by source, g order by size, draw, doc_id nulls first) - 1 as double) place,
           cast(cast('0x' || substr(md5('mix-1-start:' || case when source is null then 'true' else 'false' end || ':' || coalesce(source, '') || ':' || g), 1, 13) as bigint) as double) / 4503599627370496.0::double start
    from spread
)
select doc_id, size, source_size, target,
       cast(size * (floor(rate) + case when floor((place + 1) * part + start) > floor(place * part + start) then 1 else 0 end) as bigint) taken
from placed
""",
    "op8_url_filters": r"""
with parts as (
    select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) path
    from pages
), judged as (
    select page_id, host, path, case
        when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/7') then 'example.com/en/7'
        when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/de/8') then 'example.net/de/8'
        when (host = 'com' or host like '%.com') and starts_with(path, '/en/') then 'com/en/'
        when (host = 'net' or host like '%.net') and starts_with(path, '/de/') then 'net/de/'
        when (host = 'org' or host like '%.org') and starts_with(path, '/es/') then 'org/es/' end rule
    from parts
)
select page_id, host, path, rule, case when rule in ('com/en/', 'example.net/de/8', 'org/es/') then 'block' else 'allow' end verdict
from judged
""",
    "op11_lexical_search": r"""
with terms as (
    select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') t from documents
), held as (
    select doc_id, len(t) n, t from terms where len(t) > 0
), corpus as (
    select count(*) big_n, cast(coalesce(sum(n), 0) as bigint) l from held
), asked as (
    select item_id, term, count(*) repeats
    from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark)
    group by item_id, term
), postings as (
    select doc_id, n, term, count(*) tf from (select doc_id, n, unnest(t) term from held) group by doc_id, n, term
), df as (
    select term, count(*) df from postings group by term
), weights as (
    select term, cast(floor(1000 * ln((2.0::double * big_n + 2) / (2.0::double * df + 1))) as bigint) w from df, corpus
), scored as (
    select item_id, doc_id, cast(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // l)))) as bigint) score
    from asked join postings using (term) join weights using (term), corpus group by item_id, doc_id
), ranked as (
    select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) rank, doc_id, score from scored where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 10
""",
    "op12_filter_audit": r"""
with words as (
    select doc_id, coalesce(source, '') part, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents
), least as (
    select coalesce(text, '') text, min(doc_id) least from documents group by 1
), told as (
    select doc_id, max(case when quality = 1 then 1 else 0 end) good, max(case when toxic = 1 then 1 else 0 end) toxic from labels group by doc_id
), judged as (
    select part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
                  100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text),
                  regexp_matches(text, '[#$%&*|]'), coalesce(d.doc_id > l.least, false)] fails,
           coalesce(good, 0) good, coalesce(toxic, 0) toxic
    from words d join least l using (text) left join told t on d.doc_id = t.doc_id
), letters as (
    select unnest([1, 2, 3, 4, 5]) f
), orders as (
    select [a.f, b.f, c.f, d.f, e.f] o from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps as (
    select array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') filter_order, step, o[step] f, o[:step - 1] before
    from orders, (select unnest([1, 2, 3, 4, 5]) step)
), grouped as (
    select part, fails, count(*) n, sum(good) good, sum(toxic) toxic from judged group by part, fails
), met as (
    select part, filter_order, step, f, n, good, toxic, fails[f] falls,
           len(list_filter(before, lambda x: fails[x])) = 0 there,
           len(list_filter(fails, lambda x: x)) = 1 alone
    from grouped, steps
), counted as (
    select part, filter_order, step, f,
           sum(case when there and not falls then n else 0 end) kept, sum(case when there and falls then n else 0 end) removed,
           sum(case when falls and not there then n else 0 end) redundant, sum(case when falls and alone then n else 0 end) unique_fails,
           sum(case when there and falls then good else 0 end) good_lost, sum(case when there and falls then toxic else 0 end) toxic_lost
    from met group by part, filter_order, step, f
)
select part, filter_order, cast(step as integer) step, cast(kept as bigint) kept, cast(removed as bigint) removed, cast(redundant as bigint) redundant,
       cast(unique_fails as bigint) unique_fails, cast(good_lost as bigint) good_lost, cast(toxic_lost as bigint) toxic_lost,
       cast(sum(removed) over (partition by part, f) as bigint) shapley
from counted
""",
}
