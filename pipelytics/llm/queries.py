"""The registered queries of the text operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from . import bpe, hostrules, htmltext, imatch, langid, lengths, mixing, pii, ranked, simhash, spelling, toxicity, warc
from .common import documents, fold, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    model = langid.train(*langid.training_rows(docs.where(fold("doc_id", 4) != 2)))
    found = langid.identify(docs.select("doc_id", "text", (fold("doc_id", 4) == 2).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    coded = bpe.encode_decode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    found = htmltext.extract(pages)
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op4_host_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = hostrules.judge(documents(spark, folder))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate",
        "host_verdict", "kept",
    )


def op5_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    sized = materialise(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "sizes")
    mixed = mixing.mix(sized)
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies"
    )


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, folder))
    return found.select("doc_id", simhash.hex_of(F.col("simhash")).alias("fingerprint"), "component_id")


def op7_token_lengths(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("text")
    coded = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return lengths.length_histogram(coded.select("n_tokens"))


def toxicity_model(spark: SparkSession, docs: DataFrame, folder: str) -> toxicity.Model:
    """Trained on the labelled documents outside the held-out fold."""
    labels = table(spark, folder, "labels").where(fold("doc_id", 5) != 0)
    return toxicity.train_in_task(toxicity.training_rows(docs, labels))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, docs, folder))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    found = pii.detect(docs, pii.train(pii.training_texts(docs)))
    count = lambda kind: F.size(F.filter("base", lambda s: s.startswith(f"{kind}:"))).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"),
    )


#: Band of document frequencies of the lexicon in op10.
LOW, HIGH = 0.002, 0.05


def op10_imatch(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    links = materialise(imatch.successors(docs), "successors")
    terms = materialise(imatch.lexicon(docs, LOW, HIGH), "lexicon")
    pairs = imatch.edited(docs, links)
    both = pairs.select(
        "id",
        "hash",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("version"), F.col("text").alias("body")),
                F.struct(F.lit(1).alias("version"), F.col("edited").alias("body")),
            )
        ).alias("_v"),
    ).select("id", "hash", "edited_sha256", "_v.version", "_v.body")
    marked = imatch.fingerprints(both, terms, ["id", "hash", "version", "edited_sha256"], "body")
    of = lambda version: F.max(F.when(F.col("version") == version, F.col("fingerprint")))
    prints = materialise(
        marked.groupBy("id", "hash", "edited_sha256").agg(of(0).alias("fingerprint"), of(1).alias("edited_fingerprint")),
        "fingerprints",
    )
    following = prints.select(
        F.col("id").alias("next_id"), F.col("hash").alias("next_hash"), F.col("fingerprint").alias("_next")
    )
    joined = links.join(prints, ["id", "hash"]).join(following, ["next_id", "next_hash"])
    rows = joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return rows.select(
        F.when(F.col("id") != imatch.LEAST, F.col("id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        imatch.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        imatch.likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"),
    )


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.rank(documents(spark, folder).select("doc_id", "text"), table(spark, folder, "benchmark"))


def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    archives = scratch_path(spark, "warc")
    warc.write_archives(warc.typed(warc.stage(pages)), archives)
    found = warc.resolve(warc.reassemble(warc.read_records(spark, archives)))
    return found.select(
        F.col("key").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"), "status",
    )


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = materialise(spelling.counted_words(documents(spark, folder)), "vocabulary")
    return spelling.variants(vocabulary)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_byte_bpe, op3_html_text, op4_host_quality, op5_mix, op6_simhash, op7_token_lengths, op8_toxicity,
        op9_personal_data, op10_imatch, op11_ranked_search, op12_warc, op13_spelling_variants,
    )
}

#: Twins in DuckDB SQL, where SQL can express the operator.
ORACLES: dict[str, str] = {
    "op4_host_quality": r"""
        with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text,
                          regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
        u as (select r, unnest(ws) as word, generate_subscripts(ws, 1) as p, len(ws) as n from d),
        g as (select r, p, n, concat_ws(' ', word, lead(word, 1) over o, lead(word, 2) over o, lead(word, 3) over o,
                                        lead(word, 4) over o) as run from u window o as (partition by r order by p)),
        c as (select r, p, count(*) over (partition by r, run) as times from g where p + 4 <= n),
        e as (select r, count(distinct q) as n_repeat_words
              from (select r, unnest(range(p, p + 5)) as q from c where times > 1) group by r),
        l as (select *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
        m as (select doc_id, source, cast(len(ws) as bigint) as n_words,
                     cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
                     cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
                     len(ls) as n_lines, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
                     cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words from l left join e using (r)),
        b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
                     10 * n_symbols > n_words or 10 * n_dup_lines > 3 * n_lines as soft_failed from m),
        h as (select source, cast(count(*) as double) as n,
                     cast(count(*) filter (where base_failed or soft_failed) as double) as f from b group by source),
        s as (select cast(count(*) as double) as hosts, sum(n) as total, sum(f) / sum(n) as mean, sum(f * f / n) as squares,
                     sum(n * n) as square_rows from h),
        v as (select mean, mean * (1 - mean) as noise, squares - total * mean * mean - mean * (1 - mean) * (hosts - 1) as beyond,
                     mean * (1 - mean) * (total - square_rows / total - hosts + 1) as room from s),
        k as (select mean, case when noise <= 0 or room <= 0 or beyond * 1e6 <= room then 1e6
                                else greatest(room / beyond - 1, 1.0) end as weight from v),
        z as (select source, mean, weight, (f + mean * weight) / (n + weight) as rate, n + weight as total from h, k),
        j as (select source, rate, case
                  when rate - 1.6448536269514722 * sqrt(rate * (1 - rate) / (total + 1))
                       > greatest(0.5, mean + 1.0 * sqrt(mean * (1 - mean) / (weight + 1))) then 'rejected'
                  when rate + 1.6448536269514722 * sqrt(rate * (1 - rate) / (total + 1)) < mean then 'trusted'
                  else 'watched' end as host_verdict from z)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) as host_rate,
               host_verdict, not base_failed and host_verdict <> 'rejected' and (not soft_failed or host_verdict = 'trusted') as kept
        from b join j on b.source is not distinct from j.source""",
    "op11_ranked_search": r"""
        with d as (select doc_id, regexp_extract_all(
                       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
        s as (select cast(count(*) as bigint) as docs, cast(sum(len(terms)) as bigint) as words from d where len(terms) > 0),
        q as (select item_id, term, cast(count(*) as bigint) as q from (
                  select item_id, unnest(regexp_extract_all(
                      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by 1, 2),
        t as (select doc_id, n, term, cast(count(*) as bigint) as tf from (
                  select doc_id, cast(len(terms) as bigint) as n, unnest(terms) as term from d)
              where term in (select term from q) group by 1, 2, 3),
        w as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::double)) as bigint) as w
              from t, s group by term, docs),
        f as (select doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)) as f from t, s),
        r as (select item_id, doc_id, cast(sum(q * w * f) as bigint) as score from q join w using (term) join f using (term)
              group by 1, 2),
        o as (select *, row_number() over (partition by item_id order by score desc, doc_id) as place from r where score > 0)
        select item_id, cast(place as int) as rank, doc_id, score from o where place <= 10""",
    # Base 32 takes the digest's 40 hexadecimal digits five at a time, as four letters of five bits each.
    "op12_warc": """
        with p as (select page_id, coalesce(html, '') as h from pages),
        d as (select page_id, cast(strlen(h) as bigint) as payload_bytes, sha1(h) as x, max(page_id) over (partition by h) as top
              from p),
        b as (select *, list_transform(range(8), lambda k: cast('0x' || substr(x, cast(5 * k + 1 as int), 5) as int)) as v from d)
        select page_id, payload_bytes,
               list_aggregate(list_transform(range(32), lambda k:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                          cast((v[cast(k // 4 + 1 as int)] >> cast(5 * (3 - k % 4) as int)) & 31 as int) + 1, 1)),
                   'string_agg', '') as payload_digest,
               case when page_id = top then 'response' else 'revisit' end as record_type,
               case when page_id <> top then top end as refers_to, 'complete' as status
        from b""",
}
