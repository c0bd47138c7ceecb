"""One registered query for each training-data operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, chat, decision_list, decontaminate, host_paths, line_runs, mixing, order_minhash, quality_crf, token_cache, token_store, toxicity, word_runs
from .common import new_path, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_crf.score(docs, quality_crf.train(docs, table(spark, sf_dir, "labels")))


def op2_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_conversations(rows))


def op4_token_count_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_cache.count(table(spark, sf_dir, "documents"), new_path(spark, "token-counts"), tokenizer_file("word_bpe_49k.json"))


def op5_token_store_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    token_store.write(table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return token_store.read(spark, path)


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents"))


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return decision_list.apply(docs, decision_list.learn(decision_list.labelled_statistics(docs, table(spark, sf_dir, "labels"))))


def op9_qgram_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_paths.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def repeating_tails(docs: DataFrame) -> DataFrame:
    """docs, where one text in ten (by crc32 of doc_id) repeats a stretch of its words to its end. A null doc_id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words")).withColumn("n", F.size("words").cast("long"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    word = lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    tail = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), word), " ")
    return docs.select("doc_id", F.when(F.col("n") > 0, tail).otherwise(F.col("text")).alias("text"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs.find(repeating_tails(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op12_dangling_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.count_links(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_runs.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_crf, op2_toxicity_lexicon, op3_chat_format, op4_token_count_cache, op5_token_store_elias_fano,
        op6_order_minhash, op7_poisson_mix, op8_decision_list, op9_qgram_decontaminate, op10_host_paths, op11_word_runs, op12_dangling_suffixes, op13_line_runs,
    )
}

#: Rates here stay below mixing.PART, so that each document needs one number.
SQL: dict[str, str] = {
    "op3_chat_format": r"""
        with said as (select conv_id, turn, role, text from conversations
                      union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        t as (select conv_id, case when conv_id is null then row_number() over () end as own, turn, coalesce(role, '') as role, coalesce(text, '') as text from said),
        e as (select *, length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '</?s>|\[/?(?:INST|SYS|ROLE)\]|\[TEXT\]')) as body,
                     length(role) + length(role) - length(replace(role, '\', '')) + len(regexp_extract_all(role, '</?s>|\[/?(?:INST|SYS|ROLE)\]|\[TEXT\]')) as named from t)
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
               coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
               (3 + sum(body + case role when 'assistant' then 4 when 'user' then 13 when 'system' then 11 else 19 + named end))::bigint as formatted_chars, (-1)::integer as rewrites_at
        from e group by conv_id, own""",
    "op7_poisson_mix": """
        with counts as (select coalesce(source, '') as src, count(*) as n from documents group by 1),
        whole as (select sum(pow(n, 0.5)) as w, sum(n) as n from counts),
        rates as (select src, whole.n * pow(counts.n, 0.5) / whole.w / counts.n as rate from counts, whole),
        pmf as (select src, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) as p from rates, range(0, 400) as r(k)),
        cdf as (select src, k, sum(p) over (partition by src order by k) as c from pmf),
        drawn as (select d.*, ('0x' || substr(md5('17|' || coalesce(cast(doc_id as varchar), '') || '|0'), 1, 13))::bigint / 4503599627370496.0 as u from documents d),
        counted as (select doc_id, text, lang, d.source, n_chars, (select count(*) from cdf where cdf.src = coalesce(d.source, '') and cdf.c <= d.u) as n from drawn d)
        select doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::integer as copy from counted where n > 0""",
    "op13_line_runs": r"""
        with l as (select doc_id, p, s[p] as line, translate(trim(s[p], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
                   from (select doc_id, s, unnest(range(1, len(s) + 1)) as p from (select doc_id, string_split(coalesce(text, ''), chr(10)) as s from documents))),
        f as (select k, min(doc_id) as first from l where length(k) >= 10 group by k),
        m as (select l.doc_id, p, line, coalesce(l.doc_id > f.first, false) as gone from l left join f on f.k = l.k)
        select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by p) filter (where not gone), '')) as kept_sha256
        from m group by doc_id""",
}
