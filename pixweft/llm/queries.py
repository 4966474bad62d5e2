"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, decontam, idfile, langid, lm, neardup, periods, quality, spelling, toxicity, urls
from .shared import documents


def op1_bpe_encoding_and_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.decode(bpe.encode(documents(spark, sf_dir)))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, others = chat.from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.link_tool_calls(calls, results, chat.REPLY, others)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def op4_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = idfile.new_path(spark)
    idfile.write(documents(spark, sf_dir), path)
    return idfile.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunk_share", "symbol_gain", "band_failed")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Digests of the runs of docs with repeated ends, and the run with the greatest length / period."""
    greatest = lambda a, b: (b["length"] * a["period"] - a["length"] * b["period"], a["start"] - b["start"], a["period"] - b["period"])

    def order(a: Column, b: Column) -> Column:
        steps = [F.signum(x).cast("int") for x in greatest(a, b)]
        return F.when(steps[0] != 0, steps[0]).when(steps[1] != 0, steps[1]).otherwise(steps[2])

    best = F.get(F.array_sort("runs", order), F.lit(0))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    out = periods.runs(docs, tails=True).withColumn("best", best)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col("best")[c].alias(c) for c in ("start", "length", "period")), F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(documents(spark, sf_dir))


def op13_spelling_variant_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(documents(spark, sf_dir), losing=97)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe_encoding_and_decoding, op2_chat_formatting, op3_url_filters, op4_token_id_output, op5_lm_scoring, op6_minhash_near_dedup, op7_toxicity, op8_language_id, op9_quality_rules, op10_benchmark_decontamination, op11_approximate_nearest_neighbours, op12_periodic_run_detection, op13_spelling_variant_grouping)}


def _op2_sql() -> str:
    """The turns' calls and results by their keys; chains by recursion."""
    return """with recursive u as (select conv_id || '-' || turn as call_id, conv_id, turn, text, conv_id || '-' || (turn - 2) as up from conversations where role = 'user'),
    a as (select conv_id || '-' || (turn - 1) as call_id, conv_id, turn, text from conversations where role = 'assistant'),
    chain as (select call_id, 0 as level from u where up not in (select call_id from u) union all select u.call_id, level + 1 from u join chain on u.up = chain.call_id),
    j as (select coalesce(u.call_id, a.call_id) as call_id, coalesce(u.conv_id, a.conv_id) as conv_id, coalesce(u.turn, a.turn) as turn, level, u.call_id is not null as called, a.call_id is not null as answered, u.turn as asked, u.text as said, a.text as content
        from u full outer join a on u.call_id = a.call_id left join chain on chain.call_id = u.call_id)
    select call_id, conv_id, turn, level::bigint as level, case when called then 'reply' end as tool, case when not called then 'orphan' when answered then 'linked' else 'unanswered' end as status,
        case when called then said is not null end as valid, case when called and said is null then 'missing text' else '' end as errors,
        '{"arguments":' || case when called then '{' || coalesce('"text":' || to_json(said) || ',', '') || '"turn":' || asked || '}' else 'null' end || ',"id":' || to_json(call_id) || ',"result":' || coalesce(to_json(content)::varchar, 'null') || ',"tool":' || case when called then '"reply"' else 'null' end || '}' as message from j
    union all select null, conv_id, turn, null, null, 'no call', null, '', '{"content":' || coalesce(to_json(text)::varchar, 'null') || ',"role":' || coalesce(to_json(role)::varchar, 'null') || '}' from conversations where coalesce(role, '') not in ('user', 'assistant')"""


def _op3_sql() -> str:
    low = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    order = sorted(urls.SITES, key=lambda s: -len(s.host + s.path))
    fits = {s: f"(host = '{s.host}' or ends_with(host, '.{s.host}')) and starts_with(path, '{s.path}')" for s in order}
    rule, verdict = ("case " + " ".join(f"when {fits[s]} then '{v(s)}'" for s in order) for v in (lambda s: s.host + s.path, lambda s: s.verdict))
    method = " or ".join(f"regexp_matches(coalesce({low('url')}, ''), '{p.regex}', 's')" for p in urls.PATTERNS)
    return f"""with p as (select page_id::bigint as page_id, url, {low("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} as host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages)
    select page_id, host, path, {rule} end as rule, {verdict} when {method} then 'block' else 'allow' end as verdict from p"""


ORACLE: dict[str, str] = {"op2_chat_formatting": _op2_sql(), "op3_url_filters": _op3_sql()}
