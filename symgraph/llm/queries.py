"""Queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import documents, labels


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(documents(spark, sf_dir), tokenizer())


def op2_nearest_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    return classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .recurrent_lm import lm_scores

    return lm_scores(documents(spark, sf_dir))


def op4_mixing_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(documents(spark, sf_dir), ["doc_id"]).select("doc.doc_id", "size", "source_size", "target", "taken", "copies", "shards")


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digests, scan

    return digests(scan(documents(spark, sf_dir)))


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import rules

    return rules(documents(spark, sf_dir)).drop("cleaned")


def op7_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(documents(spark, sf_dir))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import classes

    return classes(documents(spark, sf_dir)).drop("key")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    return read_token_files(write_token_files(documents(spark, sf_dir), tokenizer()))


def op10_ftrl_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    return classify(documents(spark, sf_dir), labels(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def _rules_sql() -> str:
    from .quality_rules import BOILERPLATE, NAVIGATION, SEPARATORS, SYMBOLS

    q = lambda x: "'" + x.replace("'", "''") + "'"
    spaces, word = q(r"[\x20\x09-\x0D]+"), q(r"[^\x20\x09-\x0D]+")
    count = lambda p, t: f"len(regexp_extract_all({t}, {p}))"
    failed = " or ".join([
        f"length(x) - length(regexp_replace(x, {q(SYMBOLS)}, '', 'g')) > 0.1::double * length(x)", f"regexp_matches(x, {q(NAVIGATION)})", f"3 * {count(q(SEPARATORS), 'x')} >= {count(word, 'x')}",
        f"(regexp_matches(x, {q(BOILERPLATE)}) and {count(word, 'x')} <= 30)", r"not regexp_matches(x, '\p{L}')",
        rf"(length(regexp_replace(x, '[^\p{{Lu}}]', '', 'g')) > 0.5::double * length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) and {count(word, 'x')} >= 5)",
    ])
    return f"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
 w as (select *, regexp_extract_all(text, {word}) as words, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, {spaces}, '', 'g') <> '') as lines from d),
 g as (select r, unnest(range(1, len(words) - 1)) as i, words from w where len(words) >= 3),
 h as (select r, i, count(*) over (partition by r, words[i], words[i + 1], words[i + 2]) as n from g),
 c as (select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from h where n > 1) group by r),
 k as (select *, list_filter(lines, lambda x: not ({failed})) as kept_lines from w),
 f as (select k.*, len(words)::bigint as n_words, coalesce(c.n, 0)::bigint as n_repeat_words, {count(word, "array_to_string(kept_lines, chr(10))")}::bigint as words_kept from k left join c on k.r = c.r),
 b as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from f)
 select doc_id, n_words, length(regexp_replace(text, {spaces}, '', 'g'))::bigint as word_chars, (length(text) - length(regexp_replace(text, {q(SYMBOLS)}, '', 'g')))::bigint as n_symbols,
 (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, n_repeat_words, base_failed, not base_failed and words_kept >= 0.5::double * n_words as kept, len(lines)::bigint as n_lines, len(kept_lines)::bigint as n_lines_kept, words_kept from b"""


def oracle_sql() -> dict[str, str]:
    return {"op6_line_rules": _rules_sql()}
