"""Queries of the training-data problems, over whole tables with production parameters, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import doc_pairs, encoding, leakage, mixing, pair_defects, residue, split_overlap, splitting, syntax, token_budget
from .util import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(p1_pieces(spark, d))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(table(spark, d, "source_files"), table(spark, d, "cut_limits"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid(table(spark, d, "source_files"), table(spark, d, "sft_pairs"))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    files, pairs = table(spark, d, "source_files"), table(spark, d, "sft_pairs")
    return syntax.rates(syntax.invalid(files, None), files).unionByName(syntax.block_rates(syntax.invalid_blocks(pairs), pairs))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "sft_pairs").where("split = 'train'"), table(spark, d, "eval_items"))


def p3_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(p3_found(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "sft_pairs")
    return pair_defects.detect(pairs, pair_defects.fit(pairs))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "sft_pairs")
    return pair_defects.rates(p4_found(spark, d), pairs)


def p5_budget(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.budget(p5_tokens(spark, d))


def p5_tokens(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.document_tokens(token_budget.texts_of(table(spark, d, "documents"), table(spark, d, "source_files"), table(spark, d, "repos")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlaps(table(spark, d, "source_files"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.report(p6_found(spark, d), table(spark, d, "source_files"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_pairs(spark, d).select("tbl", "row_id", "line_no", "func_name")


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    return doc_pairs.documented(table(spark, d, "source_files"), table(spark, d, "retrieval_pairs"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_residue(spark, d).select("doc_id")


def p10_residue(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return residue.detect(documents, residue.fit(documents))


def p10_kept(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return residue.exclude(documents.select("doc_id", "lang", "source"), residue.detect(documents, residue.fit(documents)))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(encoding.count_tokens(table(spark, d, "documents"), ["doc_id", "source"]), table(spark, d, "mix_targets"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_rates, p3_found, p3_items, p4_found, p4_rates, p5_budget, p5_tokens, p6_found, p6_report, p7_found, p7_pairs, p8_ids, p9_mixture, p9_shares, p10_found, p10_residue, p10_kept)}

SQL = {
    "p1_found": """
        with f as (
            select file_id, text, coalesce(lower(trim(language, e' \\t\\n\\r')), 'other') as l
            from source_files where text is not null
        ), m as (
            select f.file_id, f.text, coalesce(c.max_chars, o.max_chars) as m
            from f left join cut_limits c on c.language = f.l left join cut_limits o on o.language = 'other'
        )
        select file_id, cast(list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) > m as integer) as forced
        from m where length(text) > m
    """,
    # words of either side in a row of twelve, compared as strings
    "p3_found": """
        with f as (
            select pair_id, 'i' as f, instruction as t from sft_pairs where split = 'train' union all
            select pair_id, 'r', response from sft_pairs where split = 'train'
        ), e as (
            select item_id, 'i' as f, instruction as t from eval_items union all select item_id, 'r', response from eval_items
        ), fw as (select pair_id, f, regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+') as w from f where t is not null),
        ew as (select item_id, f, regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+') as w from e where t is not null),
        fp as (select distinct pair_id, array_to_string(w[k : k + 11], ' ') as p from (select pair_id, w, unnest(range(1, len(w) - 10)) as k from fw where len(w) >= 12)),
        ep as (select distinct item_id, array_to_string(w[k : k + 11], ' ') as p from (select item_id, w, unnest(range(1, len(w) - 10)) as k from ew where len(w) >= 12))
        select distinct item_id, pair_id from fp join ep using (p)
    """,
}
