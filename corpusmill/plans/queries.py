"""Queries of the curation, training-pair, evaluation, retrieval and token operators, with SQL that gives the same rows.

Every query runs over its whole tables.  Where Python's parser is needed there is no SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codeast
from ..functions import text as t
from ..operators import corpus, dedup, evaluation, pairs, quality, retrieval, rules, splits, tokens
from ..sources.tables import read_table, spread
from . import sqltext as s

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, d, name)


# ------------------------------------------------------------------ corpora
SPEC = corpus.Spec("rust", ("tests", "bench", "/span", "retry"), ("src/", "lib/", "crates/", "core/"), 25, 400)


def _files(spark, d):
    return spread(table(spark, d, "source_files").select("file_id", "file_name", "text")).withColumn("rel_path", F.replace("file_name", F.lit("__"), F.lit("/")))


_FILES = "with f as (select *, replace(file_name, '__', '/') as rel_path from source_files)"
_WANTED = f"(not {s.any_of('rel_path', SPEC.exclude)} and {s.starts('rel_path', SPEC.prefixes)})"


@query(f"{_FILES} select file_id, rel_path from f where {_WANTED}")
def corpus_path_filter(spark, d):
    return _files(spark, d).where(corpus.wanted_path("rel_path", SPEC.exclude, SPEC.prefixes)).select("file_id", "rel_path")


_HEAD = f"lower(array_to_string({s.lines('text')}[:30], chr(10)))"
_GENERATED = s.any_of(_HEAD, corpus.GENERATED)


@query(f"select file_id, {_GENERATED} as generated from source_files where text is not null")
def corpus_generated_marker(spark, d):
    return table(spark, d, "source_files").where("text is not null").select("file_id", corpus.seems_generated("text").alias("generated"))


@query(
    f"select file_id, {s.count_lines('text')} as n_lines, len(string_split(text, chr(10))) as n_parts, strlen(text) as n_bytes, {s.count_words('text')} as n_words "
    "from source_files where text is not null"
)
def corpus_line_stats(spark, d):
    return _files(spark, d).where("text is not null").select(
        "file_id", t.count_lines("text").cast("bigint").alias("n_lines"), t.count_newline_parts("text").cast("bigint").alias("n_parts"), F.octet_length("text").cast("bigint").alias("n_bytes"), t.count_words("text").cast("bigint").alias("n_words"),
    )


_FN, _TY = f"len(regexp_extract_all(text, {s.lit(corpus.RUST_FUNCTION)}))", f"len(regexp_extract_all(text, {s.lit(corpus.RUST_TYPE)}))"
_CANDIDATES = f"""{_FILES}, c as (
    select file_id, rel_path, {s.count_lines('text')} as num_lines, {_FN} as num_functions, {_TY} as num_types, strlen(text) as size_bytes
    from f where {_WANTED} and text is not null and {s.strip('text')} <> '' and not {_GENERATED}
), k as (
    select *, 3 * num_functions + 4 * num_types + least(num_lines // 40, 40) + least(size_bytes // 1200, 40) as quality_score
    from c where num_lines between {SPEC.least_lines} and {SPEC.most_lines} and num_functions + num_types >= 2
)"""


@query(f"{_CANDIDATES} select * from k")
def corpus_candidates(spark, d):
    c = corpus.candidates(_files(spark, d), SPEC, key="file_id")
    return c.select("file_id", "rel_path", *[F.col(x).cast("bigint").alias(x) for x in ("num_lines", "num_functions", "num_types", "size_bytes", "quality_score")])


@query(f"{_CANDIDATES} select file_id, rel_path, quality_score from k order by quality_score desc, rel_path, file_id limit 300")
def corpus_top_files(spark, d):
    return corpus.top_files(corpus_candidates(spark, d), 300, ["file_id"]).select("file_id", "rel_path", "quality_score")


@query(f"{_CANDIDATES} select count(*) as total_files, coalesce(sum(num_lines), 0)::bigint as total_lines, coalesce(sum(num_functions), 0)::bigint as total_functions, coalesce(sum(num_types), 0)::bigint as total_types from k")
def corpus_totals(spark, d):
    return corpus.totals(corpus_candidates(spark, d))


@query()
def corpus_python_candidates(spark, d):
    """Counts of functions and classes come from Python's parser."""
    spec = corpus.Spec("python", ("tests", "bench"), ("src/", "lib/", "pkg/", "core/"), 20, 3500)
    files = _files(spark, d).where(F.col("file_name").endswith(".py"))
    return corpus.candidates(files, spec, key="file_id")


@query("select file_id, replace(replace(file_name, '__', '/'), '/', '__') as flat, md5(concat('// FILE: ', file_name, chr(10), text)) as digest from source_files where file_name is not null and text is not null")
def corpus_header_text(spark, d):
    f = _files(spark, d).where("file_name is not null and text is not null")
    return f.select("file_id", t.flatten_path("rel_path").alias("flat"), F.md5(t.with_header("file_name", "text", "//")).alias("digest"))


_NAMES = "v as (select distinct file_name from source_files where split = 'validation' and file_name is not null), x as (select distinct file_name from source_files where split = 'test' and file_name is not null)"
_ASSIGNED = "case when v.file_name is not null then 'validation' when x.file_name is not null then 'test' else 'train' end"


@query(f"with {_NAMES} select file_id, {_ASSIGNED} as assigned from source_files f left join v on f.file_name = v.file_name left join x on f.file_name = x.file_name")
def corpus_split_by_name(spark, d):
    f = table(spark, d, "source_files").select("file_id", "file_name", "split")
    named = lambda part: f.where((F.col("split") == part) & F.col("file_name").isNotNull()).select("file_name")
    return corpus.split_by_name(f, named("validation"), named("test")).select("file_id", "assigned")


@query("select split, file_name from source_files where file_name is not null")
def corpus_manifest(spark, d):
    return corpus.manifest(table(spark, d, "source_files"))


# ------------------------------------------------------------------ dedup, caps
def _pairs(spark, d):
    return table(spark, d, "sft_pairs")


def _texts(spark, d):
    """For queries that work on the texts: over all cores."""
    return spread(table(spark, d, "sft_pairs").select("pair_id", "pos", "category", "instruction", "response"))


_KEYED = f"row_number() over (partition by {s.norm('instruction')}, {s.norm('response')}, coalesce(category, '') order by pos)"


@query(f"select pair_id, pos from (select pair_id, pos, {_KEYED} as r from sft_pairs) where r = 1")
def pairs_dedup_normalised(spark, d):
    return dedup.first_of(_texts(spark, d), dedup.normalised_key()).select("pair_id", "pos")


@query("select pair_id, pos from (select pair_id, pos, row_number() over (partition by md5(concat(left(coalesce(instruction, ''), 100), '|', left(coalesce(response, ''), 200))) order by pos) as r from sft_pairs) where r = 1")
def pairs_dedup_prefix(spark, d):
    return dedup.first_of(_texts(spark, d), dedup.prefix_key()).select("pair_id", "pos")


@query("select md5(anchor) as digest, min(rp_id) as first_pos from retrieval_pairs where anchor is not null group by anchor")
def retrieval_unique_code(spark, d):
    return dedup.unique_texts(table(spark, d, "retrieval_pairs"), "anchor", "rp_id").select(F.md5("anchor").alias("digest"), "first_pos")


@query("select pair_id from (select pair_id, row_number() over (partition by coalesce(category, 'unknown') order by length(instruction) desc, pos) as r from sft_pairs) where r <= 25")
def pairs_cap_category(spark, d):
    p = _pairs(spark, d).select("pair_id", "pos", "category", F.length("instruction").alias("n"))
    return dedup.cap_per_group(p, F.coalesce("category", F.lit("unknown")), [F.desc("n"), F.col("pos")], 25).select("pair_id")


_REUSE = f"row_number() over (partition by {s.norm('response')} order by pos)"


@query(f"select pair_id, r <= 3 as kept from (select pair_id, {_REUSE} as r from sft_pairs)")
def pairs_cap_reuse(spark, d):
    kept, dropped = dedup.cap_reuse(_texts(spark, d).select("pair_id", "pos", "response"), "response", 3, [F.col("pos")])
    return kept.select("pair_id", F.lit(True).alias("kept")).unionByName(dropped.select("pair_id", F.lit(False).alias("kept")))


_TARGETS = dedup.allocate(["explain", "bugfix", "docstring", "unit_test", "complete"], 333)


@query("with g as (select * from (values " + ", ".join(f"('{c}', {n})" for c, n in _TARGETS.items()) + ") as g(category, target)) select pair_id from (select pair_id, target, row_number() over (partition by p.category order by pos) as r from sft_pairs p join g on p.category = g.category) where r <= target")
def pairs_quota(spark, d):
    targets = spark.createDataFrame(list(_TARGETS.items()), "category string, target int")
    return dedup.quota(_pairs(spark, d).select("pair_id", "pos", "category"), "category", targets).select("pair_id")


@query("select rp_id from (select rp_id, sum(least(3, coalesce(len(queries), 0))) over (order by rp_id) - least(3, coalesce(len(queries), 0)) as b from retrieval_pairs) where b < 350")
def retrieval_stop_at_target(spark, d):
    r = table(spark, d, "retrieval_pairs").select("rp_id", "queries")
    return dedup.stop_at_total(r, F.least(F.lit(3), F.coalesce(F.array_size("queries"), F.lit(0))), 350, "rp_id").select("rp_id")


# ------------------------------------------------------------------ quality
def _rule_sql(allowed=rules.ALLOWED):
    c, i, r = s.strip("coalesce(category, '')"), s.strip("coalesce(instruction, '')"), s.strip("coalesce(response, '')")
    base = f"(select *, {c} as c, {i} as i, {r} as r, {s.norm('instruction')} as inorm, {s.norm('response')} as rnorm from sft_pairs)"
    hinted = "c in (" + ", ".join(map(s.lit, rules.HINTS)) + ")"
    aligned = "(" + " or ".join(f"(c = {s.lit(k)} and {s.any_of('inorm', v)})" for k, v in rules.HINTS.items()) + ")"
    bad = s.any_of("r", rules.LOW_QUALITY)
    one = s.lit("(?m)^\\s*1[\\.\\)]\\s+")
    form = (
        "(case c when 'unit_test' then contains(r, 'def test_') or contains(rnorm, 'pytest') when 'docstring' then contains(r, '\"\"\"') or contains(rnorm, 'purpose:') "
        "when 'bugfix' then contains(rnorm, 'corrected') or contains(r, '```') when 'complete' then contains(r, '```') "
        f"when 'improve' then regexp_matches(r, {one}) or contains(rnorm, 'suggest') when 'explain' then {s.count_words('rnorm')} >= 20 else false end)"
    )
    ok = "c in (" + ", ".join(map(s.lit, allowed)) + ")"
    fence = "contains(i, '```')"
    points = f"(case when {ok} then 12 else 0 end + case when length(i) between 30 and 12000 then 12 else 0 end + case when length(r) between 20 and 12000 then 12 else 0 end + case when {aligned} then 12 else 0 end + case when {bad} then 0 else 12 end + case when {fence} then 8 else 0 end + case when {form} then 18 else 0 end)"
    fails = s.codes([(f"not {ok}", "category_not_allowed"), ("length(i) < 30", "instruction_too_short"), ("length(i) > 12000", "instruction_too_long"), ("length(r) < 20", "response_too_short"), ("length(r) > 12000", "response_too_long"), (f"{hinted} and not {aligned}", "instruction_not_aligned_to_category"), (bad, "template_or_placeholder_response"), (f"not {fence}", "prompt_missing_code_context"), (f"not {form}", "category_response_format_bad")])
    hard = s.codes([(f"not {ok}", "category_not_allowed"), ("length(i) < 30", "instruction_too_short"), ("length(r) < 20", "response_too_short"), (bad, "template_or_placeholder_response")])
    return base, points, fails, hard


_BASE, _POINTS, _FAILS, _HARD = _rule_sql()


@query(f"select pair_id, {_POINTS} as score, array_to_string({_FAILS}, ',') as fails, array_to_string({_HARD}, ',') as hard from {_BASE}")
def pairs_quality_rules(spark, d):
    """The rules of a pair's quality but for the one that compiles code."""
    a = rules.annotate(_texts(spark, d), with_compiler=False)
    return a.select("pair_id", F.col("score_hundredths").alias("score"), F.array_join("quality_fails", ",").alias("fails"), F.array_join("quality_hard_fails", ",").alias("hard"))


@query()
def pairs_quality_full(spark, d):
    return rules.annotate(_texts(spark, d)).select("pair_id", "quality_score", "quality_reasons", "quality_fails", "quality_hard_fails")


_CURATED = f"""with a as (select *, {_POINTS} as score, {_FAILS} as fails, {_HARD} as hard, {_KEYED} as k from {_BASE}), b as (select * from a where k = 1),
    good as (select * from b where score >= 60 and len(hard) = 0),
    capped as (select *, min(o) over (partition by coalesce(category, 'unknown')) as cf from (select *, row_number() over (order by score desc, pos) as o, row_number() over (partition by coalesce(category, 'unknown') order by score desc, pos) as cr from good) where cr <= 400),
    reused as (select *, row_number() over (partition by rnorm order by cf, o) as rr from capped)"""


def _curated(spark, d):
    return quality.curate(_texts(spark, d), 60, 400, 3, with_compiler=False)


@query(f"{_CURATED} select pair_id, score from reused where rr <= 3")
def pairs_curated(spark, d):
    return _curated(spark, d).kept.select("pair_id", F.col("score_hundredths").alias("score"))


@query(
    f"{_CURATED}, rej as (select pos, case when len(hard) > 0 then hard else fails end as codes from b where not (score >= 60 and len(hard) = 0) union all select pos, case when len(hard) > 0 then hard else list_append(fails, 'response_reuse_cap') end from reused where rr > 3) "
    "select reason, count(*) as n, min(pos) as first_pos from (select pos, unnest(codes) as reason from rej) group by reason order by n desc, first_pos, reason limit 12"
)
def pairs_reject_reasons(spark, d):
    return quality.reject_reasons(_curated(spark, d).rejected)


@query(f"{_CURATED} select coalesce(category, 'unknown') as category, count(*) as n, round(sum(score) / count(*) / 100.0, 4) as avg_score from b group by 1")
def pairs_average_scores(spark, d):
    return quality.average_scores(_curated(spark, d).scored)


@query(f"{_CURATED} select (select count(*) from b) as n_input, count(*) as n_kept, round(count(*) / greatest(1, (select count(*) from b)), 4) as keep_rate from reused where rr <= 3")
def pairs_keep_rate(spark, d):
    r = _curated(spark, d)
    return quality.keep_rate(r.scored, r.kept)


@query("select coalesce(category, 'unknown') as category, count(*) as n from sft_pairs group by 1")
def pairs_category_counts(spark, d):
    return quality.category_counts(_pairs(spark, d))


_ALLOW = ("docstring", "bugfix", "unit_test", "complete")


@query("select pair_id, category from sft_pairs where category in (" + ", ".join(map(s.lit, _ALLOW)) + ")")
def pairs_allow_list(spark, d):
    return _pairs(spark, d).where(F.col("category").isin(*_ALLOW)).select("pair_id", "category")


@query("select split, min(length(response)) as min, quantile_cont(length(response), 0.5) as p50, round(quantile_cont(length(response), 0.9), 6) as p90, max(length(response)) as max, round(avg(length(response)), 6) as mean from sft_pairs where response is not null group by split")
def pairs_lengths(spark, d):
    return quality.lengths(_pairs(spark, d), "response")


# ------------------------------------------------------------------ validators
def _blocks_sql(pattern: str, looks: str, flags: str) -> str:
    found = f"list_filter(list_transform({s.hits('coalesce(response, ' + s.lit('') + ')', pattern, 1, flags)}, lambda b: {s.strip('b')}), lambda b: b <> '')"
    raw = s.strip("coalesce(response, '')")
    return f"(case when len({found}) > 0 then {found} when regexp_matches({raw}, {s.lit(looks)}) then [{raw}] else [] end)"


_B2 = _blocks_sql("```(?:python|py)?[" + "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0))) + "]*\\n(.*?)```", "(?m)^\\s*(def |class |import |assert )", "s")
_B3 = _blocks_sql("```(?:python|py)?\\n(.*?)```", "(?m)^\\s*(def |class |import |from |assert |for |while |if )", "si")


def _v2_sql() -> str:
    coding = "c in ('complete', 'bugfix', 'unit_test')"
    asserts, tests = "contains(code, 'assert ')", "contains(code, 'def test_')"
    words = s.count_words("r")
    low = s.any_of("lower(r)", ("assert true\n", "todo:", "placeholder", "lorem ipsum", "your_module"))
    bug = s.any_of("lower(r)", ("bug", "fix", "issue", "error", "incorrect", "wrong"))
    quotes = s.any_of("r", ('"""', "'''"))
    points = (
        f"20 + case when {low} then 0 else 10 end + case when {coding} and n > 0 then 30 else 0 end + case when c = 'docstring' and ({quotes} or {words} >= 10) then 30 else 0 end + case when c = 'explain' and {words} >= 15 then 30 else 0 end "
        f"+ case when c = 'unit_test' and {asserts} then (case when {tests} then 20 else 10 end) else 0 end + case when c = 'bugfix' and {bug} then 15 else 0 end"
    )
    errors = s.codes([(low, "placeholder_content"), (f"{coding} and n = 0", "missing_code_block"), (f"c = 'docstring' and not ({quotes} or {words} >= 10)", "bad_docstring_format"), (f"c = 'explain' and {words} < 15", "explanation_too_short"), (f"c = 'unit_test' and not {asserts}", "no_test_assertions"), (f"c = 'bugfix' and not {bug}", "no_bug_explanation")])
    short = f"length({s.strip('r')}) < 15"
    return f"with b as (select pair_id, coalesce(category, '') as c, coalesce(response, '') as r, {_B2} as blocks from sft_pairs), x as (select *, len(blocks) as n, array_to_string(blocks, chr(10)) as code from b) select pair_id, case when {short} then 0 else least({points}, 100) end as points, case when {short} then 'too_short' else array_to_string({errors}, ',') end as errors from x"


@query(_v2_sql())
def pairs_validate_response(spark, d):
    """Every block counts as one that compiles; pairs_validate_full asks the compiler."""
    v = rules.validate_response(_texts(spark, d), F.lit(True))
    return v.select("pair_id", F.col("response_hundredths").alias("points"), F.array_join("response_errors", ",").alias("errors"))


def _v3_sql(missing: bool) -> str:
    ok = "c in (" + ", ".join(map(s.lit, rules.ROW_CATEGORIES)) + ")"
    coding, words = "c in ('complete', 'bugfix', 'unit_test', 'improve')", s.count_words("r")
    many = "(length(code) - length(replace(code, 'assert ', ''))) / 7 >= 3"
    bad = s.any_of("r", ("assert True", "TODO:", "todo:", "placeholder", "lorem ipsum"))
    bullets = "(" + f"regexp_matches(r, {s.lit('(?m)^\\s*[-*]\\s+')}) or regexp_matches(r, {s.lit('(?m)^\\s*[0-9]+\\.\\s+')})" + ")"
    test = "c = 'unit_test' and n > 0" if missing else "c = 'unit_test'"
    points = f"case when {ok} then 15 else 0 end + case when length(i) between 30 and 2200 then 15 else 0 end + case when length(r) between 20 and 8000 then 10 else 0 end + case when {bad} then 0 else 10 end + case when {coding} and n > 0 then 25 else 0 end + case when {test} and {many} then 15 else 0 end + case when c = 'docstring' and {words} >= 12 then 15 else 0 end + case when c = 'improve' and {bullets} then 10 else 0 end"
    errors = [(f"not {ok}", "invalid_category"), ("not length(i) between 30 and 2200", "instruction_length"), ("not length(r) between 20 and 8000", "response_length"), (bad, "placeholder_content"), (f"{coding} and n = 0", "missing_python_block")]
    if missing:
        errors.append(("c = 'unit_test' and n = 0", "unit_test_no_code"))
    errors += [(f"{test} and not {many}", "unit_test_low_assert_count"), (f"c = 'docstring' and {words} < 12", "docstring_format"), (f"c = 'improve' and not {bullets}", "improve_missing_bullets")]
    c, i, r = (s.strip(f"coalesce({x}, '')") for x in ("category", "instruction", "response"))
    return f"with b as (select pair_id, {c} as c, {i} as i, {r} as r, {_B3} as blocks from sft_pairs), x as (select *, len(blocks) as n, array_to_string(blocks, chr(10)) as code from b) select pair_id, {points} as points, array_to_string({s.codes(errors)}, ',') as errors from x"


@query(_v3_sql(True))
def pairs_validate_row(spark, d):
    v = rules.validate_row(_texts(spark, d), compiles=F.lit(True))
    return v.select("pair_id", F.col("row_hundredths").alias("points"), F.array_join("row_errors", ",").alias("errors"))


@query(_v3_sql(False))
def pairs_validate_row_lenient(spark, d):
    v = rules.validate_row(_texts(spark, d), compiles=F.lit(True), code_missing_is_error=False)
    return v.select("pair_id", F.col("row_hundredths").alias("points"), F.array_join("row_errors", ",").alias("errors"))


@query()
def pairs_validate_full(spark, d):
    v = rules.validate_response(_texts(spark, d))
    return v.select("pair_id", "valid", "response_hundredths", "response_errors")


@query(f"with e as (select coalesce(category, 'unknown') as category, unnest(string_split(errors, ',')) as error from ({_v3_sql(True)}) join sft_pairs using (pair_id)) select category, error, count(*) as n from e where error <> '' group by 1, 2")
def pairs_error_counts(spark, d):
    return quality.error_counts(rules.validate_row(_texts(spark, d), compiles=F.lit(True)), "row_errors")


_MADE_UP = " + ".join(f"cast(regexp_matches(r, {s.lit('(?i)' + p)}) as int)" for p in rules.MADE_UP)
_MODULES = s.hits("r", r"(?m)^\s*(?:from|import)\s+([a-zA-Z_][\w\.]*)", 1, "")
_FABRICATED = f"len(list_filter({_MODULES}, lambda m: {s.starts('lower(m)', rules.MADE_UP_MODULES)}))"


@query(f"select pair_id, {_MADE_UP} + {_FABRICATED} as n from (select pair_id, coalesce(response, '') as r from sft_pairs)")
def pairs_hallucinations(spark, d):
    return _texts(spark, d).select("pair_id", rules.hallucinations().cast("bigint").alias("n"))


def _sum(*conds: str) -> str:
    return "(" + " + ".join(f"cast(({c}) as int)" for c in conds) + ")"


_QUOTES = s.any_of("r", ('"""', "'''"))
_STYLE = f"""case c when 'docstring' then {_sum(_QUOTES, s.any_of('r', ('Args:', 'Parameters:')), s.any_of('r', ('Returns:', 'Return:')), 'length(' + s.strip('r') + ') > 20')} / 4
    when 'explain' then {_sum(s.count_words('r') + ' > 20', s.any_of('lower(r)', ('function', 'method', 'returns', 'takes', 'parameter')), 'contains(r, chr(10))')} / 3
    when 'unit_test' then {_sum("contains(r, 'def test')", "contains(r, 'assert')", 'n > 0')} / 3
    when 'improve' then {_sum(s.count_words('r') + ' > 30', s.any_of('lower(r)', ('improve', 'suggest', 'change', 'better', 'optimization')), "contains(r, '```')")} / 3
    when 'bugfix' then {_sum(s.any_of('lower(r)', ('bug', 'fix', 'issue')), "contains(r, '```')", 'n > 0')} / 3
    else {_sum('n > 0', 'n > 0')} / 2 end"""
_PYBLOCKS = s.hits("coalesce(response, '')", "```(?:python)?\\n(.*?)```", 1, "s")


@query(f"select pair_id, round({_STYLE}, 6) as style, {_sum(_QUOTES, 'length(' + s.strip('r') + ') > 30', s.any_of('r', ('Args:', 'Parameters:', 'Returns:')))} as doc_checks, {_sum(s.count_words('r') + ' >= 20', s.any_of('r', ('**', '- ')) + ' or contains(' + s.strip('r') + ', chr(10))')} as explain_checks, {_sum(_QUOTES, _QUOTES + ' and length(r) > 40', 'regexp_matches(r, ' + s.lit('Args:|Parameters:|:param ') + ')', 'regexp_matches(r, ' + s.lit('Returns:|:returns:|Return:') + ')', 'regexp_matches(r, ' + s.lit('Example[s]?:|>>>') + ')')} * 20 / 100.0 as doc_share from (select pair_id, coalesce(category, '') as c, coalesce(response, '') as r, len({_PYBLOCKS}) as n from sft_pairs)")
def pairs_style(spark, d):
    """Style checks, with every first block taken as one that compiles."""
    return _texts(spark, d).select("pair_id", F.round(rules.style_score(first_compiles=F.lit(True)), 6).alias("style"), rules.docstring_checks().alias("doc_checks"), rules.explain_checks().alias("explain_checks"), rules.docstring_share().alias("doc_share"))


@query(f"""select pair_id, case when length(r) < 10 then false when c = 'docstring' then {_QUOTES} when c = 'complete' then {s.any_of('r', ('def ', 'return'))}
    when c = 'bugfix' then {s.any_of('lower(r)', ('fix', 'bug', 'error', 'change', 'replace', 'correct'))} when c = 'explain' then {s.count_words('r')} >= 20 when c = 'unit_test' then contains(r, 'def test_') and contains(r, 'assert') else true end as passed
    from (select pair_id, coalesce(category, '') as c, {s.strip("coalesce(response, '')")} as r from sft_pairs)""")
def pairs_simple_pass(spark, d):
    return _texts(spark, d).select("pair_id", rules.simple_pass().alias("passed"))


@query("select pair_id, " + ", ".join(f"len(regexp_extract_all(coalesce(response, ''), {s.lit(p)}, 1, {s.lit(fl)})) as n_{n}" for n, p, fl in (("plain", "```(?:python|py)?\\n(.*?)```", "si"), ("python_only", "```(?:python)?\\n(.*?)```", "s"), ("any_case", "```(?:python)?\\n(.*?)```", "si"))) + " from sft_pairs")
def pairs_code_blocks(spark, d):
    n = lambda v: F.size(t.blocks("response", v, None, stripped=False)).cast("bigint")
    return _texts(spark, d).select("pair_id", n("plain").alias("n_plain"), n("python_only").alias("n_python_only"), n("python_any_case").alias("n_any_case"))


_F1 = """with p as (select pair_id, unnest(list_transform(regexp_extract_all(coalesce(response, ''), '([a-zA-Z_][a-zA-Z0-9_]*)', 1), lambda x: lower(x))) as w from sft_pairs),
    g as (select pair_id, unnest(list_transform(regexp_extract_all(coalesce(instruction, ''), '([a-zA-Z_][a-zA-Z0-9_]*)', 1), lambda x: lower(x))) as w from sft_pairs),
    pc as (select pair_id, w, count(*) as n from p group by 1, 2), gc as (select pair_id, w, count(*) as n from g group by 1, 2),
    sh as (select pair_id, sum(least(pc.n, gc.n)) as x from pc join gc using (pair_id, w) group by 1), np as (select pair_id, sum(n) as n from pc group by 1), ng as (select pair_id, sum(n) as n from gc group by 1)
    select pair_id, round(coalesce(2.0 * (x / np.n) * (x / ng.n) / ((x / np.n) + (x / ng.n)), 0.0), 6) as f1 from sft_pairs left join sh using (pair_id) left join np using (pair_id) left join ng using (pair_id)"""


@query(_F1)
def pairs_token_f1(spark, d):
    return _texts(spark, d).select("pair_id", F.round(t.token_f1("response", "instruction"), 6).alias("f1"))


# ------------------------------------------------------------------ splits
def _split_sql(case: str, table_: str = "sft_pairs", key: str = "pair_id", by: str = "") -> str:
    part = f"partition by {by}" if by else ""
    return f"with r as (select *, row_number() over ({part} order by {s.shuffled(key)}, {key}) as r, count(*) over ({part}) as n from {table_}) select {key}, {case} as part from r"


@query(_split_sql("case when r <= floor(n * (1 - 0.15)) then 'train' else 'test' end"))
def split_ratio(spark, d):
    return splits.ratio_split(_pairs(spark, d).select("pair_id"), "pair_id", 0.15).select("pair_id", "part")


@query(_split_sql("case when r <= greatest(1, floor(n * 0.1)) then 'validation' else 'train' end", "source_files", "file_id"))
def split_validation_first(spark, d):
    return splits.validation_first_split(table(spark, d, "source_files").select("file_id"), "file_id", 0.1).select("file_id", "part")


@query(_split_sql("case when r <= (case when n >= 3 then greatest(1, floor(n * 0.15)) when n = 2 then 1 else 0 end) then 'test' else 'train' end", by="category"))
def split_stratified(spark, d):
    return splits.stratified_split(_pairs(spark, d).select("pair_id", "category"), "pair_id", "category", 0.15).select("pair_id", "part")


@query(f"select doc_id from documents order by {s.shuffled('doc_id')}, doc_id limit 60")
def sample_uniform(spark, d):
    return splits.sample_rows(table(spark, d, "documents").select("doc_id"), "doc_id", 60)


@query(f"select doc_id from (select doc_id from documents order by {s.shuffled('doc_id', 7)}, doc_id limit 500) order by doc_id")
def sample_ordered(spark, d):
    return splits.ordered_subsample(table(spark, d, "documents").select("doc_id"), "doc_id", 500, "doc_id", 7)


_MINI = ["docstring", "bugfix", "explain", "unit_test", "complete"]


@query(f"with r as (select pair_id, category, row_number() over (partition by category order by {s.shuffled('pair_id')}, pair_id) as g, row_number() over (order by {s.shuffled('pair_id')}, pair_id) as r from sft_pairs) select pair_id, category from r order by case when category in ({', '.join(map(s.lit, _MINI))}) and g <= 4 then 0 else 1 end, r limit 20")
def sample_mini_test(spark, d):
    return splits.mini_test(_pairs(spark, d).select("pair_id", "category"), "pair_id", "category", _MINI, 20).select("pair_id", "category")


@query("select pair_id from sft_pairs order by pos desc limit 24")
def sample_last_rows(spark, d):
    return splits.last_rows(_pairs(spark, d).select("pair_id", "pos"), "pos", 24).select("pair_id")


# ------------------------------------------------------------------ evaluation
_K = 3
_SAMPLES = f"""with v as (select pair_id, coalesce(category, 'unknown') as category, unnest([0, 1, 2]) as k, response, instruction from sft_pairs),
    x as (select pair_id as item_id, k as sample_idx, category, case k when 0 then coalesce(response, '') when 1 then left(coalesce(response, ''), 80) else coalesce(instruction, '') end as response from v),
    w as (select *, length(response) % 3 = 0 as passed, (length(response) % 5) / 4.0 as style, case when category in ('complete', 'bugfix', 'unit_test') then length(response) % 2 = 0 end as exec_ok from x)"""
_ITEMS = f"{_SAMPLES}, i as (select item_id, max(case when sample_idx = 0 then category end) as category, max(case when sample_idx = 0 then passed::int end) as pass_1, max(passed::int) as pass_k, max(style) as style, max(case when sample_idx = 0 then exec_ok::int end) as exec_ok, max(case when sample_idx = 0 then regexp_matches(response, 'TODO|placeholder|NotImplemented')::int end) as unfinished from w group by item_id)"


def _samples(spark, d):
    """Three samples an item of existing texts, judged by their lengths: the operators take verdicts as columns."""
    p = _pairs(spark, d).select(F.col("pair_id").alias("item_id"), F.coalesce("category", F.lit("unknown")).alias("category"), F.explode(F.array(*map(F.lit, range(_K)))).alias("sample_idx"), F.coalesce("response", F.lit("")).alias("r"), F.coalesce("instruction", F.lit("")).alias("i"))
    p = p.select("item_id", "category", "sample_idx", F.when(F.col("sample_idx") == 0, F.col("r")).when(F.col("sample_idx") == 1, F.left("r", F.lit(80))).otherwise(F.col("i")).alias("response"))
    n = F.length("response")
    return p.select("*", (n % 3 == 0).alias("passed"), ((n % 5) / 4.0).alias("style"), F.when(F.col("category").isin("complete", "bugfix", "unit_test"), n % 2 == 0).alias("exec_ok"))


@query(f"{_ITEMS} select case when grouping(category) = 1 then 'all' else category end as category, count(*) as n, round(sum(pass_1) / count(*), 6) as pass_at_1, round(sum(pass_k) / count(*), 6) as pass_at_k, round(avg(style), 6) as avg_style, round(avg(exec_ok), 6) as exec_rate, round(sum(unfinished) / count(*), 6) as hallucination_rate from i group by rollup (category)")
def eval_pass_at_k(spark, d):
    return evaluation.summary(evaluation.per_item(_samples(spark, d)))


@query(f"select count(*) as n, sum(e)::bigint as events, round(sum(e) / count(*), 6) as rate from (select {_MADE_UP} + {_FABRICATED} as e from (select coalesce(response, '') as r from sft_pairs))")
def eval_event_rate(spark, d):
    return evaluation.event_rate(_texts(spark, d).select(rules.hallucinations().cast("bigint").alias("e")), F.col("e"))


@query(f"with f as ({_F1}), x as (select pair_id, coalesce(category, 'unknown') as category, length(coalesce(response, '')) % 3 = 0 as passed, f1 from sft_pairs join f using (pair_id)) select count(*) filter (category in ('complete', 'unit_test')) as n_coding, round(count(*) filter (category in ('complete', 'unit_test') and passed) / nullif(count(*) filter (category in ('complete', 'unit_test')), 0), 6) as pass_rate, round(avg(f1), 4) as token_f1 from x")
def eval_coding_rate(spark, d):
    p = _texts(spark, d).select(F.coalesce("category", F.lit("unknown")).alias("category"), "response", "instruction", (F.length(F.coalesce("response", F.lit(""))) % 3 == 0).alias("passed"))
    r = evaluation.coding_rate(p, "passed", "response", "instruction")
    return r.withColumn("token_f1", F.round("token_f1", 4))


@query("with a as (select coalesce(category, 'unknown') as category, round(count(*) filter (length(response) > 300) / count(*), 6) as v from sft_pairs where split = 'validation' group by 1), b as (select coalesce(category, 'unknown') as category, round(count(*) filter (length(response) > 300) / count(*), 6) as v from sft_pairs where split = 'test' group by 1), j as (select category, coalesce(a.v, 0.0) as before, coalesce(b.v, 0.0) as after from a full join b using (category)) select category, before, after, round(after - before, 6) as delta, case when round(after - before, 6) > 0.001 then '↑' when round(after - before, 6) < -0.001 then '↓' else '→' end as direction from j")
def eval_compare(spark, d):
    rate = lambda part: _pairs(spark, d).where(F.col("split") == part).groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.round(F.count_if(F.length("response") > 300) / F.count("*"), 6).alias("v"))
    return evaluation.compare(rate("validation"), rate("test"), "category", "v")


@query("select count(*) filter (passed) as n_passed, count(*) filter (passed) >= 2 as overall from (select split, avg(length(response)) > 370 as passed from sft_pairs group by split)")
def eval_track_gate(spark, d):
    return quality.gate(_pairs(spark, d).groupBy("split").agg((F.avg(F.length("response")) > 370).alias("passed")))


@query()
def eval_code_checks(spark, d):
    """Scores of code answers; whether code runs is a column given by whoever runs it, here none does."""
    p = _texts(spark, d).where(F.col("category").isin("complete", "bugfix", "unit_test"))
    p = p.withColumn("ok", rules.first_block_compiles("response", "python_spaced", "substring"))
    passed, of = rules.code_checks(F.col("category"), "response", F.col("ok"), F.lit(None).cast("boolean"))
    return p.select("pair_id", "category", passed.alias("passed"), of.alias("checks"))


_DOC3 = _sum(_QUOTES, "length(" + s.strip("r") + ") > 30", s.any_of("r", ("Args:", "Parameters:", "Returns:")))
_EX2 = _sum(s.count_words("r") + " >= 20", s.any_of("r", ("**", "- ")) + " or contains(" + s.strip("r") + ", chr(10))")


@query(f"select pair_id, case when c = 'docstring' then {_DOC3} = 3 else {_EX2} >= 1 end as passed, round(case when c = 'docstring' then {_DOC3} / 3 else {_EX2} / 2 end, 6) as style from (select pair_id, coalesce(category, '') as c, coalesce(response, '') as r from sft_pairs) where c not in ('complete', 'bugfix', 'unit_test')")
def eval_text_scores(spark, d):
    """Scores of docstrings and, by the scorer any other category falls back to, of explanations."""
    p = _texts(spark, d).where(~F.coalesce("category", F.lit("")).isin("complete", "bugfix", "unit_test")).select("pair_id", rules.answer_score().alias("v"))
    return p.select("pair_id", "v.passed", F.round("v.style", 6).alias("style"))


@query("with a as (select split, count(*) as n from sft_pairs group by split) select x.split, case when x.n = 0 then 'inf'::double else round((y.n - x.n) / x.n * 100, 6) end as change from a x cross join (select n from a where split = 'test') y")
def eval_percent_change(spark, d):
    a = _pairs(spark, d).groupBy("split").agg(F.count("*").alias("n"))
    # a row a split
    return a.withColumn("m", F.max(F.when(F.col("split") == "test", F.col("n"))).over(Window.partitionBy())).select("split", F.round(t.percent_change(F.col("n"), F.col("m")), 6).alias("change"))


@query("select count(distinct symbol) as n from retrieval_pairs where unit_type = 'function' and num_lines between 5 and 60 and not starts_with(symbol, '__') and symbol not in ('main', 'setup', 'teardown') and len(queries) > 0")
def retrieval_unique_functions(spark, d):
    r = table(spark, d, "retrieval_pairs").where(codeast.public_function() & (F.array_size("queries") > 0))
    return r.agg(F.countDistinct("symbol").alias("n"))


# ------------------------------------------------------------------ retrieval
def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"), "label")
    c = e.select(F.col("vec_id").alias("did"), F.col("embedding").alias("dv"), F.col("label").alias("dlabel"))
    return q, c


_SIMS = "with q as (select vec_id as qid, embedding::double[] as qv, label from embeddings where vec_id % 20 = 0), c as (select vec_id as did, embedding::double[] as dv, label as dlabel from embeddings), s as (select qid, did, list_cosine_similarity(qv, dv) as s, label = dlabel and qid <> did as rel from q cross join c), r as (select *, row_number() over (partition by qid order by round(s, 12) desc, did) as rk from s)"


@query(f"{_SIMS} select qid, did, rk, round(s, 6) as s from r where rk <= 10")
def retrieval_top_k(spark, d):
    q, c = _vectors(spark, d)
    return retrieval.top_k(q, c, 10).select("qid", "did", F.col("rk").cast("bigint").alias("rk"), F.round("s", 6).alias("s"))


def _disc(k: int) -> str:
    import math

    return "[" + ", ".join(repr(round(1.0 / math.log2(i + 1), 12)) for i in range(1, k + 1)) + "]"


_METRICS = (
    "m as (select q.qid, coalesce(1.0 / min(r.rk) filter (r.rel), 0.0) as rr, sum(case when r.rel then " + _disc(10) + "[r.rk] else 0.0 end) as dcg, count(*) filter (r.rel) as hits from q left join r on r.qid = q.qid and r.rk <= 10 group by q.qid), "
    "n as (select qid, count(*) filter (rel) as n_rel from s group by qid), "
    "x as (select m.*, n_rel, list_sum(" + _disc(10) + "[:least(n_rel, 10)]) as ideal from m join n using (qid))"
)


@query(f"{_SIMS}, {_METRICS} select qid, round(rr, 6) as rr, round(case when n_rel > 0 then dcg / ideal else 0.0 end, 6) as ndcg, round(case when n_rel > 0 then hits / n_rel else 0.0 end, 6) as recall from x")
def retrieval_metrics(spark, d):
    """Several relevant documents a query: those of its label."""
    q, c = _vectors(spark, d)
    rel = q.select("qid", "label").join(c.select("did", "dlabel"), F.col("label") == F.col("dlabel")).where("qid <> did").select("qid", "did")
    m = retrieval.per_query(q, retrieval.top_k(q, c, 10), rel, 10)
    return m.select("qid", *[F.round(x, 6).alias(x) for x in ("rr", "ndcg", "recall")])


_ONE = "t as (select qid, min(did) filter (did > qid) as did from s where rel group by qid having min(did) filter (did > qid) is not null)"


def _target(q, c):
    near = q.select("qid", "label").join(c.select("did", "dlabel"), F.col("label") == F.col("dlabel")).where("did > qid")
    return near.groupBy("qid").agg(F.min("did").alias("did"))


@query(f"{_SIMS}, {_ONE}, x as (select r.rk from t join r using (qid, did)) select count(*) as n, round(avg((rk = 1)::int), 6) as acc_at_1, round(avg(case when rk <= 10 then 1.0 / rk else 0.0 end), 6) as mrr, round(avg(case when rk <= 10 then {_disc(10)}[rk] else 0.0 end), 6) as ndcg, round(avg((rk <= 10)::int), 6) as recall from x")
def retrieval_mean_metrics(spark, d):
    """One relevant document a query: the next one of its label."""
    q, c = _vectors(spark, d)
    target = _target(q, c)
    own = q.join(target.select("qid"), "qid", "left_semi")
    return retrieval.mean_metrics(retrieval.per_query(own, retrieval.top_k(own, c, 10), target, 10))


@query(f"{_SIMS}, {_ONE}, g as (select qid, max(s) as top_s from s group by qid), x as (select t.qid, t.did, r.rk, r.s, g.top_s from t join r using (qid, did) join g using (qid)) select qid, did, rk as correct_rank, round(s, 6) as correct_similarity, round(top_s, 6) as top_1_similarity from x where rk > 10 order by qid limit 20")
def retrieval_errors(spark, d):
    q, c = _vectors(spark, d)
    return retrieval.errors(retrieval.target_ranks(q, c, _target(q, c)), 10)


_SHORT = "s2 as (select qid, did, list_cosine_similarity(qv[:32], dv[:32]) as s from q cross join c), r2 as (select *, row_number() over (partition by qid order by round(s, 12) desc, did) as rk from s2)"


@query(f"{_SIMS}, {_ONE}, {_SHORT} select t.qid, r2.rk as before_rank, r.rk as after_rank, r.rk < r2.rk as improved from t join r2 using (qid, did) join r using (qid, did) where r2.rk > 5")
def retrieval_rank_shift(spark, d):
    """Ranks by the first half of each vector against ranks by the whole."""
    q, c = _vectors(spark, d)
    target = _target(q, c)
    half = lambda df, v: df.withColumn(v, F.slice(v, 1, 32))
    before = retrieval.target_ranks(half(q, "qv"), half(c, "dv"), target)
    return retrieval.rank_shift(before, retrieval.target_ranks(q, c, target))


# ------------------------------------------------------------------ pair building
def _rp(spark, d):
    return table(spark, d, "retrieval_pairs")


_Q = s.strip("q")


@query(f"select rp_id, k - 1 as query_no, {_Q} as query, coalesce(nullif(symbol, ''), nullif(filename, ''), '') as function_name, md5(anchor) as code from (select *, unnest(queries) as q, generate_subscripts(queries, 1) as k from retrieval_pairs) where {_Q} <> ''")
def retrieval_explode_queries(spark, d):
    return pairs.explode_queries(_rp(spark, d).select("rp_id", "queries", "anchor", "symbol", "filename")).select("rp_id", F.col("query_no").cast("bigint").alias("query_no"), "query", "function_name", F.md5("code").alias("code"))


@query("select rp_id, queries[1] as query from retrieval_pairs where queries[1] is not null")
def retrieval_first_queries(spark, d):
    return pairs.first_queries(_rp(spark, d).select("rp_id", "queries"))


def _clip_sql(x: str, n: int) -> str:
    a = s.strip(x)
    return f"case when length({a}) > {n} then concat(rtrim(left({a}, {n}), {s.lit(s.SPACES)}), chr(10), '...') else {a} end"


@query(f"with x as (select rp_id, k - 1 as query_no, {_Q} as q, coalesce(nullif(symbol, ''), 'unknown_symbol') as f, coalesce(nullif(path, ''), nullif(filename, ''), 'unknown') as p, {_clip_sql('anchor', 1400)} as code, {_clip_sql('positive', 900)} as response from (select *, unnest(queries[:2]) as q, generate_subscripts(queries[:2], 1) as k from retrieval_pairs)) select rp_id, query_no, md5(concat('Explain the code of `', f, '` in ', p, '.', chr(10), 'Question: ', q, chr(10), chr(10), code)) as instruction, response, f as source_function, p as source_file from x where q <> '' and code <> '' and response <> ''")
def pairs_explain(spark, d):
    return pairs.explain_pairs(_rp(spark, d)).select("rp_id", F.col("query_no").cast("bigint").alias("query_no"), F.md5("instruction").alias("instruction"), "response", "source_function", "source_file")


@query("select pair_id, md5(concat('<|im_start|>user', chr(10), instruction, '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10), case when response is null then '' else concat(response, '<|im_end|>') end)) as digest from sft_pairs where instruction is not null")
def pairs_chat_text(spark, d):
    return _pairs(spark, d).where("instruction is not null").select("pair_id", F.md5(pairs.chat_text("instruction", "response")).alias("digest"))


@query("select pair_id, 2::bigint as n, instruction as first, response as second, coalesce(category, 'unknown') as category from sft_pairs")
def pairs_messages(spark, d):
    m = _pairs(spark, d).select("pair_id", pairs.messages("instruction", "response").alias("m"), F.coalesce("category", F.lit("unknown")).alias("category"))
    return m.select("pair_id", F.size("m").cast("bigint").alias("n"), F.col("m")[0]["content"].alias("first"), F.col("m")[1]["content"].alias("second"), "category")


def _mutation_sql() -> str:
    options = []
    for i, (label, find, put, once) in enumerate(pairs.MUTATIONS):
        n = f"(length(anchor) - length(replace(anchor, {s.lit(find)}, ''))) / {len(find)}"
        at = f"strpos(anchor, {s.lit(find)})"
        options.append(f"case when {n} {'= 1' if once else '>= 1'} then {{'h': md5(concat('42:{i}:', cast(rp_id as varchar))), 'bug': {s.lit(label)}, 'buggy': concat(substring(anchor, 1, {at} - 1), {s.lit(put)}, substring(anchor, {at} + {len(find)}))}} end")
    return f"select rp_id, m.bug as bug, md5(m.buggy) as buggy from (select rp_id, list_min(list_filter([{', '.join(options)}], lambda x: x is not null)) as m from retrieval_pairs where anchor is not null)"


@query(_mutation_sql())
def pairs_bug_mutations(spark, d):
    m = pairs.mutate(_rp(spark, d).where("anchor is not null").select("rp_id", "anchor"), "anchor", "rp_id")
    return m.select("rp_id", "bug", F.md5("buggy").alias("buggy"))


def _prompt_sql() -> str:
    arms = []
    for c, p in pairs.PROMPTS.items():
        a, b = p.split("{code}")
        arms.append(f"when {s.lit(c)} then concat({s.lit(a)}, instruction, {s.lit(b)})")
    return f"select pair_id, md5(case category {' '.join(arms)} end) as prompt from sft_pairs where instruction is not null"


@query(_prompt_sql())
def pairs_prompts(spark, d):
    return _pairs(spark, d).where("instruction is not null").select("pair_id", F.md5(pairs.prompt("category", "instruction")).alias("prompt"))


def _phrase_sql(n: str) -> str:
    arms = " ".join(f"when starts_with({n}, {s.lit(p)}) and length({n}) > {len(p)} then substring({n}, {len(p) + 1})" for p in t.NAME_PREFIXES)
    return f"replace(case {arms} else {n} end, '_', ' ')"


@query(f"select rp_id, {_phrase_sql('symbol')} as phrase, replace(replace(replace(path, '/', ' '), '.py', ''), '_', ' ') as stem, concat('passage: ', {s.strip('anchor')}) as passage from retrieval_pairs where symbol is not null and path is not null and anchor is not null")
def retrieval_phrases(spark, d):
    r = _rp(spark, d).where("symbol is not null and path is not null and anchor is not null")
    return r.select("rp_id", t.action_phrase("symbol").alias("phrase"), t.stem_phrase("path").alias("stem"), pairs.model_text("anchor", "any-e5-base", False).alias("passage"))


@query("with a as (select event_id, event_id % 7 as i from events) select event_id, (['sorting', 'parsing', 'caching', 'retries', 'dates', 'paths', 'logging'])[i + 1] as topic, (['easy', 'medium'])[(event_id // 3) % 2 + 1] as difficulty from a")
def pairs_topics(spark, d):
    e = table(spark, d, "events").select("event_id")
    return e.select("event_id", pairs.topic_of(F.col("event_id"), ["sorting", "parsing", "caching", "retries", "dates", "paths", "logging"]).alias("topic"), pairs.difficulty_of(F.col("event_id")).alias("difficulty"))


@query()
def pairs_template_queries(spark, d):
    return _rp(spark, d).where("symbol is not null").select("rp_id", pairs.template_query(F.col("symbol"), "rp_id").alias("query"))


# ------------------------------------------------------------------ JSON of model answers
@query("select event_id, props as block, props as value_of, json_extract_string(concat('{\"choices\": [{\"message\": {\"content\": ', to_json(event_type), '}}]}'), '$.choices[0].message.content') as content, event_type as loose from events where props is not null")
def json_repair(spark, d):
    """Objects wrapped in a fence and words, as models write them."""
    e = table(spark, d, "events").where("props is not null")
    fenced = F.concat(F.lit("```json\nHere it is: "), F.col("props"), F.lit(" as asked\n```"))
    broken = F.concat(F.lit('{"instruction": "'), F.col("event_type"), F.lit('", "response": '))
    chat = F.concat(F.lit('{"choices": [{"message": {"content": "'), F.col("event_type"), F.lit('"}}]}'))
    return e.select("event_id", t.json_block(fenced).alias("block"), t.content_text(F.col("props")).alias("value_of"), t.completion_text(chat).alias("content"), t.loose_field(broken, "instruction").alias("loose"))


# ------------------------------------------------------------------ tokens
_TOK = "d as (select doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') as tokens from documents where text is not null)"


def _tokens(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.filter(F.split("text", " ", -1), lambda x: x != "").alias("tokens"))


def _loss(c):
    return (F.length(c) % 7 + 1) / 4.0


_LOSS = "(length(tok) % 7 + 1) / 4.0"


@query(f"with {_TOK} select doc_id, k as chunk_no, md5(array_to_string(tokens[k * 64 + 1 : k * 64 + 64], ' ')) as chunk from (select doc_id, tokens, unnest(range(0, len(tokens) // 64)) as k from d)")
def tokens_file_chunks(spark, d):
    return tokens.file_chunks(_tokens(spark, d), 64).select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.md5(F.array_join("chunk", " ")).alias("chunk"))


def _stream(block: int) -> str:
    return f"with {_TOK}, f as (select doc_id, unnest(tokens) as tok, generate_subscripts(tokens, 1) as i from d), g as (select tok, row_number() over (order by doc_id, i) - 1 as p from f) select p // {block} as chunk_no, md5(string_agg(tok, ' ' order by p)) as chunk from g group by 1 having count(*) = {block}"


@query(_stream(128))
def tokens_stream_chunks(spark, d):
    return tokens.stream_chunks(_tokens(spark, d), 128).select("chunk_no", F.md5(F.array_join("chunk", " ")).alias("chunk"))


_BLOCKS = (96, 128, 192)


@query(" union all ".join(f"select {b} as block, chunk_no, chunk from ({_stream(b)})" for b in _BLOCKS))
def tokens_curriculum(spark, d):
    """The stream cut anew for each stage of a curriculum."""
    out = None
    for b in _BLOCKS:
        c = tokens.stream_chunks(_tokens(spark, d), b).select(F.lit(b).alias("block"), "chunk_no", F.md5(F.array_join("chunk", " ")).alias("chunk"))
        out = c if out is None else out.unionByName(c)
    return out


_WIN = f"{_TOK}, l as (select doc_id, len(tokens) as n, tokens from d where len(tokens) > 0), w as (select *, unnest(range(0, case when n <= 128 then 1 else ceil((n - 128) / 64.0)::int + 1 end)) as k from l), v as (select doc_id, k as window_no, k * 64 as b, least(k * 64 + 128, n) as e, least(k * 64 + 128, n) - case when k > 0 then (k - 1) * 64 + 128 else 0 end as target, tokens from w)"


@query(f"with {_WIN} select doc_id, window_no, b as begin_at, e as end_at, target from v")
def tokens_windows(spark, d):
    w = tokens.windows(_tokens(spark, d).select("doc_id", F.size("tokens").alias("n")), "n", 128, 64)
    return w.select("doc_id", *[F.col(a).cast("bigint").alias(b) for a, b in (("window_no", "window_no"), ("begin", "begin_at"), ("end", "end_at"), ("target", "target"))])


def _window_losses(spark, d):
    docs = _tokens(spark, d)
    w = tokens.windows(docs.select("doc_id", F.size("tokens").alias("n")), "n", 128, 64)
    each = w.join(docs, "doc_id")
    seen = F.slice("tokens", (F.col("end") - F.col("target") + 1), F.col("target"))
    total = F.aggregate(seen, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x) % 7 + 1)
    return each.select("doc_id", "window_no", F.col("target").cast("bigint").alias("target"), total.alias("quarters"), (total / F.col("target") / 4.0).alias("loss"))


_WLOSS = f"with {_WIN}, y as (select doc_id, window_no, target, list_sum(list_transform(tokens[e - target + 1 : e], lambda tok: length(tok) % 7 + 1)) as quarters from v)"


@query(f"{_WLOSS} select sum(target)::bigint as tokens, round(exp(sum(quarters) / 4.0 / sum(target)), 4) as weighted, round(exp(avg(quarters / target / 4.0)), 4) as plain from y")
def tokens_perplexity(spark, d):
    """Mean loss by tokens and plain mean over windows; losses are exact quarters."""
    w = _window_losses(spark, d)
    return w.agg(F.sum("target").alias("tokens"), F.round(F.exp(F.sum("quarters") / 4.0 / F.sum("target")), 4).alias("weighted"), F.round(F.exp(F.avg("loss")), 4).alias("plain"))


@query(f"{_WLOSS} select coalesce(d2.lang, 'unknown') as lang, sum(target)::bigint as tokens, round(exp(sum(quarters) / 4.0 / sum(target)), 4) as perplexity from y join documents d2 using (doc_id) group by 1")
def tokens_perplexity_by_language(spark, d):
    w = _window_losses(spark, d).join(table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("lang")), "doc_id")
    p = tokens.weighted_perplexity(w, "loss", "target", ["lang"])
    return p.select("lang", "tokens", F.round("perplexity", 4).alias("perplexity"))


@query("select md5(string_agg(text, concat(chr(10), chr(10)) order by doc_id)) as digest from (select doc_id, text from documents where text is not null order by doc_id limit 20)")
def tokens_joined_text(spark, d):
    return tokens.joined_text(table(spark, d, "documents").select("doc_id", "text"), 20, "doc_id").select(F.md5("text").alias("digest"))


# ------------------------------------------------------------------ code through Python's parser
def _python_files(spark, d):
    return spread(table(spark, d, "source_files").where(F.col("file_name").endswith(".py") & F.col("text").isNotNull()).select("file_id", "file_name", "text"))


@query()
def code_functions(spark, d):
    return codeast.extract_functions(_python_files(spark, d), "file_id", "text")


@query()
def code_tasks(spark, d):
    """Functions without their docstring and cut down to what is to be completed."""
    f = codeast.extract_functions(_python_files(spark, d), "file_id", "text")
    return f.select("file_id", "name", codeast.strip_docstring("code").alias("bare"), codeast.partial_function("code").alias("partial"), codeast.long_or_ragged_lines("code").alias("style_faults"))


@query()
def code_queries(spark, d):
    f = codeast.extract_functions(_python_files(spark, d), "file_id", "text").where(~F.startswith("name", F.lit("__")))
    each = f.select("file_id", "name", codeast.search_queries("name", "docstring", "args", "return_type", F.lit(None).cast("string")).alias("q"))
    return each.select("file_id", "name", F.explode(F.slice("q", 1, 3)).alias("query"))


@query()
def code_patches(spark, d):
    """Edits of a unified diff of all lines of each file, of which the first is changed."""
    f = table(spark, d, "source_files").where("text is not null and file_name is not null").select("file_id", "file_name", F.split(F.regexp_replace("text", r"\n\z", ""), "\n", -1).alias("lines"))
    n, rest = F.size("lines").cast("string"), F.transform(F.slice("lines", F.lit(2), F.size("lines")), lambda x: F.concat(F.lit("\n "), x))
    patch = F.concat(F.lit("diff --git a/x b/x\n--- a/"), F.col("file_name"), F.lit("\n+++ b/"), F.col("file_name"), F.lit("\n@@ -1,"), n, F.lit(" +1,"), n, F.lit(" @@\n-"), F.get("lines", F.lit(0)), F.lit("\n+changed"), F.array_join(rest, ""))
    edits = f.select("file_id", codeast.patch_edits(patch).alias("edits"))
    return edits.select("file_id", F.size("edits").alias("n"), pairs.edits_text("edits").alias("call"))
