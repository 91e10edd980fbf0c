"""Rule-based scoring of instruction pairs.

A rule set is a list of declarative rules, turned into Column expressions: the score as an integer of hundredths, and ordered arrays of
what was met and missed.  Scores are divided by 100 once, so no sums of binary fractions are compared with thresholds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.codeast import any_compiles, py_compiles, py_parses


@dataclass(frozen=True)
class Rule:
    """Points if `met`; else the code `fail`, which is hard where `hard` holds.  Only looked at where `applies`."""

    met: Column
    points: int = 0
    ok: str | None = None
    fail: str | None = None
    hard: Column | bool = False
    applies: Column | None = None
    fail_if: Column | None = None


def score(rules: Sequence[Rule]) -> tuple[Column, Column, Column, Column]:
    """(hundredths, reasons, fails, hard fails) of a rule set, in the order of its rules."""
    total: Column = F.lit(0)
    reasons, fails, hards = [], [], []
    for r in rules:
        on = F.lit(True) if r.applies is None else F.coalesce(r.applies, F.lit(False))
        met = F.coalesce(r.met, F.lit(False))
        missed = F.coalesce(r.fail_if, F.lit(False)) if r.fail_if is not None else ~met
        if r.points:
            total = total + F.when(on & met, r.points).otherwise(0)
        if r.ok:
            reasons.append(F.when(on & met, F.lit(r.ok)))
        if r.fail:
            fails.append(F.when(on & missed, F.lit(r.fail)))
            if r.hard is not False:
                hard = F.lit(True) if r.hard is True else r.hard
                hards.append(F.when(on & missed & hard, F.lit(r.fail)))
    codes = lambda x: F.array_compact(F.array(*x)) if x else F.array().cast("array<string>")
    return F.least(total, F.lit(100)), codes(reasons), codes(fails), codes(hards)


#: Words of instructions of each category, signs of templates, categories allowed by default (fixed values).
HINTS = {
    "explain": ("explain", "what does", "walk through"),
    "docstring": ("docstring", "documentation"),
    "bugfix": ("bug", "fix", "correct"),
    "improve": ("improve", "refactor", "suggest"),
    "unit_test": ("unit test", "pytest", "tests"),
    "complete": ("complete", "implement", "fill in"),
}
LOW_QUALITY = ("assert True", "TODO:", "todo:", "placeholder", "lorem ipsum", "description.", "fix this")
ALLOWED = ("docstring", "bugfix", "improve", "unit_test", "complete")


def prepared(pairs: DataFrame, **more: Column) -> DataFrame:
    """The pairs with stripped texts (__c, __i, __r) and what else rules refer to again and again, so that each is made once a row."""
    part = {f"__{c[0]}": t.strip(F.coalesce(c, F.lit(""))) for c in ("category", "instruction", "response")}
    return pairs.withColumns(part | more)


_PREPARED = ("__c", "__i", "__r", "__in", "__rn", "__low", "__code", "__joined", "__words", "__compiles")


def pair_rules(allowed: Sequence[str] = ALLOWED, compiles: Column | None = None) -> list[Rule]:
    """The rules of a pair's quality, over prepared columns; `compiles` None leaves out the rule that needs Python's compiler."""
    category, ins, resp, ins_norm, resp_norm = map(F.col, ("__c", "__i", "__r", "__in", "__rn"))
    hinted, aligned = F.lit(False), F.lit(False)
    for c, words in HINTS.items():
        hinted = hinted | (category == c)
        aligned = aligned | ((category == c) & t.contains_any(ins_norm, words))
    good_format = (
        F.when(category == "unit_test", F.contains(resp, F.lit("def test_")) | F.contains(resp_norm, F.lit("pytest")))
        .when(category == "docstring", F.contains(resp, F.lit('"""')) | F.contains(resp_norm, F.lit("purpose:")))
        .when(category == "bugfix", F.contains(resp_norm, F.lit("corrected")) | F.contains(resp, F.lit("```")))
        .when(category == "complete", F.contains(resp, F.lit("```")))
        .when(category == "improve", F.rlike(resp, F.lit(r"(?md)^\s*1[\.\)]\s+")) | F.contains(resp_norm, F.lit("suggest")))
        .when(category == "explain", t.count_words(resp_norm) >= 20)
        .otherwise(False)
    )
    length = lambda c, least, name: [
        Rule((F.length(c) >= least) & (F.length(c) <= 12000), 12, f"{name}_len_ok", f"{name}_too_short", True, fail_if=F.length(c) < least),
        Rule(F.length(c) <= 12000, fail=f"{name}_too_long"),
    ]
    rules = [
        Rule(category.isin(*allowed), 12, "category_allowed", "category_not_allowed", True),
        *length(ins, 30, "instruction"),
        *length(resp, 20, "response"),
        Rule(aligned, 12, "category_instruction_aligned", "instruction_not_aligned_to_category", applies=hinted),
        Rule(~t.contains_any(resp, LOW_QUALITY), 12, "no_template_patterns", "template_or_placeholder_response", True),
        Rule(F.contains(ins, F.lit("```")), 8, "prompt_has_code_context", "prompt_missing_code_context"),
        Rule(good_format, 18, "category_response_format_ok", "category_response_format_bad"),
    ]
    if compiles is not None:
        rules.append(Rule(compiles, 14, "response_python_compiles", "response_python_not_compilable", category.isin("unit_test", "complete"), applies=category.isin("unit_test", "complete", "bugfix")))
    return rules


def pair_compiles() -> Column:
    return any_compiles(t.blocks("response", "labelled", "def"))


def annotate(pairs: DataFrame, allowed: Sequence[str] = ALLOWED, with_compiler: bool = True) -> DataFrame:
    """The pairs with score_hundredths, quality_score, quality_reasons, quality_fails and quality_hard_fails."""
    df = prepared(pairs, __in=t.norm("instruction"), __rn=t.norm("response"))
    compiled = None
    if with_compiler:
        needs = F.col("__c").isin("unit_test", "complete", "bugfix")
        df = df.withColumn("__compiles", any_compiles(F.when(needs, t.blocks("response", "labelled", "def"))))
        compiled = F.col("__compiles")
    points, reasons, fails, hards = score(pair_rules(allowed, compiled))
    out = df.select("*", points.alias("score_hundredths"), reasons.alias("quality_reasons"), fails.alias("quality_fails"), hards.alias("quality_hard_fails"))
    return out.withColumn("quality_score", F.col("score_hundredths") / 100.0).drop(*_PREPARED)


def passes(least_hundredths: int = 68) -> Column:
    return (F.col("score_hundredths") >= least_hundredths) & (F.size("quality_hard_fails") == 0)


# ------------------------------------------------------------------ validators of generated pairs
def _need(category: Column, *names: str) -> Column:
    return category.isin(*names)


def response_rules(compiles: Column) -> tuple[Column, list[Rule]]:
    """(too short, rules) of a generated response by its category, over prepared columns; `compiles`: whether one of its blocks does."""
    category, resp = F.coalesce("category", F.lit("")), F.coalesce("response", F.lit(""))
    low, code, text = F.col("__low"), F.col("__code"), F.col("__joined")
    has_code, coding = F.size(code) > 0, category.isin("complete", "bugfix", "unit_test")
    asserts, tests = F.contains(text, F.lit("assert ")), F.contains(text, F.lit("def test_"))
    return F.length("__r") < 15, [
        Rule(F.lit(True), 20),
        Rule(~t.contains_any(low, ("assert true\n", "todo:", "placeholder", "lorem ipsum", "your_module")), 10, fail="placeholder_content"),
        Rule(has_code, fail="missing_code_block", applies=coding),
        Rule(compiles, 30, fail="code_not_compilable", applies=coding & has_code),
        Rule(t.contains_any(resp, ('"""', "'''")) | (t.count_words(resp) >= 10), 30, fail="bad_docstring_format", applies=category == "docstring"),
        Rule(t.count_words(resp) >= 15, 30, fail="explanation_too_short", applies=category == "explain"),
        Rule(tests & asserts, 20, applies=category == "unit_test"),
        Rule(asserts & ~tests, 10, applies=category == "unit_test"),
        Rule(asserts, fail="no_test_assertions", applies=category == "unit_test"),
        Rule(t.contains_any(low, ("bug", "fix", "issue", "error", "incorrect", "wrong")), 15, fail="no_bug_explanation", applies=category == "bugfix"),
    ]


def validate_response(pairs: DataFrame, compiles: Column | None = None) -> DataFrame:
    """The pairs with valid, response_hundredths and response_errors; a short response has no points and one error."""
    df = prepared(pairs, __low=F.lower(F.coalesce("response", F.lit(""))), __code=t.blocks("response", "spaced", "def")).withColumn("__joined", F.array_join("__code", "\n"))
    if compiles is None:
        df = df.withColumn("__compiles", any_compiles("__code"))
    short, rules = response_rules(F.col("__compiles") if compiles is None else compiles)
    points, _, fails, _ = score(rules)
    errors = F.when(short, F.array(F.lit("too_short"))).otherwise(fails)
    return df.withColumn("response_hundredths", F.when(short, 0).otherwise(points)).withColumn("response_errors", errors).withColumn("valid", F.size("response_errors") == 0).drop(*_PREPARED)


def row_rules(compiles: Column, allowed: Sequence[str], code_missing_is_error: bool = True) -> list[Rule]:
    """The rules of a synthetic row; code_missing_is_error: a unit test without code has an error of its own."""
    category, ins, resp, code, joined = map(F.col, ("__c", "__i", "__r", "__code", "__joined"))
    has_code, coding = F.size(code) > 0, category.isin("complete", "bugfix", "unit_test", "improve")
    asserts = F.regexp_count(joined, F.lit("assert ")) >= 3
    rules = [
        Rule(category.isin(*allowed), 15, fail="invalid_category"),
        Rule(F.length(ins).between(30, 2200), 15, fail="instruction_length"),
        Rule(F.length(resp).between(20, 8000), 10, fail="response_length"),
        Rule(~t.contains_any(resp, ("assert True", "TODO:", "todo:", "placeholder", "lorem ipsum")), 10, fail="placeholder_content"),
        Rule(has_code, fail="missing_python_block", applies=coding),
        Rule(compiles, 25, fail="python_not_compilable", applies=coding & has_code),
    ]
    if code_missing_is_error:
        rules.append(Rule(has_code, fail="unit_test_no_code", applies=category == "unit_test"))
    return [
        *rules,
        Rule(asserts, 15, fail="unit_test_low_assert_count", applies=(category == "unit_test") & (has_code if code_missing_is_error else F.lit(True))),
        Rule(t.count_words(resp) >= 12, 15, fail="docstring_format", applies=category == "docstring"),
        Rule(F.rlike(resp, F.lit(r"(?md)^\s*[-*]\s+")) | F.rlike(resp, F.lit(r"(?md)^\s*[0-9]+\.\s+")), 10, fail="improve_missing_bullets", applies=category == "improve"),
    ]


ROW_CATEGORIES = ("docstring", "bugfix", "improve", "unit_test", "complete", "explain")


def validate_row(pairs: DataFrame, allowed: Sequence[str] = ROW_CATEGORIES, compiles: Column | None = None, code_missing_is_error: bool = True) -> DataFrame:
    """The pairs with valid, row_hundredths and row_errors."""
    df = prepared(pairs, __code=t.blocks("response", "plain", "more")).withColumn("__joined", F.array_join("__code", "\n"))
    if compiles is None:
        df = df.withColumn("__compiles", any_compiles("__code"))
    points, _, fails, _ = score(row_rules(F.col("__compiles") if compiles is None else compiles, allowed, code_missing_is_error))
    return df.withColumn("row_hundredths", points).withColumn("row_errors", fails).withColumn("valid", F.size("row_errors") == 0).drop(*_PREPARED)


# ------------------------------------------------------------------ style, hallucination and task checks
def _checks(*parts: Column) -> Column:
    out = F.lit(0)
    for p in parts:
        out = out + F.coalesce(p, F.lit(False)).cast("int")
    return out


def style_score(response: str = "response", category: str = "category", first_compiles: Column | None = None) -> Column:
    """Part of its category's style checks that a response passes; first_compiles: whether its first block does."""
    r, c = F.coalesce(F.col(response), F.lit("")), F.coalesce(F.col(category), F.lit(""))
    low = F.lower(r)
    code = t.blocks(response, "python_only", None, stripped=False)
    has, ok = F.size(code) > 0, F.lit(False) if first_compiles is None else first_compiles
    quotes, fence = t.contains_any(r, ('"""', "'''")), F.contains(r, F.lit("```"))
    return (
        F.when(c == "docstring", _checks(quotes, t.contains_any(r, ("Args:", "Parameters:")), t.contains_any(r, ("Returns:", "Return:")), F.length(t.strip(r)) > 20) / 4)
        .when(c == "explain", _checks(t.count_words(r) > 20, t.contains_any(low, ("function", "method", "returns", "takes", "parameter")), F.contains(r, F.lit("\n"))) / 3)
        .when(c == "unit_test", _checks(F.contains(r, F.lit("def test")), F.contains(r, F.lit("assert")), has & ok) / 3)
        .when(c == "improve", _checks(t.count_words(r) > 30, t.contains_any(low, ("improve", "suggest", "change", "better", "optimization")), fence) / 3)
        .when(c == "bugfix", _checks(t.contains_any(low, ("bug", "fix", "issue")), fence, has & ok) / 3)
        .otherwise(_checks(has, has & ok) / 2)
    )


#: Signs of made-up references, and first names of modules that don't exist (fixed patterns).
MADE_UP = (r"<\s*insert.*?>", r"\bTODO\b", r"\bTBD\b", r"\byour_[a-zA-Z_]+\b", r"\bsome_module\b", r"\byour_module\b", r"\bmock_api\b")
MADE_UP_MODULES = ("foo", "bar", "baz", "example", "sample", "dummy")


def hallucinations(response: str = "response") -> Column:
    """Number of signs of made-up references: each pattern once, each suspicious import."""
    r = F.coalesce(F.col(response), F.lit(""))
    out = F.lit(0)
    for p in MADE_UP:
        out = out + F.rlike(r, F.lit("(?i)" + p)).cast("int")
    modules = F.regexp_extract_all(r, F.lit(r"(?m)^\s*(?:from|import)\s+([a-zA-Z_][\w\.]*)"), F.lit(1))
    return out + F.size(F.filter(modules, lambda m: t.starts_with_any(F.lower(m), MADE_UP_MODULES)))


def docstring_checks(response: str = "response") -> Column:
    """Of three: quotes, more than 30 characters, arguments or results; a docstring passes with all."""
    r = F.coalesce(F.col(response), F.lit(""))
    return _checks(t.contains_any(r, ('"""', "'''")), F.length(t.strip(r)) > 30, t.contains_any(r, ("Args:", "Parameters:", "Returns:")))


def docstring_share(response: str = "response") -> Column:
    """Part of five checks of a docstring's form, to two places."""
    r = F.coalesce(F.col(response), F.lit(""))
    quotes = t.contains_any(r, ('"""', "'''"))
    parts = _checks(quotes, quotes & (F.length(r) > 40), F.rlike(r, F.lit("Args:|Parameters:|:param ")), F.rlike(r, F.lit("Returns:|:returns:|Return:")), F.rlike(r, F.lit("Example[s]?:|>>>")))
    return parts * 20 / 100.0


def explain_checks(response: str = "response") -> Column:
    """Of two: 20 words, some structure; an explanation passes with one."""
    r = F.coalesce(F.col(response), F.lit(""))
    return _checks(t.count_words(r) >= 20, t.contains_any(r, ("**", "- ")) | F.contains(t.strip(r), F.lit("\n")))


def code_checks(category: Column, response: str, first_compiles: Column, runs: Column) -> tuple[Column, Column]:
    """(checks passed, checks) of completions, fixes and unit tests; `runs`: whether the code ran, given by whoever runs it."""
    r = F.coalesce(F.col(response), F.lit(""))
    code = t.blocks(response, "python_spaced", "substring")
    has, ok = F.size(code) > 0, F.coalesce(first_compiles, F.lit(False))
    ran = ok & F.coalesce(runs, F.lit(False))
    bug = t.contains_any(F.lower(r), ("bug", "fix", "error", "issue", "problem"))
    tests = F.contains(r, F.lit("def test_"))
    usable = has & tests
    passed = (
        F.when(category == "complete", _checks(has, has & ok, has & ran))
        .when(category == "bugfix", _checks(bug, has, has & ok, has & ran))
        .otherwise(_checks(tests, F.contains(r, F.lit("assert ")), usable & ok, usable & ran))
    )
    return passed, F.when(category == "complete", F.when(has, 3).otherwise(1)).otherwise(4)


def answer_score(response: str = "response", category: str = "category", first_compiles: Column | None = None, runs: Column | None = None) -> Column:
    """A struct (passed, style, exec_ok) by the scorer of the category; other categories are scored as explanations.

    exec_ok is null where nothing is run: docstrings and explanations.
    """
    c = F.coalesce(F.col(category), F.lit(""))
    code = c.isin("complete", "bugfix", "unit_test")
    compiled = F.lit(False) if first_compiles is None else first_compiles
    ran = F.lit(None).cast("boolean") if runs is None else runs
    met, of = code_checks(c, response, compiled, ran)
    usable = (F.size(t.blocks(response, "python_spaced", "substring")) > 0) & ((c != "unit_test") | F.contains(F.coalesce(F.col(response), F.lit("")), F.lit("def test_")))
    ok = usable & F.coalesce(compiled, F.lit(False)) & F.coalesce(ran, F.lit(False))
    doc, ex = docstring_checks(response), explain_checks(response)
    return F.when(code, F.struct(ok.alias("passed"), (met / of).alias("style"), ok.alias("exec_ok"))).when(
        c == "docstring", F.struct((doc == 3).alias("passed"), (doc / 3).alias("style"), F.lit(None).cast("boolean").alias("exec_ok"))
    ).otherwise(F.struct((ex >= 1).alias("passed"), (ex / 2).alias("style"), F.lit(None).cast("boolean").alias("exec_ok")))


def simple_pass(response: str = "response", category: str = "category", parses: Column | None = None) -> Column:
    """Pass or fail by category; short ones fail, other categories pass."""
    r, c = t.strip(F.coalesce(F.col(response), F.lit(""))), F.coalesce(F.col(category), F.lit(""))
    return (
        F.when(F.length(r) < 10, False)
        .when(c == "docstring", t.contains_any(r, ('"""', "'''")))
        .when(c == "complete", (F.lit(False) if parses is None else parses) | t.contains_any(r, ("def ", "return")))
        .when(c == "bugfix", t.contains_any(F.lower(r), ("fix", "bug", "error", "change", "replace", "correct")))
        .when(c == "explain", t.count_words(r) >= 20)
        .when(c == "unit_test", F.contains(r, F.lit("def test_")) & F.contains(r, F.lit("assert")))
        .otherwise(True)
    )


def first_block_compiles(response: str, variant: str, fallback: str | None = None, stripped: bool = True) -> Column:
    return py_compiles(F.get(t.blocks(response, variant, fallback, stripped), F.lit(0)))


def whole_parses(response: str) -> Column:
    return py_parses(t.strip(F.col(response)))
