"""Building instruction pairs, chats, prompts and retrieval pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .ranking import shuffle_key


def chat_text(instruction: Column | str, response: Column | str) -> Column:
    """Chat markup; without a response it ends where the answer begins."""
    head = F.concat(F.lit("<|im_start|>user\n"), t.col(instruction), F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    return F.when(t.col(response).isNull(), head).otherwise(F.concat(head, t.col(response), F.lit("<|im_end|>")))


def messages(instruction: Column | str, response: Column | str) -> Column:
    part = lambda role, c: F.struct(F.lit(role).alias("role"), t.col(c).alias("content"))
    return F.array(part("user", instruction), part("assistant", response))


def filled(*columns: Column, default: str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(default))


def edit_sample(changes: DataFrame) -> DataFrame:
    """(messages) of code changes with file or file_path, old_str or old_code, new_str or new_code, message or instruction; without
    an old or new text they are left out."""
    have = set(changes.columns)
    pick = lambda a, b, d: filled(*[F.col(c) for c in (a, b) if c in have], default=d)
    c = changes.select("*", pick("file", "file_path", "unknown").alias("__f"), pick("old_str", "old_code", "").alias("__o"), pick("new_str", "new_code", "").alias("__n"), pick("message", "instruction", "").alias("__m")).where("__o <> '' and __n <> ''")
    part = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("content"))
    user = F.concat(F.lit("File: "), F.col("__f"), F.lit("\nRequest: "), F.col("__m"), F.lit("\n\n"), F.col("__o"))
    answer = F.concat(F.lit("edit_file(\nold_str:\n"), F.col("__o"), F.lit("\nnew_str:\n"), F.col("__n"), F.lit("\n)"))
    return c.withColumn("messages", F.array(part("system", F.lit("You edit code in small steps.")), part("user", user), part("assistant", answer))).drop("__f", "__o", "__n", "__m")


def edits_text(edits: Column | str) -> Column:
    """Edits (file, old_str, new_str) as calls of an edit tool, after a short preface."""
    one = lambda e: F.concat(F.lit("<tool_code>edit_file(file="), e["file"], F.lit(", old_str="), e["old_str"], F.lit(", new_str="), e["new_str"], F.lit(")</tool_code>"))
    return F.concat(F.lit("<think>The change is small and local.</think>\n"), F.array_join(F.transform(t.col(edits), one), "\n"))


#: Tasks of the five categories; {code} stands for the function.
PROMPTS = {
    "docstring": "Write a docstring for this function:\n\n```python\n{code}\n```",
    "complete": "Complete this function:\n\n```python\n{code}\n```",
    "bugfix": "Find and fix the bug in this function:\n\n```python\n{code}\n```",
    "explain": "Explain what this function does:\n\n```python\n{code}\n```",
    "unit_test": "Write pytest unit tests for this function:\n\n```python\n{code}\n```",
}


def prompt(category: Column | str, code: Column | str) -> Column:
    """The task of a category about some code; null for other categories."""
    out = F.lit(None).cast("string")
    for c, p in PROMPTS.items():
        a, b = p.split("{code}")
        out = F.when(t.col(category) == c, F.concat(F.lit(a), t.col(code), F.lit(b))).otherwise(out)
    return out


#: Kinds of bugs: label, text to find, its replacement, whether it must occur exactly once (fixed values, in order).
MUTATIONS = (
    ("removed '- 1'", " - 1", "", False), ("removed '+ 1'", " + 1", "", False), ("'==' became '!='", " == ", " != ", False), ("'is not' became 'is'", " is not ", " is ", False),
    ("'not in' became 'in'", " not in ", " in ", False), ("commented return", "return ", "# return ", True), ("True became False", "True", "False", True), ("False became True", "False", "True", True),
    ("'<=' became '<'", " <= ", " < ", False), ("'>=' became '>'", " >= ", " > ", False), ("removed 'not'", "if not ", "if ", False), ("'and' became 'or'", " and ", " or ", True),
)


def mutate(df: DataFrame, code: str, key: str, seed: int = 42) -> DataFrame:
    """The rows with bug and buggy: the first kind that applies, in an order shuffled by row, at its first place; null if none does."""
    c = F.col(code)
    options = []
    for i, (label, find, put, once) in enumerate(MUTATIONS):
        n = F.regexp_count(c, F.lit("\\Q" + find + "\\E"))
        at = F.instr(c, find)
        changed = F.concat(F.substring(c, F.lit(1), at - 1), F.lit(put), F.substring(c, at + len(find), F.length(c)))
        applies = (n == 1) if once else (n >= 1)
        options.append(F.when(applies, F.struct(F.md5(F.concat(F.lit(f"{seed}:{i}:"), F.col(key).cast("string"))).alias("h"), F.lit(label).alias("bug"), changed.alias("buggy"))))
    best = F.array_min(F.array_compact(F.array(*options)))
    return df.withColumn("__m", best).withColumn("bug", F.col("__m.bug")).withColumn("buggy", F.col("__m.buggy")).drop("__m")


def explode_queries(rows: DataFrame, most: int | None = None) -> DataFrame:
    """A row (query, code, function_name, and the parent's columns) for each query of a row that isn't blank, of the first `most`."""
    q = F.slice("queries", 1, most) if most else F.col("queries")
    meta = [c for c in rows.columns if c not in ("queries", "anchor", "symbol")]
    return rows.select(*meta, F.col("anchor").alias("code"), filled(F.col("symbol"), F.col("filename"), default="").alias("function_name"), F.posexplode(q).alias("query_no", "__q")).withColumn("query", t.strip("__q")).where("query <> ''").drop("__q")


def first_queries(rows: DataFrame) -> DataFrame:
    return rows.withColumn("query", F.try_element_at("queries", F.lit(1))).where("query is not null").drop("queries")


def explain_pairs(rows: DataFrame, most: int = 2, code_limit: int = 1400, text_limit: int = 900) -> DataFrame:
    """Instruction pairs that ask to explain code, from the first queries of retrieval rows; without code or text they are left out."""
    place = filled(F.col("path"), F.col("filename"), default="unknown")
    symbol = filled(F.col("symbol"), default="unknown_symbol")
    code, answer = t.clip("anchor", code_limit), t.clip("positive", text_limit)
    own = rows.select("rp_id", F.posexplode(F.slice("queries", 1, most)).alias("query_no", "__q"), place.alias("place"), symbol.alias("source_function"), code.alias("__code"), answer.alias("response"))
    own = own.where((t.strip("__q") != "") & (F.col("__code") != "") & (F.col("response") != ""))
    text = F.concat(F.lit("Explain the code of `"), F.col("source_function"), F.lit("` in "), F.col("place"), F.lit(".\nQuestion: "), t.strip("__q"), F.lit("\n\n"), F.col("__code"))
    return own.select("rp_id", "query_no", text.alias("instruction"), "response", F.lit("explain").alias("category"), "source_function", F.col("place").alias("source_file"))


def model_text(c: Column | str, model: str, query: bool) -> Column:
    """A text with the prefix its embedding model wants."""
    s, name = t.strip(c), model.lower()
    if "e5" in name:
        return F.concat(F.lit("query: " if query else "passage: "), s)
    if "bge" in name and query:
        return F.concat(F.lit("Represent this sentence for searching relevant passages: "), s)
    return s


def topic_of(attempt: Column, topics: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, topics)), (F.pmod(attempt, F.lit(len(topics))) + 1).cast("int"))


def difficulty_of(attempt: Column, levels: tuple[str, str] = ("easy", "medium")) -> Column:
    return F.element_at(F.array(*map(F.lit, levels)), (F.pmod(F.floor(attempt / 3), F.lit(2)) + 1).cast("int"))


def synthetic_prompt(category: Column, difficulty: Column, topic: Column) -> Column:
    return F.format_string("Write one %s training pair of %s difficulty about %s. Answer with a JSON object of instruction and response.", category, difficulty, topic)


def template_query(name: Column, key: Column | str, seed: int = 42) -> Column:
    """One of some fixed wordings about a function, chosen by row."""
    phrase = t.action_phrase(name)
    styles = ("how to %s", "function to %s", "code that can %s", "where do we %s", "implementation of %s", "which function will %s")
    pick = (F.conv(F.substring(shuffle_key(key, seed), 1, 4), 16, 10).cast("int") % len(styles)) + 1
    return F.element_at(F.array(*[F.format_string(s, phrase) for s in styles]), pick)
