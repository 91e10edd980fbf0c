"""Operators of the core against sequential specifications and small hand-made rows."""

import json
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import codeast
from corpusmill.functions import text as t
from corpusmill.operators import corpus, dedup, evaluation, pairs, quality, ranking, retrieval, rules, splits, tokens
from corpusmill.sources import files, sinks
from corpusmill.streaming import incremental

ODD = ["", "a", "a\n", "a\n\n", "a\r\nb", "a\x1cb", "a\u2028b\u2029", " \t\na  b\x1f", "\u3000x\u00a0", "İ x", "\r\n", "\x0b\x0c", "one two\tthree\n"]


def odd_strings(n=300):
    r = random.Random(1)
    return ODD + ["".join(r.choice("ab \t\n\r\x0b\x1c\x85\u00a0\u2028xyZ") for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_text_functions_equal_python(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(odd_strings())], "i int, x string")
    rows = df.select("x", t.strip("x").alias("s"), t.rstrip("x").alias("r"), t.norm("x").alias("n"), t.count_lines("x").alias("l"), F.size(t.split_lines("x")).alias("l2"), t.count_words("x").alias("w"), t.count_newline_parts("x").alias("p"), t.is_blank("x").alias("b"), t.first_lines("x", 2).alias("f")).collect()
    for r in rows:
        x = r.x
        assert r.s == x.strip() and r.r == x.rstrip() and r.w == len(x.split()) and r.p == len(x.split("\n")) and r.b == (not x.strip())
        assert r.n == " ".join(x.lower().split())
        assert r.l == r.l2 == len(x.splitlines())
        want = x.splitlines()[:2]
        assert [*r.f.splitlines(), ""][: len(want)] == want


def test_clip_phrase_and_prefix(spark):
    df = spark.createDataFrame([("ab cd  ef", "get_user_id", "a/b_c.py"), ("  abc ", "_", "x.py")], "x string, n string, p string")
    a, b = df.select(t.clip("x", 7).alias("c"), t.action_phrase("n").alias("n"), t.stem_phrase("p").alias("p"), pairs.model_text("x", "e5-large", True).alias("m")).collect()
    assert a.c == "ab cd\n..." and b.c == "abc" and a.n == "user id" and b.n == " " and a.p == "a b c" and b.m == "query: abc"


def test_blocks_variants(spark):
    texts = ["```python\nx = 1\n```", "```PY\ny\n```", "```\nz\n```", "def f():\n  pass", "```python  \nq\n```", "```python\nopen", None, "plain"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    got = [r[0] for r in df.select(t.blocks("x", "spaced", "def")).collect()]
    assert got == [["x = 1"], [], ["z"], ["def f():\n  pass"], ["q"], [], [], []]
    assert [r[0] for r in df.select(t.blocks("x", "labelled", None)).collect()][:2] == [["x = 1"], ["y"]]


def test_json_repair(spark):
    df = spark.createDataFrame([('```json\nsure {"a": "b"} ok\n```',), ("none",), ('{"a": ',), (None,)], "x string")
    assert [r[0] for r in df.select(t.json_block("x")).collect()] == ['{"a": "b"}', None, None, None]
    loose = spark.createDataFrame([(r'{"instruction": "say \"hi\"\n", "response": "yes',)], "x string")
    r = loose.select(t.loose_field("x", "instruction").alias("a"), t.field_between("x", "instruction", "response").alias("b")).first()
    assert r.a == 'say "hi"n' and r.b == r'say \"hi\"\n'
    c = spark.createDataFrame([('["a", {"text": "b"}]',), ("plain",)], "x string")
    assert [r[0] for r in c.select(t.content_text("x")).collect()] == ["ab", "plain"]


def test_path_filter_and_generated(spark):
    rows = [("crates/a/latest.rs", "x"), ("crates/a/lib.rs", "\n" * 29 + "Do Not Edit"), ("crates/a/m.rs", "\n" * 30 + "do not edit"), ("docs/x.rs", "x"), (None, None)]
    df = spark.createDataFrame(rows, "p string, x string")
    got = df.select(corpus.wanted_path("p", corpus.RUST.exclude, corpus.RUST.prefixes).alias("w"), corpus.seems_generated("x").alias("g")).collect()
    assert [r.w for r in got] == [False, True, True, False, None]
    assert [r.g for r in got] == [False, True, False, False, None]


def test_candidates_top_and_totals(spark):
    body = "pub fn a() {}\nstruct B;\n" + "x\n" * 30
    rows = [("crates/b.rs", body), ("crates/a.rs", body), ("crates/c.rs", "fn a() {}\n" * 3), ("crates/n.rs", None), ("x/a.rs", body)]
    c = corpus.candidates(spark.createDataFrame(rows, "rel_path string, text string"), corpus.RUST)
    got = corpus.top_files(c, 1).collect()
    assert [r.rel_path for r in got] == ["crates/a.rs"] and got[0].quality_score == 3 + 4
    assert corpus.totals(c).first().total_files == 2
    assert corpus.totals(c.limit(0)).first().total_lines == 0
    py = corpus.Spec("python", (), (), 1, 100)
    p = corpus.candidates(spark.createDataFrame([("a.py", "class A:\n  def f(self): pass\n"), ("b.py", "def (")], "rel_path string, text string"), py).collect()
    assert [(r.rel_path, r.num_functions, r.num_types) for r in p] == [("a.py", 1, 1)]


def test_split_by_name_precedence(spark):
    f = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "file_name string")
    v, s = (spark.createDataFrame(x, "file_name string") for x in ([("a",), ("a",)], [("a",), ("b",)]))
    assert {r.file_name: r.assigned for r in corpus.split_by_name(f, v, s).collect()} == {"a": "validation", "b": "test", "c": "train", None: "train"}


PAIRS = "pair_id bigint, pos bigint, instruction string, response string, category string"


def pair_rows(n=400, seed=3):
    r = random.Random(seed)
    cats = ["explain", "unit_test", "docstring", "bugfix", "odd", None]
    answers = ['"""Purpose: x."""  and more text here', "```python\nassert True\n```", "```python\nx = 1\n```\nCorrected.", "short", None, "word " * 25, "TODO: later, much later than that"]
    asks = ["Explain this code, please do it.\n```\nx\n```", "Fix the bug in what follows below here", "tests", "Write a docstring for this function now"]
    return [(i, i * 3, r.choice(asks) + " " * r.randint(0, 2), r.choice(answers), r.choice(cats)) for i in range(n)]


def test_quality_pipeline_equals_sequential(spark):
    rows = pair_rows()
    df = spark.createDataFrame(rows, PAIRS).repartition(5)
    norm = lambda x: " ".join((x or "").lower().split())
    seen, first = set(), []
    for row in sorted(rows, key=lambda r: r[1]):
        k = (norm(row[2]), norm(row[3]), row[4] or "")
        if k not in seen:
            seen.add(k)
            first.append(row[0])
    assert sorted(r.pair_id for r in dedup.first_of(df, dedup.normalised_key()).collect()) == sorted(first)
    scored = {r.pair_id: r for r in rules.annotate(df).collect()}
    ok = [i for i in first if scored[i].score_hundredths >= 40 and not scored[i].quality_hard_fails]
    ok.sort(key=lambda i: (-scored[i].score_hundredths, scored[i].pos))
    for cap in (0, 3):
        buckets = defaultdict(list)
        for i in ok:
            buckets[scored[i].category or "unknown"].append(i)
        order = ok if cap <= 0 else [i for b in buckets.values() for i in b[:cap]]
        counts, kept, dropped = Counter(), [], []
        for i in order:
            k = norm(scored[i].response)
            (kept if counts[k] < 2 else dropped).append(i)
            counts[k] += counts[k] < 2
        res = quality.curate(df, 40, cap, 2)
        assert sorted(r.pair_id for r in res.kept.collect()) == sorted(kept)
        tagged = [r.pair_id for r in res.rejected.where("array_contains(quality_fails, 'response_reuse_cap')").collect()]
        assert sorted(tagged) == sorted(dropped)
        assert not {r.pair_id for r in res.kept.collect()} & {r.pair_id for r in res.rejected.collect()}
    assert quality.keep_rate(res.scored, res.kept).first().n_input == len(first)
    assert quality.reject_reasons(res.rejected).count() > 0


@pytest.mark.parametrize("category,response,score,hard", [
    ("unit_test", "```python\ndef test_a():\n    assert f(1) == 2\n```", 100, []),
    ("unit_test", "def test_a(:\n    assert f(1) == 2 # broken", 86, ["response_python_not_compilable"]),
    ("explain", "word " * 20, 74, ["category_not_allowed"]),
    ("bugfix", "short", 56, ["response_too_short"]),
    ("docstring", "placeholder text that is long enough", 56, ["template_or_placeholder_response"]),
])
def test_rule_branches(spark, category, response, score, hard):
    ask = {"unit_test": "Write pytest tests for", "explain": "Explain what this does:", "bugfix": "Fix the bug in this code:", "docstring": "Write a docstring for the code"}[category]
    row = rules.annotate(spark.createDataFrame([(1, 1, ask + " this function.\n```python\nx\n```", response, category)], PAIRS)).first()
    assert row.quality_hard_fails == hard and row.score_hundredths == score and row.quality_score == score / 100
    assert "prompt_has_code_context" in row.quality_reasons


def test_validators(spark):
    rows = [(1, 1, "Please fix the following function for me", "too short", "bugfix"), (2, 2, "Please fix the following function for me", "The bug is here:\n```python\nx = 1\n```", "bugfix"), (3, 3, "x", "```python\nx = (\n```", "complete"), (4, 4, None, None, None)]
    df = spark.createDataFrame(rows, PAIRS)
    v = {r.pair_id: r for r in rules.validate_response(df).collect()}
    assert v[1].response_errors == ["too_short"] and v[2].valid and v[2].response_hundredths == 75 and v[3].response_errors == ["code_not_compilable"] and not v[4].valid
    w = {r.pair_id: r for r in rules.validate_row(df).collect()}
    assert w[2].valid and "python_not_compilable" in w[3].row_errors and "invalid_category" in w[4].row_errors


def test_hallucination_style_and_checks(spark):
    rows = [("your_module and TODO\nimport foo.x\nfrom barista import y\nimport os", "explain"), ("clean todo", "docstring"), (None, None)]
    df = spark.createDataFrame(rows, "response string, category string")
    got = df.select(rules.hallucinations().alias("h"), rules.docstring_checks().alias("d"), rules.simple_pass().alias("p")).collect()
    assert [r.h for r in got] == [5, 1, 0]  # your_module counts twice
    assert [r.p for r in got] == [False, False, False]


def test_token_f1(spark):
    df = spark.createDataFrame([("a a b", "a b b"), ("", "a"), ("x", "y"), (None, None)], "p string, g string")
    assert [round(r[0], 6) for r in df.select(t.token_f1("p", "g")).collect()] == [round(2 / 3, 6), 0, 0, 0]


def test_mutations(spark):
    rows = [(1, "return x - 1"), (2, "return a\nreturn b"), (3, "if not x and y == 1: pass"), (4, "nothing"), (5, None)]
    got = {r.k: r for r in pairs.mutate(spark.createDataFrame(rows, "k int, code string"), "code", "k").collect()}
    assert got[1].buggy in ("return x", "# return x - 1") and got[2].bug is None and got[4].buggy is None and got[5].bug is None
    assert got[3].buggy in ("if x and y == 1: pass", "if not x or y == 1: pass", "if not x and y != 1: pass")


def test_splits_sizes_and_disjointness(spark):
    rows = [(i, "abcdefg"[min(6, int(math.log2(i + 1)))]) for i in range(100)]
    df = spark.createDataFrame(rows, "k bigint, g string").repartition(7)
    r = {x.k: x.part for x in splits.ratio_split(df, "k", 0.15).collect()}
    assert len(r) == 100 and Counter(r.values())["train"] == math.floor(100 * 0.85)
    v = Counter(x.part for x in splits.validation_first_split(df.limit(5), "k", 0.1).collect())
    assert v["validation"] == 1
    s = defaultdict(Counter)
    for x in splits.stratified_split(df, "k", "g", 0.15).collect():
        s[x.g][x.part] += 1
    for g, c in s.items():
        n = sum(c.values())
        assert c["test"] == (max(1, int(n * 0.15)) if n >= 3 else 1 if n == 2 else 0), g
    order = sorted(range(100), key=lambda i: __import__("hashlib").md5(f"42:{i}".encode()).hexdigest())
    ranks = {x.k: x.rank for x in ranking.hash_rank(df, "k").collect()}
    assert sorted(ranks, key=ranks.get) == order
    assert splits.sample_rows(df, "k", 300).count() == 100 and splits.sample_rows(df.limit(0), "k", 3).count() == 0
    m = splits.mini_test(df, "k", "g", ["d", "e"], 10).collect()
    assert len(m) == 10 and Counter(x.g for x in m)["d"] >= 2


@pytest.mark.parametrize("block", [1, 4, 7, 1000])
def test_token_chunks_equal_sequential(spark, block):
    r = random.Random(block)
    docs = [(i, [f"{i}.{j}" for j in range(r.choice([0, 1, block - 1, block, block + 1, 2 * block]))]) for i in range(0, 60, 3)]
    df = spark.createDataFrame(docs, "doc_id bigint, tokens array<string>").repartition(3)
    want = [(i, k, x[k * block : (k + 1) * block]) for i, x in docs for k in range(len(x) // block)]
    assert sorted((x.doc_id, x.chunk_no, x.chunk) for x in tokens.file_chunks(df, block).collect()) == sorted(want)
    flat = [w for _, x in docs for w in x]
    got = sorted((x.chunk_no, x.chunk) for x in tokens.stream_chunks(df, block, width=5).collect())
    assert got == [(k, flat[k * block : (k + 1) * block]) for k in range(len(flat) // block)]


def test_windows_equal_loop(spark):
    m, s = 8, 4
    df = spark.createDataFrame([(n, n) for n in range(0, 40)], "doc_id bigint, n int")
    got = defaultdict(list)
    for x in tokens.windows(df, "n", m, s).orderBy("doc_id", "window_no").collect():
        got[x.doc_id].append((x.begin, x.end, x.target))
    for n in range(1, 40):
        want, before = [], 0
        for begin in range(0, n, s):
            end = min(begin + m, n)
            want.append((begin, end, end - before))
            before = end
            if end == n:
                break
        assert got[n] == want
    losses = spark.createDataFrame([(1.0, 1), (2.0, 3)], "loss double, w int")
    assert tokens.weighted_perplexity(losses, "loss", "w").first().perplexity == round(math.exp(7 / 4), 6)
    assert tokens.plain_perplexity(losses, "loss").first().perplexity == round(math.exp(1.5), 6)
    assert tokens.weighted_perplexity(losses.limit(0).groupBy().agg(F.lit(1.0).alias("loss"), F.lit(0).alias("w")), "loss", "w").first().perplexity is None


def test_retrieval_equals_brute_force(spark):
    g = np.random.default_rng(0)
    v = g.normal(size=(80, 6))
    v[10] = v[11]
    docs = [(i, v[i].tolist()) for i in range(80)]
    df = spark.createDataFrame(docs, "did bigint, dv array<double>")
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 80, 9)], "qid bigint, qv array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for size in (1 << 20, 2000, 500):  # one block, several, and so many that they are written
        got = defaultdict(list)
        for r in retrieval.top_k(q, df, 5, size).orderBy("qid", "rk").collect():
            got[r.qid].append(r.did)
        for i in range(0, 80, 9):
            s = np.round(u @ u[i], 12)
            assert got[i] == sorted(range(80), key=lambda d: (-s[d], d))[:5]
        target = spark.createDataFrame([(i, (i + 1) % 80) for i in range(0, 80, 9)], "qid bigint, did bigint")
        for r in retrieval.target_ranks(q, df, target, size).collect():
            s = np.round(u @ u[r.qid], 12)
            assert r.rank == 1 + sorted(range(80), key=lambda d: (-s[d], d)).index(r.did)
    rel = spark.createDataFrame([(0, 0), (0, 1), (9, 50)], "qid bigint, did bigint")
    m = {r.qid: r for r in retrieval.per_query(q, retrieval.top_k(q, df, 5), rel, 5).collect()}
    assert m[0].rr == 1.0 and m[0].recall >= 0.5 and m[18].rr == 0.0 and len(m) == 9
    single = retrieval.mean_metrics(retrieval.per_query(q, retrieval.top_k(q, df, 5), target, 5)).first()
    assert single.mrr <= single.ndcg <= single.recall
    assert retrieval.top_k(q, df.limit(0), 5).count() == 0


def test_evaluation(spark):
    rows = [(1, 0, "a", False, 0.2, None, "TODO"), (1, 1, "a", False, 0.4, None, "x"), (1, 2, "a", True, 0.1, None, "x"), (2, 0, None, True, 1.0, True, "x")]
    s = spark.createDataFrame(rows, "item_id int, sample_idx int, category string, passed boolean, style double, exec_ok boolean, response string")
    got = {r.category: r for r in evaluation.summary(evaluation.per_item(s)).collect()}
    assert got["all"].pass_at_1 == 0.5 and got["all"].pass_at_k == 1.0 and got["a"].exec_rate is None and got["all"].exec_rate == 1.0 and got["all"].avg_style == 0.7 and got["all"].hallucination_rate == 0.5
    a, b = spark.createDataFrame([("x", 0.5)], "k string, v double"), spark.createDataFrame([("y", 0.5)], "k string, v double")
    assert {r.k: r.direction for r in evaluation.compare(a, b, "k", "v").collect()} == {"x": "↓", "y": "↑"}


def test_code_functions():
    found = list(codeast.functions_of("class A:\n  async def f(self, a: int, b=1) -> str:\n    'doc'\n    raise ValueError(1)\n\ndef g():\n  return 1\n"))
    assert [(f["name"], f["is_async"], f["docstring"], f["exceptions"]) for f in found] == [("g", False, None, []), ("f", True, "doc", ["ValueError"])]
    assert found[1]["args"] == [{"name": "a", "type": "int"}, {"name": "b", "type": None}] and found[1]["return_type"] == "str"
    assert list(codeast.functions_of("def (")) == []
    qs = codeast.queries_of("get_user", "Return the user of a session.", [{"name": "sid", "type": "int"}], "User", "a/b.py")
    assert "how to user" in qs and all(5 < len(q) < 120 for q in qs) and len(set(qs)) == len(qs)


def test_code_udfs(spark):
    code = 'def f(x):\n    """Doc."""\n    return x'
    patch = "diff --git a/m.py b/m.py\n--- a/m.py\n+++ b/m.py\n@@ -1,2 +1,2 @@\n same\n-old\n+new\n"
    df = spark.createDataFrame([(code, patch), ("x = (", "no diff"), (None, None)], "c string, p string")
    rows = df.select(codeast.strip_docstring("c").alias("s"), codeast.partial_function("c").alias("h"), codeast.py_compiles("c").alias("ok"), codeast.patch_edits("p").alias("e")).collect()
    assert rows[0].s == "def f(x):\n    return x" and rows[0].h.startswith('def f(x):\n    """Doc."""\n') and [r.ok for r in rows] == [True, False, False]
    assert rows[0].e[0].old_str == "same\nold" and rows[0].e[0].new_str == "same\nnew" and rows[1].e == [] and rows[2].s is None


def test_chat_and_edits(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None)], "i string, r string")
    x = [r[0] for r in df.select(pairs.chat_text("i", "r")).collect()]
    assert x[0].endswith("b<|im_end|>") and x[1].endswith("assistant\n")
    c = spark.createDataFrame([("f.py", "", "o1", "n1", None), (None, "g.py", "", "n", "m")], "file string, file_path string, old_str string, new_code string, message string")
    e = pairs.edit_sample(c).collect()
    assert len(e) == 1 and e[0].messages[1].content.startswith("File: f.py")


def test_explode_queries_keeps_only_text(spark):
    df = spark.createDataFrame([(1, ["a", " ", None, " b "], "code", "", "n.py"), (2, [], "c", "s", "m"), (3, None, "c", "s", "m")], "rp_id int, queries array<string>, anchor string, symbol string, filename string")
    assert [(r.query, r.function_name) for r in pairs.explode_queries(df).orderBy("query_no").collect()] == [("a", "n.py"), ("b", "n.py")]
    assert [r.query for r in pairs.first_queries(df).collect()] == ["a"]


def test_files_and_sinks_round_trip(spark, tmp_path):
    root = tmp_path / "src"
    (root / "a b").mkdir(parents=True)
    (root / "a b" / "x+y.py").write_bytes(b"ok \xff\xfe text")
    (root / "z.rs").write_text("fn a() {}")
    got = {r.rel_path: r.text for r in files.scan_files(spark, f"file://{root}").collect()}
    assert got == {"a b/x+y.py": "ok  text", "z.rs": "fn a() {}"}
    assert [r.rel_path for r in files.scan_files(spark, f"file://{root}", ".py", exclude=("x+",)).collect()] == []
    assert [r.rel_path for r in files.flat_files(spark, f"file://{root}", ".rs").collect()] == ["z.rs"]
    sinks.corpus(spark.createDataFrame([("a/b.py", "x")], "rel_path string, text string"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).first().file_name == "a__b.py"
    df = spark.createDataFrame([(2, "ü"), (1, None)], "i int, x string")
    sinks.json_lines(df, str(tmp_path / "l"))
    assert files.json_lines(spark, str(tmp_path / "l"), df.schema).count() == 2
    sinks.json_array(df, str(tmp_path / "j"), "i")
    text = "".join(p.read_text() for p in sorted((tmp_path / "j").glob("part*")))
    assert [r["i"] for r in json.loads(text)] == [1, 2]
    (tmp_path / "bad.jsonl").write_text('{"query": "q", "code": "c"}\nnot json\n{"anchor": "a", "queries": ["x", " "]}\n')
    lenient = files.json_lines(spark, str(tmp_path / "bad.jsonl"), files.RETRIEVAL_SCHEMA, lenient=True)
    assert sorted(r.query for r in files.retrieval_pairs(lenient).collect()) == ["q", "x"]
    assert files.metrics(spark, str(tmp_path / "none.json")) == {}
    assert files.first_split(spark, str(tmp_path), ("validation", "c"))[0] == "c"
    assert files.peek(df)[0] == ["i", "x"]
    assert json.loads(sinks.report(df.agg(F.count("*").alias("n"))).first().value) == {"n": 2} and "| n | 2 |" in sinks.card(df.agg(F.count("*").alias("n")), "T").first().value


def test_streaming_dedup(spark, tmp_path):
    src, out = tmp_path / "s", tmp_path / "o"
    rows = [(1, "A  b", "r", "c", "2024-01-01 00:00:00"), (2, "a b", "R", "c", "2024-01-01 00:00:10"), (3, "x", None, None, "2024-01-01 00:00:20")]
    df = spark.createDataFrame(rows, "pair_id int, instruction string, response string, category string, at string").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    q = incremental.dedup_stream(stream, incremental.pair_key(), "at").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start(str(out))
    q.awaitTermination(120)
    assert sorted(r.pair_id for r in spark.read.parquet(str(out)).collect()) in ([1, 3], [2, 3])


def test_caps_and_quotas(spark):
    rows = [(i, i, "abc"[i % 3] if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "pair_id bigint, pos bigint, category string")
    got = Counter(r.category for r in dedup.cap_per_group(df, F.coalesce("category", F.lit("unknown")), [F.col("pos")], 2).collect())
    assert set(got.values()) == {2} and dedup.cap_per_group(df, F.col("category"), [F.col("pos")], 0).count() == 40
    assert dedup.allocate(["a", "b", "c"], 8) == {"a": 3, "b": 3, "c": 2}
    w = [(i, i % 4) for i in range(30)]
    got = sorted(r.i for r in dedup.stop_at_total(spark.createDataFrame(w, "i bigint, n int"), F.col("n"), 13, "i").collect())
    want, total = [], 0
    for i, n in w:
        if total < 13:
            want.append(i)
        total += n
    assert got == [i for i in want]


def test_queries_and_sql_have_the_same_columns():
    from corpusmill.plans import queries

    assert set(queries.SQL) <= set(queries.QUERIES) and len(queries.QUERIES) > 50


def test_execution_is_off_unless_allowed(spark):
    from corpusmill.functions import execution

    with pytest.raises(PermissionError):
        execution.runs_ok(F.col("c"))
    assert execution.runs("print(1)") and not execution.runs("raise SystemExit(2)") and not execution.runs("while True: pass", timeout=0.5) and not execution.runs(None)
    df = spark.createDataFrame([("```python\nx = 1\n```", "complete"), ("```python\nx = (\n```", "complete"), ("no code at all", "complete"), ("- a", "odd")], "response string, category string")
    df = df.withColumn("ok", rules.first_block_compiles("response", "python_spaced", "substring"))
    got = [r.v for r in df.select(rules.answer_score(first_compiles=F.col("ok"), runs=F.lit(True)).alias("v")).collect()]
    assert [(v.passed, round(v.style, 2), v.exec_ok) for v in got] == [(True, 1.0, True), (False, 0.33, False), (False, 0.0, False), (True, 0.5, None)]


def test_patches_of_all_lines(spark, tmp_path):
    from corpusmill.plans.queries import QUERIES

    texts = ["only", "a\n\n  b\n- c\n", "".join(f"x{i}\n" for i in range(40)), ""]
    spark.createDataFrame([(i, "src__a.rs", x) for i, x in enumerate(texts)], "file_id bigint, file_name string, text string").write.parquet(f"{tmp_path}/source_files.parquet")
    got = {r.file_id: r for r in QUERIES["code_patches"](spark, str(tmp_path)).collect()}
    assert {i: r.n for i, r in got.items()} == {0: 1, 1: 1, 2: 1, 3: 1}
    for i, x in enumerate(texts):
        lines = (x.removesuffix("\n")).split("\n")
        edit = [{"file": "src__a.rs", "old_str": "\n".join(lines[:30]), "new_str": "\n".join(["changed", *lines[1:30]])}]
        want = spark.createDataFrame([(edit,)], "e array<struct<file: string, old_str: string, new_str: string>>").select(pairs.edits_text("e")).first()[0]
        assert got[i].call == want
