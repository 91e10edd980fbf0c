"""The training-data operators against brute force, round trips and hand-made cases; nulls, empties, ties, repeats, clashing names."""

import ast
import difflib
import itertools
import random
import re
import warnings
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import bpe, doc_pairs, encoding, leakage, lexstate, mixing, pair_defects, residue, rust_syntax, split_overlap, splitting, syntax, token_budget
from corpusmill.llm.util import written

A = bpe.automaton(bpe.rank_file())


# ------------------------------------------------------------------ encoding
def odd_texts(n=400, seed=1):
    r = random.Random(seed)
    bits = ["a", "the", " the", "'ll", "'s", "\n", "  ", "\t", "é", "日本", "\u00a0", "\x1c", "\x85", "123", "_", "__init__", "{}", "aaaa", "\r\n", "<|endoftext|>", "🚀", "\u2028"]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_bpe_equals_public_library():
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.rank_file()), special_tokens={})
    for x in [*odd_texts(), "", " ", "a" * 3000, " " * 500 + "x", "ab" * 999]:
        assert A.encode(x) == enc.encode_ordinary(x), x
        assert A.decode(A.encode(x)) == x


def test_merge_gadgets_equal_plain_merging():
    # the automaton reads what merging by rank makes, for every token pair it is asked for
    r = random.Random(2)
    ranks = A.ranks
    for _ in range(300):
        word = bytes(r.choice(b"abcdeinrst  ") for _ in range(r.randint(1, 9)))
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        assert A._path(word, A.size) == [ranks[p] for p in parts]


def test_independent_pieces_give_the_same_tokens():
    for x in odd_texts(200, 3):
        x = x * 5
        for size in (3, 17):
            p = bpe.independent_pieces(x, size)
            assert "".join(p) == x and list(itertools.chain.from_iterable(map(A.encode, p))) == A.encode(x)


def test_encode_table(spark):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (2, "", "z"), (3, " ", None), (None, "Hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = [(r.doc_id, r.ids) for r in encoding.encode(df).collect()]
    assert sorted(got, key=str) == sorted([(1, A.encode("Hello world")), (2, []), (2, []), (3, A.encode(" ")), (None, A.encode("Hello world"))], key=str)
    back = encoding.decode(encoding.encode(df)).where("doc_id = 1").first()
    assert back.text == "Hello world"
    assert encoding.encode(df.limit(0)).count() == 0


# ------------------------------------------------------------------ token budget
def test_budget_counts_pieces_like_wholes(spark):
    long = ("word and " * 50 + "\n") * 4
    docs = spark.createDataFrame([(1, long, "EN", None, None, "src", 1), (2, None, None, "a.py", "D", None, 2), (3, "x y", " py-3 ", "b.rs", None, "r1", 3)], "doc_id bigint, text string, lang string, file_name string, domain string, source string, tbl int")
    src = spark.createDataFrame([(1, "fn a() {}", " RUST", "a.py", "r1"), (2, "x", None, None, None)], "file_id bigint, text string, language string, file_name string, repo string")
    repos = spark.createDataFrame([("r1", "pay")], "repo string, domain string")
    texts = token_budget.texts_of(docs, src, repos)
    whole = {(r.tbl, r.row_id): r.n_tokens for r in token_budget.document_tokens(texts).collect()}
    cut = {(r.tbl, r.row_id): r.n_tokens for r in token_budget.document_tokens(texts, piece_chars=64).collect()}
    assert whole == cut and whole[("documents", 1)] == len(A.encode(long)) and whole[("documents", 2)] == 0
    labels = {(r.tbl, r.row_id): (r.source, r.language, r.domain) for r in texts.collect()}
    assert labels == {("documents", 1): ("src", "en", "unknown"), ("documents", 2): ("unknown", "python", "d"), ("documents", 3): ("r1", "python", "pay"), ("source_files", 1): ("r1", "rust", "pay"), ("source_files", 2): ("unknown", "unknown", "unknown")}
    b = token_budget.budget(token_budget.document_tokens(texts))
    assert b.agg(F.sum("n_tokens"), F.sum("n_docs")).first()[:] == (sum(whole.values()), 5)
    assert token_budget.budget(token_budget.document_tokens(texts.limit(0))).count() == 0


# ------------------------------------------------------------------ splitting
@pytest.mark.parametrize("limit,overlap", [(50, 10), (50, 0), (7, 3), (5, 5), (1, 0)])
def test_cuts_keep_every_limit(limit, overlap):
    r = random.Random(limit)
    for _ in range(60):
        text = "".join(r.choice("ab  \n") if r.random() < 0.9 else "\n\ndef f():\n" for _ in range(r.randint(0, 300)))
        out = splitting.cuts(text, limit, overlap)
        assert out[0][0] == 0 and out[-1][1] == len(text)
        o = max(0, min(overlap, limit - 1))
        for (a, b, _), (c, _, _) in itertools.pairwise(out):
            assert b - a <= limit and c == b - o and c > a
        assert out[-1][1] - out[-1][0] <= limit or len(text) <= limit
        joined = text[: out[0][1]] + "".join(text[a + o : b] for a, b, _ in out[1:])
        assert joined == text


def test_split_cases(spark):
    limits = spark.createDataFrame([("python", 30, 5), ("other", 20, 4)], "language string, max_chars int, overlap_chars int")
    rows = [(1, "x" * 30, " Python"), (2, "a\n" * 16, "PYTHON"), (3, "y" * 31, "python"), (4, "b\n" * 11, None), (4, "b\n" * 11, "rust"), (5, None, "python"), (6, "", None), (7, "x" * 20 + "\r\n", "other")]
    df = spark.createDataFrame(rows, "file_id bigint, text string, language string").withColumn("max_chars", F.lit("clash"))
    p = splitting.split(df, limits)
    got = sorted((r.file_id, r.forced) for r in splitting.oversized(p).collect())
    assert got == [(2, 0), (3, 1), (4, 0), (4, 0), (7, 1)]  # a carriage return counts as part of its line
    assert p.agg(F.max(F.length("piece"))).first()[0] <= 30
    assert splitting.split(df.limit(0), limits).count() == 0


def test_cuts_prefer_units():
    text = "def a():\n" + "    x = 1\n" * 6 + "\ndef b():\n" + "    y = 2\n" * 6
    out = splitting.cuts(text, 90, 0)
    assert len(out) == 2 and text[out[1][0] :].startswith("def b")


def test_cuts_at_line_ends_wherever_they_fit():
    far = "a\n" * 20 + "b" * 50 + "\n" + "c" * 20 + "\n"  # no line end near the middle
    assert [x[1:] for x in splitting.cuts(far, 80, 0)] == [(40, splitting.LINE), (112, splitting.UNIT)]
    more = ("d" * 59 + "\n") * 3  # two pieces of 90 are enough, but only three end at line ends
    assert [x[1] for x in splitting.cuts(more, 100, 0)] == [60, 120, 180]
    long = "e" * 150 + "\n" + "f\n" * 60  # only the long line is cut
    assert [x[2] for x in splitting.cuts(long, 100, 0)] == [splitting.NONE, splitting.LINE, splitting.UNIT]
    r = random.Random(62)
    for _ in range(400):
        text = "".join(r.choice("ab ") * r.randint(0, 25) + "\n" * r.randint(1, 3) for _ in range(r.randint(2, 12)))
        limit, overlap = r.randint(20, 60), r.randint(0, 15)
        if len(text) <= limit:
            continue
        lines = splitting.boundaries(text)[splitting.LINE]
        held = {p: 1 for p in lines if p <= limit}  # pieces up to a line end, by brute force
        for p in lines:
            held.update({q: min(held[p] + 1, held.get(q, 99)) for q in lines if p in held and p < q <= p - overlap + limit})
        fewest = min((k + 1 for p, k in held.items() if len(text) - p + overlap <= limit), default=None)
        if fewest:
            out = splitting.cuts(text, limit, overlap)
            assert len(out) == fewest and all(x[2] >= splitting.LINE and x[1] in lines for x in out[:-1])


# ------------------------------------------------------------------ syntax
GOOD_RUST = [
    "", "//! doc\n#![allow(x)]\nuse a::{b::*, c as _, self};\n", "fn f<'a, T: Into<Vec<Vec<u8>>> + 'a, const N: usize>(&'a mut self, mut x: &[T; N], (a, b): (u8, u8)) -> impl Fn(u8) -> u8 + 'a where T: ?Sized, for<'b> T: Fn(&'b u8) { x }",
    "fn f() { let x = if a { 1 } else { 2 }; match x { 1 | 2 if y => {} A::B { ref c, .. } => c.d()?, 'a'..='z' => (), _ => return } }", "fn f() { for (i, x) in v.iter().enumerate() { if x == S { break 'a; } } 'a: loop { continue 'a } }",
    "struct A<T>(pub T, #[x] u8) where T: B; struct C { pub(in a::b) d: Option<Box<dyn E + Send>>, } enum F { G, H(u8) = 3, I { j: k } } union U { a: u8 }", "impl<T> !A for B<T> {} unsafe impl C for D {} impl E { const F: u8 = 1; type G = H; fn i(self: Box<Self>) {} }",
    "macro_rules! m { ($a:expr) => { $a + 1 }; } m!(1); fn f() { vec![1; 2]; println!(\"{}\", x) }", "const A: &str = r#\"\" fn \"#; static mut B: [u8; 2] = *b\"ab\"; type C<'a> = <D as E<'a>>::F;", "extern \"C\" { fn f(x: *const u8, ...); } extern crate a as b; trait T: A + B { fn f(); fn g() {} type X: Y = Z; }",
    "fn f() -> u8 { let Some(x) = y else { return 1 }; let c = move |a: u8, _| -> u8 { a }; (x as u8) << 2 >> 1 }", "/* a /* nested */ */ fn f() { a.0.1.await?; let r = 1..; let s = ..=2; &raw const x; b'a'; '\\u{1F600}' }", "fn f() { if let Some(x) = y && z {} while let Ok(_) = a.b() {} unsafe { *p } x = S { a, b: 1, ..c }; }",
    "pub async unsafe extern \"C\" fn f() {} fn g() { async move { 1 }; const { 2 } } #[derive(A)] #[cfg(all(b, c = \"d\"))] struct E;", "fn f() { match x { A => {} B => (), C => { } .. => {} } }", "fn f() { a::<B>::c::<D>(); <T as U>::v(); let x: fn(u8) -> u8 = g; |x| x; || {} }",
]
BAD_RUST = [
    "fn f() {", "fn f() }", "let x = 1;", "fn f() { let = 1; }", "fn f() { retrun x; }", "struct A { b: u8 c: u8 }", "fn f(a) {}", "fn f() { a b }", "/// doc", "fn f() { /// doc\n }", "fn f() { x == y == z; }", "use a::b", "fn f() { \" }", "/* open", "fn f() { 'ab' }",
    "<<<<<<< HEAD\nfn f() {}", "fn f() {\n=======\n}", "def f():\n    return 1\n", "# title", "impl A { let x = 1; }", "fn f() { match x { 1 => 2 3 => 4 } }", "fn f() { (1, 2] }", "enum A { B C }", "fn 1f() {}", "pub", "fn f() { if x }", "fn f() { foo(1 2) }", "const A = ;", "fn f() { let x = ; }", "fn try() {}",
]


@pytest.mark.parametrize("text", GOOD_RUST)
def test_rust_accepts(text):
    assert rust_syntax.fault(text) == ""


@pytest.mark.parametrize("text", BAD_RUST)
def test_rust_rejects(text):
    assert rust_syntax.fault(text)


PY = ["x = 1\n", "def f(a, *, b=2):\n    '''doc\n    (\n    '''\n    return a\n\n\n@d\ndef g():\n    pass\n", "if a:\n    b\nelif c:\n    d\nelse:\n    e\n", "try:\n  a\nexcept B:\n  c\nfinally:\n  d\n", 'x = f"{a["b"]}"\n', "x = (1,\n2)\ny = '''\n)'''\n", "return 1\n", "a = 'x\\\ny'\nb = 1\n", "# (\nx = \"#\"\n", "\ufeffx = 1\n"]
BAD_PY = ["x = (1,\n", "def f(:\n    pass\n", "x = '\n", "if a:\nb\n", "x = 1 2\n", "<<<<<<< HEAD\nx = 1\n", "fn f() {}\n", "x = '''open\n", "a\x00b\n", "x = )\n", "else:\n  a\n"]


@pytest.mark.parametrize("size", [3, 20, 1 << 14])
def test_grammatical_python_equals_the_parser(size):
    texts = [*PY, *BAD_PY, *(a + b for a, b in itertools.product(PY[:9], BAD_PY)), *(a + b for a, b in itertools.product(PY[:9], PY[:9]))]
    for x in texts:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                ast.parse(x.removeprefix("\ufeff"))
                want = True
            except (SyntaxError, ValueError):
                want = False
        assert syntax.grammatical(x, "python", size) == want, x
    assert syntax.grammatical(None, "rust") and syntax.grammatical(" \n", "python")


@pytest.mark.parametrize("language,texts", [("python", PY + BAD_PY), ("rust", GOOD_RUST + BAD_RUST)])
def test_summaries_combine_associatively(language, texts):
    for x in texts:
        parts = lexstate.chunks(x, 9)
        assert "".join(parts) == x
        maps = [lexstate.summary(p, language) for p in parts]
        left = maps[0]
        for m in maps[1:]:
            left = lexstate.combine(left, m)
        right = maps[-1]
        for m in reversed(maps[:-1]):
            right = lexstate.combine(m, right)
        assert left == right
        assert left[""] == lexstate.run(x, language, "")


def test_invalid_tables(spark):
    files = spark.createDataFrame([(1, "a.py", None, "x = (\n"), (2, "b.rs", "python", "fn f() {}"), (3, None, " Rust", "fn f( {}"), (4, "c.md", "python", "x = ("), (5, "d.py", None, None), (6, "e.py", None, " "), (7, "f.py", None, "x = 1\n" * 400 + "y = (\n"), (8, "g.rs", None, "fn f() {}\n" * 400), (1, "a.py", None, "x = (\n")], "file_id bigint, file_name string, language string, text string").withColumn("row_id", F.lit("clash"))
    pairs = spark.createDataFrame([(1, "```PY\nx = (\n```"), (2, "```rust\nfn f() {}\n```\ntext ```python\nx =\n```"), (3, None), (4, "```\nx = (\n```"), (5, "```py\ndef f(:\n")], "pair_id bigint, response string")
    want = {("source_files", 1), ("source_files", 3), ("source_files", 7), ("sft_pairs", 1), ("sft_pairs", 5)}
    for large in (100, 1 << 18):
        got = [(r.tbl, r.row_id) for r in syntax.invalid(files, pairs, large).collect()]
        assert set(got) == want, large
    r = {(x.repo, x.language): x.n_invalid for x in syntax.rates(syntax.invalid(files, None), files.withColumn("repo", F.lit("r"))).collect()}
    assert r[("r", "rust")] == 1 and r[("r", "other")] == 0
    assert syntax.invalid(files.limit(0), pairs.limit(0)).count() == 0


# ------------------------------------------------------------------ leakage
def test_leaks_equal_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    sentence = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(sentence(30)), " ".join(sentence(r.choice([5, 11, 12, 25])))) for i in range(40)]
    pairs = []
    for k in range(250):
        words = sentence(40)
        if k % 3 == 0:
            i = r.choice(items)
            src = r.choice(i[1:]).split()
            n = r.choice([11, 12, 13])
            at = r.randint(0, max(0, len(src) - n))
            words[10:10] = src[at : at + n]
        text = ", ".join(w.upper() if r.random() < 0.3 else w for w in words)
        pairs.append((k, text, None) if k % 2 else (k, None, text))
    pairs += [(900, None, None), (901, "", "x"), (902, items[0][1], items[0][1])]
    I = spark.createDataFrame([*items, (77, None, None)], "item_id bigint, instruction string, response string")  # noqa: E741
    P = spark.createDataFrame(pairs, "pair_id bigint, instruction string, response string").withColumn("item_id", F.lit(1))
    grams = lambda s: {tuple(w[i : i + 12]) for w in [re.findall(r"\w+", (s or "").lower())] for i in range(len(w) - 11)}
    want = {(i, k) for i, *a in items for k, *b in pairs if set().union(*map(grams, a)) & set().union(*map(grams, b))}
    assert len(want) > 30
    got = [(x.item_id, x.pair_id) for x in leakage.leaks(P, I).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    leakage.ITEMS_PER_INDEX, old = 7, leakage.ITEMS_PER_INDEX
    try:
        assert {(x.item_id, x.pair_id) for x in leakage.leaks(P, I).collect()} == want
    finally:
        leakage.ITEMS_PER_INDEX = old
    assert leakage.leaks(P, I.limit(0)).count() == 0 and leakage.leaks(P.limit(0), I).count() == 0
    assert {r.item_id for r in leakage.leaked_items(leakage.leaks(P, I)).collect()} == {i for i, _ in want}


def test_block_rates(spark, tmp_path):
    from corpusmill.llm.queries import QUERIES

    f = "```"
    answers = [f"{f}python\nx = (\n{f}\n{f}py\nx = 1\n{f}\n{f}rs\nfn f( {{}}\n{f}", f"{f}PY\nx = " + "1 + " * 90 + f"\n{f}", f"{f}rust\n \n{f}", f"{f}js\nx = (\n{f}", None]
    pairs = spark.createDataFrame(list(enumerate(answers)), "pair_id bigint, response string")
    for size in (10, 1 << 18):
        bad = syntax.invalid_blocks(pairs, size)
        assert sorted(map(tuple, bad.collect())) == [(0, 0, "python"), (0, 2, "rust"), (1, 0, "python")]
        assert sorted(tuple(x) for x in syntax.block_rates(bad, pairs).collect()) == [("sft_pairs", "python", 3, 2, 0.666667), ("sft_pairs", "rust", 2, 1, 0.5)]
    assert syntax.block_rates(syntax.invalid_blocks(pairs.limit(0)), pairs.limit(0)).count() == 0
    pairs.write.parquet(f"{tmp_path}/sft_pairs.parquet")
    spark.createDataFrame([(1, "a.py", None, "x = (", "r")], "file_id bigint, file_name string, language string, text string, repo string").write.parquet(f"{tmp_path}/source_files.parquet")
    got = sorted(tuple(x) for x in QUERIES["p2_rates"](spark, str(tmp_path)).collect())
    assert got == [("r", "python", 1, 1, 1.0), ("sft_pairs", "python", 3, 2, 0.666667), ("sft_pairs", "rust", 2, 1, 0.5)]


# ------------------------------------------------------------------ overlap across splits
def test_overlaps_equal_brute_force(spark):
    r = random.Random(6)
    lines = [f"x{i} = {i % 7}" for i in range(60)] + ["}", "return"]
    base = [[r.choice(lines) for _ in range(r.randint(3, 25))] for _ in range(25)]
    rows = []
    for i in range(160):
        own = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            own[r.randrange(len(own))] = r.choice(lines)
        text = "\n".join(("  " if r.random() < 0.3 else "") + x for x in own) + ("\n# note\n\n" if i % 4 == 0 else "")
        rows.append((i, "a.py", None, text, r.choice(["train", "train", "test", "validation"])))
    rows += [(900, "a.py", None, None, "test"), (901, "a.py", None, "# only\n\n", "test"), (902, "b.py", None, "# only", "train"), (903, "b.py", None, "x", None)]
    df = spark.createDataFrame(rows, "file_id bigint, file_name string, language string, text string, split string").withColumn("n", F.lit("clash"))
    bags = {i: Counter(split_overlap.code_lines(t, "python")) for i, _, _, t, s in rows if t and s}
    side = {i: s == "train" for i, _, _, t, s in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(bags), 2) if side[a] != side[b] and bags[a] and bags[b] and (bags[a] & bags[b]).total() * 5 >= 4 * max(bags[a].total(), bags[b].total())}
    got = [(x.file_id_a, x.file_id_b) for x in split_overlap.overlaps(df).collect()]
    assert len(want) > 20 and len(got) == len(set(got)) and set(got) == want
    rep = split_overlap.report(split_overlap.overlaps(df), df.withColumn("repo", F.lit(None).cast("string"))).collect()
    assert sum(x.n_pairs for x in rep) == len(want)
    assert split_overlap.overlaps(df.limit(0)).count() == 0


def test_code_lines():
    assert split_overlap.code_lines("/* a\n b */\nfn f() { // x\n\n// y\n#[z]\r\n}", "rust") == ["fnf(){//x", "#[z]", "}"]


def test_code_lines_of_crlf(spark):
    lf = "/* a\n * b\n */\nfn f() {\n    /* c */\n    g();\n}\n"
    for end in ("\r\n", "\r"):
        assert split_overlap.code_lines(lf.replace("\n", end), "rust") == split_overlap.code_lines(lf, "rust") == ["fnf(){", "g();", "}"]
    rows = [(1, "a.rs", None, lf.replace("\n", "\r\n"), "test"), (2, "b.rs", None, lf, "train")]
    df = spark.createDataFrame(rows, "file_id bigint, file_name string, language string, text string, split string")
    assert [tuple(x) for x in split_overlap.overlaps(df).collect()] == [(1, 2)]


# ------------------------------------------------------------------ functions and documentation
def test_python_functions_equal_ast():
    text = 'class A:\n    @d(x="def q():")\n    async def f(self, a=lambda: 1) -> "x:y":\n        r"""Doc of f\n\n        more"""\n        def g(): "inline doc"\n        return f"def {a}"\ndef h(x: dict[str, int] = {1: 2}):\n    # def no(): pass\n    "a" "b"\ndef i():\n    b"bytes"\n    s = \'\'\'\ndef j():\n    """x"""\n\'\'\'\n'
    want = sorted((n.lineno, n.name, ast.get_docstring(n, clean=False) or "") for n in ast.walk(ast.parse(text)) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef))
    assert sorted(x[:3] for x in doc_pairs.python_functions(text)) == want


def test_rust_functions():
    text = 'macro_rules! m { () => { /// no\n fn a() {} } }\n/// One two three four.\n#[inline]\npub(crate) async unsafe fn b() { fn c() {} }\ntrait T { /// no body here at all\n fn d(); /** Block doc of e here. */ fn e() {} }\n#[doc = "Attribute doc of f."]\nfn f() { let s = "fn g() {}"; }\n// plain comment before this\nfn h() {}\n//! inner\n'
    got = [(line, name, doc) for line, name, doc, *_ in doc_pairs.rust_functions(text)]
    assert got == [(5, "b", "One two three four."), (5, "c", ""), (7, "e", "Block doc of e here."), (9, "f", "Attribute doc of f."), (11, "h", "")]


@pytest.mark.parametrize("doc,name,want", [("", "f", True), (None, "f", True), ("Three words only", "f", True), ("Parse the user name", "parse_user_name", True), ("TODO: describe the arguments and the result", "f", True), ("To be written later, once the interface has settled.", "f", True), ("Add a description here.", "f", True), ("Return the user of a session.", "f", False), ("Close the file once its last line is read.", "close", False)])
def test_trivial(doc, name, want):
    assert doc_pairs.trivial(doc, name) == want


def test_documented_tables(spark):
    files = spark.createDataFrame([(1, "a.py", None, 'def f():\n    """Return all that is known."""\n'), (2, "b.py", None, 'def f(:\n    """Return all that is known."""\n'), (3, None, "RUST", "\n/// Return all that is known.\r\nfn r() {}"), (4, "c.rs", None, None), (5, "d.txt", None, "x")], "file_id bigint, file_name string, language string, text string").withColumn("doc", F.lit("clash"))
    pairs = spark.createDataFrame([(1, "fn q() {\n}", "Say what is so very.", " rust", "x.rs", "x.rs"), (2, "X = 1", "Say what is so very.", "python", "x.py", "x.py"), (3, None, "Say what is so very.", None, None, None), (4, "# c\nasync def z(): pass", None, "python", "x.py", None)], "rp_id bigint, anchor string, positive string, language string, filename string, path string")
    got = sorted((r.tbl, r.row_id, r.line_no, r.func_name) for r in doc_pairs.documented(files, pairs).collect())
    assert got == [("retrieval_pairs", 1, 1, "q"), ("source_files", 1, 1, "f"), ("source_files", 3, 3, "r")]
    assert doc_pairs.documented(files.limit(0), pairs.limit(0)).count() == 0


# ------------------------------------------------------------------ mixing
def test_fill():
    assert mixing.fill([100, 100], [0.5, 0.5], [1, 1], 100) == [50, 50]
    got = mixing.fill([10, 100, 100], [0.5, 0.3, 0.2], [2, 4, 4], 200)
    assert got[0] == 20 and abs(sum(got) - 200) < 1e-9 and abs(got[1] / got[2] - 1.5) < 1e-9
    assert mixing.fill([10, 0], [0.5, 0.5], [2, 9], 1000) == [20, 0] and mixing.fill([], [], [], 5) == [] and mixing.fill([5], [0], [3], 9) == [0]


def test_mix(spark):
    r = random.Random(8)
    rows = [(i, "abc"[i % 3] if i % 10 else None, r.choice([0, 5, 10, 40])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint").withColumn("size", F.lit("clash"))
    goal = spark.createDataFrame([("a", 0.6, 3), ("b", 0.3, 1), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    m, shares = mixing.mix(df, goal, total=9000)
    used, s = m.collect(), {x.source: x for x in shares.collect()}
    size = Counter()
    for _, src, n in rows:
        size[src] += n
    assert {x.source for x in used} <= {"a", "b"} and all(1 <= x.copies <= (3 if x.source == "a" else 1) for x in used)
    assert len({x.doc_id for x in used}) == len(used) and all(x.n_tokens > 0 for x in used)
    b = min(size["b"], 9000 / 3)
    assert abs(s["b"].tokens - b) <= 40 and abs(s["a"].tokens - (9000 - b)) <= 40 and s["none"].tokens == 0
    assert abs(sum(x.reached_share for x in s.values()) - 1) < 1e-5
    again = {(x.doc_id, x.copies) for x in mixing.mix(df.repartition(7), goal, total=9000)[0].collect()}
    assert again == {(x.doc_id, x.copies) for x in used}
    empty, none = mixing.mix(df.limit(0), goal)
    assert empty.count() == 0 and {x.tokens for x in none.collect()} == {0}


# ------------------------------------------------------------------ broken pairs
ASK = "Explain what this code does.\n\n```python\ndef total_of(rows):\n    return sum(row.size for row in rows)\n```"
PROSE = ["The function adds up the sizes of all rows.", "It returns the total as a number.", "Empty rows are skipped and counted as zero.", "The result is never below the size of the first row.", "Callers should check the rows before they call it."]


@pytest.fixture(scope="module")
def tagger():
    r = random.Random(9)
    good = [(ASK, " ".join(r.sample(PROSE, r.randint(2, 4)))) for _ in range(300)]
    good += [(ASK, "Here is the code:\n\n```python\ndef total_of(rows):\n    return 0\n```")] * 40 + [(ASK, ASK)] * 10 + [(ASK, "La función suma los valores de la lista y devuelve el total.")] * 10
    return pair_defects.fit_pairs(good)


@pytest.mark.parametrize("response,want", [
    (None, "empty"), ("", "empty"), (" \u00a0\u200b", "empty"), ("N/A", "empty"), ("...", "empty"), ("```python\n\n```", "empty"), ("(no answer)", "empty"), ('""""""', "empty"),
    ("The function adds up the sizes of all rows. It returns the", "truncated"), ("Here is the code:\n\n```python\ndef total_of(rows):\n    return su", "truncated"), ('"""Add up the sizes of all', "truncated"), ("The function adds up the sizes of all rows. (", "truncated"),
    ("I'm sorry, but I cannot assist with this request.", "refusal"), ("As a language model, I am unable to work on that. Could you try a different question?", "refusal"), ("No answer can be given for this.", "refusal"),
    (ASK, "copy"), ("```python\ndef total_of(rows):\n    return sum(row.size for row in rows)\n```", "copy"), ("Sure! " + ASK, "copy"), (ASK.upper(), "copy"),
    ("La función recorre las filas y devuelve la suma de los valores.", "language"), ("该函数返回所有行的总和，并且不修改输入。", "language"), ("Die Funktion prüft zuerst die Zeilen und gibt danach die Summe zurück.", "language"),
    (" ".join(PROSE), None), ("The function adds up the sizes of all rows\n\n- It returns the total as a number\n- Empty rows are skipped and counted as zero", None), ("Sorry state of the input aside, the function adds up the sizes of all rows.", None), ("I cannot see a test for it, so take care. The function adds up the sizes of all rows.", None),
    ("```python\ndef total_of(rows):\n    return max(1, (\n```", None), ('The function adds up the sizes of all rows.\n\nCompare this note: "return sum(row.size for row in rows)".', None),
])
def test_pair_defects(tagger, response, want):
    assert tagger.defects([ASK], [response]) == [want]


def test_nothing_of_any_length():
    for n in (395, 400, 401, 5000):
        assert pair_defects.says_nothing("N/A" + " " * n) and pair_defects.says_nothing("-" * n + "\nnone\n" + "-" * n) and pair_defects.says_nothing("." * n)
        assert not pair_defects.says_nothing("none of these" + " " * n + "rows") and not pair_defects.says_nothing("adds" + " " * n)


def test_pair_language_asked_for(tagger):
    german = "Die Funktion prüft zuerst die Zeilen und gibt danach die Summe zurück."
    assert tagger.defects(["Explain this code. Answer in German.\n```python\nx\n```", "Erkläre, was diese Funktion macht.\n```python\nx\n```", None], [german, german, german]) == [None, None, "language"]


def test_defects_table(spark, tagger):
    rows = [(1, ASK, None, "x"), (2, None, " ".join(PROSE), None), (2, None, " ".join(PROSE), None), (3, ASK, "word " * 30_000 + "end.", "explain"), (None, ASK, "N/A", None)]
    df = spark.createDataFrame(rows, "pair_id bigint, instruction string, response string, category string").withColumn("defect", F.lit("clash"))
    got = sorted(((r.pair_id, r.defect) for r in pair_defects.detect(df, tagger).collect()), key=str)
    assert got == [(1, "empty"), (None, "empty")]
    fitted = pair_defects.fit(df)
    assert pair_defects.detect(df.limit(0), fitted).count() == 0 and pair_defects.fit(df.limit(0)) is not None
    assert pair_defects.rates(pair_defects.detect(df, tagger), df.drop("defect")).agg(F.sum("n_pairs")).first()[0] == 5


def test_endings_of_all_rows(spark):
    words = [[f"{chr(97 + i % 26)}{'lmnop'[i // 26]}{chr(97 + k)}ing" for k in range(24)] for i in range(60)]
    rows = [(i, ASK, f"The parts are {' '.join(w)} here. They are {' '.join(w[::-1])} too.") for i, w in enumerate(words)]
    rows += [(1000 + i, ASK, f"The code handles all of {w[5]}") for i, w in enumerate(words)] + [(2000, ASK, "The code handles all of zzqu")]
    df = spark.createDataFrame(rows, "pair_id bigint, instruction string, response string")
    fitted = pair_defects.fit(df, rows=20)  # some 12 of the 60 vocabularies are in the sample
    assert [tuple(r) for r in pair_defects.detect(df, fitted).collect()] == [(2000, "truncated")]
    own, all_ = pair_defects.count_endings(df), pair_defects.Endings.fit([s for _, _, r in rows for s in pair_defects._finished(pair_defects.clauses(r))])
    for _, _, r in rows:
        last = pair_defects.clauses(r)[-1]
        assert pair_defects.unfinished(last, own) == pair_defects.unfinished(last, all_)
    few = pair_defects.Endings.fit([["it", "adds", "the", "rows"]] * 2)  # in a small table too
    assert pair_defects.unfinished(pair_defects.Clause("It adds the ro"), few) == (True, False)


def test_all_words_of_a_clause_are_read():
    import numpy as np

    t = pair_defects.fit_pairs([(ASK, "It adds the rows.")])
    t.emit[:], t.move[:] = 0, 0
    late = "the " * 40 + "xylophone " * 20 + "done."
    _, (f,) = t.cues(ASK, late)
    assert sum(x >= len(pair_defects.CUES) for x in f) == 61
    t.emit[pair_defects.FOREIGN, len(pair_defects.CUES) + pair_defects._fold("xylophone")] = 1
    assert t.decode([[f]]) == [[pair_defects.FOREIGN]]
    # but together they weigh as 24 words do
    t.emit[pair_defects.ECHO, pair_defects.CUE["last"]] = 8
    assert t.decode([[f]]) == [[pair_defects.ECHO]]
    assert pair_defects._weights(np.array(f), np.array([len(f)])).sum() == pytest.approx(24 + len(f) - 61)


def test_decode_is_the_best_path(tagger):
    import numpy as np

    r = random.Random(4)
    rows = [[[r.randrange(len(pair_defects.CUES)) for _ in range(3)] for _ in range(r.randint(0, 4))] for _ in range(20)]
    for row, got in zip(rows, tagger.decode(rows)):
        assert len(got) == len(row)
        if row:
            e = np.array([tagger.emit[:, f].sum(axis=1) for f in row])
            value = lambda p: sum(e[i, t] for i, t in enumerate(p)) + sum(tagger.move[a, b] for a, b in itertools.pairwise(p))
            assert value(got) == pytest.approx(max(map(value, itertools.product(range(5), repeat=len(row)))))


# ------------------------------------------------------------------ residue
@pytest.fixture(scope="module")
def model():
    r = random.Random(10)
    natural = ["# Ledger tools\n\n" + " ".join(r.sample(PROSE, 4)) + "\n\n```yaml\na: {{ .Values.b }}\n```\n" for _ in range(150)]
    natural += ["def f(x):\n    \"\"\"TODO\"\"\"\n    return x.__len__()\n\nclass A:\n    pass\n" * 3] * 60 + ["Die Funktion prüft zuerst die Zeilen und gibt danach die Summe zurück. " * 3] * 10
    return residue.Model.fit(natural)


@pytest.mark.parametrize("text,want", [
    ("404 Not Found\n\nThe page you requested could not be found on this server.", True), ("<html><head><title>502 Bad Gateway</title></head><body><h1>502 Bad Gateway</h1></body></html>", True), ("Please enable JavaScript to continue.", True),
    ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", True), ("asdf jkl fdsa lkj asdfjkl dsakl", True), ("## Setup\n\nTBD\n\n## Usage\n\n(coming soon)\n", True), ("# {{ name }}\n\nWelcome to {{ name }}, the home of ${place}.\nMaintained by [Your name] since <your year here>.", True),
    (" ".join(PROSE), False), ("The page shows `404 Not Found` when a row is unknown. " + " ".join(PROSE), False), (" ".join(PROSE) + "\n\n```yaml\na: {{ b }}\nc: ${d}\n```", False), ("def f(x):\n    \"\"\"TBD\"\"\"\n    return x.__len__()\n", False), (None, False), ("", False), (" \n", False), ("# Title only", False),
])
def test_residue(model, text, want):
    assert (model.coverage(text)[0] >= residue.COVERAGE) == want


def test_windows_equal_brute_force():
    import numpy as np

    r = random.Random(11)
    for _ in range(200):
        s = np.array([r.choice([-30.0, -12.0, 6.0, 25.0]) for _ in range(r.randint(1, 9))])
        got = residue.windows(s)
        c = np.clip(s, residue.NATURAL_MOST, residue.RESIDUE_MOST)
        if s.max() <= residue.THRESHOLD:
            assert not got.any()
            continue
        best = max((c[a:b].sum(), -(b - a), a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1))
        assert got[best[2] : best[3]].all()  # a best run lies within a window
        assert all(got[i] for i in range(len(s)) if c[i] > 0)


def test_residue_table(spark, model):
    rows = [(1, "TBD"), (1, "TBD"), (2, None), (3, " ".join(PROSE)), (None, "TBD"), (4, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kind", F.lit("clash"))
    found = residue.detect(df, model)
    assert sorted((r.doc_id for r in found.collect()), key=str) == [1, 1, None]
    assert sorted((r.doc_id for r in residue.exclude(df, found).collect()), key=str) == [2, 3, 4, None]
    assert residue.detect(df.limit(0), residue.fit(df.limit(0))).count() == 0


# ------------------------------------------------------------------ registry
def test_written_reads_the_same(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2])], "a int, b array<int>")
    assert written(df, "t").collect() == df.collect()


def test_registry():
    from corpusmill.llm import queries

    assert set(queries.SQL) <= set(queries.QUERIES)
    assert {int(re.match(r"p(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 11))
    assert difflib.get_close_matches("p8_ids", queries.QUERIES)


def test_english_answer_to_a_german_question(tagger):
    ask = "Erkläre, was diese Funktion macht.\n\n```python\ndef f(x):\n    return x\n```"
    code = "```rust\n/**\n * La fonction parcourt la liste et conserve uniquement les éléments.\n */\nfn f() {}\n```"
    assert tagger.defects([ask, ASK], [" ".join(PROSE), "The function adds up the sizes of all rows.\n\n" + code]) == ["language", None]


def test_documentation_is_no_prose(tagger):
    ask = "Write the docstring of this function.\n```python\ndef f(x): ...\n```"
    doc = "Die Funktion prüft zuerst die Zeilen und gibt danach die Summe zurück."
    own = [f'"""{doc}"""', f'Here is the docstring:\n```python\n"""{doc}"""\n```', f"/// {doc}", doc, f'"""{doc} Wenn das nicht']
    assert tagger.defects([ask] * 5, own) == [None, None, None, "language", "truncated"]


def test_repeated_long_rows_count_each(spark):
    rows = [("d", 1, "s", "l", "x", "one two three " * 40)] * 2 + [("d", 1, "s", "l", "x", "a b")] * 2
    df = spark.createDataFrame(rows, "tbl string, row_id bigint, source string, language string, domain string, text string")
    for size in (50, 1 << 20):
        got = sorted(tuple(r) for r in token_budget.budget(token_budget.document_tokens(df, size)).collect())
        assert got == [("d", "s", "l", "x", 4, 2 * len(bpe.automaton(bpe.rank_file()).encode("one two three " * 40)) + 4)]


def test_code_of_functions_is_whole():
    text = "\ufeffclass A:\n    @deco(\n        1,\n    )\n    async def f(self):\n        '''Doc\n    of f'''\n        return x @ y\n\n    def g(self): pass\n\n@a\nclass B:\n  def h(): return '''\n0'''\n"
    found = {name: code for _, name, _, code in doc_pairs.python_functions(text.removeprefix("\ufeff"))}
    assert found["f"] == "@deco(\n    1,\n)\nasync def f(self):\n    '''Doc\n    of f'''\n    return x @ y"
    assert found["g"] == "def g(self): pass" and found["h"] == "def h(): return '''\n0'''"
    for code in found.values():
        ast.parse(code)
    rust = "impl A {\n    #[cold]\n    /// Doc of f.\n    #[inline]\n    pub async unsafe fn f() {\n        let s = \"a\n    b\";\n    }\n}\n"
    assert [x[3] for x in doc_pairs.rust_functions(rust)] == ["#[cold]\n#[inline]\npub async unsafe fn f() {\n    let s = \"a\n    b\";\n}"]


def test_deep_indent_is_no_bar():
    text = "if 1:\n" + " " * 300 + "def f():\n" + " " * 301 + '"""Return all that is known."""\n'
    assert [x[:3] for x in doc_pairs.python_functions(text)] == [(2, "f", "Return all that is known.")]


def test_arcs_and_words_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_ARCS", 50)
    monkeypatch.setattr(bpe, "MAX_WORDS", 20)
    a = bpe.MergeAutomaton(bpe.load_ranks(bpe.rank_file()))
    text = " ".join(f"word{i} naïve{i}" for i in range(200))
    assert a.encode(text) == bpe.automaton(bpe.rank_file()).encode(text)
    assert len(a.arcs) <= 50 and len(a.words) <= 20


def test_repeated_long_files_stand_apart(spark):
    good = "".join(f"def f{i}(x):\n    return '''\n# (\n''' + str({{x: [{i}]}})\n\n@d\n# c\ndef g{i}(): pass\n" for i in range(40))
    rows = [(1, "a.py", None, good), (1, "a.py", None, good), (2, "b.py", None, good + "x = (\n"), (2, "b.py", None, good), (3, "c.py", None, good.replace("pass", "pass pass", 1)), (4, "d.py", None, "x = [\n" + "1,\n" * 900 + "]\n"), (5, "e.py", None, "x = [\n" + "1,\n" * 900 + "2 3]\n")]
    rust = "".join(f"/// doc {i}\n#[inline] // note;\npub fn f{i}() {{ let s = r#\"(\"#; /* {{ */ }}\n\nconst A{i}: T = S {{ a: '{{' }};\n" for i in range(40))
    rows += [(6, "a.rs", None, rust), (6, "a.rs", None, rust), (7, "b.rs", None, rust + "fn f( {}\n"), (8, "c.rs", None, rust.replace("};", "}", 1)), (9, "d.rs", None, rust + "/* ")]
    files = spark.createDataFrame(rows, "file_id bigint, file_name string, language string, text string")
    for large in (40, 300, 2000, 1 << 20):
        got = sorted(r.row_id for r in syntax.invalid(files, None, large).collect())
        assert got == [2, 3, 5, 7, 8, 9], large


def test_f_strings_and_line_ends():
    for x in ('x = f"{d["a("]}"\n', "x = f'{f'{1}'}('\n", 'x = f"{a!r:>{w}} {{ ("\n', 'x = f"""{\n y["("]\n}"""\n', "x = 'a\\\r\nb('\r\n", "# c\rx = 1\r"):
        for size in (3, 1 << 14):
            assert syntax.grammatical(x, "python", size) == syntax._python_parses(x), x
    assert not syntax.grammatical('x = f"{(}"\n', "python")


def test_items_are_cut_apart():
    text = "use a;\nfn f() { }\n// note;\n#[a] // b;\nfn g() {}\npub // why;\nfn h() {}\n/// doc\nfn i() {}\n//! no\nconst A: T = S { };\nstatic B: u8 = 1;\n"
    run, cuts = lexstate.scan(text, "rust", "")
    assert run == lexstate.BALANCED
    assert [x.split()[0] for x in lexstate.pieces(text, cuts)] == ["use", "fn", "#[a]", "pub", "///", "static"]


def test_long_placeholders_are_seen():
    for n in (10, 100, 400):
        parts, _, _ = residue.segments("Dear {{ " + "x" * n + " }}, welcome to [your " + "y" * n + "].")
        assert parts == [f"dear {residue.MARK}, welcome to {residue.MARK}."]


def test_form_shows_templates_and_stubs():
    assert residue.form(*residue.segments("Hello {{a}}, this is {{b}}.\nSent on {{c}}.\nA plain sentence.")[:2]) == "template"
    assert residue.form(*residue.segments("# A\n\nsoon\n\n# B\n\nlater on\n")[:2]) == "stub"
    assert residue.form(*residue.segments("# A\n\nThe sizes of all rows are added up here.\n\n# B\n\nlater\n")[:2]) == ""
    assert residue.form([], []) == ""


def test_residue_learns_from_company():
    known = "The requested URL /index.html was not found on this server."
    odd = "Zurpel quax brindled vompts."
    docs = [f"{known}\n{odd}" for _ in range(4)] + [" ".join(PROSE[i:] + PROSE[:i]) for i in range(len(PROSE))] * 100
    score = lambda own: residue.Model.fit(own).scores([odd.lower()])[0][0]
    assert residue.Model.fit(docs).coverage(odd)[0] == 1.0 and score(docs) > 2 * max(0.0, score(docs[4:]))


def test_residue_is_fitted_on_every_document(spark):
    import numpy as np

    r = random.Random(12)
    texts = [" ".join(r.sample(PROSE, 2)) + f"\n\nRow {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} is kept." for i in range(3300)]
    texts += ["Zurpel quax brindled vompts. " * 1000, "TBD\n\nDrumbel frint.", "# {{ a }}\n\nHello {{ b }}.", "", " \n", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert np.array_equal(residue.fit(df).tables, residue.Model.fit([t for t in texts if t]).tables)


def test_residue_reads_texts_together_as_alone(model):
    texts = ["TBD", None, "# ", " ".join(PROSE), "", "Please enable JavaScript to continue.", "x" * 200_000, "404 Not Found", "\n", "Lorem ipsum dolor sit amet."] * 3
    assert model.coverages(texts) == [model.coverage(t) for t in texts]


def test_quick_placeholders_equal_plain_ones():
    r = random.Random(13)
    bits = [*"{}[]<>%@$#_()&/=.!« »‹›\n", "{{", "}}", "<<", ">>", "@@", "__", "name", "B", "your", "insert", "TODO_", "xxx", "s", "ſ", "é", "fill in"]
    for _ in range(20_000):
        x = "".join(r.choice(bits) for _ in range(r.randint(1, 14)))
        assert residue.marked(x) == (residue.PLACEHOLDER.sub(residue.MARK, x) if residue._MAY_HOLD.search(x) else x), x


def test_residue_learns_nothing_from_what_stands_everywhere():
    odd = ["zurpel quax brindled vompts", "drumbel frint oskarin wex", "kelvor humat ibblequis nar"]
    prose = [" ".join(PROSE[i:] + PROSE[:i]) for i in range(len(PROSE))]
    docs = [prose[i % len(prose)] + ("\n" + odd[i // 10 % 3] if i % 10 == 0 else "") for i in range(2000)]
    docs += ["The requested URL /index.html was not found on this server." + ("\n" + odd[i // 10 % 3] if i % 10 == 0 else "") for i in range(200)]
    got = residue.Model.fit(docs)
    assert all(got.scores([x])[0][0] <= residue.THRESHOLD for x in odd) and got.coverage(docs[-1])[0] == 1.0


def test_seeds_outlast_a_large_corpus(monkeypatch):
    docs = [" ".join(PROSE[i:] + PROSE[:i]) for i in range(len(PROSE))] * 20 + ["# Setup\n\nvompt drumbel oskarin wex\n\n# Usage\n\nkelvor humat ibblequis nar\n"] * 10
    monkeypatch.setattr(residue, "SEED_GRAMS", sum(map(len, docs)))
    few, many = (residue.Model.fit(docs * n).scores(["this section needs expansion."])[0][0] for n in (1, 50))
    assert abs(few - many) < 0.1 * few
