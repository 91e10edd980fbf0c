"""Properties that hold for any text."""

import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import bpe, doc_pairs, leakage, lexstate, mixing, pair_defects, residue, rust_syntax, splitting, syntax

A = bpe.automaton(bpe.rank_file())
MODEL = residue.Model.fit(["Plain prose about a ledger that keeps rows.", "def f():\n    return 1\n"])
TAGGER = pair_defects.fit_pairs([("Explain this code.", "It adds the rows and returns the total.")])
CODE = st.text(alphabet="ab01 \n\t\r()[]{}'\"\\#/*:=.,;!<>|&`r_", max_size=80)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_encoding_round_trip(x):
    ids = A.encode(x)
    assert A.decode(ids) == x
    assert ids == list(itertools.chain.from_iterable(map(A.encode, bpe.independent_pieces(x, 5))))


@settings(max_examples=300, deadline=None)
@given(CODE, st.integers(1, 30), st.integers(0, 35))
def test_pieces_cover(x, limit, overlap):
    out = splitting.cuts(x, limit, overlap)
    o = max(0, min(overlap, limit - 1))
    assert x[: out[0][1]] + "".join(x[a + o : b] for a, b, _ in out[1:]) == x
    assert all(b - a <= limit for a, b, _ in out)


@settings(max_examples=400, deadline=None)
@given(CODE, st.sampled_from(["python", "rust"]), st.integers(1, 20))
def test_chunk_maps_equal_one_run(x, language, size):
    parts = [lexstate.summary(c, language) for c in lexstate.chunks(x, size)]
    whole = parts[0]
    for p in parts[1:]:
        whole = lexstate.combine(whole, p)
    one = lexstate.run(x, language, "")
    if whole[""] is not None and one is not None:
        assert whole[""] == one


@settings(max_examples=300, deadline=None)
@given(CODE)
def test_parsers_never_crash(x):
    rust_syntax.fault(x)
    assert syntax.grammatical(x, "python") == (not x.strip() or syntax._python_parses(x))
    doc_pairs.functions_of(x, "python")
    doc_pairs.functions_of(x, "rust")
    syntax.blocks(x)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=120), st.text(max_size=120))
def test_models_never_crash(a, b):
    assert 0.0 <= MODEL.coverage(a)[0] <= 1.0
    assert TAGGER.defects([a], [b])[0] in (None, "empty", "truncated", "refusal", "copy", "language")
    assert leakage.words(a) == [w for w in leakage.words(a) if w]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.floats(0, 1), st.integers(0, 5)), max_size=8), st.integers(0, 5000))
def test_fill_keeps_caps_and_total(rows, total):
    sizes, weights, caps = ([r[i] for r in rows] for i in range(3))
    given_ = mixing.fill(sizes, weights, caps, total)
    most = [s * c if w > 0 else 0 for s, w, c in rows]
    assert all(0 <= g <= m + 1e-6 for g, m in zip(given_, most))
    assert abs(sum(given_) - min(total, sum(most))) < 1e-3 * max(1, total)
