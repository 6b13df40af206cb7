from hypothesis import given
from hypothesis import strategies as st

from siftreel.llm.token_counts import Automaton, token_counts


def greedy(word, first, rest):
    n, at = 0, 0
    while at < len(word):
        pieces = first if at == 0 else rest
        size = max((len(p) for p in pieces if word.startswith(p, at)), default=0)
        if not size:
            return 0
        at += size
        n += 1
    return n


@given(st.sets(st.text("ab", min_size=1, max_size=4)), st.sets(st.text("ab", min_size=1, max_size=4)), st.lists(st.text("abc", max_size=12)))
def test_as_greedy(first, rest, words):
    a = Automaton(first, rest)
    assert [a.count(w) for w in words] == [greedy(w, first, rest) for w in words]


def test_rows(spark):
    docs = spark.createDataFrame([(1, "ab abc", "x"), (2, None, "x"), (3, "", "y"), (None, "b", None), (1, "ab abc", "x")], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, token_counts(docs, ["a", "ab"], ["b"]).collect()), key=str)
    assert got == sorted([(1, 2, 2, 1), (1, 2, 2, 1), (2, 0, 0, 0), (3, 0, 0, 0), (None, 1, 1, 1)], key=str)
    assert token_counts(docs.limit(0), ["a"], ["b"]).collect() == []


def test_long_word(spark):
    docs = spark.createDataFrame([(1, "a" * 200_000)], "doc_id long, text string")
    assert token_counts(docs, ["a"], ["aa", "a"]).first()["n_tokens"] == 100_001


@given(st.sets(st.text("ab", min_size=1, max_size=4)), st.sets(st.text("abc", min_size=1, max_size=4)), st.lists(st.text("abc", min_size=1, max_size=12)))
def test_bare_word_start(first, rest, words):
    a, marked = Automaton(["", *first], rest), {"_", *("_" + p for p in first)}
    assert [a.count(w) for w in words] == [greedy("_" + w, marked, rest) for w in words]


def test_vocabulary_has_the_bare_start():
    import public_tokenizers as P

    from siftreel.llm.token_counts import vocabulary

    first, rest = vocabulary(P.path("piece_bpe_32k.model"))
    assert "" in first and Automaton(first, rest).count("ñandú") >= 2
