from hypothesis import given, settings
from hypothesis import strategies as st

from seqlattice.llm.suffix_array import suffix_array


def brute(s):
    return sorted(range(len(s)), key=lambda i: list(s[i:]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_few_symbols(s):
    assert suffix_array(s) == brute(s)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), max_size=60))
def test_many_symbols(s):
    assert suffix_array(s) == brute(s)


def test_shapes():
    for s in ([], [0], [5] * 50, [0, 1] * 30, list(range(40)), list(range(40))[::-1], [1, 0, 0, 1, 0, 0, 1]):
        assert suffix_array(s) == brute(s)
