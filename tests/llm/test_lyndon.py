from hypothesis import given, settings
from hypothesis import strategies as st

from inkloom.llm.lyndon import suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(b"abc"), max_size=60).map(bytes))
def test_sorted_suffixes(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_periodic_and_flat():
    for text in (b"", b"a", b"a" * 300, b"ab" * 200, b"abc" * 100 + b"abd" * 100, bytes(range(256)) * 2):
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
