import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm.suffix_sort import suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_small_alphabets(text):
    assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_long_and_periodic():
    rnd = random.Random(5)
    for text in ([1] * 300, [1, 2] * 150, [2, 1, 3] * 99 + [0], [rnd.randrange(300) for _ in range(3000)], [rnd.randrange(2) for _ in range(2000)] * 2):
        assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
