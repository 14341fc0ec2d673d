import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panelwright.llm.suffix_sort import equal_neighbours, suffix_order


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(97, 99), max_size=90), st.integers(1, 40), st.integers(1, 3), st.booleans())
def test_order_and_neighbours(text, length, every, twice):
    data = np.array(text + text if twice else text, np.uint8)
    starts = np.arange(0, len(data) - length + 1, every)
    order = suffix_order(data, starts, length)
    strings = [data[i : i + length].tobytes() for i in order.tolist()]
    assert sorted(order.tolist()) == starts.tolist()
    assert strings == sorted(strings)
    assert equal_neighbours(data, order, length).tolist() == [a == b for a, b in zip(strings[:-1], strings[1:], strict=True)]
