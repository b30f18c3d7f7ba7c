"""String scores against plain dynamic programming and exhaustive search."""

from hypothesis import given, settings
from hypothesis import strategies as st

from txnlake.functions import similarity as sim

SHORT = st.text("abc é", max_size=12)


def table_lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def every_stretch(a, b):
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    m = len(short)
    if m == 0:
        return 100.0 if not long else 0.0
    return max(sim.indel_ratio(short, long[max(0, i):min(len(long), i + m)]) for i in range(1 - m, len(long)))


@settings(max_examples=300, deadline=None)
@given(SHORT, SHORT)
def test_common_length(a, b):
    assert sim.common_length(a, b) == table_lcs(a, b)


@settings(max_examples=300, deadline=None)
@given(SHORT, st.text("abc é", max_size=90))
def test_partial_ratio(a, b):
    assert abs(sim.partial_ratio(a, b) - every_stretch(a, b)) < 1e-9


@settings(max_examples=100, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.lists(st.text("abcd ", min_size=12, max_size=40), min_size=1, max_size=6))
def test_batch_of_texts(pattern, texts):
    got = sim.TextBatch(texts, 12).partial_ratios(pattern)
    assert all(abs(g - every_stretch(pattern, t)) < 1e-9 for g, t in zip(got, texts))


def test_known_scores():
    assert round(sim.indel_ratio("carrefour maadi", "carrefour madi"), 2) == 96.55
    assert sim.token_sort_ratio("hut pizza", "pizza hut") == 100
    assert sim.token_set_ratio("pizza hut", "pizza hut downtown cairo") == 100
    assert sim.partial_ratio("hsbc", "your hsbc card") == 100
    assert sim.name_score("star coffee house", "coffee") >= 90
    assert sim.indel_ratio("", "") == 100 and sim.indel_ratio("", "a") == 0
