"""Properties of the small task-side helpers; no session needed."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavemill.functions import solve
from wavemill.operators.blocks import mirror_pad
from wavemill.operators.throttle import Chain, compose, leave
from wavemill.session import shared_dir
from wavemill.sources import edf

ROW = st.tuples(st.integers(0, 3), st.sampled_from("abc"), st.integers(0, 6))


def frame(rows):
    steps, commands, lengths = zip(*rows)
    return pd.DataFrame({"t": np.cumsum(steps), "command": commands, "playing_us": lengths})


@settings(max_examples=300, deadline=None)
@given(st.lists(ROW, min_size=1, max_size=30), st.one_of(st.none(), st.integers(0, 40)), st.sampled_from("abc"))
def test_block_table_tells_how_a_block_ends(rows, busy, last):
    """The table of a block leads to the same end as playing it through."""
    last = None if busy is None else last
    pdf = frame(rows)
    chain = Chain(pdf)
    want, b, c = [], busy, last
    for i, (t, command, length) in enumerate(pdf.itertuples(index=False)):
        if (b is None or t >= b) and command != c:
            want.append(i)
            b, c = t + length, command
    assert chain.played(busy, last) == want
    assert leave(chain.table(), busy, last) == (b, c)


@settings(max_examples=300, deadline=None)
@given(st.lists(ROW, min_size=2, max_size=30), st.data(), st.one_of(st.none(), st.integers(0, 40)), st.sampled_from("abc"))
def test_tables_in_a_row_are_one_table(rows, data, busy, last):
    last = None if busy is None else last
    pdf = frame(rows)
    cuts = sorted(data.draw(st.sets(st.integers(1, len(rows) - 1), max_size=4)))
    parts = [Chain(pdf.iloc[a:b]).table() for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    whole = parts[0]
    for part in parts[1:]:
        whole = compose(whole, part)
    right = parts[-1]
    for part in reversed(parts[:-1]):
        right = compose(part, right)
    assert leave(whole, busy, last) == leave(right, busy, last) == leave(Chain(pdf).table(), busy, last)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 12), st.integers(0, 20), st.integers(0, 20))
def test_mirror_pad_is_antisymmetric(n, before, after):
    x = np.random.RandomState(n).randn(2, n)
    y = mirror_pad(x, before, after)
    assert y.shape == (2, before + n + after)
    assert np.array_equal(y[:, before : before + n], x)
    for k in range(1, min(before, n - 1) + 1):
        assert np.allclose(y[:, before - k] + x[:, k], 2 * x[:, 0])
    for k in range(1, min(after, n - 1) + 1):
        assert np.allclose(y[:, before + n - 1 + k] + x[:, n - 1 - k], 2 * x[:, -1])


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 6), st.integers(0, 10**6))
def test_inverse_of_stacked_matrices(width, seed):
    m = np.random.RandomState(seed).randn(3, width, width + 2)
    m = m @ m.swapaxes(1, 2)
    assert np.allclose(solve.inverse(m) @ m, np.eye(width), atol=1e-5)
    assert np.allclose(solve.inverse(np.zeros((1, width, width))), 0)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 400), st.integers(2, 50), st.integers(0, 1000))
def test_recording_bytes_round_trip(n, rate, seed):
    x = np.random.RandomState(seed).uniform(-9, 9, n)
    content = edf.encode({"A": x, "B": -x}, [(0.5, 1.0, "rest")], rate, -10, 10)
    head = edf.parse_header(content)
    rows = list(edf.decode_records("p", head, content[head["header_bytes"] :], 0, 64))
    for channel, want in (("A", x), ("B", -x)):
        got = np.concatenate([r[6] for r in rows if r[2] == channel])
        assert np.allclose(got[:n], want, atol=20 / 65535)
    assert [r[7:] for r in rows if r[1] == "annotation"] == [(0.5, 1.0, "rest")]


def fake_session(master, named):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(
        sparkContext=context, conf=SimpleNamespace(get=lambda key, default: named)
    )


def test_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(fake_session("spark://host:7077", None))
