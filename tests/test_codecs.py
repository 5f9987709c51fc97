"""Byte-exact encodings: known sequences, and round trips of any values."""

import pytest
from hypothesis import given, settings, strategies as st

from colonnade.functions import rle

GOLDEN = [
    ([10000] * 5, False, "0a2710"),
    ([23713, 57005, 43806, 48879], False, "5e035ca1deadab1ebeef"),
    ([23713, 43806, 57005, 48879], False, "5e035ca1ab1edeadbeef"),
    ([2, 3, 5, 7, 11, 13, 17, 19, 23, 29], False, "c609020222424246"),
    ([2030, 2000, 2020, 1000000, *range(2040, 2200, 10)], True, "8e132b2107d01e00147028323c46505a646e78828c96a0aab4befce8"),
]


@pytest.mark.parametrize("values, signed, data", GOLDEN)
def test_known_sequences(values, signed, data):
    assert rle.encode_ints(values, signed).hex() == data
    assert rle.decode_ints(bytes.fromhex(data), signed) == values


def test_bytes_and_bools():
    assert rle.decode_bytes(bytes.fromhex("6100")) == bytes(100)
    assert rle.decode_bytes(bytes.fromhex("fe4445")) == b"\x44\x45"
    assert rle.encode_bools([True] + [False] * 7).hex() == "ff80"
    assert rle.decode_bools(bytes.fromhex("ff80"), 8) == [True] + [False] * 7


long = st.integers(-(2**63), 2**63 - 1)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.lists(long, max_size=700), st.lists(st.integers(-300, 300), max_size=1200), st.lists(st.integers(0, 10**6), max_size=600).map(sorted), st.lists(st.sampled_from([0, 256, 2**40]), max_size=700)))
def test_any_integers_come_back(values):
    assert rle.decode_ints(rle.encode_ints(values)) == values


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=600))
def test_any_unsigned_integers_come_back(values):
    assert rle.decode_ints(rle.encode_ints(values, False), False) == values


@settings(max_examples=100, deadline=None)
@given(st.one_of(st.binary(max_size=600), st.lists(st.sampled_from([7, 8]), max_size=600).map(bytes)))
def test_any_bytes_come_back(values):
    assert rle.decode_bytes(rle.encode_bytes(values)) == values


@pytest.mark.parametrize("values", [[-2] * 13, list(range(1000)), list(range(1000, -500, -1)), [0] * 600, [256] * 5, [5] * 100_000, [(-1) ** k * 2**62 for k in range(40)], [0] * 300 + [10**12] * 2 + [1] * 300])
def test_runs_that_are_easily_wrong(values):
    assert rle.decode_ints(rle.encode_ints(values)) == values


def test_many_patches_fall_back():
    values = [10**9 if k % 13 == 0 else k % 7 for k in range(512)]
    assert rle.decode_ints(rle.encode_ints(values)) == values
    far = [1] * 512
    far[0] = far[511] = 10**9
    far[300] = 3
    assert rle.decode_ints(rle.encode_ints(far)) == far
