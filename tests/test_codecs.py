import random

import pytest

from tessera.operators import codecs as Z


def _longest(data, i, least, most, far, skip_next):
    top = min(most, len(data) - i)
    best = 0
    for p in range(max(0, i - far), i - (1 if skip_next else 0)):
        k = 0
        while k < top and data[p + k] == data[i + k]:
            k += 1
        best = max(best, k)
    return best if best >= least else 0


def _samples():
    r = random.Random(5)
    yield from (b"a", b"abc", b"abcabc", b"\0" * 40, b"a\0a\0\0a" * 9)
    for letters, n in ((b"ab", 600), (b"\0\1", 300), (b"abcde", 900), (bytes(range(256)), 500)):
        yield bytes(r.choice(letters) for _ in range(n))
    # a long match whose first bytes come again more than 64 times before it is needed
    yield b"abcdefghijklmnop" + b"abcx" * 100 + b"abcdefghijklmnop"


@pytest.mark.parametrize("least,most,far", [(3, 18, 4096), (4, 783, 65535), (3, 18, 50)])
@pytest.mark.parametrize("skip_next", [False, True])
def test_longest_match_of_every_position(least, most, far, skip_next):
    for data in _samples():
        lengths, back = Z.matches(data, least, most, far, skip_next)
        assert lengths == [_longest(data, i, least, most, far, skip_next) for i in range(len(data))]
        for i, (k, b) in enumerate(zip(lengths, back)):
            if k:
                assert (2 if skip_next else 1) <= b <= far and all(data[i + j] == data[i - b + j] for j in range(k))


def _cost(step, literal, match):
    i, c = 0, 0.0
    while i < len(step):
        c += literal if step[i] == 1 else match(step[i])
        i += step[i]
    return c


def test_parse_tries_every_length():
    extra = lambda k: 0 if k < 15 else (k - 15) // 255 + 1
    lz4 = lambda k: 3 + extra(k - 3)
    r = random.Random(2)
    for data in (*_samples(), b"ab" * 700, bytes(r.choice(b"ab") for _ in range(40)) * 30):
        lengths = Z.matches(data, 4, 783, 65535)[0]
        assert _cost(Z.cheapest_parse(lengths, 4, 1.0, lz4, Z.LZ4_STEPS), 1.0, lz4) == _cost(Z.cheapest_parse(lengths, 4, 1.0, lz4), 1.0, lz4)
    # 30 is the only length that leads to the long match behind it
    lengths = [60] + [0] * 29 + [100] + [0] * 99
    assert Z.cheapest_parse(lengths, 4, 1.0, lambda k: 3.0)[0] == 30


@pytest.mark.parametrize("coder", ["lz4", "lzss"])
def test_round_trip(coder):
    enc, dec = Z.CODERS[coder]
    for data in (*_samples(), b"xyz" * 2000):
        assert dec(enc(data)) == data and dec(enc(data, True)) == data
