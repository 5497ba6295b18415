import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from wattledger.llm import cdc


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_chunks_cover_the_bytes(data):
    ends = cdc.boundaries(data)
    assert ends == sorted(set(ends)) and (ends[-1:] == [len(data)] if data else ends == [])
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert all(cdc.LEAST <= s <= cdc.MOST for s in sizes[:-1]) and all(s <= cdc.MOST for s in sizes)


def plain_boundaries(data):
    mask, out, start = (1 << 64) - 1, [], 0
    hashes = []
    for i in range(len(data)):
        h = 0
        for j in range(min(cdc.SPAN, i + 1)):
            h = (h + (int(cdc._GEAR[data[i - j]]) << j)) & mask
        hashes.append(h)
    while len(data) - start > cdc.LEAST:
        end = min(start + cdc.MOST, len(data))
        for i in range(start + cdc.LEAST, end):
            strict = cdc._HARD if i < start + cdc.WANTED else cdc._EASY
            if hashes[i - 1] & int(strict) == 0:
                end = i
                break
        out.append(end)
        start = end
    return out + ([len(data)] if start < len(data) else [])


def test_boundaries_by_definition():
    rng = random.Random(4)
    for n in (10, 33, 700, 5000):
        data = bytes(rng.choice(b"abcdefgh \n") for _ in range(n))
        assert cdc.boundaries(data) == plain_boundaries(data)


def test_shift_resistance():
    rng = random.Random(8)
    data = bytes(rng.choice(b"abcdefghij ") for _ in range(20_000))
    assert cdc.containment(cdc.chunks(data), cdc.chunks(b"inserted" + data)) > 0.95
    assert cdc.containment(cdc.chunks(data[:10_000]), cdc.chunks(data)) > 0.95
    assert cdc.containment({}, {}) == 1 and cdc.containment({}, {1: 2}) == 0 and cdc.containment({1: 2}, {}) == 0


def plain(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (k, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = (cdc.chunks(x.encode()) for x in (text, edited, after))
        out[k] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), cdc.fingerprint(a), cdc.fingerprint(b),
                  cdc.containment(a, b), cdc.containment(a, c))
    return out


def values(df):
    return {
        r["doc_id"]: (r["n_chars"], hashlib.sha256(r["edited"].encode()).hexdigest(), *r[3:]) for r in df.collect()
    }


def test_pairs_of_neighbours(make):
    rng = random.Random(6)
    rows = [(k, "".join(rng.choice("abcdé 中\n") for _ in range(rng.choice([0, 1, 5, 300, 2000])))) for k in rng.sample(range(-500, 500), 60)]
    assert values(cdc.compare(make(rows).repartition(7))) == plain(rows)
    assert values(cdc.compare(make(rows[:1]))) == plain(rows[:1])
    assert cdc.compare(make([])).count() == 0


def test_odd_tables(odd):
    got = cdc.compare(odd).collect()
    assert len(got) == odd.count()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in odd.collect())
    again = [r for r in got if r["doc_id"] == 5]
    assert sorted(r["near_next"] for r in again) == [1.0, 1.0]  # its double, and then the equal text of 4
