"""Filters of stored ids name no bucket in vain."""

import numpy as np
import pyarrow as pa

from wattledger.plans import store as P


def table(hashes):
    ids = [f"{h:020d}" for h in hashes.tolist()]
    return pa.table({"id": ids, "h": hashes.view(np.int64), "bucket": ["b"] * len(ids)})


def test_large_batches_name_no_part_in_vain():
    rng = np.random.default_rng(7)
    kept, asked = (rng.integers(0, 2**64, n, np.uint64) for n in (200_000, 8_000_000))
    row = P._filter_of(table(kept)).to_pylist()[0]
    assert row["rows"] == 200_000 and not P._may_hold(row["filter"], row["bits"], asked)
    assert all(P._may_hold(row["filter"], row["bits"], h) for h in (kept[:1], kept[-1:], np.append(asked, kept[77])))


def test_bloom_filters_of_earlier_stores_are_read():
    hashes = np.random.default_rng(1).integers(0, 2**64, 100, np.uint64)
    bits = np.zeros(3200, bool)
    bits[P._probes(hashes, 3200).ravel()] = True
    packed = np.packbits(bits, bitorder="little").tobytes()
    assert P._may_hold(packed, 3200, hashes[:1]) and not P._may_hold(packed, 3200, hashes[:1] + np.uint64(12345))
