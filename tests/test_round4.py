"""What the fourth review found: a job that its SQL had made smaller."""

from __future__ import annotations

import pytest
from test_round3 import agrees

from quietgrid.functions import caps

# supplier 0 makes application/x-count with schema s1, 2 video/x-raw; a key may come twice, and anything may be null
SUPPLIERS = [{"s_suppkey": k, "s_nationkey": n} for k, n in [(0, 1), (2, 1), (2, 1), (2, 5), (8, None), (14, 5), (None, 1)]]
# of size 2 and 10 video/x-raw, 6 a wildcard, 4 application/x-event
PARTS = [{"p_partkey": k, "p_size": s} for k, s in [(1, 2), (61, 10), (61, 4), (7, 6), (13, 4), (5, None), (9, None), (None, 2), (None, 6)]]


@pytest.mark.parametrize("block", [1000, 2])
def test_every_pair_of_capabilities_that_fit(spark, tmp_path, monkeypatch, block):
    for name in ("BLOCK", "UP_BLOCK"):
        monkeypatch.setattr(caps, name, block, raising=False)
    got = agrees(spark, tmp_path / "t", "J01_compatible_caps", supplier=SUPPLIERS, part=PARTS)
    assert {up for up, down in got if down == 7} == {0, 2, 8, 14, None}
    assert {k: n for k, n in got.items() if k[0] == 2} == {(2, 1): 3, (2, 61): 5, (2, 7): 3, (2, 5): 1, (2, None): 6}
    assert {k: n for k, n in got.items() if k[0] == 0} == {(0, 1): 1, (0, 61): 2, (0, 7): 1, (0, None): 1}
    assert {k: n for k, n in got.items() if k[0] is None} == {(None, 1): 1, (None, 61): 2, (None, 7): 1, (None, None): 1}


def test_pairs_grow_with_both_tables(spark, tmp_path):
    for n in (1, 3):
        suppliers, parts = [{"s_suppkey": 6 * i, "s_nationkey": 1} for i in range(5 * n)], [{"p_partkey": 60 * i + 2, "p_size": 8} for i in range(7 * n)]
        assert len(agrees(spark, tmp_path / str(n), "J01_compatible_caps", supplier=suppliers, part=parts)) == 35 * n * n
