import numpy as np
import pytest

from blockweave.operators import block, factor, gram_tiles
from blockweave.plans import nmf
from tests.conftest import entries_of, factor_of, matrix_of_factor
from tests.test_block import dense_of

RNG = np.random.default_rng(4)


def test_stripes_cover_the_upper_half_in_bounded_parts():
    for rank, tile, held in ((10, 3, 8 * 30), (10, 3, 1), (7, 7, 1 << 20), (1000, 64, 8 * 100_000)):
        found = gram_tiles.stripes(rank, tile, held)
        assert found[0][0] == 0 and found[-1][1] == rank
        assert all(a[1] == b[0] and a[1] % tile == 0 for a, b in zip(found, found[1:], strict=False))
        assert all(8 * (e - s) * (rank - s) <= held or e - s <= tile for s, e in found)


@pytest.mark.parametrize("held", [1, 1 << 20])
def test_gram_and_its_product(spark, monkeypatch, held):
    whole = gram_tiles.stripes
    monkeypatch.setattr(gram_tiles, "stripes", lambda rank, tile: whole(rank, tile, held))
    monkeypatch.setattr(gram_tiles, "GROUP", 4)
    m = RNG.normal(size=(15, 7))
    rows = factor_of(spark, m)
    g = gram_tiles.gram_blocks(rows, 7, 3)
    assert np.allclose(dense_of(g), m.T @ m) and block.validate(g).count() == 0
    assert np.allclose(matrix_of_factor(gram_tiles.apply_gram(rows, g), 15), m @ m.T @ m)


def test_wrong_rank_and_no_rows(spark):
    rows = factor_of(spark, np.ones((3, 2)))
    with pytest.raises(Exception, match="expected factor rows of 3"):
        gram_tiles.gram_blocks(rows, 3, 2).blocks.collect()
    assert dense_of(gram_tiles.gram_blocks(rows.limit(0), 2, 2)).any() == np.False_


def test_a_pass_with_the_gram_matrix_as_a_table(spark, monkeypatch):
    a = RNG.integers(0, 4, size=(9, 6)).astype(float)
    w, h = RNG.random((9, 5)), RNG.random((6, 5))
    options = {"w": factor_of(spark, w), "h": factor_of(spark, h)}
    want = nmf.fit(entries_of(spark, a), 5, 1, **options)
    monkeypatch.setattr(nmf, "BROADCAST_BYTES", 8)
    got = nmf.fit(entries_of(spark, a), 5, 1, **options)
    assert np.allclose(matrix_of_factor(got.w, 9), matrix_of_factor(want.w, 9))
    assert np.allclose(matrix_of_factor(got.h, 6), matrix_of_factor(want.h, 6))
    assert factor.to_entries(got.w).count() == 45
