import numpy as np
import pytest

from riskframe.models import bayes


@pytest.mark.parametrize("draws", [1, 2, 7, 500])
def test_interval_equals_percentiles(draws):
    """Bit by bit, for equal draws and rows with NaN too."""
    p = np.random.default_rng(draws).random((300, draws)).astype(np.float32)
    p[0] = p[0, 0]
    p[1, -1] = np.nan
    want = np.percentile(p, [100 * t for t in bayes.TAILS], axis=1)
    for got, expected in zip(bayes.interval(p), want):
        assert got.dtype == np.float64
        np.testing.assert_array_equal(got, expected)
