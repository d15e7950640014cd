import math

import numpy as np
from stationweave.operators.spikes import LOG_STEP, wet_cutoff


def histogram(mm):
    return np.unique(np.floor(np.log(mm) / LOG_STEP), return_counts=True)


def cutoff(mm):
    bins, n = histogram(np.asarray(mm))
    return math.exp(wet_cutoff(bins * LOG_STEP, n))


HONEST = [*np.clip(np.random.default_rng(5).exponential(2.2, 6000), 0.1, 26.7), 26.7]
SPIKES = [106.8, 150.0, 240.0, 400.0]


def test_a_gap_is_the_cutoff():
    assert 26.7 < cutoff([*HONEST, *SPIKES]) <= 106.8


def test_a_value_in_the_gap_hides_no_spike():
    for between in (45.0, 55.0, 66.0):
        assert between < cutoff([*HONEST, between, *SPIKES]) <= 106.8


def test_an_honest_record_has_no_spike():
    for seed in range(20):
        mm = np.maximum(np.random.default_rng(seed).exponential(2.2, 3000), 0.1)
        assert cutoff(mm) > mm.max()
