"""The term space of the quality model."""

import numpy as np

from sonarframe.llm import quality


def test_few_byte_pairs_share_a_term():
    assert np.bincount(quality._PAIR, minlength=quality.TERMS).max() < 64
