"""Registered queries next to their SQL."""

import pytest
from compare import differences, duck

from fairtender.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, sf, name):
    assert differences(spark, duck(sf), name, QUERIES[name], ORACLES[name], sf) == ""


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
