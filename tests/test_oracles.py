"""Every registered query against its SQL on the smallest test tables."""

import pytest
from oracle import connect, difference

from __spark_entry__ import entry
from chatlens.plans.catalog import QUERIES
from chatlens.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


def test_entry_has_the_known_answer(spark):
    assert entry(spark).collect()[0][0] == 3


def test_known_answers(spark, sf_dir):
    summary = QUERIES["corpus_summary"](spark, sf_dir).first()
    assert (summary.total_rows, summary.conversations) == (977, 20)
    assert (summary.human_messages, summary.system_messages) == (261, 177)
    assert QUERIES["client_return_summary"](spark, sf_dir).first().returning_clients == 2
    assert QUERIES["out_of_vocabulary_counts"](spark, sf_dir).first().resolution == 2
