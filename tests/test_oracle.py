"""Every query that SQL can express agrees with that SQL."""

from __future__ import annotations

import pytest
from helpers import SF, plain

import __spark_entry__ as entry

NAMES = list(entry.PLANS)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    query, sql = entry.PLANS[name]
    got = query(spark, SF)
    want = duck.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    rows = [[r[c] for c in order] for r in got.collect()]
    index = [names.index(c) for c in order]
    assert plain(rows) == plain([[r[i] for i in index] for r in want.fetchall()])


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
