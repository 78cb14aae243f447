"""Pages by cursor, chained, are the sorted table."""

import random

import pytest

from fleetlens.operators.cursor import cursor_page, next_cursor

SCHEMA = "a INT, b STRING, c DOUBLE"


def table(seed, n=150):
    rnd = random.Random(seed)
    rows = [(rnd.choice([None, 1, 2, 3]), rnd.choice([None, "x", "y", "z"]), rnd.choice([None, 0.5, 1.5, -2.0])) for _ in range(n)]
    return rows + [(2, "x", 0.5)] * 40 + [(None, None, None)] * 30


def key(row, orders):
    out = []
    for name, direction in orders:
        v = row["abc".index(name)]
        rank = (0, 0) if v is None else (1, v if not isinstance(v, str) else ord(v))
        out.append(rank if direction == "asc" else (-rank[0], -rank[1]))
    return out


@pytest.mark.parametrize("orders", [[("a", "asc")], [("b", "desc"), ("a", "asc")], [("c", "desc")], [("a", "desc"), ("c", "asc"), ("b", "desc")], []])
def test_chained_pages_are_the_sorted_table(rows, orders):
    data = table(3)
    df, cursor, got = rows(SCHEMA, *data), None, []
    while True:
        page = cursor_page(df, orders, 23, cursor)
        part = [tuple(r) for r in page.collect()]
        if not part:
            break
        assert len(part) == 23 or len(got) + len(part) == len(data)
        got += part
        cursor = next_cursor(page, orders, cursor)
    assert sorted(map(str, got)) == sorted(map(str, data))
    assert [key(r, orders) for r in got] == sorted(key(r, orders) for r in data)


@pytest.mark.parametrize("orders", [[("a", "asc")], [("c", "desc"), ("b", "asc")], []])
@pytest.mark.parametrize("size", [20, 115, 500])
def test_long_pages_are_the_short_ones(rows, orders, size):
    # pages that end in the middle of equal rows, at their end, and within one group of them
    df = rows(SCHEMA, *table(3), *[(None, None, float("nan"))] * 9, (1, "x", float("nan")))
    short, at, n = None, None, 0
    while n == 0 or at:
        short = cursor_page(df, orders, size, at)
        long = cursor_page(df, orders, size, at, top_n=0)
        page = [str(tuple(r)) for r in long.collect()]
        assert page == [str(tuple(r)) for r in short.collect()]
        n += len(page)
        before, at = at, next_cursor(short, orders, at)
        assert repr(at) == repr(next_cursor(long, orders, before))
        assert at is None or len(page) == size or n == 230
    assert n == 230


def test_no_task_and_no_driver_holds_a_long_page(spark, monkeypatch):
    df = spark.range(40_000).selectExpr("id % 5 AS g", "id % 20000 AS id")
    collected, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda df: collected.append(out := collect(df)) or out)
    page = cursor_page(df, [("g", "asc")], 15_000)
    cursor = next_cursor(page, [("g", "asc")])
    assert (cursor.values, cursor.seen, page.count()) == ((1,), 2, 15_000)
    again = cursor_page(df, [("g", "asc")], 15_000, cursor)
    assert next_cursor(again, [("g", "asc")], cursor).values == (3,)
    assert max(map(len, collected)) < 100
    for x in (page, again):
        assert "TakeOrderedAndProject" not in x._jdf.queryExecution().executedPlan().toString()


def test_the_bound_reaches_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 AS g").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    page = cursor_page(df, [("id", "asc")], 10)
    cursor = next_cursor(page, [("id", "asc")])
    again = cursor_page(df, [("id", "asc")], 10, cursor)
    assert [r.id for r in again.collect()] == list(range(10, 20))
    plan = again._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters")[1].splitlines()[0]
    assert "(id,9)" in pushed and "TakeOrderedAndProject" in plan


def test_rows_that_come_meanwhile_move_no_page(rows):
    data = [(i, "x", 0.0) for i in range(10)]
    page = cursor_page(rows(SCHEMA, *data), [("a", "asc")], 4)
    cursor = next_cursor(page, [("a", "asc")])
    later = rows(SCHEMA, *data, (0, "new", 0.0), (1, "new", 0.0))
    assert [r.a for r in cursor_page(later, [("a", "asc")], 4, cursor).collect()] == [4, 5, 6, 7]


def test_empty(rows):
    page = cursor_page(rows(SCHEMA), [("a", "asc")], 4)
    assert page.collect() == [] and next_cursor(page, [("a", "asc")]) is None
    with pytest.raises(ValueError):
        cursor_page(rows(SCHEMA), [], 0)
