"""Substitutes against a direct reading of their definition."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from shelfcast.operators.substitutes import substitute_details, substitute_rows, substitutes


def expected(products, replacements, n, distinct):
    """Lists built group by group, categories in order, codes in order."""
    lists = {}
    groups = {}
    for code, category in products:
        groups.setdefault(category, []).append(code)
    for category in sorted(groups, key=lambda c: (c is not None, c or "")):
        members = sorted(groups[category])
        for code in members:
            lists.setdefault(code, []).extend(m for m in members if m != code)
    for code in replacements:
        lists.setdefault(code, [])
    if distinct:
        lists = {k: list(dict.fromkeys(v)) for k, v in lists.items()}
    return {k: v[:n] for k, v in lists.items()}


def run(spark, products, replacements, n, distinct, limit=200_000):
    master = spark.createDataFrame(products, "product_code STRING, category STRING")
    others = spark.createDataFrame([(c,) for c in replacements], "product_code STRING")
    got = substitutes(master, others, n, distinct, max_broadcast_rows=limit)
    return {r["product_code"]: list(r["substitutes"]) for r in got.collect()}


CASES = [
    ([("a", "x"), ("b", "x"), ("c", "x"), ("d", "y")], ["z", "a"]),
    ([("a", None), ("b", None), ("c", "x")], []),
    ([("a", "x"), ("a", "x"), ("b", "x"), ("c", "x"), ("c", "x")], []),
    ([("a", "x"), ("a", "y"), ("b", "x"), ("c", "y"), ("b", "y"), ("d", "y")], ["q"]),
    ([(f"p{i:02}", "big") for i in range(30)], []),
]


@pytest.mark.parametrize("products, replacements", CASES)
@pytest.mark.parametrize("n", [0, 3, 5])
@pytest.mark.parametrize("limit", [0, 200_000])
def test_distinct_substitutes(spark, products, replacements, n, limit):
    assert run(spark, products, replacements, n, True, limit) == expected(products, replacements, n, True)


@pytest.mark.parametrize("products, replacements", [CASES[0], CASES[2]])
@pytest.mark.parametrize("n", [1, 4, 9])
def test_repeated_substitutes(spark, products, replacements, n):
    assert run(spark, products, replacements, n, False) == expected(products, replacements, n, False)


@settings(max_examples=12, deadline=None)
@given(
    hs.lists(hs.tuples(hs.sampled_from("abcdefgh"), hs.sampled_from([None, "x", "y", "z"])), min_size=1, max_size=25),
    hs.integers(1, 4),
)
def test_random_masters(spark, products, n):
    assert run(spark, products, ["zz"], n, True) == expected(products, ["zz"], n, True)


def test_never_itself_and_never_too_many(spark):
    products = [(f"p{i}", f"c{i % 4}") for i in range(50)]
    for code, subs in run(spark, products, [], 3, True).items():
        assert code not in subs and len(subs) == len(set(subs)) == 3


def test_order_column_decides(spark):
    master = spark.createDataFrame(
        [("a", "x", 3), ("b", "x", 1), ("c", "x", 2)], "product_code STRING, category STRING, pos INT"
    )
    got = {r["product_code"]: r["substitutes"] for r in substitutes(master, n=2, position="pos").collect()}
    assert got == {"a": ["b", "c"], "b": ["c", "a"], "c": ["b", "a"]}


@pytest.mark.parametrize("limit", [0, 200_000])
def test_details(spark, rows, limit):
    master = spark.createDataFrame(
        [("a", "x", "v1", "KPL"), ("b", "x", "v2", "LTK"), ("c", "x", "v3", "KPL")],
        "product_code STRING, category STRING, vendorName STRING, salesUnit STRING",
    )
    details = substitute_details(substitute_rows(master, 1), master, max_broadcast_rows=limit)
    assert rows(details, "target_product", "product_code", "vendorName") == [
        ("a", "b", "v2"), ("b", "a", "v1"), ("c", "a", "v1"),
    ]


def test_categories_are_cut_before_the_shuffle(spark):
    master = spark.createDataFrame([("a", "x")], "product_code STRING, category STRING")
    plan = substitute_rows(master, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "CartesianProduct" not in plan
