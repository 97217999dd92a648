"""Replacement counts meet the statistics of products, not the pairs of customer and product."""

from shelfcast.operators import features


def test_pairs_are_not_joined_to_replacements(spark, rows, monkeypatch):
    stats = {
        "customer_product": spark.createDataFrame(
            [(1, "a", 0.5, 2, 3), (1, "b", 0.0, 1, 1), (None, "a", 1.0, 1, 1), (2, None, 1.0, 1, 1)],
            "customer_number long, product_code string, customer_product_shortage_rate double, customer_product_order_count long, n_rows long",
        ),
        "product": spark.createDataFrame([("a", 0.25, 4), ("b", 0.0, 1), (None, 1.0, 1)], "product_code string, product_shortage_rate double, n_rows long"),
        "customer": spark.createDataFrame([(1, 0.5, 4), (2, 1.0, 1), (None, 1.0, 1)], "customer_number long, customer_shortage_rate double, n_rows long"),
        "replacements": spark.createDataFrame([("a", 7), ("c", 9), (None, 5)], "product_code string, replacement_frequency long"),
    }
    met, attach = [], features.attach

    def watched(fact, lookup, keys, **more):
        if lookup.columns == ["product_code", "replacement_frequency"]:
            met.append(fact.columns)
        return attach(fact, lookup, keys, **more)

    monkeypatch.setattr(features, "attach", watched)
    for fits in (True, False):
        pairs = features._pair_table(stats, dict.fromkeys(stats, fits), 1)
        got = rows(pairs, "customer_number", "product_code", "product_shortage_rate", "customer_shortage_rate", "replacement_frequency")
        assert got == [(None, "a", 0.25, None, 7), (1, "a", 0.25, 0.5, 7), (1, "b", 0.0, 0.5, 0), (2, None, None, 1.0, 0)]
    assert len(met) == 2 and all("customer_number" not in columns for columns in met)
