"""Tables of a bundle get as many buckets as their rows ask for, with the same rows."""

from pyspark.sql import functions as F

from shelfcast.operators import stats as st


def test_buckets_grow_with_the_rows(spark, tmp_path, rows):
    products = spark.range(1000).select(F.col("id").cast("string").alias("product_code"), (F.col("id") / 7).alias("product_shortage_rate"))
    plants = spark.createDataFrame([("a", 0.5), (None, 0.25)], "plant string, plant_shortage_rate double")
    st.save_bucketed_stats({"product": products, "plant": plants}, str(tmp_path), "grown", buckets=2, rows_per_bucket=100)
    kept = st.load_bucketed_stats(spark, "grown", ["product", "plant"])
    assert rows(kept["product"]) == rows(products) and rows(kept["plant"]) == rows(plants)
    described = {n: {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED grown_{n}").collect()}["Num Buckets"] for n in kept}
    assert described == {"product": "10", "plant": "2"}
