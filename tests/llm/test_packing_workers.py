"""Packing holds one Python worker for each task."""

from shelfcast.llm import packing, queries


def test_pieces_are_made_and_packed_in_one_operator(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "word " * 5000), (None, "")], "doc_id long, text string")
    plans = []
    stored = packing.materialize
    monkeypatch.setattr(packing, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, name))
    rows = packing.packed_documents(docs, queries.tokenizer(), with_ids=False).collect()
    assert plans[0].count("MapInArrow") == 1
    pieces = {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows}
    assert pieces == {tuple(r) for r in packing.pieces(docs, queries.tokenizer(), with_ids=False).collect()} and len(rows) == len(pieces)
