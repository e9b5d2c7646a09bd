"""How much text a worker encodes at once changes no piece, and the pipeline's stage encodes less at once than the query."""

from docsluice.llm import packing


def test_slices_change_no_piece(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} and {i * i}, " * (i % 7 * 40)) for i in range(60)], "doc_id bigint, text string").coalesce(1)
    rows = lambda most: sorted(tuple(r) for r in packing.pieces(docs, capacity=64, most=most).drop("uid").collect())
    assert rows(1) == rows(5000) == rows(packing.SLICE)
    seen, gathered = [], packing.document_sequences
    monkeypatch.setattr(packing, "document_sequences", lambda d, most: seen.append(most) or gathered(d, most=most))
    packing.stage(spark, docs, "")
    assert seen == [packing.STAGE_SLICE] and packing.STAGE_SLICE < packing.SLICE
