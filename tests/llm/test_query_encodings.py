"""The rows of the SentencePiece query hold the encodings themselves."""

import hashlib

import numpy as np

from lodemark.llm import queries, spm


def test_query_returns_the_ids(spark, tmp_path):
    texts = {1: "a small text about reputations", 2: "", 3: None, 4: "naïve café 測試 \U0001f600", 5: "x" * 3000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    model = spm.lattice(spm.MODEL, 0.3)
    rows = queries.QUERIES["op9_sentencepiece"](spark, f"file://{tmp_path}").collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        assert len(r["ids"]) == r["n_pieces"] and hashlib.sha256(np.array(r["ids"], "<i4").tobytes()).hexdigest() == r["ids_sha256"]
        assert model.sp.decode(r["ids"]) == (texts[r["doc_id"]] or "") and r["decoded"]
    both = {d: {tuple(r["ids"]) for r in rows if r["doc_id"] == d} for d in texts}
    assert len(both[1]) == len(both[4]) == len(both[5]) == 2 and both[2] == both[3] == {()}
