"""Queries over whole tables that SQL cannot express, by brute force."""

import hashlib

import pyarrow.parquet as pq
import sentencepiece

from corpusmill.plans import catalog

from .test_queries import D

QUERIES = catalog.queries()


def test_pieces_are_the_models(spark):
    import public_tokenizers

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = pq.read_table(f"{D}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want = {i: model.encode(t or "") for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    got = {r["doc_id"]: (r["n_pieces"], r["ids_hash"]) for r in QUERIES["q_sentencepiece"](spark, D).collect()}
    assert got == {i: (len(x), hashlib.sha1(",".join(map(str, x)).encode()).hexdigest()) for i, x in want.items()}


def test_crops_anywhere_in_long_documents(spark):
    n = catalog.LENGTH
    sha = lambda ids: hashlib.sha1(",".join(map(str, ids)).encode()).hexdigest()
    docs = {r["doc_id"]: r["ids"] for r in catalog._tokens(spark, D).collect()}
    got = {r["doc_id"]: r for r in QUERIES["q_pad_labels"](spark, D).collect()}
    assert got.keys() == docs.keys()
    places = []
    for i, ids in docs.items():
        whole = ids + [0] * (n - len(ids))
        at = [k for k in range(len(whole) - n + 1) if sha(whole[k : k + n]) == got[i]["ids_hash"]]
        assert at and got[i]["labels_hash"] == sha(x or -100 for x in whole[at[0] : at[0] + n]) and got[i]["valid"] == min(len(ids), n)
        if len(ids) > n:
            places.append(at[0] / (len(ids) - n))
    assert places and min(places) < 0.25 and max(places) > 0.75
