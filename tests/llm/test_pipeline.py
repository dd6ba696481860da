"""Each stage of the corpus pipeline on odd rows, against what it is made of, and the whole on a small table."""

import corpus_pipeline as cp
import pytest
from ledgerloom.llm import langid, unigram
from ledgerloom.llm.queries import tokenizer
from test_llm import brute_components, families

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, key int, comp string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de"][i % 2], ["a", "b", None][i % 3], 0, 1, "x") for i, t in enumerate(families())]
    rows += [(None, "w1 w2 w3", "en", "a", 0, 1, "x"), (7, rows[7][1], "de", "b", 0, 1, "x"), (9000, "?! 12", "en", "a", 0, 1, "x"), (9001, "日本語 の 文章", None, "a", 0, 1, "x")]
    return spark.createDataFrame(rows, SHAPE).repartition(4)


def test_language_stage(spark, docs):
    kept = cp.identify_language(spark, docs, "")
    assert kept.columns == docs.columns
    model = langid.train(docs.where(~langid.is_held_out()))
    lang, score = model.decide([r.text or "" for r in docs.collect()])
    want = sum(x != "und" and s >= cp.LEAST_LANGUAGE_SCORE for x, s in zip(lang, score, strict=True))
    ids = {r.doc_id for r in kept.collect()}
    assert kept.count() == want and 9000 not in ids and 9001 not in ids and {0, 1, 2} <= ids
    assert cp.identify_language(spark, docs.limit(0), "").count() == 0


def test_join_stage(spark, docs):
    kept = cp.drop_near_duplicates(spark, docs, "")
    rows = [r for r in docs.collect() if r.doc_id is not None]
    rows.sort(key=lambda r: r.doc_id)
    ids = [r.doc_id for r in rows]
    want = {ids[i] for i, (_, c) in brute_components([r.text for r in rows], 5, 80, 100).items() if ids[c] == ids[i]}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} - {None} == want
    assert cp.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_mixing_and_piece_stages(spark, docs):
    kept = cp.mix_sources(spark, docs, "")
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    out = cp.encode_pieces(spark, docs, "").collect()
    p = unigram.Pieces(tokenizer("piece_bpe_32k.model"))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in out:
        assert r.n_pieces == len(r.piece_ids) and b"".join(p.text[i] for i in r.piece_ids).decode() == (" " + text[r.doc_id] if text[r.doc_id] else "")
    assert len(out) == docs.count() and cp.encode_pieces(spark, docs.limit(0), "").count() == 0 and cp.mix_sources(spark, docs.limit(0), "").count() == 0


def test_whole(spark):
    """The run is its stages, one after the other."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
    got = cp.run(spark, sf)
    assert sorted(map(tuple, got.select("doc_id", "n_pieces").collect())) == sorted(map(tuple, docs.select("doc_id", "n_pieces").collect()))
    assert set(got.columns) == {"doc_id", "lang", "source", "piece_ids", "n_pieces"}
