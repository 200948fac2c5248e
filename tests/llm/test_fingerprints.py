"""Texts that have few or no terms in the band."""

from tidemark.llm.fingerprints import NONE, imatch


def test_copies_and_rare_texts_have_fingerprints(spark):
    prose = lambda i: " ".join(f"w{(i * 7 + j) % 400}" for j in range(60))
    rows = [(i, "the very same text in every third row") for i in range(100)] + [(100 + i, prose(i)) for i in range(200)]
    rows += [(300, "unus duo tres quattuor"), (301, "yksi kaksi kolme"), (302, "einzig"), (303, None), (304, " ")]
    got = {r.doc_id: r for r in imatch(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    blank = NONE * 24
    assert {k for k, r in got.items() if r.fingerprint == blank} == {303, 304}
    assert len({got[i].fingerprint for i in range(100)}) == 1 and got[0].near_next == 1
    assert got[300].near_next < 1 and got[301].near_next < 1 and got[302].near_next == 0 and got[303].near_next == 1
