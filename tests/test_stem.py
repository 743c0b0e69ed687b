import pytest

from granary.functions.stem import stem
from granary.operators import retrieval

# Words and their published stems.
PAIRS = {
    "consigned": "consign", "consignment": "consign", "consistency": "consist", "generously": "generous", "generic": "generic", "communication": "communic", "skies": "sky", "happy": "happi", "say": "say", "by": "by",
    "hopping": "hop", "hoping": "hope", "national": "nation", "relational": "relat", "conditional": "condit", "bed": "bed", "sing": "sing", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "kiwis": "kiwi",
    "gaps": "gap", "agreed": "agre", "luxuriating": "luxuri", "falling": "fall", "succeeding": "succeed", "knightly": "knight", "controlling": "control", "youth": "youth", "boyish": "boyish", "argued": "argu",
}


@pytest.mark.parametrize("word", PAIRS)
def test_published_stems(word):
    assert stem(word) == PAIRS[word]


def test_search_meets_other_forms(spark):
    docs = spark.createDataFrame([(1, "The customers were happily advised"), (2, "A market"), (3, None)], "d int, text string")
    asked = spark.createDataFrame([("q", "customer advising"), ("none", "the of")], "q string, text string")
    index = retrieval.stemmed_postings(retrieval.postings(docs, "d", "text"), "d")
    assert {r.term for r in index.filter("d = 1").collect()} == {"custom", "happili", "advis"}
    got = retrieval.stemmed_search(asked, "q", "text", index, "d").collect()
    assert [(r.q, r.d, r.rank, round(r.score, 6)) for r in got] == [("q", 1, 1, 0.2)]
