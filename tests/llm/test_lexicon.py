"""The toxicity lexicon holds all words that tell, and not only as many as explain the labelled sample."""

from __future__ import annotations

import random
import zlib

from helispan.llm import toxicity


def test_words_beside_a_frequent_one(spark):
    rng = random.Random(5)
    calm = ["".join(rng.choice("bcdfgaeiou") for _ in range(5)) for _ in range(200)]
    weak = ["murkzz", "vylqq", "sprokk", "jexxt", "wuzzp", "klomph"]
    docs, labels, wanted = [], [], set()
    for i in range(900):
        held, bad = zlib.crc32(str(i).encode()) % 4 == 2, i % 6 == 0
        w = [rng.choice(calm) for _ in range(30)]
        if bad:
            w[:3] = rng.sample(weak, 3) if held else ["rotten", *rng.sample(weak, 2)]
            rng.shuffle(w)
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
        if held and bad:
            wanted.add(i)
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id for r in toxicity.classify(d, y).collect() if r.held_out and r.predicted}
    assert len(wanted) > 20 and got == wanted
