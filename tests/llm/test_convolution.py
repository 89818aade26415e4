"""The classifier's scores against a convolution written out word by word."""

import math
import random

import numpy as np
import pyarrow as pa

from ridgelens.llm import toxicity
from ridgelens.llm.words import U64, Words


def plain(m, text):
    """Embeddings of the words and of empty places behind them, each filter at each place, the largest answer of each, a weighted sum."""
    data = np.frombuffer(text.encode(), np.uint8)
    w = Words(data, np.array([0, len(data)]), lower=True, bare=True)
    own = [m.words[int(h & U64(toxicity.BUCKETS - 1))] + m.words[toxicity.BUCKETS + int((h >> U64(40)) & U64(toxicity.BUCKETS - 1))] for h in w.hashes]
    places = [*own, *[np.zeros(m.words.shape[1])] * max(toxicity.WIDTHS)]
    total, at = m.out_bias, 0
    for f in m.filters:  # width, embedding, filter
        for k in range(f.shape[2]):
            answers = []
            for t in range(len(own) + 1):
                x = float(m.bias[at])
                for i in range(f.shape[0]):
                    for d in range(f.shape[1]):
                        x += float(places[t + i][d]) * float(f[i, d, k])
                answers.append(max(0.0, x))
            total += max(answers) * float(m.out[at])
            at += 1
    return 1 / (1 + math.exp(-min(30, max(-30, total))))


def test_scores_are_those_of_a_plain_convolution():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["Bad,", "BAD", "é", "x.y"]
    texts = ["", " \n", "one", "Bad"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(36)]
    labels = np.array([int("bad" in t.lower()) for t in texts])
    m = toxicity.fit(pa.array(texts), labels, epochs=2)
    m.bias = m.bias + np.linspace(-0.2, 0.3, len(m.bias)).astype(np.float32)  # some answer even where there is no word
    got = toxicity.scores(m, pa.array(texts))
    assert np.allclose(got, [plain(m, t) for t in texts], atol=1e-4) and got.std() > 0.05
