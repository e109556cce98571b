"""The recurrent network against a plain forward pass, window by window and step by step."""

import math

import numpy as np
import pyarrow as pa

from maskloom.llm import toxicity as t


def plain_gru(net, d, inputs):
    """States of one direction over a window's words, in their order."""
    h = t.HIDDEN
    wx, wh, bx, bn = (net[f"{k}_{d}"].astype(float) for k in ("wx", "wh", "bx", "bn"))
    state, out = np.zeros(h), [None] * len(inputs)
    for k in range(len(inputs)) if d == "f" else reversed(range(len(inputs))):
        g, u = inputs[k] @ wx + bx, state @ wh
        new_state = np.empty(h)
        for j in range(h):
            r = 1 / (1 + math.exp(-(g[j] + u[j])))
            z = 1 / (1 + math.exp(-(g[h + j] + u[h + j])))
            candidate = math.tanh(g[2 * h + j] + r * (u[2 * h + j] + bn[j]))
            new_state[j] = candidate + z * (state[j] - candidate)
        state = new_state
        out[k] = state
    return out


def plain_logit(net, inputs):
    states = [np.concatenate(pair) for pair in zip(plain_gru(net, "f", inputs), plain_gru(net, "b", inputs))]
    scores = [float(np.tanh(s @ net["wa"].astype(float)) @ net["va"].astype(float)) for s in states]
    top = max(scores)
    weights = [math.exp(s - top) for s in scores]
    pooled = sum(w * s for w, s in zip(weights, states)) / sum(weights)
    return float(pooled @ net["wo"].astype(float) + net["bo"][0])


def test_scores_equal_a_plain_forward_pass():
    draw = np.random.default_rng(3)
    odds = draw.standard_normal((2, 1 << t.ODDS_BITS)).astype(np.float16)
    net = {k: (v + 0.05 * draw.standard_normal(v.shape)).astype(np.float32) for k, v in t.new_network(5).items()}
    model = {"odds": odds, "net": net, "empty": -1.5}
    words = [f"wort{k}" for k in range(40)]
    texts = ["one", " ".join(draw.choice(words, t.WINDOW)), " ".join(draw.choice(words, 3 * t.WINDOW + 5)), "", None, " \n", "é ü?"]
    got = t.document_logits(model, pa.array(texts))
    want = []
    for text in texts:
        known = t.Words(pa.array([text]))
        values, slots = t.word_inputs(known, lambda kind, slot: odds[kind][slot])
        sequence = t.embed(net, values, slots).astype(float)[known.at] if len(known.at) else np.zeros((0, 1))
        n = len(sequence)
        starts = [0] if n else []
        while starts and starts[-1] + t.WINDOW < n:
            starts.append(starts[-1] + t.STRIDE)
        logits = [plain_logit(net, sequence[s: s + t.WINDOW]) for s in starts]
        want.append(max(logits, default=-1.5))
    assert np.abs(got - np.array(want)).max() < 1e-3


def test_the_model_does_not_hang_on_partitions(spark):
    from conftest import SMALL

    docs, labels = (spark.read.parquet(f"{SMALL}/{name}.parquet") for name in ("documents", "labels"))
    adaptive, partitions = (spark.conf.get(f"spark.sql.{k}") for k in ("adaptive.enabled", "shuffle.partitions"))
    scores = []
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (2, 7):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            rows = t.score(docs, t.train(docs, labels)).orderBy("doc_id", "score").collect()
            scores.append([(r["doc_id"], r["score"]) for r in rows])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert scores[0] == scores[1]
