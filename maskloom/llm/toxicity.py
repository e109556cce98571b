"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's inputs are a learned vector of the word, learned vectors of its first 3, first 5 and last
3 characters, and the log-odds of the word and of its most telling character group in the
training sample. Windows of 32 words, each overlapping the next by half, run through a gated
recurrent layer in both directions; attention pools the states to one logit. A document's score
is that of its highest window, above or below the cut that errs least on the sample.

The network is fitted on the driver to a bounded sample: windows of at most ``TOXIC_SAMPLE`` toxic
and ``CLEAN_SAMPLE`` other documents. Scoring reads every window of every text, on the executors.
Only the text is an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import TERM, Roller, lowered, mix64, runs, stored, text_bytes

TOXIC_SAMPLE, CLEAN_SAMPLE = 1500, 4500
WINDOW, STRIDE = 32, 16
HIDDEN, ATTENTION = 8, 8
WORD_SLOTS, WORD_DIM = 1 << 14, 6
PART_SLOTS, PART_DIM = 1 << 13, 8
# Slots of the log-odds of words and of character groups.
ODDS_BITS = 18
# Documents that the base rate stands for in a slot's log-odds.
PRIOR = 8.0
LEAST_DOCUMENTS = 3
EPOCHS, BATCH, RATE = 8, 128, 0.01
# Learned vectors decay, so that words of a few documents stay near zero.
DECAY = 0.5
WARM, UNLIKELY = 4, 0.3
TOXIC_WINDOWS, CLEAN_WINDOWS = 2, 4
_GRAM = 4
_PREFIXES = (3, 4, 5, 6)
_SALT = np.uint64(0x9E3779B97F4A7C15)


def is_held_out(doc_id: Column) -> Column:
    """One document in five, by the checksum of its id; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


# --- words and their inputs -------------------------------------------------------------------


class Words:
    """The distinct words of some texts, and which of them stand where."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        data = lowered(data)
        starts, ends, _ = runs(TERM[data], offsets)
        self.bounds = np.searchsorted(starts, offsets)
        roller = Roller(data)
        hashes = roller.hashes(starts, ends)
        self.hashes, first, self.at = np.unique(hashes, return_index=True, return_inverse=True)
        a, b = starts[first], ends[first]
        with np.errstate(over="ignore"):
            def part(low, high, salt):
                return mix64(roller.hashes(low, high) + _SALT * np.uint64(salt))

            self.parts = [
                part(a, np.minimum(a + 3, b), 1), part(a, np.minimum(a + 5, b), 2), part(np.maximum(b - 3, a), b, 3),
            ]
            # Character groups: beginnings of several lengths, then every group of four.
            heads = [part(a, np.minimum(a + n, b), 10 + n) for n in _PREFIXES]
            many = np.maximum(b - a - _GRAM + 1, 0)
            inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            low = np.repeat(a, many) + inner
            grams = part(low, low + _GRAM, 4)
        n = len(a)
        self.group_owner = np.concatenate([np.tile(np.arange(n), len(heads)), np.repeat(np.arange(n), many)])
        self.groups = np.concatenate([*heads, grams]) if n else np.empty(0, np.uint64)


def _slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def log_odds(toxic: np.ndarray, clean: np.ndarray, base: float) -> np.ndarray:
    """Log-odds of toxic among documents with a slot, less those of all documents.

    Shrunk as if ``PRIOR`` more documents had the base rate; 0 where too few documents are known.
    """
    share = (toxic + PRIOR * base) / (toxic + clean + PRIOR)
    value = np.log(share / (1 - share)) - np.log(base / (1 - base))
    return np.where(toxic + clean >= LEAST_DOCUMENTS, np.clip(value, -4, 8), 0).astype(np.float32)


def word_inputs(words: Words, odds) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds of word and best group, slots of word and three parts) per distinct word.

    ``odds`` gives the log-odds of slots of words (kind 0) or of character groups (kind 1).
    """
    known = odds(0, _slot(words.hashes, ODDS_BITS)).astype(np.float32)
    best = np.full(len(words.hashes), -9.0, np.float32)
    np.maximum.at(best, words.group_owner, odds(1, _slot(words.groups, ODDS_BITS)).astype(np.float32))
    slots = np.stack(
        [_slot(words.hashes, 14)] + [_slot(p, 13) for p in words.parts], 1
    ).astype(np.int32)
    return np.stack([known, best], 1), slots


def windows_of(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, document) of all windows; documents without words have none."""
    n = np.diff(bounds)
    count = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = bounds[:-1][doc] + number * STRIDE
    return first, np.minimum(WINDOW, bounds[1:][doc] - first), doc


def _places(first: np.ndarray, size: np.ndarray, at: np.ndarray, padding: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct word per window and step, mask); padding has a word of its own."""
    step = np.arange(WINDOW)
    mask = step < size[:, None]
    places = np.where(mask, first[:, None] + step, 0)
    return np.where(mask, at[places], padding), mask


# --- the network ------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_network(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    inputs = 2 + WORD_DIM + PART_DIM
    def draw(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)
    net = {"word": draw(WORD_SLOTS, WORD_DIM, scale=0.05), "part": draw(PART_SLOTS, PART_DIM, scale=0.05)}
    for d in ("f", "b"):
        net[f"wx_{d}"] = draw(inputs, 3 * HIDDEN, scale=inputs**-0.5)
        net[f"wh_{d}"] = draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
        net[f"bx_{d}"] = np.zeros(3 * HIDDEN, np.float32)
        net[f"bn_{d}"] = np.zeros(HIDDEN, np.float32)
    net |= {
        "wa": draw(2 * HIDDEN, ATTENTION, scale=0.3), "va": draw(ATTENTION, scale=0.3),
        "wo": draw(2 * HIDDEN, scale=0.3), "bo": np.zeros(1, np.float32),
    }
    return net


def embed(net: dict, odds: np.ndarray, slots: np.ndarray) -> np.ndarray:
    parts = net["part"]
    chars = parts[slots[:, 1]] + parts[slots[:, 2]] + parts[slots[:, 3]]
    return np.concatenate([odds * 0.5, net["word"][slots[:, 0]], chars], 1)


def _scan(net: dict, d: str, gates, mask: np.ndarray, keep: list | None) -> np.ndarray:
    """States of one direction. ``gates(t)`` gives a step's input part, shape (windows, 3 H)."""
    n, h = len(mask), HIDDEN
    state = np.zeros((n, h), np.float32)
    out = np.empty((WINDOW, n, h), np.float32)
    wh, bn = net[f"wh_{d}"], net[f"bn_{d}"]
    for t in range(WINDOW) if d == "f" else reversed(range(WINDOW)):
        g, u = gates(t), state @ wh
        rz = _sigmoid(g[:, : 2 * h] + u[:, : 2 * h])
        r, z = rz[:, :h], rz[:, h:]
        un = u[:, 2 * h:] + bn
        new = np.tanh(g[:, 2 * h:] + r * un)
        m = mask[:, t: t + 1]
        if keep is not None:
            keep.append((t, state, r, z, new, un, m))
        state = np.where(m, new + z * (state - new), state)
        out[t] = state
    return out


def _pool(net: dict, states: np.ndarray, mask: np.ndarray):
    """(attention features, weights, pooled states, logits) of states (steps, windows, 2 H)."""
    seen = np.tanh(states @ net["wa"])
    score = np.where(mask.T, seen @ net["va"], -1e9)
    weight = np.exp(score - score.max(0)) * mask.T
    weight /= np.maximum(weight.sum(0), 1e-9)
    pooled = (states * weight[:, :, None]).sum(0)
    return seen, weight, pooled, pooled @ net["wo"] + net["bo"][0]


def gradients(net: dict, odds: np.ndarray, slots: np.ndarray, mask: np.ndarray, labels: np.ndarray, weights: np.ndarray):
    """(loss, gradients) of windows; odds (windows, steps, 2), slots (windows, steps, 4)."""
    n = len(mask)
    x = embed(net, odds.reshape(-1, 2), slots.reshape(-1, 4)).reshape(n, WINDOW, -1)
    kept: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate(
        [_scan(net, d, lambda t, d=d: x[:, t] @ net[f"wx_{d}"] + net[f"bx_{d}"], mask, kept[d]) for d in ("f", "b")], 2
    )
    seen, weight, pooled, logit = _pool(net, states, mask)
    p = _sigmoid(logit)
    loss = -(weights * (labels * np.log(p + 1e-7) + (1 - labels) * np.log(1 - p + 1e-7))).sum() / weights.sum()
    grad = {k: np.zeros_like(v) for k, v in net.items()}
    dlogit = (weights * (p - labels) / weights.sum()).astype(np.float32)
    grad["bo"][0] = dlogit.sum()
    grad["wo"] = pooled.T @ dlogit
    dpooled = dlogit[:, None] * net["wo"]
    dweight = (states * dpooled).sum(2)
    dstates = weight[:, :, None] * dpooled
    dscore = weight * (dweight - (weight * dweight).sum(0))
    grad["va"] = np.einsum("tna,tn->a", seen, dscore)
    dseen = dscore[:, :, None] * net["va"] * (1 - seen**2)
    grad["wa"] = np.einsum("tnh,tna->ha", states, dseen)
    dstates = dstates + dseen @ net["wa"].T
    h = HIDDEN
    dx = np.zeros_like(x)
    for k, d in enumerate(("f", "b")):
        wx, wh = net[f"wx_{d}"], net[f"wh_{d}"]
        after = np.zeros((n, h), np.float32)
        for t, before, r, z, new, un, m in reversed(kept[d]):
            dh = dstates[t, :, k * h: (k + 1) * h] + after
            live = np.where(m, dh, 0)
            dnew = live * (1 - z) * (1 - new**2)
            dz = live * (before - new) * z * (1 - z)
            dr = dnew * un * r * (1 - r)
            dg = np.concatenate([dr, dz, dnew], 1)
            du = np.concatenate([dr, dz, dnew * r], 1)
            after = live * z + np.where(m, 0, dh) + du @ wh.T
            grad[f"wh_{d}"] += before.T @ du
            grad[f"bn_{d}"] += du[:, 2 * h:].sum(0)
            grad[f"wx_{d}"] += x[:, t].T @ dg
            grad[f"bx_{d}"] += dg.sum(0)
            dx[:, t] += dg @ wx.T
    flat, s = dx.reshape(n * WINDOW, -1), slots.reshape(-1, 4)
    real = mask.reshape(-1)
    np.add.at(grad["word"], s[real, 0], flat[real, 2: 2 + WORD_DIM])
    for c in (1, 2, 3):
        np.add.at(grad["part"], s[real, c], flat[real, 2 + WORD_DIM:])
    return float(loss), grad


def fit(odds, slots, mask, labels, epochs: int = EPOCHS, seed: int = 7) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(network, windows it was fitted to); Adam, both classes with the same total weight.

    Labels are noisy. In the first ``WARM`` epochs the vectors of words and characters stay fixed,
    so that the network cannot learn single windows by heart. Toxic windows that it then finds
    very unlikely are taken for mislabelled and left out of the rest.
    """
    net = new_network(seed)
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    rng = np.random.default_rng(seed)
    share = min(max(float(labels.mean()), 1e-3), 1 - 1e-3)
    weights = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    use = np.arange(len(labels))
    step = 0
    for epoch in range(epochs):
        if epoch == WARM:
            p = _sigmoid(training_logits(net, odds, slots, mask))
            sure = (labels == 0) | (p >= UNLIKELY)
            use = np.flatnonzero(sure) if (labels[sure] > 0).any() else use
        order = use[rng.permutation(len(use))]
        for low in range(0, len(order), BATCH):
            pick = order[low: low + BATCH]
            _, grad = gradients(net, odds[pick], slots[pick], mask[pick], labels[pick], weights[pick])
            step += 1
            for k in net:
                if k in ("word", "part") and epoch < WARM:
                    continue
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                if k in ("word", "part"):
                    move = move + DECAY * net[k]
                net[k] = net[k] - RATE * move
    return {k: v.astype(np.float32) for k, v in net.items()}, use


def training_logits(net: dict, odds, slots, mask, most: int = 4096) -> np.ndarray:
    """Logits of windows given by their inputs."""
    out = np.empty(len(mask), np.float32)
    for low in range(0, len(mask), most):
        part = slice(low, low + most)
        x = embed(net, odds[part].reshape(-1, 2), slots[part].reshape(-1, 4))
        out[part] = window_logits(net, x, np.arange(len(x)).reshape(-1, WINDOW), mask[part])
    return out


def window_logits(net: dict, inputs: np.ndarray, places: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Logits of windows over distinct words with ``inputs``; the last word is the padding."""
    states = []
    for d in ("f", "b"):
        table = inputs @ net[f"wx_{d}"] + net[f"bx_{d}"]
        states.append(_scan(net, d, lambda t, table=table: table[places[:, t]], mask, None))
    return _pool(net, np.concatenate(states, 2), mask)[3]


def document_logits(model: dict, column: pa.Array, most: int = 4096) -> np.ndarray:
    """The highest window logit of each text; texts without words get the model's bias."""
    table = model["odds"]
    out = highest_logits(model["net"], Words(column), len(column), lambda kind, slot: table[kind][slot], most)
    out[np.isneginf(out)] = model["empty"]
    return out


def highest_logits(net: dict, words: Words, n: int, odds_of, most: int = 4096) -> np.ndarray:
    """The highest logit over all windows of each of ``n`` texts, -inf without words."""
    odds, slots = word_inputs(words, odds_of)
    inputs = embed(net, odds, slots)
    inputs = np.concatenate([inputs, np.zeros((1, inputs.shape[1]), np.float32)])
    first, size, doc = windows_of(words.bounds)
    out = np.full(n, -np.inf, np.float32)
    for low in range(0, len(first), most):
        part = slice(low, low + most)
        places, mask = _places(first[part], size[part], words.at, len(inputs) - 1)
        np.maximum.at(out, doc[part], window_logits(net, inputs, places, mask))
    return out


# --- fitting on a bounded sample, scoring everything -------------------------------------------


def _slices(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    _, offsets = text_bytes(column)
    low = 0
    while low < len(column):
        high = min(len(column), max(low + 1, int(np.searchsorted(offsets, offsets[low] + most))))
        yield low, high
        low = high


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic and other documents per slot, combined within the task."""
    totals = np.zeros((2, 1 << ODDS_BITS, 2), np.int64)
    for batch in batches:
        labels = batch.column(1).to_numpy()
        for low, high in _slices(batch.column(0)):
            for k in range(low, high):
                words = Words(batch.column(0).slice(k, 1))
                for kind, hashes in enumerate((words.hashes, words.groups)):
                    totals[kind, np.unique(_slot(hashes, ODDS_BITS)), int(labels[k])] += 1
    kind, slot = np.nonzero(totals.sum(2))
    yield pa.RecordBatch.from_arrays(
        [pa.array(kind), pa.array(slot), pa.array(totals[kind, slot, 1]), pa.array(totals[kind, slot, 0])],
        names=["kind", "slot", "toxic", "clean"],
    )


def _training_windows(toxic: np.ndarray, clean: np.ndarray, base: float):
    """The windows of each sampled document with the strongest log-odds, as flat arrays.

    A document's own part in the counts is taken off first, or its rarest words would give its
    label away.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for k in range(batch.num_rows):
                words = Words(batch.column(0).slice(k, 1))
                if not len(words.at):
                    continue
                own = int(labels[k])
                values, slots = word_inputs(words, lambda kind, slot: log_odds(
                    np.maximum(toxic[kind][slot] - own, 0), np.maximum(clean[kind][slot] - (1 - own), 0), base
                ))
                strength = np.maximum(values.max(1), 0)[words.at]
                first, size, _ = windows_of(words.bounds)
                total = np.append(0, np.cumsum(strength))
                sums = total[first + size] - total[first]
                pick = np.argsort(-sums, kind="stable")[: TOXIC_WINDOWS if labels[k] else CLEAN_WINDOWS]
                if not labels[k]:  # and as many spread over the text
                    spread = np.linspace(0, len(first) - 1, CLEAN_WINDOWS).astype(np.int64)
                    pick = np.append(pick, np.setdiff1d(spread, pick))
                places, mask = _places(first[pick], size[pick], words.at, 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).slice(k, 1), pa.array([labels[k]], pa.int32()),
                     pa.array([values[places].astype(np.float32).tobytes()]),
                     pa.array([slots[places].astype(np.int32).tobytes()]), pa.array([mask.tobytes()])],
                    names=["doc_id", "toxic", "odds", "slots", "mask"],
                )

    return run


def _sample_logits(net: dict, toxic: np.ndarray, clean: np.ndarray, base: float):
    """The highest logit over all windows of each sampled document, its own part in the counts taken off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, label in enumerate(batch.column(1).to_pylist()):
                own = int(label)
                out.append(highest_logits(net, Words(batch.column(0).slice(k, 1)), 1, lambda kind, slot: log_odds(
                    np.maximum(toxic[kind][slot] - own, 0), np.maximum(clean[kind][slot] - (1 - own), 0), base
                ))[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(1), pa.array(out, pa.float32())], names=["doc_id", "toxic", "logit"]
            )

    return run


def best_cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the fewest errors; of several, the middle of the widest gap."""
    order = np.argsort(logits, kind="stable")
    value, toxic = logits[order].astype(np.float64), labels[order]
    below = np.append(0, np.cumsum(toxic))
    above = np.append(0, np.cumsum(1 - toxic))
    errors = below + (above[-1] - above)
    low = np.append(value[0] - 2, value)
    high = np.append(value, value[-1] + 2)
    gap = np.where(errors == errors.min(), high - low, -1)
    at = int(gap.argmax())
    return float((low[at] + high[at]) / 2)


def training_sample(docs: DataFrame, labels: DataFrame, toxic: int, clean: int) -> DataFrame:
    """(text, toxic, doc_id) of at most so many labelled documents outside the held-out fifth, a row per id."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    order = F.xxhash64("doc_id")
    picked = (
        known.where("toxic = 1").orderBy(order, "doc_id").limit(toxic)
        .union(known.where("toxic = 0").orderBy(order, "doc_id").limit(clean))
    )
    # At most toxic + clean rows of two numbers.
    picked = picked.select(F.col("doc_id").alias("_picked"), F.col("toxic").alias("_toxic"))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_picked"))
    # Of the rows of one id, that with the smallest hash.
    one = rows.groupBy("_picked", "_toxic").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one"))
    return one.select("one.text", F.col("_toxic").alias("toxic"), F.col("_picked").cast("bigint").alias("doc_id"))


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_SAMPLE, clean: int = CLEAN_SAMPLE) -> dict:
    """A model fitted to a bounded sample of the labelled documents.

    Without labelled documents of both kinds every score is the share of toxic ones (0.5 at most
    if there are none).
    """
    sample = stored(training_sample(docs, labels, toxic, clean))
    counts = sample.mapInArrow(_count, "kind bigint, slot bigint, toxic bigint, clean bigint")
    counts = counts.groupBy("kind", "slot").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # At most 2 ** (ODDS_BITS + 1) rows of small numbers.
    table = counts.where(F.col("toxic") + F.col("clean") >= LEAST_DOCUMENTS).toPandas()
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n = sum(sizes.values())
    base = (sizes.get(1, 0) + 0.5) / (n + 1)
    seen = np.zeros((2, 2, 1 << ODDS_BITS), np.float32)
    for k, name in enumerate(("toxic", "clean")):
        seen[k, table["kind"], table["slot"]] = table[name]
    odds = log_odds(*seen, base).astype(np.float16)
    windows = sample.mapInArrow(
        _training_windows(*seen, base), "doc_id bigint, toxic int, odds binary, slots binary, mask binary"
    )
    # In the order of ids: the order of training must not hang on partitions.
    found = sorted(windows.collect(), key=lambda r: r["doc_id"])
    model = {"odds": odds, "net": new_network(), "scale": 0.0, "shift": float(np.log(base / (1 - base))), "empty": 0.0}
    if len({r["toxic"] for r in found}) < 2:
        return model
    values = np.concatenate([np.frombuffer(r["odds"], np.float32).reshape(-1, WINDOW, 2) for r in found])
    slots = np.concatenate([np.frombuffer(r["slots"], np.int32).reshape(-1, WINDOW, 4) for r in found])
    mask = np.concatenate([np.frombuffer(r["mask"], bool).reshape(-1, WINDOW) for r in found])
    per = np.array([len(r["mask"]) // WINDOW for r in found])
    label = np.array([r["toxic"] for r in found])
    owner = np.repeat(np.arange(len(found)), per)
    first = np.ones(len(owner), bool)
    first[1:] = owner[1:] != owner[:-1]
    # Only the strongest window of a toxic document is sure to be meant by its label.
    use = (label[owner] == 0) | first
    picked = np.flatnonzero(use)
    net, _ = fit(values[picked], slots[picked], mask[picked], label[owner][picked].astype(np.float32))
    model["net"] = net
    # Calibration: the cut between the highest logits of whole texts, of all sampled documents.
    rated = sample.mapInArrow(_sample_logits(net, *seen, base), "doc_id bigint, toxic int, logit float").collect()
    rated = sorted((r["doc_id"], r["toxic"], r["logit"]) for r in rated if np.isfinite(r["logit"]))
    label, logits = np.array([r[1] for r in rated]), np.array([r[2] for r in rated])
    cut = best_cut(logits, label)
    model |= {"scale": 1.0, "shift": -cut, "empty": float(np.median(logits[label == 0]))}
    return model


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of (doc_id, text).

    Null and empty texts and texts without words have the score of an ordinary clean one. Null
    ids and repeated rows are documents of their own. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for low, high in _slices(batch.column(2)):
                part = batch.slice(low, high - low)
                x = document_logits(own, part.column(2)).astype(np.float64) * own["scale"] + own["shift"]
                p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model does not call toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for low, high in _slices(batch.column(at)):
                part = batch.slice(low, high - low)
                x = document_logits(own, part.column(at)).astype(np.float64) * own["scale"] + own["shift"]
                yield part.filter(pa.array(x < 0))

    return docs.mapInArrow(run, docs.schema)
