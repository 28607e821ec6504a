"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs.

Every text is scored in overlapping windows of words; its score is that of its worst window. A word enters as a
learned embedding (its own, and the mean of its character trigrams'), and as evidence: log-odds of the word and of its
longer n-grams. The network, its embeddings and tables are fitted with numpy on the driver, on a bounded sample of
labelled rows, and are a few megabytes at most.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import LOWER, documents_of, mix, raw, slices, with_rest, word_bounds, word_hashes

#: Words in a window, and words from one window to the next.
WINDOW, STRIDE = 24, 12
#: The fitting sample: at most so many rows of label 1 and of label 0, with texts of at most so many characters.
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1500, 3000, 20_000
THRESHOLD = 0.7
HIDDEN = 8
GRAMS = (4, 5, 6)
#: Slots of an input table, and the least G statistic of what it takes in.
SLOTS, LEAST_G = 1 << 17, 15.0

_U = np.uint64
_F = np.float32
_PARTS = np.ones(256, bool)
_PARTS[48:58] = _PARTS[97:123] = False
_PARTS[128:] = False
_START = 94  # stands before each word, so that its first characters have n-grams of their own
#: Numbers of a learned embedding; words that have one (the most frequent of those in LEAST_DOCS texts), slots of
#: character embeddings, and characters of each.
EMBED, MAX_WORDS, LEAST_DOCS, CHAR_SLOTS, CHARS = 4, 1 << 15, 5, 1 << 13, 3
INPUTS = len(GRAMS) + 3 + EMBED


@dataclass
class EvidenceTable:
    """Log-odds by 64-bit hash: a slot holds the strongest entry that fell there, and a check of its hash."""

    check: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS, np.uint32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS, _F))

    @classmethod
    def fit(cls, documents: list[np.ndarray], toxic: np.ndarray) -> EvidenceTable:
        """From each document's distinct hashes: log-odds of label 1 where the G statistic is at least LEAST_G."""
        out = cls()
        n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
        both = [np.concatenate([d for d, y in zip(documents, toxic) if y == side] or [np.empty(0, _U)]) for side in (True, False)]
        keys = np.unique(np.concatenate(both))
        if not len(keys):
            return out
        c1, c0 = (np.bincount(np.searchsorted(keys, b), minlength=len(keys)).astype(float) for b in both)
        share = n1 / (n1 + n0)
        total = c1 + c0
        term = lambda seen, expected: np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / expected), 0.0)
        g = 2 * (term(c1, total * share) + term(c0, total * (1 - share)))
        odds = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
        strong = np.flatnonzero(g >= LEAST_G)
        strong = strong[np.argsort(g[strong], kind="stable")]
        slot = (keys[strong] & _U(SLOTS - 1)).astype(np.int64)
        out.check[slot] = (keys[strong] >> _U(32)).astype(np.uint32)
        out.value[slot] = np.clip(odds[strong], -3.0, 6.0) / 3.0
        return out

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes & _U(SLOTS - 1)).astype(np.int64)
        return np.where(self.check[slot] == (hashes >> _U(32)).astype(np.uint32), self.value[slot], _F(0))


def words_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts: words per text, each word's number among the distinct words, those words' hashes, and the
    bytes of the distinct words, each after a start mark, as (bytes, begin of each)."""
    lowered = [(t or b"").translate(LOWER) for t in texts]
    data = np.frombuffer(b" ".join(lowered), np.uint8)
    starts, ends = word_bounds(data, _PARTS)
    edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])
    counts = np.diff(np.searchsorted(starts, edges))
    hashes, first, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    a, size = starts[first], (ends - starts)[first]
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    spread = np.repeat(a - begin[:-1] - 1, size + 1) + np.arange(begin[-1])
    letters = data[np.maximum(spread, 0)] if len(data) else np.empty(0, np.uint8)
    letters[begin[:-1]] = _START
    return counts, which, hashes, (letters, begin)


def gram_hashes(letters: np.ndarray, begin: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n of GRAMS: the hash at each byte, and whether the n bytes from there lie in one word."""
    n = len(letters)
    left = np.repeat(begin[1:], np.diff(begin)) - np.arange(n)
    packed = np.zeros(n, _U)
    out = []
    for i in range(max(GRAMS)):
        packed <<= _U(8)
        packed[: max(0, n - i)] |= letters[i:]
        if i + 1 in GRAMS:
            out.append((mix(packed ^ _U((i + 1) << 56)), left > i))
    return out


@dataclass
class Embeddings:
    """Learned inputs: a row per known word, and one per slot of hashed character trigrams. A word's embedding is its own
    row (none: zeros) plus the mean of its trigrams' rows."""

    vocabulary: np.ndarray = field(default_factory=lambda: np.empty(0, _U))
    words: np.ndarray = field(default_factory=lambda: np.zeros((1, EMBED), _F))
    chars: np.ndarray = field(default_factory=lambda: np.zeros((CHAR_SLOTS, EMBED), _F))

    @classmethod
    def over(cls, documents: list[np.ndarray]) -> Embeddings:
        """Zeros, for the words of a sample."""
        words, seen = np.unique(np.concatenate([np.empty(0, _U), *documents]), return_counts=True)
        known = np.flatnonzero(seen >= LEAST_DOCS)
        known = np.sort(known[np.argsort(-seen[known], kind="stable")[:MAX_WORDS]])
        return cls(words[known], np.zeros((len(known) + 1, EMBED), _F))

    def places(self, hashes: np.ndarray, letters: np.ndarray, begin: np.ndarray) -> Places:
        """Which rows make up each word's embedding."""
        at = np.searchsorted(self.vocabulary, hashes)
        known = np.zeros(len(hashes), bool)
        if len(self.vocabulary):
            known = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == hashes
        n = len(letters)
        code = np.zeros(n, _U)
        for i in range(CHARS):
            code[: max(0, n - i)] = (code[: max(0, n - i)] << _U(8)) | letters[i:]
        fits = np.repeat(begin[1:], np.diff(begin)) - np.arange(n) >= CHARS
        counts = np.add.reduceat(fits, begin[:-1], dtype=np.int64) if len(hashes) else np.empty(0, np.int64)
        return Places(np.where(known, at + 1, 0).astype(np.int32), (mix(code[fits]) % _U(CHAR_SLOTS)).astype(np.uint16), np.concatenate([[0], np.cumsum(counts)]))

    def of(self, where: Places, chunk: int = 1 << 15) -> np.ndarray:
        out = self.words[where.words]
        for a in range(0, len(out), chunk):
            bounds = where.bounds[a : a + chunk + 1]
            counts = np.diff(bounds)
            owner, rows = np.repeat(np.arange(len(counts)), counts), self.chars[where.chars[bounds[0] : bounds[-1]]]
            for k in range(EMBED):
                out[a : a + chunk, k] += np.bincount(owner, rows[:, k], len(counts)) / np.maximum(1, counts)
        return out


@dataclass
class Places:
    """Of each word: its row among the known words (0: none), and a run of slots of its trigrams."""

    words: np.ndarray
    chars: np.ndarray
    bounds: np.ndarray

    def take(self, rows: np.ndarray) -> Places:
        counts = np.diff(self.bounds)[rows]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(self.bounds[:-1][rows] - bounds[:-1], counts) + np.arange(bounds[-1])
        return Places(self.words[rows], self.chars[at], bounds)

    @staticmethod
    def joined(parts: list[Places]) -> Places:
        counts = np.concatenate([np.diff(p.bounds) for p in parts])
        return Places(np.concatenate([p.words for p in parts]), np.concatenate([p.chars for p in parts]), np.concatenate([[0], np.cumsum(counts)]))


def word_inputs(tables: list[EvidenceTable], embeddings: Embeddings, hashes: np.ndarray, letters: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One row per distinct word, after a row of zeros for padding: the word's evidence, the strongest evidence of its
    n-grams for each n, its length, one, and its embedding."""
    out = np.zeros((len(hashes) + 1, INPUTS), _F)
    if not len(hashes):
        return out
    out[1:, 0] = tables[0].lookup(hashes)
    for i, (h, fits) in enumerate(gram_hashes(letters, begin)):
        out[1:, 1 + i] = np.maximum.reduceat(np.where(fits, tables[1 + i].lookup(h), _F(0)), begin[:-1])
    out[1:, len(GRAMS) + 1] = np.minimum(np.diff(begin) - 1, 20) / 20
    out[1:, len(GRAMS) + 2] = 1
    out[1:, -EMBED:] = embeddings.of(embeddings.places(hashes, letters, begin))
    return out


def window_rows(counts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, as rows of word_inputs (0 pads), and the first window of each text. A text with at
    most WINDOW words, or none, has one."""
    windows = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    first = np.concatenate([[0], np.cumsum(windows)])
    text = np.repeat(np.arange(len(counts)), windows)
    ends = np.cumsum(counts)
    at = (ends - counts)[text] + (np.arange(first[-1]) - first[text]) * STRIDE
    place = at[:, None] + np.arange(WINDOW)
    rows = np.zeros(place.shape, np.int32)
    inside = place < ends[text][:, None]
    rows[inside] = which[place[inside]] + 1
    return rows, first


# ---------------------------------------------------------------- the network


def new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-1])).astype(_F)
    out = {}
    for side in "fb":
        out[f"W{side}"], out[f"U{side}"] = scale(3 * HIDDEN, INPUTS), scale(3 * HIDDEN, HIDDEN)
    out["v"], out["w"], out["c"] = np.zeros(2 * HIDDEN, _F), scale(2 * HIDDEN), np.zeros(1, _F)
    return out


def _squash(x: np.ndarray) -> np.ndarray:
    """Softsign, which the cells use in place of the hyperbolic tangent: it costs a quarter of the time."""
    return x / (1 + np.abs(x))


def _gate(x: np.ndarray) -> np.ndarray:
    return _F(0.5) + _F(0.5) * _squash(x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def project(weights: dict[str, np.ndarray], inputs: np.ndarray) -> dict[str, np.ndarray]:
    """What each distinct word adds to gates and new states, once for all of its places."""
    return {side: weights[f"W{side}"] @ inputs.T for side in "fb"}


def forward(weights: dict[str, np.ndarray], projected: dict[str, np.ndarray], rows: np.ndarray, keep: bool = False):
    """The logit of each window. Arrays have the windows last, so that each step is a few long vector operations."""
    n = len(rows)
    steps = np.ascontiguousarray(rows.T)
    hidden = np.empty((WINDOW, 2 * HIDDEN, n), _F)
    kept = {}
    for side, order, part in (("f", range(WINDOW), slice(0, HIDDEN)), ("b", range(WINDOW - 1, -1, -1), slice(HIDDEN, None))):
        h = np.zeros((HIDDEN, n), _F)
        for t in order:
            x = projected[side].take(steps[t], axis=1)
            u = weights[f"U{side}"] @ h
            gates = _gate(x[: 2 * HIDDEN] + u[: 2 * HIDDEN])
            z, r = gates[:HIDDEN], gates[HIDDEN:]
            new = _squash(x[2 * HIDDEN :] + r * u[2 * HIDDEN :])
            if keep:
                kept[side, t] = (h, z, r, new, u[2 * HIDDEN :])
            h = new + z * (h - new)
            hidden[t, part] = h
    scores = np.matmul(weights["v"], hidden)
    scores = np.exp(scores - scores.max(axis=0))
    attention = scores / scores.sum(axis=0)
    pooled = np.einsum("thn,tn->hn", hidden, attention)
    logits = weights["w"] @ pooled + weights["c"]
    return (logits, hidden, attention, pooled, kept) if keep else logits


def gradients(weights: dict[str, np.ndarray], inputs: np.ndarray, rows: np.ndarray, d: np.ndarray, run) -> dict[str, np.ndarray]:
    """Of the sum of d * logits, for all weights and for the inputs' embeddings (backpropagation through time)."""
    _, hidden, attention, pooled, kept = run
    steps = rows.T
    out = {"w": pooled @ d, "c": d.sum(keepdims=True)}
    d_pooled = weights["w"][:, None] * d
    d_attention = (hidden * d_pooled).sum(axis=1)
    d_scores = attention * (d_attention - (attention * d_attention).sum(axis=0))
    out["v"] = np.tensordot(hidden, d_scores, ((0, 2), (0, 1)))
    learned = np.zeros((len(inputs), EMBED), _F)
    d_hidden = attention[:, None, :] * d_pooled + d_scores[:, None, :] * weights["v"][None, :, None]
    for side, order, part in (("f", range(WINDOW - 1, -1, -1), slice(0, HIDDEN)), ("b", range(WINDOW), slice(HIDDEN, None))):
        U = weights[f"U{side}"]
        dW, dU = np.zeros_like(weights[f"W{side}"]), np.zeros_like(U)
        dh = np.zeros((HIDDEN, len(rows)), _F)
        for t in order:
            h, z, r, new, un = kept[side, t]
            dh = dh + d_hidden[t, part]
            d_new = dh * (1 - z) * (1 - np.abs(new)) ** 2
            d_z = dh * (h - new) * _F(0.5) * (1 - np.abs(2 * z - 1)) ** 2
            d_r = d_new * un * _F(0.5) * (1 - np.abs(2 * r - 1)) ** 2
            d_x = np.concatenate([d_z, d_r, d_new])
            d_u = np.concatenate([d_z, d_r, d_new * r])
            dW += d_x @ inputs[steps[t]]
            np.add.at(learned, steps[t], (weights[f"W{side}"][:, -EMBED:].T @ d_x).T)
            dU += d_u @ h.T
            dh = dh * z + U.T @ d_u
        out[f"W{side}"], out[f"U{side}"] = dW, dU
    return {k: g.astype(_F) for k, g in out.items()} | {"inputs": learned}


@dataclass
class Model:
    tables: list[EvidenceTable]
    weights: dict[str, np.ndarray]
    embeddings: Embeddings = field(default_factory=Embeddings)

    def windows(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts, which, hashes, (letters, begin) = words_of(texts)
        return word_inputs(self.tables, self.embeddings, hashes, letters, begin), *window_rows(counts, which)

    def score(self, texts: list[bytes | None], chunk: int = 1024) -> np.ndarray:
        if not texts:
            return np.empty(0)
        inputs, rows, first = self.windows(texts)
        projected = project(self.weights, inputs)
        logits = np.concatenate([forward(self.weights, projected, rows[i : i + chunk]) for i in range(0, len(rows), chunk)])
        return 1.0 / (1.0 + np.exp(-np.maximum.reduceat(logits, first[:-1]).astype(float)))


def _hash_sets(texts: list[bytes], kind: int) -> list[np.ndarray]:
    """Of each text, the distinct hashes for one kind of table: words (0), or n-grams of the kind's length."""
    found = []
    for text in texts:
        _, _, hashes, (letters, begin) = words_of([text])
        if kind:
            h, fits = gram_hashes(letters, begin)[kind - 1]
            hashes = np.unique(h[fits])
        found.append(hashes)
    return found


def _portions(texts: list[bytes], which: np.ndarray, most: int = 1 << 20):
    """Runs of indices whose texts have about `most` bytes together, so that work arrays stay small."""
    run, size = [], 0
    for i in which:
        run.append(i)
        size += len(texts[i])
        if size >= most:
            yield np.array(run)
            run, size = [], 0
    if run:
        yield np.array(run)


def rate(epoch: int, epochs: int) -> float:
    return 0.01 * (1 - 0.9 * epoch / epochs)


def _move(embeddings: Embeddings, squares: dict[str, np.ndarray], where: Places, g: np.ndarray, step: np.float32) -> None:
    """A step down the gradient of some words' embeddings, scaled by past squares, for words and trigrams alike."""
    counts = np.diff(where.bounds)
    share = np.repeat(g / np.maximum(1, counts)[:, None], counts, axis=0)
    for name, rows, grads in (("words", where.words, g), ("chars", where.chars, share)):
        table = getattr(embeddings, name)
        used, at = np.unique(rows, return_inverse=True)
        total = np.stack([np.bincount(at, grads[:, k], len(used)) for k in range(EMBED)], axis=1).astype(_F) + _F(1e-3) * table[used]
        squares[name][used] += total * total
        table[used] -= step * total / np.sqrt(squares[name][used])
    embeddings.words[0] = 0


def fit(texts: list[bytes], toxic: np.ndarray, epochs: int = 16, batch: int = 128, candidates: int = 8, seed: int = 7) -> Model:
    """Fit tables and network. While the network learns, each half of the sample is seen through tables made from the
    other half, so that it meets evidence as strong as it will on new texts. A text's loss is that of its worst window,
    looked for among the `candidates` windows with the most evidence."""
    rng = np.random.default_rng(seed)
    weights = new_weights(rng)
    if texts:  # a window without words is met in fitting, too
        texts, toxic = [*texts, *[b""] * (1 + len(texts) // 100)], np.concatenate([toxic, np.zeros(1 + len(texts) // 100, bool)])
    half = np.arange(len(texts)) % 2 == 0
    tables: tuple[list, list, list] = ([], [], [])
    for kind in range(1 + len(GRAMS)):
        found = _hash_sets(texts, kind)
        if not kind:
            embeddings = Embeddings.over(found)
        for into, part in zip(tables, (half | True, half, ~half)):
            into.append(EvidenceTable.fit([found[i] for i in np.flatnonzero(part)], toxic[part]))
    whole = Model(tables[0], weights, embeddings)
    if not texts or toxic.all() or not toxic.any():
        weights["w"][:] = 0
        weights["c"][:] = -2.0
        return whole
    base, picked, owner = [np.zeros((1, INPUTS), _F)], [], []
    learned = [Places(np.zeros(1, np.int32), np.empty(0, np.uint16), np.zeros(2, np.int64))]
    offset = 0
    for seen, part in ((Model(tables[1], weights), ~half), (Model(tables[2], weights), half)):
        for mine in _portions(texts, np.flatnonzero(part)):
            counts, which, hashes, (letters, begin) = words_of([texts[i] for i in mine])
            inputs, (rows, first) = word_inputs(seen.tables, seen.embeddings, hashes, letters, begin), window_rows(counts, which)
            learned.append(embeddings.places(hashes, letters, begin))
            weight = inputs[:, : 1 + len(GRAMS)].sum(axis=1)[rows].sum(axis=1)
            for k, i in enumerate(mine):
                own = np.arange(first[k], first[k + 1])
                own = own[np.argsort(-weight[own], kind="stable")[:candidates]]
                picked.append(np.where(rows[own] > 0, rows[own] + offset, 0))
                owner += [i] * len(own)
            base.append(inputs[1:])
            offset += len(inputs) - 1
    inputs, rows, owner, places = np.concatenate(base), np.concatenate(picked), np.array(owner), Places.joined(learned)
    order = np.argsort(owner, kind="stable")
    rows, owner = rows[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    docs, target = owner[first], toxic[owner[first]].astype(_F)
    m = {k: np.zeros_like(x) for k, x in weights.items()}
    v = {k: np.zeros_like(x) for k, x in weights.items()}
    squares = {"words": np.full_like(embeddings.words, 1e-6), "chars": np.full_like(embeddings.chars, 1e-6)}
    step = 0
    epochs = max(epochs, -(-500 * batch // len(docs)))
    for epoch in range(epochs):
        if epoch % 2 == 0:
            inputs[1:, -EMBED:] = embeddings.of(places)[1:]
            projected = project(weights, inputs)
            logits = np.concatenate([forward(weights, projected, rows[i : i + 4096]) for i in range(0, len(rows), 4096)])
            worst = np.array([a + int(np.argmax(logits[a:b])) for a, b in zip(first, [*first[1:], len(rows)])])
        mixed = rng.permutation(len(docs))
        for at in range(0, len(mixed), batch):
            pick = mixed[at : at + batch]
            used, mine = np.unique(rows[worst[pick]], return_inverse=True)
            where = places.take(used)
            seen, mine = inputs[used], mine.reshape(len(pick), WINDOW)
            seen[:, -EMBED:] = np.where(used[:, None] > 0, embeddings.of(where), _F(0))
            run = forward(weights, project(weights, seen), mine, keep=True)
            d = (_sigmoid(run[0]) - target[pick]) / len(pick)
            step += 1
            grads = gradients(weights, seen, mine, d.astype(_F), run)
            _move(embeddings, squares, where, np.where(used[:, None] > 0, grads.pop("inputs"), _F(0)), _F(2 * rate(epoch, epochs)))
            for k, g in grads.items():
                g = g + _F(1e-4) * weights[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                weights[k] -= (rate(epoch, epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(_F)
    return whole


def is_held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def fitting_sample(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_chars: int = MAX_CHARS) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels to learn from: at most max_toxic and max_clean labelled rows that aren't held out, those whose
    ids have the least hashes. Ids with two different labels, nulls, and longer texts are left out; of an id's several
    texts, the one with the least hash counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~is_held_out())
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").select("doc_id", "toxic", F.xxhash64("doc_id").alias("o"))
    chosen = known.filter("toxic = 1").orderBy("o").limit(max_toxic).unionByName(known.filter("toxic = 0").orderBy("o").limit(max_clean))
    rows = docs.filter(F.length("text") <= max_chars).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "toxic", "text").orderBy("doc_id").toArrow()
    return [t or b"" for t in raw(rows.column(2).combine_chunks())], rows.column(1).to_numpy() == 1


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted, for every input row.

    Labels (doc_id, toxic) are learnt only from rows whose crc32(doc_id as text) mod 3 is not 1; with none, or with one
    label only, every score is the same low one. A score depends on the text alone. Null and empty texts, and texts
    without words, have one empty window. A null id isn't held out. Repeated rows each have their row; an empty table
    gives none. Very long texts are scored in all of their windows; the highest window counts, so ties need no rule, and a
    score on the threshold is predicted toxic. Extra columns play no part, whatever their names. Scoring is one narrow pass: the fitted model has a fixed size and is broadcast.
    """
    source = documents_of(docs, id_col, text_col)
    if model is None:
        model = fit(*fitting_sample(source, labels))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for batch in slices(batches, 2 << 20):
            score = shared.value.score(raw(batch.column(1)))
            held = [d is not None and zlib.crc32(str(d).encode()) % 3 == 1 for d in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], schema=schema)

    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with their own columns, whose text scores below the threshold (a tie goes). Null and empty texts
    have one empty window, very long ones are scored whole, repeated rows alike. Extra columns keep their values, whatever their
    names. An empty table gives an empty one; without labels all stay. One narrow pass."""
    if model is None:
        model = fit(*fitting_sample(documents_of(docs, id_col, text_col), labels))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = with_rest(docs, id_col, text_col).select("rest", "text")

    def run(batches):
        for batch in slices(batches, 2 << 20):
            fine = shared.value.score(raw(batch.column(1))) < threshold
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fine))], names=["rest"])

    kept = rows.mapInArrow(run, T.StructType([rows.schema["rest"]]))
    return kept.select(*(F.col(f"rest.`{c}`").alias(c) for c in docs.columns))
