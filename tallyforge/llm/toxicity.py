"""Toxic spans by a linear-chain conditional random field.

Each token has a state (0 clean, 1 toxic).  Its features are the word and its
first 3 to 6 bytes, known by 64-bit hashes; two neighbouring states have a
transition weight.  Forward-backward gives every token's marginal; marginals
make the document's score and the offending character spans.

The field needs labelled tokens and the corpus has labelled documents.  A token
of a toxic document is labelled toxic if one of its features is far more
frequent, by document frequency, in toxic than in clean documents of the
sample; all tokens of clean documents are clean.

The fit uses a bounded sample on the driver (`toxic_rows` and `clean_rows`,
chosen by a hash of the id among those that have a document, and `sample_chars`
of text in all, so that one text of any length can be in it).  Scoring covers
all tokens of all texts in Arrow batches; a whole batch is one chain in which
a document's first token forgets what stood before it, and the chain is
computed in rows by the associativity of its 2x2 products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tallyforge.llm import _text as X
from tallyforge.llm._frames import appended, table

PREFIXES = (3, 4, 5, 6)
#: Features of fewer documents of the sample have no weight.
LEAST = 3
TOXIC_ROWS, CLEAN_ROWS, SAMPLE_CHARS = 900, 1800, 16_000_000
ROUNDS = 16
#: Step of the transition and initial weights; they stand at frequencies when the ascent starts.
CHAIN_RATE = 0.5
FOLDS = 5

RESULT = "score double, predicted int, n_toxic_tokens long, toxic_spans array<struct<start:long,end:long,probability:double>>"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def tokens(data: np.ndarray, offsets: np.ndarray):
    """(features, inverse, starts, ends, first) of lower-cased bytes.  features
    has a column for each distinct word: the word's hash and one for each
    prefix, 0 where the word is shorter; inverse leads from tokens to columns."""
    starts, ends, first = X.words(data, offsets, X.ALNUM)
    hashes, at, inverse = np.unique(X.hash_spans(data, starts, ends), return_index=True, return_inverse=True)
    out = np.zeros((1 + len(PREFIXES), len(hashes)), X.U64)
    if len(hashes):
        out[0] = hashes
        size = (ends - starts)[at]
        load = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))[starts[at]]
        for k, n in enumerate(PREFIXES):
            h = X.mix((load & X._MASK[n]) ^ X.U64(0x9E3779B97F4A7C15 * n & (2**64 - 1)))
            out[1 + k] = np.where(size >= n, h, X.U64(0))
    return out, inverse, starts, ends, first


def marginals(emission: np.ndarray, begins: np.ndarray, transition: np.ndarray, initial: np.ndarray, pairs: bool = False):
    """P(state 1) of each token.  `emission`: log weight of state 1 against 0;
    `begins`: whether a token is its document's first; transition and initial:
    log weights.  With `pairs` also the summed pair marginals (2x2)."""
    n = len(emission)
    if not n:
        return (np.zeros(0), np.zeros((2, 2))) if pairs else np.zeros(0)
    wide = max(1, int(np.sqrt(n)))
    rows = -(-n // wide)
    e = np.ones((rows * wide,))
    e[:n] = np.exp(np.clip(emission, -30, 30))
    b = np.zeros(rows * wide, bool)
    b[:n] = begins
    b[n:] = True
    e, b = np.ascontiguousarray(e.reshape(rows, wide).T), np.ascontiguousarray(b.reshape(rows, wide).T)
    a, pi = np.exp(transition), np.exp(initial)
    # weights into each state from each state, per column of tokens
    w00, w01 = np.where(b, pi[0], a[0, 0]), np.where(b, pi[1], a[0, 1]) * e
    w10, w11 = np.where(b, pi[0], a[1, 0]), np.where(b, pi[1], a[1, 1]) * e
    p00, p01, p10, p11 = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for c in range(wide):
        q00, q01 = p00 * w00[c] + p01 * w10[c], p00 * w01[c] + p01 * w11[c]
        q10, q11 = p10 * w00[c] + p11 * w10[c], p10 * w01[c] + p11 * w11[c]
        s = 1.0 / (q00 + q01 + q10 + q11)
        p00, p01, p10, p11 = q00 * s, q01 * s, q10 * s, q11 * s
    into, back = np.empty((2, rows)), np.empty((2, rows))
    x, y = 1.0, 0.0
    for r in range(rows):
        into[:, r] = x, y
        x, y = x * p00[r] + y * p10[r], x * p01[r] + y * p11[r]
        x, y = x / (x + y), y / (x + y)
    x = y = 1.0
    for r in range(rows - 1, -1, -1):
        back[:, r] = x, y
        x, y = p00[r] * x + p01[r] * y, p10[r] * x + p11[r] * y
        x, y = x / (x + y), y / (x + y)
    f0, f1 = np.empty((wide, rows)), np.empty((wide, rows))
    x, y = into
    for c in range(wide):
        u, v = x * w00[c] + y * w10[c], x * w01[c] + y * w11[c]
        s = 1.0 / (u + v)
        f0[c] = x = u * s
        f1[c] = y = v * s
    out = np.empty((wide, rows))
    sums = np.zeros((2, 2))
    x, y = back
    for c in range(wide - 1, -1, -1):
        u, v = f0[c] * x, f1[c] * y
        out[c] = v / (u + v)
        if pairs:
            g0, g1 = (f0[c - 1], f1[c - 1]) if c else into
            m = np.stack([g0 * w00[c] * x, g0 * w01[c] * y, g1 * w10[c] * x, g1 * w11[c] * y])
            m = (m / m.sum(0))[:, ~b[c]].sum(1)
            sums += m.reshape(2, 2)
        x, y = w00[c] * x + w01[c] * y, w10[c] * x + w11[c] * y
        s = 1.0 / (x + y)
        x, y = x * s, y * s
    out = out.T.reshape(-1)[:n]
    return (out, sums) if pairs else out


class Field:
    """Weights of the field and of the document score."""

    def __init__(self):
        self.keys, self.weights = np.zeros(1, X.U64), np.zeros(1)  # sorted hashes; the first, 0, is no feature
        self.transition, self.initial, self.bias = np.zeros((2, 2)), np.zeros(2), -4.0
        self.score = np.zeros(3)
        self.prior = 0.5

    def numbers(self, features: np.ndarray) -> np.ndarray:
        """Index of each feature in `keys`, 0 if it has no weight."""
        at = np.minimum(np.searchsorted(self.keys, features), len(self.keys) - 1)
        return np.where(self.keys[at] == features, at, 0)

    def emission(self, numbers: np.ndarray) -> np.ndarray:
        return self.bias + self.weights[numbers].sum(0)

    def summary(self, probability: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Per document: the largest token's log odds and the log of one more than the expected number of
        toxic ones among the tokens that are toxic rather than clean; the others' would grow with a text's length."""
        n = len(first) - 1
        doc = np.repeat(np.arange(n), np.diff(first))
        top = np.zeros(n)
        np.maximum.at(top, doc, probability)
        total = np.bincount(doc, weights=np.where(probability >= 0.5, probability, 0.0), minlength=n)
        top = np.clip(top, 1e-6, 1 - 1e-6)
        return np.stack([np.ones(n), np.log(top / (1 - top)), np.log1p(total)], 1)

    def documents(self, summary: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary @ self.score, -30, 30)))


def token_labels(numbers: np.ndarray, first: np.ndarray, toxic: np.ndarray, evidence: float = 9.0, odds: float = 20.0) -> np.ndarray:
    """Weak labels of tokens from labels of their documents.

    A feature marks tokens if its share of toxic documents is `odds` times as
    likely as chance has it and the log likelihood ratio is over `evidence`,
    so a rare feature that met toxic documents by chance doesn't.
    """
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    flag, size = np.zeros(numbers.shape[1], bool), int(numbers.max(initial=0)) + 1
    for row in numbers:
        pairs = np.unique(doc.astype(np.int64) * size + row)
        f, t = pairs % size, toxic[pairs // size]
        bad, good = np.bincount(f[t], minlength=size), np.bincount(f[~t], minlength=size)
        ratio = (bad + 0.5) / (toxic.sum() + 1) / ((good + 0.5) / ((~toxic).sum() + 1))
        share, seen = toxic.mean(), np.maximum(bad + good, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(bad, bad * np.log(bad / seen / share), 0) + np.where(good, good * np.log(good / seen / (1 - share)), 0)
        mark = (gain >= evidence) & (ratio >= odds)
        mark[0] = False
        flag |= mark[row]
    return flag & toxic[doc]


def _copies(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Documents of the sample that share one of 4 minwise three-word shingles with an earlier one."""
    out, met = np.zeros(len(first) - 1, bool), [set() for _ in range(4)]
    for d in range(len(out)):
        w = hashes[first[d] : first[d + 1]]
        if len(w) < 3:
            continue
        grams = w[:-2] * X.U64(3) + w[1:-1] * X.U64(5) + w[2:] * X.U64(7)
        low = [int(X.mix(grams ^ X.U64(k + 1)).min()) for k in range(4)]
        out[d] = any(x in m for x, m in zip(low, met))
        for x, m in zip(low, met):
            m.add(x)
    return out


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> Field:
    """Two thirds of the sample fit the field, the rest the document score."""
    field = Field()
    field.prior = float((weight @ toxic + 1) / (weight.sum() + 2)) if len(toxic) else 0.5
    field.score[0] = np.log(field.prior / (1 - field.prior))
    if not toxic.any() or toxic.all():
        return field
    data, offsets = X.buffers(pa.array(texts, pa.string()))
    data = np.append(X.LOWER[data[: offsets[-1]]], np.zeros(8, X.U8))
    features, inverse, _, _, first = tokens(data, offsets)
    doc = np.repeat(np.arange(len(toxic)), np.diff(first))
    known = [np.zeros(1, X.U64)]
    for row in features:
        pairs = np.unique(doc.astype(np.int64) * len(row) + inverse)
        found, back = np.unique(row, return_inverse=True)
        seen = np.unique(pairs // len(row) * len(found) + back[pairs % len(row)]) % len(found)
        known.append(found[np.bincount(seen, minlength=len(found)) >= LEAST])
    field.keys = np.unique(np.concatenate(known))
    field.weights = np.zeros(len(field.keys))
    numbers = field.numbers(features)[:, inverse]
    # copies of one document would make all its words look toxic
    copies = _copies(features[0][inverse], first)
    own = (np.arange(len(toxic)) % 3 != 2) & ~copies
    in_fit = own[doc]
    train, begins = numbers[:, in_fit], np.zeros(len(inverse), bool)
    begins[first[:-1][np.diff(first) > 0]] = True
    begins = begins[in_fit]
    labels = token_labels(train, np.concatenate([[0], np.cumsum(np.diff(first)[own])]), toxic[own])
    y = labels.astype(float)
    same = ~begins[1:]
    seen = np.bincount((labels[:-1] * 2 + labels[1:])[same], minlength=4).reshape(2, 2).astype(float)
    heads = np.bincount(labels[begins], minlength=2).astype(float)
    # the ascent starts at the frequencies of the states and their pairs
    field.transition, field.initial = np.log((seen + 0.5) / (seen + 0.5).sum(1, keepdims=True)), np.log((heads + 0.5) / (heads + 0.5).sum())
    field.bias = 0.0
    chain_square = [np.full((2, 2), 1e-8), np.full(2, 1e-8)]
    square, rate, decay = np.full(len(field.keys), 1e-8), 0.7, 1e-5
    for _ in range(rounds):
        p, pairs = marginals(field.emission(train), begins, field.transition, field.initial, pairs=True)
        error = y - p
        gradient = np.zeros(len(field.keys))
        for row in train:
            gradient += np.bincount(row, weights=error, minlength=len(field.keys))
        gradient[0] = 0
        gradient -= decay * field.weights
        square += gradient**2
        field.weights += rate * gradient / np.sqrt(square)
        # likelihood gradients of the chain's weights: labelled counts less expected ones, half a
        # count of each kind beside, so that what the sample never has isn't ruled out
        at_heads = p[begins].sum()
        chance = lambda w: np.exp(w) / np.exp(w).sum(-1, keepdims=True)
        chain = (seen + 0.5 - pairs - chance(field.transition), heads + 0.5 - np.array([begins.sum() - at_heads, at_heads]) - chance(field.initial))
        for total, g, w in zip(chain_square, chain, (field.transition, field.initial)):
            total += g**2
            w += CHAIN_RATE * g / np.sqrt(total)
        field.bias += 0.5 * float(np.sign(error.sum())) * min(1.0, abs(error.sum()) / (1 + y.sum()))
    rest = np.flatnonzero((np.arange(len(toxic)) % 3 == 2) & ~copies)
    probability = np.zeros(len(inverse))
    held = ~in_fit
    head = np.zeros(len(inverse), bool)
    head[first[:-1][np.diff(first) > 0]] = True
    probability[held] = marginals(field.emission(numbers[:, held]), head[held], field.transition, field.initial)
    x = field.summary(probability, first)[rest]
    t, w = toxic[rest].astype(float), weight[rest]
    beta = field.score.copy()
    for _ in range(30):  # damped Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (t - p)) - 0.05 * beta
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        step = np.linalg.solve(h, g)
        beta += step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    field.score = beta
    return field


def train(documents: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, sample_chars: int = SAMPLE_CHARS) -> Field:
    """Fit on labelled rows that aren't held out; conflicting labels of an id
    count as toxic, labels without a document don't count.  A text that doesn't
    fit into what is left of `sample_chars` is passed over."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    sizes = documents.where(F.col("text").isNotNull()).groupBy("doc_id").agg(F.sum(F.length("text")).alias("size"))
    known = known.join(sizes, "doc_id").persist(StorageLevel.DISK_ONLY)
    size = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    ids, room = [], sample_chars
    for value, limit in ((True, toxic_rows), (False, clean_rows)):
        for r in known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect():
            if r["size"] <= room:
                room -= r["size"]
                ids.append((r["doc_id"], value))
    known.unpersist()
    if not ids:
        return fit([], np.zeros(0, bool), np.zeros(0))
    chosen = F.broadcast(documents.sparkSession.createDataFrame(ids, "doc_id long, toxic boolean"))
    rows = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(chosen, "doc_id").collect()
    rows = sorted({(r["doc_id"], r["text"], r["toxic"]) for r in rows})
    rows.sort(key=lambda r: X.hash_word(str(r[0])))
    toxic = np.array([r[2] for r in rows], bool)
    share = {v: size.get(v, 0) / max(1, (toxic == v).sum()) for v in (True, False)}
    weight = np.array([share[bool(v)] for v in toxic])
    return fit([r[1] for r in rows], toxic, weight / max(weight.mean(), 1e-9) if len(weight) else weight)


def scored(documents: DataFrame, field: Field, text: str = "text", spans: bool = True) -> DataFrame:
    """All columns of `documents` plus score, predicted, n_toxic_tokens and
    toxic_spans (code points, end exclusive; null unless `spans`).

    Null and empty texts, and texts without words, get the score of a text
    with no toxic token.  Rows are scored one by one: repeated rows alike.
    Without labels of both kinds every score is the smoothed share of toxic
    labels.  Input columns with a result's name are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def make():
        model = shared.value

        def work(batch):
            data, offsets = X.buffers(batch.column(batch.schema.get_field_index(text)))
            score, count, found = [], [], []
            for a, b in X.chunks(offsets):
                lo, hi = int(offsets[a]), int(offsets[b])
                part = np.append(X.LOWER[data[lo:hi]], np.zeros(8, X.U8))
                features, inverse, starts, ends, first = tokens(part, offsets[a : b + 1] - lo)
                begins = np.zeros(len(starts), bool)
                begins[first[:-1][np.diff(first) > 0]] = True
                p = marginals(model.emission(model.numbers(features))[inverse], begins, model.transition, model.initial)
                score.append(model.documents(model.summary(p, first)))
                bad = p >= 0.5
                total = np.concatenate([[0], np.cumsum(bad)])
                count.append(total[first[1:]] - total[first[:-1]])
                if spans:
                    chars = np.concatenate([[0], np.cumsum((part[: hi - lo] & 0xC0) != 0x80)])
                    here: list[list] = [[] for _ in range(b - a)]
                    doc = np.searchsorted(first, np.flatnonzero(bad), side="right") - 1
                    last = -2
                    for i, d in zip(np.flatnonzero(bad).tolist(), doc.tolist()):
                        base = chars[offsets[a + d] - lo]
                        if i == last + 1 and i > first[d]:
                            here[d][-1]["end"] = int(chars[ends[i]] - base)
                            here[d][-1]["probability"] = max(here[d][-1]["probability"], float(p[i]))
                        else:
                            here[d].append({"start": int(chars[starts[i]] - base), "end": int(chars[ends[i]] - base), "probability": float(p[i])})
                        last = i
                    found += here
                else:
                    found += [None] * (b - a)
            s = np.concatenate(score)
            return [pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(np.concatenate(count).astype(np.int64)), pa.array(found, kind)]

        return work

    return appended(documents, make, RESULT)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = train(documents, table(spark, sf_dir, "labels"))
    return scored(documents, field).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_toxic_tokens", "toxic_spans")
