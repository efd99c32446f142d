"""Language-model scores by a weighted backoff automaton.

Smoothed n-grams are the automaton's states.  A state has an arc for each word
that follows its words in the training texts, with the smoothed log10
probability, and a failure arc to the state of its words but the first, with
the log10 of the mass left over.  One traversal from left to right follows, for
each word, failure arcs until an arc for it is found, adds up the weights, and
moves to the longest state that ends in the word.

Words and n-grams are counted exactly over all training texts, and none is cut.
They go packed: a task sends those of its texts, with their buckets, to the part
of their first two words (words to the part of their hash), so an n-gram's
history is in the n-gram's own part.  A part adds them up and answers each
bucket with numbers only, in the ascending order of the bucket's own n-grams
there, which the bucket finds again from its texts.  So no task, no broadcast
and no driver holds the model.

A state's failure arc needs the discounted counts that its arcs take: they are
added up in the part, and for single words sent on to the words' parts.

A word's lowest-order probability is (c + 1) / (N + V + 1); higher orders use
absolute discounting interpolated with the order below.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import _text as X
from tallyforge.llm._frames import cells, small_batches, table, written

FOLDS, HELD = 7, 2
ORDER = 3
#: Share of the training tokens from which an n-gram is an arc: none is cut.
SHARE = 0.0
DISCOUNT = 0.5
#: Bytes of text in a bucket, about.
BUCKET = 8 << 20
#: The end of a text, which is also the state before its first word.
END = X.U64(0x51ED270B7A3F00D5)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of all words and one END after each text."""
    words, first = X.hashed_words(column, X.SPACED)
    n = len(first) - 1
    out = np.empty(len(words) + n, X.U64)
    at = first + np.arange(n + 1)
    ends = at[1:] - 1
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside], out[ends] = words, END
    return out, at


class Automaton:
    """States and arcs, for tests; lookups go by 64-bit n-gram hashes."""

    def __init__(self, arcs: list[tuple[np.ndarray, np.ndarray]], failures: list[tuple[np.ndarray, np.ndarray]]):
        self.arcs, self.failures = arcs, failures  # sorted keys and values, by order from 2


def build(tables: list[dict], n_train: int, v_train: int, words: dict[int, int], discount: float = DISCOUNT) -> Automaton:
    """From n-grams {(w1, .., wn): count} of each order from 2 and the
    counts of their words.  A history's count is its own as an n-gram."""
    def base(w):
        return (words[w] + 1) / (n_train + v_train + 1)

    below, arcs, failures = None, [], []
    history_count: dict = {(w,): c for w, c in words.items()}
    for table_ in tables:
        followers: dict = {}
        for g, c in table_.items():
            followers.setdefault(g[:-1], []).append((g, c))
        left = {h: 1.0 - sum(max(c - discount, 0.0) for _, c in rows) / history_count[h] for h, rows in followers.items()}
        probability = {}
        for h, rows in followers.items():
            for g, c in rows:
                lower = base(g[-1]) if below is None else below(g[1:])
                probability[g] = max(c - discount, 0.0) / history_count[h] + left[h] * lower
        arcs.append({g: np.log10(p) for g, p in probability.items()})
        failures.append({h: np.log10(max(x, 1e-12)) for h, x in left.items()})
        history_count = dict(table_)

        def below(g, p=probability, m=left, low=below):
            return p[g] if g in p else m.get(g[:-1], 1.0) * (base(g[-1]) if low is None else low(g[1:]))

    def packed(rows):
        keys = np.array([gram_hash(g) for g in rows], X.U64)
        order = np.argsort(keys)
        return keys[order], np.array(list(rows.values()))[order]

    return Automaton([packed(a) for a in arcs], [packed(f) for f in failures])


def gram_hash(words: tuple[int, ...]) -> int:
    """64-bit hash of one n-gram, for the tests' automaton."""
    h = np.array([words[-1]], X.U64)
    for w in reversed(words[:-1]):
        h = X.mix(h * X.U64(0x9E3779B97F4A7C15) + np.array([w], X.U64))
    return int(h[0])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(X.U64).view(np.int64)


def _bucketed(documents: DataFrame, bucket: int, train: Column | None) -> tuple[DataFrame, int]:
    """(documents, number of buckets): documents with a bucket of about `bucket` bytes: neighbouring ids, which
    often stand in one file, and hashes of texts without an id."""
    rows = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows, n, _ = cells(rows, bucket)
    mark = ~held_out(F.col("doc_id")) if train is None else train
    return rows.select(F.col("cell").cast("int").alias("bucket"), "doc_id", mark.alias("train"), "text"), n


#: Bytes of text that a task holds before it sends their words or n-grams, about.
BLOCK = 4 << 20
#: Parts that the n-grams of one first word are dealt to, at most.
SALT = 16
#: Bits that are left out of the hashes of second and of later words: those are
#: told apart only among the followers of one state, of which states of two
#: words have far fewer.
SHORT, SHORTER = X.U64(16), X.U64(24)
_LOW = X.U64(0xFFFFFFFF)
_G = X.U64(0x9E3779B97F4A7C15)


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of numbers, compressed: all first bytes of an array, then all second ones, ..."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.itemsize))], X.U64)
    raw = head.tobytes() + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpacked(body: bytes) -> list[np.ndarray]:
    """The arrays as unsigned numbers."""
    raw = pa.Codec("zstd").decompress(body[8:], int.from_bytes(body[:8], "little"), asbytes=True)
    count = int.from_bytes(raw[:8], "little")
    at, out = 8 + 16 * count, []
    for n, size in np.frombuffer(raw, X.U64, 2 * count, 8).reshape(-1, 2).tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(f"<u{size}").ravel())
        at += n * size
    return out


def _steps(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers; where `new` holds, the number itself."""
    out = x.copy()
    out[1:] -= np.where(new[1:], X.U64(0), x[:-1])
    return out


def _sums(steps: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The numbers of _steps()."""
    total = np.cumsum(steps, dtype=X.U64)
    heads = np.flatnonzero(new)
    return total - np.repeat(total[heads] - steps[heads], np.diff(np.append(heads, len(steps))))


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Marks rows that differ from the one before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _heads(counts: np.ndarray) -> np.ndarray:
    """Marks the first rows of groups of these sizes, none of them empty."""
    new = np.zeros(int(counts.sum()), bool)
    new[np.cumsum(counts, dtype=np.int64) - counts] = True
    return new


def _sum(number: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(number, weights=values, minlength=n)


def _word_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> X.U64(20)) % X.U64(parts)).astype(np.int64)


def _levels(words: np.ndarray, first: np.ndarray, buckets: np.ndarray, train: np.ndarray, order: int, parts: int, numbers: bool = True) -> tuple:
    """(names, distinct, own words, firsts, levels) of texts.

    names: buckets; distinct: the texts' words, both ascending.  Own words and
    firsts are (bucket's place in names, word's place in distinct, training
    count, each token's number) of the words and the first words of n-grams in
    each bucket.  A level, for each order from 2, is (up, word, n, part, number):
    distinct n-grams by the number of their history and the short hash of their
    last word, with training counts and parts, and each token's n-gram (unless
    `numbers` is false, when the last level has none).
    """
    size = np.diff(first)
    marked = np.repeat(train, size)
    names, bucket = np.unique(buckets, return_inverse=True)
    bucket = np.repeat(bucket.astype(np.int64), size)
    distinct, at = np.unique(words, return_inverse=True)
    at = at.astype(np.int32)
    width = len(distinct)

    def by_bucket(at):
        keys = bucket * width + at
        if len(names) * width <= 8 * len(words):
            counts = np.bincount(keys, minlength=len(names) * width)
            there = np.flatnonzero(counts)
            n = np.bincount(keys[marked], minlength=len(counts))[there]
            number = (np.cumsum(counts > 0) - 1)[keys]
        else:
            there, number = np.unique(keys, return_inverse=True)
            n = np.bincount(number[marked], minlength=len(there))
        return there // width, there % width, n.astype(X.U64), number.astype(np.int32)

    own = by_bucket(at)
    if order < 2:
        return names, distinct, own, None, []
    before = np.empty_like(at)
    before[1:] = at[:-1]
    before[first[:-1]] = np.searchsorted(distinct, END)
    firsts = by_bucket(before)
    place = np.arange(len(words)) - np.repeat(first[:-1], size)
    levels, number, part = [], firsts[3], None
    for k in range(2, order + 1):
        if k < 4:
            lasts = distinct >> (SHORT if k == 2 else SHORTER)
            new = _changes(lasts)
            short, brief = (np.cumsum(new) - 1).astype(np.int32), lasts[new]
        rows = np.flatnonzero(place >= k - 2)
        keys = (number[rows if k == 2 else rows - 1].astype(X.U64) << X.U64(32)) | (short[at[rows]].astype(X.U64) << X.U64(1))
        if k < order or numbers:
            keys, dense = np.unique(keys, return_inverse=True)
            n = np.bincount(dense[marked[rows]], minlength=len(keys))
            number = np.full(len(words), -1, np.int32)
            number[rows] = dense
        else:  # the lowest bit tells training tokens
            keys = np.sort(keys | marked[rows])
            heads = np.flatnonzero(_changes(keys >> X.U64(1)))
            n = np.add.reduceat((keys & X.U64(1)).astype(np.int64), heads) if len(heads) else heads
            keys, number = keys[heads], None
        up, word = (keys >> X.U64(32)).astype(np.int64), brief[((keys & _LOW) >> X.U64(1)).astype(np.int64)]
        if k == 2:
            part = (((distinct[firsts[1][up]] >> X.U64(20)) + word % X.U64(SALT)) % X.U64(parts)).astype(np.int64)
        else:
            part = part[up]
        levels.append((up, word, n.astype(X.U64), part, number))
    return names, distinct, own, firsts, levels


def _dealt(part: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(part, its rows) in ascending order."""
    by = np.argsort(part, kind="stable")
    heads = np.flatnonzero(_changes(part[by])) if len(by) else np.zeros(0, np.int64)
    return [(int(part[by[a]]), by[a:b]) for a, b in zip(heads, np.append(heads[1:], len(by)))]


def _blocks(batches, make):
    """make(texts) for `BLOCK` bytes of text at a time, or somewhat more."""
    held, size = [], 0
    for batch in X.slices(batches, size=BLOCK):
        held.append(batch)
        size += batch.nbytes
        if size >= BLOCK:
            yield make(pa.Table.from_batches(held))
            held, size = [], 0
            pa.default_memory_pool().release_unused()
    if held:
        yield make(pa.Table.from_batches(held))


def _messages(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "body"])


def _asked(parts: int, order: int):
    """Arrow function of a task: for each part its n-grams in about `BLOCK`
    bytes of text: buckets, first words and their numbers of n-grams, then by
    order the last words, their counts and their numbers of longer n-grams."""

    def packed(texts):
        names, distinct, _, firsts, levels = _levels(*tokens(texts.column(2)), texts.column(0).to_numpy(), texts.column(1).to_numpy().astype(bool), order, parts, numbers=False)
        chosen: dict[int, np.ndarray] = {}
        bodies: dict[int, list] = {}
        for k, (up, word, n, part, _) in enumerate(levels):
            for p, rows in _dealt(part):
                if k == 0:
                    new = _changes(up[rows])
                    lead = up[rows[new]]
                    own = firsts[0][lead]
                    bodies[p] = [names[own].astype(np.uint32), _steps(distinct[firsts[1][lead]], _changes(own)), np.diff(np.append(np.flatnonzero(new), len(rows))).astype(np.uint32)]
                else:
                    to = np.searchsorted(chosen[p], up[rows])
                    new = _changes(to)
                    bodies[p].append(np.bincount(to, minlength=len(chosen[p])).astype(np.uint32))
                bodies[p] += [_steps(word[rows], new), n[rows].astype(np.uint32)]
                chosen[p] = rows
        none = [np.zeros(0, np.uint32), np.zeros(0, X.U64), np.zeros(0, np.uint32)]
        for body in bodies.values():
            while len(body) < 5 + 3 * (order - 2):  # no longer n-grams
                body += [np.zeros(len(body[-1]), np.uint32), *none[1:]]
        return _messages([(p, _packed(body)) for p, body in bodies.items()])

    return lambda batches: _blocks(batches, packed)


def _words(parts: int):
    """Arrow function of a task: for each part of words the buckets, hashes and training counts."""

    def packed(texts):
        names, distinct, (own, word, n, _), _, _ = _levels(*tokens(texts.column(2)), texts.column(0).to_numpy(), texts.column(1).to_numpy().astype(bool), 1, 1)
        rows = _dealt(_word_part(distinct[word], parts))
        return _messages([(p, _packed([names[own[r]].astype(np.uint32), _steps(distinct[word[r]], _changes(own[r])), n[r].astype(np.uint32)])) for p, r in rows])

    return lambda batches: _blocks(batches, packed)


def _merged(again: bool, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(heads, slot): a row of each distinct one in ascending order, and each
    row's number among these.  Unless `again` holds, rows are distinct and
    ascend where their first key is equal."""
    by = np.lexsort(keys[::-1]) if again else np.argsort(keys[0], kind="stable")
    new = _changes(*(k[by] for k in keys))
    slot = np.empty(len(by), np.int64)
    slot[by] = np.cumsum(new) - 1
    return by[new], slot


def _again(buckets: list[np.ndarray]) -> bool:
    """Tells that a bucket is in several messages."""
    own = np.concatenate([np.unique(b) for b in buckets])
    return len(np.unique(own)) < len(own)


def _answered(least: float, discount: float, order: int, word_parts: int):
    """Arrow function of a part: to each bucket, for its n-grams here in ascending
    order, how often other buckets have them and, if they do, what the arcs of
    their states take; to parts of words (-1, -2, ..) what the arcs of these take."""

    def run(key, t):
        parsed = [_unpacked(b) for b in t.column("body").to_pylist()]
        whole = lambda i: np.concatenate([p[i] for p in parsed])
        again = _again([p[0] for p in parsed])
        count = whole(2).astype(np.int64)
        bucket = np.repeat(whole(0).astype(np.int64), count)
        first = np.repeat(np.concatenate([_sums(p[1], _changes(p[0])) for p in parsed]), count)
        slots: list[tuple] = []
        number = below = None
        for k in range(order - 1):
            if k:
                parent = np.repeat(below, whole(3 * k + 2).astype(np.int64))
                inside = np.concatenate([np.repeat(np.arange(len(p[3 * k + 2])), p[3 * k + 2].astype(np.int64)) for p in parsed])
                # rows of one history in one message follow each other
                message = np.repeat(np.arange(len(parsed)), [len(p[3 * k + 3]) for p in parsed])
                word = _sums(whole(3 * k + 3), _changes(message, inside)) if len(inside) else np.zeros(0, X.U64)
                heads, slot = _merged(again, parent, word)
            else:
                word = _sums(whole(3), _heads(count))
                heads, slot = _merged(again, bucket, first, word)
            n = _sum(slot, whole(3 * k + 4), len(heads))
            up = parent[heads] if k else None
            state = number[up].astype(X.U64) if k else first[heads]
            _, lead, number = np.unique(X.mix(state * _G + word[heads]), return_index=True, return_inverse=True)
            total = _sum(number, n, len(lead))
            taken = np.where(total >= least, np.maximum(total - discount, 0.0), 0.0)
            if k:
                slots[-1][3][:] = _sum(slots[-1][2][up[lead]], taken, len(slots[-1][3]))
            else:
                names, at = np.unique(first[heads][lead], return_inverse=True)
                by_word, bucket = _sum(at, taken, len(names)), bucket[heads]
            slots.append((bucket if not k else slots[-1][0][up], total[number] - n, number, np.zeros(len(lead))))
            below = slot
        rows = []
        edges = np.flatnonzero(_changes(bucket))
        for b in bucket[edges].tolist():
            body = []
            for own, others, number, less in slots:
                lo, hi = np.searchsorted(own, [b, b + 1])
                shared = others[lo:hi]
                body += [shared.astype(X.U64), np.where(shared > 0, less[number[lo:hi]], 0.0)]
            rows.append((b, _packed(body)))
        some = by_word > 0
        names, by_word = names[some], by_word[some]
        for p, own in _dealt(_word_part(names, word_parts)):
            rows.append((-1 - p, _packed([_steps(names[own], np.arange(len(own)) == 0), by_word[own]])))
        return pa.Table.from_pydict({"to": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array(np.full(len(rows), key[0].as_py()), pa.int32()), "body": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _counted():
    """Arrow function of a part of words: to each bucket, for its words here in
    ascending order, their totals and what the arcs of their states take; to -1
    the numbers of tokens and of words of the training texts."""

    def run(key, t):
        parsed = [_unpacked(b) for b in t.column("body").to_pylist()]
        asked, taken = [p for p in parsed if len(p) == 3], [p for p in parsed if len(p) == 2]
        bucket = np.concatenate([p[0] for p in asked]).astype(np.int64)
        word = np.concatenate([_sums(p[1], _changes(p[0])) for p in asked])
        heads, slot = _merged(_again([p[0] for p in asked]), bucket, word)
        n = _sum(slot, np.concatenate([p[2] for p in asked]), len(heads))
        names, number = np.unique(word[heads], return_inverse=True)
        total = _sum(number, n, len(names))
        less = np.zeros(len(names))
        for w, x in taken:
            less[np.searchsorted(names, np.cumsum(w, dtype=X.U64))] += x.view(float)
        bucket = bucket[heads]
        edges = np.flatnonzero(_changes(bucket))
        bodies = [_packed([total[number[a:b]].astype(X.U64), less[number[a:b]]]) for a, b in zip(edges, np.append(edges[1:], len(bucket)))]
        m, p = len(bodies), -1 - key[0].as_py()
        return pa.Table.from_pydict({
            "to": pa.array(np.append(bucket[edges], -1).astype(np.int32)), "part": pa.array(np.full(m + 1, p), pa.int32()), "body": pa.array([*bodies, None], pa.binary()),
            "tokens": pa.array([None] * m + [int(total.sum())], pa.int64()), "words": pa.array([None] * m + [int((total > 0).sum())], pa.int64()),
        })

    return run


def _scored(n_train: int, v_train: int, least: float, discount: float, order: int, parts: int, word_parts: int):
    """Arrow function of a bucket: its texts' scores from the numbers of its words and n-grams."""

    def answered(rows):
        """The arrays of the answers, joined in the order of the parts."""
        part, body = rows.column("part").to_numpy(), rows.column("body")
        bodies = [_unpacked(body[int(i)].as_py()) for i in np.argsort(part)]
        return [np.concatenate(x) for x in zip(*bodies)]

    def run(key, left, right):
        w, first = tokens(left.column("text"))
        begins = first[:-1]
        place = np.arange(len(w)) - np.repeat(begins, np.diff(first))
        names, distinct, own, _, levels = _levels(w, first, np.zeros(left.num_rows, np.int32), left.column("train").to_numpy().astype(bool), order, parts)
        grams = right.column("gram").to_numpy().astype(bool)
        words, answers = answered(right.filter(pa.array(~grams))), answered(right.filter(pa.array(grams)))
        total, less = np.empty(len(distinct)), np.empty(len(distinct))
        by = np.argsort(_word_part(distinct, word_parts), kind="stable")
        total[by], less[by] = words[0], words[1].view(float)
        at, end = own[3], np.searchsorted(distinct, END)
        count = total[at]
        p = (count + 1) / (n_train + v_train + 1)
        base = np.log10(p)
        totals, takes = [], []
        for k, (up, _, n, _, _) in enumerate(levels):
            if k:
                takes.append(_sum(up, np.where(n >= least, np.maximum(n - discount, 0.0), 0.0), len(totals[-1])))
            totals.append(n.astype(float))
        takes.append(np.zeros(len(totals[-1])))
        for k, (_, _, _, part, _) in enumerate(levels):
            by = np.argsort(part, kind="stable")
            others = answers[2 * k].astype(float)
            takes[k][by] = np.where(others > 0, answers[2 * k + 1].view(float), takes[k][by])
            totals[k][by] += others
        for k, level in enumerate(levels):
            here = np.flatnonzero(place >= k)
            if k:
                before = levels[k - 1][4][here - 1]
                history, taken = totals[k - 1][before], takes[k - 1][before]
            else:
                history, taken = np.empty_like(count), np.empty(len(w))
                history[1:], taken[1:] = count[:-1], less[at[:-1]]
                history[begins], taken[begins] = total[end], less[end]
            own = totals[k][level[4][here]]
            history = np.maximum(history, 1)  # a history that no training text has takes nothing
            arc = own >= least
            left_over = 1.0 - taken / history
            p[here] = np.where(arc, np.maximum(own - discount, 0.0) / history + left_over * p[here], np.maximum(left_over, 1e-12) * p[here])
        weight = np.log10(p)
        add = lambda x: np.add.reduceat(x, begins)
        return pa.Table.from_pydict({
            "doc_id": left.column("doc_id"), "n_tokens": pa.array(np.diff(first).astype(np.int64)), "n_known": pa.array(add((count > 0).astype(np.int64))),
            "train_tokens": pa.array(np.full(left.num_rows, n_train, np.int64)), "base_score": pa.array(add(base)), "score": pa.array(add(weight)),
        })

    return run


#: Removes a query's shuffle files from the executors' disks when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _kept(df: DataFrame) -> DataFrame:
    """written(), after which the exchanges that led to it are removed."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return written(df)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def score(documents: DataFrame, train: Column | None = None, order: int = ORDER, share: float = SHARE, discount: float = DISCOUNT, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row.

    The rows for which `train` holds (by default those that aren't held out)
    are learned from.  Null counts as the empty text, whose only token is the
    end.  Repeated rows are counted and scored as often as they occur.  Without
    training rows every token is unknown.  An empty table gives no rows.
    Columns other than doc_id and text are ignored.  `share`, for models that
    leave out rare n-grams, is the least share of the training tokens of an arc.
    """
    small_batches(documents.sparkSession)
    rows, parts = _bucketed(documents, bucket, train)
    texts = rows.select("bucket", "train", "text")
    least = 1.0
    if share > 0:
        size = lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([int(tokens(b.column(0))[1][-1])], pa.int64())}) for b in X.slices(batches))
        least = max(1.0, share * (rows.where("train").select("text").mapInArrow(size, "n long").agg(F.sum("n")).first()[0] or 0))
    word_parts = -(-parts // 4)
    asked = texts.mapInArrow(_asked(parts, order), "part int, body binary")
    answers = _kept(asked.groupBy("part").applyInArrow(_answered(least, discount, order, word_parts), "to int, part int, body binary"))
    taken = answers.where("`to` < 0").select(F.col("to").alias("part"), "body")
    words = texts.mapInArrow(_words(word_parts), "part int, body binary").select((-1 - F.col("part")).alias("part"), "body").unionByName(taken)
    words = _kept(words.groupBy("part").applyInArrow(_counted(), "to int, part int, body binary, tokens long, words long"))
    n_train, v_train = words.where("`to` < 0").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    known = [x.where("`to` >= 0").select(F.col("to").alias("bucket"), F.lit(gram).alias("gram"), "part", "body") for x, gram in ((words, False), (answers, True))]
    kind = dict(documents.dtypes)["doc_id"]
    run = _scored(n_train, v_train, least, discount, order, parts, word_parts)
    return rows.groupBy("bucket").cogroup(known[0].unionByName(known[1]).groupBy("bucket")).applyInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


class Walker:
    """The automaton walked word by word, for tests: explicit states, arcs and failures."""

    def __init__(self, tables, n_train, v_train, words, discount=DISCOUNT):
        self.model = build(tables, n_train, v_train, words, discount)
        self.n = len(tables) + 1

    def step(self, state: tuple[int, ...], w: int, base: dict[int, float]) -> float:
        total, h = 0.0, state
        while h:
            keys, values = self.model.arcs[len(h) - 1]
            i = np.searchsorted(keys, X.U64(gram_hash((*h, w))))
            if i < len(keys) and keys[i] == X.U64(gram_hash((*h, w))):
                return total + values[i]
            keys, values = self.model.failures[len(h) - 1]
            i = np.searchsorted(keys, X.U64(gram_hash(h)))
            total += values[i] if i < len(keys) and keys[i] == X.U64(gram_hash(h)) else 0.0
            h = h[1:]
        return total + base[w]

    def text(self, words: list[int], base: dict[int, float]) -> float:
        state, total = (int(END),), 0.0
        for w in [*words, int(END)]:
            total += self.step(state, w, base)
            state = (*state, w)[-(self.n - 1) :]
        return total
