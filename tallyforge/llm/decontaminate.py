"""Benchmark decontamination with suffix arrays over the training shards.

Every Arrow slice of documents is a shard.  A suffix array over the shard's
word positions, sorted by their first `window` words, is searched by binary
search for every benchmark suffix; the interval found gives all verbatim
occurrences, which are then extended to their longest match.

The suffix array is sparse: a position enters only if the next words, as many
as the shortest window asks for, all occur in the benchmark's vocabulary.  No
other position can start a match, so nothing is lost and the array stays small.

The benchmark is the query set.  It is read in blocks of at most
`block_bytes` of text, each broadcast, so no broadcast grows with it; the
training side isn't shuffled at all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import _text as X
from tallyforge.llm._frames import appended, blocks_for, table

WINDOW = 8
#: Items from which op2 calls a document contaminated; decontaminate() removes
#: documents that hold any.
MIN_ITEMS = 2
BLOCK_BYTES = 8 << 20

RESULT = "n_words long, n_hit long, n_items long, items array<string>, longest long, longest_item string, longest_at long"


class ItemIndex:
    """Vocabulary, words and windows of one block of benchmark items."""

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW):
        hashes, first = X.hashed_words(pa.array(texts, pa.string()), X.ALNUM)
        self.vocab = np.unique(hashes)
        self.words = (np.searchsorted(self.vocab, hashes) + 1).astype(np.int64)
        self.first, self.ids, self.window = first, ids, window
        size = np.diff(first)
        self.item_of = np.repeat(np.arange(len(ids)), size)
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.vocab & X.U64(0xFFFF)).astype(np.int64)] = True
        #: window length -> (sorted distinct keys, [window -> items] as CSR, a start in `words` for each window)
        self.windows = {}
        for length in sorted({min(window, int(n)) for n in size if n}):
            at = [np.arange(a, a + (n - length + 1 if length == window else 1)) for a, n in zip(first, size) if n and min(window, n) == length]
            at = np.concatenate(at)
            key = keys(self.words, at, length)
            distinct, inverse = np.unique(key, return_inverse=True)
            pairs = np.unique(np.stack([inverse, self.item_of[at]], 1), axis=0)
            starts = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
            order = np.argsort(inverse, kind="stable")
            self.windows[length] = (distinct, starts, pairs[:, 1], at[order], np.searchsorted(inverse[order], np.arange(len(distinct) + 1)))
        self.shortest = min(self.windows, default=0)

    def ids_of(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers from 1; 0 for words of no item."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.bits[(hashes & X.U64(0xFFFF)).astype(np.int64)])
        if len(maybe) and len(self.vocab):
            h = hashes[maybe]
            at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
            good = self.vocab[at] == h
            out[maybe[good]] = at[good] + 1
        return out


def keys(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The `length` words from each position as byte strings that sort as the words do."""
    block = words[at[:, None] + np.arange(length)].astype(">u4")
    return np.ascontiguousarray(block).view(f"S{4 * length}").ravel()


def search_shard(index: ItemIndex, hashes: np.ndarray, first: np.ndarray) -> dict:
    """All windows of `index` in one shard.

    Returns `spans` (starts, lengths) of word positions, `pairs` (document,
    item) without repeats, and `longest` (document, length, start, item) rows.
    """
    none = np.zeros(0, np.int64)
    out = {"starts": none, "lengths": none, "pairs": np.zeros((0, 2), np.int64), "longest": np.zeros((0, 4), np.int64)}
    if not len(hashes) or not index.shortest:
        return out
    words = index.ids_of(hashes)
    n = len(words)
    # words from each position on that are all in the vocabulary and of the same document
    stop = np.flatnonzero(words == 0)
    stop = np.union1d(stop, first[1:])
    position = np.flatnonzero(words)
    run = stop[np.searchsorted(stop, position, side="right")] - position if len(stop) else none
    enough = run >= index.shortest
    position, run = position[enough], run[enough]
    if not len(position):
        return out
    padded = np.concatenate([words, np.zeros(index.window, np.int64)])
    # depth-limited sort: words beyond the run are 0 in the key, so they can't match
    block = padded[position[:, None] + np.arange(index.window)]
    block[np.arange(index.window) >= run[:, None]] = 0
    full = np.ascontiguousarray(block.astype(">u4")).view(f"S{4 * index.window}").ravel()
    order = np.argsort(full, kind="stable")
    suffixes, block = position[order], block[order]
    doc = np.searchsorted(first, suffixes, side="right") - 1
    starts, lengths, pairs, longest = [], [], [], []
    for length, (distinct, item_at, items, origin, origin_at) in index.windows.items():
        sorted_keys = np.ascontiguousarray(block[:, :length].astype(">u4")).view(f"S{4 * length}").ravel()
        lo = np.searchsorted(sorted_keys, distinct, side="left")
        hi = np.searchsorted(sorted_keys, distinct, side="right")
        found = np.flatnonzero(hi > lo)
        if not len(found):
            continue
        count = hi[found] - lo[found]
        which = np.repeat(found, count)
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[found], count)
        # a window with trailing zeros of another length can't be equal: words are numbered from 1
        at, of = suffixes[rows], doc[rows]
        starts.append(at)
        lengths.append(np.full(len(at), length))
        seen = np.unique(np.stack([of, which], 1), axis=0)
        many = item_at[seen[:, 1] + 1] - item_at[seen[:, 1]]
        flat = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(item_at[seen[:, 1]], many)
        pairs.append(np.stack([np.repeat(seen[:, 0], many), items[flat]], 1))
        longest.append(_extend(index, padded, first, at, of, which, length, origin, origin_at))
    if starts:
        out = {"starts": np.concatenate(starts), "lengths": np.concatenate(lengths), "pairs": np.unique(np.concatenate(pairs), axis=0), "longest": np.concatenate(longest)}
    return out


def _extend(index, padded, first, at, of, which, length, origin, origin_at):
    """The longest match of each document, among one origin for each window found.

    A longest match starts with a window; every window of it is found, and the
    items that hold the window are followed one after the other.
    """
    best = {}
    item_end = index.first[index.item_of + 1] if len(index.item_of) else index.first
    turn = 0
    live = np.arange(len(at))
    while len(live):
        o = origin_at[which[live]] + turn
        live = live[o < origin_at[which[live] + 1]]
        if not len(live):
            break
        src = origin[origin_at[which[live]] + turn]
        d, end_d, end_s = at[live].copy(), first[of[live] + 1], item_end[src]
        size = np.full(len(live), length)
        grow = np.arange(len(live))
        while len(grow):
            can = (d[grow] + size[grow] < end_d[grow]) & (src[grow] + size[grow] < end_s[grow])
            grow = grow[can]
            grow = grow[padded[d[grow] + size[grow]] == index.words[src[grow] + size[grow]]]
            size[grow] += 1
        order = np.lexsort((d, -size, of[live]))
        keep = order[np.unique(of[live][order], return_index=True)[1]]
        for k in keep:
            row = (int(size[k]), -int(d[k]), -int(index.item_of[src[k]]))
            doc = int(of[live][k])
            best[doc] = max(best.get(doc, row), row)
        turn += 1
    return np.array([(doc, s, -p, -i) for doc, (s, p, i) in best.items()], np.int64).reshape(-1, 4)


def load_blocks(benchmark: DataFrame, item: str, text: str, window: int, block_bytes: int) -> list:
    """Broadcast indexes of the benchmark, block by block; rows without id are no items."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).where("i is not null")
    total = items.agg(F.sum(F.octet_length("t") + F.lit(16))).first()[0] or 0
    n = blocks_for(total, block_bytes)
    out = []
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).collect() if n > 1 else items.collect()
        rows.sort()
        out.append(spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows])))
    return out


def contamination(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of `documents` plus n_words, n_hit, n_items, items (sorted
    as strings), and the longest verbatim match: its words, item and word
    offset (null without a match; ties: the earliest place, then the first item).

    Null and empty texts have no words and no hits.  Rows with equal ids stay
    rows of their own; items with equal ids count once.  An empty benchmark
    hits nothing.  Input columns with a result's name are replaced.
    """
    blocks = load_blocks(benchmark, item, item_text, window, block_bytes)

    def make():
        held = [ItemIndex(*blocks[0].value, window)] if len(blocks) == 1 else None

        def work(batch):
            hashes, first = X.hashed_words(batch.column(batch.schema.get_field_index(text)), X.ALNUM)
            n = len(first) - 1
            edge = np.zeros(len(hashes) + 1, np.int32)
            items: list[set] = [set() for _ in range(n)]
            best: list[tuple] = [(0, 0, None)] * n
            for block in blocks:
                index = held[0] if held else ItemIndex(*block.value, window)
                found = search_shard(index, hashes, first)
                np.add.at(edge, found["starts"], 1)
                np.add.at(edge, found["starts"] + found["lengths"], -1)
                for d, i in found["pairs"].tolist():
                    items[d].add(index.ids[i])
                for d, size, at, i in found["longest"].tolist():
                    if size > best[d][0] or (size == best[d][0] and (at, index.ids[i]) < best[d][1:]):
                        best[d] = (size, at - int(first[d]), index.ids[i])
            hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
            names = [sorted(x) for x in items]
            return [
                pa.array(np.diff(first)),
                pa.array((hit[first[1:]] - hit[first[:-1]]).astype(np.int64)),
                pa.array([len(x) for x in names], pa.int64()),
                pa.array(names, pa.list_(pa.string())),
                pa.array([b[0] for b in best], pa.int64()),
                pa.array([b[2] for b in best], pa.string()),
                pa.array([b[1] if b[2] is not None else None for b in best], pa.int64()),
            ]

        return work

    return appended(documents, make, RESULT)


def decontaminate(documents: DataFrame, benchmark: DataFrame, min_items: int = 1, **options) -> DataFrame:
    """The rows of `documents` that hold windows of fewer than `min_items` items."""
    names = documents.columns
    text = options.pop("text", "text")
    held = documents.select(*[F.col(f"`{c}`").alias(f"__kept_{k}") for k, c in enumerate(names)], F.col(f"`{text}`").alias("text"))
    marked = contamination(held, benchmark, **options)
    return marked.where(F.col("n_items") < min_items).select(*[F.col(f"__kept_{k}").alias(c) for k, c in enumerate(names)])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_items") >= MIN_ITEMS).alias("contaminated"),
        "longest", "longest_item", "longest_at",
    )


#: For a benchmark whose ids occur once.
SQL2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
c AS (SELECT item, w, least({WINDOW}, len(w)) AS n, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS k FROM b WHERE len(w) > 0),
i AS (SELECT DISTINCT item, n, k, array_to_string(w[k : k + n - 1], ' ') AS g FROM c),
e AS (SELECT d.r, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i) s WHERE len(d.w) >= s.n),
h AS (SELECT e.r, e.n, e.p, i.item, i.k FROM e JOIN i ON e.n = i.n AND array_to_string(e.w[e.p : e.p + e.n - 1], ' ') = i.g),
t AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS x FROM (SELECT DISTINCT r, n, p FROM h)) GROUP BY 1),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY 1),
u AS (SELECT r, item, n, p, p - k AS diagonal, p - row_number() OVER (PARTITION BY r, item, n, p - k ORDER BY p) AS island FROM h),
l AS (SELECT r, item, min(p) - 1 AS place, count(*) + n - 1 AS size FROM u GROUP BY r, item, n, diagonal, island),
o AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY r ORDER BY size DESC, place, item) = 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(t.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256, coalesce(m.n_items, 0) >= {MIN_ITEMS} AS contaminated,
CAST(coalesce(o.size, 0) AS BIGINT) AS longest, o.item AS longest_item, CAST(o.place AS BIGINT) AS longest_at
FROM d LEFT JOIN t ON d.r = t.r LEFT JOIN m ON d.r = m.r LEFT JOIN o ON d.r = o.r
"""


def brute(doc: str | None, items: list[tuple[str, str]], window: int = WINDOW) -> tuple[int, int, list[str]]:
    """(n_words, n_hit, items) by direct comparison, for tests."""
    import re

    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    d, hit, names = split(doc), set(), set()
    for name, t in items:
        w = split(t)
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(d) - n + 1 if n else 0):
            if tuple(d[i : i + n]) in grams:
                hit.update(range(i, i + n))
                names.add(name)
    return len(d), len(hit), sorted(names)


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()
