"""Near-duplicate groups by a chosen-path set similarity join.

A document's set holds its distinct word shingles.  Documents with equal sets
are one class from the start.  In each of `TREES` independent trees the classes
branch by selected minwise tokens: a node's members share the tokens chosen so
far, and a node of more than `SMALL` members branches again, to `LEVELS` tokens
at most.  Nodes of one member end.  In the others all members are compared by
sketches, the low bytes of all minwise tokens; a node still large after the
last token (near copies by the thousand) is dealt into blocks, and one member
stands in all of them.

Sketches only say what to compare.  Classes linked by them form clusters, and
in a cluster links are confirmed on the full sets: one class after another, of
the smallest group that still has unknown pairs, is compared with all others,
until no pair of different groups is unknown.  So a cluster's groups are exact,
without a comparison of all pairs.  Clusters beyond `CLUSTER` classes are dealt
into blocks with shared pivots, and the classes that don't join the cluster's
main group that way are compared with every block.

Texts move once, for classes of clusters only; all that is kept between steps
is written to the shared folder.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm import _text as X
from tallyforge.llm._frames import small_batches, table, written
from tallyforge.operators.graph import components

SHINGLE, QUERY_SHINGLE = 5, 4
SIMILARITY = (80, 100)
TREES, LEVELS = 16, 4
#: Members of a node that are compared with each other.
SMALL = 256
#: Equal sketch bytes of 64 from which a pair is looked at; a pair of the least
#: similarity has fewer with probability 4e-5 in a node.
ALIKE = 37
#: Classes of a cluster that one task takes, and pivots shared by its blocks beyond.
CLUSTER, PIVOTS = 2000, 16
#: Pairs compared at a time.
PAIRS = 1 << 18

_SEED = np.random.Generator(np.random.PCG64(20240607))
_XOR = _SEED.integers(0, 2**63, TREES * LEVELS, dtype=np.uint64)
_MUL = _SEED.integers(0, 2**63, TREES * LEVELS, dtype=np.uint64) * X.U64(2) + X.U64(1)
_P = X.U64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of all shingles, repeats included; a text of fewer than
    k words, but not none, has its whole sequence as one."""
    size = np.diff(first)
    n = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    out_first = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(out_first[-1]) + np.repeat(first[:-1] - out_first[:-1], n)
    length = np.repeat(np.minimum(size, k), n)
    h = length.astype(X.U64)
    for i in range(k):
        inside = length > i
        if inside.all():
            h = h * _P + words[at + i]
        else:
            h[inside] = h[inside] * _P + words[at[inside] + i]
    return X.mix(h), out_first


def sets(column, k: int):
    """For each row its distinct shingle hashes, sorted."""
    words, first = X.hashed_words(column, X.SPACED)
    h, f = shingles(words, first, k)
    return [np.unique(h[a:b]) for a, b in zip(f[:-1].tolist(), f[1:].tolist())]


def _signed_rows(k: int):
    """(doc_id, text key, n, set digest, minwise tokens) of each row."""

    def run(batches):
        for batch in X.slices(batches, size=1 << 22):
            own = sets(batch.column(2), k)
            full = np.array([len(s) > 0 for s in own], bool)
            first = np.concatenate([[0], np.cumsum([len(s) for s in own])]).astype(np.int64)
            flat = np.concatenate(own) if own else np.zeros(0, X.U64)
            tokens = np.zeros((len(own), TREES * LEVELS), X.U64)
            if len(flat):
                begin = first[:-1][full]
                for j in range(TREES * LEVELS):
                    tokens[full, j] = np.minimum.reduceat((flat ^ _XOR[j]) * _MUL[j], begin)
            tokens = (X.mix(tokens) >> X.U64(32)).astype("<u4")
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in own]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(first)), pa.array(digest, pa.binary()), pa.array([t.tobytes() if g else None for t, g in zip(tokens, full)], pa.binary())],
                ["doc_id", "text_key", "n", "set", "tokens"],
            )

    return run


def _branches(batches):
    """(tree node at two, three and four tokens, set) of each class in each tree."""
    for batch in X.slices(batches, size=1 << 20):
        n = batch.num_rows
        t = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(n, TREES, LEVELS).astype(X.U64)
        node = X.mix(t[:, :, 0] + (np.arange(TREES, dtype=X.U64) + X.U64(1)) * _P)
        at = []
        for level in range(1, LEVELS):
            node = X.mix(node * _P + t[:, :, level])
            at.append(pa.array(node.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([*at, batch.column(0).take(pa.array(np.repeat(np.arange(n), TREES)))], [*(f"node{k}" for k in range(2, LEVELS + 1)), "set"])


def _runs(batches, key: int):
    """Tables of whole groups from batches sorted by column `key`; several groups at a time."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1], side="left"))
        if held and held[-1].column(key)[-1].as_py() == k[-1]:
            held.append(batch)
            continue
        held.append(batch.slice(0, cut))
        whole = pa.Table.from_batches(held)
        if whole.num_rows:
            yield whole
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _alike(batches):
    """Edges (a, b) that link the members of each node whose sketches are alike; columns: leaf, set id, sketch."""
    for whole in _runs(batches, 0):
        leaf = whole.column(0).to_numpy()
        ids = whole.column(1).to_numpy()
        sketch = np.frombuffer(b"".join(whole.column(2).to_pylist()), np.uint8).reshape(len(leaf), -1)
        begin = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
        size = np.diff(np.append(begin, len(leaf)))
        left = np.repeat(begin + size, size) - np.arange(len(leaf)) - 1  # later members of the same node
        label = np.arange(len(leaf))
        total = np.concatenate([[0], np.cumsum(left)])
        links = []
        a = 0
        while a < len(leaf):
            b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, side="right")) - 1)
            x = np.repeat(np.arange(a, b), left[a:b])
            y = np.arange(len(x)) - np.repeat(total[a:b] - total[a], left[a:b]) + x + 1
            good = (sketch[x] == sketch[y]).sum(1) >= ALIKE
            links.append(np.stack([x[good], y[good]]))
            a = b
        x, y = np.concatenate(links, 1)
        while len(x):
            before = label.copy()
            low = np.minimum(label[x], label[y])
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            label = label[label]
            if (label == before).all():
                break
        at = np.flatnonzero((label != np.arange(len(leaf))) & (ids != ids[label]))
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[label[at]])], ["a", "b"])


def resolve(members: list[np.ndarray], group: np.ndarray, ask: np.ndarray, similarity=SIMILARITY) -> np.ndarray:
    """Group of each member after all links between different groups are known.

    A pair is unknown while neither of its members has been compared with all
    others; only members in `ask` are compared.  They go by the smallest group
    first, and those whose own group is the only one left with unknown pairs
    needn't.
    """
    n = len(members)
    group, open_ = group.copy(), ask.copy()
    size = np.array([len(m) for m in members], np.int64)
    flat = np.concatenate(members)
    _, code = np.unique(flat, return_inverse=True)
    first = np.cumsum(size) - size
    mark = np.zeros(int(code.max()) + 1, np.int32)
    whole = bool(ask.all())
    while open_.any():
        names, count = np.unique(group[open_], return_counts=True)
        if whole and len(names) == 1:
            break
        name = names[np.argmin(count)]
        i = int(np.flatnonzero(open_ & (group == name))[0])
        own = code[first[i] : first[i] + size[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[code], first)
        mark[own] = 0
        linked = similarity[1] * both >= similarity[0] * (size[i] + size - both)
        open_[i] = False
        joined = np.unique(group[linked])
        if len(joined) > 1:
            group[np.isin(group, joined)] = joined[0]
    return group


def _confirmed(similarity):
    """Edges (set, root) within each sorted key; columns: key, set, shingles, ask, root.
    Members of equal roots are one group from the start."""

    def run(batches):
        for whole in _runs(batches, 0):
            key = whole.column(0).to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(begin[1:], len(key))
            name, held = whole.column(1).to_pylist(), whole.column(2)
            asked, roots = np.asarray(whole.column(3).to_numpy(), bool), whole.column(4).to_pylist()
            a_out, b_out = [], []
            for a, b in zip(begin.tolist(), ends.tolist()):
                seen: dict[bytes, int] = {}
                for i in range(a, b):
                    if name[i] not in seen or asked[i]:
                        seen[name[i]] = i
                rows = list(seen.values())
                if len(rows) < 2:
                    continue
                _, start = np.unique([(roots[i] or name[i]).hex() for i in rows], return_inverse=True)
                group = resolve([np.frombuffer(held[i].as_py(), np.uint64) for i in rows], start, asked[rows], similarity)
                least: dict[int, bytes] = {}
                for i, g in zip(rows, group.tolist()):
                    least[g] = min(least.get(g, name[i]), name[i])
                for i, g in zip(rows, group.tolist()):
                    if name[i] != least[g]:
                        a_out.append(name[i])
                        b_out.append(least[g])
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.binary()), pa.array(b_out, pa.binary())], ["a", "b"])

    return run


def _sorted_by(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key)


def _leaves(classes: DataFrame) -> DataFrame:
    """(leaf, id, sketch) of the tree nodes with two members at least."""
    spread = classes.select("set", "tokens").mapInArrow(_branches, ", ".join(f"node{k} long" for k in range(2, LEVELS + 1)) + ", set binary")
    leaves, rows = [], spread
    for level in range(2, LEVELS + 1):
        node = f"node{level}"
        count = rows.groupBy(node).agg(F.count(F.lit(1)).alias("members"), F.min("set").alias("shared")).where("members > 1")
        rows = rows.join(count, node)
        if level == 2:
            rows = written(rows)
        if level < LEVELS:
            leaves.append(rows.where(f"members <= {SMALL}").select(F.col(node).alias("leaf"), "set"))
            rows = rows.where(f"members > {SMALL}").drop("members", "shared")
        else:
            blocks = F.ceil(F.col("members") / SMALL)
            leaves.append(rows.select(F.xxhash64(node, F.pmod(F.xxhash64(node, "set"), blocks)).alias("leaf"), "set"))
            # one member stands in all blocks of its node
            shared = count.where(f"members > {SMALL}").select(node, F.col("shared").alias("set"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("members") / SMALL) - 1)).alias("block"))
            leaves.append(shared.select(F.xxhash64(node, "block").alias("leaf"), "set"))
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    # a node's chance members have no partner later; a leaf keeps its rows whole
    sketch = classes.select("set", F.col("id"), F.col("sketch"))
    return out.join(sketch, "set").select("leaf", "id", "sketch")


def _sketches(batches):
    for batch in X.slices(batches, size=1 << 22):
        n = batch.num_rows
        low = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(n, TREES * LEVELS, 4)[:, :, 0]
        ids = np.frombuffer(b"".join(s[:8] for s in batch.column(0).to_pylist()), "<i8")
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids), pa.array([r.tobytes() for r in low], pa.binary())], [*batch.schema.names, "id", "sketch"])


def _full_sets(k: int):
    def run(batches):
        for batch in X.slices(batches, size=1 << 22):
            own = sets(batch.column(2), k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.tobytes() for s in own], pa.binary())], ["cluster", "set", "shingles"])

    return run


def similar_sets(documents: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of `documents`.

    Rows are linked if similarity[1] * intersection >= similarity[0] * union of
    their shingle sets; component_id is the least id reachable.  Null and empty
    texts, and texts without words, have an empty set, are linked with nothing
    and are their own component.  Rows of equal ids are linked by their texts
    like any others.  A component without any id has a null component_id, and
    its rows are kept.  Columns other than doc_id and text are ignored.
    """
    small_batches(documents.sparkSession)
    rows = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    kind = dict(documents.dtypes)["doc_id"]
    signed = written(rows.select("doc_id", "text_key", "text").mapInArrow(_signed_rows(shingle), f"doc_id {kind}, text_key long, n long, set binary, tokens binary"))
    classes = signed.where("set is not null").groupBy("set").agg(F.min(F.struct("doc_id", "text_key")).alias("who"), F.min("doc_id").alias("least"), F.first("tokens").alias("tokens"))
    classes = classes.select("set", F.col("who.doc_id").alias("doc_id"), F.col("who.text_key").alias("text_key"), "least", "tokens")
    classes = written(classes.mapInArrow(_sketches, f"set binary, doc_id {kind}, text_key long, least {kind}, tokens binary, id long, sketch binary"))
    linked = _sorted_by(_leaves(classes), "leaf").mapInArrow(_alike, "a long, b long").distinct()
    clusters = components(linked).select(F.col("node").alias("id"), F.col("root").alias("cluster"))
    members = written(classes.join(clusters, "id").select("doc_id", "text_key", "set", "cluster"))
    # members grow with the corpus, so they are never broadcast
    found = members.hint("merge").join(rows.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "text"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")))
    full = written(found.select("cluster", "set", "text").mapInArrow(_full_sets(shingle), "cluster long, set binary, shingles binary"))
    roots = _confirm(full, members, similarity)
    named = classes.select("set", "least").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = written(named.join(least, "root").select("set", "component_id"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "set").join(ids, "set", "left")
    component = F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _confirm(full: DataFrame, members: DataFrame, similarity) -> DataFrame:
    """(set, root) of the classes that have links, from clusters with full sets."""
    edge = "a binary, b binary"
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("classes"))
    large = written(size.where(F.col("classes") > CLUSTER))
    some = large.count()
    plain = full if not some else full.join(large, "cluster", "left_anti")
    yes, no = F.lit(True), F.lit(None).cast("binary")
    direct = _sorted_by(plain.select("cluster", "set", "shingles", yes.alias("ask"), no.alias("root")), "cluster").mapInArrow(_confirmed(similarity), edge)
    direct = direct.select(F.col("a").alias("set"), F.col("b").alias("root"))
    if not some:
        return direct
    # Blocks of large clusters: own classes and the cluster's pivots, its least digests.
    dealt = written(full.join(large, "cluster").withColumn("blocks", F.ceil(F.col("classes") / (CLUSTER // 2))).withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks"))))
    order = Window.partitionBy("cluster").orderBy("set")
    chosen = dealt.select("cluster", "set").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PIVOTS).select("cluster", "set").distinct()
    pivots = dealt.join(chosen, ["cluster", "set"]).dropDuplicates(["cluster", "set"])
    pivots = pivots.select("cluster", "set", "shingles", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    key = F.xxhash64("cluster", "block").alias("key")
    first = dealt.select(key, "set", "shingles", yes.alias("ask"), no.alias("root")).unionByName(pivots.select(key, "set", "shingles", yes.alias("ask"), no.alias("root")))
    edges = written(_sorted_by(first, "key").mapInArrow(_confirmed(similarity), edge))
    groups = written(components(edges).select(F.col("node").alias("set"), "root"))
    held = dealt.join(groups, "set", "left").withColumn("root", F.coalesce("root", "set"))
    number = held.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"))
    main = number.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.greatest(F.lit(1), F.ceil((F.sum("n") - F.max("n")) / (CLUSTER // 4))).alias("parts"))
    held = written(held.join(main, "cluster"))
    # Classes outside the main group, in parts, meet every block of their cluster.
    rest = held.where("root != main").withColumn("part", F.pmod(F.hash("set"), F.col("parts")))
    ask = rest.select("cluster", "set", "shingles", "root", "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    parts = rest.select("cluster", "part").distinct()
    met = held.join(parts, "cluster").select(F.xxhash64("cluster", "block", "part").alias("key"), "set", "shingles", F.lit(False).alias("ask"), "root")
    second = met.unionByName(ask.select(F.xxhash64("cluster", "block", "part").alias("key"), "set", "shingles", yes.alias("ask"), "root"))
    more = _sorted_by(second, "key").mapInArrow(_confirmed(similarity), edge)
    joined = components(edges.unionByName(more)).select(F.col("node").alias("set"), "root")
    return direct.unionByName(joined)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents"), shingle=QUERY_SHINGLE)


#: Compares all documents that share a shingle: for tables whose ids occur once.
SQL6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {QUERY_SHINGLE - 1}, 1) + 1)) AS k FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[k : k + least({QUERY_SHINGLE}, len(w)) - 1], ' ')) AS g FROM e),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE {SIMILARITY[1]} * c >= {SIMILARITY[0]} * (x.n + y.n - c)),
m AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM m UNION SELECT r.a, m.b FROM r JOIN m ON r.b = m.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, c.least) AS component_id, d.doc_id = least(d.doc_id, c.least) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.a
"""


def without_near_duplicates(documents: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The rows of `documents` whose id is their component's."""
    kept = similar_sets(documents, shingle, similarity).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return documents.join(kept, documents["doc_id"].eqNullSafe(kept["__kept"]), "left_semi")
