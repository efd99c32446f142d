"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece exactly one token can end its encoding.  The
candidates are the vocabulary's matches that end at the prefix, which a
suffix-link automaton enumerates in one pass; a candidate is the right one if
the token before it, already stored for the shorter prefix, and it form a
compatible pair, that is, if merging their joined bytes gives them back.  The
ids follow from the back-pointers.

Texts are first cut as the byte-level pre-tokenizer cuts them, with the
vocabulary's special tokens taken out before.  A cut piece's ids are kept in a
bounded table of each worker, so frequent pieces are encoded once.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm._frames import appended, table

FILE = "byte_bpe_50k.json"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces in each half of a worker's table.  When the young half is full it
#: becomes the old one, so pieces not met for a while go.
CACHE = 300_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(FILE)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class PrefixBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_chars())}
        vocab = spec["model"]["vocab"]
        raw = {t: bytes(back[c] for c in t) for t in vocab if all(c in back for c in t)}
        self.bytes_of = [b""] * (max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1)
        for t, b in raw.items():
            self.bytes_of[vocab[t]] = b
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.rank, self.parts = {}, {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair, joined = (vocab[a], vocab[b]), vocab[a + b]
            self.rank[pair] = (k, joined)
            self.parts.setdefault(joined, (k, *pair))
        # a token's own merge number; single bytes were never merged
        self.made = [-1] * len(self.bytes_of)
        for t, (k, _, _) in self.parts.items():
            self.made[t] = k
        own = {}
        for t, b in raw.items():
            i = vocab[t]
            if t not in self.special and (len(b) == 1 or i in self.parts):
                own[i] = b
        # tokens whose own bytes merge to something else never end a prefix
        self.single = {b[0]: i for i, b in own.items() if len(b) == 1}
        self.links = ahocorasick.Automaton()
        for i, b in own.items():
            if self.merge(b) == [i]:
                self.links.add_word(b.decode("latin-1"), (len(b), i))
        self.links.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.cut = regex.compile(PATTERN)
        self.cut_special = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.flat, self.size, self.at = np.frombuffer(b"".join(self.bytes_of), np.uint8), size, np.cumsum(size) - size

    def merge(self, raw: bytes) -> list[int]:
        """Merges in rank order, leftmost first: the definition."""
        out = [self.single[b] for b in raw]
        while len(out) > 1:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(out, out[1:])) if p in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            out[i : i + 2] = [self.rank[out[i], out[i + 1]][1]]
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether the joined bytes of two tokens are encoded as these two.

        The merges that built both sides are taken back, latest first.  A merge
        across the seam that would have come before the one taken back last
        breaks the pair.
        """
        key = (left, right)
        known = self.fits.get(key)
        if known is not None:
            return known
        limit, good, rank, parts, made = 1 << 60, True, self.rank, self.parts, self.made
        while True:
            m = rank.get((left, right))
            if m is not None and m[0] < limit:
                good = False
                break
            a, b = made[left], made[right]
            if a < 0 and b < 0:
                break
            # of equal merges the left one came first, so the right one is taken back first
            if a > b:
                limit, left = a, parts[left][2]
            else:
                # a seam merge of the same number stands further left and comes before it
                limit, right = b + 1, parts[right][1]
        if len(self.fits) >= 2_000_000:
            self.fits.clear()
        self.fits[key] = good
        return good

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one piece."""
        n = len(raw)
        if n == 1:
            return [self.single[raw[0]]]
        last = [-1] * (n + 1)  # the last token of each prefix
        back = [0] * (n + 1)
        ends: list[list] = [[] for _ in range(n + 1)]
        for end, match in self.links.iter(raw.decode("latin-1")):
            ends[end + 1].append(match)
        fits, compatible = self.fits, self.compatible
        for end in range(1, n + 1):
            for size, token in ends[end]:
                start = end - size
                if start:
                    key = (last[start], token)
                    good = fits.get(key)
                    if good is None:
                        good = compatible(*key)
                    if not good:
                        continue
                last[end], back[end] = token, start
                break
        out, end = [], n
        while end:
            out.append(last[end])
            end = back[end]
        return out[::-1]

    def packed(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.cut_special is None or "<" not in text or not self.cut_special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut_special.finditer(text):
            out += [self._plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        pieces = self.cut.findall(text)
        if len(self.cache) > CACHE:
            self.cache, self.old = {}, self.cache
        cache, old = self.cache, self.old
        out = list(map(cache.get, pieces))
        if None in out:
            for i, got in enumerate(out):
                if got is None:
                    p = pieces[i]
                    got = cache.get(p) or old.get(p) or np.array(self.piece(p.encode("utf-8")), "<u4").tobytes()
                    if len(p) <= 64:
                        cache[p] = got
                    out[i] = got
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, token after token."""
        ids = ids.astype(np.int64)
        size = self.size[ids]
        total = int(size.sum())
        shift = np.repeat(self.at[ids] - (np.cumsum(size) - size), size)
        return self.flat[np.arange(total) + shift].tobytes()

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", errors="replace")


_WORKER: dict[str, PrefixBpe] = {}


def worker(path: str) -> PrefixBpe:
    """One encoder for each Python worker and file."""
    if path not in _WORKER:
        _WORKER[path] = PrefixBpe(path)
    return _WORKER[path]


def encoded(documents: DataFrame, path: str | None = None, text: str = "text", with_ids: bool = True) -> DataFrame:
    """All columns of `documents` plus n_tokens, ids (array of int, unless
    `with_ids` is false), ids_sha256, decoded_sha256 and round_trip (whether
    decoding the ids gives the text back).

    Null and empty texts have no ids; null counts as the empty text.  Texts of
    any length are encoded whole; repeated rows are encoded alike.  Input
    columns with a result's name are replaced.  `path` must be readable on
    every executor, as an installed tokenizer file is.
    """
    fields = "n_tokens long, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string, round_trip boolean"

    def make():
        bpe = worker(path or default_path())

        def work(batch):
            count, ids, id_sha, text_sha, same = [], [], [], [], []
            for t in batch.column(batch.schema.get_field_index(text)):
                t = t.as_py() or ""
                raw = bpe.packed(t)
                got = np.frombuffer(raw, "<u4")
                back = bpe.decode_bytes(got)
                count.append(len(got))
                if with_ids:
                    ids.append(got.astype(np.int32))
                id_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(back).hexdigest())
                same.append(back == t.encode("utf-8"))
            lists = []
            if with_ids:
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(flat))]
            return [pa.array(count, pa.int64()), *lists, pa.array(id_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(same, pa.bool_())]

        return work

    return appended(documents, make, fields, size=4 << 20)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip")
