"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary's pieces that end at each
place of a word; dynamic programming carries the best score and its number of
pieces, and no segmentation is built.  Ties go by the rule of the unigram
tokenizer: of paths with equal scores the one whose last piece starts first
stays.  An unknown character costs the lowest score less 10; neighbouring
unknown characters are one piece, or their bytes with byte fallback.

Words are cut as by a Metaspace pre-tokenizer: a space becomes U+2581 and
starts a word, and a text that doesn't start with one gets one.  A batch's
distinct words are counted once, and a worker keeps a bounded table of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import _text as X
from tallyforge.llm._frames import appended, table

FILE = "piece_bpe_32k.model"
SPACE = "▁"
PENALTY = 10.0
CACHE = 1_000_000

_NOT_BLANK = np.ones(256, bool)
_NOT_BLANK[0x20] = False


def load_vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """(piece, score) in id order from a sentencepiece file; control pieces included."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(FILE)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


class CountViterbi:
    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int = 0, byte_fallback: bool = False):
        import ahocorasick

        self.pieces = ahocorasick.Automaton()
        for k, (piece, score) in enumerate(vocabulary):
            if piece and piece not in self.pieces:
                self.pieces.add_word(piece, (len(piece), score, k == unknown))
        self.pieces.make_automaton()
        self.low = min(s for _, s in vocabulary) - PENALTY
        names = {p for p, _ in vocabulary}
        self.by_bytes = byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))
        self.cache: dict[int, tuple[int, float]] = {}

    def word(self, text: str) -> tuple[int, float]:
        """(pieces, score) of one word's best segmentation."""
        n = len(text)
        ends: list[list] = [[] for _ in range(n + 1)]
        for end, match in self.pieces.iter(text):
            ends[end + 1].append(match)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        unknown = [False] * (n + 1)  # whether the best path's last piece is the unknown one
        low, by_bytes = self.low, self.by_bytes
        for end in range(1, n + 1):
            best, of, single, is_unknown = None, 0, False, False
            for size, own, marked in ends[end]:  # longest first: the earliest start
                if size == 1:
                    single = True
                got = score[end - size] + own
                if best is None or got > best:
                    best, of, is_unknown = got, end - size, marked
            if not single:
                got = score[end - 1] + low
                if best is None or got > best:
                    best, of, is_unknown = got, end - 1, True
            score[end], unknown[end] = best, is_unknown
            if not is_unknown:
                count[end] = count[of] + 1
            elif by_bytes:
                count[end] = count[of] + len(text[of:end].encode("utf-8"))
            else:
                count[end] = count[of] + (not unknown[of])
        return count[n], score[n]


def counted(documents: DataFrame, vocabulary: list[tuple[str, float]], unknown: int = 0, byte_fallback: bool = False, text: str = "text") -> DataFrame:
    """All columns of `documents` plus n_pieces and piece_score.

    Null and empty texts have 0 pieces and score 0.  Texts are counted whole;
    repeated rows alike.  Input columns with a result's name are replaced.
    The vocabulary is a tokenizer's, whose size doesn't depend on the data.
    """
    shared = documents.sparkSession.sparkContext.broadcast((vocabulary, unknown, byte_fallback))

    def make():
        model = CountViterbi(*shared.value)

        def work(batch):
            column = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.string()), "")
            column = pc.replace_substring(column, SPACE, " ")
            data, offsets = X.buffers(column)
            if len(model.cache) > CACHE:
                model.cache.clear()
            pieces, scores = [], []
            blank = model.word(SPACE)
            for a, b in X.chunks(offsets):
                lo, hi = int(offsets[a]), int(offsets[b])
                part, own = data[lo : hi + 8], offsets[a : b + 1] - lo
                starts, ends, first = X.words(part, own, _NOT_BLANK)
                hashes = X.hash_spans(part, starts, ends)
                distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                known = list(map(model.cache.get, distinct.tolist()))
                for k, got in enumerate(known):
                    if got is None:
                        i = at[k]
                        known[k] = got = model.word(SPACE + part[starts[i] : ends[i]].tobytes().decode("utf-8"))
                        model.cache[int(distinct[k])] = got
                n = np.concatenate([[0], np.cumsum(np.array([x[0] for x in known], np.int64)[inverse])]) if len(known) else np.zeros(1, np.int64)
                s = np.array([x[1] for x in known])[inverse] if len(known) else np.zeros(0)
                size = np.diff(own)
                spaces = np.concatenate([[0], np.cumsum(part[: hi - lo] == 0x20)])
                lead = np.where(size > 0, part[np.minimum(own[:-1], max(0, hi - lo - 1))] == 0x20, False) if hi > lo else np.zeros(len(size), bool)
                empty = np.where(size > 0, spaces[own[1:]] - spaces[own[:-1]] + 1 - lead - np.diff(first), 0)
                pieces.append(n[first[1:]] - n[first[:-1]] + empty * blank[0])
                scores.append(np.bincount(np.repeat(np.arange(len(size)), np.diff(first)), weights=s, minlength=len(size)) + empty * blank[1])
            return [pa.array(np.concatenate(pieces).astype(np.int64)), pa.array(np.concatenate(scores))]

        return work

    return appended(documents, make, "n_pieces long, piece_score double")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = counted(table(spark, sf_dir, "documents").select("doc_id", "text"), load_vocabulary())
    return out.select("doc_id", "n_pieces", "piece_score")
