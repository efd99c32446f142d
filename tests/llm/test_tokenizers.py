"""BPE and piece counts against the public tokenizer library."""

import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer, models, pre_tokenizers

from tallyforge.llm import bpe, token_counts

PARTS = ["a", "b", " ", "  ", "\n", "é", "the", "ing", "'s", "12", "🙂", "<|endoftext|>", "<", "xxxx", "\t", "中", "...", "\x00", "▁", "<s>", "of", "Th"]


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randrange(0, 25))) for _ in range(n)] + ["", " ", "the " * 3000, "ab" * 4000, " lead", "trail "]


def test_encode(spark):
    t = Tokenizer.from_file(public_tokenizers.path(bpe.FILE))
    rows = [(i, s, 1) for i, s in enumerate(texts(400, 1))] + [(-1, None, 1), (None, "the", 2), (0, "the", 2), (0, "the", 2)]
    got = bpe.encoded(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()
    assert len(got) == len(rows)
    for g in got:
        ids = t.encode(g.text or "", add_special_tokens=False).ids
        assert g.ids == ids and g.n_tokens == len(ids) and g.round_trip
        assert g.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_definition():
    b = bpe.PrefixBpe(public_tokenizers.path(bpe.FILE))
    r = random.Random(3)
    for _ in range(300):
        raw = bytes(r.choice(b"aeinrst o\xc3\xa9") for _ in range(r.randrange(1, 30)))
        assert b.piece(raw) == b.merge(raw)


def test_counts(spark):
    vocabulary = token_counts.load_vocabulary()
    rows = [(i, s, 5) for i, s in enumerate(texts(400, 2))] + [(-1, None, 1), (0, "x", 1), (0, "x", 1)]
    for fallback in (False, True):
        t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=fallback))
        t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_counts.SPACE, prepend_scheme="always", split=True)
        df = spark.createDataFrame(rows, "doc_id long, text string, n_pieces int")
        got = token_counts.counted(df, vocabulary, byte_fallback=fallback).collect()
        assert len(got) == len(rows)
        for g in got:
            e = t.encode(g.text or "", add_special_tokens=False)
            assert g.n_pieces == len(e.ids), (g.text, g.n_pieces, e.tokens)
            if not fallback and 0 not in e.ids:
                assert abs(g.piece_score - sum(vocabulary[i][1] for i in e.ids)) < 1e-6 * max(1, abs(g.piece_score))


def test_ties():
    t = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -2.0), ("bc", -2.0), ("abc", -3.0), (token_counts.SPACE, -1.0)]
    lib = Tokenizer(models.Unigram(t, unk_id=0))
    model = token_counts.CountViterbi(t)
    r = random.Random(4)
    for _ in range(500):
        s = "".join(r.choice("abcd") for _ in range(r.randrange(1, 12)))
        assert model.word(s)[0] == len(lib.encode(s).ids), s
