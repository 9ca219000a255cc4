"""Byte-owner alignment against a two-pointer walk over tokens of the vocabularies' own files."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from loomgrid.llm import alignment


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    byte.encode_special_tokens = True
    return byte, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as they are, and the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def walk(models, text):
    """(n_a, n_b, groups, links) or None."""
    if not text:
        return None
    byte, piece = models
    letters = byte_letters()
    a, b = byte.encode(" " + text, add_special_tokens=False).ids, piece.encode(text)
    raw_a = [bytes(letters[c] for c in byte.id_to_token(k)) for k in a]
    raw_b = [bytes([int(piece.id_to_piece(k)[3:5], 16)]) if piece.is_byte(k) else piece.id_to_piece(k).replace("▁", " ").encode() for k in b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
    links, i, j = [], 0, 0
    while i < len(a):
        links.append((a[i], b[j]))
        x, y = ends_a[i], ends_b[j]
        i, j = i + (x <= y), j + (y <= x)
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
        i, j = k, m
    return len(a), len(b), ";".join(groups), links


PARTS = [" ", "  ", "\n", "\t", "a", "B", "the", "word", "ing", "'s", "'ll", "12", "7", "é", "漢", "字", "😀", "▁", " ", "́", "<|endoftext|>", "<s>", "<0x0A>", "...", "--", "\r\n", "\x1c", "ﬁ", "​", "#", "_", "=="]


def texts(n=400):
    rng = random.Random(1)
    return [None, "", " ", "\n", "x " * 3000, "y" * 5000, "word\n\n word \n", *("".join(rng.choices(PARTS, k=rng.randrange(1, 40))) for _ in range(n))]


def test_words_apart_and_whole(models):
    x = alignment.aligner(public_tokenizers.path(alignment.BYTE_RANKS), public_tokenizers.path(alignment.PIECE_MODEL))
    assert x.apart
    none = 0
    for t in filter(None, texts(3000)):
        words = x.words(t)
        known = dict(zip(words, x.align([x.chunk(w) for w in words]))) if words else {}
        got, want = x.text(t, known), walk(models, t)
        assert (got and (got[0], got[1], got[2].decode(), [(int(v) >> 32, int(v) & 0xFFFFFFFF) for v in got[3]])) == want, t
        if words:
            assert "".join(map(x.chunk, words)) == " " + t
        none += want is None
    assert 0 < none < 2500


def test_query(spark, tmp_path, models):
    rows = [(k if k != 5 else None, t, 7) for k, t in enumerate(texts())]
    rows += [(1, "x " * 3000, 7), (None, None, 7)]
    spark.createDataFrame(rows, "doc_id long, text string, links int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = [walk(models, t) for _, t, _ in rows]
    docs = collections.Counter(pair for f in found if f for pair in set(f[3]))
    best: dict[int, int] = collections.defaultdict(int)
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    want = collections.Counter(
        (r[0], f[0], f[1], f[2].count(";") + 1, len(f[3]), sum(docs[p] == best[p[0]] for p in f[3]), sum(docs[p] for p in f[3]), hashlib.sha256(f[2].encode()).hexdigest()) if f else (r[0], 0, 0, 0, 0, 0, 0, "")
        for r, f in zip(rows, found)
    )
    assert collections.Counter(map(tuple, alignment.query(spark, str(tmp_path)).collect())) == want
    # beyond the bound of the broadcast, pairs are shuffled
    most, alignment.MAX_PAIRS = alignment.MAX_PAIRS, 3
    try:
        assert collections.Counter(map(tuple, alignment.query(spark, str(tmp_path)).collect())) == want
    finally:
        alignment.MAX_PAIRS = most


def test_groups_spell_the_text(spark):
    docs = spark.createDataFrame([("Some words, and numbers 123.",)], "text string")
    r = docs.select(alignment.align(docs["text"]).alias("x")).first()["x"]
    x = alignment.aligner(public_tokenizers.path(alignment.BYTE_RANKS), public_tokenizers.path(alignment.PIECE_MODEL))
    for g in r["groups"].split(";"):
        a, b = ([int(k) for k in side.split(",")] for side in g.split("|"))
        assert b"".join(x.a_bytes[k] for k in a) == b"".join(x.b_bytes[k] for k in b)
    assert sum(v["n"] for v in r["links"]) == r["n_links"]
