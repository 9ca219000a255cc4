"""Alignment of two tokenizers' tokens over the same bytes, by byte-owner arrays.

Every byte of " " + text has an owner, a token index, under A (byte-level BPE) and under B (sentence pieces):
``np.repeat`` of the indices over the tokens' byte lengths. Where either owner changes a new overlapping pair begins;
where both change at once both tokenizers cut, and the tokens between two cuts are a group. All new words of an Arrow
batch lie in one pair of owner arrays.

Neither tokenizer joins a space or line feed to a visible character before it, so a text is taken apart there and the
alignment of a word is kept in a bounded cache; what can't be taken apart so (see ``Aligner.text``) is aligned whole.

Edge cases: a text that is null, empty, or whose tokens of A or B don't spell " " + text has no tokens (counts 0,
groups ""); texts of special tokens are plain text; texts of any length are read whole; equal rows get equal results;
an empty table gives an empty result; other columns pass through, whatever they are called.
"""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, WordCache, materialize, meet, table

#: A's ranks: the vocabulary of byte_bpe_50k.json; B's model.
BYTE_RANKS, PIECE_MODEL = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
MARK = "▁"
#: Id pairs are broadcast up to so many; beyond, hot ones are and the rest is shuffled.
MAX_PAIRS = 1_000_000
#: Longer words are aligned each time instead of cached; new words are aligned together up to so many characters.
CACHED_CHARS, TOGETHER_CHARS = 64, 1 << 20
_SPLIT = re.compile(r"(?<=\S)(?=[ \n])")
_SPACES = re.compile(r"\s[ \n]")


def decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0..size-1, left-aligned in a byte matrix with room for a separator, and how many there are of each."""
    width = len(str(max(size - 1, 0)))
    text = np.array([str(k) for k in range(size)], dtype=f"S{width + 1}")
    return text.view(np.uint8).reshape(size, width + 1), np.char.str_len(text).astype(np.int64)


class Aligner:
    def __init__(self, ranks_path: str, model_path: str):
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.a_bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.a_bytes[rank] = token
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)]
        self.mark = self.b.piece_to_id(MARK)
        # words can be aligned by themselves if no piece goes on after a visible character with a space, or holds a line feed
        self.apart = not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.digits, self.n_digits = decimals(max(len(self.a_bytes), len(self.b_bytes)))

    def tokens_b(self, chunks: list[str]) -> list[list[int] | None]:
        """B's ids of each chunk; the model puts a space before it, which a chunk's own space is taken for."""
        out: list[list[int] | None] = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        for k, c in enumerate(chunks):
            if c[0] != " ":
                out[k] = out[k][1:] if out[k] and out[k][0] == self.mark else None
        return out

    def align(self, chunks: list[str]) -> list[tuple[int, int, bytes, bytes] | None]:
        """(n_a, n_b, groups, links) of each chunk, as two counts, text and 64-bit numbers a * 2^32 + b; None if B's or A's tokens don't spell it."""
        raw = [c.encode() for c in chunks]
        a, b = [self.a.encode_ordinary(c) for c in chunks], self.tokens_b(chunks)
        spelled = [y is not None and b"".join(map(self.b_bytes.__getitem__, y)) == r == b"".join(map(self.a_bytes.__getitem__, x)) for r, x, y in zip(raw, a, b)]
        found: list[tuple[int, int, bytes, bytes] | None] = [None] * len(chunks)
        ok = [k for k, s in enumerate(spelled) if s and raw[k]]
        if not ok:
            return found
        n_a, n_b = (np.array([len(x[k]) for k in ok], np.int64) for x in (a, b))
        ids_a, ids_b = (np.concatenate([np.asarray(x[k], np.int64) for k in ok]) for x in (a, b))
        size_a, size_b = self.a_sizes[ids_a], self.b_sizes[ids_b]
        own_a, own_b = np.repeat(np.arange(len(ids_a)), size_a), np.repeat(np.arange(len(ids_b)), size_b)
        new_a, new_b = own_a[1:] != own_a[:-1], own_b[1:] != own_b[:-1]
        starts = np.concatenate([[0], np.flatnonzero(new_a | new_b) + 1])
        cuts = np.flatnonzero(new_a & new_b) + 1
        links = (ids_a[own_a[starts]] << 32) | ids_b[own_b[starts]]
        # tokens by group, A's before B's, each followed by its separator
        group_a, group_b = (np.searchsorted(cuts, np.cumsum(s) - s, side="right") for s in (size_a, size_b))
        at_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a, side="left")
        at_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, side="right")
        ids, ends = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = ids_a, ids_b
        ends[at_a[np.append(group_a[1:] != group_a[:-1], True)]] = ord("|")
        ends[at_b[np.append(group_b[1:] != group_b[:-1], True)]] = ord(";")
        n, text = self.n_digits[ids], self.digits[ids]
        text[np.arange(len(ids)), n] = ends
        spelt = text[np.arange(text.shape[1]) <= n[:, None]].tobytes()
        upto = np.concatenate([[0], np.cumsum(n + 1)])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        over = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(raw[k]) for k in ok])])).tolist()
        for j, k in enumerate(ok):
            found[k] = (len(a[k]), len(b[k]), spelt[upto[j] : upto[j + 1] - 1], links[over[j] : over[j + 1]].tobytes())
        return found

    def words(self, text: str) -> list[str] | None:
        """Keys of the words of " " + text: a word without its space, or one that starts with a line feed; others after an added space."""
        if not self.apart or text[-1].isspace():
            return None
        if not (text[0] in " \n" or _SPACES.search(text)):
            return text.replace("\n", " \n").split(" ")
        return [c[1:] if c[0] == " " and c[1] not in " \n" else c if c[0] == "\n" and c[1] not in " \n" else " " + c for c in _SPLIT.split(" " + text)]

    @staticmethod
    def chunk(key: str) -> str:
        return key[1:] if key[0] == " " else key if key[0] == "\n" else " " + key

    def text(self, text: str, known: dict) -> tuple[int, int, bytes, np.ndarray] | None:
        """(n_a, n_b, groups, links) of a text whose words ``known`` holds; aligned whole if it can't be taken apart."""
        words = self.words(text)
        parts = [known[w] if len(w) <= CACHED_CHARS else None for w in words] if words else [None]
        if None in parts and words:
            long = [k for k, w in enumerate(words) if len(w) > CACHED_CHARS]
            for k, x in zip(long, self.align([self.chunk(words[k]) for k in long]) if long else []):
                parts[k] = x
        if None in parts:
            whole = self.align([" " + text])[0]
            return whole and (*whole[:3], np.frombuffer(whole[3], np.int64))
        return sum([x[0] for x in parts]), sum([x[1] for x in parts]), b";".join([x[2] for x in parts]), np.frombuffer(b"".join([x[3] for x in parts]), np.int64)


@cache
def aligner(ranks_path: str, model_path: str) -> Aligner:
    return Aligner(ranks_path, model_path)


_LINKS = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])


def align(text: Column, ranks_path: str | None = None, model_path: str | None = None) -> Column:
    """Alignment of a whole text: n_a, n_b, n_groups, n_links, groups ("a1,a2|b1;a3|b2,b3") and links, the distinct id pairs with their occurrences.

    ranks_path, model_path: files of the two tokenizers on every worker.
    """
    paths, memo = (ranks_path or public_tokenizers.path(BYTE_RANKS), model_path or public_tokenizers.path(PIECE_MODEL)), []

    def arrow(texts: pa.Array) -> pa.Array:
        x = aligner(*paths)
        memo[:] = memo or [WordCache(lambda w: None, size=lambda w, v: len(w) + (200 + len(v[2]) + len(v[3]) if v else 0))]
        known, counts, groups, lists, together = memo[0].take(), [], [], [], []

        def settle() -> None:
            new = {w for t in together if t for w in x.words(t) or () if w not in known and len(w) <= CACHED_CHARS}
            moved = {w: known.last[w] for w in new if w in known.last}
            fresh = [w for w in new if w not in moved]
            for w, v in [*moved.items(), *zip(fresh, x.align([x.chunk(w) for w in fresh]))]:
                known.add(w, v)
            for t in together:
                n_a, n_b, spelt, links = (t and x.text(t, known)) or (0, 0, b"", np.empty(0, np.int64))
                counts.append((n_a, n_b, spelt.count(b";") + 1 if spelt else 0, len(links)))
                groups.append(spelt.decode())
                lists.append(np.unique(links, return_counts=True))
            together.clear()
            known.trim()

        chars = 0
        for t in texts:
            together.append(t.as_py() or "")
            chars += len(together[-1])
            if chars >= TOGETHER_CHARS:
                settle()
                chars = 0
        settle()
        ids, n = (np.concatenate([np.empty(0, np.int64), *(v[k] for v in lists)]) for k in (0, 1))
        offsets = np.concatenate([[0], np.cumsum([len(v[0]) for v in lists])]).astype(np.int32)
        links = pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in (ids >> 32, ids & 0xFFFFFFFF, n)], fields=list(_LINKS))
        columns = [pa.array(np.array([c[k] for c in counts], np.int64)) for k in range(4)]
        return pa.StructArray.from_arrays([*columns, pa.array(groups, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), links)], names=["n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    return F.arrow_udf(arrow, "struct<n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups:string,links:array<struct<a:int,b:int,n:int>>>")(text)


def link_counts(links: DataFrame) -> DataFrame:
    """(a, b, docs, best) of rows (a, b), one for each document that holds the pair: how many do, and whether no pair of the same a is in more."""
    counts = materialize(links.groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs")), "link_counts", compact=True)
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return materialize(counts.join(most, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best")), "ranked_links", compact=True)


def link_scores(aligned: DataFrame, key: str, links: str) -> DataFrame:
    """(key, n_best, count_sum) of the rows of ``aligned`` with links: how many of a row's links are the best of their a, and the sum of their counts.

    aligned: a written table with a unique ``key``; ``links``: as ``align`` gives them.
    """
    rows = aligned.select(key, F.inline(links))
    ranked = link_counts(rows.select("a", "b"))
    if ranked.limit(MAX_PAIRS + 1).count() <= MAX_PAIRS:
        rows = rows.join(F.broadcast(ranked), ["a", "b"])
    else:
        rows = meet(rows, ranked.withColumn("rows", F.col("docs")), ["a", "b"])
    return rows.groupBy(key).agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as made:
        docs = table(spark, sf_dir, "documents").select("doc_id", align(F.col("text")).alias("x")).select("doc_id", "x.*")
        digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
        docs = materialize(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "links"), "aligned")
        out = docs.drop("links").join(link_scores(docs, "row", "links"), "row", "left")
        sums = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")}
        out = out.withColumns(sums).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
        return made.keep(materialize(out, "alignments", compact=True))
