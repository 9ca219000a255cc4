"""Token counts by trie-shared dynamic programming.

A unigram segmentation's forward score at a prefix doesn't depend on what follows. The distinct pre-tokens of a
batch are inserted in a trie (its unbranched paths are one node, so a word of any length is); a walk from the root
scores each shared prefix once and stores the token count of the best segmentation at each terminal. The pieces
that end at a character are found by walking back through a trie of the reversed pieces.

The vocabulary is that of a given subword model; as it has ranks and no probabilities, pieces get Zipf
log-probabilities by rank. A character outside the vocabulary counts as its UTF-8 bytes. Ties go to fewer tokens.

Edge cases: null and empty texts have 0 tokens; texts and words of any length are read whole; equal rows get equal
counts; an empty table gives an empty result; other columns pass through, whatever they are called.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache
from os.path import commonprefix

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Texts are taken together until they hold so many characters.
BATCH_CHARS = 2_000_000


@dataclass(frozen=True)
class Vocabulary:
    """scores: log-probability by piece; endings: trie of the reversed pieces, with the score at "" where a piece is whole."""

    scores: dict[str, float]
    endings: dict
    missing: float

    @staticmethod
    def ranked(pieces: list[str]) -> Vocabulary:
        """Pieces in order of rank, with Zipf log-probabilities."""
        total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
        scores: dict[str, float] = {}
        for r, p in enumerate(pieces):
            scores.setdefault(p, -math.log(r + 1) - total)
        endings: dict = {}
        for p, score in scores.items():
            node = endings
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = score
        return Vocabulary(scores, endings, min(scores.values(), default=0.0) - 10)


@cache
def vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    # pieces of one character rank last in the file, by their own order; longer ones by merge order
    return Vocabulary.ranked([m.id_to_piece(i) for i in sorted(usable, key=lambda i: -m.get_score(i))])


class Trie:
    """Words by shared prefix. A node is [characters on the way to it, children by first character, ends a word]."""

    def __init__(self, words):
        self.root = ["", {}, False]
        for w in words:
            self.insert(w)

    def insert(self, word: str) -> None:
        node, at = self.root, 0
        while at < len(word):
            child = node[1].get(word[at])
            if child is None:
                node[1][word[at]] = [word[at:], {}, True]
                return
            way = child[0]
            if not word.startswith(way, at):  # the path forks inside this node
                same = len(commonprefix((way, word[at : at + len(way)])))
                node[1][word[at]] = fork = [way[:same], {way[same]: child}, False]
                child[0] = way[same:]
                child = fork
            node, at = child, at + len(child[0])
        node[2] = True

    def counts(self, v: Vocabulary) -> dict[str, int]:
        """Token count of each word; each character of the trie is scored once."""
        out: dict[str, int] = {}
        text: list[str] = []  # the characters from the root to here, and the best (score, -tokens) after each
        best = [(0.0, 0)]
        stack = [(self.root, 0)]
        while stack:
            node, depth = stack.pop()
            del text[depth:], best[depth + 1 :]
            for char in node[0]:
                text.append(char)
                top, at, ending = None, len(text), v.endings
                while at > 0:
                    at -= 1
                    ending = ending.get(text[at])
                    if ending is None:
                        break
                    p = ending.get("")
                    if p is not None:
                        s, k = best[at]
                        if top is None or (s + p, k - 1) > top:
                            top = (s + p, k - 1)
                if char not in v.scores:
                    n = len(char.encode("utf-8", "surrogatepass"))
                    s, k = best[-1]
                    if top is None or (s + n * v.missing, k - n) > top:
                        top = (s + n * v.missing, k - n)
                best.append(top)
            if node[2]:
                out["".join(text)] = -best[-1][1]
            stack += [(child, len(text)) for child in node[1].values()]
        return out


def trie_counts(words, v: Vocabulary) -> dict[str, int]:
    """Token count of each of the distinct ``words``."""
    return Trie(words).counts(v)


def token_counts(text: Column, model_path: str | None = None) -> Column:
    """(n_words, n_tokens) of a whole text. ``model_path``: a subword model's file on every worker."""
    path, memo = model_path or public_tokenizers.path(MODEL), []

    def arrow(texts: pa.Array) -> pa.Array:
        memo[:] = memo or [WordCache(lambda w: 0)]
        known, n_words, n_tokens, group, chars = memo[0].take(), [], [], [], 0

        def settle() -> None:
            new = {w for words in group for w in words if w not in known}
            moved = {w: known.last[w] for w in new if w in known.last}
            counts = trie_counts((MARK + w.decode("utf-8", "replace") for w in new if w not in moved), vocabulary(path))
            for w in new:
                known.add(w, moved[w] if w in moved else counts[MARK + w.decode("utf-8", "replace")])
            for words in group:
                n_words.append(len(words))
                n_tokens.append(sum(map(known.__getitem__, words)))
            group.clear()
            known.trim()

        for t in texts:
            raw = (t.as_py() or "").encode()
            group.append(raw.split())
            chars += len(raw)
            if chars >= BATCH_CHARS:
                settle()
                chars = 0
        settle()
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["n_words", "n_tokens"])

    return F.arrow_udf(arrow, "struct<n_words:bigint,n_tokens:bigint>")(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_counts(F.col("text")).alias("c")).select("doc_id", "c.*")
