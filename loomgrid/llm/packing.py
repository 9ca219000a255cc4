"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents are cut into pieces; pieces fall by row number into blocks of bounded size. A block evolves on several
islands, each of which starts from its own best-fit packings in random order. A child takes over whole well-filled
bins of one parent; bins of the other parent that hold the same pieces are taken apart, as are its emptiest, and what
they lose is put back best-fit. After each era an island's elite migrates to the next island of its block; the best
packing of a block stays. Blocks are independent tasks. The part-filled bins that blocks end with are then packed once
more, together, in the same way.

Edge cases: a null or empty text is one piece, the end id; texts of any length are cut into pieces of full length,
which fill a sequence alone, and a rest; equal rows, repeated and null ids are packed each; ties between packings go
to the earlier one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left, insort
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, materialize, table

LENGTH, END = 4096, 1
TOKENIZER = "word_bpe_49k.json"
#: A block holds about so many pieces. Each of its islands keeps so many packings, and breeds as many children a
#: generation; after each era elites migrate.
BLOCK_PIECES = 4096
ISLANDS, ERAS, POPULATION, GENERATIONS = 2, 2, 4, 4
#: Bins filled to this share may be injected whole; as many as this share of a child's bins, the emptiest, are taken apart.
WELL_FILLED, TAKEN_APART = 0.995, 0.1
#: A block ends with bins that are filled to less than this; they are packed with those of other blocks.
ENDS = 0.97
PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
#: Texts of these characters alone (ASCII, Latin and Cyrillic letters, common punctuation) are split here into the
#: tokenizer's pre-tokens and those looked up; others, and any with special tokens, are tokenised as a whole.
_OTHER = re.compile("[^\\t\\n\\r -~\\u00a1\\u00ab\\u00bb\\u00bf-\\u012f\\u0131-\\u0148\\u014a-\\u017e\\u0410-\\u044f\\u2013\\u2014\\u2018\\u2019\\u201c\\u201d\\u2026]|<\\|")
#: What an ASCII text must not hold: white space on which libraries differ, and the start of special tokens.
_BREAKS = ("\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: The split of word_bpe_49k.json, on lower-cased text of those characters.
_PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _ids(path: str, text: str) -> bytes:
    return np.asarray(_tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: 256 + k for k, b in enumerate(rest)}


@cache
def _chunks(path: str) -> WordCache:
    """Ids by text between white space; pre-tokens are such texts too."""
    letters, model = _byte_letters(), _tokenizer(path).model
    raw = [k.to_bytes(4, "little") for k in range(_tokenizer(path).get_vocab_size())]

    def pre_token(x: str) -> bytes:
        if not (x.isascii() and x.isprintable()):
            x = x.encode().decode("latin-1").translate(letters)
        return b"".join([raw[t.id] for t in model.tokenize(x)])

    def split(chunk: str) -> bytes:
        if chunk.isalpha():
            return pre_token(chunk)
        if chunk[:-1].isalpha():  # and then a character that is no letter: two pre-tokens
            return known[chunk[:-1]] + known[chunk[-1]]
        parts = _PRE.findall(chunk)
        return pre_token(chunk) if len(parts) == 1 else b"".join(map(known.__getitem__, parts))

    # ids take about as many bytes as their text, which the cost of an entry covers
    known = WordCache(split)
    return known


def token_bytes(text: str | None, path: str) -> bytes:
    """All ids of a text and the end id, little-endian unsigned 32-bit."""
    end = END.to_bytes(4, "little")
    if not text:
        return end
    if any(x in text for x in _BREAKS) if text.isascii() else _OTHER.search(text):
        return _ids(path, text) + end
    chunks = _chunks(path)
    if chunks is not WordCache.taken:
        chunks.take()
    if chunks.held > chunks.limit:
        chunks.trim()
    return b"".join(map(chunks.__getitem__, text.lower().split())) + end


def cut(ids: bytes) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids."""
    step = 4 * LENGTH
    return [(k // step, k // 4, len(part := ids[k : k + step]) // 4, zlib.crc32(part)) for k in range(0, len(ids), step)]


def pieces(text: Column, path: str) -> Column:
    def arrow(texts: pa.Array) -> pa.Array:
        rows = [cut(token_bytes(t.as_py(), path)) for t in texts]
        flat = np.array([x for r in rows for x in r], np.int64).reshape(-1, 4)
        of = pa.StructArray.from_arrays([pa.array(flat[:, 0], pa.int32()), *(pa.array(flat[:, k], pa.int64()) for k in (1, 2, 3))], names=["piece", "start", "length", "ids_crc32"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), of)

    # else Spark runs it once more, for the filter that it puts before an inline of its result
    return F.arrow_udf(arrow, PIECES).asNondeterministic()(text)


# -- the genetic algorithm, on item sizes; a packing is a list of bins, a bin a list of items --


class Packing:
    """bins: lists of items; fills: their sizes' sums."""

    def __init__(self, bins: list[list[int]], fills: list[int]):
        self.bins, self.fills = bins, fills

    @staticmethod
    def of(bins: list[list[int]], sizes) -> Packing:
        return Packing(bins, [sum(map(sizes.__getitem__, b)) for b in bins])

    def put(self, items, sizes) -> Packing:
        """Each of ``items``, in order, goes into the fullest bin that has room."""
        bins, fills = self.bins, self.fills
        room = sorted((LENGTH - f, k) for k, f in enumerate(fills) if f < LENGTH)
        for i in items:
            size = sizes[i]
            at = bisect_left(room, (size, -1))
            if at < len(room):
                left, k = room.pop(at)
                bins[k].append(i)
                fills[k] += size
            else:
                left, k = LENGTH, len(bins)
                bins.append([i])
                fills.append(size)
            if left > size:
                insort(room, (left - size, k))
        return self

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then uneven filling, which leaves room that can be used."""
        return -len(self.bins), math.fsum(f * f for f in self.fills)


def random_packing(sizes, rng) -> Packing:
    return Packing([], []).put(rng.permutation(len(sizes)).tolist(), sizes)


def crossover(a: Packing, b: Packing, sizes, rng) -> Packing:
    """``a`` with whole well-filled bins of ``b``: bins of ``a`` that share an item with them are taken apart, as are
    the emptiest, and the items that lose their place go back best-fit, largest first."""
    good = [k for k, f in enumerate(b.fills) if f >= WELL_FILLED * LENGTH and len(b.bins[k]) > 1] or [max(range(len(b.fills)), key=b.fills.__getitem__)]
    chosen = [k for k, x in zip(good, rng.random(len(good))) if x < 0.5] or good[:1]
    taken = {i for k in chosen for i in b.bins[k]}
    kept, loose = [], []
    for k, x in enumerate(a.bins):
        if taken.isdisjoint(x):
            kept.append(k)
        else:
            loose += [i for i in x if i not in taken]
    kept.sort(key=a.fills.__getitem__)
    apart = max(1, int(TAKEN_APART * len(a.bins)))
    for k in kept[:apart]:
        loose += a.bins[k]
    child = Packing([*(list(b.bins[k]) for k in chosen), *(list(a.bins[k]) for k in kept[apart:])], [*(b.fills[k] for k in chosen), *(a.fills[k] for k in kept[apart:])])
    return child.put(sorted(loose, key=sizes.__getitem__, reverse=True), sizes)


def fewest(sizes) -> int:
    return math.ceil(sum(sizes) / LENGTH)


def evolve(sizes: list[int], seed, people: list[Packing] = ()) -> list[Packing]:
    """A population after an era, best first. ``people``: the last era's, and immigrants; without any, random ones."""
    rng = np.random.default_rng(seed)
    people = [*people] or [random_packing(sizes, rng) for _ in range(POPULATION)]
    if len(sizes) < 2:
        return people[:1]
    for _ in range(GENERATIONS):
        people.sort(key=Packing.fitness, reverse=True)
        n = len(people)
        for _ in range(POPULATION):
            i, j = rng.integers(0, n, 2).tolist()
            people.append(crossover(people[i], people[j if i != j else (j + 1) % n], sizes, rng))
    return sorted(people, key=Packing.fitness, reverse=True)[:POPULATION]


# -- on tables --

_ORDER = ["row", "piece"]


def _ints(x, kind: str) -> bytes:
    return np.asarray(x, kind).tobytes()


def _genes(p: Packing, n: int) -> bytes:
    """The bin of each item."""
    g = np.empty(n, "<i4")
    for k, b in enumerate(p.bins):
        g[b] = k
    return g.tobytes()


def _packing(genes: bytes, sizes) -> Packing:
    bins: dict[int, list[int]] = {}
    for i, g in enumerate(np.frombuffer(genes, "<i4").tolist()):
        bins.setdefault(g, []).append(i)
    return Packing.of(list(bins.values()), sizes)


_STATE = "block long, island int, home int, sizes binary, people array<binary>, bins int, children int, immigrants int"


def _found(items: pa.Table) -> pa.Table:
    """A block's islands, still without packings: the sizes of its pieces in their order."""
    t = items.sort_by([(k, "ascending") for k in _ORDER])
    sizes, block = _ints(t["length"].to_numpy(), "<i4"), t["block"][0].as_py()
    rows = [{"block": block, "island": i, "home": i, "sizes": sizes, "people": [], "bins": None, "children": 0, "immigrants": 0} for i in range(ISLANDS)]
    return pa.Table.from_pylist(rows, _schema())


def _schema() -> pa.Schema:
    return pa.schema([("block", pa.int64()), ("island", pa.int32()), ("home", pa.int32()), ("sizes", pa.binary()), ("people", pa.list_(pa.binary())), ("bins", pa.int32()), ("children", pa.int32()), ("immigrants", pa.int32())])


def _era(era: int):
    """An island's era: its packings and the immigrants in; its packings, and the elite for the next island, out."""

    def run(state: pa.Table) -> pa.Table:
        rows = sorted(state.to_pylist(), key=lambda r: (r["home"] != r["island"], r["home"]))
        own, guests = rows[0], rows[1:]
        sizes = np.frombuffer(own["sizes"], "<i4").tolist()
        people = evolve(sizes, [own["block"] & 0x7FFFFFFF, own["island"], era], [_packing(g, sizes) for r in rows for g in r["people"]])
        genes = [_genes(p, len(sizes)) for p in people]
        stay = {**own, "people": genes, "bins": len(people[0].bins), "children": own["children"] + POPULATION * GENERATIONS * (len(sizes) > 1), "immigrants": own["immigrants"] + sum(len(r["people"]) for r in guests)}
        elite = {**stay, "people": genes[:1], "island": (own["island"] + 1) % ISLANDS}
        return pa.Table.from_pylist([stay, elite] if ISLANDS > 1 and era + 1 < ERAS else [stay], _schema())

    return run


def evolve_blocks(items: DataFrame) -> DataFrame:
    """One row per block and island of ``items`` (block, row, piece, length): its packings as the bin of each piece
    (best first), the best one's number of bins, and how many children were bred and immigrants taken in."""
    x = items.select("block", *_ORDER, "length").groupBy("block").applyInArrow(_found, _STATE)
    # islands are small rows and much work, so they are dealt to tasks by number and not by size
    tasks = 4 * items.sparkSession.sparkContext.defaultParallelism
    for era in range(ERAS):
        x = x.repartition(tasks, "block", "island").groupBy("block", "island").applyInArrow(_era(era), _STATE)
    return x


def _place(key, items: pa.Table, best: pa.Table) -> pa.Table:
    """A block's pieces with their places: pieces lie in a bin in their order."""
    t = items.sort_by([(k, "ascending") for k in _ORDER])
    length, bin_ = t["length"].to_numpy(), np.frombuffer(best["genes"][0].as_py(), "<i4").astype(np.int64)
    by_bin = np.argsort(bin_, kind="stable")
    upto = np.cumsum(length[by_bin])
    first = np.searchsorted(bin_[by_bin], bin_[by_bin])
    offset = np.empty(len(length), np.int64)
    offset[by_bin] = upto - length[by_bin] - (upto[first] - length[by_bin][first])
    fill = np.bincount(bin_, length).astype(np.int64)
    return t.append_column("bin", pa.array(bin_)).append_column("offset", pa.array(offset)).append_column("fill", pa.array(fill[bin_]))


def _packed(items: DataFrame) -> DataFrame:
    """``items``, which have a block, with bin, offset and fill (the bin's)."""
    best = evolve_blocks(items).groupBy("block").agg(F.min(F.struct("bins", "island", F.get("people", 0).alias("genes"))).alias("best")).select("block", "best.genes")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return items.groupBy("block").cogroup(best.groupBy("block")).applyInArrow(_place, f"{kinds}, bin long, offset long, fill long")


def blocked(items: DataFrame, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """``items`` (row, piece, ...) with the block that they fall into by hash of their row number."""
    blocks = max(1, -(-items.count() // block_pieces))
    return items.withColumn("block", F.pmod(F.xxhash64(*_ORDER), F.lit(blocks)))


def pack(items: DataFrame, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Add sequence_id and offset to ``items`` (row, piece, start, length, ...), where (row, piece) is a key."""
    x = materialize(_packed(blocked(items, block_pieces)), "packed")
    part_filled = F.col("fill") < ENDS * LENGTH
    once = x.where(~part_filled).withColumn("round", F.lit(0))
    ends = _packed(blocked(x.where(part_filled).drop("block", "bin", "offset", "fill"), block_pieces)).withColumn("round", F.lit(1))
    sequence = (F.col("block") * 2 + F.col("round")) * (BLOCK_PIECES * 1024) + F.col("bin")
    return once.unionByName(ends).withColumn("sequence_id", sequence).drop("block", "bin", "fill", "round")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The pieces of ``docs`` with their places. ``tokenizer``: path of a tokenizer file on every worker."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    p = docs.select(F.col(id_col).alias("doc_id"), pieces(F.col(text_col), path).alias("p"), F.monotonically_increasing_id().alias("row"))
    return pack(materialize(p.select("doc_id", "row", F.inline("p")), "pieces")).drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
