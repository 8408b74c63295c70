"""Phrase collocations: counts of short phrases from suffix automata, scored by how well a phrase holds together.

Texts of a language are packed in shards of words. Each shard has a generalised suffix automaton of bounded depth: its
states are the sets of places where phrases end, ordered by suffix links, and hold how often (endpos counts). A state's
phrases, from one word more than its link's up to its longest, share the count, so enumerating the states gives every
distinct phrase of the shard once. Counts are then summed over all shards.

A phrase is frequent only if the phrases in it are. So words and pairs are counted first, and only what lies in chains
of pairs that may be frequent is enumerated to the full depth. Shards know these by a bitmap of hashed frequent pairs,
whose size is fixed: a pair that shares its bit with a frequent one only adds rows, which the sums drop again, so
results are exact however full the bitmap is (a full one prunes nothing, and every phrase travels once per shard).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, modest_batches, tidy, written

#: The longest phrase, how often one is found at least, the share (percent) of a phrase that makes a longer one replace it, and phrases of a language in the report.
DEPTH, LEAST, SUBSUMED, FIRST = 4, 30, 80, 2000
#: Text of a shard, in bytes; a single longer text is a shard of its own.
SHARD_BYTES = 8 << 20
# Capitals are lowered, tabs divide words as blanks do, these signs and line ends divide pieces.
_FROM = bytes(range(ord("A"), ord("Z") + 1)) + b"\t" + b".,;:!?\n\x0b\x0c\r"
_TO = bytes(range(ord("a"), ord("z") + 1)) + b" " + b"\n" * 10
_TABLE = bytes.maketrans(_FROM, _TO)
SHARD = "shard long, lang string, n long, body binary"
COUNTED = "lang string, phrase string, n long"
#: Bits of the map of frequent pairs (16 MB).
BITS = 1 << 27


class Automaton:
    """The suffix automaton of many pieces, for phrases of up to ``depth`` words.

    ``codes``: words as numbers from 0, and -1 between pieces. ``joined``: whether a phrase may hold a word and the one
    before it (all in a piece, unless given). For each state: ``count`` (places where its phrases end), ``end`` (one of
    these), ``size`` (words of its longest phrase) and ``link`` (the state of its longest suffix with more places, or -1).
    """

    def __init__(self, codes: np.ndarray, depth: int, joined: np.ndarray | None = None) -> None:
        goes_on = np.r_[False, (codes[1:] >= 0) & (codes[:-1] >= 0)][: len(codes)]
        if joined is not None:
            goes_on &= joined
        # Nodes of depth d: the distinct phrases of d words; a node's parent is the phrase without its first word.
        at = np.flatnonzero(codes >= 0).astype(np.int32)
        n_words = int(codes.max(initial=0)) + 1
        count = np.bincount(codes[at], minlength=n_words)
        end = np.zeros(n_words, dtype=np.int32)
        end[codes[at]] = at
        node = codes[at]
        levels = [(count.astype(np.int32), end, np.full(n_words, -1, dtype=np.int32))]
        base = 0
        for d in range(2, depth + 1):
            further = at[at >= d - 1]
            node = node[len(at) - len(further) :]
            longer = goes_on[further - d + 2]
            at, node = further[longer], node[longer]
            key = node.astype(np.int64) * n_words + codes[at - d + 1]
            order = np.argsort(key, kind="stable").astype(np.int32)
            key = key[order]
            new = np.r_[True, key[1:] != key[:-1]][: len(key)]
            first = np.flatnonzero(new)
            count = np.diff(np.r_[first, len(key)]).astype(np.int32)
            levels.append((count, at[order[first]], (base + key[first] // n_words).astype(np.int32)))
            base += len(levels[-2][0])
            node[order] = np.cumsum(new, dtype=np.int32) - 1
            del key, order, new
        sizes = np.repeat(np.arange(1, depth + 1, dtype=np.int32), [len(c) for c, _, _ in levels])
        count, end, parent = (np.concatenate(x) for x in zip(*levels, strict=True))
        # A phrase with as many places as its suffix ends at the same ones: one state, named by the longer.
        longest = count > 0
        longest[parent[(parent >= 0) & (count == count[parent])]] = False
        low = parent.copy()
        for _ in range(depth):
            same = (low >= 0) & (count[low] == count)
            low[same] = parent[low[same]]
        number = np.cumsum(longest) - 1
        self.count, self.end, self.size, low = count[longest], end[longest], sizes[longest], low[longest]
        self.link = np.where(low >= 0, number[low], -1)
        self.shortest = np.where(low >= 0, sizes[low], 0) + 1

    def phrases(self, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(last place, words, count) of every distinct phrase of at least so many words."""
        low = np.maximum(self.shortest, least)
        times = np.maximum(0, self.size - low + 1)
        state = np.repeat(np.arange(len(times)), times)
        size = low[state] + np.arange(len(state)) - np.repeat(np.cumsum(times) - times, times)
        return self.end[state], size, self.count[state]


def shard_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of some texts, and the texts as their numbers, -1 between pieces."""
    joined = b"\n".join(texts).translate(_TABLE).replace(b"\n", b" \n ")
    tokens = pc.split_pattern(pa.array([joined], pa.large_binary()), b" ").flatten()
    coded = tokens.filter(pc.not_equal(tokens, b"")).dictionary_encode()
    words, codes = coded.dictionary, np.asarray(coded.indices).astype(np.int32)
    cut = words.index(pa.scalar(b"\n", pa.large_binary())).as_py()
    if cut >= 0:
        codes = np.where(codes == cut, -1, codes - (codes > cut)).astype(np.int32)
        words = pa.concat_arrays([words[:cut], words[cut + 1 :]])
    return words, codes


def packed(words: pa.Array, codes: np.ndarray) -> bytes:
    """A shard's words and codes as one compressed record."""
    out = pa.BufferOutputStream()
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (words.cast(pa.binary()), pa.array(codes, pa.int32()))]
    record = pa.RecordBatch.from_arrays(lists, names=["words", "codes"])
    with pa.ipc.new_stream(out, record.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(record)
    return out.getvalue().to_pybytes()


def pack(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Texts (lang, text) as shards of one language each."""
    part, made = TaskContext.get().partitionId(), 0
    waiting: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def shard(lang: str) -> pa.RecordBatch:
        nonlocal made
        words, codes = shard_of(waiting.pop(lang))
        del sizes[lang]
        made += 1
        tidy()
        values = [(part << 32) + made], [lang], [int((codes >= 0).sum())], [packed(words, codes)]
        types = pa.int64(), pa.string(), pa.int64(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["shard", "lang", "n", "body"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            size = len(text.as_buffer())
            if sizes.get(lang, 0) + size > shard_bytes and lang in sizes:
                yield shard(lang)
            waiting.setdefault(lang, []).append(text.as_py())
            sizes[lang] = sizes.get(lang, 0) + size + 1
            if sum(sizes.values()) > 2 * shard_bytes:
                yield shard(max(sizes, key=sizes.get))
    while sizes:
        yield shard(next(iter(sizes)))
    tidy()


def _rows(lang: str, words: pa.Array, codes: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """An automaton's phrases spelled out, in batches."""
    ends, sizes, counts = found
    for s in range(0, len(ends), rows):
        end, size = ends[s : s + rows], sizes[s : s + rows]
        phrase = pa.nulls(len(end), pa.binary()).fill_null(b"")
        for back in range(int(size.max()) - 1, -1, -1):
            inside = size > back
            word = words.take(pa.array(np.where(inside, codes[np.maximum(0, end - back)], 0)))
            longer = pc.binary_join_element_wise(phrase, word, b" ") if back + 1 < int(size.max()) else word
            phrase = pc.if_else(pa.array(size == back + 1), word, pc.if_else(pa.array(inside), longer, phrase))
        k = len(end)
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(lang), k), phrase.cast(pa.string()), pa.array(counts[s : s + rows], pa.int64())], names=["lang", "phrase", "n"]
        )


def _shards(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    for lang, body in zip(batch.column("lang"), batch.column("body"), strict=True):
        record = pa.ipc.open_stream(body.as_buffer()).read_next_batch()
        yield lang.as_py(), record.column("words").values, np.asarray(record.column("codes").values)


def words_and_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every distinct word and pair of each shard with its count."""
    for batch in batches:
        for lang, words, codes in _shards(batch):
            yield from _rows(lang, words, codes, Automaton(codes, 2).phrases())
            tidy()


def may_be_frequent(lang: str, words: pa.Array, codes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Whether each word stands in one piece with the word before it and the bit of that pair is set."""
    within = np.flatnonzero((codes[1:] >= 0) & (codes[:-1] >= 0)) + 1
    pairs, of = np.unique(codes[within - 1].astype(np.int64) * len(words) + codes[within], return_inverse=True)
    spelled = words.to_pylist()
    begun = [zlib.crc32(w + b" ", zlib.crc32(lang.encode() + b"\n")) for w in spelled]
    first, second = ((pairs // max(1, len(words))).tolist(), (pairs % max(1, len(words))).tolist())
    bit = np.fromiter((zlib.crc32(spelled[b], begun[a]) for a, b in zip(first, second)), dtype=np.int64, count=len(pairs)) % (64 * len(bitmap))
    out = np.zeros(len(codes), dtype=bool)
    out[within] = ((bitmap[bit // 64] >> (bit % 64).astype(np.uint64)) & np.uint64(1)).astype(bool)[of.reshape(-1)]
    return out


def long_phrases(batches: Iterator[pa.RecordBatch], depth: int, bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Phrases of three words and more of each shard that lie in chains of pairs that may be frequent."""
    for batch in batches:
        for lang, words, codes in _shards(batch):
            joined = may_be_frequent(lang, words, codes, bitmap)
            # Chains of two pairs and more are laid end to end.
            chained = joined & (np.r_[False, joined[:-1]] | np.r_[joined[1:], False])
            inside = chained | np.r_[chained[1:], False]
            if inside.any():
                kept = codes[inside]
                yield from _rows(lang, words, kept, Automaton(kept, depth, chained[inside]).phrases(3))
            tidy()


def pair_bitmap(counts: DataFrame) -> np.ndarray:
    """The bits of the frequent pairs, as BITS / 64 whole numbers: a table of that many rows at most is collected."""
    bit = F.crc32(F.concat_ws("\n", "lang", "phrase").cast("binary")) % BITS
    pairs = counts.where("instr(phrase, ' ') > 0").select(bit.alias("bit"))
    packed_bits = pairs.groupBy(F.expr("cast(bit div 64 as int)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toArrow()
    bitmap = np.zeros(BITS // 64, dtype=np.uint64)
    bitmap[np.asarray(packed_bits.column("at"))] = np.asarray(packed_bits.column("bits")).view(np.uint64)
    return bitmap


def _summed(rows: DataFrame, least: int) -> DataFrame:
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def _few(phrases: DataFrame) -> DataFrame:
    """The phrases, marked for broadcast if they are few and short by count."""
    size = phrases.agg(F.coalesce(F.sum(F.octet_length("phrase") + 32), F.lit(0))).first()[0]
    return F.broadcast(phrases) if size <= 32 << 20 else phrases


def phrase_counts(shards: DataFrame, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """(lang, phrase, a) of every phrase of up to ``depth`` words with ``a`` places, at least ``least``, over all shards."""
    counts = written(_summed(shards.mapInArrow(words_and_pairs, COUNTED), least), "short")
    if depth < 3:
        return counts
    bitmap = shards.sparkSession.sparkContext.broadcast(pair_bitmap(counts))
    long = shards.mapInArrow(lambda batches: long_phrases(batches, depth, bitmap.value), COUNTED)
    longer = written(_summed(long, least), "longer")
    both = written(counts.union(longer), "phrases")
    discard(counts, longer)
    return both


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of every phrase of two words and more, cut where it holds together least.

    A cut after k words leaves parts with l and r places: score floor(2000000 * a / (l + r)), in decimals, since
    products may pass 64 bits. The lowest score counts, of equal ones the smallest k.
    """
    words = F.split("phrase", " ")
    cuts = counts.withColumn("words", words).where("size(words) >= 2").withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumn("head", F.array_join(F.slice("words", 1, F.col("k")), " ")).withColumn("rest", F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " "))
    parts = _few(counts)
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"]).join(parts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    score = F.expr("2000000BD * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))").cast("long")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("at"))
    return worst.select("lang", "phrase", "a", "at.l", "at.r", "at.score")


def subsumed(counts: DataFrame, share: int = SUBSUMED) -> DataFrame:
    """(lang, phrase) of phrases that stand inside a longer one with at least ``share`` percent of their places.

    Counts do not grow with length, so a longer phrase is reached through phrases of one word more each: those that link
    to a phrase by leaving out their first word (the suffix link) or their last (the link of the reversed texts).
    """
    words = F.split("phrase", " ")
    n = F.size("words")
    links = counts.withColumn("words", words).where("size(words) >= 3")
    links = links.select("lang", "a", F.explode(F.array(F.array_join(F.slice("words", 2, n - 1), " "), F.array_join(F.slice("words", 1, n - 1), " "))).alias("phrase"))
    most = links.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    exact = [F.col(c).cast("decimal(19, 0)") for c in ("longer", "a")]
    return counts.join(most, ["lang", "phrase"]).where(exact[0] * 100 >= exact[1] * share).select("lang", "phrase")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", depth: int = DEPTH, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first collocations.

    Texts are lowered (A-Z), cut into pieces at ``.,;:!?`` and line ends, and these into words at blanks and tabs. A
    phrase of 2 to ``depth`` words counts with at least ``least`` places, overlapping ones and those of repeated rows
    included; n is the language's words. Ordered by score, then places (both descending), then the phrase's UTF-8 bytes.
    A null language is ``und``; null and empty texts have no words; a language without such phrases has no rows. Other
    columns play no part.
    """
    texts = docs.select(F.coalesce(docs[lang_col], F.lit("und")).alias("lang"), docs[text_col].cast("binary").alias("text"))
    modest_batches(docs.sparkSession)
    size = SHARD_BYTES
    shards = written(texts.where("octet_length(text) > 0").mapInArrow(lambda batches: pack(batches, size), SHARD), "shards")
    counts = phrase_counts(shards, depth, least)
    totals = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    kept = scored(counts).join(subsumed(counts), ["lang", "phrase"], "left_anti")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
