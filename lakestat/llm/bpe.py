"""Byte-pair encoding and decoding as streaming transducers with bounded lookahead.

The vocabulary is given, never trained. A text is read in blocks that end at white space; each block's pre-tokens are
merged by the ranked list and their ids leave at once, so that beside the text only a block and its ids are held. A
token is emitted as soon as it is stable, and there are two ways for that: the end of its pre-token has been read, or
the pre-token goes on for more than the merge list's sufficient lookahead behind it, which is computed from the list.
Pre-tokens that end within their first WINDOW bytes, which words do, are stable whole; those of a block are merged
together in one vectorised step, and a table of words seen before stands in front of it. Longer ones go through
``Encoder.stream``, which holds a window and the lookahead however long the pre-token is.

Decoding is the other way round: token bytes enter an incremental UTF-8 state machine and whole characters leave it.
Ids and decoded text are digested as they come. One pass over the documents, no shuffle; the merge list (about 1 MB, of
fixed size) is broadcast.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns

#: Bytes of a pre-token that are read at a time.
WINDOW = 256
#: Characters of text that are read at a time; a block goes on to the next white space.
BLOCK = 1 << 16
#: Characters of blocks, of one or many texts, that are merged together.
UNIT = 1 << 20
#: Longer stretches without white space are cut to pre-tokens one by one.
LONG = 4096
#: Entries of the table of known words in each worker; when full, only those of the blocks at hand stay.
KNOWN = 200_000
#: Ids of a long stretch that leave at once.
IDS_AT_ONCE = 1 << 14
#: White space of the pre-tokenizer's pattern.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"

_NO_RANK = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """What encoding and decoding need of a tokenizer file: a BPE model whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        alphabet = byte_alphabet()
        self.first = [ids[c] for c in alphabet]
        self.last = [ids[c + self.suffix] for c in alphabet]
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        pairs = sorted((a << 20 | b, rank, made) for (a, b), (rank, made) in self.merges.items())
        self.pair_keys, self.pair_ranks = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        self.made = np.zeros(len(model["merges"]) + 1, dtype=np.int64)
        self.made[self.pair_ranks] = [p[2] for p in pairs]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in (ids | self.special).items()}
        self.lookahead = sufficient_lookahead(self.merges, {*self.first, *self.last})


def sufficient_lookahead(merges: dict[tuple[int, int], tuple[int, int]], symbols: set[int]) -> int:
    """Symbols after a token's end that must be known for the token to be final.

    Text that is added at the end can move the leftmost change to the left only by merges of growing rank. If the
    merge of rank k moves it, it moves to the start of the merge's right part v, which holds the place where the
    change was; the left part of the merge that brought the change there is then a part of v. So
    reach(k) = len(v) + max(reach(j) for j < k whose left part occurs in v), and the largest reach suffices.
    """
    length, parts, reach_of_left, most = dict.fromkeys(symbols, 1), {s: frozenset([s]) for s in symbols}, {}, 0
    for (u, v), (_, made) in sorted(merges.items(), key=lambda m: m[1][0]):
        reach = length[v] + max((reach_of_left.get(x, 0) for x in parts[v]), default=0)
        most, length[made], parts[made] = max(most, reach), length[u] + length[v], parts[u] | parts[v] | {made}
        reach_of_left[u] = max(reach_of_left.get(u, 0), reach)
    return most + 1  # the last symbol of a word differs from the others


class Encoder:
    """Text to token ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, bytes] = {}
        self.pretoken = regex.compile(PRETOKEN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.first, self.last = np.array(vocabulary.first), np.array(vocabulary.last)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; the count of merges where there is none."""
        keys, v = (left << 20) | right, self.v
        at = np.minimum(np.searchsorted(v.pair_keys, keys), len(v.pair_keys) - 1)
        return np.where(v.pair_keys[at] == keys, v.pair_ranks[at], len(v.made) - 1)

    @staticmethod
    def _alike(size: np.ndarray) -> Iterator[np.ndarray]:
        """Numbers of words of about the same size, some 300,000 bytes of padded words at a time."""
        low = 0
        for width in (4, 8, 16, 32, 64, 128, WINDOW):
            at = np.flatnonzero((size > low) & (size <= width))
            yield from (p for p in np.array_split(at, max(1, len(at) * width // 300_000)) if len(p))
            low = width

    def merged_all(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of many pre-tokens of up to WINDOW bytes: the same merges as ``merged``, one step for all at a time."""
        none = len(self.v.made) - 1
        found = [b""] * len(words)
        size = np.array([len(w) for w in words])
        for part in self._alike(size):
            n, width = size[part], int(size[part].max())
            data = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in part), dtype=np.uint8).reshape(-1, width)
            ids = self.first[data]
            rows = np.arange(len(part))
            ids[rows, n - 1] = self.last[data[rows, n - 1]]
            ids[np.arange(width) >= n[:, None]] = -1
            rank = np.full((len(part), width), none)
            rank[:, :-1] = self.ranks(ids[:, :-1], ids[:, 1:])
            n, todo, at = n.copy(), part, np.arange(width)
            while len(todo):
                best = rank.argmin(axis=1)
                rows = np.arange(len(todo))
                found_rank = rank[rows, best]
                live = found_rank < none
                if not live.all():
                    over = ~live
                    packed, row = ids[over].astype("<u4").tobytes(), 4 * width
                    for k, (i, m) in enumerate(zip(todo[over].tolist(), n[over].tolist(), strict=True)):
                        found[i] = packed[k * row : k * row + 4 * m]
                    todo, ids, rank, n, best, found_rank = todo[live], ids[live], rank[live], n[live], best[live], found_rank[live]
                    rows = np.arange(len(todo))
                if not len(todo):
                    break
                shift = np.minimum(at + (at > best[:, None]), width - 1)
                ids, rank = np.take_along_axis(ids, shift, 1), np.take_along_axis(rank, shift, 1)
                ids[rows, best] = self.v.made[found_rank]
                n -= 1
                ids[rows, n], rank[rows, n] = -1, none
                rank[rows, best] = self.ranks(ids[rows, best], ids[rows, np.minimum(best + 1, width - 1)])
                rank[rows, np.minimum(best, n - 1)] = np.where(best + 1 < n, rank[rows, np.minimum(best, n - 1)], none)
                before = np.maximum(best - 1, 0)
                rank[rows, before] = np.where(best > 0, self.ranks(ids[rows, before], ids[rows, best]), rank[rows, before])
        return found

    def merged(self, ids: list[int]) -> list[int]:
        """The symbols merged in order of rank, leftmost first; the list is used up."""
        merges, none = self.v.merges, (_NO_RANK, 0)
        todo = [merges.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while todo:
            best = min(todo)
            if best[0] == _NO_RANK:
                break
            i = todo.index(best)
            ids[i : i + 2] = [best[1]]
            del todo[i]
            if i < len(todo):
                todo[i] = merges.get((ids[i], ids[i + 1]), none)
            if i:
                todo[i - 1] = merges.get((ids[i - 1], ids[i]), none)
        return ids

    def stream(self, data: Iterable[bytes]) -> Iterator[int]:
        """Ids of one pre-token that arrives in pieces, emitted as soon as they are final."""
        held, v = bytearray(), self.v
        for piece in data:
            held += piece
            while len(held) > 2 * WINDOW + v.lookahead:
                ready = WINDOW + v.lookahead
                at, sizes = 0, self._sizes
                for i in self.merged([v.first[b] for b in held[:ready]]):
                    if (at := at + sizes[i]) > WINDOW:
                        at -= sizes[i]
                        break
                    yield i
                del held[:at]
        if held:
            yield from self.merged([*(v.first[b] for b in held[:-1]), v.last[held[-1]]])

    @property
    def _sizes(self) -> dict[int, int]:
        if not hasattr(self, "_size_of"):
            suffix = self.v.suffix
            self._size_of = {i: len(t.removesuffix(suffix) if suffix else t) for i, t in self.v.tokens.items()}
        return self._size_of

    def split(self, word: str) -> list[str]:
        """Pre-tokens of a stretch without white space."""
        if word.isalpha():
            return [word]
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return self.pretoken.findall(word)

    def streamed(self, pretoken: str) -> Iterator[int]:
        """Ids of one pre-token, read in windows."""
        return self.stream(pretoken[k : k + WINDOW].encode("utf-8", "surrogatepass") for k in range(0, len(pretoken), WINDOW))

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Packed ids of stretches without white space, lower-cased."""
        split = {w: self.split(w) for w in words}
        each = list(set().union(*split.values()))
        data = [p.encode("utf-8", "surrogatepass") for p in each]
        ends = [k for k, d in enumerate(data) if len(d) <= WINDOW]
        ids = dict(zip([each[k] for k in ends], self.merged_all([data[k] for k in ends]), strict=True)) if ends else {}
        ids |= {p: array("I", self.streamed(p)).tobytes() for p, d in zip(each, data, strict=True) if len(d) > WINDOW}
        return {w: ids[ps[0]] if len(ps) == 1 else b"".join([ids[p] for p in ps]) for w, ps in split.items()}

    def pieces(self, text: str) -> Iterator[str | int]:
        """Stretches of the text and the ids of special tokens between them."""
        if self.special and "<|" in text:
            for k, piece in enumerate(self.special.split(text)):
                if k % 2:
                    yield self.v.special[piece]
                elif piece:
                    yield piece
        elif text:
            yield text

    def stretches(self, text: str) -> list[str]:
        """Stretches without white space, normalised, in order."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        low = text.lower()
        return list(filter(None, self.spaces.split(low))) if any(c in low for c in "\x1c\x1d\x1e\x1f") else low.split()

    def blocks(self, text: str) -> Iterator[str | int]:
        """The text in blocks that end at white space, and the ids of special tokens between them."""
        for piece in self.pieces(text):
            if isinstance(piece, int):
                yield piece
                continue
            start = 0
            while start < len(piece):
                stop = len(piece) if len(piece) - start <= BLOCK else (m.start() if (m := self.spaces.search(piece, start + BLOCK)) else len(piece))
                yield piece[start:stop]
                start = stop

    def units(self, texts: list[str]) -> Iterator[list[tuple[int, list[str] | int]]]:
        """Number of the text and stretches of the next blocks of all texts, or the id of a special token."""
        unit, size = [], 0
        for k, text in enumerate(texts):
            for block in self.blocks(text):
                unit.append((k, block if isinstance(block, int) else self.stretches(block)))
                size += 0 if isinstance(block, int) else len(block)
                if size >= UNIT:
                    yield unit
                    unit, size = [], 0
        if unit:
            yield unit

    def ids_of(self, stretches: list[str]) -> Iterator[bytes]:
        """Packed ids of the stretches of one block, of which those that are not long are known."""
        known, plain = self.known, []
        for s in stretches:
            if len(s) <= LONG:
                plain.append(known[s])
                continue
            yield b"".join(plain)
            plain, out = [], array("I")
            for m in self.pretoken.finditer(s):
                out.extend(self.streamed(m.group()))
                if len(out) > IDS_AT_ONCE:
                    yield out.tobytes()
                    out = array("I")
            yield out.tobytes()
        yield b"".join(plain)

    def encode(self, texts: list[str]) -> Iterator[tuple[int, bytes]]:
        """(number of the text, packed ids), text by text and within each in order, as blocks are read."""
        for unit in self.units(texts):
            words = {s for _, part in unit if not isinstance(part, int) for s in part if len(s) <= LONG}
            if len(self.known) + len(words) > KNOWN:
                self.known = {w: self.known[w] for w in words & self.known.keys()}
            self.known |= self.learn(words - self.known.keys())
            for k, part in unit:
                for packed in (array("I", [part]).tobytes(),) if isinstance(part, int) else self.ids_of(part):
                    if packed:
                        yield k, packed


class Decoder:
    """Token ids to text through an incremental UTF-8 state machine.

    ``plain``: tokens as the vocabulary spells them, with a space between two, which is what a file without a decoder
    asks for. Otherwise the bytes they stand for, with a space where a word ends.
    """

    def __init__(self, vocabulary: Vocabulary, plain: bool = True):
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.between = b" " if plain else b""
        self.begun = False
        byte_of = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
        if plain:
            self.bytes_of = {i: t.encode() for i, t in vocabulary.tokens.items()}
        else:
            special = {*vocabulary.special.values()}
            end = vocabulary.suffix
            self.bytes_of = {
                i: t.encode() if i in special else b"".join(byte_of[c] for c in t.removesuffix(end)) + (b" " if end and t.endswith(end) else b"")
                for i, t in vocabulary.tokens.items()
            }

    def feed(self, ids: Iterable[int]) -> str:
        """The characters that are whole once these ids are in."""
        data = self.between.join(map(self.bytes_of.__getitem__, ids))
        if self.begun and data:
            data = self.between + data
        self.begun |= bool(data)
        return self.state.decode(data)

    def finish(self) -> str:
        """What remains; the decoder can then be used again."""
        rest = self.state.decode(b"", True)
        self.state.reset()
        self.begun = False
        return rest


IDS = T.ArrayType(T.LongType())


def encode(docs: DataFrame, path: str, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256, and with ``with_ids`` also ids and decoded.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the decoded text in
    UTF-8. A null text is an empty one: no tokens, and the digests of nothing. Special tokens' strings in a text are
    those tokens. Texts are encoded whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields += [T.StructField("ids", IDS), T.StructField("decoded", T.StringType())]

    def make():
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)

        def work(texts):
            rows = []
            coming = encoder.encode([t or "" for t in texts])
            k, packed = next(coming, (len(texts), b""))
            for n in range(len(texts)):
                ids, text, count, held, shown = hashlib.sha256(), hashlib.sha256(), 0, array("I"), []
                while k == n:
                    part = array("I", packed)
                    ids.update(packed)
                    count += len(part)
                    out = decoder.feed(part)
                    text.update(out.encode())
                    if with_ids:
                        held.extend(part)
                        shown.append(out)
                    k, packed = next(coming, (len(texts), b""))
                rest = decoder.finish()
                text.update(rest.encode())
                row = (count, ids.hexdigest(), text.hexdigest())
                rows.append((*row, list(held), "".join([*shown, rest])) if with_ids else row)
            return [list(x) for x in zip(*rows, strict=True)] if rows else [[] for _ in fields]

        return work

    return append_columns(docs, text_col, fields, make)
