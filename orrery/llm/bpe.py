"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last ``WINDOW`` characters chooses where a text may be
cut, so equal passages are cut alike wherever they stand. Each distinct chunk is
encoded once and kept, ``CACHE_CHUNKS`` at most per Python worker, which Spark
reuses for many tasks; a text's ids are those of its chunks in a row. A new chunk
is made of words in the same way: each distinct word is encoded once and kept,
``CACHE_WORDS`` about, found by a hash and compared letter by letter.

Some joins are exact as they stand, because no token and no normalisation can reach
over them: the right side begins with a space or line end and the left side ends
with no white space (words also part at stops). A run without such a place that is
longer than ``LONGEST`` is cut within words, where ``WINDOW`` plain letters stand on both
sides, and these joins are repaired: a window around the join is encoded anew and
doubled until a token on its left stands in the left chunk's ids too, at the same
place, and one on its right in the right chunk's. Ids of a word are right exactly if
every two neighbours are (merges are taken by rank, so a neighbour pair that ever
stands in ids of any word is never merged), and after such a repair every pair of
neighbours stands in the left chunk, the window or the right one. Where no tokens
agree, the window grows to both chunks, which settles it.

Edge cases: a null text is empty and has no ids; special tokens that stand in a
text are treated as the library does; repeated rows come back as often as they
came; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from itertools import chain

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame

from orrery.llm.text import code_points, map_texts, span_hashes

WINDOW = 8
#: One in so many exact joins cuts; about 6 times as many characters to a chunk.
CUT_ONE_IN = 64
#: Runs without an exact join that are longer than this are cut within words, half as far apart at least, and repaired.
LONGEST = 4096
CACHE_CHUNKS = 10_000
CACHE_WORDS = 800_000
#: Longer words are encoded whenever they occur.
LONG_WORD = 64
#: So many new words are encoded in one go.
TOGETHER = 500
STOPS = np.array([ord(c) for c in ".,;:!?"], np.uint32)
BLANKS = np.array([0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
#: So many tokens behind a join are at hand for the next one.
KEPT_BACK = 1 << 12
#: Rows of id, begin and end.
Tokens = np.ndarray
_encoders: dict[str, "ChunkEncoder"] = {}


class WordTable:
    """Words with their ids in flat arrays, by a 64-bit hash: open addressing, at most half full.

    A word is held only if its letters are those of the hash's row, so a clash of hashes
    makes a word unknown, and never another's ids.
    """

    BITS = 18

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.bits = self.BITS
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.row = np.zeros(1 << self.bits, np.int32)
        #: ids, and letters as UTF-16 units, of all rows end to end, with each row's begin and the end.
        self.pools = [np.zeros(1 << 18, np.uint32), np.zeros(1 << 18, np.uint16)]
        self.edges = [np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)]
        self.n = 0

    def find(self, h: np.ndarray, cp: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Row of each word, -1 if its hash is new, -2 if the hash is another word's."""
        out = np.full(len(h), -1, np.int64)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            key = self.keys[slot]
            hit = key == h[todo]
            out[todo[hit]] = self.row[slot[hit]]
            on = ~hit & (key != 0)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        known = np.flatnonzero(out >= 0)
        if len(known):
            row, n = out[known], (end - at)[known]
            begin = self.edges[1][row]
            same = self.edges[1][row + 1] - begin == n
            out[known[~same]] = -2
            known, begin, n = known[same], begin[same], n[same]
        if len(known):
            first = np.cumsum(n) - n
            inside = np.arange(n.sum())
            equal = self.pools[1][inside + np.repeat(begin - first, n)] == cp[inside + np.repeat(at[known] - first, n)]  # a letter beyond 16 bits equals none
            out[known[~np.logical_and.reduceat(equal, first)]] = -2
        return out

    def _append(self, k: int, data: np.ndarray, sizes: np.ndarray) -> None:
        used = int(self.edges[k][self.n])
        if used + len(data) > len(self.pools[k]):
            self.pools[k] = np.concatenate([self.pools[k], np.zeros(max(len(self.pools[k]) // 2, len(data)), self.pools[k].dtype)])
        if self.n + len(sizes) + 1 > len(self.edges[k]):
            self.edges[k] = np.concatenate([self.edges[k], np.zeros(max(len(self.edges[k]) // 2, len(sizes) + 1), np.int64)])
        self.pools[k][used : used + len(data)] = data
        self.edges[k][self.n + 1 : self.n + 1 + len(sizes)] = used + np.cumsum(sizes)

    def add(self, h: np.ndarray, ids: list[bytes], words: list[str]) -> None:
        """Hold ids of words with new, distinct hashes."""
        self._append(0, np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
        self._append(1, np.frombuffer("".join(words).encode("utf-16-le", "surrogatepass"), np.uint16), np.fromiter((len(w.encode("utf-16-le", "surrogatepass")) // 2 for w in words), np.int64, len(words)))
        row = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.n += len(h)
        if 2 * self.n > len(self.keys):
            held = self.keys != 0
            h, row = np.concatenate([self.keys[held], h]), np.concatenate([self.row[held], row])
            self.bits = max(self.bits + 1, int(2 * self.n - 1).bit_length())
            self.keys, self.row = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        slot, todo = (h >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[todo[free]]
            placed = free & (self.keys[slot] == h[todo])
            self.row[slot[placed]] = row[todo[placed]]
            todo, slot = todo[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows laid end to end, and how many each has."""
        begin = self.edges[0][rows]
        size = self.edges[0][rows + 1] - begin
        place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.pools[0][place], size


def word_cuts(cp: np.ndarray) -> np.ndarray:
    """Places where a word begins by an exact join.

    Before a space or line end that follows no blank, and between a plain letter
    or digit and a stop: every pattern of these tokenizers parts them there.
    """
    space = (cp == 32) | (cp == 10)
    cut = space.copy()
    cut[1:] &= ~blanks(cp)[:-1]
    plain = ((cp >= 48) & (cp <= 57)) | ((cp >= 97) & (cp <= 122)) | ((cp >= 65) & (cp <= 90)) | ((cp >= 0xC0) & (cp <= 0x24F) & (cp != 0xD7) & (cp != 0xF7) & (cp != 0x130))
    stop = (cp == 46) | (cp == 44) | (cp == 58) | (cp == 59) | (cp == 33) | (cp == 63)
    cut[1:] |= (stop[1:] & plain[:-1]) | (plain[1:] & stop[:-1])
    return cut


def blanks(cp: np.ndarray) -> np.ndarray:
    """Any character that a tokenizer might take for white space."""
    out = (cp == 32) | ((cp >= 9) & (cp <= 13)) | ((cp >= 28) & (cp <= 31)) | (cp == 0x85) | (cp == 0xA0)
    if len(cp) and cp.max() >= 0x1680:
        out |= np.isin(cp, BLANKS)
    return out


class ChunkEncoder:
    """A tokenizer with its words' and chunks' ids; one per file and Python worker.

    Ids are kept as little-endian unsigned 32-bit integers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunks: dict[str, bytes] = {}
        self.runs: dict[str, Tokens] = {}
        self.words = WordTable()
        self.opens = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.opens[i] = token.startswith("\u0120")

    @classmethod
    def of(cls, path: str) -> "ChunkEncoder":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def plain(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, encoded on its own."""
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def apart(self, words: list[str]) -> list[bytes]:
        """Ids of words that aren't held."""
        first = iter(self.plain([w for w in words if len(w) <= LONGEST]))
        return [next(first) if len(w) <= LONGEST else self.run(w) for w in words]

    def tokens(self, piece: str) -> Tokens:
        found = self.tokenizer.encode(piece, add_special_tokens=False)
        return np.array([*zip(found.ids, *zip(*found.offsets, strict=True), strict=True)] if found.ids else np.zeros((0, 3)), np.int64)

    def run(self, text: str) -> bytes:
        """Ids of a long run: chunks that are encoded once, joined with repair."""
        cuts, safe = run_cuts(text)
        edges = [0, *cuts, len(text)]
        pieces = [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        missing = [x for x in dict.fromkeys(pieces) if x not in self.runs]
        if len(self.runs) + len(missing) > CACHE_CHUNKS // 100:
            self.runs.clear()
        held = {x: self.runs.get(x) if x in self.runs else self.tokens(x) for x in dict.fromkeys(pieces)}
        self.runs.update({x: held[x] for x in list(held)[: CACHE_CHUNKS // 100]})
        before, left = [], held[pieces[0]]
        for at, end, piece in zip(edges[1:], edges[2:], pieces[1:], strict=False):
            left = self.repaired(text, before, left, held[piece] + np.array([0, at, at]), at, end, safe)
            # mostly the last tokens alone change with the next join
            before.append(left[:-KEPT_BACK])
            left = left[-KEPT_BACK:]
        return np.concatenate([*before, left])[:, 0].astype("<u4").tobytes()

    def repaired(self, text: str, before: list[Tokens], left: Tokens, right: Tokens, at: int, end: int, safe: np.ndarray) -> Tokens:
        """The tokens on both sides of the join at ``at``; more of the left side is taken from ``before`` if need be."""
        reach = 4 * WINDOW
        while True:
            while before and at - reach < left[0, 1]:
                left = np.concatenate([before.pop(), left])
            low = max(0, int(safe[max(0, np.searchsorted(safe, at - reach, side="right") - 1)]))
            high = min(end, int(safe[min(len(safe) - 1, np.searchsorted(safe, at + reach))]))
            window = self.tokens(text[low:high]) + np.array([0, low, low])
            begin, stop = agreement(left, window, low, at), agreement(right, window, at, high)
            settled_left, settled_right = low == 0, high == end
            # without a token that agrees, all of a side is taken from a window that covers it
            if (len(begin) or settled_left) and (len(stop) or settled_right):
                if not len(begin):
                    before.clear()
                i, j = (begin[-1, 0] + 1, begin[-1, 1] + 1) if len(begin) else (0, 0)
                m, n = (stop[0, 0], stop[0, 1]) if len(stop) else (len(right), len(window))
                return np.concatenate([left[:i], window[j:n], right[m:]])
            reach *= 2

    def spaced(self, words: list[str]) -> list[bytes]:
        """As ``plain``, for words that hold no space but the first character.

        In byte-level vocabularies a token begins with the space's sign exactly
        where such a word begins, so many are encoded in one go and told apart.
        """
        out: list[bytes] = []
        for i in range(0, len(words), TOGETHER):
            some = words[i : i + TOGETHER]
            ids = np.asarray(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            begins = np.flatnonzero(self.opens[ids])
            if len(begins) != len(some):
                return self.plain(words)
            data, edges = ids.tobytes(), [*(4 * begins).tolist(), 4 * len(ids)]
            out += [data[x:y] for x, y in zip(edges, edges[1:], strict=False)]
        return out

    def encoded(self, words: list[str]) -> list[bytes]:
        alone = [w[0] == " " and " " not in w[1:] and not w[-1].isspace() for w in words]
        first = iter(self.spaced([w for w, a in zip(words, alone, strict=True) if a]))
        other = iter(self.plain([w for w, a in zip(words, alone, strict=True) if not a]))
        return [next(first if a else other) for a in alone]

    def by_words(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, joined from those of its words."""
        if not texts:
            return []
        cp, begins = code_points(texts)
        cut = word_cuts(cp)
        cut[begins[:-1]] = True
        cut[begins[1:] - 1] = True  # the line end behind each text
        at = np.flatnonzero(cut)
        end = np.append(at[1:], len(cp))
        own = ~np.isin(at, begins[1:] - 1, assume_unique=True)
        at, end = at[own], end[own]
        h = span_hashes(cp, at, end) | np.uint64(1)
        row = self.words.find(h, cp, at, end)
        short = end - at <= LONG_WORD
        fresh = short & (row == -1)
        joined = "\n".join(texts)
        if fresh.any():
            new, where = np.unique(h[fresh], return_index=True)
            if self.words.n + len(new) > CACHE_WORDS:  # the table grows where one group of texts has more
                self.words.clear()
                fresh = short
                new, where = np.unique(h[fresh], return_index=True)
            source = np.flatnonzero(fresh)[where]
            words = [joined[a:b] for a, b in zip(at[source].tolist(), end[source].tolist(), strict=True)]
            self.words.add(new, self.encoded(words), words)
            row = self.words.find(h, cp, at, end)
        long = row < 0
        size = np.zeros(len(at), np.int64)
        ids, size[~long] = self.words.ids(row[~long])
        text_of = np.searchsorted(begins, at, side="right") - 1
        edges = np.concatenate([[0], np.cumsum(np.bincount(text_of, size, len(texts)).astype(np.int64))])
        data = ids.tobytes()
        if not long.any():
            return [data[4 * a : 4 * b] for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]
        out: list[list[bytes]] = [[] for _ in texts]
        places = np.cumsum(size) * 4
        done = [4 * x for x in edges.tolist()]
        far = np.flatnonzero(long)
        for i, own_ids in zip(far.tolist(), self.apart([joined[at[i] : end[i]] for i in far]), strict=True):
            t = int(text_of[i])
            out[t] += [data[done[t] : places[i]], own_ids]
            done[t] = int(places[i])
        return [b"".join([*parts, data[x : 4 * y]]) for parts, x, y in zip(out, done, edges[1:].tolist(), strict=False)]

    def learn(self, chunks: list[str]) -> None:
        """Hold the ids of all ``chunks``, encoding those that are new."""
        missing = [c for c in dict.fromkeys(chunks) if c not in self.chunks]
        if len(self.chunks) + len(missing) > CACHE_CHUNKS:
            self.chunks.clear()
            missing = list(dict.fromkeys(chunks))
        self.chunks.update(zip(missing, self.by_words(missing), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as of the whole text, as unsigned 32-bit integers."""
        cut = chunks_of(texts)
        self.learn(list(chain.from_iterable(cut)))
        of = self.chunks.__getitem__
        return [np.frombuffer(b"".join(map(of, chunks)), "<u4") for chunks in cut]


def rolled(cp: np.ndarray) -> np.ndarray:
    """A hash of the WINDOW characters before each place."""
    h = np.zeros(len(cp), np.uint32)
    for k in range(WINDOW, 0, -1):
        h[k:] = h[k:] * np.uint32(0x9E3779B1) + cp[:-k]
    return (h * np.uint32(0x85EBCA6B)) >> np.uint32(16)


def run_cuts(text: str, longest: int | None = None) -> tuple[list[int], np.ndarray]:
    """Where a run is cut, and all places with WINDOW plain letters on both sides, its ends among them."""
    longest = longest or LONGEST
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = ((cp >= 97) & (cp <= 122)) | ((cp >= 65) & (cp <= 90))
    count = np.concatenate([[0], np.cumsum(plain)])
    inner = np.arange(WINDOW, max(WINDOW, len(cp) - WINDOW))
    inner = inner[count[inner + WINDOW] - count[inner - WINDOW] == 2 * WINDOW]
    cuts, last = [], 0
    for x in inner[(rolled(cp)[inner] & 255) == 7].tolist():
        if x - last >= longest // 2:
            cuts.append(x)
            last = x
    return cuts, np.concatenate([[0], inner, [len(cp)]])


def agreement(side: Tokens, window: Tokens, low: int, high: int) -> np.ndarray:
    """(place in ``side``, place in ``window``) of the tokens from ``low`` to ``high`` that both have."""
    here = [np.flatnonzero((t[:, 1] >= low) & (t[:, 2] <= high) & (t[:, 2] > t[:, 1])) for t in (side, window)]
    found = {tuple(x): i for i, x in zip(here[0].tolist(), side[here[0]].tolist(), strict=True)}
    both = [(found[tuple(x)], j) for j, x in zip(here[1].tolist(), window[here[1]].tolist(), strict=True) if tuple(x) in found]
    return np.array(both, np.int64).reshape(-1, 2)


def chunks_of(texts: list[str]) -> list[list[str]]:
    """Chunks of each text, cut where a join is exact."""
    cp, begins = code_points(texts)
    exact = (cp == 32) | (cp == 10)
    exact[1:] &= ~blanks(cp)[:-1]
    exact[:1] = False
    cuts = np.flatnonzero(exact & (rolled(cp) % CUT_ONE_IN == 7))
    out = []
    lo = np.searchsorted(cuts, begins[:-1], side="right")
    hi = np.searchsorted(cuts, begins[1:] - 1, side="left")
    for i, t in enumerate(texts):
        edges = [0, *(cuts[lo[i] : hi[i]] - begins[i]).tolist(), len(t)]
        out.append([t[a:b] for a, b in zip(edges, edges[1:], strict=False)] if t else [])
    return out


FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", with_ids: bool = False, with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, kept columns, n_tokens and digests; on request the ids and the decoded text."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{key}` {kinds[key]}", *[f"`{c}` {kinds[c]}" for c in keep], FIELDS, *["ids array<int>"] * with_ids, *["decoded string"] * with_text])

    def run(cols, texts):
        encoder = ChunkEncoder.of(path)
        ids = encoder.encode(texts)
        decoded = [encoder.tokenizer.decode(x.tolist(), skip_special_tokens=False) if len(x) else "" for x in ids]
        out = {key: cols[key], **{c: cols[c] for c in keep}, "n_tokens": [len(x) for x in ids]}
        out["ids_sha256"] = [hashlib.sha256(x.tobytes()).hexdigest() for x in ids]
        out["decoded_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in decoded]
        if with_ids:
            out["ids"] = [x.tolist() for x in ids]
        if with_text:
            out["decoded"] = decoded
        return out

    return map_texts(docs, run, schema, [key, *keep], text)


def op5(docs: DataFrame) -> DataFrame:
    return encoded(docs)
