"""SentencePiece encoding and decoding as a streaming Viterbi pass.

The lattice of pieces over a text keeps one backpointer per position: the piece with which the best path to that
position ends. For a unigram model the best path is that of the highest total score; for a BPE model it is the one
path whose neighbouring pieces are compatible (see ``bpe``), which is what merging by score yields, so the ids equal the
library's. ``Stream`` keeps a window of positions bounded by the longest piece; whenever the backpointer paths of all
positions that a later piece can still start from meet in one boundary, the ids up to it are final and are given out.

Over a table, ``encode`` cuts texts where every path must meet (between two characters that no piece holds side by side,
so before a word-start mark that follows something else, and mostly around line ends and punctuation) and looks known
parts up, by 64-bit hashes whose hits are compared with the parts themselves. New parts of more than two times the longest
piece go through ``Stream``; shorter ones are a window each, final at its end, and run through the same recurrence together. A run of word-start marks has its own rule, as its pieces all have the same score.

Defined results: a null text gives null ids, an empty one no ids; characters outside the vocabulary become byte pieces;
decoding turns ids back into the text exactly, but for texts that hold the word-start mark itself. Repeated rows each get
their own result; very long texts are encoded whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..session import ship
from . import bpe, words

MARK = "▁"
#: Parts that a worker remembers at most.
KEEP = 60_000
#: Code points that are cut and looked up at once, so that a very long text takes little more than its own size.
BLOCK = 1 << 21
_NORMAL, _USER, _BYTE = 1, 4, 6
_UNIGRAM, _BPE = 1, 2


def read_model(path: str) -> tuple[list[tuple[str, float, int]], int, bool]:
    """Pieces (text, score, type), model type and whether a mark goes before the text, read from the file's wire format."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, kind, prefix = [], _UNIGRAM, True
    for field, value in _fields(data):
        if field == 1:
            text, score, type_ = "", 0.0, _NORMAL
            for k, v in _fields(value):
                if k == 1:
                    text = v.decode("utf-8")
                elif k == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif k == 3:
                    type_ = v
            pieces.append((text, score, type_))
        elif field == 2:
            kind = next((v for k, v in _fields(value) if k == 3), kind)
        elif field == 3:
            prefix = bool(next((v for k, v in _fields(value) if k == 3), prefix))
    return pieces, kind, prefix


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[i]
        value |= (b & 0x7F) << shift
        i, shift = i + 1, shift + 7
        if b < 0x80:
            return value, i


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    i = 0
    while i < len(data):
        tag, i = _varint(data, i)
        if tag & 7 == 0:
            value, i = _varint(data, i)
        elif tag & 7 == 2:
            n, i = _varint(data, i)
            value, i = data[i : i + n], i + n
        else:
            n = 8 if tag & 7 == 1 else 4
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


def _bpe_pairs(pieces: list[tuple[str, float, int]]) -> tuple[bpe.Pairs, dict[str, int], list[str]]:
    """The recurrence's tables for pieces that are merged by score: a piece counts if merging its characters yields it.

    Pieces that are only word-start marks are left out; they are scored alike and have their own rule.
    """
    normal = [(t, s) for t, s, k in pieces if k in (_NORMAL, _USER)]
    own = [(t, s) for t, s in normal if len(t) > 1 and t.strip(MARK)]
    chars = sorted({c for t, _ in own for c in t} | {t for t, _ in normal if len(t) == 1})
    symbols = {c: i for i, c in enumerate(chars)}
    rank, texts, tokens = dict(symbols), list(chars), [(i,) for i in range(len(chars))]
    left, right = list(range(len(chars))), list(range(len(chars)))
    for text, _ in sorted(own, key=lambda x: -x[1]):
        parts = list(text)
        while len(parts) > 2:
            best = min(((rank.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 40, 0))
            if best[0] == 1 << 40:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        if len(parts) == 2 and parts[0] in rank and parts[1] in rank:
            rank[text] = len(texts)
            left.append(rank[parts[0]])
            right.append(rank[parts[1]])
            texts.append(text)
            tokens.append(tuple(symbols[c] for c in text))
    merged = {(rank[t[:i]], rank[t[i:]]): k for t, k in rank.items() if len(t) > 1 for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank}
    return bpe.Pairs(tokens, left, right, merged), symbols, texts


class Codec:
    """One model's encoder and decoder; ``path`` names a SentencePiece model of type BPE or unigram."""

    def __init__(self, path: str):
        pieces, self.kind, self.prefix = read_model(path)
        if self.kind not in (_UNIGRAM, _BPE):
            raise ValueError("only BPE and unigram models are supported")
        self.pieces = [t for t, _, _ in pieces]
        self.types = [k for _, _, k in pieces]
        self.unknown = next((i for i, k in enumerate(self.types) if k == 2), 0)
        self.ids = {t: i for i, (t, _, k) in enumerate(pieces) if k in (_NORMAL, _USER)}
        self.bytes = {int(t[1:-1], 16): i for i, (t, _, k) in enumerate(pieces) if k == _BYTE}
        self.scores = {t: s for t, s, k in pieces if k in (_NORMAL, _USER)}
        self.longest = max(map(len, self.ids))
        self.runs = sorted((len(t) for t in self.ids if t and not t.strip(MARK)), reverse=True)
        self.low = min(self.scores.values()) - 10.0  # what the library charges for an unknown character
        self.pairs = None
        if self.kind == _BPE:
            self.pairs, self.symbols, texts = _bpe_pairs(pieces)
            # a character that only occurs in longer pieces has a place in the recurrence but no id
            self.rank_ids = np.array([self.ids.get(t, -1) for t in texts], np.int64)
            self.texts = texts
            self.code_rank = np.full(0x110000, bpe.OUTSIDE, np.int32)
            self.code_rank[[ord(c) for c in self.symbols]] = list(self.symbols.values())
        self._compile()

    def _compile(self) -> None:
        self.cuts = self.kind == _BPE and not any(MARK in t.lstrip(MARK) for t in self.ids)
        if self.cuts:
            beside = sorted({t[i : i + 2] for t in self.ids for i in range(len(t) - 1)} | {MARK * 2})
            self.first, self.second = np.zeros(0x110000, np.uint16), np.zeros(0x110000, np.uint16)
            for classes, k in ((self.first, 0), (self.second, 1)):
                chars = sorted({ord(x[k]) for x in beside})
                classes[chars] = np.arange(1, len(chars) + 1)
            self.beside = np.zeros((int(self.first.max()) + 1, int(self.second.max()) + 1), bool)
            for x, y in beside:
                self.beside[self.first[ord(x)], self.second[ord(y)]] = True
        self.known = Known()
        self.raw = [bytes([int(t[1:-1], 16)]) if k == _BYTE else t.encode() if k in (_NORMAL, _USER) else b"" for t, k in zip(self.pieces, self.types, strict=True)]
        self.raw_size = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "first", "second", "beside") and not k.startswith("raw")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._compile()

    # -- encoding --

    def normalise(self, text: str) -> str:
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def _outside(self, char: str) -> list[int]:
        b = [self.bytes.get(x) for x in char.encode("utf-8", "surrogatepass")]
        return [self.unknown] if None in b else b

    def run_ids(self, n: int) -> list[int]:
        """A run of marks: pieces of equal score merge from the left, so the run fills up with the longest ones."""
        out = []
        for size in self.runs:
            out += [self.ids[MARK * size]] * (n // size)
            n %= size
        return out + self._outside(MARK) * n

    def _finish(self, part: str, ranks: np.ndarray) -> list[int]:
        ids = np.where(ranks == bpe.OUTSIDE, -1, self.rank_ids[ranks])
        if (ids >= 0).all():
            return ids.tolist()
        out, at = [], 0
        for r, i in zip(ranks.tolist(), ids.tolist(), strict=True):
            n = 1 if r == bpe.OUTSIDE else len(self.texts[r])
            out += [i] if i >= 0 else self._outside(part[at])
            at += n
        return out

    def cut(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where the parts of some normalised texts begin; ``starts`` are those of the texts that aren't empty."""
        edge = np.zeros(len(codes), bool)
        if self.cuts:
            for i in range(0, len(codes) - 1, BLOCK):
                near = codes[i : i + BLOCK + 1]
                edge[i + 1 : i + len(near)] = ~self.beside[self.first[near[:-1]], self.second[near[1:]]]
        edge[starts] = True
        return np.flatnonzero(edge)

    def learn(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of some parts of a text: of all parts in turn, how many each has, and where each part's begin."""
        limit = 2 * self.longest
        long = np.flatnonzero(size > (limit if self.pairs is not None else 0)).tolist()
        own = {i: Stream(self).packed(_string(codes[begin[i] : begin[i] + size[i]])) for i in long}  # parts with ids of their own
        begin, size = begin.copy(), size.copy()
        size[long] = 0
        counts, ids = np.zeros(len(size), np.int64), np.zeros(0, np.int32)
        if len(own) < len(size):
            mark, last = ord(MARK), len(codes) - 1
            runs = {}
            for i in np.flatnonzero((size > 0) & (codes[begin] == mark) & ((size == 1) | (codes[np.minimum(begin + 1, last)] == mark))).tolist():
                part = codes[begin[i] : begin[i] + size[i]]
                runs[i] = m = int(np.argmax(part != mark)) or len(part)
                begin[i] += m - 1
                size[i] = size[i] - m + 1 if m < len(part) else 0
            flat = self.code_rank[codes[ragged(begin, size)]].astype(np.int64)
            counts, ranks = self.pairs.encode_words(flat, size)
            ids = np.where(ranks == bpe.OUTSIDE, -1, self.rank_ids[ranks]).astype(np.int32)
            end = np.cumsum(counts)
            outside = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(ids < 0, out=outside[1:])
            alone = self.symbols.get(MARK, bpe.OUTSIDE)
            for i in runs.keys() | set(np.flatnonzero(outside[end] != outside[end - counts]).tolist()):
                a, b, m = int(end[i] - counts[i]), int(end[i]), runs.get(i, 0)
                got = self._finish(_string(codes[begin[i] : begin[i] + size[i]]), ranks[a:b])
                if m and a == b:
                    got = self.run_ids(m)
                elif m > 1:  # a last mark that stays alone is part of the run
                    got = self.run_ids(m) + got[1:] if ranks[a] == alone else self.run_ids(m - 1) + got
                own[i] = np.array(got, np.int32).tobytes()
        at = np.cumsum(counts) - counts
        if own:
            which = np.fromiter(own, np.int64, len(own))
            counts[which] = [len(x) // 4 for x in own.values()]
            at[which] = len(ids) + np.cumsum(counts[which]) - counts[which]
            ids = np.concatenate([ids, np.frombuffer(b"".join(own.values()), np.int32)])
        return ids, counts, at

    def _plain(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray, ids: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For some parts, whether the bytes of their pieces are theirs."""
        ids = ids[ragged(at, counts)]
        got, want = self.spelled(ids), _string(codes[ragged(begin, size)]).encode("utf-8", "surrogatepass")
        width = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.raw_size[ids], out=width[1:])
        end = np.cumsum(counts)
        n_got, n_want = width[end] - width[end - counts], np.add.reduceat(_width(codes[ragged(begin, size)]), np.cumsum(size) - size)
        if got == want and (n_got == n_want).all():
            return np.ones(len(size), bool)
        a, b = np.cumsum(n_got), np.cumsum(n_want)
        return np.array([got[i - m : i] == want[j - n : j] for i, m, j, n in zip(a.tolist(), n_got.tolist(), b.tolist(), n_want.tolist(), strict=True)], bool)

    def ids_of(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of some normalised texts, the end of each text's ids, and whether its ids' pieces spell it.

        ``starts`` has where each text begins in ``codes``, and the end.
        """
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(starts) - 1, np.int64), np.ones(len(starts) - 1, bool)
        edges = np.append(self.cut(codes, starts[:-1][starts[1:] > starts[:-1]]), len(codes))
        got, upto, odd, i = [], np.zeros(len(edges), np.int64), np.zeros(len(edges), np.int32), 0
        while i < len(edges) - 1:
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + BLOCK, side="right")) - 1)
            block, begin, size = codes[edges[i] : edges[j]], edges[i:j] - edges[i], np.diff(edges[i : j + 1])
            keys = hashes(block, begin, size)
            first, number = distinct(block, begin, size, keys)
            ids, counts, at, plain = self.known.look_up(self, block, begin[first], size[first], keys[first])
            upto[i + 1 : j + 1], odd[i + 1 : j + 1] = counts[number], ~plain[number]
            got.append(ids[ragged(at[number], counts[number])])
            i = j
        np.cumsum(upto, out=upto)
        np.cumsum(odd, out=odd)
        text = np.searchsorted(edges, starts)  # each text's first part
        return np.concatenate(got), upto[text[1:]], odd[text[1:]] == odd[text[:-1]]

    def encode(self, text: str) -> list[int]:
        codes = _codes(self.normalise(text))
        return self.ids_of(codes, np.array([0, len(codes)]))[0].tolist()

    # -- decoding --

    def decode(self, ids: Iterable[int]) -> str:
        """The text of some ids; byte pieces are read as UTF-8, and invalid bytes become U+FFFD."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text

    def spelled(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids' pieces, before they are read as text."""
        n = self.raw_size[ids]
        shift = self.raw_start[ids] - (np.cumsum(n) - n)
        at = np.arange(int(n.sum()))
        return self.raw_bytes[at + np.repeat(shift, n)].tobytes()

    def gives(self, ids: np.ndarray, text: str, normal: str) -> bool:
        """Whether the ids decode to the text; where they spell its normal form and it holds no mark, they do."""
        if MARK not in text and self.spelled(ids) == normal.encode("utf-8", "surrogatepass"):
            return True
        return self.decode(ids.tolist()) == text


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _string(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


def _width(codes: np.ndarray) -> np.ndarray:
    """Bytes of each code point in UTF-8."""
    return 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``begin``, one run after the other."""
    at = np.repeat(begin - (np.cumsum(size) - size), size)
    at += np.arange(len(at))
    return at


def hashes(codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each part."""
    return words.range_hashes(codes, begin, begin + size)


def distinct(codes: np.ndarray, begin: np.ndarray, size: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different part, and for each part the number of its own among these; the parts fill ``codes``."""
    o = np.argsort(keys)
    new = np.ones(len(keys), bool)
    np.not_equal(keys[o[1:]], keys[o[:-1]], out=new[1:])
    first, number = o[new], np.empty(len(keys), np.int64)
    number[o] = np.cumsum(new) - 1
    like = first[number]
    if (size[like] == size).all() and (codes[ragged(begin[like], size)] == codes).all():
        return first, number
    seen: dict[bytes, int] = {}  # two parts have one hash
    for i, (b, n) in enumerate(zip(begin.tolist(), size.tolist(), strict=True)):
        number[i] = seen.setdefault(codes[b : b + n].tobytes(), len(seen))
    return np.unique(number, return_index=True)[1], number


class Known:
    """Parts with their ids, by hash. Beyond ``KEEP`` parts, those that have not come again are forgotten."""

    def __init__(self):
        self.keys, self.codes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int32)
        self.begin, self.size, self.at, self.counts = (np.zeros(0, np.int64) for _ in range(4))
        self.plain, self.again = np.zeros(0, bool), np.zeros(0, bool)

    def __len__(self) -> int:
        return len(self.keys)

    def _find(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which parts are known, and as which."""
        if not len(self):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.searchsorted(self.keys, keys)
        k[k == len(self)] = 0
        i = np.flatnonzero((self.keys[k] == keys) & (self.size[k] == size))
        k = k[i]
        if len(i):
            same = codes[ragged(begin[i], size[i])] == self.codes[ragged(self.begin[k], size[i])]
            if not same.all():
                same = np.logical_and.reduceat(same, np.cumsum(size[i]) - size[i])
                i, k = i[same], k[same]
        return i, k

    def look_up(self, codec: Codec, codes: np.ndarray, begin: np.ndarray, size: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, the number of each part's, where they begin, and whether they spell the part; new parts are learned."""
        i, k = self._find(codes, begin, size, keys)
        new = np.ones(len(keys), bool)
        new[i] = False
        new = np.flatnonzero(new)
        counts, at, plain = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64), np.empty(len(keys), bool)
        counts[i], at[i], plain[i] = self.counts[k], self.at[k], self.plain[k]
        ids = self.ids
        self.again[k] = True
        full = len(self) + len(new) > KEEP
        if len(new):
            fresh, n, a = codec.learn(codes, begin[new], size[new])
            counts[new], at[new] = n, a + len(ids)
            plain[new] = codec._plain(codes, begin[new], size[new], fresh, n, a)
            ids = np.concatenate([ids, fresh])
        if full:
            stay = self.again
            if np.count_nonzero(stay) + len(new) > KEEP:
                stay = np.zeros(len(self), bool)
                stay[k] = True
            stay = np.flatnonzero(stay)
        else:
            stay = np.arange(len(self))
        if full or len(new):
            self._take(stay, self.again if not full else np.zeros(len(self), bool), codes, ids, keys[new], begin[new], size[new], counts[new], at[new], plain[new])
        return ids, counts, at, plain

    def _take(self, stay, again, codes, ids, keys, begin, size, counts, at, plain) -> None:
        """Hold the parts of before that stay, and new ones; of two with one hash the first."""
        held = np.concatenate([self.codes[ragged(self.begin[stay], self.size[stay])], codes[ragged(begin, size)]])
        size, counts, at = (np.concatenate([x[stay], y]) for x, y in ((self.size, size), (self.counts, counts), (self.at, at)))
        begin = np.cumsum(size) - size
        keys, first = np.unique(np.concatenate([self.keys[stay], keys]), return_index=True)
        plain, again = np.concatenate([self.plain[stay], plain])[first], np.concatenate([again[stay], np.zeros(len(plain), bool)])[first]
        self.codes, self.ids = held[ragged(begin[first], size[first])], ids[ragged(at[first], counts[first])]
        self.keys, self.plain, self.again = keys, plain, again
        self.size, self.counts = size[first], counts[first]
        self.begin, self.at = np.cumsum(self.size) - self.size, np.cumsum(self.counts) - self.counts


class Stream:
    """Encode a text that arrives in parts, in memory bounded by the longest piece.

    ``push`` returns the ids that have become final, ``close`` the rest. Text must already be normalised
    (``Codec.normalise``; a mark before the first part only).
    """

    def __init__(self, codec: Codec):
        self.codec = codec
        self.text: list[str] = []  # characters after the last final boundary
        self.best = [0.0]
        self.last: list = [None]  # per position the piece that ends there, as text
        self.rank = [bpe.OUTSIDE]
        self.before = bpe.OUTSIDE  # the final piece before the window, for compatibility; OUTSIDE fits anything
        self.run = 0  # marks read, of which the last may belong to what follows
        self.pending = 0  # marks of a run before the one that the window begins with
        self.held = 0

    def _step(self) -> None:
        c, i = self.codec, len(self.text)
        if c.pairs is not None:
            symbols = tuple(c.symbols.get(x, bpe.OUTSIDE) for x in self.text[max(0, i - c.longest) :])
            if symbols[-1] == bpe.OUTSIDE:
                self.last.append(self.text[-1])
                self.rank.append(bpe.OUTSIDE)
                return
            for n in c.pairs.lengths:
                t = c.pairs.by_symbols.get(symbols[-n:]) if n <= len(symbols) else None
                if t is not None and c.pairs.fits(self.rank[i - n] if i > n else self.before, t):
                    self.last.append("".join(self.text[i - n :]))
                    self.rank.append(t)
                    return
            raise ValueError("no piece ends here")
        best, piece = -np.inf, self.text[-1]
        for n in range(1, min(i, c.longest) + 1):
            t = "".join(self.text[i - n :])
            s = c.scores.get(t, c.low if n == 1 else None)
            if s is not None and self.best[i - n] + s > best:
                best, piece = self.best[i - n] + s, t
        self.best.append(best)
        self.last.append(piece)

    def _final(self) -> int:
        """The last boundary that the paths of all positions a later piece can start from have in common."""
        ends = list(range(max(0, len(self.text) - self.codec.longest + 1), len(self.text) + 1))
        paths = set(ends)
        while len(paths) > 1:
            top = max(paths)
            if top == 0:
                break
            paths.discard(top)
            paths.add(top - len(self.last[top]))
        return paths.pop()

    def _take(self, upto: int) -> list[int]:
        parts, i = [], upto
        while i:
            parts.append((self.last[i], self.rank[i] if self.codec.pairs is not None else None))
            i -= len(self.last[i])
        ids = []
        for text, rank in reversed(parts):
            known = self.codec.ids.get(text)
            ids += [known] if known is not None and rank != bpe.OUTSIDE else self.codec._outside(text)
        if self.pending and parts:  # a last mark that stays alone is part of its run
            alone = parts[-1][0] == MARK
            ids = self.codec.run_ids(self.pending + alone) + ids[alone:]
            self.pending = 0
        if self.codec.pairs is not None and upto:
            self.before = self.rank[upto]
        del self.text[:upto]
        self.last, self.best = [None, *self.last[upto + 1 :]], [b - self.best[upto] for b in self.best[upto:]] if self.codec.pairs is None else [0.0]
        self.rank = [bpe.OUTSIDE, *self.rank[upto + 1 :]] if self.codec.pairs is not None else [bpe.OUTSIDE]
        return ids

    def push(self, text: str) -> list[int]:
        out = []
        for ch in text:
            if self.codec.pairs is not None and ch == MARK and (self.run or not self.text or self.text[-1] != MARK):
                out += self._rest()  # no piece goes on past a mark that follows something else
                self.run += 1
                continue
            if self.run:
                self.pending, self.run = self.run - 1, 0
                self.text.append(MARK)
                self._step()
            self.text.append(ch)
            self._step()
            self.held = max(self.held, len(self.text))
            if len(self.text) >= 2 * self.codec.longest:
                out += self._take(self._final())
        return out

    def _rest(self) -> list[int]:
        out = self._take(len(self.text))
        self.before = bpe.OUTSIDE
        return out

    def close(self) -> list[int]:
        n, self.run = self.run, 0
        return self._rest() + (self.codec.run_ids(n) if n else [])

    def packed(self, text: str) -> bytes:
        """The ids of a whole text, four bytes each."""
        ids = array("i")
        for i in range(0, len(text), 4096):
            ids.extend(self.push(text[i : i + 4096]))
        ids.extend(self.close())
        return ids.tobytes()


_KIND = "struct<ids:array<int>,round_trip:boolean>"


def _normal(codec: Codec, chunk: words.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of a chunk's texts in normal form, where each begins (and the end), and which texts hold a mark."""
    codes = np.frombuffer(chunk.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = chunk.offsets
    if len(codes) < len(chunk.data):
        upto = np.zeros(len(chunk.data) + 1, np.int32)
        np.cumsum((chunk.data & 0xC0) != 0x80, out=upto[1:], dtype=np.int32)
        starts = upto[chunk.offsets].astype(np.int64)
    mark = ord(MARK)
    marked = np.zeros(len(chunk), bool)
    marked[np.searchsorted(starts, np.flatnonzero(codes == mark), side="right") - 1] = True
    codes = np.where(codes == 0x20, np.uint32(mark), codes)
    if codec.prefix:
        filled = starts[1:] > starts[:-1]
        codes = np.insert(codes, starts[:-1][filled], mark)
        starts = starts + np.concatenate([[0], np.cumsum(filled)])
    return codes, starts, marked


def _encoder(codec: Callable[[], Codec]):
    def encode(text: pa.Array) -> pa.Array:
        c = codec()
        parts, ends, same, n = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], [np.zeros(0, bool)], 0
        for k in words.chunks(text):  # a run of texts at a time
            codes, starts, marked = _normal(c, k)
            ids, upto, spelled = c.ids_of(codes, starts)
            good = spelled & ~marked
            for i in np.flatnonzero(~good).tolist():
                good[i] = c.decode(ids[upto[i - 1] if i else 0 : upto[i]].tolist()) == (text[k.first + i].as_py() or "")
            parts.append(ids)
            ends.append(upto + n)
            same.append(good)
            n += len(ids)
        off, empty = np.concatenate(ends).astype(np.int32), text.is_null()
        ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(parts)), mask=empty)
        return pa.StructArray.from_arrays([ids, pc.if_else(empty, None, pa.array(np.concatenate(same)))], ["ids", "round_trip"])

    return encode


def _shared(docs: DataFrame, path: str) -> Callable[[], Codec]:
    """The codec as a broadcast (a vocabulary's size is fixed), so that a worker keeps what it has learned."""
    held = docs.sparkSession.sparkContext.broadcast(Codec(path))
    return lambda: held.value


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "pieces") -> DataFrame:
    """``docs`` with a column ``out``: ids, and round_trip (whether decoding them gives the text again)."""
    ship(docs.sparkSession)
    return docs.withColumn(out, arrow_udf(words.bounded(_encoder(_shared(docs, path))), returnType=_KIND).asNondeterministic()(F.col(text_col)))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with a column ``out``: the text of the ids; null ids give null."""
    ship(rows.sparkSession)
    codec = _shared(rows, path)

    def read(ids: pa.Array) -> pa.Array:
        c = codec()
        return pa.array([None if x is None else c.decode(x) for x in ids.to_pylist()], pa.string())

    return rows.withColumn(out, arrow_udf(words.bounded(read), returnType="string").asNondeterministic()(F.col(ids_col)))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Document ids with their ids and number of ids."""
    p = F.col("pieces")
    return encode(docs.select("doc_id", "text"), path).select("doc_id", F.coalesce(F.size(p["ids"]), F.lit(0)).cast("long").alias("n_ids"), p["ids"].alias("ids"), p["round_trip"].alias("round_trip"))


def op4_sentencepiece_codec(spark, sf_dir: str) -> DataFrame:
    """Every document with its ids, and whether they decode to its text."""
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
