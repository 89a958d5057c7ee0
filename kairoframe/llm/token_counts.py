"""Token counts by prefix dynamic programming over a byte-level BPE vocabulary.

A text is cut into the vocabulary's pieces (its splitting pattern); inside a piece the recurrence of ``bpe`` gives the
exact token count of every prefix, and counts add up over pieces. So one pass answers how many tokens a text has, how
many any prefix has, and how much of it fits a budget, without encoding anything again. Pieces that a worker has
met before are looked up (at most ``KEEP`` of them are kept); new ones of a run of texts are worked out together.

Defined results: a null or empty text has 0 tokens and 0 bytes; the vocabulary's added tokens count as one token where
their string stands in a text, as its library does by default; repeated rows each get their own count. Texts are
counted whole.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..session import ship
from . import bpe, words

#: Pieces that a worker remembers at most.
KEEP = 150_000
LIMIT = 512
#: The splitting pattern of byte-level BPE vocabularies; white space by its Unicode property.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next free one from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Counter:
    """Counts of one vocabulary; ``path`` names a byte-level BPE file in the tokenizers library's format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.pairs, _, _ = bpe.from_merges(byte_symbols(), merges)
        self.added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self._compile()

    def _compile(self) -> None:
        self.find = regex.compile(PIECES).findall
        self.cut = regex.compile(f"({'|'.join(map(regex.escape, self.added))})").split if self.added else None
        self.known: dict[str, int] = dict.fromkeys(self.added, 1)  # no other piece is equal to one of these

    def __getstate__(self):
        return {"pairs": self.pairs, "added": self.added}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._compile()

    def learn(self, pieces: set[str]) -> None:
        """Work out the pieces that aren't known yet."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > KEEP:
            self.known = dict.fromkeys(self.added, 1)
            new = [p for p in pieces if p not in self.known]
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        counts, _ = self.pairs.encode_words(flat, np.fromiter(map(len, raw), np.int64, len(raw)), ids=False)
        self.known.update(zip(new, counts.tolist(), strict=True))

    def pieces(self, text: str) -> list[str]:
        """A text's pieces; an added token is one."""
        if self.cut is None or not any(a in text for a in self.added):
            return self.find(text)
        out = []
        for i, part in enumerate(self.cut(text)):
            out += [part] if i % 2 else self.find(part)
        return out

    def count(self, text: str | None) -> int:
        pieces = self.pieces(text or "")
        self.learn(set(pieces))
        return sum(map(self.known.__getitem__, pieces))

    def prefix_counts(self, text: str) -> PrefixCounts:
        return PrefixCounts(self, text)


class PrefixCounts:
    """Exact token counts of the prefixes of one text, by code points."""

    def __init__(self, counter: Counter, text: str):
        self.counter, self.text = counter, text
        pieces = counter.pieces(text)
        counter.learn(set(pieces))
        self.whole = {k for k, p in enumerate(pieces) if p in counter.added}
        self.starts = [0, *accumulate(map(len, pieces))]
        self.before = [0, *accumulate(counter.known[p] for p in pieces)]
        self.inside: dict[int, list[int]] = {}

    def _piece(self, k: int) -> list[int]:
        """Counts of the prefixes of piece k, by code points."""
        if k not in self.inside:
            piece = self.text[self.starts[k] : self.starts[k + 1]]
            _, count = self.counter.pairs.prefixes(piece.encode("utf-8", "surrogatepass"))
            ends = accumulate(len(c.encode("utf-8", "surrogatepass")) for c in piece)
            self.inside[k] = [0, *(count[e] for e in ends)]
        return self.inside[k]

    def count(self, n: int) -> int:
        """Tokens of the first n code points."""
        n = max(0, min(n, len(self.text)))
        k = min(bisect_right(self.starts, n) - 1, len(self.before) - 1)
        part = self.text[self.starts[k] : n]
        if part and k in self.whole:  # a part of an added token is text, which may belong to the piece before it
            k -= k > 0 and k - 1 not in self.whole
            return self.before[k] + self.counter.count(self.text[self.starts[k] : n])
        # white space at the end, or part of a contraction, may split otherwise than in the whole text
        if self.text[:n][-1:].isspace():
            k -= part == ""
            while k and k - 1 not in self.whole and self.text[self.starts[k - 1] : self.starts[k]].isspace():
                k -= 1
        elif part[:1] != "'":
            return self.before[k] + (self._piece(k)[len(part)] if part else 0)
        return self.before[k] + self.counter.count(self.text[self.starts[k] : n])

    def fit(self, budget: int) -> int:
        """Code points of the longest run of whole pieces, from the start, of at most ``budget`` tokens."""
        return self.starts[bisect_right(self.before, budget) - 1]


def _counting(get: Callable[[], Counter], limit: int):
    def count(text: pa.Array) -> pa.Array:
        counter = get()
        n_tokens, fit = [], []
        for k in words.chunks(text):  # a run of texts at a time
            rows = [counter.pieces(t or "") for t in text.slice(k.first, len(k)).to_pylist()]
            counter.learn({p for pieces in rows for p in pieces})
            known = counter.known.__getitem__
            for pieces in rows:
                total = sum(map(known, pieces))
                n_tokens.append(total)
                if total > limit:
                    upto = bisect_right(list(accumulate(map(known, pieces))), limit)
                    fit.append(sum(map(len, pieces[:upto])))
                else:
                    fit.append(None)
        return pa.StructArray.from_arrays([pa.array(n_tokens, pa.int64()), pa.array(fit, pa.int64())], ["n_tokens", "fit_chars"])

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, text_col: str = "text", out: str = "tokens") -> DataFrame:
    """``docs`` with a column ``out`` (it replaces one of that name): n_tokens, and for texts over ``limit`` the code points of whole pieces that fit it."""
    ship(docs.sparkSession)
    kind = "struct<n_tokens:long,fit_chars:long>"
    held = docs.sparkSession.sparkContext.broadcast(Counter(path))  # a vocabulary's size is fixed; a worker keeps what it has learned
    return docs.withColumn(out, arrow_udf(words.bounded(_counting(lambda: held.value, limit)), returnType=kind).asNondeterministic()(F.col(text_col)))


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every document with its bytes and tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    t = F.col("tokens")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), t["n_tokens"].alias("n_tokens"), (t["n_tokens"] > LIMIT).alias("over_limit"), t["fit_chars"].alias("fit_chars")
    )
