"""Token counts and the SentencePiece codec against the libraries, and streaming against whole encoding."""

import random

import pytest
from helpers import ODD, prose, table

from kairoframe.llm import sentencepiece_codec as codec
from kairoframe.llm import token_counts as counts

P = pytest.importorskip("public_tokenizers")
ALPHABET = "abc ABC'sreve\n\t\r\x1c\x85\xa0  éñ中文日本한글벨😀!!--==12345   <|endoftext|>"


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))) for _ in range(n)] + ["a" * 300, "中文" * 200, "<|endoftext|><|endoftext|>x  ", " " * 47 + "x", "\n" * 20]


@pytest.fixture(scope="module")
def counter():
    return counts.Counter(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def pieces():
    return codec.Codec(P.path("piece_bpe_32k.model"))


def test_counts_equal_the_library(spark, counter):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [*ODD, *odd_texts(300), prose(1, 20000)]
    got = counts.count_tokens(table(spark, texts), P.path("byte_bpe_50k.json")).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        n = len(lib.encode(r["text"] or "", add_special_tokens=False).ids)
        assert r["tokens"]["n_tokens"] == n
        fit = r["tokens"]["fit_chars"]
        assert (fit is not None) == (n > 512)
        if fit is not None:
            assert len(lib.encode(r["text"][:fit], add_special_tokens=False).ids) <= 512 + 1
    assert counts.count_tokens(table(spark, texts).limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_every_prefix(counter):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for t in [*odd_texts(60, 7), "a  <|endoftext|>b", "<|endoftext|><|endoftext|>", "so!!<|endoftext|> x", "<|endof<|endoftext|>text|>"]:
        if len(t) > 60:
            continue
        p = counter.prefix_counts(t)
        assert [p.count(n) for n in range(len(t) + 1)] == [len(lib.encode(t[:n], add_special_tokens=False).ids) for n in range(len(t) + 1)]
    p = counter.prefix_counts("one two three four")
    assert p.fit(0) == 0 and p.fit(2) == len("one two") and p.fit(99) == len(p.text)


def test_ids_equal_the_library(spark, pieces):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = [*ODD, *odd_texts(300), *(" " * k + x for k in range(40) for x in ("", "the", "벨", "\n", "a  b")), prose(1, 20000)]
    got = codec.encode(table(spark, texts), P.path("piece_bpe_32k.model")).collect()
    for r in got:
        if r["text"] is None:
            assert r["pieces"]["ids"] is None
        else:
            assert r["pieces"]["ids"] == lib.encode(r["text"]) and r["pieces"]["round_trip"]
    assert len(got) == len(texts) + 2
    ids = codec.encode(table(spark, texts), P.path("piece_bpe_32k.model")).selectExpr("text AS want", "pieces.ids AS ids")
    assert codec.decode(ids, P.path("piece_bpe_32k.model")).where("NOT (want <=> text)").count() == 0
    assert codec.encode(table(spark, texts).limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_streaming_gives_the_same_ids_in_a_bounded_window(pieces):
    rng = random.Random(2)
    for t in [*odd_texts(150, 3), prose(2, 400)]:
        s, n, out, i = codec.Stream(pieces), pieces.normalise(t), [], 0
        while i < len(n):
            k = rng.randint(1, 7)
            out += s.push(n[i : i + k])
            i += k
        assert out + s.close() == pieces.encode(t)
        assert s.held <= 2 * pieces.longest


def test_long_parts_go_through_the_window(monkeypatch):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib, c, held = sentencepiece.SentencePieceProcessor(model_file=path), codec.Codec(path), []
    packed = codec.Stream.packed

    def spied(self, text):
        ids = packed(self, text)
        held.append((len(text), self.held))
        return ids

    monkeypatch.setattr(codec.Stream, "packed", spied, raising=False)
    monkeypatch.setattr(c.pairs, "prefixes", lambda symbols: pytest.fail("a long part keeps every position"))
    rng = random.Random(4)
    texts = ["".join(rng.choice(x) for _ in range(n)) for x in ("abcdefghij", "etaoinshr", "日本語ab벨", "=-_", "a") for n in (32, 33, 200, 3000)]
    for t in [*texts, " " * 60 + texts[3], texts[7] + "\n" + texts[11] + "  x"]:
        assert c.encode(t) == lib.encode(t)
    assert max(n for n, _ in held) > 3000 and all(n > 2 * c.longest and w <= 2 * c.longest for n, w in held)


def _field(n, kind, data):
    return bytes([n << 3 | kind]) + (bytes([len(data)]) + data if kind == 2 else data)


def test_unigram_models(tmp_path):
    """A model put together by hand: the best path by score, checked against all segmentations."""
    import struct

    vocab = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -2.5, 1), ("▁a", -3.5, 1), ("aba", -4.0, 1), ("bb", -7.0, 1)]
    body = b"".join(_field(1, 2, _field(1, 2, t.encode()) + _field(2, 5, struct.pack("<f", s)) + _field(3, 0, bytes([k]))) for t, s, k in vocab)
    path = tmp_path / "m.model"
    path.write_bytes(body + _field(2, 2, _field(3, 0, bytes([1]))))
    c = codec.Codec(str(path))
    score = {t: s for t, s, k in vocab if k == 1}

    def best(t):
        if not t:
            return 0.0
        return max(score[t[:n]] + best(t[n:]) for n in range(1, 4) if t[:n] in score)

    rng = random.Random(1)
    for _ in range(60):
        t = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 10)))
        ids = c.encode(t)
        assert "".join(c.pieces[i] for i in ids) == c.normalise(t) and abs(sum(score[c.pieces[i]] for i in ids) - best(c.normalise(t))) < 1e-5
        s, out = codec.Stream(c), []
        for ch in c.normalise(t):
            out += s.push(ch)
        assert out + s.close() == ids and c.decode(ids) == t


def test_parts_that_come_again_stay_known(monkeypatch):
    monkeypatch.setattr(codec, "KEEP", 6)
    c = codec.Codec(P.path("piece_bpe_32k.model"))
    want = codec.Codec(P.path("piece_bpe_32k.model"))
    learned = []
    encode_words = c.pairs.encode_words
    monkeypatch.setattr(c.pairs, "encode_words", lambda flat, sizes: learned.append(len(sizes)) or encode_words(flat, sizes))
    texts = [f"the same words {a} {b}" for a, b in (("new", "ones"), ("other", "ones"), ("again", "others"), ("quite", "different"))]
    assert [c.encode(t) for t in texts] == [want.encode(t) for t in texts]
    assert learned == [5, 1, 2, 2] and len(c.known) <= 6


def test_round_trip_by_spelling():
    import numpy as np

    c = codec.Codec(P.path("piece_bpe_32k.model"))
    for t in ("", " ", "a", "two  words\n", "é漢 \U0001f600", "a▁b", "▁", "x" * 100):
        ids = c.encode(t)
        assert c.gives(np.array(ids, np.int32), t, c.normalise(t)) == (c.decode(ids) == t), t
        assert not c.gives(np.array([*ids, 300], np.int32), t, c.normalise(t))


def test_parts_end_where_no_piece_goes_on(monkeypatch):
    """A word is learned once, whatever stands behind it; before, each word with its punctuation was a part."""
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib, c = sentencepiece.SentencePieceProcessor(model_file=path), codec.Codec(path)
    learned = []
    encode_words = c.pairs.encode_words
    monkeypatch.setattr(c.pairs, "encode_words", lambda flat, sizes: learned.append(len(sizes)) or encode_words(flat, sizes))
    pairs = {t[i : i + 2] for t in c.ids for i in range(len(t) - 1)}
    ends = [x for x in ",;#%&" if "e" + x not in pairs and x + "▁" not in pairs]
    assert len(ends) > 2
    text = " ".join(f"stone{x}" for x in ["", *ends])
    assert c.encode(text) == lib.encode(text) and sum(learned) == 1 + len(ends)
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice(ALPHABET + "the and") for _ in range(rng.randint(0, 60)))
        assert c.encode(t) == lib.encode(t), t


@pytest.mark.parametrize("keep", [5, 60_000])
@pytest.mark.parametrize("clash", [0, 1, 3])
def test_parts_of_one_hash_are_told_apart(monkeypatch, clash, keep):
    import numpy as np
    import pyarrow as pa
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib, c = sentencepiece.SentencePieceProcessor(model_file=path), codec.Codec(path)
    hashes = codec.hashes
    monkeypatch.setattr(codec, "KEEP", keep)
    if clash:
        monkeypatch.setattr(codec, "hashes", lambda *a: hashes(*a) % np.uint64(clash))
    encode = codec._encoder(lambda: c)
    for seed in range(4):
        texts = [None, "", *odd_texts(40, seed), "a▁b", "▁", "", *ODD, "stone, stone; stones", None]
        got = encode(pa.array(["left out", *texts]).slice(1))
        for t, r in zip(texts, got.to_pylist(), strict=True):
            assert r["ids"] == (None if t is None else lib.encode(t)), t
            assert r["round_trip"] == (None if t is None else lib.decode(lib.encode(t)) == t), t
    assert encode(pa.array([], pa.string())).to_pylist() == [] and encode(pa.array([None, ""])).to_pylist() == [{"ids": None, "round_trip": None}, {"ids": [], "round_trip": True}]


def test_texts_longer_than_a_block(monkeypatch):
    import pyarrow as pa
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib, c = sentencepiece.SentencePieceProcessor(model_file=path), codec.Codec(path)
    monkeypatch.setattr(codec, "BLOCK", 20)
    sizes = []
    distinct = codec.distinct
    monkeypatch.setattr(codec, "distinct", lambda codes, *a: sizes.append((len(codes), len(a[0]))) or distinct(codes, *a))
    texts = [None, *ODD[1:], *odd_texts(60, 9), prose(3, 60), "a▁b " * 9]
    for t, r in zip(texts, codec._encoder(lambda: c)(pa.array(texts)).to_pylist(), strict=True):
        assert r["ids"] == (None if t is None else lib.encode(t)) and r["round_trip"] == (None if t is None else lib.decode(lib.encode(t)) == t)
    assert len(sizes) > 100 and all(n <= 20 or parts == 1 for n, parts in sizes)
