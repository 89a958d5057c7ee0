"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact verification.

1. A scan turns each text into its set of word shingles and keeps its size, a 64-bit class id of the set, the bands of
   its MinHash signature and the signature's low bytes. Documents with equal sets are one class from here on, summed up
   before they are shuffled, so a group of copies of any size is one row.
2. Classes that share a band are candidates. In each bucket every member is compared with the bucket's pivot, not with
   every other member, so the pairs grow with the members. The pivot is the member that meets most others over all of its
   bands: of a group of near copies, the one that they were made from.
3. A pair's signatures are compared batch by batch; it is dropped once the posterior probability that its similarity
   reaches the threshold falls under ``miss``. (Low bytes agree by chance once in 256, which only keeps more pairs.) What
   is left is verified on the full sets, read again from the texts of those classes only.
4. Verified links give components. Only buckets with members outside their pivot's component can hide a link. Those
   members meet all others block by block (``BLOCK`` of them, as expected, against as many), with their sets as 32-bit
   hashes; members of the pivot's component don't meet each other. Pairs of one component are passed over, the others
   pruned as before and counted out in the block. Only what links a member with another component leaves it, the closest
   pair of each, and is verified on the full sets. So no candidate is left out, and no list of all pairs is made: of a
   bucket of m members, u of them outside, about u * m / BLOCK rows are dealt out.

With the default bands a pair at the threshold is missed with odds of about 7e-7, and less above it.

Defined results: a text without words is in no class, linked with nothing and kept; a text of fewer words than a
shingle is one shingle; repeated rows are copies; a null id takes part, but never gives a group its id. Classes are told
apart by 64-bit hashes; n different sets share one with odds of about n*n / 2**65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..session import Tables, ship
from . import words as W
from .components import components

#: Ids of classes that are broadcast at most; beyond that the join is shuffled.
BROADCAST_IDS = 500_000
#: Members of a bucket that meet in one block, expected.
BLOCK = 512
_PAIRS = 1 << 16


@dataclass(frozen=True)
class Similarity:
    """What counts as near: shingles of ``words`` words, 100 * intersection >= ``percent`` * union."""

    words: int = 5
    percent: int = 80
    rows: int = 5
    bands: int = 36
    batch: int = 36
    miss: float = 1e-7

    @property
    def hashes(self) -> int:
        return self.rows * self.bands


#: For a similarity of 0.85 or more on three words.
COPIES_85 = Similarity(words=3, percent=85, rows=6, bands=30)


def shingle_sets(c: W.Chunk, n: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    w = W.split(c, W.SOLID)
    begin = w.first_of()
    hashes, at = W.windows(w.hashes, w.doc, n)
    first = np.searchsorted(at, begin)
    for i in range(len(c)):
        total = begin[i + 1] - begin[i]
        if total >= n:
            yield np.unique(hashes[first[i] : first[i + 1]])
        elif total:
            yield np.array([W.window_hash(w.hashes[begin[i] : begin[i + 1]])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def class_id(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of each hash function over a set."""
    x, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        h = np.multiply.outer(a, x[i : i + 1024])
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h += b[:, None]
        np.minimum(out, h.min(1), out=out)
    return out


def band_hashes(sigs: np.ndarray, s: Similarity) -> np.ndarray:
    """One hash for each band of each signature."""
    m = sigs.reshape(len(sigs), s.bands, s.rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(s.bands, dtype=np.uint64), m.shape[:2]).copy()
    for k in range(s.rows):
        h = W.mix(h * np.uint64(0x9E3779B97F4A7C15) + m[:, :, k] + np.uint64(k + 1))
    return h.view(np.int64)


def _sketcher(s: Similarity):
    a, b = _family(s.hashes)

    def sketch(text: pa.Array) -> pa.Array:
        sizes, ids, sigs, bands = [], [], [], []
        for c in W.chunks(text):
            found = []
            for x in shingle_sets(c, s.words):
                sizes.append(len(x))
                ids.append(class_id(x) if len(x) else None)
                found.append(signature(x, a, b))
            low = np.stack(found)
            bands.append(band_hashes(low, s).reshape(-1))
            sigs += [low[i].astype(np.uint8).tobytes() for i in range(len(low))]
        flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(sigs, pa.binary()), W.lists(flat, np.full(len(text), s.bands), pa.int64())], ["n", "cid", "sig", "bands"])

    return arrow_udf(W.bounded(sketch), returnType="struct<n:long,cid:long,sig:binary,bands:array<long>>").asNondeterministic()


def _matrix(sig: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(sig.to_pylist()), np.uint8).reshape(len(sig), width)


def least_matches(s: Similarity) -> list[tuple[int, int]]:
    """For each number of compared hashes the fewest matches that a pair may have to stay.

    With a uniform prior, k matches of m leave the similarity with a Beta(k + 1, m - k + 1) posterior, whose probability
    of reaching t is that of at most k successes in m + 1 trials at t.
    """
    t, out = s.percent / 100, []
    for m in range(s.batch, s.hashes + 1, s.batch):
        total, k = 0.0, -1
        while total < s.miss:
            k += 1
            total += comb(m + 1, k) * t**k * (1 - t) ** (m + 1 - k)
        out.append((m, k))
    return out


def alike(x: np.ndarray, y: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Which of the rows of two signature tables may still be near, batch by batch."""
    alive, matched, at = np.arange(len(x)), np.zeros(len(x), np.int64), 0
    for m, k in bounds:
        matched = matched + (x[alive, at:m] == y[alive, at:m]).sum(1)
        alive, matched, at = alive[matched >= k], matched[matched >= k], m
    out = np.zeros(len(x), bool)
    out[alive] = True
    return out


def _pruner(s: Similarity):
    bounds = least_matches(s)

    def keep(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(alike(_matrix(x, s.hashes), _matrix(y, s.hashes), bounds))

    return arrow_udf(W.bounded(keep), returnType="boolean").asNondeterministic()


def _meeting(s: Similarity):
    """Pairs (a, b) of blocks that may be near. Rows come sorted by (band, lo, hi); a key's rows are two blocks at most."""
    bounds = least_matches(s)

    def within(cid: np.ndarray, n: np.ndarray, root: np.ndarray, block: np.ndarray, sig: np.ndarray, sets: list[bytes], cross: bool) -> Iterator[tuple[int, int]]:
        m, ids, begin = len(cid), None, None
        for first in range(0, m, step := max(1, _PAIRS // max(m, 1))):
            i = np.repeat(np.arange(first, min(first + step, m)), m)
            j = np.tile(np.arange(m), min(first + step, m) - first)
            ok = (i < j) & (root[i] != root[j]) & (100 * np.minimum(n[i], n[j]) >= s.percent * np.maximum(n[i], n[j]))
            if cross:
                ok &= block[i] != block[j]
            i, j = i[ok], j[ok]
            near = alike(sig[i], sig[j], bounds)
            i, j = i[near], j[near]
            if len(i) and ids is None:  # the block's shingles, numbered
                parts = [np.frombuffer(x, np.uint32) for x in sets]
                begin = np.cumsum([0, *map(len, parts)])
                values, ids = np.unique(np.concatenate(parts), return_inverse=True)
                mark = np.zeros(len(values), np.int64)
            cuts = np.append(np.flatnonzero(np.append(True, i[1:] != i[:-1])), len(i)) if len(i) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                x, ys = i[a], j[a:b]
                mark[ids[begin[x] : begin[x + 1]]] = 1
                both = np.add.reduceat(mark[ids], begin[:-1])[ys]
                mark[ids[begin[x] : begin[x + 1]]] = 0
                share = both / (n[x] + n[ys] - both)
                linked = np.flatnonzero(100 * both >= s.percent * (n[x] + n[ys] - both))
                best: dict[int, int] = {}
                for k in linked[np.argsort(share[linked])].tolist():
                    best[int(root[ys[k]])] = int(cid[ys[k]])
                for y in best.values():
                    yield int(cid[x]), y

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def work(t: pa.Table) -> pa.RecordBatch:
            band, lo, hi, block, cid, n, root = (t.column(k).to_numpy() for k in ("band", "lo", "hi", "block", "cid", "n", "root"))
            sig = _matrix(t.column("sig").combine_chunks(), s.hashes)
            new = np.ones(len(band), bool)
            new[1:] = (band[1:] != band[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            cuts = np.append(np.flatnonzero(new), len(band))
            sets = t.column("items").to_pylist()
            pairs = {(min(x, y), max(x, y)) for i, j in zip(cuts[:-1], cuts[1:], strict=True) for x, y in within(cid[i:j], n[i:j], root[i:j], block[i:j], sig[i:j], sets[i:j], lo[i] != hi[i])}
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in sorted(pairs)], pa.int64()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            t = pa.Table.from_batches([b])
            last = [t.column(k)[-1].as_py() for k in ("band", "lo", "hi")] if len(t) else None
            if last is None:
                continue
            same = np.ones(len(t), bool)
            for k, v in zip(("band", "lo", "hi"), last, strict=True):
                same &= t.column(k).to_numpy() == v
            cut_at = int(np.flatnonzero(same)[0])
            if cut_at:
                yield work(pa.concat_tables([*held, t.slice(0, cut_at)]))
                held = [t.slice(cut_at)]
                W.release()
            else:  # the batch goes on with one key, or begins another after what is held
                if held and [held[0].column(k)[0].as_py() for k in ("band", "lo", "hi")] != last:
                    yield work(pa.concat_tables(held))
                    held = []
                held.append(t)
        if held:
            yield work(pa.concat_tables(held))

    return meet


def _set_reader(s: Similarity, bits: int):
    def read(text: pa.Array) -> pa.Array:
        ids, sets = [], []
        for c in W.chunks(text):
            for x in shingle_sets(c, s.words):
                ids.append(class_id(x) if len(x) else None)
                sets.append(x.tobytes() if bits == 64 else (x >> np.uint64(32)).astype(np.uint32).tobytes())
        return pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["cid", "items"])

    return arrow_udf(W.bounded(read), returnType="struct<cid:long,items:binary>").asNondeterministic()


def _verifier(s: Similarity):
    def linked(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(x.to_pylist(), y.to_pylist(), strict=True):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            if len(a) > len(b):
                a, b = b, a
            k = np.searchsorted(b, a)
            k[k == len(b)] = 0
            both = int((b[k] == a).sum())
            out.append(100 * both >= s.percent * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    return arrow_udf(W.bounded(linked), returnType="boolean").asNondeterministic()


class Search:
    """One run over a table: classes, their buckets, and links between classes."""

    def __init__(self, docs: DataFrame, s: Similarity, id_col: str, text_col: str):
        ship(docs.sparkSession)
        self.s, self.tables = s, Tables(docs.sparkSession)
        self.texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        sketched = self.tables.save(self.texts.withColumn("k", _sketcher(s)(F.col("text"))).select("id", "k.*"))
        classes = sketched.where("n > 0").groupBy("cid").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
        self.classes = self.tables.save(classes)
        self.rows = self.tables.save(sketched.select("id", "n", "cid"))
        self.tables.drop(sketched)
        bands = self.classes.select("cid", "n", F.explode("bands").alias("band"))
        shared = bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
        self.members = self.tables.save(bands.join(shared, "band"))

    def _near_sizes(self, x: str, y: str):
        return 100 * F.least(x, y) >= self.s.percent * F.greatest(x, y)

    def prune(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that their signatures leave."""
        sig = self.classes.select("cid", "sig")
        found = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
        return found.where(_pruner(self.s)(F.col("sig_a"), F.col("sig_b"))).select("a", "b")

    def sets(self, cids: DataFrame, bits: int = 64) -> DataFrame:
        """cid, items (sorted shingle hashes of 64 or 32 bits) of the named classes, read from their documents again."""
        needed = self.tables.save(cids.distinct().join(self.classes.select("cid", "least"), "cid"))
        ids = needed.select(F.col("least").alias("id")).distinct()
        ids = F.broadcast(ids) if needed.count() <= BROADCAST_IDS else ids
        known = self.texts.where(F.col("id").isNotNull()).join(ids, "id", "left_semi")
        if needed.where("least is null").limit(1).count():  # classes of rows without an id
            known = known.union(self.texts.where(F.col("id").isNull()))
        found = known.withColumn("k", _set_reader(self.s, bits)(F.col("text"))).select("k.*")
        return found.groupBy("cid").agg(F.first("items").alias("items"))

    def verify(self, pairs: DataFrame) -> DataFrame | None:
        """The pairs (a, b) whose full sets are near; None if there are no pairs."""
        found = self.tables.save(pairs)
        if found.isEmpty():
            return None
        sets = self.sets(found.select(F.col("a").alias("cid")).union(found.select(F.col("b").alias("cid"))))
        both = found.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
        links = self.tables.save(both.where(_verifier(self.s)(F.col("set_a"), F.col("set_b"))).select("a", "b"))
        self.tables.drop(found)
        return links

    def star_pairs(self) -> DataFrame:
        """Every member of a bucket with its pivot: the member whose bands meet most others."""
        meets = self.members.groupBy("cid").agg(F.sum("size").alias("meets"))
        ranked = self.members.join(meets, "cid")
        self.pivots = self.tables.save(ranked.groupBy("band").agg(F.max(F.struct("meets", "cid", "n")).alias("p")).select("band", "p.cid", "p.n").toDF("band", "pivot", "pivot_n"))
        pairs = self.members.join(self.pivots, "band").where((F.col("cid") != F.col("pivot")) & self._near_sizes("n", "pivot_n"))
        return pairs.select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct()

    def unmet_pairs(self, roots: DataFrame | None) -> DataFrame:
        """Links that blocks find between components that share a bucket, by their 32-bit sets."""
        members, main = self.members.select("band", "cid", "n"), self.pivots.select("band", F.col("pivot").alias("cid"))
        if roots is None:
            members, main = (x.withColumn("root", F.col("cid")) for x in (members, main))
        else:
            members, main = (x.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")) for x in (members, main))
        placed = self.tables.save(members.join(main.select("band", F.col("root").alias("main")), "band").withColumn("outside", F.col("root") != F.col("main")).drop("main"))
        self.tables.drop(self.members, self.pivots)
        sizes = placed.groupBy("band").agg(F.count_if("outside").alias("out"), F.count("*").alias("all")).where("out > 0")
        unmet = self.tables.save(placed.join(sizes, "band"))
        self.tables.drop(placed)
        if unmet.isEmpty():
            return unmet.select(F.col("cid").alias("a"), F.col("cid").alias("b"))
        sets = self.sets(unmet.select("cid"), 32).join(self.classes.select("cid", "sig"), "cid")
        count = lambda c: F.ceil(c / BLOCK).cast("int")
        unmet = unmet.withColumns({"ins": count(F.col("all") - F.col("out")), "outs": count(F.col("out"))})
        deal = lambda n: F.pmod(F.xxhash64("cid"), F.greatest(n, F.lit(1))).cast("int")
        rows = unmet.withColumn("block", F.when(F.col("outside"), F.col("ins") + deal(F.col("outs"))).otherwise(deal(F.col("ins"))))
        first = F.when(F.col("outside"), F.lit(0)).otherwise(F.col("ins"))  # blocks of the pivot's component meet those outside only
        rows = rows.withColumn("other", F.explode(F.sequence(first, F.col("ins") + F.col("outs") - 1))).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        rows = rows.join(sets, "cid").select("band", "lo", "hi", "block", "cid", "n", "root", "sig", "items")
        rows = rows.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")
        return rows.mapInArrow(_meeting(self.s), "a long, b long").distinct()

    def roots(self) -> DataFrame | None:
        """node, root of all classes that are linked with another; None if none are."""
        links = self.verify(self.prune(self.star_pairs()))
        roots = components(links) if links is not None else None
        more = self.verify(self.unmet_pairs(roots))
        if more is None:
            return roots
        return components(more if links is None else links.union(more))

    def groups(self) -> DataFrame:
        """cid, and id and class of the group's head (the document with the least id of its component), for classes with a copy or a link."""
        roots = self.roots()
        own = self.classes.select("cid", "least", "copies")
        if roots is None:
            return own.where("copies > 1").select("cid", F.col("least").alias("group"), F.col("cid").alias("head"))
        placed = own.join(roots.withColumnRenamed("node", "cid"), "cid", "left").where("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "cid"))
        heads = placed.where("least is not null").groupBy("root").agg(F.min(F.struct("least", "cid")).alias("h"))
        return placed.join(heads, "root", "left").select("cid", F.col("h")["least"].alias("group"), F.col("h")["cid"].alias("head"))


def _groups(docs: DataFrame, similarity: Similarity, id_col: str, text_col: str) -> tuple[DataFrame, Search]:
    """id, n, cid, group, head of every row, and the run."""
    search = Search(docs, similarity, id_col, text_col)
    found = search.tables.save(search.rows.join(search.groups(), "cid", "left"))
    search.tables.drop(search.classes, search.rows)
    return found, search


def find_groups(docs: DataFrame, similarity: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """id, n_shingles, component_id (least id of all documents that links lead to), kept (whether it is the row's own)."""
    rows, _ = _groups(docs, similarity, id_col, text_col)
    group = F.coalesce("group", "id")
    return rows.select("id", F.col("n").alias("n_shingles"), group.alias("component_id"), F.coalesce(F.col("id") == group, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, similarity: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """``docs`` with one document of each group: the one with the least id, and of rows that share it one with the group's least class.

    Rows without an id or without words stay. An id may stand on rows with different texts: each row goes by its own text.
    """
    rows, search = _groups(docs, similarity, id_col, text_col)
    named = rows.where(F.col("id").isNotNull())
    gone = search.tables.save(named.where(F.coalesce((F.col("id") != F.col("group")) | (F.col("cid") != F.col("head")), F.lit(False))).select("id", "cid").distinct())
    repeated = search.tables.save(named.groupBy("id").count().where("count > 1").select("id"))
    tag, cls = W.fresh(docs, "id"), W.fresh(docs, "class")
    docs = docs.withColumn(tag, F.col(id_col).cast("long"))
    by_id = lambda ids: ids.select(F.col("id").alias(tag)).distinct()
    once = docs
    if not repeated.isEmpty():
        once = docs.join(by_id(repeated), tag, "left_anti")
    kept = once.join(by_id(gone), tag, "left_anti")
    if not repeated.isEmpty():  # these rows are told apart by their class as well
        more = docs.join(by_id(repeated), tag, "left_semi").withColumn(cls, _set_reader(similarity, 64)(F.col(text_col))["cid"])
        with_words = more.where(F.col(cls).isNotNull()).dropDuplicates([tag, cls]).join(gone.toDF(tag, cls), [tag, cls], "left_anti")
        kept = kept.unionByName(with_words.drop(cls)).unionByName(more.where(F.col(cls).isNull()).drop(cls))
    return kept.drop(tag)


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate group."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_groups(docs, COPIES_85).withColumnRenamed("id", "doc_id")


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP9_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
"""
