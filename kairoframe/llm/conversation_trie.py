"""Prefix tries of conversations: what turns conversations have in common from their first turn on.

1. A conversation becomes an array of turns, each two 64-bit hashes of role and text with the text's length; equal
   conversations become one row with their number and least id. From here on texts are no longer moved.
2. Subtries are dealt out by the hash of their first turn to groups of about ``limit`` turns. A first turn with more than
   ``limit`` turns behind it is split: of its conversations the common prefix is taken (the least and the largest array
   have no more in common than all of them), and each next turn roots a subtrie of its own, which is dealt out in its turn or
   split again. Such rounds go on until no subtrie of two or more conversations is too large.
3. A group builds its tries with a dictionary per node, in pandas, and sums up children before parents by going back through
   the nodes in the order that they were made in.
4. The nodes of split prefixes are summed up from their children by aggregation, last round first, and the root after them.

The ids of conversations that end at a node are digested as a stream of chunks in order, so that neither a task nor a
string holds all copies of a conversation.

Defined results: rows without a conversation id belong to no conversation; a null role or text is empty; turns are ordered by
number, null first, equal numbers by role, then by hash of the text; a table without conversations has no nodes, not even a
root. Repeated rows are turns of their own. One conversation is held whole by a task, as 24 bytes a turn. Turns and
prefixes are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Tables, ship

#: Turns of a group of subtries, as expected.
LIMIT = 100_000
#: Ids in a chunk of text that is digested at once.
CHUNK = 4096
_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_NODE_TYPES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NOTHING = hashlib.sha256().hexdigest()


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and turns: array of (a, b, chars) in order, for each conversation."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    t = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(7), text, role).alias("b"), F.length(text).cast("long").alias("chars"))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), t.alias("t"))
    plain = lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["chars"].alias("chars"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", plain).alias("turns"))


def _digest(a: str, b: str, turns: Column) -> list[Column]:
    return [F.xxhash64(turns).alias(a), F.xxhash64(F.lit(3), turns).alias(b)]


def _prefix(n: Column) -> Column:
    return F.slice("turns", F.lit(1), n)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order, to one digest for each (e1, e2)."""
    here, sha = None, None
    for b in batches:
        out = []
        for e1, e2, ids in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if (e1, e2) != here:
                if here is not None:
                    out.append((*here, sha.hexdigest()))
                here, sha = (e1, e2), hashlib.sha256(ids.encode())
            else:
                sha.update(f",{ids}".encode())
        if out:
            yield _ends(out)
    if here is not None:
        yield _ends([(*here, sha.hexdigest())])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["e1", "e2", "sha"])


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """One row for each sequence of turns: turns, n (conversations), least (id), sha (digest of their ids)."""
    convs = convs.select("conv_id", "turns", *_digest("e1", "e2", F.col("turns")))
    own = convs.groupBy("e1", "e2").agg(F.first("turns").alias("turns"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    chunks = convs.groupBy("e1", "e2", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    chunks = chunks.select("e1", "e2", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "chunk")
    ends = chunks.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "chunk").select("e1", "e2", "ids").mapInArrow(_stream, "e1 long, e2 long, sha string")
    return own.join(ends, ["e1", "e2"]).drop("e1", "e2")


def _build(group: pd.DataFrame) -> pd.DataFrame:
    """All nodes of a group's subtries; a subtrie's root has the prefix that it hangs from (up1, up2)."""
    roots: dict[tuple, int] = {}
    kids: list[dict] = []
    parent, depth, chars, convs, least, sha, up = [], [], [], [], [], [], []

    def node(above: int, level: int, size: int, hangs: tuple) -> int:
        kids.append({})
        parent.append(above)
        depth.append(level)
        chars.append(size)
        convs.append(0)
        least.append(None)
        sha.append(_NOTHING)
        up.append(hangs)
        return len(kids) - 1

    for p1, p2, k, up1, up2, a, b, c, n, first, ids in zip(*(group[x] for x in ("p1", "p2", "k", "up1", "up2", "a", "b", "chars", "n", "least", "sha")), strict=True):
        here = roots.get((p1, p2))
        if here is None:
            here = roots[p1, p2] = node(-1, k, int(c[0]), (up1, up2))
        turns = list(zip(a.tolist(), b.tolist(), c.tolist(), strict=True))
        for i, (x, y, size) in enumerate(turns):
            if i:
                child = kids[here].get((x, y))
                if child is None:
                    child = kids[here][x, y] = node(here, k + i, size, (None, None))
                here = child
            convs[here] += n
            least[here] = first if least[here] is None else min(least[here], first)
        sha[here] = ids
    leaves, saved = [0] * len(kids), [0] * len(kids)
    for i in range(len(kids) - 1, -1, -1):  # a node is made after its parent, so this is a postorder
        leaves[i] = leaves[i] or 1
        saved[i] += (convs[i] - 1) * chars[i]
        if parent[i] >= 0:
            leaves[parent[i]] += leaves[i]
            saved[parent[i]] += saved[i]
    above = pd.array([least[p] if p >= 0 else None for p in parent], "Int64")
    hangs = {f"up{j + 1}": pd.array([u[j] for u in up], "Int64") for j in range(2)}
    return pd.DataFrame({"conv_id": least, "depth": depth, "parent_conv_id": above, "n_convs": convs, "n_children": [len(x) for x in kids], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": sha} | hangs)


def _common(lo: Column, hi: Column) -> Column:
    """Length of the common prefix of two different arrays."""
    return (F.array_position(F.zip_with(lo, hi, lambda x, y: x.eqNullSafe(y)), F.lit(False)) - 1).cast("int")


class Trie:
    """The steps of one trie; ``nodes`` gives its result."""

    def __init__(self, convs: DataFrame, limit: int = LIMIT):
        self.spark, self.limit = convs.sparkSession, limit
        self.tables = Tables(self.spark)
        self.seqs = self.tables.save(distinct_sequences(convs))
        #: Of each round: the split prefixes, with the subtrie root (up1, up2, k) and the node that is split (q1, q2, at).
        self.splits: list[DataFrame] = []
        self._steps: list[DataFrame] = []

    def _step(self, df: DataFrame) -> DataFrame:
        """A table that is needed until the subtries are built."""
        self._steps.append(self.tables.save(df))
        return self._steps[-1]

    def split(self) -> DataFrame:
        """Sequences with the root of their subtrie: depth k, prefix (p1, p2), and the prefix that it hangs from (up1, up2)."""
        none = F.lit(None).cast("long")
        rows = self.seqs.where(F.size("turns") > 0).withColumns({"k": F.lit(1), "up1": none, "up2": none})
        done: list[DataFrame] = []
        while True:
            rows = rows.withColumns(dict(zip(("p1", "p2"), _digest("p1", "p2", _prefix(F.col("k"))), strict=True)))
            sizes = rows.groupBy("p1", "p2", "k").agg(F.sum(F.size("turns") - F.col("k") + 1).alias("turns"), F.count(F.lit(1)).alias("seqs"))
            large = self._step(sizes.where((F.col("turns") > self.limit) & (F.col("seqs") > 1)).select("p1", "p2", "k"))
            if large.isEmpty():
                return reduce(DataFrame.unionByName, [*done, rows])
            key = ["p1", "p2", "k"]
            done.append(rows.join(large, key, "left_anti"))
            rows = rows.join(large, key)
            found = rows.groupBy(*key, "up1", "up2").agg(F.min("turns").alias("lo"), F.max("turns").alias("hi"))
            found = found.withColumn("at", _common(F.col("lo"), F.col("hi"))).withColumn("turns", F.slice("lo", F.lit(1), F.col("at")))
            found = self.tables.save(found.select(*key, "up1", "up2", "at", F.transform("turns", lambda t: t["chars"]).alias("chars"), *_digest("q1", "q2", F.col("turns"))))
            rows = rows.join(found.select(*key, "at", "q1", "q2"), key)
            last = F.size("turns") == F.col("at")
            ending = rows.where(last).select("q1", "q2", F.col("n").alias("end_n"), F.col("least").alias("end_least"), F.col("sha").alias("end_sha"))
            self.splits.append(self.tables.save(found.join(ending, ["q1", "q2"], "left")))
            rows = self._step(rows.where(~last).select("turns", "n", "least", "sha", (F.col("at") + 1).alias("k"), F.col("q1").alias("up1"), F.col("q2").alias("up2")))
            self.tables.drop(found)

    def grouped(self, rows: DataFrame) -> DataFrame:
        """The nodes of all subtries; (up1, up2) is null but for their roots, and for the roots at depth 1 as well."""
        total = self.seqs.agg(F.sum(F.size("turns"))).first()[0] or 0
        groups = max(1, -(-total // self.limit))
        part = lambda f: F.transform(F.slice("turns", F.col("k"), F.size("turns") - F.col("k") + 1), lambda t: t[f]).alias(f)
        rows = rows.select(F.pmod(F.xxhash64("p1", "p2"), F.lit(groups)).alias("group"), "p1", "p2", F.col("k").cast("long").alias("k"), "up1", "up2", part("a"), part("b"), part("chars"), "n", "least", "sha")
        for c in ("up1", "up2"):  # pandas would make floats of longs with nulls
            rows = rows.withColumn(c, F.coalesce(c, F.lit(0)))
        return rows.groupBy("group").applyInPandas(_build, f"{_NODE_TYPES}, up1 long, up2 long")

    def nodes(self) -> DataFrame:
        rows = self.split()
        made = self.tables.save(self.grouped(rows))
        self.tables.drop(*self._steps)
        hanging = lambda df, first: df.where(F.col("parent_conv_id").isNull() & ((F.col("depth") == 1) if first else (F.col("depth") > 1)))
        n, saved, children, leaves = (F.sum("n_convs").alias("n"), F.sum("saved_tokens").alias("saved"), F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"))
        tops = [made]  # tables with subtrie roots
        for split in reversed(self.splits):
            below = reduce(DataFrame.unionByName, [hanging(t, False).select("up1", "up2", "conv_id", "n_convs", "n_leaves", "saved_tokens") for t in tops])
            sums = below.groupBy(F.col("up1").alias("q1"), F.col("up2").alias("q2")).agg(n, saved, children, leaves, F.min("conv_id").alias("least"))
            rows = split.join(sums, ["q1", "q2"])
            rows = rows.withColumns({"least": F.least("least", "end_least"), "n": F.col("n") + F.coalesce("end_n", F.lit(0))})
            # The prefix's own nodes, from the subtrie's root down to where it is split.
            rows = rows.withColumn("depth", F.explode(F.sequence(F.col("k"), F.col("at"))))
            own = F.aggregate(F.slice("chars", F.col("depth"), F.col("at") - F.col("depth") + 1), F.lit(0).cast("long"), lambda s, c: s + c)
            deepest, top = F.col("depth") == F.col("at"), F.col("depth") == F.col("k")
            rows = rows.select(
                F.col("least").alias("conv_id"),
                F.col("depth").cast("long").alias("depth"),
                F.when(~top, F.col("least")).alias("parent_conv_id"),
                F.col("n").alias("n_convs"),
                F.when(deepest, F.col("children")).otherwise(1).alias("n_children"),
                F.col("leaves").alias("n_leaves"),
                (F.col("saved") + (F.col("n") - 1) * own).alias("saved_tokens"),
                F.when(deepest, F.coalesce("end_sha", F.lit(_NOTHING))).otherwise(_NOTHING).alias("ends_sha256"),
                F.when(top, F.coalesce("up1", F.lit(0))).alias("up1"),
                F.when(top, F.coalesce("up2", F.lit(0))).alias("up2"),
                F.when(deepest, F.col("q1")).alias("q1"),
                F.when(deepest, F.col("q2")).alias("q2"),
            )
            tops.append(self.tables.save(rows))
        self.tables.drop(*self.splits)
        out = self._rooted(tops, hanging)
        self.tables.drop(self.seqs)
        return out

    def _rooted(self, tops: list[DataFrame], hanging) -> DataFrame:
        """All nodes with their parents, and the root."""
        bare = self.seqs.where(F.size("turns") == 0).select("least", "n", "sha")
        first = reduce(DataFrame.unionByName, [hanging(t, True).select("conv_id", "n_convs", "n_leaves", "saved_tokens") for t in tops])
        one = first.agg(F.min("conv_id").alias("c"), F.sum("n_convs").alias("n"), F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).first()
        end = bare.first()  # equal sequences are one row
        ids = [x for x in (one["c"], end and end["least"]) if x is not None]
        if not ids:
            return self.spark.createDataFrame([], _NODE_TYPES)
        root = (min(ids), 0, None, (one["n"] or 0) + (end["n"] if end else 0), one["children"], one["leaves"] or 1, one["saved"] or 0, end["sha"] if end else _NOTHING)
        nodes = reduce(DataFrame.unionByName, [t.select(*_NODE, "up1", "up2") for t in tops])
        parent = F.when(F.col("depth") == 1, F.lit(root[0])).otherwise(F.col("parent_conv_id"))
        if len(tops) > 1:
            split_at = reduce(DataFrame.unionByName, [t.where(F.col("q1").isNotNull()).select(F.col("q1").alias("up1"), F.col("q2").alias("up2"), F.col("conv_id").alias("above")) for t in tops[1:]])
            inner, hung = nodes.where((F.col("depth") == 1) | F.col("parent_conv_id").isNotNull()), hanging(nodes, False)
            hung = hung.join(split_at, ["up1", "up2"]).withColumn("parent_conv_id", F.col("above")).select(*_NODE)
            nodes = inner.withColumn("parent_conv_id", parent).select(*_NODE).union(hung)
        else:
            nodes = nodes.withColumn("parent_conv_id", parent).select(*_NODE)
        return nodes.union(self.spark.createDataFrame([root], _NODE_TYPES))


def prefix_trie(convs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the trie of ``convs`` (conv_id, turns as of ``sequences``).

    A row for each distinct prefix: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (code points of turns that would be stored again without the trie), ends_sha256 (of the ids that end there). A node's text
    is turn ``depth`` of its conv_id.
    """
    ship(convs.sparkSession)
    return Trie(convs, limit).nodes()


def shared_heads(convs: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Each conversation with its first turns, crc32(id) mod ``most`` of them, taken from the first one of its hundred."""
    c = F.col("conv_id")
    heads = convs.where(c % group == 0).select(c.alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(c.cast("string").cast("binary")) % most).cast("int")
    n = F.size("turns")
    rows = convs.withColumn("base", c - c % group).join(heads, "base", "left").withColumn("h", h)
    own = F.slice("turns", F.col("h") + 1, F.greatest(n - F.col("h"), F.lit(0)))
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return rows.select("conv_id", F.concat(head, own).alias("turns"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(shared_heads(sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


#: CRC-32 of a text of ASCII characters: each byte goes into the register, which then takes eight steps.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len({0}) + 1), lambda i: list_value(ascii(({0})[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0)))), "
    "lambda c, b: xor(xor(c, b) >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT)"
)
OP12_SQL = f"""
WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT conv_id, turns, {_CRC.format("conv_id::VARCHAR")} % 6 AS h, conv_id - conv_id % 100 AS base FROM own),
rebuilt AS (SELECT c.conv_id, coalesce(b.turns, [])[1:h] || c.turns[h + 1:] AS s FROM heads c LEFT JOIN own b ON b.conv_id = c.base),
prefixes AS (SELECT conv_id, s, unnest(range(len(s) + 1)) AS depth FROM rebuilt),
named AS (SELECT conv_id, depth, len(s) AS n, md5(to_json(s[1:depth])::VARCHAR) AS id, md5(to_json(s[1:depth - 1])::VARCHAR) AS up, CASE WHEN depth > 0 THEN length(s[depth].text) ELSE 0 END AS chars FROM prefixes),
nodes AS (
  SELECT depth, id, any_value(CASE WHEN depth > 0 THEN up END) AS up, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM named GROUP BY depth, id),
kids AS (SELECT up AS id, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
above AS (SELECT DISTINCT a.depth AS above_depth, a.id AS above_id, b.depth, b.id FROM named a JOIN named b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
sums AS (
  SELECT above_depth AS depth, above_id AS id, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens
  FROM above JOIN nodes n USING (depth, id) LEFT JOIN kids k USING (depth, id) GROUP BY 1, 2)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (depth, id) LEFT JOIN kids k USING (depth, id) LEFT JOIN nodes p ON p.id = n.up AND p.depth = n.depth - 1
"""
