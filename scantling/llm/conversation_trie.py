"""Prefix trie of conversations, built level by level.

A node of depth d is a distinct sequence of the first d turns (role, text) of some conversation, the
root the empty one. It is named by its depth and its smallest member, the smallest conv_id that
starts with it. Turns travel as SHA-256 digests.

Construction: the live conversations of a level (those in a node with others) are joined to their
next turn and grouped by (parent node, next turn); the groups are the next level's nodes, their
smallest conv_id the name, and groups of two or more stay alive. A conversation that is alone in its
node needs no more grouping: its further turns are a chain of nodes of its own, read off its turns
at the end. So there are as many rounds as turns that some two conversations share. Then, from the
deepest level up, children are counted and their leaves and savings added to their parents.

Each level is a written table in the shared folder: lineage is one level long. Counts are aggregated
before they are moved; the join that tells members their node is one that Spark splits where a node
has many. What is not split is a conversation: its turns are numbered in one sort.

Edge cases: a null role or text is empty; rows without conv_id are left out; turns are ordered by
``turn``, null first, ties by digest; repeated rows are turns of their own; other columns are ignored;
a table without conversations has no nodes.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_dir, parts, stored

#: A forked conversation takes up to ``FORKS - 1`` turns of the first of its ``KIN`` ids.
FORKS, KIN = 9, 5
#: Members of a node in one piece of the list that is hashed.
PIECE = 4096

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, bytes long"
ROLLED = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth`` (from 1), ``key`` (digest of role and text), ``bytes`` (of the text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    return rows.select("conv_id", F.row_number().over(w).cast("long").alias("depth"), "key", "bytes")


def forks(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its kin."""
    return F.crc32(conv_id.cast("string")) % FORKS


def forked(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of the first of their kin: (members, turns).

    Conversation c gets the first h turns of c - c % KIN (all if there are fewer, none without it),
    then its own after its first h. ``own`` and the result: conv_id, depth, key, bytes; members:
    conv_id, length (0 where no turn is left).
    """
    own = stored(own)
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", forks(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % KIN)
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("of_base"))
    sizes = sizes.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("of_base", F.lit(0))))
    sizes = stored(sizes.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    heads = own.filter(F.col("depth") < FORKS).withColumnRenamed("conv_id", "base").join(sizes.select("conv_id", "base", "h"), "base").filter("depth <= h")
    tails = own.join(sizes.select("conv_id", "h", "taken"), "conv_id").filter("depth > h").withColumn("depth", F.col("depth") - F.col("h") + F.col("taken"))
    # the first of the kin takes its own turns, so it stays as it is
    return sizes.select("conv_id", "length"), heads.select(*own.columns).unionByName(tails.select(*own.columns))


@dataclass
class Trie:
    """``nodes``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens.

    ``ends``: conv_id and depth of a node, ``member``, a conversation that ends there, and whether it
    is ``alone`` in the node.
    """

    nodes: DataFrame
    ends: DataFrame

    def last_turns(self, conversations: DataFrame) -> DataFrame:
        """The nodes below the root with role and text of their last turn, for conversations that aren't forked."""
        w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "_key")
        role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
        key = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
        said = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), key.alias("_key"))
        said = said.select("conv_id", F.row_number().over(w).cast("long").alias("depth"), "role", "text")
        return self.nodes.join(said, ["conv_id", "depth"])


def build(members: DataFrame, rows: DataFrame) -> Trie:
    """The trie of ``members`` (conv_id, length: its number of turns) with their turns ``rows`` (conv_id, depth, key, bytes)."""
    spark, folder = rows.sparkSession, fresh_dir(rows.sparkSession, "trie")

    def kept(df: DataFrame, *name) -> DataFrame:
        path = os.path.join(folder, *map(str, name))
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    n = parts(spark)
    # by depth, so that a level reads its own part of the files
    rows = kept(rows.repartitionByRange(n, "depth", "conv_id").sortWithinPartitions("depth", "conv_id"), "turns")
    members = kept(members.select("conv_id", F.col("length").cast("long").alias("length")), "members")
    first = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).first()
    if not first["n"]:
        return Trie(spark.createDataFrame([], ROLLED), spark.createDataFrame([], "conv_id long, depth long, member long, alone boolean"))
    root = spark.createDataFrame([(first["conv_id"], 0, None, first["n"], 0)], NODE)
    levels, lengths = [kept(root, "level", 0)], members
    alone = [members.filter(F.lit(first["n"] == 1)).select("conv_id", F.lit(0).cast("long").alias("depth"))]
    live = members.filter(F.lit(first["n"] > 1)).select("conv_id", F.lit(first["conv_id"]).alias("node"), "length")
    ends = []
    depth = 0
    while not live.isEmpty():
        ends.append(live.filter(F.col("length") == depth).select(F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("conv_id").alias("member"), F.lit(False).alias("alone")))
        depth += 1
        said = rows.filter(F.col("depth") == depth).select("conv_id", "key", "bytes")
        following = kept(live.join(said, "conv_id"), "next", depth)
        groups = following.groupBy("node", "key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
        groups = kept(groups, "groups", depth)
        levels.append(groups.select("conv_id", F.lit(depth).cast("long").alias("depth"), F.col("node").alias("parent_conv_id"), "n_convs", "bytes"))
        alone.append(groups.filter("n_convs = 1").select("conv_id", F.lit(depth).cast("long").alias("depth")))
        shared = groups.filter("n_convs > 1").select("node", "key", F.col("conv_id").alias("own"))
        live = kept(following.join(shared, ["node", "key"]).select("conv_id", F.col("own").alias("node"), "length"), "live", depth)
    # a conversation is alone at one depth; its chain goes on from there
    single = alone[0]
    for x in alone[1:]:
        single = single.unionByName(x)
    single = kept(single.withColumnRenamed("depth", "from_depth").join(lengths, "conv_id"), "single")
    rolled, below = [], None
    for level in reversed(levels):
        level = level.join(single.select("conv_id", F.col("from_depth").alias("depth"), "length"), ["conv_id", "depth"], "left")
        below = level.withColumn("sum_children", F.lit(0).cast("long")).withColumn("sum_leaves", F.lit(0).cast("long")).withColumn("sum_saved", F.lit(0).cast("long")) if below is None else level.join(
            below.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("sum_children"), F.sum("n_leaves").alias("sum_leaves"), F.sum("saved_tokens").alias("sum_saved")), "conv_id", "left"
        )
        chain = (F.col("length") > F.col("depth")).cast("long")
        children = F.coalesce(chain, F.col("sum_children"), F.lit(0))
        leaves = F.when(F.col("length").isNotNull(), 1).otherwise(F.greatest(F.coalesce("sum_leaves", F.lit(0)), F.lit(1)))
        saved = (F.col("n_convs") - 1) * F.col("bytes") + F.coalesce("sum_saved", F.lit(0))
        below = kept(below.select("conv_id", "depth", "parent_conv_id", "n_convs", children.alias("n_children"), leaves.cast("long").alias("n_leaves"), saved.alias("saved_tokens")), "rolled", len(levels) - 1 - len(rolled))
        rolled.append(below)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    chains = rows.select("conv_id", "depth").join(single, "conv_id").filter("depth > from_depth")
    chains = chains.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), (F.col("length") > F.col("depth")).cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"))
    nodes = spark.read.schema(ROLLED).parquet(*[os.path.join(folder, "rolled", str(k)) for k in range(len(levels))]).unionByName(chains)
    ended = single.select("conv_id", F.col("length").alias("depth"), F.col("conv_id").alias("member"), F.lit(True).alias("alone"))
    for x in ends:
        ended = ended.unionByName(x)
    return Trie(nodes, kept(ended, "ends"))


def digests(ends: DataFrame) -> DataFrame:
    """``conv_id, depth, ends_sha256``: SHA-256 of each node's members in decimal, ascending, joined by commas.

    Members are dealt by range, sorted, and joined to pieces of ``PIECE`` by many tasks; a node's
    pieces are then hashed in order as they come. SHA-256 itself can't be split.
    """
    piece = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("text", pa.string())])
    digest = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])

    def join(batches):
        for batch in batches:
            node, depth, member = (batch.column(k).to_numpy() for k in range(3))
            if not len(node):
                continue
            start = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (depth[1:] != depth[:-1])])
            start = np.unique(np.r_[start, np.concatenate([np.arange(a, b, PIECE) for a, b in zip(start, np.r_[start[1:], len(node)])])])
            texts = pc.cast(batch.column(2), pa.string())
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[start, len(node)].astype(np.int32)), texts), ",")
            yield pa.RecordBatch.from_arrays([pa.array(node[start]), pa.array(depth[start]), pa.array(member[start]), joined], schema=piece)

    def hashed(batches):
        own, h = None, None
        for batch in batches:
            done = {k: [] for k in digest.names}
            for node, depth, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if (node, depth) == own:
                    h.update(b",")
                else:
                    if own is not None:
                        for k, v in zip(digest.names, (*own, h.hexdigest())):
                            done[k].append(v)
                    own, h = (node, depth), hashlib.sha256()
                h.update(text.encode())
            yield pa.RecordBatch.from_pydict(done, schema=digest)
        if own is not None:
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip(digest.names, (*own, h.hexdigest()))}, schema=digest)

    n = parts(ends.sparkSession)
    sorted_ = ends.select("conv_id", "depth", "member").repartitionByRange(n, "conv_id", "depth", "member").sortWithinPartitions("conv_id", "depth", "member")
    pieces = sorted_.mapInArrow(join, "conv_id long, depth long, first long, text string")
    return pieces.repartition(n, "conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(hashed, "conv_id long, depth long, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> Trie:
    """The trie of conversations as they are (conv_id, turn, role, text)."""
    rows = stored(turns(conversations))
    return build(rows.groupBy("conv_id").agg(F.count("*").alias("length")), rows)


def query(spark, sf_dir: str) -> DataFrame:
    trie = build(*forked(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    # the one member of a node of its own needs no sorting
    alone = trie.ends.filter("alone").select("conv_id", "depth", F.sha2(F.col("member").cast("string"), 256).alias("ends_sha256"))
    out = trie.nodes.join(digests(trie.ends.filter("not alone")).unionByName(alone), ["conv_id", "depth"], "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: One step of CRC-32 over a bit, eight of them a byte.
_BYTE = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: {_BYTE}), 4294967295)"
ORACLE_SQL = f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha) AS d, sha, bytes FROM (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS sha, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, n, h, conv_id - conv_id % {KIN} AS base FROM (SELECT conv_id, count(*) AS n, any_value({_CRC} % {FORKS}) AS h FROM t GROUP BY 1)),
k AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS taken FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT k.conv_id, t.d, t.sha, t.bytes FROM k JOIN t ON t.conv_id = k.base AND t.d <= k.h UNION ALL SELECT k.conv_id, t.d - k.h + k.taken, t.sha, t.bytes FROM k JOIN t ON t.conv_id = k.conv_id AND t.d > k.h),
p AS (SELECT conv_id, d, bytes, string_agg(sha, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM k),
e AS (SELECT conv_id, max(d) AS len FROM p GROUP BY 1),
n AS (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = d), '')) AS ends_sha256 FROM p JOIN e USING (conv_id) GROUP BY 1, 2),
ch AS (SELECT n.d, n.path, count(x.path) AS n_children FROM n LEFT JOIN n x ON x.d = n.d + 1 AND substr(x.path, 1, 64 * n.d) = n.path GROUP BY 1, 2),
m AS (SELECT n.*, n_children FROM n JOIN ch USING (d, path)),
u AS (SELECT a.d, a.path, count(*) FILTER (s.n_children = 0) AS n_leaves, sum((s.n_convs - 1) * s.bytes) AS saved_tokens FROM m s JOIN m a ON a.d <= s.d AND substr(s.path, 1, 64 * a.d) = a.path GROUP BY 1, 2)
SELECT m.conv_id, m.d::BIGINT AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, m.ends_sha256 FROM m JOIN u USING (d, path) LEFT JOIN n q ON q.d = m.d - 1 AND q.path = substr(m.path, 1, 64 * (m.d - 1))"""
