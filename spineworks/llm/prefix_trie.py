"""Prefix trie of conversations, summed up its subtrees by depth-band rollup.

Nodes are the distinct prefixes of turn sequences, known by a 128-bit prefix
key and named by (smallest member conversation, depth). Depths are cut into
bands of ``BAND`` levels. A node explodes only to its ancestors inside its
band, whose names come with it as an array of at most ``BAND`` items. The
band roots form a trie of a ``BAND``-th of the depth; their band sums are
rolled up in the same way (rounds grow as the logarithm of the depth), and
the completed totals are added to the nodes that the band roots hang from
before those explode. Work is at most ``BAND`` rows for a node and level, and no
conversation, node or level is ever one task's group: turns are numbered over
a range partitioning that may cut a conversation anywhere.

Defined results: rows without conv_id take no part; null role and text are
empty; turns of equal number (null ones first) follow the digest of role and
text, and repeated rows are turns of their own; an empty table gives no node,
not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prefix_keys
from .common import discard, map_arrow, stage

#: Levels of one band.
BAND = 8
#: Members of a node that are joined to one text before they meet.
JOINED_IDS = 8_192
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, at, a, b, chars) of all turns: position from 1, prefix key lanes, code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.char_length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("tie"))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("digest"), F.asc("tie")]
    ordered = (turns.repartitionByRange(_partitions(rows), *order).sortWithinPartitions(*order)
               .select("conv_id", "digest", "chars"))
    parts = stage(map_arrow(ordered, prefix_keys.prefix_sums, "sequence long, part int, at long, a long, b long, "
                                                              "chars long"), "trie-parts")
    # a conversation cut by partition borders goes on in the next partition: two rows for a partition at most
    ends = parts.groupBy("sequence", "part").agg(F.max(F.struct("at", "a", "b")).alias("end"))
    cut = ends.groupBy("sequence").agg(F.count("*").alias("parts")).where("parts > 1")
    found, whole = [], {}
    for r in ends.join(cut, "sequence", "left_semi").orderBy("sequence", "part").collect():
        before = whole.get(r["sequence"], (0, 0, 0))
        found.append((r["sequence"], r["part"], *before))
        whole[r["sequence"]] = prefix_keys.carried(*before, *r["end"])
    if not found:
        return parts.select(F.col("sequence").alias("conv_id"), "at", "a", "b", "chars")
    before = rows.sparkSession.createDataFrame(found, "sequence long, part int, n long, before_a long, before_b long")
    joined = parts.join(F.broadcast(before), ["sequence", "part"], "left").na.fill(0, ["n", "before_a", "before_b"])
    return map_arrow(joined.select("sequence", "at", "a", "b", "chars", "n", "before_a", "before_b"), _go_on,
                     "conv_id long, at long, a long, b long, chars long")


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = [prefix_keys.Powers(b) for b in prefix_keys.BASES]
    for batch in batches:
        _, at, a, b, _, n, before_a, before_b = _columns(batch)
        steps, where = np.unique(n, return_inverse=True)  # few: one for each cut
        lanes = []
        for lane, x, before in ((0, a, before_a), (1, b, before_b)):
            scale = np.array([pow(prefix_keys.BASES[lane], int(s), prefix_keys.PRIME) for s in steps], np.uint64)
            lanes.append(prefix_keys.plus(prefix_keys.times(x, scale[where]), before).astype(np.int64))
        yield pa.record_batch([batch.column(0), pa.array(at + n), pa.array(lanes[0]), pa.array(lanes[1]),
                               batch.column(4)], ["conv_id", "at", "a", "b", "chars"])


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "depth", "a", "b", "chars", "ends"]
    for batch in batches:
        conv, at, a, b, chars, head, taken, n, ga, gb, da, db = _columns(batch)
        lanes = prefix_keys.moved((a, b), (ga, gb), (da, db), taken - head)
        yield pa.record_batch([pa.array(conv), pa.array(at + taken - head), *[pa.array(x.astype(np.int64)) for x in lanes],
                               pa.array(chars), pa.array(at == n)], names)


def rebuilt_prefixes(rows: DataFrame, group: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Prefixes and lengths of the conversations rebuilt over the heads of their groups' first conversations.

    Conversation c takes the first h turns of conversation c - c % ``group``
    (h = crc32 of its decimal id % ``heads``) in place of its own. Gives
    (conv_id, depth, a, b, chars, ends), depths from 1, and (conv_id, depth),
    the number of turns of every conversation.
    """
    turns = stage(numbered_turns(rows), "trie-turns")
    head = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(heads))
    few = F.when(F.col("at") < heads, F.struct("at", "a", "b", "chars"))
    convs = turns.groupBy("conv_id").agg(F.max("at").alias("n"), F.sort_array(F.collect_list(few)).alias("own"))
    convs = stage(convs.withColumn("head", head), "trie-conversations")
    donors = (convs.where(F.col("conv_id") % group == 0)
              .select(F.col("conv_id").alias("donor"), F.col("own").alias("given")))
    given = F.coalesce(F.size("given"), F.lit(0))
    nothing = F.struct(F.lit(0).cast("long").alias("at"), *[F.lit(0).cast("long").alias(c) for c in ("a", "b", "chars")])
    at_turn = lambda lists, n: F.when(n > 0, F.element_at(lists, n.cast("int"))).otherwise(nothing)
    plan = (convs.withColumn("donor", F.col("conv_id") - F.col("conv_id") % group).join(donors, "donor", "left")
            .withColumn("taken", F.least("head", F.when(F.col("given").isNull(), 0).otherwise(given)).cast("long"))
            .withColumn("origin", at_turn(F.col("own"), F.least("head", "n")))
            .withColumn("offset", at_turn(F.col("given"), F.col("taken"))))
    plan = stage(plan, "trie-plan")
    own = (turns.where(F.col("at") > head)
           .join(plan.select("conv_id", "head", "taken", "n", F.col("origin.a").alias("ga"), F.col("origin.b").alias("gb"),
                             F.col("offset.a").alias("da"), F.col("offset.b").alias("db")), "conv_id")
           .select("conv_id", "at", "a", "b", "chars", "head", "taken", "n", "ga", "gb", "da", "db"))
    schema = "conv_id long, depth long, a long, b long, chars long, ends boolean"
    lent = (plan.where("taken > 0").select("conv_id", "taken", (F.col("n") <= F.col("head")).alias("short"),
                                           F.explode(F.slice("given", F.lit(1), F.col("taken").cast("int"))).alias("g"))
            .select("conv_id", F.col("g.at").alias("depth"), "g.a", "g.b", "g.chars",
                    (F.col("short") & (F.col("g.at") == F.col("taken"))).alias("ends")))
    lengths = plan.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("depth"))
    return map_arrow(own, _rebuilt, schema).unionByName(lent), lengths


def _bands(paths: DataFrame) -> DataFrame:
    """Nodes (conv_id, depth, parent, line, ...) of rows (member, depth, conv_id, ...); conv_id names the node.

    ``line`` holds the names of the node's ancestors inside its band, from
    the band's root down to itself; ``parent`` is the name one level up.
    """
    extra = [c for c in paths.columns if c not in ("member", "depth", "conv_id")]
    band = F.floor(F.col("depth") / BAND)
    both = F.when((F.col("depth") + 1) % BAND == 0, F.array(band, band + 1)).otherwise(F.array(band))
    groups = (paths.select("member", F.explode(both).alias("band"), F.struct("depth", "conv_id", *extra).alias("step"))
              .groupBy("member", "band").agg(F.sort_array(F.collect_list("step")).alias("steps")))
    # a member names the nodes at the end of its path, so only bands that it ends with hold nodes of its own
    groups = groups.where(F.element_at("steps", -1)["conv_id"] == F.col("member"))
    start = F.col("band") * BAND
    inside = F.filter("steps", lambda s: s["depth"] >= start)
    upper = F.size("steps") - F.size("inside") + F.col("i") - 1
    return (groups.withColumn("inside", inside)
            .select("steps", "inside", "member", F.posexplode("inside").alias("i", "node"))
            .where("node.conv_id = member")
            .select("node.*", F.when(upper >= 0, F.get("steps", upper)["conv_id"]).alias("parent"),
                F.transform(F.slice("inside", F.lit(1), F.col("i") + 1), lambda s: s["conv_id"]).alias("line")))


def _rolled_up(paths: DataFrame, nodes: DataFrame, values: list[str], deepest: int) -> DataFrame:
    """(conv_id, depth, *values) summed over each node's subtree.

    ``nodes`` are those of ``paths`` with their values.
    """
    if deepest >= BAND:
        above = paths.where(F.col("depth") % BAND == 0).select("member", (F.col("depth") / BAND).cast("long")
                                                               .alias("depth"), "conv_id")
        above = stage(above, "trie-above")
        sums = (nodes.groupBy(F.get("line", F.lit(0)).alias("conv_id"), F.floor(F.col("depth") / BAND).alias("depth"))
                .agg(*[F.sum(v).alias(v) for v in values]))
        roots = stage(_bands(above).join(sums, ["conv_id", "depth"]), "trie-roots")
        whole = _rolled_up(above, roots, values, deepest // BAND)
        whole = whole.select("conv_id", (F.col("depth") * BAND).alias("depth"), *values)
        hung = (nodes.where((F.col("depth") % BAND == 0) & (F.col("depth") > 0)).select("conv_id", "depth", "parent")
                .join(whole, ["conv_id", "depth"])
                .groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
                .agg(*[F.sum(v).alias(f"{v}_below") for v in values]))
        nodes = nodes.join(hung, ["conv_id", "depth"], "left").select(
            "depth", "line", *[(F.col(v) + F.coalesce(f"{v}_below", F.lit(0).cast("long"))).alias(v) for v in values])
    out = (nodes.select("depth", *values, F.posexplode("line").alias("i", "conv_id"))
           .groupBy("conv_id", (F.floor(F.col("depth") / BAND) * BAND + F.col("i")).alias("depth"))
           .agg(*[F.sum(v).alias(v) for v in values]))
    return stage(out, "trie-totals")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, depth, member) to (conv_id, depth, first member, joined members)."""
    at, ids, found = None, [], []

    def close():
        if ids:
            found.append((*at, ids[0], ",".join(map(str, ids))))
            ids.clear()

    def out():
        rows = pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*found), (
            pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["conv_id", "depth", "first", "ids"])
        found.clear()
        return rows

    for batch in batches:
        for conv, depth, member in zip(*[c.to_pylist() for c in batch.columns]):
            if (conv, depth) != at or len(ids) >= JOINED_IDS:
                close()
                at = (conv, depth)
            ids.append(member)
        if found:
            yield out()
    close()
    if found:
        yield out()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, depth, ids) to one SHA-256 for each (conv_id, depth)."""
    at, state, found = None, None, []

    def out():
        rows = pa.record_batch([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                                pa.array([f[2] for f in found], pa.string())], ["conv_id", "depth", "ends_sha256"])
        found.clear()
        return rows

    for batch in batches:
        for conv, depth, ids in zip(*[c.to_pylist() for c in batch.columns]):
            if (conv, depth) == at:
                state.update(b",")
            else:
                if at is not None:
                    found.append((*at, state.hexdigest()))
                at, state = (conv, depth), hashlib.sha256()
            state.update(ids.encode())
        if found:
            yield out()
    if at is not None:
        found.append((*at, state.hexdigest()))
        yield out()


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): hash of the members that end at each node.

    Members are sorted over all tasks, so a node with very many of them is
    joined to texts in many tasks. SHA-256 itself is one chain: those texts (a
    row for ``JOINED_IDS`` members) then stream through one task in order,
    which holds one text at a time.
    """
    n, order = _partitions(ends), ["conv_id", "depth", "member"]
    joined = map_arrow(ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order), _joined,
                       "conv_id long, depth long, first long, ids string")
    met = joined.repartition(n, "conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
    return map_arrow(met.select("conv_id", "depth", "ids"), _hashed, "conv_id long, depth long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256).
    """
    prefixes, lengths = rebuilt_prefixes(conversations)
    prefixes = stage(prefixes, "trie-prefixes")
    keys = ["depth", "a", "b"]
    named = prefixes.groupBy(*keys).agg(F.min("conv_id").alias("name"), F.count("*").alias("n_convs"),
                                        F.max("chars").alias("chars"))
    paths = prefixes.select("conv_id", "ends", *keys).join(named, keys).select(
        F.col("conv_id").alias("member"), "depth", F.col("name").alias("conv_id"), "n_convs", "chars", "ends")
    all_of = lengths.agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), F.max("depth").alias("deepest")).first()
    start = lengths.select(F.col("conv_id").alias("member"), F.lit(0).cast("long").alias("depth"),
                           F.lit(all_of["first"]).cast("long").alias("conv_id"),
                           F.lit(all_of["n"]).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("chars"),
                           (F.col("depth") == 0).alias("ends"))
    paths = stage(paths.unionByName(start), "trie-paths")
    discard(prefixes)
    nodes = stage(_bands(paths.drop("ends")), "trie-nodes")
    children = (nodes.where("depth > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
                .agg(F.count("*").alias("n_children")))
    nodes = nodes.join(children, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", F.col("parent").alias("parent"), "line", "n_convs",
        F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        F.col("n_children").isNull().cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    nodes = stage(nodes, "trie-valued")
    totals = _rolled_up(paths.select("member", "depth", "conv_id"), nodes, ["n_leaves", "saved_tokens"],
                        all_of["deepest"] or 0)
    hashes = _end_hashes(paths.where("ends"))
    names = ["conv_id", "depth"]
    return (nodes.drop("n_leaves", "saved_tokens", "line").join(totals, names).join(hashes, names, "left")
            .select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                    "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 100 AS donor,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(c::VARCHAR)),
           lambda i: ascii(substr(c::VARCHAR, (i + 1)::BIGINT, 1))::BIGINT)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS depth, text,
         md5(length(role) || ':' || role || text) AS turn
  FROM (SELECT v.c, 0 AS own, t.pos, t.role, t.text FROM convs v JOIN turns t ON t.c = v.donor AND t.pos <= v.h
        UNION ALL
        SELECT v.c, 1, t.pos, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c AND t.pos > v.h)),
steps AS (
  SELECT c, depth, length(text) AS chars, list(turn) OVER (PARTITION BY c ORDER BY depth) AS path FROM rebuilt
  UNION ALL SELECT c, 0, 0, [] FROM convs),
ended AS (SELECT *, depth = max(depth) OVER (PARTITION BY c) AS ends FROM steps),
nodes AS (
  SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM ended GROUP BY path, depth),
children AS (SELECT path[1:-2] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
lifted AS (SELECT path[1:d] AS path, leaf, saved
           FROM (SELECT n.path, n.saved, c.n IS NULL AS leaf, unnest(range(0, n.depth + 1)) AS d
                 FROM nodes n LEFT JOIN children c USING (path))),
summed AS (SELECT path, sum(leaf::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM lifted GROUP BY path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves,
       s.saved_tokens, n.ends_sha256
FROM nodes n JOIN summed s USING (path) LEFT JOIN children k USING (path)
LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:-2]
"""
