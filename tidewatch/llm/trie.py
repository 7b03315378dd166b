"""Prefix trie of conversations by an Euler tour whose list is ranked by contraction.

Nodes are the distinct sequences of first turns. Each is named by a digest that is
folded over its turns, so no text is shuffled: a turn is the digest of its role and text. Turns
get their places by range; digests are folded within runs of ``RUN`` turns and then over the
runs of a conversation, so one conversation may hold a third of all turns.

Nodes, numbered in the order of (parent, node), stand beside their siblings. Every
node has an enter and an exit arc; who follows whom comes from those numbers and from one
message of each parent to its first and last child. Rounds of contraction rank the
list: an arc whose hash is less than both neighbours' leaves and tells them of each other,
which takes a third out of the list with one shuffle. The last ``LAST`` arcs are ranked in
one task, and the rounds are undone in reverse, each arc from the one before
it. Running sums over the arcs' places then give each subtree what lies between
its enter and its exit.

Rows without ``conv_id`` belong to no conversation and are passed over. Null role or text
is empty. Turns come by ``turn`` (null first), then digest; rows that repeat are turns
of their own. Empty tables have no nodes. Columns besides the four are not read, so
clashing names do no harm. A text is hashed in the scan, whole, however long. Ids of the
conversations that end at a node are hashed as a stream over sorted rows, which SHA-256
does in one task for each node, in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.flat import numbered
from tidewatch.llm.merkle import crc32_sql
from tidewatch.operators.places import placed, summed
from tidewatch.session import stored, work_folder

RUN = 1024
LAST = 1 << 14
SPLICED, HEADS = 5, 9
ROOT = bytes(16)


def joined_digest(*parts: Column) -> Column:
    """The first half of the SHA-256 of binary parts."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def turns_of(conversations: DataFrame, folder: str) -> DataFrame:
    """conv_id, pos, digest, bytes of each turn: its place in its conversation, its digest and the length of its text."""
    rows, row_id = numbered(conversations)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    narrow = rows.where("conv_id IS NOT NULL").select("conv_id", "turn", F.col(row_id).alias("row_id"), joined_digest(whole).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row_id")]
    found = placed(narrow, ["conv_id"], order, f"{folder}/turns", "pos")
    return stored(found.select("conv_id", "pos", "digest", "bytes"), f"{folder}/placed")


def head_length(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("long")


def rebuilt(turns: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """The conversations with the first turns of another spliced in: turns (conv_id, pos, digest, bytes, last), and conv_id, size of every conversation."""
    first = F.col("conv_id") - F.col("conv_id") % SPLICED
    heads = turns.where((F.col("conv_id") % SPLICED == 0) & (F.col("pos") < HEADS - 1)).select(F.col("conv_id").alias("of"), F.col("pos").alias("head_pos"), F.col("digest").alias("head_digest"), F.col("bytes").alias("head_bytes"))
    lengths = heads.groupBy("of").agg(F.count(F.lit(1)).alias("have"))
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).withColumns({"of": first, "h": head_length(F.col("conv_id"))})
    taken = F.least("h", F.coalesce("have", F.lit(0)))
    convs = convs.hint("merge").join(lengths, "of", "left").select("conv_id", "of", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size"))
    convs = stored(convs, f"{folder}/convs")
    spliced = convs.hint("merge").join(heads, "of").where("head_pos < h").select("conv_id", F.col("head_pos").alias("pos"), F.col("head_digest").alias("digest"), F.col("head_bytes").alias("bytes"), "size")
    # a conversation may hold a third of all turns: a merge join, whose large partitions Spark splits
    kept = turns.where(F.col("pos") >= head_length(F.col("conv_id"))).hint("merge").join(convs.select("conv_id", "h", "taken", "size"), "conv_id")
    own = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "bytes", "size")
    return spliced.unionByName(own).withColumn("last", F.col("pos") == F.col("size") - 1).drop("size"), convs.select("conv_id", "size")


def chained(rows: DataFrame, keys: list[str], order: str, digest: str) -> DataFrame:
    """``rows`` with ``before`` and ``upto``: the fold of ``digest`` in ``order`` over the rows of the same ``keys``, without and with the row itself.

    ``before`` is null in the first row. Rows are read as a sorted stream.
    """
    schema = rows.withColumns({"before": F.lit(None).cast("binary"), "upto": F.lit(None).cast("binary")}).schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            before, upto = [], []
            for key, x in zip(zip(*[batch.column(k).to_pylist() for k in keys], strict=True), batch.column(digest).to_pylist(), strict=True):
                if key != now:
                    now, state = key, None
                before.append(state)
                state = hashlib.sha256((state or b"") + x).digest()[:16]
                upto.append(state)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.binary()), pa.array(upto, pa.binary())], names=schema.names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(fold, schema)


def prefixes(turns: DataFrame, folder: str, run: int = RUN) -> DataFrame:
    """conv_id, depth, node, parent, bytes, last of each rebuilt turn; ``node`` names the turns up to it, ``parent`` those before it."""
    parts = stored(chained(turns.withColumn("run", F.floor(F.col("pos") / run)), ["conv_id", "run"], "pos", "digest"), f"{folder}/parts")
    # the fold over a conversation's full runs, again a stream, gives each run but the first the name of the node that it hangs below
    ends = parts.where(F.pmod("pos", F.lit(run)) == run - 1).select("conv_id", "run", F.col("upto").alias("of_run"))
    starts = chained(ends, ["conv_id"], "run", "of_run").select("conv_id", (F.col("run") + 1).alias("run"), F.col("upto").alias("start"))
    whole = parts.hint("merge").join(starts, ["conv_id", "run"], "left")
    start = F.coalesce("start", F.lit(b""))
    parent = F.when(F.col("before").isNotNull(), joined_digest(start, F.col("before"))).otherwise(F.coalesce("start", F.lit(ROOT)))
    return whole.select("conv_id", (F.col("pos") + 1).alias("depth"), joined_digest(start, F.col("upto")).alias("node"), parent.alias("parent"), "bytes", "last")


def ids_hashed(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: the SHA-256 of the ascending ids, joined by commas, of each node's rows (node, conv_id)."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            nodes, hashes = [], []
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != now:
                    if now is not None:
                        nodes.append(now)
                        hashes.append(state.hexdigest())
                    now, state = node, hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(hashes, pa.string())], names=["node", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    return ends.select("node", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(stream, "node binary, ends_sha256 string")


def tour(nodes: DataFrame) -> DataFrame:
    """arc, prev, next of the Euler tour of ``nodes`` (g, first, last): node g enters by arc 2g and exits by 2g + 1.

    Siblings have consecutive numbers; ``first`` and ``last`` are those of a node's children, null without any. The root has
    the largest number.
    """
    enter, exit_ = F.col("g") * 2, F.col("g") * 2 + 1
    null = F.lit(None).cast("long")
    arc = lambda a, prev, next_, prev_sib, next_sib: F.struct(a.alias("arc"), prev.alias("prev"), next_.alias("next"), prev_sib.alias("prev_sib"), next_sib.alias("next_sib"))
    root = F.col("depth") == 0
    leaf = F.col("first").isNull()
    own = [
        arc(enter, null, F.when(leaf, exit_).otherwise(F.col("first") * 2), F.when(~root, enter - 1), null),
        arc(exit_, F.when(leaf, enter).otherwise(F.col("last") * 2 + 1), null, null, F.when(~root, exit_ + 1)),
    ]
    told = [arc(F.col("first") * 2, enter, null, null, null), arc(F.col("last") * 2 + 1, null, exit_, null, null)]
    sent = nodes.select(F.explode(F.when(leaf, F.array(*own)).otherwise(F.array(*own, *told))).alias("x")).select("x.*")
    # what a parent says of its first and last child goes before what they would take their neighbours to be
    return sent.groupBy("arc").agg(*[F.coalesce(F.max(c), F.max(f"{c}_sib")).alias(c) for c in ("prev", "next")])


def ranked(arcs: DataFrame, folder: str, last: int = LAST) -> DataFrame:
    """arc, place: the places from 0 in the list that ``arcs`` (arc, prev, next) make; its first arc has no prev.

    ``dp`` and ``dn`` are the distances to the neighbours.
    """
    rows = stored(arcs.select("arc", "prev", "next", F.lit(1).cast("long").alias("dp"), F.lit(1).cast("long").alias("dn")), f"{folder}/list0")
    gone, n, k = [], rows.count(), 0
    while n > last:
        drawn = lambda c: F.xxhash64(F.lit(k), F.col(c))  # noqa: B023, E731
        leaves = F.coalesce((drawn("arc") < drawn("prev")) & (drawn("arc") < drawn("next")) & F.col("prev").isNotNull() & F.col("next").isNotNull(), F.lit(False))
        marked = rows.withColumn("leaves", leaves)
        gone.append(stored(marked.where("leaves").select("arc", "prev", "dp"), f"{folder}/gone{k}"))
        null, apart = F.lit(None).cast("long"), F.col("dp") + F.col("dn")
        message = lambda a, prev, dp, next_, dn: F.struct(a.alias("arc"), prev.alias("prev"), dp.alias("dp"), next_.alias("next"), dn.alias("dn"), F.lit(True).alias("told"))
        told = marked.where("leaves").select(F.explode(F.array(message(F.col("prev"), null, null, F.col("next"), apart), message(F.col("next"), F.col("prev"), apart, null, null))).alias("x")).select("x.*")
        stay = marked.where("NOT leaves").select("arc", "prev", "dp", "next", "dn", F.lit(False).alias("told"))
        by = {c: F.coalesce(F.max(F.when(F.col("told"), F.col(c))), F.max(F.when(~F.col("told"), F.col(c)))).alias(c) for c in ("prev", "next", "dp", "dn")}
        rows = stored(stay.unionByName(told).groupBy("arc").agg(*by.values()), f"{folder}/list{k + 1}")
        k, n = k + 1, rows.count()
    found = rows.repartition(1).mapInArrow(walked, "arc long, place long")
    for k in reversed(range(len(gone))):
        known = stored(found, f"{folder}/found{k}")
        after = gone[k].hint("merge").join(known.withColumnRenamed("arc", "prev"), "prev").select("arc", (F.col("place") + F.col("dp")).alias("place"))
        found = known.unionByName(after)
    return found


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of at most ``LAST`` arcs by doubling each one's step towards the beginning."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    arcs = table["arc"].to_numpy()
    order = np.argsort(arcs)
    prev = table["prev"].fill_null(-1).to_numpy()
    first = prev < 0
    to = np.where(first, np.arange(len(arcs)), order[np.searchsorted(arcs, prev, sorter=order).clip(0, len(arcs) - 1)])
    steps = np.where(first, 0, table["dp"].to_numpy())
    for _ in range(max(1, len(arcs)).bit_length()):
        steps, to = steps + steps[to], to[to]
    yield pa.RecordBatch.from_arrays([pa.array(arcs), pa.array(steps)], names=["arc", "place"])


def trie(turns: DataFrame, convs: DataFrame, folder: str, run: int = RUN, last: int = LAST) -> DataFrame:
    """One row for each node of the trie of ``turns`` (conv_id, pos, digest, bytes, last), of all ``convs`` (conv_id, size)."""
    steps = stored(prefixes(turns, folder, run), f"{folder}/prefixes")
    counted = [F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")]
    inner = steps.groupBy("node").agg(*counted, F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("bytes").alias("bytes"))
    # without conversations the root's group is empty and goes
    top = convs.agg(*counted).where("n_convs > 0").select(F.lit(ROOT).alias("node"), "conv_id", "n_convs", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("bytes"))
    # null parents come last, so the root has the largest number
    all_nodes = inner.unionByName(top).withColumn("all", F.lit(0))
    named = placed(all_nodes, ["all"], [F.col("parent").asc_nulls_last(), F.col("node")], f"{folder}/nodes", "g").drop("all")
    named = stored(named, f"{folder}/named")
    kids = named.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.min("g").alias("first"), F.max("g").alias("last"), F.count(F.lit(1)).alias("n_children"))
    nodes = stored(named.hint("merge").join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), f"{folder}/linked")
    places = ranked(tour(nodes), f"{folder}/tour", last)
    arcs = places.select(F.floor(F.col("arc") / 2).alias("g"), F.when(F.col("arc") % 2 == 0, F.col("place")).alias("enter"), F.when(F.col("arc") % 2 == 1, F.col("place")).alias("exit"))
    spans = arcs.groupBy("g").agg(F.max("enter").alias("enter"), F.max("exit").alias("exit"))
    own = nodes.select("g", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    held = stored(spans.hint("merge").join(own, "g"), f"{folder}/spans")
    zero = F.lit(0).cast("long")
    event = lambda place, sign, leaf, saved: F.struct(F.col(place).alias("place"), F.lit(sign).alias("sign"), leaf.alias("n_leaves"), saved.alias("saved_tokens"), F.when(F.lit(sign < 0), F.col("leaf")).otherwise(zero).alias("more_leaves"), F.when(F.lit(sign < 0), F.col("saved")).otherwise(zero).alias("more_saved"))
    events = held.select("g", F.explode(F.array(event("enter", -1, F.col("leaf"), F.col("saved")), event("exit", 1, zero, zero))).alias("x")).select("g", "x.*")
    # sums at exit less sums at enter, and what the node itself has, which its enter already counts
    ran = summed(stored(events, f"{folder}/events"), "place", ["n_leaves", "saved_tokens"])
    within = ran.groupBy("g").agg(*[(F.sum(F.col("sign") * F.col(c)) + F.sum(more)).cast("long").alias(c) for c, more in (("n_leaves", "more_leaves"), ("saved_tokens", "more_saved"))])
    ends = steps.where("last").select("node", "conv_id").unionByName(convs.where("size = 0").select(F.lit(ROOT).alias("node"), "conv_id"))
    # a node may have a third of all as children: again merge joins
    parents = named.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.hint("merge").join(within, "g").hint("merge").join(parents, "parent", "left")
    out = out.hint("merge").join(ids_hashed(ends), "node", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, folder: str | None = None, run: int = RUN, last: int = LAST) -> DataFrame:
    """The trie of the rebuilt ``conversations`` (conv_id, turn, role, text)."""
    folder = folder or work_folder(conversations.sparkSession, "trie")
    turns, convs = rebuilt(turns_of(conversations, folder), folder)
    return trie(turns, convs, folder, run, last)


def query(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = f"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % {SPLICED} AS of, {crc32_sql("conv_id::VARCHAR")} % {HEADS} AS h FROM o),
b AS (SELECT c.conv_id, 0 AS part, o.pos, o.role, o.text FROM c JOIN o ON o.conv_id = c.of AND o.pos < c.h
      UNION ALL SELECT c.conv_id, 1, o.pos, o.role, o.text FROM c JOIN o USING (conv_id) WHERE o.pos >= c.h),
t AS (SELECT conv_id, row_number() OVER w AS depth, list(sha256(length(role) || ':' || role || text)) OVER w AS path, octet_length(encode(text)) AS bytes FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
p AS (SELECT conv_id, depth, sha256(array_to_string(path, ',')) AS node, CASE WHEN depth > 1 THEN sha256(array_to_string(path[:depth - 1], ',')) ELSE '' END AS parent, bytes FROM t
      UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM c),
n AS (SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(parent) AS parent, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY node),
k AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
e AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(node, depth) AS node FROM p GROUP BY conv_id) GROUP BY node),
s AS (SELECT p.node, sum(CASE WHEN k.node IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved_tokens
      FROM n LEFT JOIN k USING (node) JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.node)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n JOIN s USING (node) LEFT JOIN k USING (node) LEFT JOIN n q ON q.node = n.parent LEFT JOIN e ON e.node = n.node
"""
