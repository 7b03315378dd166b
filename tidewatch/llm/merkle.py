"""Merkle manifest of a table: every row's proof by a rollup of nested structs.

Each row is a leaf of its language's tree; runs of ``FAN`` nodes become one, and the
languages' roots are the leaves of one more tree. A row's rank in its language, in
base ``FAN``, says where it stands: the last ``DIGITS`` digits are columns, the rest
names its block. Grouping by all digits but the last, then all but the last two, and so on,
nests each run's nodes into its parent's struct, until a block is one struct of at most
``FAN ** DIGITS`` leaves. The blocks' roots are the nodes of the next tier, ranked and
rolled up alike, as often as needed; the number of tiers is all that the driver learns.

Going down, each tier's transform and explode give its nodes their siblings, and the
path above meets a block's struct by grouping both under the block's key. No join
makes a proof, and no group holds more than a block.

``H`` is the lower-case hex SHA-256 of the concatenated inputs. A null field is
``-``, another its length in UTF-8 bytes, ``:`` and the value, so an empty text is ``0:``. Null
ids and languages come first. Rows with the same id, even wholly equal ones, are leaves
of their own, in order of their hash and then of reading. A row without id is never tampered
with. An empty table gives no rows. A text is one value of its task however long it is;
it is hashed in the scan and never shuffled. Columns besides the five fields are
not read, so clashing names do no harm.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.flat import numbered
from tidewatch.operators.places import placed
from tidewatch.session import stored, work_folder

FAN = 8
DIGITS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<l:string,r:string>>"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(text: Column) -> Column:
    return hashed(*[field(text if c == "text" else F.col(c)) for c in FIELDS])


def leaves_of(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """lang, doc_id, row_id, h, alt: each row's leaf, and the leaf of its text after tampering where ``tampered`` holds."""
    docs, row_id = numbered(docs)
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    changed = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    leaf = leaf_hash(F.col("text"))
    return docs.select("lang", "doc_id", F.col(row_id).alias("row_id"), leaf.alias("h"), F.when(changed, leaf_hash(lower)).otherwise(leaf).alias("alt"))


def nested(nodes: DataFrame, group: list[str], extra: list[str]) -> DataFrame:
    """Nodes (group, place, h, extra) rolled up: a row for each block, with its size ``m``, root ``h`` and nested struct ``tree``.

    Level by level the last digit is grouped away, and what had it becomes an element of its parent's ``kids``.
    """
    digits = [f"d{k}" for k in range(DIGITS)]
    block = F.floor(F.col("place") / FAN**DIGITS)
    levels = nodes.select(*group, block.alias("block"), *[F.pmod(F.floor(F.col("place") / FAN**k), F.lit(FAN)).cast("int").alias(d) for k, d in enumerate(digits)], "h", F.struct(*extra).alias("own"))
    # all later groupings hold the keys that this one deals by, so nothing is shuffled again
    levels = levels.repartition(*group, "block").withColumn("m", F.lit(1).cast("long"))
    body = "own"
    for k, digit in enumerate(digits):
        kids = F.array_sort(F.collect_list(F.struct(digit, "h", F.col(body).alias("body"))))
        up = levels.groupBy(*group, "block", *digits[k + 1 :]).agg(kids.alias("kids"), F.sum("m").alias("m"))
        joined = F.array_join(F.transform("kids", lambda x: x["h"]), "")
        levels, body = up.withColumn("h", F.sha2(joined.cast("binary"), 256)), "kids"
    return levels.select(*group, "block", "m", "h", F.col("kids").alias("tree"))


def depth_of(m: Column, block: Column) -> Column:
    """Levels that a block needs. One that isn't full and is the first is alone, so its levels end where one node is left."""
    whole = (block > 0) | (m >= FAN**DIGITS)
    steps = F.lit(DIGITS)
    for k in reversed(range(DIGITS)):
        steps = F.when(m <= FAN**k, k).otherwise(steps)
    return F.when(whole, DIGITS).otherwise(steps)


def top_of(blocks: DataFrame) -> DataFrame:
    """The blocks as nodes of the next tier: their root is the node of the last level that they need."""
    tree, depth = F.col("tree"), depth_of(F.col("m"), F.col("block"))
    top, node = F.when(depth == DIGITS, F.col("h")), tree
    for k in reversed(range(DIGITS)):
        top = top.when(depth == k, F.get(node, F.lit(0))["h"])
        node = F.get(node, F.lit(0))["body"]
    return blocks.withColumn("h", top)


def unnested(blocks: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each node of the blocks: ``keep``, place, h, own, and ``steps``, its siblings from its run upwards and on along ``above``.

    From the block's root down, a transform gives each node of a run the siblings to its left and right, and an explode
    makes it a row, with its own kids still nested in it.
    """
    joined = lambda cut: F.array_join(F.transform(cut, lambda y: y["h"]), "")
    flat = blocks.select(*keep, depth_of(F.col("m"), F.col("block")).alias("depth"), F.col("block").alias("place"), F.col("tree").alias("body"), F.col("above").alias("steps"))
    for k in reversed(range(DIGITS)):
        left = joined(F.filter("body", lambda y: y[f"d{k}"] < F.col("x")[f"d{k}"]))
        right = joined(F.filter("body", lambda y: y[f"d{k}"] > F.col("x")[f"d{k}"]))
        step = F.when(F.col("depth") > k, F.array(F.struct(left.alias("l"), right.alias("r")))).otherwise(F.expr(f"CAST(array() AS {_STEPS})"))
        flat = flat.withColumn("x", F.explode("body"))
        flat = flat.select(*keep, "depth", (F.col("place") * FAN + F.col(f"x.d{k}")).alias("place"), F.col("x.h").alias("h"), F.col("x.body").alias("body"), F.concat(step, "steps").alias("steps"))
    return flat.select(*keep, "place", "h", F.col("body").alias("own"), "steps")


def tiers_of(nodes: DataFrame, group: list[str], extra: list[str], folder: str) -> list[DataFrame]:
    """The written blocks of each tier, until every group is one block."""
    tiers = []
    while True:
        tiers.append(stored(top_of(nested(nodes, group, extra)), f"{folder}/tier{len(tiers)}"))
        if not (tiers[-1].agg(F.max("block")).first()[0] or 0):
            return tiers
        nodes, extra = tiers[-1].select(*group, F.col("block").alias("place"), "h", F.lit(0).alias("unused")), ["unused"]


def brought_down(tiers: list[DataFrame], group: list[str], above: DataFrame, carried: list[str]) -> DataFrame:
    """The first tier's nodes with their steps. above: group, ``above``, ``carried`` of each group's root.

    What is above a block and its struct meet under the block's key by a union and a group of two rows.
    """
    above = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(tiers):
        paths = above.select(*group, "block", F.struct("above", *carried).alias("path"))
        both = blocks.select(*group, "block", F.struct("m", "tree").alias("own_block")).unionByName(paths, allowMissingColumns=True)
        met = both.groupBy(*group, "block").agg(F.first("own_block", ignorenulls=True).alias("b"), F.first("path", ignorenulls=True).alias("p"))
        flat = met.select(*group, "block", "b.*", "p.*")
        nodes = unnested(flat, [*group, *carried])
        above = nodes.select(*group, F.col("place").alias("block"), F.col("steps").alias("above"), *carried)
    return nodes


def manifest(docs: DataFrame, tampered: Column | None = None, folder: str | None = None) -> DataFrame:
    """row_id, doc_id, leaf, alt, subroot, root, steps of each row of ``docs``; ``alt`` is the leaf of a row as it is found later."""
    spark = docs.sparkSession
    folder = folder or work_folder(spark, "merkle")
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "h", "row_id")]
    ranked = placed(leaves_of(docs, tampered), ["lang"], order, f"{folder}/leaves")
    tiers = tiers_of(ranked, ["lang"], ["doc_id", "row_id", "alt"], f"{folder}/langs")
    subroots = tiers[-1].select(F.lit(0).alias("all"), "lang", "h")
    langs = placed(subroots, ["all"], [F.col("lang").asc_nulls_first()], f"{folder}/subroots")
    top = tiers_of(langs, ["all"], ["lang"], f"{folder}/top")
    root = top[-1].select("all", F.col("h").alias("root"), F.expr(f"CAST(array() AS {_STEPS})").alias("above"))
    down = brought_down(top, ["all"], root, ["root"])
    above = down.select(F.col("own.lang").alias("lang"), F.col("steps").alias("above"), F.col("h").alias("subroot"), "root")
    rows = brought_down(tiers, ["lang"], above, ["subroot", "root"])
    return rows.select("own.row_id", "own.doc_id", F.col("h").alias("leaf"), "own.alt", "subroot", "root", "steps")


def proof_hash(steps: Column) -> Column:
    """H of the siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["l"], s["r"])), "").cast("binary"), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda h, s: hashed(s["l"], h, s["r"]))


def verified(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`manifest` with proof_sha256, folded_root (from ``alt``) and whether it is the root."""
    return rows.withColumns({"proof_sha256": proof_hash(F.col("steps")), "folded_root": folded(F.col("alt"), F.col("steps"))}).withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return verified(manifest(docs, tampered)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text as a DuckDB expression."""
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    for _ in range(7):
        bit = f"list_transform([{bit}], lambda c: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)[1]"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda s, x: list_transform([xor(s, x)], lambda c: {bit})[1]), 4294967295)"


def _sql() -> str:
    f = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(f(text if c == "text" else c) for c in FIELDS) + ")"
    upper, lower = string.ascii_uppercase, string.ascii_lowercase

    def tree(name: str) -> str:
        return f"""
  SELECT t, n, 0 AS lvl, i, h FROM {name} UNION ALL
  SELECT t, (n + {FAN - 1}) // {FAN}, lvl + 1, i // {FAN}, sha256(string_agg(h, '' ORDER BY i)) FROM {name}_all WHERE n > 1 GROUP BY t, n, lvl, i // {FAN}"""

    sides = lambda t: f"coalesce((SELECT string_agg(o.h, '' ORDER BY o.i) FROM {t}_all o WHERE o.t IS NOT DISTINCT FROM s.t AND o.lvl = s.lvl AND o.i // {FAN} = s.i // {FAN} AND o.i"
    steps = lambda t: f"SELECT t, lvl, i, {sides(t)} < s.i), '') AS l, {sides(t)} > s.i), '') AS r FROM {t}_all s WHERE n > 1"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang AS t, {leaf("text")} AS h, CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 3 = 0 THEN {leaf(f"translate(text, '{upper}', '{lower}')")} ELSE {leaf("text")} END AS alt FROM documents),
a AS (SELECT doc_id, t, h, alt, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM d),
a_all AS ({tree("a")}),
b AS (SELECT 0 AS t, t AS lang, h, row_number() OVER (ORDER BY t NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM a_all WHERE n = 1),
b_all AS ({tree("b")}),
sa AS ({steps("a")}), sb AS ({steps("b")}),
w AS (
  SELECT a.doc_id, a.i AS leaf_i, a.t, sa.lvl AS k, sa.l, sa.r FROM a JOIN sa ON sa.t IS NOT DISTINCT FROM a.t AND sa.i = a.i // pow({FAN}, sa.lvl)::BIGINT
  UNION ALL SELECT a.doc_id, a.i, a.t, 1000 + sb.lvl, sb.l, sb.r FROM a JOIN b ON b.lang IS NOT DISTINCT FROM a.t JOIN sb ON sb.i = b.i // pow({FAN}, sb.lvl)::BIGINT),
p AS (SELECT leaf_i, t, string_agg(l || r, '' ORDER BY k) AS proof, list({{'l': l, 'r': r}} ORDER BY k) AS steps FROM w GROUP BY leaf_i, t),
o AS (SELECT a.doc_id, a.h AS leaf, b.h AS subroot, (SELECT h FROM b_all WHERE n = 1) AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
             list_reduce(list_concat([{{'l': a.alt, 'r': ''}}], coalesce(p.steps, [])), lambda x, y: {{'l': sha256(y['l'] || x['l'] || y['r']), 'r': ''}})['l'] AS folded_root
      FROM a JOIN b ON b.lang IS NOT DISTINCT FROM a.t LEFT JOIN p ON p.leaf_i = a.i AND p.t IS NOT DISTINCT FROM a.t)
SELECT *, folded_root = root AS verified FROM o
"""


SQL = _sql()
