r"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines are what stands between ``\n``, without spaces, tabs and ``\r`` around; empty
lines are left alone. Equal lines are one node. Two nodes are linked if their edit
distance is at most ``EDITS`` and at most one for each ``PER_EDIT`` code points of the longer
line: of the shortest lines, whose few characters would nearly all be near each
other, only equal ones match. A line's class is its connected component of links, and
the first line of a class (least doc_id, null last, then line number) is the one that stays.

The join (Li et al., Pass-Join, 2011): a line of length l is cut into ``EDITS + 1``
segments, so one at least stands unedited in a line near it. Segments are indexed by
length, number and content. A line probes the index of each length from its own
down to ``EDITS`` less with the substrings that the multi-match-aware bounds allow for each
segment. Most keys are of one line only: they go before anything more is made of their lines.
Lines of many texts that share a segment would all meet; counts of ten letters of the lines that
are left part those that no two edits could make equal within the join. What is left is
verified, with its distance, by a banded bit-parallel automaton: a word for each
number of edits holds the reachable diagonals of the band, and reading a
character moves all diagonals at once.

Null text is one empty line. Repeated rows repeat each other's lines. An empty table
gives no rows; other columns are not read. A very long line is one node like others: its
keys are hashes and its verification is given up where it has too many edits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.flat import numbered
from tidewatch.operators.components import components
from tidewatch.session import released, removed, stored, work_folder

EDITS = 2
PER_EDIT = 10
#: What lines are trimmed of.
BLANK = " \t\r"
#: Common letters of Latin scripts. Any would be right; those that lines have part them best.
LETTERS = "etanisrohd"
#: Characters after which the automaton looks whether any state is left.
STOP = 20
PAIRS_A_TASK = 10_000
#: Lengths of parts by which common beginnings are skipped.
PARTS = (4096, 2048, 1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1)


def lines_of(docs: DataFrame, row_id: str) -> DataFrame:
    """row_id, doc_id, line_no, line of each row."""
    cut = docs.select(F.col(row_id).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))
    # trimming copies and measures a line, so it is left to those that have something to trim
    blank = reduce(lambda a, b: a | b, [f("line", F.lit(c)) for c in BLANK for f in (F.startswith, F.endswith)])
    return cut.select("row_id", "doc_id", "line_no", F.when(blank, F.btrim("line", F.lit(BLANK))).otherwise(F.col("line")).alias("line"))


def key_of(line: Column) -> Column:
    return F.substring(F.unhex(F.sha2(line.cast("binary"), 256)), 1, 16)


def keyed_parts(nodes: DataFrame, probes: list[tuple[int, int, int]], edits: int) -> DataFrame:
    """node, other, own, k: a key for each probe (how much shorter the indexed line is, segment, shift) of each line.

    ``other`` is the node too, or -1 less it where the indexed line is shorter. ``own`` keys are those
    of the line's own segments, which the index has too.

    Segments are even parts, the longer ones last. The probes are exploded first and one
    expression makes all keys: code for each of them would be too long to be compiled.
    A segment is hashed as UTF-8. Where each code point is a byte it is cut from the bytes, without counting characters anew.
    """
    parts = edits + 1
    specs = F.array(*[F.struct(F.lit(a).alias("less"), F.lit(i).alias("i"), F.lit(s).alias("shift")) for a, i, s in probes])
    sizes = nodes.select("node", "line", F.length("line").alias("l"), F.octet_length("line").alias("bytes"))
    each = sizes.select("*", F.explode(specs).alias("p")).select("node", "l", "bytes", "line", (F.col("l") - F.col("p.less")).alias("m"), "p.i", "p.shift")
    sized = each.select("*", F.expr(f"CAST(m div {parts} AS INT)").alias("even"), F.expr(f"m % {parts}").alias("longer"))
    placed = sized.select("node", "l", "bytes", "line", "m", "i", "shift", F.expr(f"1 + even * i + greatest(0, longer - ({parts} - i)) + shift").alias("at"), F.expr(f"even + IF(i >= {parts} - longer, 1, 0)").alias("size"))
    whole = placed.where("at >= 1 AND at + size - 1 <= l")
    return whole.select("node", F.expr("IF(m < l, -1 - node, node)").alias("other"), F.expr("m = l AND shift = 0").alias("own"), F.expr("xxhash64(m, i, IF(bytes = l, substring(CAST(line AS BINARY), at, size), CAST(substring(line, at, size) AS BINARY)))").alias("k"))


def index_probes(edits: int) -> list[tuple[int, int, int]]:
    return [(0, i, 0) for i in range(edits + 1)]


def search_probes(edits: int) -> list[tuple[int, int, int]]:
    """The multi-match-aware bounds: a shift that leaves more edits on one side than the segments there allow can't be the first match."""
    return [(less, i, s) for less in range(edits + 1) for i in range(edits + 1) for s in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)]


def distances(pairs: DataFrame, edits: int) -> DataFrame:
    """a, b, n (code points of y), edits of ``pairs`` (a, b and lines x, y): the distance if at most ``edits``, else null.

    Bit ``edits + d`` of word e says that diagonal d (place in x less place in y) is
    reached with e edits. What both lines begin with and what both end with never needs an edit: it is left out
    by comparing halved parts, of the lines and of their rests reversed. The fold runs over ``STOP`` characters, and
    over the rest only where a bit is left. Arrays are made by projections of their own:
    inside the fold they would be made anew for each character.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1
    rest = lambda c: F.substring(c, F.col("p") + 1, F.length(c))
    cut = pairs.select("a", "b", "x", "y", F.length("x").alias("m"), F.length("y").alias("n"))
    for _ in ("beginning", "end"):
        cut = cut.withColumn("p", F.lit(0))
        for size in PARTS:
            part = lambda c: F.substring(c, F.col("p") + 1, F.lit(size))  # noqa: B023, E731
            cut = cut.withColumn("p", F.when(part("x") == part("y"), F.col("p") + size).otherwise(F.col("p")))
        cut = cut.withColumns({"x": F.reverse(rest("x")), "y": F.reverse(rest("y"))})

    def letters(text: Column) -> Column:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))

    def placed(text: Column) -> Column:
        return F.transform(letters(text), lambda c, j: F.struct(c.alias("c"), j.alias("j")))

    def step(x: str):
        def read(words: Column, at: Column) -> Column:
            same = F.lit(0)
            for r in range(width):
                place = at["j"] + (r - edits)
                same = same + F.when((place >= 0) & (F.get(x, F.greatest(place, F.lit(0))) == at["c"]), 1 << r).otherwise(0)
            out = []
            for e in range(edits + 1):
                word = F.get(words, F.lit(e)).bitwiseAND(same)
                if e:
                    before = F.get(words, F.lit(e - 1))
                    word = word.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(out[-1], 1).bitwiseAND(F.lit(mask)))
                out.append(word)
            return F.array(*out)

        return read

    begin = F.array(*[F.lit(sum(1 << edits + d for d in range(e + 1))) for e in range(edits + 1)])
    cut = cut.withColumns({"head_x": letters(F.substring("x", 1, STOP + edits)), "head_y": placed(F.substring("y", 1, STOP))})
    headed = cut.withColumn("head", F.aggregate("head_y", begin, step("head_x")))
    alive = F.exists("head", lambda w: w != 0)
    headed = headed.withColumns({"all_x": F.when(alive, letters(F.col("x"))), "all_y": F.when(alive, placed(F.col("y")))})
    tail = F.slice("all_y", F.lit(STOP + 1), F.greatest(F.size("all_y") - STOP, F.lit(0)))
    ended = headed.select("a", "b", "m", "n", F.aggregate(tail, F.col("head"), step("all_x")).alias("ends"))
    last = F.get(F.array(*[F.lit(1 << r) for r in range(width)]), F.lit(edits) + F.col("m") - F.col("n"))
    found = F.coalesce(*[F.when(F.get("ends", F.lit(e)).bitwiseAND(last) != 0, e) for e in range(edits + 1)])
    return ended.select("a", "b", "n", found.alias("edits"))


def with_letters(lines: DataFrame) -> DataFrame:
    """``lines`` (line) with letters: counts of ``LETTERS`` in each line, six bits each and modulo 64.

    Each letter is taken out of what the ones before it have left, so the commonest go first.
    """
    rest, counts = lines.withColumn("rest0", F.col("line")), []
    for k, x in enumerate(LETTERS):
        rest = rest.withColumn(f"rest{k + 1}", F.replace(F.col(f"rest{k}"), F.lit(x)))
        counts.append((F.octet_length(f"rest{k}") - F.octet_length(f"rest{k + 1}")).cast("long").bitwiseAND(F.lit(63)))
    return rest.select(*lines.columns, reduce(lambda a, b: F.shiftleft(a, 6).bitwiseOR(b), counts).alias("letters"))


def counts_within(a: Column, b: Column, edits: int) -> Column:
    """Whether letter counts leave it open that two lines are within ``edits``: each edit changes two counts by one at most."""
    apart = []
    for k in range(len(LETTERS)):
        d = F.abs(F.shiftright(a, 6 * k).bitwiseAND(F.lit(63)) - F.shiftright(b, 6 * k).bitwiseAND(F.lit(63)))
        apart.append(F.least(d, F.lit(64) - d))
    return reduce(lambda x, y: x + y, apart) <= 2 * edits


def node_of(other: Column) -> Column:
    return F.when(other < 0, -1 - other).otherwise(other)


def shared_keys(nodes: DataFrame, folder: str, edits: int = EDITS) -> DataFrame:
    """node, other, own, k: the keys (see :func:`keyed_parts`) that an indexed line has and some other line too.

    A line's own segments are among its probes, so one row is both. The segments are dealt one after the other,
    so that only the keys of one are on disk; what they leave is written.
    """
    by_key, node = Window.partitionBy("k"), node_of(F.col("other"))
    for i in range(edits + 1):
        keys = keyed_parts(nodes, [x for x in search_probes(edits) if x[1] == i], edits).select("other", "own", "k")
        seen = keys.select("*", F.min(node).over(by_key).alias("least"), F.max(node).over(by_key).alias("most"), F.max("own").over(by_key).alias("indexed"))
        seen.where("least < most AND indexed").select(node.alias("node"), "other", "own", "k").write.parquet(f"{folder}/shared/segment={i}")
        released(nodes.sparkSession)
    return nodes.sparkSession.read.schema("node long, other long, own boolean, k long").parquet(f"{folder}/shared")


def near_pairs(nodes: DataFrame, folder: str, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """a, b, edits: pairs of ``nodes`` (node, line; lines distinct, nodes not negative) within the edits that their length allows.

    The lines that share a key with another one are left in ``folder``/texts (node, line, letters).
    """
    spark = nodes.sparkSession
    shared = shared_keys(nodes, folder, edits)
    some = shared.select("node").distinct()
    texts = stored(with_letters(nodes.select("node", "line").join(some.hint("shuffle_hash"), "node", "left_semi")), f"{folder}/texts")
    released(spark)
    counted = stored(shared.hint("merge").join(texts.select("node", "letters"), "node"), f"{folder}/counted")
    index = counted.where("own").select("k", "node", F.col("letters").alias("index_letters"))
    # lines of equal length meet in both orders, of which one is taken; a probe of a shorter length has a number below 0
    met = counted.select("k", "other", "letters").hint("merge").join(index, "k")
    met = met.where((F.col("node") != node_of(F.col("other"))) & ((F.col("other") < 0) | (F.col("node") < F.col("other"))) & counts_within(F.col("letters"), F.col("index_letters"), edits))
    pairs = stored(met.select(F.col("node").alias("a"), node_of(F.col("other")).alias("b")).distinct(), f"{folder}/pairs")
    both = pairs.hint("merge").join(texts.select(F.col("node").alias("a"), F.col("line").alias("x")), "a")
    both = both.hint("merge").join(texts.select(F.col("node").alias("b"), F.col("line").alias("y")), "b")
    # small in bytes but not in work: the number of tasks follows the number of pairs
    n = max(spark.sparkContext.defaultParallelism, pairs.count() // PAIRS_A_TASK)
    dealt = both.select("a", "b", "x", "y").repartition(n, "a", "b")
    # written before it is filtered: a filter pushed below the arrays would make them anew for each character
    found = stored(distances(dealt, edits), f"{folder}/verified").where("edits IS NOT NULL")
    return found.where(F.col("edits") <= F.floor(F.col("n") / per_edit)).select("a", "b", "edits")


def line_classes(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT, folder: str | None = None) -> DataFrame:
    """doc_id, line_no, n_links, class_doc_id, class_line_no, kept for each line that isn't empty."""
    if per_edit <= 2 * edits:
        raise ValueError("lines must be longer than twice the edits")
    folder = folder or work_folder(docs.sparkSession, "lines")
    docs, row_id = numbered(docs)
    lines = lines_of(docs, row_id).where("line <> ''")
    keyed = stored(lines.select("row_id", "doc_id", "line_no", key_of(F.col("line")).alias("key")), f"{folder}/keyed")
    # numbered once and written, so that each later scan gives a line the same number
    least = per_edit - edits
    # of so many bytes a line is long enough in any case
    distinct = lines.where((F.octet_length("line") >= 4 * least) | (F.length("line") >= least)).select("line").distinct()
    nodes = stored(distinct.withColumn("node", F.monotonically_increasing_id()), f"{folder}/nodes")
    released(docs.sparkSession)
    links = stored(near_pairs(nodes, folder, edits, per_edit), f"{folder}/links")
    counts = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    roots = components(links.select("a", "b"), f"{folder}/components")
    linked = counts.hint("merge").join(roots, "node")
    texts = docs.sparkSession.read.schema("node long, line string").parquet(f"{folder}/texts")
    keys = stored(texts.join(roots.select("node").hint("shuffle_hash"), "node", "left_semi").select("node", key_of(F.col("line")).alias("key")), f"{folder}/keys")
    classes = linked.hint("merge").join(keys, "node").hint("merge").join(keys.select(F.col("node").alias("root"), F.col("key").alias("root_key")), "root")
    classes = stored(classes.select("key", "n_links", "root_key"), f"{folder}/classes")
    removed(docs.sparkSession, *[f"{folder}/{x}" for x in ("nodes", "shared", "counted", "texts", "verified")])
    released(docs.sparkSession)
    # one line may be a third of all lines: merge joins, whose large partitions Spark splits; minima are summed before they are dealt
    marked = keyed.hint("merge").join(classes, "key", "left").select("row_id", "doc_id", "line_no", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root_key", "key").alias("root"))
    marked = stored(marked, f"{folder}/marked")
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "line_no", "row_id")
    heads = marked.groupBy("root").agg(F.min(order).alias("head"))
    out = marked.hint("merge").join(heads, "root")
    kept = (F.col("row_id") == F.col("head.row_id")) & (F.col("line_no") == F.col("head.line_no"))
    return out.select("doc_id", "line_no", "n_links", F.col("head.doc_id").alias("class_doc_id"), F.col("head.line_no").alias("class_line_no"), kept.alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return line_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH RECURSIVE cut AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
lines AS (SELECT doc_id, line_no::INT AS line_no, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM cut),
filled AS (SELECT * FROM lines WHERE line <> ''),
nodes AS (SELECT line, row_number() OVER (ORDER BY line) AS node, length(line) AS l FROM (SELECT DISTINCT line FROM filled)),
links AS (
  SELECT x.node AS a, y.node AS b FROM nodes x JOIN nodes y ON y.l BETWEEN x.l AND x.l + {EDITS} AND x.node <> y.node AND (x.l < y.l OR x.node < y.node)
  WHERE y.l >= {PER_EDIT} AND levenshtein(x.line, y.line) <= least({EDITS}, y.l // {PER_EDIT})),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT node, node AS r FROM nodes UNION SELECT reach.node, sides.b FROM reach JOIN sides ON reach.r = sides.a),
roots AS (SELECT node, min(r) AS root FROM reach GROUP BY node),
counts AS (SELECT a AS node, count(*) AS n_links FROM sides GROUP BY a),
marked AS (
  SELECT doc_id, line_no, root, coalesce(n_links, 0) AS n_links
  FROM filled JOIN nodes USING (line) JOIN roots USING (node) LEFT JOIN counts USING (node)),
heads AS (SELECT root, min((doc_id, line_no)) AS head FROM marked GROUP BY root)
SELECT doc_id, line_no, n_links, head[1] AS class_doc_id, head[2] AS class_line_no, (doc_id, line_no) = head AS kept
FROM marked JOIN heads USING (root)
"""
