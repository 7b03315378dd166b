"""Common subsequences of two versions of many pages' lines, all pages at once.

Lines that stand once on both sides of a segment are anchors. Of a segment's anchors
the heaviest chain that keeps the order of both sides stays, which cuts the segment in
pieces; in a piece other lines stand once on both sides, and so on until no piece
has an anchor. What is left are lines that repeat, whose longest common
subsequence is found exactly, by bit-parallel dynamic programming. Where no anchor
that stays stands in the way of a longer subsequence, as in pages that gain and lose lines
without moving them, the whole is a longest one.

Each round is two windows over the lines that may still meet. Anchors in unbroken order are one block, so
the chain is chosen among as many blocks as the order breaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import stored, work_folder

WORD = 62
FULL = (1 << WORD) - 1


def _bound(value: Column, body) -> Column:
    """``body`` of a variable that holds ``value``, which in a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def heaviest_chain(blocks: Column) -> Column:
    """The places (from 0) in ``blocks``, an array of struct<r, w>, of the chain of increasing r that has the greatest sum of w."""
    none = F.expr("CAST(array() AS array<struct<r:bigint,f:bigint,prev:int,at:int>>)")
    best = lambda acc, x: F.array_max(F.transform(F.filter(acc, lambda y: y["r"] < x["r"]), lambda y: F.struct(y["f"].alias("f"), y["at"].alias("at"))))
    one = lambda acc, x, b: F.array(F.named_struct(F.lit("r"), x["r"], F.lit("f"), F.coalesce(b["f"], F.lit(0)) + x["w"], F.lit("prev"), F.coalesce(b["at"], F.lit(-1)), F.lit("at"), F.size(acc)))
    ran = F.aggregate(blocks, none, lambda acc, x: F.concat(acc, _bound(best(acc, x), lambda b: one(acc, x, b))))
    end = lambda acc: F.array_max(F.transform(acc, lambda y: F.struct(y["f"].alias("f"), y["at"].alias("at"))))["at"]
    start = lambda acc: F.named_struct(F.lit("want"), end(acc), F.lit("kept"), F.array().cast("array<int>"))
    back = lambda s, y: F.when(y["at"] == s["want"], F.named_struct(F.lit("want"), y["prev"], F.lit("kept"), F.concat(s["kept"], F.array(y["at"])))).otherwise(s)
    return _bound(ran, lambda acc: F.aggregate(F.reverse(acc), start(acc), back)["kept"])


def in_order(anchors: DataFrame) -> DataFrame:
    """The anchors (page_id, seg, i, j) of each segment's heaviest chain in both orders."""
    by_i, by_j = (Window.partitionBy("page_id", "seg").orderBy(c) for c in ("i", "j"))
    ranked = anchors.withColumn("r", F.row_number().over(by_j).cast("long"))
    breaks = F.when(F.col("r") == F.lag("r").over(by_i) + 1, 0).otherwise(1)
    blocked = ranked.withColumn("breaks", breaks).withColumn("block", F.sum("breaks").over(by_i))
    sizes = blocked.groupBy("page_id", "seg", "block").agg(F.min("r").alias("r"), F.count(F.lit(1)).alias("w"))
    lists = sizes.groupBy("page_id", "seg").agg(F.array_sort(F.collect_list(F.struct("block", "r", "w"))).alias("xs"))
    some = F.when(F.size("xs") == 1, F.array(F.lit(0))).otherwise(heaviest_chain(F.transform("xs", lambda x: F.struct(x["r"].alias("r"), x["w"].alias("w")))))
    kept = lists.select("page_id", "seg", F.explode(some).alias("at")).select("page_id", "seg", (F.col("at") + 1).cast("long").alias("block"))
    return blocked.hint("merge").join(kept, ["page_id", "seg", "block"], "left_semi").select("page_id", "seg", "i", "j")


def _bit(words: Column, k: Column) -> Column:
    return F.call_function("getbit", F.get(words, F.floor(k / WORD).cast("int")), F.pmod(k, F.lit(WORD)).cast("int"))


def repeated_pairs(rest: DataFrame) -> DataFrame:
    """page_id, i, j: a longest common subsequence of each segment of ``rest`` (page_id, seg, side, pos, code).

    The bit for column j of a row is 0 where one more line of the other side makes the common
    subsequence longer; a row follows from the one before by an addition with carry. The
    way back through the rows takes a pair where its bit turns 0.
    """
    key = ["page_id", "seg"]
    left, right = (rest.where(F.col("side") == s) for s in (0, 1))
    ranked = right.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("pos")) - 1)
    bits = ranked.groupBy(*key, "code", F.floor(F.col("k") / WORD).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("k", F.lit(WORD)).cast("int"))).alias("bits"))
    masks = bits.groupBy(*key, "code").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("mask"))
    columns = right.groupBy(*key).agg(F.array_sort(F.collect_list("pos")).alias("js"))
    rows = left.hint("merge").join(masks, [*key, "code"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", F.map_entries("mask").alias("mask")))).alias("rows"))
    both = rows.hint("merge").join(columns, key).withColumn("words", F.ceil(F.size("js") / WORD).cast("int"))
    full, zero = F.lit(FULL), F.lit(0).cast("long")
    dense = lambda mask: _bound(F.map_from_entries(mask), lambda m: F.transform(F.sequence(F.lit(0), F.col("words") - 1), lambda w: F.coalesce(F.try_element_at(m, w), zero)))

    def added(acc: Column, x: Column) -> Column:
        v, u = x["v"], x["v"].bitwiseAND(x["m"])
        total = v + u + acc["carry"]
        word = total.bitwiseAND(full).bitwiseOR(v.bitwiseAND(F.bitwise_not(u)))
        return F.named_struct(F.lit("carry"), F.shiftright(total, WORD), F.lit("out"), F.concat(acc["out"], F.array(word)))

    pairs = lambda v, m: F.zip_with(v, m, lambda a, b: F.named_struct(F.lit("v"), a, F.lit("m"), b))
    begin = F.named_struct(F.lit("carry"), zero, F.lit("out"), F.array().cast("array<bigint>"))
    row = lambda v, m: F.aggregate(pairs(v, m), begin, added)["out"]
    ones = F.array(F.transform(F.sequence(F.lit(1), F.col("words")), lambda _: full))
    table = F.aggregate("rows", ones, lambda acc, x: F.concat(acc, F.array(row(F.element_at(acc, -1), dense(x["mask"])))))

    def back(vs: Column):
        def step(s: Column, _: Column) -> Column:
            at = lambda i: _bit(F.get(vs, i), s["j"] - 1)
            to = lambda i, j, out: F.named_struct(F.lit("i"), i, F.lit("j"), j, F.lit("out"), out)
            pair = F.array(F.named_struct(F.lit("i"), s["i"], F.lit("j"), s["j"]))
            return (
                F.when((s["i"] == 0) | (s["j"] == 0), s)
                .when(at(s["i"]) == 1, to(s["i"], s["j"] - 1, s["out"]))
                .when(at(s["i"] - 1) == 0, to(s["i"] - 1, s["j"], s["out"]))
                .otherwise(to(s["i"] - 1, s["j"] - 1, F.concat(s["out"], pair)))
            )

        start = F.named_struct(F.lit("i"), F.size("rows"), F.lit("j"), F.size("js"), F.lit("out"), F.expr("CAST(array() AS array<struct<i:int,j:int>>)"))
        return F.aggregate(F.sequence(F.lit(1), F.size("rows") + F.size("js")), start, step)["out"]

    met = both.withColumn("x", F.explode(_bound(table, back)))
    return met.select("page_id", F.get("rows", F.col("x.i") - 1)["pos"].alias("i"), F.get("js", F.col("x.j") - 1).alias("j"))


def common_lines(old: DataFrame, new: DataFrame, folder: str | None = None) -> DataFrame:
    """page_id, i, j of the lines (page_id, pos, line) that two versions have in common, in the order of both."""
    folder = folder or work_folder(old.sparkSession, "lines")
    side = lambda df, k: df.select("page_id", F.lit(-1).cast("long").alias("seg"), F.lit(k).alias("side"), F.col("pos").cast("long").alias("pos"), F.unhex(F.md5(F.col("line").cast("binary"))).alias("code"))
    lines, found, k = side(old, 0).unionByName(side(new, 1)), None, 0
    while True:
        of = Window.partitionBy("page_id", "seg", "code")
        at = lambda s: F.when(F.col("side") == s, F.col("pos"))
        met = lines.select("*", *[f(at(s)).over(of).alias(f"{n}{s}") for n, f in (("n", F.count), ("p", F.max)) for s in (0, 1)])
        met = stored(met.where("n0 > 0 AND n1 > 0"), f"{folder}/met{k}")
        once = (F.col("n0") == 1) & (F.col("n1") == 1)
        anchors = met.where(once & (F.col("side") == 0)).select("page_id", "seg", F.col("p0").alias("i"), F.col("p1").alias("j"))
        if not anchors.take(1):
            pairs = repeated_pairs(met.select(*lines.columns)) if met.take(1) else anchors.select("page_id", "i", "j")
            return pairs if found is None else found.unionByName(pairs)
        kept = stored(in_order(anchors), f"{folder}/kept{k}").select("page_id", "i", "j")
        found = kept if found is None else found.unionByName(kept)
        # a piece is named by the old side's place of the anchor that it follows
        marks = kept.select("page_id", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("pos"), F.col("i").alias("mark")) for s, c in ((0, "i"), (1, "j"))])).alias("x")).select("page_id", "x.*")
        left = met.where(~once).select(*lines.columns).unionByName(marks, allowMissingColumns=True)
        before = F.max("mark").over(Window.partitionBy("page_id", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
        cut = left.withColumn("before", before).where("mark IS NULL")
        lines, k = cut.select("page_id", F.greatest("seg", F.coalesce("before", "seg")).alias("seg"), "side", "pos", "code"), k + 1


def ordered_diff(old: DataFrame, new: DataFrame, folder: str | None = None) -> DataFrame:
    """page_id, kind, pos, line: lines (page_id, pos, line) that only one version has, in order; a moved line is removed and added."""
    folder = folder or work_folder(old.sparkSession, "lines")
    pairs = stored(common_lines(old, new, folder), f"{folder}/pairs")
    gone = lambda df, c, kind: df.hint("merge").join(pairs.select("page_id", F.col(c).alias("pos")), ["page_id", "pos"], "left_anti").select("page_id", F.lit(kind).alias("kind"), F.col("pos").cast("long").alias("pos"), "line")
    return gone(new, "j", "added").unionByName(gone(old, "i", "removed"))
