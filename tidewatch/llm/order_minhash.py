"""Near-duplicates by Order MinHash with banded alignment.

Texts become lower-case words; equal word sequences are one text from here on. A
text's k-mers (``K`` words) are labelled with their occurrence number. Each of
``SKETCHES`` hash functions picks the ``PICKS`` least labelled k-mers and keeps them in
text order (Marcais et al., 2019), with the least k-mer without labels; two texts that
agree in one such sketch are candidates. Order and labels make agreement follow edit
similarity, the plain k-mer keeps texts apart that share a line repeated many times and
nothing else. Texts of up to ``SHORT`` words have ``SHORT_SKETCHES`` more, of
``SHORT_PICKS`` single words. Short k-mers and few picks make the candidates as wide as the
link test: scattered edits of a fifth of the words leave a Jaccard similarity of 0.47
of 2-word k-mers, and agreement in one of the sketches with a probability over 0.99.

Candidates are verified by alignment of their words inside the band that
``SIMILARITY`` allows: similar means ``1 - edits / longer length >= SIMILARITY``.
Exact bounds settle most unequal pairs before: on length and, with a bit map of each
text's words, on the words that one text has and the other lacks, before texts are joined to pairs. A bit map of fixed
size says nothing of long texts, whose unlike pairs share a sketch most often; the pairs that it leaves open meet a
wide one, as large as the text needs, with a bit for each occurrence of a word.

Within a sketch's texts first each is verified against the least one, which joins
groups of copies of any size in as many pairs as they have members: in the first ``FIRST``
sketches each, in the others where the two are still in different classes. Where
texts of one sketch are then still in different classes, each meets three more of them,
of the least and of the greatest class and one by hash: classes that are linked all over become one in
as many pairs as they have members. Of what is then still apart every pair
across classes is verified that the bounds and, within the join, the words themselves (``bag``) leave open.
So no link between candidates is lost, a class never makes all its pairs, and texts that share only a passage make none.

Classes are connected components; the class id is the least ``doc_id`` in it. Texts
shorter than K words have one k-mer, all their words. Texts without words (null,
empty) are one class. Null doc_ids belong to classes but name none unless alone.
Rows repeated stay rows. An empty table gives no rows; other columns are not read.
A text's words are hashed in pieces and its sketches run over its k-mers by ``PIECE``, so
a very long text takes its bytes and some 80 bytes for each word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.components import components
from tidewatch.llm.flat import chosen, chunks, mixed, normal_words, numbered, shingles, words
from tidewatch.session import released, removed, stored, work_folder

K = 2
SKETCHES = 56
PICKS = 2
SHORT, SHORT_SKETCHES, SHORT_PICKS = 24, 24, 3
SIMILARITY = 0.8
#: Sketches whose pairs with the least text are verified first; k-mers that are ranked at once.
FIRST, PIECE = 6, 1 << 16
#: Longs in the bit map of a text's words; bits for each word of a text in its wide one, at least.
MAPS, WIDE = 8, 2


def labelled(prints: np.ndarray) -> np.ndarray:
    """Each k-mer's hash with its occurrence number, counted from the text's start."""
    order = np.argsort(prints, kind="stable")
    some = prints[order]
    first = np.ones(len(some), bool)
    first[1:] = some[1:] != some[:-1]
    start = np.flatnonzero(first)
    nth = np.arange(len(some)) - np.repeat(start, np.diff(np.append(start, len(some))))
    out = np.empty_like(prints)
    out[order] = mixed(some + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def least_places(ranks: np.ndarray, picks: int) -> np.ndarray:
    """Places of the ``picks`` least ranks of each row. Ranks are uniform, so few below a bound hold them nearly always."""
    n, size = ranks.shape
    if size > 8 * picks:
        rows, places = np.nonzero(ranks < np.uint64((1 << 64) * 3 * picks // size))
        counts = np.bincount(rows, minlength=n)
        if counts.min() >= picks:
            order = np.lexsort((ranks[rows, places], rows))
            first = np.cumsum(counts) - counts
            return places[order[first[:, None] + np.arange(picks)]]
    return np.argpartition(ranks, picks - 1, axis=1)[:, :picks] if picks < size else np.tile(np.arange(size), (n, 1))


def sketches(prints: np.ndarray, n: int = SKETCHES, picks: int = PICKS) -> np.ndarray:
    """``n`` order sketches of one text's k-mer hashes, as numbers; none without words."""
    if not len(prints):
        return np.zeros(0, np.int64)
    mers = labelled(prints)
    seeds = mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(picks))
    odd = seeds[:, None] | np.uint64(1)
    picks = min(picks, len(mers))
    plain, ranks, place = np.full(n, np.uint64(2**64 - 1)), np.zeros((n, 0), np.uint64), np.zeros((n, 0), np.int64)
    for a in range(0, len(mers), PIECE):
        np.minimum(plain, ((prints[None, a : a + PIECE] ^ seeds[:, None]) * odd).min(axis=1), out=plain)
        some = (mers[None, a : a + PIECE] ^ seeds[:, None]) * odd
        at = least_places(some, min(picks, some.shape[1]))
        ranks = np.concatenate([ranks, np.take_along_axis(some, at, axis=1)], axis=1)
        place = np.concatenate([place, at + a], axis=1)
        if ranks.shape[1] > picks:
            best = np.argpartition(ranks, picks - 1, axis=1)[:, :picks]
            ranks, place = np.take_along_axis(ranks, best, axis=1), np.take_along_axis(place, best, axis=1)
    place.sort(axis=1)
    out = seeds + plain
    for i in range(picks):
        out = mixed(out + mers[place[:, i]]) + np.uint64(i)
    return out.view(np.int64)


def all_sketches(hashes: np.ndarray, k: int = K, n: int = SKETCHES, picks: int = PICKS) -> np.ndarray:
    """A text's sketches from its words' hashes, with those of single words if it is short."""
    long = sketches(shingles(hashes, min(k, max(1, len(hashes)))), n, picks)
    return np.concatenate([long, sketches(shingles(hashes, 1), SHORT_SKETCHES, SHORT_PICKS)]) if 0 < len(hashes) <= SHORT else long


def bit_map(hashes: np.ndarray) -> np.ndarray:
    """``MAPS`` longs with a bit for each word. A bit of one text alone is a word that the other lacks, so it costs an edit."""
    bits = np.zeros(64 * MAPS, np.uint8)
    bits[(hashes >> np.uint64(20)) % np.uint64(64 * MAPS)] = 1
    return np.packbits(bits).view(np.int64)


def wide_map(hashes: np.ndarray) -> np.ndarray:
    """A bit for each word and its occurrence number, in a power of two of longs, so that a wider map folds to a narrower one."""
    size = 64
    while size < WIDE * len(hashes):
        size *= 2
    bits = np.zeros(size, np.uint8)
    bits[(labelled(hashes) >> np.uint64(20)) % np.uint64(size)] = 1
    return np.packbits(bits).view(np.int64)


def bag(hashes: np.ndarray) -> np.ndarray:
    """A number for each word with its occurrence number. Equal numbers of unequal words hide edits and never add any."""
    return (labelled(hashes) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def edits(a: list[str], b: list[str], most: int) -> int:
    """Edit distance of two word lists if at most ``most``, else ``most + 1``.

    Bit-parallel inside the band of diagonals that ``most`` edits can reach (Hyyro,
    2003): bit r of a column's words is the cell ``most`` rows above the diagonal, plus r.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    if not most or not n or not m:
        return max(n, m) if not n or not m else most + (a != b)
    where: dict[str, int] = {}
    for i, word in enumerate(a):
        where[word] = where.get(word, 0) | 1 << i
    band, top = (1 << 2 * most + 1) - 1, 1 << 2 * most
    up, down, score = band ^ ((1 << most) - 1), 0, min(n, most)
    for j, word in enumerate(b, 1):
        same = where.get(word, 0)
        same = (same << most + 1 - j if j <= most + 1 else same >> j - most - 1) & band
        zero = ((((same & up) + up) ^ up) | same | down) & band
        right, left = (down | ~(zero | up)) & band, zero & up
        if j <= n - most:
            score += not zero & top
        else:
            row = n - j + most
            score += (right >> row & 1) - (left >> row & 1) if row >= 0 else 0
        up, down = (left | ~(zero >> 1 | right)) & band, zero >> 1 & right
    return min(score, most + 1)


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    x, y = a.split(), b.split()
    most = int((1 - least) * max(len(x), len(y)) + 1e-9)
    if abs(len(x) - len(y)) > most:
        return False
    shared = sum((Counter(x) & Counter(y)).values())
    return max(len(x), len(y)) - shared <= most and edits(x, y, most) <= most


def _sketched(texts: DataFrame, k: int, n: int, picks: int) -> DataFrame:
    """node, size (words), maps (see ``bit_map``), wide (see ``wide_map``), found (sketches) of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, maps, wide, size = [], [], [], []
            for _, data, offsets in chunks(batch.column(1)):
                hashes, first = words(data, offsets)
                for a, b in zip(first[:-1], first[1:], strict=True):
                    found.append(all_sketches(hashes[a:b], k, n, picks))
                    maps.append(bit_map(hashes[a:b]))
                    wide.append(wide_map(hashes[a:b]))
                size.append(np.diff(first))
            size = np.concatenate([np.zeros(0, np.int64), *size])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(maps, longs), pa.array(wide, longs), pa.array(found, longs)], ["node", "size", "maps", "wide", "found"])

    return texts.mapInArrow(cut, "node long, size long, maps array<long>, wide array<long>, found array<long>")


def _bagged(texts: DataFrame) -> DataFrame:
    """node, words, bag (see ``bag``) of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = []
            for _, data, offsets in chunks(batch.column(1)):
                hashes, first = words(data, offsets)
                bags += [bag(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.list_(pa.int32()))], ["node", "words", "bag"])

    return texts.select("node", "words").mapInArrow(cut, "node long, words string, bag array<int>")


def _most(longer: Column, similarity: float) -> Column:
    """The edits that the limit allows to texts of which the longer one has so many words."""
    return F.floor(longer * (1 - similarity) + 1e-6)


def _as_long(a: Column, b: Column, similarity: float) -> Column:
    return F.abs(a - b) <= _most(F.greatest(a, b), similarity)


def _like(a: str, b: str, similarity: float) -> Column:
    """Whether the bounds on length and words leave it open that two texts (size and map columns of these endings) are similar."""
    most = _most(F.greatest(f"size_{a}", f"size_{b}"), similarity)
    lacks = lambda x, y: sum(F.bit_count(F.col(f"m{i}_{x}").bitwiseAND(F.bitwise_not(f"m{i}_{y}"))) for i in range(MAPS))
    return _as_long(F.col(f"size_{a}"), F.col(f"size_{b}"), similarity) & (lacks(a, b) <= most) & (lacks(b, a) <= most)


def _bags_like(a: str, b: str, similarity: float) -> Column:
    """Whether the words that the longer text has and the other lacks (size and bag columns of these endings) leave a pair open."""
    longer = F.col(f"size_{a}") >= F.col(f"size_{b}")
    x, y = F.col(f"bag_{a}"), F.col(f"bag_{b}")
    lacks = F.size(F.array_except(F.when(longer, x).otherwise(y), F.when(longer, y).otherwise(x)))
    return lacks <= _most(F.greatest(f"size_{a}", f"size_{b}"), similarity)


def _other(left: DataFrame) -> DataFrame:
    """``left`` (sketch, root, a and columns that end in _a) as the other side of its pairs."""
    return left.select(F.col("sketch").alias("sketch_b"), F.col("root").alias("root_b"), *[F.col(c).alias(c[:-1] + "b") for c in left.columns if c == "a" or c.endswith("_a")])


def _stars(left: DataFrame) -> DataFrame:
    """Three texts of each sketch, as ``_other`` names them: one of its least class, one of its greatest and one by hash."""
    row = F.struct("root", *[c for c in left.columns if c == "a" or c.endswith("_a")])
    some = left.groupBy("sketch").agg(F.min(row).alias("x"), F.max(row).alias("y"), F.min(F.struct(F.xxhash64("a").alias("by"), row.alias("row"))).alias("z"))
    return _other(some.select("sketch", F.explode(F.array_distinct(F.array("x", "y", "z.row"))).alias("row")).select("sketch", "row.*"))


def _bounds(profiles: DataFrame, end: str) -> DataFrame:
    """Node, size and map columns with names of this ending."""
    return profiles.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}"), *[F.get("maps", F.lit(i)).alias(f"m{i}_{end}") for i in range(MAPS)])


def _folded(a: Column, b: Column) -> Column:
    """The wide map ``a``, its halves laid over each other if it is wider than ``b``."""
    half = F.size(a) / F.lit(2)
    over = F.zip_with(F.slice(a, F.lit(1), half.cast("int")), F.slice(a, half.cast("int") + 1, half.cast("int")), lambda x, y: x.bitwiseOR(y))
    return F.when(F.size(a) > F.size(b), over).otherwise(a)


def wide_open(pairs: DataFrame, profiles: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that the wide maps leave open. Maps of more than twice the other's width, as a low limit allows, leave a pair open."""
    wide = lambda end: profiles.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}"), F.col("wide").alias(f"wide_{end}"))
    both = pairs.hint("merge").join(wide("a"), "a").hint("merge").join(wide("b"), "b")
    x, y = _folded(F.col("wide_a"), F.col("wide_b")), _folded(F.col("wide_b"), F.col("wide_a"))
    lacks = lambda x, y: F.aggregate(F.zip_with(x, y, lambda v, w: F.bit_count(v.bitwiseAND(F.bitwise_not(w)))), F.lit(0), lambda s, v: s + v)
    most = _most(F.greatest("size_a", "size_b"), similarity)
    return both.where((F.size(x) != F.size(y)) | (lacks(x, y) <= most) & (lacks(y, x) <= most)).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts (node, words) are similar."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [similar(x, y, similarity) for x, y in zip(batch["wa"], batch["wb"], strict=True)]
            yield batch.loc[good, ["a", "b"]]

    used = pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct()).distinct()
    some = texts.join(used.hint("shuffle_hash"), "node", "left_semi")
    left = pairs.hint("merge").join(some.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b")
    both = left.hint("merge").join(some.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a")
    dealt = both.select("a", "b", "wa", "wb").repartition("a", "b")
    return dealt.mapInPandas(keep, "a long, b long")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, k: int = K, n: int = SKETCHES, picks: int = PICKS, folder: str | None = None, row_id: str | None = None) -> DataFrame:
    """row_id, doc_id, class_id, class_size, first (one row of each class) for each row of ``docs``."""
    spark = docs.sparkSession
    folder = folder or work_folder(spark, "near")
    text = normal_words(F.col("text"))
    docs, row_id = numbered(docs, row_id)
    rows = docs.select(F.col(row_id).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("words"))
    keys = stored(rows.select("row_id", "doc_id", F.sha2(F.col("words").cast("binary"), 256).alias("digest")), f"{folder}/keys")
    nodes = stored(keys.groupBy("digest").agg(F.min("row_id").alias("node")), f"{folder}/nodes")
    chosen = rows.select(F.col("row_id").alias("node"), "words").join(nodes.select("node").hint("shuffle_hash"), "node", "left_semi")
    texts = stored(chosen, f"{folder}/texts")
    released(spark)
    profiles = stored(_sketched(texts, k, n, picks), f"{folder}/sketches")
    # sizes go with the sketches, so that texts of unequal length don't become pairs at all
    found = profiles.select(F.struct("node", "size").alias("at"), F.posexplode("found").alias("nth", "sketch"))
    heads = stored(found.groupBy("sketch").agg(F.min("at").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sketch", "head"), f"{folder}/heads")
    released(spark)
    shared = found.hint("merge").join(heads, "sketch").select("nth", "sketch", F.col("head.node").alias("head"), F.col("at.node").alias("node"), _as_long(F.col("head.size"), F.col("at.size"), similarity).alias("as_long"))
    shared = stored(shared, f"{folder}/shared")
    # sketches are read no more; only sizes and bit maps are
    profiles = stored(profiles.select("node", "size", "maps", "wide"), f"{folder}/profiles")
    removed(spark, f"{folder}/sketches", f"{folder}/heads")
    released(spark)

    def kept(df: DataFrame, name: str) -> DataFrame:
        """``df`` written; the shuffles that made it, of pairs and of texts, are let go before the next ones."""
        out = stored(df, f"{folder}/{name}")
        released(spark)
        return out

    def open_pairs(pairs: DataFrame, name: str) -> DataFrame:
        both = pairs.distinct().hint("merge").join(_bounds(profiles, "a"), "a").hint("merge").join(_bounds(profiles, "b"), "b")
        return kept(both.where(_like("a", "b", similarity)).select("a", "b"), name)

    with_root = lambda df, roots, node, root: df.hint("merge").join(roots.select(F.col("node").alias(node), F.col("root").alias(root)), node, "left").withColumn(root, F.coalesce(root, node))
    heads_of = shared.where("node <> head AND as_long").select("nth", F.col("head").alias("a"), F.col("node").alias("b"))
    first = open_pairs(heads_of.where(F.col("nth") < FIRST).select("a", "b"), "first")
    links = kept(verified(first, texts, similarity), "links1")
    roots = kept(components(links, f"{folder}/stars1"), "roots1")
    removed(spark, f"{folder}/stars1")
    # heads of the other sketches, for texts that aren't in their class yet; each of the bounds meets only those
    rest = heads_of.where(F.col("nth") >= FIRST).select("a", "b").distinct()
    rest = with_root(with_root(rest, roots, "a", "root_a"), roots, "b", "root_b").where("root_a <> root_b").select("a", "b")
    rest = open_pairs(rest.hint("merge").join(first, ["a", "b"], "left_anti"), "rest")
    rest = kept(wide_open(rest, profiles, similarity), "rest_wide")
    tried = first.unionByName(rest)
    links = kept(links.unionByName(verified(rest, texts, similarity)), "links")
    roots = components(links, f"{folder}/stars2")
    # texts of one sketch that are still apart, while one of another class is open to them; the sketch's head has met them all
    rooted = kept(with_root(shared.where("node <> head").select("sketch", "node"), roots, "node", "root"), "rooted")
    removed(spark, *[f"{folder}/{x}" for x in ("shared", "links1", "roots1", "stars2")])
    apart = rooted.groupBy("sketch").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("sketch")
    left = rooted.hint("merge").join(apart, "sketch", "left_semi")
    left = kept(left.hint("merge").join(_bounds(profiles, "a"), F.col("node") == F.col("a")).drop("node"), "left")
    removed(spark, *[f"{folder}/{x}" for x in ("rooted", "rest", "profiles")])
    open_to = (F.col("sketch") == F.col("sketch_b")) & (F.col("root") != F.col("root_b")) & _like("a", "b", similarity)
    left = kept(left.hint("merge").join(_other(left), open_to, "left_semi"), "open")
    some = left.select(F.col("a").alias("node")).distinct()
    texts = kept(_bagged(texts.join(some.hint("shuffle_hash"), "node", "left_semi")), "bags")
    removed(spark, f"{folder}/left", f"{folder}/texts")

    def untried(pairs: DataFrame, tried: DataFrame, name: str) -> DataFrame:
        each = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *[c for c in pairs.columns if c not in ("a", "b")]).distinct()
        return kept(each.hint("merge").join(tried, ["a", "b"], "left_anti"), name)

    # three of each sketch meet the others; a class takes the name of the least one it is found linked with
    stars = left.hint("merge").join(_stars(left), open_to).select("a", "b", F.least("root", "root_b").alias("root"), F.greatest("root", "root_b").alias("other"))
    stars = untried(stars, tried, "stars")
    star_links = kept(verified(stars.select("a", "b"), texts, similarity), "star_links")
    met = stars.hint("merge").join(star_links, ["a", "b"])
    names = met.groupBy(F.col("other").alias("root")).agg(F.min("root").alias("name"))
    left = left.hint("merge").join(names, "root", "left").withColumn("root", F.coalesce("name", "root")).drop("name")
    # then all pairs across classes that the bounds and the words themselves leave open
    left = kept(left.hint("merge").join(texts.select("node", F.col("bag").alias("bag_a")), F.col("a") == F.col("node")).drop("node"), "bagged")
    removed(spark, f"{folder}/open")
    across = (F.col("sketch") == F.col("sketch_b")) & (F.col("root") < F.col("root_b")) & _like("a", "b", similarity) & _bags_like("a", "b", similarity)
    pairs = untried(left.hint("merge").join(_other(left), across).select("a", "b"), tried.unionByName(stars.select("a", "b")), "second")
    removed(spark, *[f"{folder}/{x}" for x in ("bagged", "first", "rest_wide", "stars")])
    more = kept(verified(pairs, texts, similarity), "links2")
    removed(spark, f"{folder}/bags", f"{folder}/second")
    roots = components(links.unionByName(star_links).unionByName(more), f"{folder}/classes")
    classed = nodes.hint("merge").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    marked = kept(keys.hint("merge").join(classed, "digest").select("row_id", "doc_id", "root"), "marked")
    removed(spark, *[f"{folder}/{x}" for x in ("keys", "nodes", "links", "star_links", "links2", "classes")])
    # the least doc_id names the class, its least row is the one that stays; the class of a third of all rows is summed before it is dealt
    names = marked.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row_id")).alias("least"), F.count(F.lit(1)).alias("class_size"))
    return marked.hint("merge").join(names, "root").select("row_id", "doc_id", "class_id", "class_size", (F.col("row_id") == F.col("least.row_id")).alias("first"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class, columns as they were."""
    docs, row_id = numbered(docs)
    own = work_folder(docs.sparkSession, "near")
    marks = stored(near_classes(docs, row_id=row_id, **{"folder": own, **options}), work_folder(docs.sparkSession, "marks"))
    removed(docs.sparkSession, own)
    released(docs.sparkSession)
    return chosen(docs, row_id, marks.where("first"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_id")
