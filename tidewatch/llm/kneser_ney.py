"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over bytes of UTF-8, of order ``ORDER``. Counts of trusted text, the
continuation counts of lower orders, discounts from counts of counts, and context
totals are aggregations and joins over n-gram tables, sharded by n-gram. Every trusted
document counts. For scoring, documents are dealt to blocks of about ``BLOCK_BYTES``. A
block asks for its distinct n-grams; what all blocks ask for is joined with the sharded tables
order by order, and each block meets the probabilities of its own n-grams only. So no
task or driver holds the model, and what is gathered grows with the documents. Only tables of
n-grams of one and two bytes, 65,536 rows at most for any input, are made by a few tasks and broadcast:
each join less is a stage less, and the driver keeps figures of every task of every stage.

Perplexity is ``exp(-mean log p)`` over a document's bytes. A few words that trusted text
doesn't have move the mean of a long document little, so its worst passage is scored too:
the largest ``-log p`` of ``PASSAGE`` bytes in a row. The limit of each score is, for each
language, the ``quantile`` of trusted documents' scores (exact, over all of them)
among documents of a like length (see ``LENGTH_CLASSES``: short texts vary more), times
``slack``; languages or lengths without trusted documents take the largest limit of
their language, or of all. These scores are held out: trusted documents are dealt to two
halves, and each half is scored by a model of the other. Documents above a limit are rejected.

Null and empty texts have no perplexity and are rejected. Null languages are a
language of their own. Documents without a label are scored like others. Repeated rows
each get their result; labels repeated for a document count once. Without any trusted
text nothing is rejected but empty texts. A very long text is scored whole, in its block. An empty table gives no rows. Columns other
than doc_id, text, lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.flat import chosen, chunks, numbered
from tidewatch.session import released, removed, stored, work_folder

ORDER = 4
#: Bytes of text in a block, and n-grams that a task gathers before it sends them.
BLOCK_BYTES = 16 << 20
LONG = 16
HELD_GRAMS = 4_000_000
QUANTILE = 0.999
SLACK = 1.0
#: Bytes of a passage.
PASSAGE = 4
#: Upper ends, in bytes, of the classes of length within which limits are taken.
LENGTH_CLASSES = (64, 256, 1024)
#: N-grams of up to so many bytes are at most ``256 ** SMALL_ORDER``; tasks that make their tables.
SMALL_ORDER, FEW_TASKS = 2, 4
_PAD = 10


def _few(table: DataFrame, n: int) -> DataFrame:
    """A table by n-grams of ``n`` bytes, in few partitions if it is bound to be small."""
    return table.coalesce(FEW_TASKS) if n <= SMALL_ORDER else table


def _met(table: DataFrame, n: int) -> DataFrame:
    """A table by n-grams of ``n`` bytes, as the other side of a join."""
    return F.broadcast(table) if n <= SMALL_ORDER else table.hint("merge")


def grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte the number that it and the ``order - 1`` bytes before it in its row make; rows begin after line ends."""
    n = len(data)
    wide = data.astype(np.int64)
    out = wide.copy()
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(1, order):
        before = np.full(n, _PAD, np.int64)
        before[back:] = wide[:-back] if n > back else wide[:0]
        before[place < back] = _PAD
        out |= before << (8 * back)
    return out


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, c: counts over the only column of ``texts``; each task sends its distinct n-grams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                new, n = np.unique(grams(data, offsets, order), return_counts=True)
                keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
                counts = np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
        for a in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 100_000]), pa.array(counts[a : a + 100_000])], ["gram", "c"])

    return texts.mapInArrow(count, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(counts: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams seen one to four times; kept in range where those are too few."""
    n1, n2, n3, n4 = (max(x, 0) for x in counts)
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 2 * y, 3 - 4 * y * n4 / n3 if n3 else 3 * y]
    return tuple(float(min(max(x, 0.1 * (k + 1)), 0.95 * (k + 1))) for k, x in enumerate(d))


def train(texts: DataFrame, folder: str, order: int = ORDER) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables by order: (gram, p) of seen n-grams, and (context, back) with the weight of the next lower order."""
    seen = {order: stored(gram_counts(texts, order), f"{folder}/counts{order}")}
    for n in range(order - 1, 0, -1):  # below the top, how many different bytes come before
        low = F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("gram")
        seen[n] = stored(_few(seen[n + 1].select(low).groupBy("gram").agg(F.count(F.lit(1)).alias("c")), n), f"{folder}/counts{n}")
    probs, backs, lower = [], [], None
    for n in range(1, order + 1):
        d1, d2, d3 = discounts(list(seen[n].agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first()))
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        rows = seen[n].select("gram", "c", F.shiftright("gram", 8).alias("context"), cut.alias("cut"))
        # a context has 256 n-grams at most, so they go with its totals instead of being joined with them
        back = rows.groupBy("context").agg(F.sum("c").alias("total"), (F.sum("cut") / F.sum("c")).alias("back"), F.collect_list(F.struct("gram", "c", "cut")).alias("seen"))
        back = stored(_few(back, n), f"{folder}/back{n}")
        rows = back.select("total", "back", F.inline("seen")).withColumn("low", F.col("gram").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)))
        own = (F.col("c") - F.col("cut")) / F.col("total")
        if lower is None:
            rows = rows.select("gram", (own + F.col("back") / 256).alias("p"))
        else:
            rows = rows.join(_met(lower.select(F.col("gram").alias("low"), F.col("p").alias("p_low")), n - 1), "low").select("gram", (own + F.col("back") * F.col("p_low")).alias("p"))
        lower = stored(rows, f"{folder}/p{n}")
        probs.append(lower)
        backs.append(back.select("context", "back"))
    return probs, backs


def resolved(grams_: DataFrame, probs: list[DataFrame], backs: list[DataFrame]) -> DataFrame:
    """gram, logp of distinct n-grams of the top order: joined with the sharded tables, longest order first.

    What an order knows is settled; the rest takes the weight of its context to the next order.
    """
    order = len(probs)
    rows = grams_.select("gram", F.lit(1.0).alias("weight"), F.lit(None).cast("double").alias("p"))
    for n in range(order, 0, -1):
        part = F.col("gram") if n == order else F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1))
        rows = rows.withColumns({"part": part, "ctx": F.shiftright(part, 8)})
        rows = rows.join(_met(probs[n - 1].select(F.col("gram").alias("part"), F.col("p").alias("p_n")), n), "part", "left")
        rows = rows.join(_met(backs[n - 1].withColumnRenamed("context", "ctx"), n - 1), "ctx", "left")
        open_ = F.col("p").isNull()
        weight = F.when(open_ & F.col("p_n").isNull(), F.col("weight") * F.coalesce("back", F.lit(1.0))).otherwise(F.col("weight"))
        rows = rows.select("gram", weight.alias("weight"), F.coalesce("p", F.col("weight") * F.col("p_n")).alias("p"))
    return rows.select("gram", F.log(F.coalesce("p", F.col("weight") / 256)).cast("float").alias("logp"))


def _wanted(docs: DataFrame, order: int) -> DataFrame:
    """block, gram: the distinct n-grams of each block of documents, already distinct within each task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for block, keys in held.items():
                for a in range(0, len(keys), 100_000):
                    some = keys[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), pa.array(some)], ["block", "gram"])

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for block in np.unique(blocks):
                some = batch.column(1).filter(pa.array(blocks == block))
                for _, data, offsets in chunks(some):
                    new = np.unique(grams(data, offsets, order))
                    size += len(new)
                    held[block] = np.union1d(held[block], new) if block in held else new
            if size > HELD_GRAMS:
                yield from sent()
                held, size = {}, 0
        yield from sent()

    return docs.mapInArrow(cut, "block long, gram long").distinct()


def _block_scores(order: int):
    """Of a block's documents and the log probabilities of its n-grams: each document's loss, worst passage and bytes."""

    def score(docs: pa.Table, model: pa.Table) -> pa.Table:
        docs, keys, logs = docs.combine_chunks(), model.column("gram").to_numpy(), model.column("logp").to_numpy()
        by = np.argsort(keys)
        keys, logs = keys[by], logs[by].astype(np.float64)
        n_rows = docs.num_rows
        loss, worst, size = np.zeros(n_rows), np.zeros(n_rows), np.zeros(n_rows, np.int64)
        for row, data, offsets in chunks(docs.column("text")):
            n = np.diff(offsets)
            size[row : row + len(n)] = n
            if not len(data):
                continue
            own, place = np.unique(grams(data, offsets, order), return_inverse=True)
            sums = np.concatenate([[0.0], np.cumsum(logs[np.searchsorted(keys, own)][place])])
            loss[row : row + len(n)] = sums[offsets[:-1]] - sums[offsets[1:]]
            # passages end at each byte and begin in its row
            first = np.maximum(np.arange(1, len(data) + 1) - PASSAGE, np.repeat(offsets[:-1], n))
            full = np.flatnonzero(n)
            worst[row + full] = np.maximum.reduceat(sums[first] - sums[1:], offsets[:-1][full])
        return pa.table({"row_id": docs.column("row_id"), "doc_id": docs.column("doc_id"), "lang": docs.column("lang"), "loss": loss, "worst": worst, "size": size})

    return score


def _block(docs: DataFrame) -> Column:
    """The number of each document's block.

    Neighbouring rows make a block, so that a task that reads them gathers for few. Rows of more than
    ``LONG`` times the mean are dealt to as many more blocks as they are longer, so a block
    holds ``LONG * BLOCK_BYTES`` at most, or one document.
    """
    n, total = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    mean = max(1, (total or 0) / max(1, n))
    span = max(1, int(BLOCK_BYTES / mean))
    parts = F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.octet_length("text"), F.lit(1)) / (LONG * mean))))).cast("long")
    return F.xxhash64(F.floor(F.col("row_id") / span), parts, F.pmod(F.xxhash64("row_id"), parts))


def _scored(docs: DataFrame, probs, backs, folder: str) -> DataFrame:
    """row_id, doc_id, lang, loss, worst, size: documents are dealt to blocks, and each block meets the probabilities of its own n-grams."""
    order = len(probs)
    blocked = docs.withColumn("block", _block(docs))
    wanted = stored(_wanted(blocked.select("block", "text"), order), f"{folder}/wanted")
    known = stored(resolved(wanted.select("gram").distinct(), probs, backs), f"{folder}/known")
    released(docs.sparkSession)
    # a common n-gram is wanted by every block: a merge join, whose large partitions Spark splits
    model = wanted.hint("merge").join(known, "gram").select("block", "gram", "logp")
    texts = blocked.select("block", "row_id", "doc_id", "lang", "text").groupBy("block")
    return texts.cogroup(model.groupBy("block")).applyInArrow(_block_scores(order), "row_id long, doc_id long, lang string, loss double, worst double, size long")


def _rows(docs: DataFrame, row_id: str) -> DataFrame:
    return docs.select(F.col(row_id).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def _good(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id").distinct()


def _trusted(rows: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """The trusted rows, with the half they are dealt to; all rows of a text are in one half."""
    rows = rows.join(_good(labels).hint("shuffle_hash"), "doc_id", "left_semi").select("row_id", "doc_id", "lang", "text")
    rows = stored(rows.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2))), f"{folder}/trusted")
    released(rows.sparkSession)
    return rows


def _scores(rows: DataFrame, texts: DataFrame, folder: str, order: int, spent: str | None = None) -> DataFrame:
    """row_id, doc_id, lang, perplexity, worst, size of ``rows`` under the model of ``texts``; ``spent`` is deleted when the model stands."""
    model = train(texts, folder, order)
    if spent:
        removed(rows.sparkSession, spent)
    released(rows.sparkSession)
    losses = stored(_scored(rows, *model, folder), f"{folder}/losses")
    removed(rows.sparkSession, f"{folder}/wanted", f"{folder}/known")
    released(rows.sparkSession)
    filled = F.col("size") > 0
    return losses.select("row_id", "doc_id", "lang", F.when(filled, F.exp(F.col("loss") / F.col("size"))).alias("perplexity"), F.when(filled, F.col("worst")).alias("worst"), "size")


def scored(docs: DataFrame, labels: DataFrame, folder: str, order: int = ORDER) -> DataFrame:
    """row_id, doc_id, lang, perplexity, worst, size for each row of ``docs``."""
    docs, row_id = numbered(docs)
    rows = _rows(docs, row_id)
    return _scores(rows, _trusted(rows, labels, folder).select("text"), folder, order)


def held_out(trusted: DataFrame, folder: str, order: int = ORDER) -> DataFrame:
    """Scores of trusted rows, each by the model of the half that it isn't in."""
    halves = []
    for k in (0, 1):
        rows = trusted.where(F.col("half") == k).select("row_id", "doc_id", "lang", "text")
        halves.append(_scores(rows, trusted.where(F.col("half") != k).select("text"), f"{folder}/half{k}", order))
    return halves[0].unionByName(halves[1])


def length_class(size):
    out = F.lit(len(LENGTH_CLASSES))
    for k in range(len(LENGTH_CLASSES) - 1, -1, -1):
        out = F.when(size <= LENGTH_CLASSES[k], k).otherwise(out)
    return out


def classified(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, folder: str | None = None, order: int = ORDER, row_id: str | None = None) -> DataFrame:
    """row_id, doc_id, lang, perplexity, threshold, kept for each row of ``docs``."""
    folder = folder or work_folder(docs.sparkSession, "kneser_ney")
    docs, row_id = numbered(docs, row_id)
    every = _rows(docs, row_id)
    trusted = _trusted(every, labels, folder)
    tried = held_out(trusted, folder, order).where("perplexity IS NOT NULL").withColumn("length_class", length_class(F.col("size")))
    # last, so that the trusted texts are gone while all texts are shuffled
    rows = _scores(every, trusted.select("text"), folder, order, spent=f"{folder}/trusted").withColumn("length_class", length_class(F.col("size")))
    # a row for each language and length: quantiles come from sharded counts of rounded values, not from one sort
    each = tried.select("lang", "length_class", F.explode(F.create_map(F.lit("mean"), F.col("perplexity"), F.lit("worst"), F.col("worst"))).alias("score", "v"))
    counted = each.groupBy("lang", "length_class", "score", F.round("v", 3).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    limits = counted.groupBy("lang", "length_class", "score").agg((F.percentile("v", F.lit(quantile), F.col("n")) * slack).alias("limit"))
    of = lambda score: F.max(F.when(F.col("score") == score, F.col("limit")))
    limits = stored(limits.groupBy("lang", "length_class").agg(of("mean").alias("limit"), of("worst").alias("worst_limit")), f"{folder}/limits")
    by_lang = limits.groupBy("lang").agg(F.max("limit").alias("lang_limit"), F.max("worst_limit").alias("lang_worst"))
    every = limits.agg(F.max("limit").alias("any_limit"), F.max("worst_limit").alias("any_worst"))
    # as many rows as languages, checked before they go to every task
    few = limits.count() <= 10_000
    table = (lambda x: F.broadcast(x)) if few else (lambda x: x.hint("merge"))
    a, b = limits.withColumnRenamed("lang", "l").withColumnRenamed("length_class", "k"), by_lang.withColumnRenamed("lang", "l2")
    out = rows.join(table(a), F.col("lang").eqNullSafe(F.col("l")) & (F.col("length_class") == F.col("k")), "left")
    out = out.join(table(b), F.col("lang").eqNullSafe(F.col("l2")), "left").join(F.broadcast(every), F.lit(True), "left")
    limit, worst_limit = F.coalesce("limit", "lang_limit", "any_limit"), F.coalesce("worst_limit", "lang_worst", "any_worst")
    kept = F.isnotnull("perplexity") & F.coalesce(F.col("perplexity") <= limit, F.lit(True)) & F.coalesce(F.col("worst") <= worst_limit, F.lit(True))
    return out.select("row_id", "doc_id", "lang", "perplexity", limit.alias("threshold"), kept.alias("kept"))


def filtered(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without rejected rows, columns as they were."""
    docs, row_id = numbered(docs)
    own = work_folder(docs.sparkSession, "kneser_ney")
    marks = stored(classified(docs, labels, row_id=row_id, **{"folder": own, **options}), work_folder(docs.sparkSession, "marks"))
    removed(docs.sparkSession, own)
    released(docs.sparkSession)
    return chosen(docs, row_id, marks.where("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return classified(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("row_id")
