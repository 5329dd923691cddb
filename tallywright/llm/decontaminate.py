"""Benchmark decontamination by winnowing, with DataFrame functions only.

Fingerprints of a text are chosen k-gram hashes: of each window of ``window - k + 1``
consecutive k-grams the smallest hash, the first of equal ones. Texts that share
``window`` words in a row share the fingerprint of that span, at the same place in
it, so joining the fingerprints of documents and benchmark items misses no shared
window. Hits are then extended: every window of words around a joined fingerprint
is compared, word by word, with the items' windows.

Items of fewer words than a window are one window each. They have no winnowing
guarantee; each is looked up by its own length, as a k-gram of all its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.common import BROADCAST_ROWS, ascii_lower, discard, materialize

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of a gram's number that hold its place in the text.
PLACE_BITS = 31
#: A row with this print carries a document's number of words; prints have 33 bits.
COUNT = 1 << 40


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def _grams(hashes: str, n: int, salt: int = 0) -> Column:
    """Every run of n words: the upper bits of its hash, with its place in the lower ones.

    hashes: the array of the words' hashes. As numbers these order by hash, then place.
    """
    within = F.slice(F.col(hashes), F.lit(1), F.greatest(F.size(hashes) - (n - 1), F.lit(0)))

    def gram(h: Column, i: Column) -> Column:
        rest = [F.get(F.col(hashes), i + j) for j in range(1, n)]
        return F.xxhash64(h, *rest, F.lit(salt)).bitwiseAND(F.lit(-(1 << PLACE_BITS))).bitwiseOR(i.cast("long"))

    return F.transform(within, gram)


def _picked(grams: str, width: int) -> Column:
    """The smallest of each ``width`` consecutive grams; the first of those with equal hashes."""
    runs = F.slice(F.col(grams), F.lit(1), F.greatest(F.size(grams) - (width - 1), F.lit(0)))
    return F.array_distinct(F.transform(runs, lambda g, i: F.least(g, *[F.get(F.col(grams), i + j) for j in range(1, width)])))


def _hashed(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))


def benchmark_windows(items: DataFrame, window: int) -> DataFrame:
    """item_id, n and words of every distinct window of the items."""
    split = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(window))
    return (
        split.select("item_id", n.alias("n"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - n + 1)).alias("first"))
        .select("item_id", "n", F.slice("words", F.col("first"), F.col("n")).alias("words"))
        .distinct()
    )


def _prints_of_windows(windows: DataFrame, window: int, k: int, lengths: list[int]) -> DataFrame:
    """print, n: one fingerprint of each full window (n 0), and of each short item (its length)."""
    hashed = _hashed(windows, "n")
    parts = [
        hashed.where(F.col("n") == window)
        .select(_grams("hashes", k).alias("grams"))
        .select(F.explode(_picked("grams", window - k + 1)).alias("gram"), F.lit(0).alias("n"))
    ]
    parts += [hashed.where(F.col("n") == n).select(_grams("hashes", n, n)[0].alias("gram"), F.lit(n).alias("n")) for n in lengths]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found.select(F.shiftright("gram", PLACE_BITS).alias("print"), "n").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, k: int = 6, share: int = 20) -> DataFrame:
    """One row per document: how much of it the items' windows cover.

    docs: doc_id, text; items: item_id, text; further columns are ignored. Null
    texts have no words. Rows that repeat a doc_id with the same text give equal
    rows; rows with one doc_id and several texts are judged each by its own text.
    Items that repeat an item_id count as one item with the windows of all its
    rows; a null item_id is not counted in n_items, its windows still count as
    hits. Empty tables give no rows, or no hits.

    Returns doc_id, row_hash, n_words, n_hit, n_items, items_sha256, contaminated.
    """
    windows = materialize(
        benchmark_windows(items, window).withColumn("span", F.concat_ws(" ", "words")), "windows"
    )
    lengths = sorted(r["n"] for r in windows.where(F.col("n") < window).select("n").distinct().collect())  # at most window - 1
    prints = materialize(_prints_of_windows(windows, window, k, lengths), "prints")
    n_prints, n_windows = prints.count(), windows.count()
    prints = prints.union(docs.sparkSession.range(1).select(F.lit(COUNT), F.lit(-1)))

    base = docs.select("doc_id", "text", F.xxhash64("text").alias("row_hash"))
    words = base.select("doc_id", "row_hash", words_of(F.col("text")).alias("words"))
    grams = _hashed(words, "doc_id", "row_hash").select("*", _grams("hashes", k).alias("grams"))
    shorts = [_grams("hashes", n, n) for n in lengths]
    count = F.array(F.lit(None).cast("long"))
    chosen = grams.select("doc_id", "row_hash", "words", F.concat(_picked("grams", window - k + 1), *shorts, count).alias("grams"))
    # the words ride along only within the stage; the join keeps them for its hits. The
    # outer form keeps the optimizer from computing all grams twice for a test of size.
    # One row more for each document, with no gram, holds its number of words
    place = F.col("gram").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    exploded = chosen.select("doc_id", "row_hash", "words", F.explode_outer("grams").alias("gram")).select(
        "doc_id", "row_hash", "words", F.coalesce(F.shiftright("gram", PLACE_BITS), F.lit(COUNT)).alias("print"), F.coalesce(place, F.size("words")).alias("at")
    )
    if n_prints <= BROADCAST_ROWS:
        seeds = exploded.join(F.broadcast(prints), "print").drop("print")
    else:  # too many to broadcast: shuffle slim rows, then fetch the words of the documents hit
        met = exploded.drop("words").where(F.col("print") != COUNT).join(prints, "print").drop("print")
        counts = words.select("doc_id", "row_hash", F.lit(None).cast("array<string>").alias("words"), F.size("words").alias("at"), F.lit(-1).alias("n"))
        met = met.withColumnRenamed("doc_id", "hit_id").withColumnRenamed("row_hash", "hit_hash")
        seeds = words.join(met, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row_hash") == F.col("hit_hash"))).select("doc_id", "row_hash", "words", "at", "n").union(counts)

    # extension: every window of words around a seed, compared with the items' windows
    counts_words = F.col("n") < 0
    length = F.when(counts_words, F.col("at")).when(F.col("n") == 0, F.lit(window)).otherwise(F.col("n"))
    reach = F.when(F.col("n") == 0, F.lit(window - k)).otherwise(F.lit(0))
    first = F.when(counts_words, F.lit(-1)).otherwise(F.greatest(F.col("at") - reach, F.lit(0)))
    last = F.when(counts_words, F.lit(-1)).otherwise(F.least(F.col("at"), F.size("words") - length))
    around = seeds.select("doc_id", "row_hash", "words", length.alias("length"), F.explode_outer(F.sequence(first, last)).alias("first"))
    span = F.when(F.col("first") >= 0, F.concat_ws(" ", F.slice("words", F.greatest("first", F.lit(0)) + 1, F.col("length")))).otherwise(F.lit(""))
    candidates = around.select("doc_id", "row_hash", "first", "length", span.alias("span"))
    spans = windows.select("span").distinct()
    if n_windows <= BROADCAST_ROWS:
        spans = spans.union(docs.sparkSession.range(1).select(F.lit("")))
        met = candidates.join(F.broadcast(spans), "span", "left_semi").distinct()
    else:
        candidates = materialize(candidates, "candidates")
        met = candidates.where("first >= 0").join(spans, "span", "left_semi").union(candidates.where("first < 0").select("span", "doc_id", "row_hash", "first", "length")).distinct()
    met = materialize(met.select("doc_id", "row_hash", "first", "length", "span"), "hits")
    if n_windows > BROADCAST_ROWS:
        discard(candidates)
    hits = met.where("first >= 0")

    end = F.col("first") + F.col("length")
    earlier = Window.partitionBy("doc_id", "row_hash").orderBy("first", "length").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        hits.select("doc_id", "row_hash", "first", "length", end.alias("end"))
        .withColumn("reached", F.coalesce(F.max("end").over(earlier), F.lit(0)))
        .groupBy("doc_id", "row_hash")
        .agg(F.sum(F.greatest(F.col("end") - F.greatest("first", "reached"), F.lit(0))).alias("n_hit"))
    )
    found = (
        hits.select("doc_id", "row_hash", "span")
        .distinct()
        .join(windows.select("item_id", "span"), "span")
        .groupBy("doc_id", "row_hash")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    judged = (
        covered.alias("c")
        .join(found.alias("f"), F.col("c.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("c.row_hash") == F.col("f.row_hash")))
        .select("c.doc_id", "c.row_hash", "c.n_hit", "f.items")
    )
    n_hit = F.coalesce(F.col("j.n_hit"), F.lit(0)).cast("long")
    items_hit = F.coalesce(F.col("j.items"), F.expr("cast(array() as array<string>)"))
    counted = met.where("first < 0").select("doc_id", "row_hash", F.col("length").cast("long").alias("n_words"))
    verdicts = (
        counted.alias("d")
        .join(judged.alias("j"), F.col("d.doc_id").eqNullSafe(F.col("j.doc_id")) & (F.col("d.row_hash") == F.col("j.row_hash")), "left")
        .select(
            F.col("d.doc_id").alias("of_id"),
            F.col("d.row_hash").alias("of_hash"),
            "d.n_words",
            n_hit.alias("n_hit"),
            F.size(items_hit).cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", items_hit), 256).alias("items_sha256"),
            ((n_hit > 0) & (n_hit * share >= F.col("d.n_words"))).alias("contaminated"),
        )
    )
    # a row for each row of docs: texts are read once more, but only hashed
    each = base.select("doc_id", "row_hash").join(verdicts, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("row_hash") == F.col("of_hash")))
    return each.drop("of_id", "of_hash")
