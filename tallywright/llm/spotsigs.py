"""SpotSigs fingerprints, with DataFrame functions only.

A spot is a common word and the chain of the next two content words after it. The
set of a text's spots is its fingerprint. A few words drawn by their hash count as
common in every language. Texts without a common word take every
word as the start of a chain; texts without words are one signature of the whole
text. Sets are compared by Jaccard similarity; pairs are looked for only between
sets whose lengths allow the similarity, through the rarest signatures of each set.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.common import materialize, power_of_two, small_table
from tallywright.llm.decontaminate import NOT_WORD

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in that is was it for on with as are this be at by an or from which you have not had his "
    "der die das und ist von den mit zu sich des ein eine dem nicht auf für als auch im "
    "le la les et est une un de du que qui dans par pour sur pas au "
    "el los las y en con se del por una lo no su al es"
).split()
#: One in so many words, drawn by its hash, counts as common, so that texts of any language have some.
SAMPLED = 8
WORD = 0xFFFFFFFF


def _spots(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add a column of the distinct 32-bit signatures of a text column, ascending."""
    tokens, at, content = f"{out}_tokens", f"{out}_at", f"{out}_content"
    common = lambda w: w.isin(ANCHORS) | (F.xxhash64(w).bitwiseAND(F.lit(SAMPLED - 1)) == 0)
    split = df.withColumn(tokens, F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), NOT_WORD), lambda w: w != ""))
    placed = split.withColumn(at, F.array_compact(F.transform(tokens, lambda w, i: F.when(common(w), i)))).withColumn(content, F.filter(tokens, lambda w: ~common(w)))

    def chain(p: Column, j: Column) -> Column:  # p - j content words stand before the j-th common word
        return F.when(p - j + 1 < F.size(content), F.xxhash64(F.get(tokens, p), F.get(content, p - j), F.get(content, p - j + 1)).bitwiseAND(F.lit(WORD)))

    def run(w: Column, i: Column) -> Column:
        return F.xxhash64(w, F.get(tokens, i + 1), F.get(tokens, i + 2)).bitwiseAND(F.lit(WORD))

    spotted = placed.withColumn(out, F.array_compact(F.transform(at, chain)))
    whole = F.when(F.coalesce(F.col(text), F.lit("")) == "", F.expr("cast(array() as array<bigint>)")).otherwise(F.array(F.xxhash64(text).bitwiseAND(F.lit(WORD))))
    every = F.when(F.size(tokens) == 0, whole).otherwise(F.transform(tokens, run))
    return spotted.withColumn(out, F.array_sort(F.array_distinct(F.when(F.size(out) > 0, F.col(out)).otherwise(every)))).drop(tokens, at, content)


def signature_sets(docs: DataFrame, text: str = "text", out: str = "spots") -> DataFrame:
    """docs with a column of their spot signatures."""
    return _spots(docs, text, out)


def as_string(spots: str) -> Column:
    """A set as text: eight hex digits for each signature, ascending."""
    return F.array_join(F.transform(spots, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")), "")


def jaccard(a: str, b: str) -> Column:
    """Jaccard similarity of two sets; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def with_next(docs: DataFrame, per_bucket: int = 4000) -> DataFrame:
    """doc_id, text, next_text: the text of the next row in descending doc_id; after the last, the first.

    Rows with equal doc_ids stand in the order of a hash of their text, null doc_ids
    last. Rows are dealt into ranges of doc_id of about ``per_bucket`` rows; within a
    range the next row is a window's lead, and each range's first text, one row a
    range, is handed to the range before it.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("row_hash"))
    total = docs.count()
    ranges = power_of_two(total / per_bucket, 1, 1 << 15)
    shares = [i / ranges for i in range(1, ranges)]
    bounds = docs.where("doc_id is not null").agg(F.percentile_approx(F.col("doc_id").cast("long"), shares or [0.5], 100 * ranges).alias("b"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    cuts = sorted(set((bounds.b or []) if ranges > 1 else []))
    low, high = bounds.lo if bounds.lo is not None else 0, bounds.hi if bounds.hi is not None else 0
    # range r holds ids of (cuts[r - 1], cuts[r]]; found through slices of equal width
    width = (high - low) // (4 * ranges) + 1
    edges = [low - 1, *[c for c in cuts if low <= c < high], high]
    rows = [(part, r, edges[r] + 1, edges[r + 1]) for r in range(len(edges) - 1) for part in range((edges[r] + 1 - low) // width, (edges[r + 1] - low) // width + 1)]
    of_id = F.broadcast(small_table(spark, rows or [(0, 0, 0, 0)], "part long, bucket int, first_id long, last_id long"))  # at most five rows a range

    def bucketed(df: DataFrame) -> DataFrame:
        part = F.floor((F.col("doc_id") - low) / width) if width > 1 else F.col("doc_id") - low
        joined = df.withColumn("part", part.cast("long")).join(of_id, "part", "left").where("doc_id is null or doc_id between first_id and last_id")
        return joined.withColumn("bucket", F.coalesce("bucket", F.lit(-1))).drop("part", "first_id", "last_id")

    order = [F.col("doc_id").desc_nulls_last(), F.col("row_hash").desc()]
    within = Window.partitionBy("bucket").orderBy(*order)
    led = bucketed(base).withColumn("next_text", F.lead("text").over(within))

    slim = bucketed(base.select("doc_id", "row_hash"))
    # the first row of each range: ids descend, nulls last, so compare (has id, id, hash)
    first = slim.groupBy("bucket").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row_hash")).alias("f"))
    down = Window.orderBy(F.col("bucket").desc())
    chained = first.select("bucket", F.coalesce(F.lead("f").over(down), F.first("f").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("f"))
    firsts = chained.select(F.col("bucket").alias("of"), F.col("f.doc_id").alias("id"), F.col("f.row_hash").alias("hash"))
    texts = (
        base.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("hash")))
        .select("of", F.col("text").alias("handed"))
        .dropDuplicates(["of"])
    )
    return (
        led.join(texts, (F.col("bucket") == F.col("of")) & F.col("next_text").isNull(), "left")
        .select("doc_id", "text", F.coalesce("next_text", "handed").alias("next_text"))
    )


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last floor(n / 2) characters replaced by the first as
    many, or all, of the next document. Null texts are empty. Null doc_ids stand
    after all others, rows with equal doc_ids in the order of a hash of their text;
    repeated rows have equal fingerprints. A single row is followed by itself.
    Further columns are ignored, whatever their names. An empty table gives an
    empty result. Signatures have 32 bits, so unequal spots of one text are taken
    for one with a chance of 2 ** -32.
    """
    half = F.expr("n_chars div 2").cast("int")
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substr("next_text", F.lit(1), half))
    spotted = _spots(_spots(_spots(rows.withColumn("edited", edited), "text", "spots"), "edited", "edited_spots"), "next_text", "next_spots")
    return spotted.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string("spots").alias("fingerprint"),
        as_string("edited_spots").alias("edited_fingerprint"),
        jaccard("spots", "edited_spots").alias("near_edited"),
        jaccard("spots", "next_spots").alias("near_next"),
    )


def near_pairs(docs: DataFrame, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of documents whose signature sets are similar enough.

    pairs: a, b, similarity between representatives of equal sets (a < b); members:
    doc_id, representative. Empty sets and null doc_ids are left out. Sets are dealt
    by ranges of length within which, or between neighbours of which, the similarity
    is possible; candidates share one of the rarest signatures of each set, as many
    as the similarity leaves free to differ, and lengths prune before comparison.
    """
    sets = materialize(signature_sets(docs.select("doc_id", "text").where("doc_id is not null")).select("doc_id", "spots").where(F.size("spots") > 0), "spots")
    members = sets.select("doc_id", F.sha2(as_string("spots"), 256).alias("set")).groupBy("set").agg(F.min("doc_id").alias("representative"))
    keyed = sets.withColumn("set", F.sha2(as_string("spots"), 256))
    membership = keyed.join(members, "set").select("doc_id", "representative")
    reps = sets.join(members.select(F.col("representative").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    spread = reps.select("doc_id", F.size("spots").alias("n"), F.explode("spots").alias("spot"))
    frequency = spread.groupBy("spot").count()
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("count", "spot"))
    free = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    prefix = materialize(
        spread.join(frequency, "spot").withColumn("rank", rank).where(F.col("rank") <= free)
        .select("doc_id", "n", "spot", F.floor(F.log(F.col("n").cast("double")) / -math.log(similarity)).cast("int").alias("range")),
        "prefix",
    )
    probe = prefix.withColumn("range", F.explode(F.array(F.col("range"), F.col("range") + 1)))
    x, y = probe.alias("x"), prefix.alias("y")
    longer = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.doc_id") < F.col("y.doc_id")))
    candidates = x.join(y, (F.col("x.spot") == F.col("y.spot")) & (F.col("x.range") == F.col("y.range")) & longer & (F.col("x.n") >= F.col("y.n") * similarity - 1e-9)).select(
        F.col("x.doc_id").alias("p"), F.col("y.doc_id").alias("q")
    ).distinct()
    left, right = reps.select(F.col("doc_id").alias("p"), F.col("spots").alias("p_spots")), reps.select(F.col("doc_id").alias("q"), F.col("spots").alias("q_spots"))
    scored = candidates.join(left, "p").join(right, "q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), jaccard("p_spots", "q_spots").alias("similarity"))
    return scored.where(F.col("similarity") >= similarity - 1e-12), membership
