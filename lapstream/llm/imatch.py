"""I-Match fingerprints over randomised lexicon subsets.

Terms are runs of letters and digits in lower case, folded to ``SLOTS`` slots by hash. The
lexicon keeps the slots whose document frequency, as a share of all documents, lies in a
band; this is a band of inverse document frequency. At most (distinct terms per document)
/ (lower edge) slots can be in it, however large the corpus, and rare terms that share a
slot add a share of about (terms per document) / SLOTS whatever the size. The lexicon is
handed to the tasks as a bitmap of SLOTS bits, a bound fixed beforehand.

For each of ``SEEDS`` seeds the lexicon is thinned by half again and again. A text is
hashed on the thinnest subset that holds any of its terms: its distinct terms in it are
sorted and hashed. Short and long texts alike so meet a subset in which they have one or
two terms. Likeness of two fingerprints is the share of equal hashes.

A text without terms in the band uses all its terms; one without terms has all hashes
zero. NULL counts as empty. Equal texts have equal fingerprints. Whole texts are used.
Rows are ordered by id, NULL first, then by content. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapstream.llm.common import content_key
from lapstream.session import cut_lineage

SLOTS = 1 << 20
SEEDS = 20
#: Shares of all documents between which a term is kept.
BAND = (0.0005, 0.2)
CHUNK_DOCS = 2000
MAX_CHUNKS = 10_000
NOT_A_TERM = r"[^\p{L}\p{N}]+"


def slots(text: Column) -> Column:
    """Distinct slots of the terms of a text."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_A_TERM)
    terms = F.filter(words, lambda w: w != "")
    return F.array_distinct(F.transform(terms, lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int")))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """One row: the lexicon as an array of 64-bit words."""
    total = docs.count()
    low, high = band[0] * total, max(band[1] * total, 1)
    kept = (
        docs.select(F.explode(slots(F.col("text"))).alias("slot"))
        .groupBy("slot")
        .agg(F.count(F.lit(1)).alias("docs"))
        .filter(F.col("docs").between(low, high))
    )
    words = kept.groupBy(F.expr("slot div 64").alias("place")).agg(
        F.expr("bit_or(shiftleft(1L, slot % 64))").alias("bits")
    )
    places = docs.sparkSession.range(SLOTS // 64).select(F.col("id").alias("place"))
    filled = places.join(words, "place", "left").select("place", F.coalesce("bits", F.lit(0)).alias("bits"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "bits")))
    return cut_lineage(filled.agg(ordered.alias("l")).select(F.col("l.bits").alias("lexicon")), "imatch-lexicon")


def lowest_bit(term: Column, seed: Column) -> Column:
    """Lowest set bit of a term's hash under a seed; the higher, the thinner its subset."""
    bits = F.xxhash64(term, seed).bitwiseOR(F.lit(1 << 40))
    return bits.bitwiseAND(-bits)


def subset_hash(terms: Column, seed: Column) -> Column:
    """Hash of the terms in the thinnest subset that holds any of them."""
    thin = F.filter(terms, lambda t: F.xxhash64(t, seed).bitwiseAND(F.lit(7)) == 0)

    def in_thinnest(some: Column) -> Column:
        best = F.array_max(F.transform(some, lambda t: lowest_bit(t, seed)))
        # An array of one is how a lambda names a value it uses twice.
        left = F.transform(F.array(best), lambda b: F.filter(some, lambda t: lowest_bit(t, seed) == b))
        return F.xxhash64(F.array_sort(left[0])).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")

    some = F.transform(F.array(thin), lambda s: in_thinnest(F.when(F.size(s) > 0, s).otherwise(terms)))
    return some[0]


def fingerprint(text: Column, words: Column, seeds: int = SEEDS) -> Column:
    """Array of ``seeds`` hashes; ``words`` is the lexicon."""
    found = slots(text)

    def kept(every: Column) -> Column:
        inside = F.filter(every, lambda s: F.getbit(F.element_at(words, F.shiftright(s, 6) + 1), s % 64) == 1)
        return F.transform(F.array(inside), lambda i: F.when(F.size(i) > 0, i).otherwise(every))[0]

    terms = F.transform(F.array(found), kept)
    hashes = F.transform(
        terms,
        lambda t: F.when(
            F.size(t) > 0, F.transform(F.sequence(F.lit(1), F.lit(seeds)), lambda r: subset_hash(t, r))
        ).otherwise(F.array_repeat(F.lit(0), seeds)),
    )
    return hashes[0]


def likeness(a: Column, b: Column) -> Column:
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)
    return F.size(same) / F.size(a)


def as_text(hashes: Column) -> Column:
    """Eight hexadecimal digits per hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def with_next(rows: DataFrame, carried: list[str], chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """Rows (doc_id, tie, ...) with the ``carried`` columns of the next row as next_*.

    The order is cut into chunks at ids of the table, so a window holds one chunk. The row
    at a cut is sent to the chunk before it as well, the first row of all to the last one.
    """
    total, nulls, least = rows.agg(
        F.count(F.lit(1)), F.count(F.when(F.isnull("doc_id"), 1)), F.min("doc_id")
    ).first()
    chunks = max(1, min(MAX_CHUNKS, -(-total // chunk_docs)))
    shares = [i / chunks for i in range(1, chunks)]
    cuts: list[int] = []
    if shares and least is not None:
        cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0]))
    own = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    at_cut = F.col("doc_id").isin(cuts) if cuts else F.lit(False)
    first = F.isnull("doc_id") if nulls else F.col("doc_id") == F.lit(least)
    places = F.array(
        F.struct(own.alias("chunk"), F.lit(False).alias("guest")),
        F.when(F.coalesce(at_cut, F.lit(False)), F.struct((own - 1).alias("chunk"), F.lit(True).alias("guest"))),
        F.when(first, F.struct(F.lit(len(cuts)).alias("chunk"), F.lit(True).alias("guest"))),
    )
    spread = rows.select("*", F.explode(F.filter(places, lambda p: p.isNotNull())).alias("at"))
    # A row can be a guest of one chunk on two grounds when all rows are in it; once will do
    # for the order, as both copies carry the same columns.
    along = Window.partitionBy("at.chunk").orderBy("at.guest", F.col("doc_id").asc_nulls_first(), "tie")
    ahead = [F.lead(c).over(along).alias(f"next_{c}") for c in carried]
    return spread.select("*", *ahead).filter("not at.guest").drop("at")


def fingerprints(
    docs: DataFrame, band: tuple[float, float] = BAND, seeds: int = SEEDS, chunk_docs: int = CHUNK_DOCS
) -> DataFrame:
    """doc_id, text, edited text, both fingerprints and that of the next document.

    The edited text has the last half of its characters replaced by the first as many of
    the next document.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = lexicon(texts, band)
    marked = (
        texts.withColumn("lexicon", known.scalar())
        .select(
            "doc_id",
            content_key(F.col("text")).alias("tie"),
            "text",
            fingerprint(F.col("text"), F.col("lexicon"), seeds).alias("hashes"),
        )
    )
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.col("text").substr(F.lit(1), F.length("text") - half), F.col("next_text").substr(F.lit(1), half)
    )
    # Ids and contents alone are enough to find where the order is cut.
    paired = with_next(marked, ["text", "hashes"], chunk_docs)
    return (
        paired.withColumn("edited", edited)
        .withColumn("lexicon", known.scalar())
        .withColumn("edited_hashes", fingerprint(F.col("edited"), F.col("lexicon"), seeds))
        .select("doc_id", "text", "edited", "hashes", "edited_hashes", "next_hashes")
    )
