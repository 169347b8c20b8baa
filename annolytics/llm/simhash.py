"""SimHash fingerprints of whole texts, and all pairs of fingerprints within a Hamming radius, in DataFrame expressions only.

Terms are lower-cased words, each weighted by its squared length, so that long rare words outweigh short common ones (a weight that
needs no pass over the corpus). Each word's 128 hash bits vote with its weight. Votes for two bits share a long (32 bits each), so 64
sums of generated code count all 128; partial sums are combined on the map side and only one row a text is shuffled.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from annolytics.llm.tables import written

BITS = 128
#: Characters of a word that count towards its weight; 256 votes a word leave room for 16 million words in a 32-bit lane.
MAX_LENGTH = 16


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, fingerprint (32 hex digits), n (rows of equal keys): one row a distinct key; keys must determine the text.

    A text without words has the fingerprint of zeros; the piece before leading white space is empty and weighs nothing. Ties between votes count as 0.
    """
    # the number of terms travels along, to tell how many equal rows there were
    words = df.select(*keys, F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+").alias("_words"))
    words = words.select(*keys, F.size("_words").alias("_n"), F.explode("_words").alias("_word"))
    length = F.least(F.length("_word"), F.lit(MAX_LENGTH)).cast("long")
    votes = words.select(*keys, "_n", F.xxhash64("_word").alias("_x"), F.xxhash64("_word", F.lit(1)).alias("_y"), (length * length).alias("_w"))
    lanes = F.lit(0x0000000100000001)
    sums = [F.sum(F.shiftrightunsigned(c, k).bitwiseAND(lanes) * F.col("_w")).alias(f"{c}{k}") for c in ("_x", "_y") for k in range(32)]
    votes = votes.groupBy(*keys, "_n").agg(*sums, F.sum("_w").alias("_total"), F.count(F.lit(1)).alias("_count"))

    def word(c: str) -> Column:
        out = F.lit(0).cast("long")
        for k in range(32):
            low, high = F.col(f"{c}{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"{c}{k}"), 32)
            out = out.bitwiseOR(F.when(2 * low > F.col("_total"), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
            out = out.bitwiseOR(F.when(2 * high > F.col("_total"), F.shiftleft(F.lit(1).cast("long"), k + 32)).otherwise(F.lit(0).cast("long")))
        return F.lower(F.lpad(F.hex(out), 16, "0"))

    return votes.select(*keys, F.concat(word("_x"), word("_y")).alias("fingerprint"), F.col("_count").cast("long").alias("_count"), "_n").select(
        *keys, "fingerprint", (F.col("_count") / F.col("_n")).cast("long").alias("n")
    )


def part(fingerprint: Column, k: int) -> Column:
    """The k-th 32 bits of a fingerprint, as a long."""
    return F.conv(F.substring(fingerprint, 8 * k + 1, 8), 16, 10).cast("long")


def distance(a: Column, b: Column) -> Column:
    out = F.lit(0)
    for k in range(BITS // 32):
        out = out + F.bit_count(part(a, k).bitwiseXOR(part(b, k)))
    return out


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1 - distance(a, b) / F.lit(float(BITS))


def within_radius(prints: DataFrame, *, radius: int, key: str = "doc_id", blocks: int | None = None) -> DataFrame:
    """All pairs of different fingerprints at most radius bits apart, exactly, between class representatives.

    prints: key, fingerprint. Permuted block tables: the fingerprint is cut into `blocks` blocks (radius + 2, at most 32, unless
    given); radius errors leave at least blocks - radius blocks untouched, so each choice of that many blocks, moved to the front,
    is a table in which any such pair agrees. Rows of equal fingerprint are one class, represented by the smallest key, so copies are
    never paired with one another. Returns left, right (fingerprints, left < right), left_id, right_id, distance. Null fingerprints
    take no part.
    """
    blocks = blocks or min(32, radius + 2)
    if not 0 <= radius < blocks <= 32:
        raise ValueError("radius must be below the number of blocks, which is 32 at most")
    digits = BITS // 4
    edges = [round(i * digits / blocks) for i in range(blocks + 1)]
    fp = F.col("fingerprint")
    classes = prints.where(fp.isNotNull()).groupBy("fingerprint").agg(F.min(key).alias("id"))
    piece = lambda i: F.substring(fp, edges[i] + 1, edges[i + 1] - edges[i])
    kept = list(combinations(range(blocks), blocks - radius))
    table = F.explode(F.array(*[F.concat(F.lit(f"{t}:"), *[piece(i) for i in c]) for t, c in enumerate(kept)]))
    slots = classes.select("id", "fingerprint", table.alias("slot"))
    a, b = slots.alias("a"), slots.alias("b")
    pairs = a.join(b, (F.col("a.slot") == F.col("b.slot")) & (F.col("a.fingerprint") < F.col("b.fingerprint")))
    pairs = pairs.select(F.col("a.fingerprint").alias("left"), F.col("b.fingerprint").alias("right"), F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"))
    return pairs.withColumn("distance", distance(F.col("left"), F.col("right"))).where(F.col("distance") <= radius).distinct()


def successors(docs: DataFrame, *, rows_a_range: int = 200_000, most_ranges: int = 1000) -> DataFrame:
    """doc_id, next_id over the distinct ids: the next smaller id, after the smallest the largest; null ids count as smallest.

    Ids are dealt into ranges at sampled quantiles, so no task sorts them all; only one row a range is ordered in one place.
    """
    ids = written(docs.select("doc_id").distinct(), "simhash-ids")
    ranges = min(most_ranges, max(8, -(-ids.count() // rows_a_range)))
    cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []))
    below = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    dealt = ids.withColumn("_range", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(len(cuts) - below))
    heads = dealt.groupBy("_range").agg(F.max("doc_id").alias("_head"))
    over = W.orderBy("_range")
    first = F.first(F.struct("_head")).over(over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    heads = heads.withColumn("_next", F.coalesce(F.lead(F.struct("_head")).over(over), first))
    inside = W.partitionBy("_range").orderBy(F.col("doc_id").desc_nulls_last())
    linked = dealt.withColumn("_in", F.lead(F.struct("doc_id")).over(inside)).join(heads, "_range")
    return linked.select("doc_id", F.when(F.col("_in").isNotNull(), F.col("_in.doc_id")).otherwise(F.col("_next._head")).alias("next_id"))


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars, next_id, edited, copies: each text with its last third replaced by the next document's beginning.

    Null text: empty. Where rows repeat an id, all of them are followed by the same next document, and the next document of the ids
    above is, of the rows with the id, the one whose text hashes lowest. copies: how often each row stands here, because that next
    document's row is itself repeated. Null ids are equal to one another and the smallest.
    """
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("~"))
    kind = docs.schema["doc_id"].dataType
    # texts travel with this key alone, so that both joins read one exchange of them
    base = docs.select(key("doc_id").alias("_key"), F.coalesce("text", F.lit("")).alias("text"))
    third = F.floor(F.length("text") / 3).cast("int")
    hashed = base.groupBy("_key", F.xxhash64("text").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.max(third).alias("third"))
    hashed = hashed.groupBy("_key").agg(F.min(F.struct("h", "n")).alias("first"), F.max("third").alias("third"))
    links = successors(docs).select(key("doc_id").alias("_asker"), key("next_id").alias("_next"), "next_id")
    links = links.join(hashed.select(F.col("_key").alias("_asker"), "third"), "_asker").join(hashed.select(F.col("_key").alias("_next"), "first"), "_next")
    links = written(links, "simhash-next")
    heads = base.join(links.withColumnRenamed("_next", "_key"), "_key").where(F.xxhash64("text") <= F.col("first.h"))  # the lowest hash; as an equality it would change the exchange
    heads = heads.select(F.col("_asker").alias("_key"), "next_id", F.expr("substring(text, 1, third)").alias("_head"), F.col("first.n").alias("copies"))
    cut = "cast(floor(length(text) / 3) as int)"
    text = F.concat(F.expr(f"substring(text, 1, length(text) - {cut})"), F.expr(f"substring(_head, 1, {cut})"))
    doc_id = F.when(F.col("_key") != "~", F.col("_key")).cast(kind).alias("doc_id")
    return base.join(heads, "_key").select(doc_id, "text", F.length("text").cast("long").alias("n_chars"), "next_id", text.alias("edited"), "copies")


def compared(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id.

    The next document is that of edited(); a lone document is its own next. Empty texts have the fingerprint of zeros.
    """
    pairs = edited(docs)
    digest = F.unhex(F.sha2(F.encode("edited", "UTF-8"), 256))
    keys = ["doc_id", "_text", "n_chars", "_digest", "next_id", "copies", "_edited"]
    rows = pairs.select("doc_id", F.xxhash64("text").alias("_text"), "n_chars", digest.alias("_digest"), "next_id", "copies", F.explode(F.array(
        F.struct(F.lit(False).alias("e"), F.col("text").alias("t")), F.struct(F.lit(True).alias("e"), F.col("edited").alias("t")))).alias("x"))
    prints = fingerprints(rows.select(*keys[:-1], F.col("x.e").alias("_edited"), F.col("x.t").alias("_t")), keys, "_t")
    one = lambda e: F.max(F.when(F.col("_edited") == e, F.col("fingerprint")))
    both = prints.groupBy(*keys[:-1]).agg(one(False).alias("fingerprint"), one(True).alias("edited_fingerprint"), F.max("n").alias("n"))
    both = written(both.withColumn("n", (F.col("n") / F.col("copies")).cast("long")), "simhash-prints")
    # as in edited(), the row of an id that stands for it to others is the one whose text hashes lowest
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("~"))
    chosen = both.groupBy(key("doc_id").alias("_next")).agg(F.min(F.struct("_text", "fingerprint")).alias("s"))
    out = both.withColumn("_next", key("next_id")).join(chosen, "_next")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return out.select(
        "doc_id", "n_chars", F.lower(F.hex("_digest")).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("s.fingerprint")).alias("near_next"), "next_id",
    )
