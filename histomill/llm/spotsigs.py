"""Document fingerprints from spot signatures.

A signature is an anchor with the ``CHAIN`` content words that follow it, anchors between them being
skipped (fewer only at the text's end). Anchors are common words of several languages, all words
of one or two letters, and the starts of lines and sentences, so texts in other languages have
signatures too; signs of scripts without spaces are words of their own. A document's
fingerprint is its set of signatures. Likeness is the Jaccard similarity of two sets.

``near_duplicates`` compares sets without comparing all: sets are partitioned by length (two
sets at similarity ``t`` differ in length by a factor of ``t`` at most), every set is filed
under its rarest signatures only (two sets at similarity ``t`` share one of the first
``|A| - ceil(t |A|) + 1``), and a pair is verified on the whole sets. DataFrame functions only.

Defined results: null text is empty; a text without words has the empty set; two empty sets
have likeness 1, an empty and another 0; rows are ordered by ``doc_id``, nulls first, then by a
digest of the text, then by text; repeated rows are neighbours; ids that are no whole numbers
count as null; very long texts are taken whole; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histomill.llm.common import clashless, materialise
from histomill.llm.graph import components

CHAIN = 3
SIMILARITY = 0.8
#: Rows whose texts stand in order in one task.
BUCKET_ROWS = 2_048
MOST_RANGES = 50_000

# The anchors, the most common words of several languages.
ANCHORS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "not", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch",
    "le", "la", "les", "de", "et", "à", "un", "une", "du", "dans", "est", "pour", "qui", "que", "sur", "pas", "par", "au", "avec",
    "el", "los", "las", "y", "en", "con", "por", "para", "se", "del", "al", "su", "lo", "es", "no",
    "di", "il", "che", "non", "per", "sono", "het", "een", "van", "dat", "niet", "não", "uma", "com",
    "и", "в", "не", "на", "с", "что", "как", "по", "это", "но", "из", "за", "от", "для",
    "的", "了", "是", "在", "不", "和", "有", "の", "は", "に", "を", "が", "と", "で",
)

_SIGN = r"[\u2e80-\u2fdf\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"  # no spaces between words
_START, _MARK = "\x02", "\x01"  # starts of lines and sentences, what stands before an anchor
#: Anchor and chain, found ahead of every place where a word begins, so that chains may overlap.
_PATTERN = rf"(?<= )(?={_MARK}[^ ])(?=({_MARK}[^ ]+(?:(?: {_MARK}[^ ]+)*+ [^ ]+){{1,{CHAIN}}}))"
_FIRST = -(1 << 63)


def marked(text: Column) -> Column:
    """The words of a text between single spaces, with a mark before every anchor."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, r"[.!?\n。！？]+(?=\s|$)|\n|[。！？]", f" {_START} ")
    t = F.regexp_replace(t, _SIGN, " $0 ")
    t = F.regexp_replace(t, rf"[^\p{{L}}\p{{N}}{_START}]+", " ")
    words = F.split(F.trim(F.concat(F.lit(f"{_START} "), F.trim(t))), " ")
    anchor = lambda w: (F.length(w) <= 2) & ~w.rlike(_SIGN) | w.isin(*ANCHORS)
    return F.concat(F.lit(" "), F.array_join(F.transform(words, lambda w: F.when(anchor(w), F.concat(F.lit(_MARK), w)).otherwise(w)), " "), F.lit(" "))


def signatures(text: Column) -> Column:
    """The sorted set of a text's signatures as 64-bit hashes."""
    found = F.regexp_extract_all(marked(text), F.lit(_PATTERN), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda s: F.xxhash64(F.regexp_replace(s, f" {_MARK}[^ ]+", "")))))


def digest(sigs: Column) -> Column:
    """A set of signatures as a string; equal sets give equal strings."""
    return F.concat(F.size(sigs).cast("string"), F.lit(":"), F.lower(F.hex(F.xxhash64(sigs))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of signatures."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def _range_of(key: Column, cuts: list[int]) -> Column:
    """Number of cuts up to a key, counted in two steps of about the square root of their number."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    every, coarse = F.array(*map(F.lit, cuts)), F.array(*map(F.lit, cuts[::step]))
    below = lambda edges: F.aggregate(edges, F.lit(0), lambda n, c: n + F.when(c <= key, 1).otherwise(0))
    first = F.greatest(below(coarse) - 1, F.lit(0)) * step
    return first + below(F.slice(every, first + 1, step))


def in_order(documents: DataFrame, rows_a_task: int = BUCKET_ROWS) -> DataFrame:
    """``(doc_id, text, sigs, next_text, next_sigs)``: every document beside the next by
    ``doc_id``; the last beside the first. Ids are cut into ranges at quantiles, rows without id
    at quantiles of the digest; the first row of a range is also dealt to the range before, so
    no task sees more than its range."""
    key, text = F.coalesce(F.col("doc_id").try_cast("long"), F.lit(_FIRST)), F.coalesce("text", F.lit(""))
    rows = clashless(documents, "doc_id", "text").select("doc_id", text.alias("text"), key.alias("k"), F.xxhash64(text).alias("d"))
    named, nameless = F.col("k") != _FIRST, F.col("k") == _FIRST
    n, without = rows.select("k").agg(F.count_if(named), F.count_if(nameless)).first()

    def firsts(of: DataFrame, c: str, count: int) -> list[int]:
        """The least value of every range between quantiles."""
        ranges = min(MOST_RANGES, -(-count // rows_a_task))
        cuts = sorted(set(of.agg(F.percentile_approx(c, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0])) if ranges > 1 else []
        return sorted(r.least for r in of.select(c, _range_of(F.col(c), cuts).alias("range")).groupBy("range").agg(F.min(c).alias("least")).collect()) if count else []

    ids, digests = firsts(rows.where(named), "k", n), firsts(rows.where(nameless), "d", without)
    ranges = max(1, len(ids) + len(digests))
    of_id, of_digest = _range_of(F.col("k"), ids[1:]) + len(digests), _range_of(F.col("d"), digests[1:])
    bucket = F.when(named, of_id).otherwise(of_digest)
    own = F.struct(bucket.alias("bucket"), F.lit(False).alias("guest"))
    before = F.struct(F.pmod(bucket + ranges - 1, F.lit(ranges)).alias("bucket"), F.lit(True).alias("guest"))
    is_head = F.when(named, F.col("k").isin(ids) if ids else F.lit(False)).otherwise(F.col("d").isin(digests) if digests else F.lit(False))
    dealt = rows.select("*", F.explode(F.when(is_head, F.array(own, before)).otherwise(F.array(own))).alias("to"))
    dealt = dealt.select("doc_id", "k", "d", "text", "to.*").repartition(F.col("bucket"))
    # a guest is the next range's first row; in the last range it is the first row of all
    order = Window.partitionBy("bucket").orderBy("guest", "k", "d", "text")
    told = dealt.withColumn("sigs", signatures(F.col("text")))
    return (
        told.withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_sigs", F.lead("sigs").over(order))
        .where("NOT guest")
        .select("doc_id", "text", "sigs", "next_text", "next_sigs")
    )


def fingerprint(documents: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited, sigs, edited_sigs, near_edited, near_next`` of every row; the
    edited text ends with the start of the next document."""
    rows = in_order(documents)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half))
    told = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    told = told.withColumn("edited_sigs", signatures(F.col("edited")))
    return told.select(
        "doc_id",
        "n_chars",
        "edited",
        "sigs",
        "edited_sigs",
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id`` of every row: the smallest id that chains of likeness of at least
    ``similarity`` reach."""
    sets = materialise(
        clashless(documents, "doc_id", "text").select(F.col("doc_id").try_cast("long").alias("doc_id"), signatures(F.col("text")).alias("sigs")).select(
            "doc_id", "sigs", F.xxhash64("sigs").alias("node")
        ),
        "sets",
    )
    distinct = materialise(sets.groupBy("node").agg(F.min("doc_id").alias("least"), F.any_value("sigs").alias("sigs"), F.count(F.lit(1)).alias("n")), "distinct")
    spread = distinct.select("node", F.size("sigs").alias("size"), F.explode("sigs").alias("s"))
    held = spread.groupBy("s").agg(F.count(F.lit(1)).alias("held"))
    ranked = spread.join(held.where("held > 1"), "s", "left").select("node", "size", "s", F.coalesce("held", F.lit(1)).alias("held"))
    order = Window.partitionBy("node").orderBy("held", "s")
    prefix = ranked.withColumn("r", F.row_number().over(order)).where(
        (F.col("r") <= F.col("size") - F.ceil(F.col("size") * similarity) + 1) & (F.col("held") > 1)
    )
    # lengths in steps of the similarity: like sets are at most one step apart
    step = F.floor(F.log("size") / -math.log(similarity)).cast("int")
    filed = prefix.select("node", "size", "s", step.alias("step"))
    other = filed.select("node", "size", "s", F.explode(F.array(F.col("step"), F.col("step") + 1)).alias("step"))
    pairs = (
        filed.alias("x")
        .join(other.alias("y"), (F.col("x.s") == F.col("y.s")) & (F.col("x.step") == F.col("y.step")) & (F.col("x.node") != F.col("y.node")))
        .where((F.least("x.size", "y.size") >= F.greatest("x.size", "y.size") * similarity))
        .select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"))
        .distinct()
    )
    whole = distinct.select("node", "sigs")
    links = (
        pairs.join(whole.select(F.col("node").alias("a"), F.col("sigs").alias("sa")), "a")
        .join(whole.select(F.col("node").alias("b"), F.col("sigs").alias("sb")), "b")
        .where(likeness(F.col("sa"), F.col("sb")) >= similarity)
        .select("a", "b")
    )
    labels = components(links).withColumnRenamed("label", "l")
    named = distinct.select("node", "least").join(labels, "node", "left").withColumn("l", F.coalesce("l", "node"))
    least = named.groupBy("l").agg(F.min("least").alias("class_id"))
    return sets.join(named.join(least, "l").select("node", "class_id"), "node").select("doc_id", "class_id")
