"""Benchmark decontamination on a distributed positional inverted index.

Every benchmark window is looked up by its rarest terms: those that fewest windows hold, longer
ones first. Postings ``(term, document, position)`` of the whole training text are stored for
these terms. Shifted by the term's offset in the window, a posting names the place where the
window would start; the lists of a window's rarest terms are intersected on that place, and
the text at the places that all of them name is compared word by word. A window one of whose
terms has no posting cannot match and is dropped first. DataFrame functions only.

Proximity matches are places where ``share`` of a window's distinct words stand within ``length``
words and ``slop`` more on either side, in any order. As many words of a window as may be missing,
and one more, have their lists read: one of these is hit by every match, whichever words it lacks.

Defined results: null or empty text has no words and is clean; an item without words has no
window; an item shorter than a window is one window; repeated rows are judged each; a null
``doc_id`` or ``item_id`` is a value like any other (a null item id is written as ``null``); very
long texts are indexed whole; empty documents give no rows, an empty benchmark no hits; other
columns are ignored, and kept by :func:`clean_only`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histomill.llm.common import ascii_lower, clashless, join_hot, materialise, small_side

#: Fixed by the operator's contract: what separates words once A-Z are lower-cased; A-Z are
#: word characters before that.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Rarest terms by which a window is looked up.
ANCHORS = 3
#: Of these, the lists that are intersected: the shortest ones in the training text.
INTERSECTED = 2
#: Most distinct benchmark terms or windows that are broadcast; beyond it, or beyond the bytes that
#: ``small_side`` allows, joins shuffle, split at hot terms.
BROADCAST_ROWS = 500_000
#: Most documents whose keys are broadcast.
DOCUMENT_ROWS = 100_000
#: Share of a window's distinct words that a proximity match holds.
SHARE = 0.8
#: Words on either side of a window's place in which proximity matches are sought, if they are.
NEAR_SLOP = 3


def fenced_words(text: Column) -> Column:
    """The words of a text between one empty string in front and one behind; null is empty."""
    return F.split(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), SEPARATORS)


def word_list(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; null gives an empty list."""
    return F.transform(F.array_remove(fenced_words(text), ""), ascii_lower)


def folded(term: Column) -> Column:
    """Id of a term in the index. It ignores the case of all letters, so that a term's postings
    hold at least those of the exact comparison, which follows."""
    return F.xxhash64(F.lower(term))


def windows(benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """``(window_id, terms, n, items)``: each distinct run of ``length`` words of the benchmark
    with the ids (as strings, sorted) of the items that hold it."""
    items = clashless(benchmark, "item_id", "text").select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), word_list(F.col("text")).alias("w")
    )
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - length, F.lit(0)))
    return (
        items.where(F.size("w") > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, length))).alias("terms"))
        .groupBy("terms")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .select(F.xxhash64("terms").alias("window_id"), "terms", F.size("terms").alias("n"), "items")
    )


def anchored(grams: DataFrame, terms: int = ANCHORS) -> DataFrame:
    """``(window_id, anchors)``: offset and id of each window's ``terms`` rarest terms."""
    places = grams.select("window_id", F.posexplode("terms").alias("off", "t")).select("window_id", "off", F.lower("t").alias("t"))
    held = places.groupBy("t").agg(F.countDistinct("window_id").alias("held"))
    rank = F.struct("held", (-F.length("t")).alias("length"), "off", folded(F.col("t")).alias("term_id"))
    return (
        places.join(small_side(materialise(held, "held"), BROADCAST_ROWS), "t")
        .groupBy("window_id")
        .agg(F.slice(F.array_sort(F.collect_list(rank)), 1, terms).alias("r"))
        .select("window_id", F.transform("r", lambda x: F.struct(x["off"].alias("off"), x["term_id"].alias("term_id"))).alias("anchors"))
    )


def near_lists(grams: DataFrame, share: float = SHARE) -> DataFrame:
    """``(term_id, wins, vocabulary, least)``: for each list that proximity matches are sought by,
    the windows (id, words, fewest distinct words) it is read for, their words together and the
    fewest of all. It is read for a window of which it holds one of the rarest words, of which
    there is one more than may be missing."""
    places = grams.select("window_id", F.explode(F.array_distinct("terms")).alias("t"))
    held = places.groupBy("t").agg(F.count(F.lit(1)).alias("held"))
    rank = F.struct("held", (-F.length("t")).alias("length"), folded(F.col("t")).alias("term_id"), "t")
    need = F.ceil(F.size("r") * share).cast("int")
    return (
        places.join(small_side(materialise(held, "held"), BROADCAST_ROWS), "t")
        .groupBy("window_id")
        .agg(F.array_sort(F.collect_list(rank)).alias("r"))
        .select(F.struct("window_id", F.col("r.t").alias("terms"), need.alias("need")).alias("win"), F.explode(F.array_distinct(F.slice(F.col("r.term_id"), F.lit(1), F.size("r") - need + 1))).alias("term_id"))
        .groupBy("term_id")
        .agg(F.collect_list("win").alias("wins"))
        .select("term_id", "wins", F.array_distinct(F.flatten("wins.terms")).alias("vocabulary"), F.array_min("wins.need").alias("least"))
    )


def index(documents: DataFrame, anchors: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Stored postings ``(doc_id, digest, term_id, pos)`` of the anchors' terms and of ``more``
    terms, and one row a document with the term id of the empty string whose position is its
    number of words."""
    end = anchors.sparkSession.range(1).select(folded(F.lit("")).alias("term_id"))
    vocabulary = anchors.select(F.explode("anchors.term_id").alias("term_id")).unionByName(end)
    vocabulary = (vocabulary if more is None else vocabulary.unionByName(more.select("term_id"))).distinct()
    words = clashless(documents, "doc_id", "text").select(
        "doc_id",
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("digest"),
        F.posexplode(fenced_words(F.lower(F.col("text")))).alias("pos", "term"),
    )
    postings = (
        words.select("doc_id", "digest", "pos", F.xxhash64("term").alias("term_id"))
        .join(small_side(vocabulary, BROADCAST_ROWS), "term_id")
        .where((F.col("term_id") != folded(F.lit(""))) | (F.col("pos") > 0))
        .select("doc_id", "digest", "term_id", (F.col("pos") - 1).alias("pos"))
    )
    return materialise(postings, "postings")


def candidates(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(doc_id, digest, window_id, start)``: places that a window's shortest lists all name."""
    counts = postings.groupBy("term_id").agg(F.count(F.lit(1)).alias("tf"))
    lists = anchors.select("window_id", F.explode("anchors").alias("a")).select("window_id", "a.off", "a.term_id")
    ranked = (
        lists.join(counts, "term_id", "left")
        .groupBy("window_id")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("tf", F.lit(0)).alias("tf"), "off", "term_id"))).alias("r"))
        .where(F.col("r")[0]["tf"] > 0)
        .select("window_id", F.least(F.size("r"), F.lit(INTERSECTED)).alias("k"), F.explode(F.slice("r", 1, INTERSECTED)).alias("a"))
        .select("window_id", "k", "a.off", "a.term_id", "a.tf")
    )
    # a list's windows with its length, so that each term is there once
    read = ranked.groupBy("term_id").agg(F.first("tf").alias("tf"), F.collect_list(F.struct("window_id", "k", "off")).alias("wins"))
    named = (
        join_split(postings, materialise(read, "lists"), "term_id", "tf")
        .select("doc_id", "digest", "pos", F.explode("wins").alias("w"))
        .select("doc_id", "digest", "w.window_id", "w.k", (F.col("pos") - F.col("w.off")).alias("start"))
        .where("start >= 0")
    )
    places = named.groupBy("doc_id", "digest", "window_id", "start").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k"))
    return places.where(F.col("n") >= F.col("k")).select("doc_id", "digest", "window_id", "start")


def join_split(big: DataFrame, unique: DataFrame, key: str, rows: str) -> DataFrame:
    """Inner join with a stored table that has each key once: by broadcast if it is proven small,
    otherwise by a shuffle that is split at hot keys."""
    side = small_side(unique, BROADCAST_ROWS)
    return join_hot(big, unique, key, rows) if side is unique else big.join(side, key)


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.digest") == F.col(f"{b}.digest"))


def _words_at(documents: DataFrame, places: DataFrame, lowered: bool = False) -> DataFrame:
    """``(doc_id, digest, w, places)`` of the documents with places, ``w`` being fenced words; A-Z
    lower-cased at once if most words are in some place."""
    texts = clashless(documents, "doc_id", "text").select(
        "doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("digest"), "text"
    )
    wanted = small_side(places.select("doc_id", "digest"), min(BROADCAST_ROWS, DOCUMENT_ROWS)).alias("k")
    texts = texts.alias("t").join(wanted, _same("t", "k"), "left_semi")
    text = ascii_lower(F.col("t.text")) if lowered else F.col("t.text")
    return texts.join(places.alias("p"), _same("t", "p")).select("t.doc_id", "t.digest", fenced_words(text).alias("w"), "p.places")


def _lowered(words: Column | str) -> Column:
    return F.transform(words, ascii_lower)


def _items(items: str = "items") -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(items))))


def near_items(documents: DataFrame, postings: DataFrame, grams: DataFrame, lists: DataFrame, length: int, slop: int) -> DataFrame:
    """``(doc_id, digest, near_items)`` of the documents with proximity matches."""
    span = length + 2 * slop
    read = small_side(lists.select("term_id"), BROADCAST_ROWS)
    places = materialise(
        postings.join(read, "term_id").groupBy("doc_id", "digest").agg(F.collect_set(F.struct("term_id", "pos")).alias("places")), "near_places"
    )
    spots = _words_at(documents, places, True).select("doc_id", "digest", F.explode(F.transform("places", lambda x: F.struct(
        x["term_id"].alias("term_id"), F.slice("w", F.greatest(x["pos"] - span + 1, F.lit(0)) + 2, 2 * span - 1).alias("around")
    ))).alias("s")).select("doc_id", "digest", "s.term_id", "s.around")
    holds = lambda words, terms, least: F.size(F.array_intersect(words, terms)) >= least
    starts = F.sequence(F.lit(1), F.greatest(F.size("around") - span + 1, F.lit(1)))
    return (
        spots.join(small_side(lists, BROADCAST_ROWS), "term_id")
        .where(holds("around", "vocabulary", F.col("least")))
        .select("doc_id", "digest", "around", F.explode("wins").alias("win"))
        .where(holds("around", "win.terms", F.col("win.need")))
        .where(F.exists(starts, lambda i: holds(F.slice("around", i, span), "win.terms", F.col("win.need"))))
        .select("doc_id", "digest", "win.window_id")
        .distinct()
        .join(small_side(grams.select("window_id", "items"), BROADCAST_ROWS), "window_id")
        .groupBy("doc_id", "digest")
        .agg(_items().alias("near_items"))
    )


def hits(documents: DataFrame, benchmark: DataFrame, length: int = WINDOW, slop: int = 0, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """``(sizes, found)``: one row a document with its number of words and copies, and one row a
    document with matches: hit words, matching items and, for ``slop`` > 0, the items of which
    ``share`` of a window's distinct words stand within ``length`` and twice ``slop`` words."""
    grams = materialise(windows(benchmark, length), "windows")
    anchors = materialise(anchored(grams), "anchors")
    lists = materialise(near_lists(grams, share), "near_lists") if slop else None
    postings = index(documents, anchors, lists)
    end = F.col("term_id") == folded(F.lit(""))
    sizes = postings.where(end).groupBy("doc_id", "digest").agg(F.max("pos").cast("long").alias("n_words"), F.count(F.lit(1)).alias("copies"))
    places = materialise(
        candidates(postings.where(~end), anchors).groupBy("doc_id", "digest").agg(F.collect_list(F.struct("window_id", "start")).alias("places")),
        "places",
    )
    spots = (
        _words_at(documents, places)
        .select("doc_id", "digest", F.explode(F.transform("places", lambda x: F.struct(
            x["window_id"].alias("window_id"),
            x["start"].alias("start"),
            F.slice("w", x["start"] + 2, length).alias("here"),
        ))).alias("s"))
        .select("doc_id", "digest", "s.*")
    )
    exact = spots.join(small_side(grams, BROADCAST_ROWS), "window_id").where(_lowered(F.slice("here", F.lit(1), F.col("n"))) == F.col("terms"))
    words_hit = F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1))))
    found = exact.groupBy("doc_id", "digest").agg(F.size(words_hit).cast("long").alias("n_hit"), _items().alias("items"))
    if lists is None:
        return sizes, found.withColumn("near_items", F.array().cast("array<string>"))
    near = near_items(documents, postings.where(~end), grams, lists, length, slop)
    both = found.alias("e").join(near.alias("n"), _same("e", "n"), "full_outer")
    keys = [F.coalesce(f"e.{c}", f"n.{c}").alias(c) for c in ("doc_id", "digest")]
    return sizes, both.select(*keys, "n_hit", "items", "near_items")


def decontaminate(documents: DataFrame, benchmark: DataFrame, length: int = WINDOW, slop: int = 0) -> DataFrame:
    """One row a document: ``doc_id, n_words, n_hit, items, near_items, contaminated``."""
    sizes, found = hits(documents, benchmark, length, slop)
    none = F.array().cast("array<string>")
    return (
        sizes.alias("s")
        .join(found.alias("f"), F.col("s.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("s.digest") == F.col("f.digest")), "left")
        .select(
            "s.doc_id",
            F.col("s.n_words"),
            F.coalesce("f.n_hit", F.lit(0)).alias("n_hit"),
            F.coalesce("f.items", none).alias("items"),
            F.coalesce("f.near_items", none).alias("near_items"),
            F.explode(F.array_repeat(F.lit(0), F.col("s.copies").cast("int"))).alias("_copy"),
        )
        .drop("_copy")
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def clean_only(documents: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, in which no benchmark window occurs."""
    _, found = hits(documents, benchmark, length)
    leaks = materialise(found.where("n_hit > 0").select("doc_id", "digest"), "leaks")
    digest = F.xxhash64(F.coalesce(F.col("t.text"), F.lit("")))
    same = F.col("t.doc_id").eqNullSafe(F.col("f.doc_id")) & (digest == F.col("f.digest"))
    return documents.alias("t").join(small_side(leaks, BROADCAST_ROWS).alias("f"), same, "left_anti")
