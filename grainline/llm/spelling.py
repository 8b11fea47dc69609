"""Spelling variants: words one edit apart by an even-partition pigeonhole join (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, lower_ascii, settle

#: A run of letters; part of the contract.
LETTERS = "[A-Za-zÀ-ÿ]+"
#: One in so many runs of a document loses a letter; part of the contract.
SLIP = 31
SHORTEST, RAREST = 7, 2
#: A form is so many times as frequent as its variant.
RATIO = 10
#: Words that share a key are compared; a key of more is refined by what they don't share.
HOT = 32


def observed(run: Column, doc_id: Column) -> Column:
    """A lower-cased run as it is counted: where SLIP divides the CRC-32 of ``<doc_id>:<run>``, a letter is left out."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % SLIP == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + F.lit(2), F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """``word, n`` of all words of at least ``shortest`` letters and ``rarest`` occurrences; counts are summed before they are shuffled."""
    runs = docs.select(F.col(id_col).alias("_id"), F.explode(F.regexp_extract_all(lower_ascii(F.col(text_col)), F.lit(f"({LETTERS})"), F.lit(1))).alias("_run"))
    words = runs.filter(F.length("_run") >= shortest).select(observed(F.col("_run"), F.col("_id")).alias("word"))
    return words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= rarest)


def _halves(entries: DataFrame) -> DataFrame:
    """Each entry refined twice: by the first and by the second segment of what its words needn't share yet (``rest``).

    The indexed rest has ``size`` letters, cut at half of them. One edit changes one
    of the two segments, so the other is found: the first at the start of a rest of
    the same or one more letter, the second at its end, shifted by the extra letter.
    """
    half, length = F.floor(F.col("size") / 2).cast("int"), F.length("rest")
    tail = F.col("size") - half
    return entries.select(
        "word", "n", "longer",
        F.explode(F.array(
            F.struct(F.concat_ws(":", "key", F.lit("1"), F.substring("rest", F.lit(1), half)).alias("key"), F.substring("rest", half + F.lit(1), length).alias("rest"), tail.alias("size")),
            F.struct(F.concat_ws(":", "key", F.lit("2"), F.substring("rest", length - tail + F.lit(1), tail)).alias("key"), F.substring("rest", F.lit(1), length - tail).alias("rest"), half.alias("size")),
        )).alias("_half"),
    ).select("word", "n", "longer", "_half.*")


def near_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """Distinct pairs ``a, n_a, b, n_b`` of words (word, n) which one inserted, deleted or replaced letter parts.

    Every word is indexed under its two segments, and probes those of words as long
    and one shorter. A key of at most ``hot`` indexed words makes candidates; those of a
    hotter key go on to the segments of what they don't share yet, until that is a
    single letter, where at most the alphabet shares a key. So no word meets all those of
    a frequent beginning, and none is left out. Candidates are verified where
    they are made, on what they don't share, and then deduplicated, so that only
    true pairs are shuffled.
    """
    length = F.length("word")
    lengths = F.explode(F.array(F.struct(F.lit(False).alias("longer"), length.alias("size")), F.struct(F.lit(True).alias("longer"), (length - 1).alias("size"))))
    entries = words.select("word", "n", F.col("word").alias("rest"), lengths.alias("_as")).select("word", "n", "rest", "_as.*", F.col("_as.size").cast("string").alias("key"))
    found, stores = None, []
    while True:
        stored = Stored(_halves(entries))
        stores.append(stored)
        level = stored.df
        # what shares all but one letter can't be refined, and needn't
        hotter = settle(level.filter(~F.col("longer") & (F.col("size") > 1)).groupBy("key").agg(F.count("*").alias("_n")).filter(F.col("_n") > hot).select("key"))
        index = level.filter(~F.col("longer")).join(hotter, "key", "left_anti").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("rest").alias("rest_a"))
        probes = level.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("n_b"), "rest")
        met = index.join(probes, "key").filter(F.col("longer") | (F.col("a") < F.col("b"))).filter(F.levenshtein("rest_a", "rest", 1) == 1)
        pairs = settle(met.select("a", "n_a", "b", "n_b"))
        found = pairs if found is None else found.union(pairs)
        if hotter.isEmpty():
            break
        entries = level.join(hotter, "key", "left_semi")
    for stored in stores:
        stored.drop()
    return found.distinct()


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """``word, root`` for ``word, form``: forms followed to the last, in as many doublings as chains of ``longest`` links need."""
    found = settle(forms.select("word", F.col("form").alias("root")))
    for _ in range(max(0, math.ceil(math.log2(max(1, longest))))):
        further = found.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        found = settle(found.join(further, "root", "left").select("word", F.coalesce("_further", "root").alias("root")))
    return found


def variants(words: DataFrame, ratio: int = RATIO, hot: int = HOT) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a table of distinct words with their counts ``word, n``.

    A word's form is the most frequent of its near words (of equals, the first in
    code-point order) if that is ``ratio`` times as frequent. Forms are ever more frequent,
    so chains have at most as many links as the greatest count has digits.
    """
    pairs = near_pairs(words.select("word", "n"), hot)
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("m")).union(pairs.select("b", "n_b", "a", "n_a"))
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("near").alias("near")))
    counts = both.groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("_n"), best.alias("_best"))
    formed = -F.col("_best.m") >= ratio * F.col("_n")
    counts = settle(counts.select("word", "n_near", F.when(formed, F.col("_best.near")).alias("form"), F.when(formed, -F.col("_best.m")).alias("form_n")))
    most = words.agg(F.max("n")).first()[0] or 1
    last = roots(counts.filter("form IS NOT NULL").select("word", "form"), math.ceil(math.log(max(most, ratio), ratio)))
    whole = words.select("word", "n").join(counts, "word", "left").join(last, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of all documents with the more frequent word each is a variant of.

    Null and empty texts have no words; a null doc_id reads 'null' where letters are
    left out. Runs and texts of any length are taken whole. Repeated rows count each;
    of near words with equal counts the smallest is the form. An empty table gives no
    rows; other columns, of any name, aren't looked at. The vocabulary is written once;
    links and words never meet in the driver.
    """
    counted = Stored(word_counts(docs, id_col, text_col))
    found = settle(variants(counted.df))
    counted.drop()
    return found
