"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

A seed is a mask over successive words; the words at its ``1`` places are hashed, those at its ``0``
places ignored. Seeds of the benchmark items meet the seeds of all documents; each hit names a
diagonal (document place minus item place), and the aligned words are compared around it: an item is
leaked if some ``WINDOW`` aligned words (the whole item, if shorter) agree at ``PERCENT`` of their
places or more. Between them the two masks find every window of 15 words with up to three strangers,
wherever these stand, so no such leak is missed. Items under 15 words have a mask of successive words
besides, as long as the longest run that their strangers must leave (all of an item under five words);
documents are looked up by the masks of the item lengths that occur.

The seeds of the benchmark are broadcast only up to ``BROADCAST_SEEDS`` rows, and otherwise joined by
key, where Spark splits a seed that very many places share; equal hits are combined before they are
shuffled. Hits are written to the shared folder before the documents are read again, and only documents
with a hit are aligned.

Defined cases: a null or empty text has no hit, nor has a document too short for a seed; repeated
items are reported item by item; rows of one doc_id are one document, as are rows with a null doc_id;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

BLANKS = "[\\x20\\x09-\\x0D]+"
#: The masks.
MASKS = ["111101", "1100111"]
WINDOW, PERCENT = 15, 80
BROADCAST_SEEDS = 500_000
#: Hits of at most so many rows are broadcast to the documents (about 40 bytes a row).
BROADCAST_HITS = 500_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), BLANKS), lambda w: w != "")


def run_mask(n: int) -> str:
    """Successive words that agree wherever the strangers in an item of ``n`` words stand."""
    strangers = n * (100 - PERCENT) // 100
    return "1" * -(-(n - strangers) // (strangers + 1))


def seeds(w: Column, masks: list[str], fit: dict[str, list[int]] | None = None) -> Column:
    """An array of arrays: at each place the hashes of the masks that fit there; those
    in ``fit`` are for texts of these lengths alone."""
    own = lambda m: F.size(w).isin(fit[m]) if fit and m in fit else F.lit(True)

    def at(i: Column) -> Column:
        hashes = [F.when((i + len(m) <= F.size(w)) & own(m), F.xxhash64(F.lit(k), *(F.get(w, i + j) for j, c in enumerate(m) if c == "1"))) for k, m in enumerate(masks)]
        return F.array(*hashes)

    shortest = min(map(len, masks))
    return F.when(F.size(w) >= shortest, F.transform(F.sequence(F.lit(0), F.size(w) - shortest), at)).otherwise(F.array().cast("array<array<bigint>>"))


def _seed_rows(table: DataFrame, key: str, w: str, at: str, masks: list[str], fit: dict[str, list[int]] | None = None) -> DataFrame:
    """A row per place and mask. Outer explodes: for inner ones Spark would work out the seeds twice,
    the second time in a filter on their number."""
    places = table.select(key, F.posexplode_outer(seeds(F.col(w), masks, fit)).alias(at, "hashes"))
    return places.select(key, at, F.explode_outer("hashes").alias("seed")).where("seed is not null")


def _agree(dw: Column, iw: Column, diagonal: Column) -> Column:
    """1 or 0 for each item place that the diagonal puts inside the document."""
    lo, hi = F.greatest(F.lit(0), -diagonal), F.least(F.size(iw), F.size(dw) - diagonal)
    same = lambda i: (F.get(dw, diagonal + i) == F.get(iw, i)).cast("int")
    return F.when(hi > lo, F.transform(F.sequence(lo, hi - 1), same)).otherwise(F.array().cast("array<int>"))


def find(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, matched, item_words, start_word``: the documents with leaked items, the words
    that agree on the best diagonal, and where in the document the item begins there."""
    d = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("dw"))
    i = scratch.save(items.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("iw")), "items")
    fit: dict[str, list[int]] = {}
    for (n,) in i.select(F.size("iw").alias("n")).where((F.col("n") > 0) & (F.col("n") < WINDOW)).distinct().orderBy("n").collect():
        fit.setdefault(run_mask(n), []).append(n)
    masks = [*MASKS, *fit]
    wanted = scratch.save(_seed_rows(i, "item_id", "iw", "i_at", masks, fit), "seeds")
    few = wanted.count() <= BROADCAST_SEEDS
    small = lambda t: F.broadcast(t) if few else t
    met = _seed_rows(d, "doc_id", "dw", "d_at", masks).join(small(wanted), "seed")
    hits = scratch.save(met.select("doc_id", "item_id", (F.col("d_at") - F.col("i_at")).alias("diagonal")).distinct(), "hits")
    hits = hits.withColumnRenamed("doc_id", "hit_id")
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits
    both = d.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id"))).join(small(i.withColumnRenamed("item_id", "own_id")), F.col("item_id").eqNullSafe(F.col("own_id")))
    aligned = both.select("doc_id", "item_id", "diagonal", F.size("iw").alias("item_words"), _agree(F.col("dw"), F.col("iw"), F.col("diagonal")).alias("same"))
    width = F.least(F.lit(WINDOW), F.col("item_words"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    leak = F.when(F.size("same") >= width, F.exists(F.sequence(F.lit(1), F.size("same") - width + 1), lambda k: 100 * total(F.slice("same", k, width)) >= PERCENT * width)).otherwise(False)
    leaked = aligned.where(leak).select("doc_id", "item_id", "item_words", F.struct(total(F.col("same")).alias("matched"), (-F.greatest(F.lit(0), F.col("diagonal"))).alias("back")).alias("m"))
    best = leaked.groupBy("doc_id", "item_id").agg(F.max("m").alias("m"), F.max("item_words").alias("item_words"))
    return best.select("doc_id", "item_id", F.col("m.matched").alias("matched"), "item_words", (-F.col("m.back")).alias("start_word"))
