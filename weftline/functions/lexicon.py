"""Caption lexicon: weighted substring signals as Column expressions.

Matching is by substring on the lower-cased caption, never by word, and blanks inside a term count.
Of several matching terms the first in list order is reported.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

# The term lists.
CONTEXT = ("outfit", "street style", "streetwear", "wearing", "dressed in", "dressed up", "ootd", "lookbook", "fashion week", "fashion show", "fashion photo", "fashion blog", "fashion model", "fashion style", "fashion look", "street fashion", "style outfit", "runway")
GARMENT = ("dress", "shirt", "blouse", "jacket", "blazer", "coat", "overcoat", "sweater", "hoodie", "cardigan", "pants", "trousers", "jeans", "skirt", "shorts", "shoes", "boots", "sneakers", "heels", "sandals", "suit", "tuxedo", "gown", "romper", "jumpsuit", "vest", "scarf", "hat")
PERSON = ("woman", "women", "man ", "men ", "lady", "girl", "boy", "model", "stylish", "posing", "portrait", "wearing", "wears", "wore", "dressed", "casual", "elegant", "chic")
STRONG = ("outfit", "ootd", "what i wore", "fashion week", "fashion show", "runway", "street style", "street fashion", "lookbook", "fashion model")
MEDIUM = ("fashion photo", "fashion blog", "fashion style", "fashion look", "style outfit", "streetwear", "dressed in", "dressed up")
PENALTY = ("half-dressed", "half dressed", "undress", "search result", "google", "catalog", "catalogue", "buy now", "shop now", "add to cart", "free shipping", "price", "discount", "coupon", "wholesale", "bulk order", "amazon", "ebay", "aliexpress", "alibaba")
#: A starting list only: a deployment passes its own through ``Lexicon(exclusion=read_terms(path))``.
EXCLUSION = (
    "baby", "infant", "toddler", "child", "kids", " son ", "daughter", "underwear", "lingerie", "bikini", "swimsuit", "nude", "naked",
    "cartoon", "illustration", "anime", "sketch", "vector", "logo", "screenshot", "plush", "doll", "figurine", "toys", "coating", "chemical",
    "seizure", "circuit", "wiring", "harness", "cable", "resin", "surgical", "medical", "clinical", "patient", "hospital", "nurse", "icu",
    "mannequin", "necklace", "jewelry", "decor", "supplies", "furniture", "mattress", "sofa", "renovati", "camper", "engine", "motor",
    "recipe", "ceremony", "royal family", "red carpet", "theater", "ballet", "cosplay", "halloween", "superhero", "protest", "rally", "police",
    "arrest", "injur", "shooting", "fire department", "rescue", "flood", "election", "president", "reporter", "prison", "military", "soldier",
    "soccer", "football", "stadium", "dog ", "cat ", "horse", "puppy", "animal",
)
PROXY_AXES = {
    "colorful_proxy": ("colorful", "bright", "vibrant", "neon", "multicolor", "rainbow", "bold color"),
    "formal_proxy": ("formal", "suit", "blazer", "tie", "business", "office", "elegant", "tuxedo"),
    "minimal_proxy": ("minimal", "simple", "clean", "basic", "understated", "plain", "monochrome"),
    "outdoor_proxy": ("outdoor", "hiking", "nature", "park", "garden", "beach", "mountain", "trail"),
}
MODES = {"broad": 0.5, "strict": 1.5, "outfit": 2.5}
STRONG_SCORE, MEDIUM_SCORE, WEARING_SCORE, GARMENT_SCORE, PERSON_SCORE, BOTH_SCORE, PENALTY_SCORE = 3.0, 2.0, 1.5, 1.0, 1.0, 0.5, -1.5


def read_terms(path: str) -> tuple[str, ...]:
    """One term a line; blanks at either end belong to it."""
    return tuple(x for x in Path(path).read_text(encoding="utf-8").split("\n") if x)


@dataclass(frozen=True)
class Lexicon:
    """The term lists that score and filter captions."""

    context: tuple[str, ...] = CONTEXT
    garment: tuple[str, ...] = GARMENT
    person: tuple[str, ...] = PERSON
    strong: tuple[str, ...] = STRONG
    medium: tuple[str, ...] = MEDIUM
    penalty: tuple[str, ...] = PENALTY
    exclusion: tuple[str, ...] = field(default=EXCLUSION)


DEFAULT = Lexicon()


def contains_any(text: Column, terms: tuple[str, ...]) -> Column:
    """One expression over a constant array, so long lists keep the plan small."""
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def first_match(text: Column, terms: tuple[str, ...]) -> Column:
    """The first matching term in list order, or null; later terms aren't looked for."""
    out = F
    for t in terms:
        out = out.when(F.contains(text, F.lit(t)), F.lit(t))
    return F.lit(None).cast("string") if out is F else out


def count_matches(text: Column, terms: tuple[str, ...]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t)))


def score_caption(caption: Column, lexicon: Lexicon = DEFAULT, low: Column | None = None) -> Column:
    """``struct<score, signals, excluded, excluded_term>``; -Infinity for empty or excluded captions.

    ``low``: a column that holds the lower-cased caption already; inside the lambdas below, an expression
    would be evaluated for every term."""
    low = F.lower(caption) if low is None else low
    term = first_match(low, lexicon.exclusion)
    context = F.when(contains_any(low, lexicon.strong), F.struct(F.lit("strong_outfit").alias("k"), F.lit(STRONG_SCORE).alias("v"))).when(contains_any(low, lexicon.medium), F.struct(F.lit("medium_context").alias("k"), F.lit(MEDIUM_SCORE).alias("v"))).when(F.contains(low, F.lit("wearing")), F.struct(F.lit("wearing").alias("k"), F.lit(WEARING_SCORE).alias("v")))
    garment, person = contains_any(low, lexicon.garment), contains_any(low, lexicon.person)
    penalties = count_matches(low, lexicon.penalty)
    parts = F.array(
        context,
        F.when(garment, F.struct(F.lit("garment").alias("k"), F.lit(GARMENT_SCORE).alias("v"))),
        F.when(person, F.struct(F.lit("person").alias("k"), F.lit(PERSON_SCORE).alias("v"))),
        F.when(garment & person, F.struct(F.lit("combo").alias("k"), F.lit(BOTH_SCORE).alias("v"))),
        F.when(penalties > 0, F.struct(F.lit("penalty").alias("k"), (penalties * PENALTY_SCORE).alias("v"))),
    )
    found = F.filter(parts, lambda p: p.isNotNull())
    none = F.lit(float("-inf"))
    single = lambda name: F.map_from_arrays(F.array(F.lit(name)), F.array(none))
    empty = caption.isNull() | (caption == "")
    return F.struct(
        F.when(empty | term.isNotNull(), none).otherwise(F.aggregate(found, F.lit(0.0), lambda a, p: a + p.v)).alias("score"),
        F.when(empty, single("empty")).when(term.isNotNull(), single("excluded")).otherwise(F.map_from_entries(found)).alias("signals"),
        (~empty & term.isNotNull()).alias("excluded"),
        F.when(~empty, term).alias("excluded_term"),
    )


def filter_caption(caption: Column, lexicon: Lexicon = DEFAULT, strict: bool = False, min_score: float | None = None, low: Column | None = None) -> Column:
    """``struct<accepted, reason, matched_term>``: by tiers, or by score where ``min_score`` is given; ``low`` as
    in ``score_caption``."""
    low = F.lower(caption) if low is None else low
    term = first_match(low, lexicon.exclusion)
    result = lambda ok, reason, t: F.struct(F.lit(ok).alias("accepted"), F.lit(reason).alias("reason"), t.cast("string").alias("matched_term"))
    out = F.when(caption.isNull() | (caption == ""), result(False, "empty", F.lit(None))).when(term.isNotNull(), result(False, "excluded", term))
    if min_score is not None:
        score = score_caption(caption, lexicon, low).score
        shown = F.format_string("score=%.1f", score)
        return out.when(score >= min_score, result(True, "accepted", shown)).otherwise(result(False, "below_score_threshold", F.concat(shown, F.lit(f"<{min_score}"))))
    context, garment = first_match(low, lexicon.context), first_match(low, lexicon.garment)
    person = contains_any(low, lexicon.person)
    if strict:
        out = out.when(context.isNotNull() & ~person, result(False, "no_person_context", context))
    return out.when(context.isNotNull(), result(True, "accepted", context)).when(person & garment.isNotNull(), result(True, "accepted", garment)).otherwise(result(False, "no_fashion_signal", F.lit(None)))


def resolve_min_score(mode: str | None = None, min_score: float | None = None) -> float | None:
    """An explicit score wins over a mode; neither means tiers."""
    return min_score if min_score is not None else MODES[mode] if mode else None


def proxy_flags(caption: Column) -> dict[str, Column]:
    """1.0 or 0.0 per keyword axis; a null caption counts as empty."""
    low = F.lower(F.coalesce(caption, F.lit("")))
    return {name: contains_any(low, terms).cast("double") for name, terms in PROXY_AXES.items()}


def _capitalised(text: Column) -> Column:
    """Upper case for the first letter alone, lower case for the rest."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 20)))


def _bare(axis: Column) -> Column:
    """Without its suffixes."""
    return F.regexp_replace(F.regexp_replace(axis, "_proxy$", ""), "_score$", "")


def axis_name(axis: Column) -> Column:
    """An axis as a heading, both sides of it."""
    return _capitalised(F.replace(_bare(F.lower(axis)), F.lit("_"), F.lit(" ")))


def axis_label(axis: Column, score: Column) -> Column:
    """A side's name for ``a_vs_b`` by the sign of the score; else the name without its suffix."""
    low = F.lower(axis)
    sides = F.split(low, "_vs_", 2)
    plain = _bare(low)
    name = F.when(F.contains(low, F.lit("_vs_")), F.when(score >= 0, F.get(sides, 0)).otherwise(F.get(sides, 1))).otherwise(plain)
    return _capitalised(F.replace(name, F.lit("_"), F.lit(" ")))
