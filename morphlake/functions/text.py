"""Text functions as columns: HTML stripping, chunks, content tokens, folding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]
#: Words that carry no content.
STOP_WORDS = ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it"]


def strip_html(html: Column) -> Column:
    """Scripts, styles, comments and tags to spaces; the basic entities decoded; spaces squeezed."""
    t = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\n\r]+", " "))


def overlapping_chunks(text: Column, size: int, overlap: int) -> Column:
    """Pieces of `size` characters, each `overlap` into the one before; the last may be shorter."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(text, k * step + 1, F.lit(size)))


def strip_ending(word: Column) -> Column:
    """The word without a common ending, if enough is left."""
    cut = lambda n: F.left(word, F.length(word) - n)
    return (
        F.when((F.length(word) > 5) & (F.right(word, F.lit(3)) == "ing"), cut(3))
        .when((F.length(word) > 4) & F.right(word, F.lit(2)).isin("ed", "es", "er"), cut(2))
        .when((F.length(word) > 3) & (F.right(word, F.lit(1)) == "s"), cut(1))
        .otherwise(word)
    )


def semantic_token_set(text: Column) -> Column:
    """Distinct content tokens: lower case, no stop words, endings stripped, three letters or more."""
    words = F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0)), F.lower)
    kept = F.filter(words, lambda w: ~w.isin(STOP_WORDS))
    return F.array_distinct(F.filter(F.transform(kept, strip_ending), lambda w: F.length(w) >= 3))


def fold_letters(text: Column) -> Column:
    """j as i and v as u, lower-cased: the key a lexicon is looked up by."""
    return F.translate(F.lower(text), "jv", "iu")


def expand_ligatures(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))


def safe_text(text: Column) -> Column:
    """Without control characters, for tab-separated output."""
    return F.regexp_replace(text, r"[\x00-\x1F\x7F]+", " ")


def bounded_witness(text: Column, size: int = 180) -> Column:
    """Spaces squeezed; beyond `size` characters an ellipsis."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > size, F.concat(F.left(t, F.lit(size - 1)), F.lit("…"))).otherwise(t)
