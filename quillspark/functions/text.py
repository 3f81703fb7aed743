"""Text as tokens: column functions over built-in Spark functions only.

Token arrays keep the order of first appearance and hold no duplicates unless said
otherwise. A null text gives an empty array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the search's definition for equal results.
STOPWORDS = ("a", "an", "the", "to", "of", "for", "in", "on", "at", "and", "or", "with", "by", "from", "is", "are", "be", "this", "that")
IRREGULAR = {"statuses": "status"}
UNCHANGED = ("series", "species", "news")
HEAD_BOUNDARIES = ("in", "for", "of", "on", "with", "by", "at")

_EMPTY = "array<string>"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def split_camel(text: Column) -> Column:
    """``fooBar`` to ``foo Bar``, then ``JQLQuery`` to ``JQL Query``."""
    return F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]{2,})([A-Z][a-z])", "$1 $2")


def _pieces(text: Column) -> Column:
    return F.split(text, "[^a-z0-9]+")


def _is_in(x: Column, values) -> Column:
    return x.isin(*values) if values else F.lit(False)


def raw_tokens(text: Column | str) -> Column:
    """All tokens of two characters or more, with stopwords and duplicates."""
    return F.filter(_pieces(F.lower(split_camel(_text(text)))), lambda t: F.length(t) >= 2)


def unigrams(text: Column | str) -> Column:
    """Distinct tokens of two characters or more, without stopwords."""
    return F.array_distinct(F.filter(raw_tokens(text), lambda t: ~_is_in(t, STOPWORDS)))


def phrase_tokens(text: Column | str) -> Column:
    """Tokens without camel-case splitting or stopwords; duplicates stay."""
    return F.filter(_pieces(F.lower(_text(text))), lambda t: (F.length(t) > 0) & ~_is_in(t, STOPWORDS))


def title_tokens(text: Column | str) -> Column:
    """Distinct singular tokens of a title: no camel-case splitting, stopwords and single
    letters stay."""
    return F.array_distinct(F.transform(F.filter(_pieces(F.lower(_text(text))), lambda t: t != ""), singular))


def singular(t: Column) -> Column:
    """Singular of one token. All that changes ends in s, which most tokens don't."""
    cut = lambda n: F.substring(t, F.lit(1), F.length(t) - n)
    out = F.when(~t.endswith("s") | _is_in(t, UNCHANGED) | (F.length(t) <= 3), t)
    for word, one in IRREGULAR.items():
        out = out.when(t == word, F.lit(one))
    out = out.when(t.endswith("ies"), F.concat(cut(3), F.lit("y")))
    out = out.when(t.rlike("(sses|shes|ches|xes)$"), cut(2))
    out = out.when(t.rlike("(ss|us|is)$"), t)
    return out.when(t.endswith("s"), cut(1)).otherwise(t)


def forms(tokens: Column) -> Column:
    """Tokens and their singulars, distinct."""
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.array(t, singular(t)))))


def token_set(text: Column | str) -> Column:
    return forms(unigrams(text))


def singular_tokens(text: Column | str) -> Column:
    return F.array_distinct(F.transform(unigrams(text), singular))


def joined_forms(query: Column | str) -> Column:
    """Words that split into two tokens or more, as one lower-case identifier each."""
    words = F.filter(F.split(_text(query), r"\s+"), lambda w: F.size(unigrams(w)) >= 2)
    joined = F.transform(words, lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]", ""))
    return F.array_distinct(F.filter(joined, lambda j: (F.length(j) > 3) & ~_is_in(j, STOPWORDS)))


def is_identifier(query: Column | str) -> Column:
    """One word without white space that splits into two tokens or more."""
    q = F.trim(_text(query))
    return (q != "") & ~q.rlike(r"\s") & (F.size(joined_forms(q)) > 0)


def literal_segments(path: Column | str) -> Column:
    """Path segments that aren't ``{parameters}``."""
    return F.filter(F.split(_text(path), "/"), lambda s: (s != "") & ~(s.startswith("{") & s.endswith("}")))


def path_tokens(path: Column | str, noise=()) -> Column:
    return F.filter(F.array_distinct(F.flatten(F.transform(literal_segments(path), unigrams))), lambda t: ~_is_in(t, noise))


def literal_path_tokens(path: Column | str) -> Column:
    """As ``path_tokens``, but numbers are dropped, noise and repeats stay."""
    return F.filter(F.flatten(F.transform(literal_segments(path), unigrams)), lambda t: ~t.rlike("^[0-9]+$"))


def terminal_tokens(path: Column | str) -> Column:
    """Tokens of the last literal segment, without numbers."""
    last = F.try_element_at(literal_segments(path), F.lit(-1))
    return F.when(F.size(literal_segments(path)) > 0, F.filter(unigrams(last), lambda t: ~t.rlike("^[0-9]+$"))).otherwise(F.array().cast(_EMPTY))


def without_placeholders(text: Column | str) -> Column:
    return F.regexp_replace(_text(text), r"\{[^}]*\}", " ")


def rule_tokens(query: Column | str) -> Column:
    return unigrams(without_placeholders(query))


def span_tokens(query: Column | str) -> Column:
    """Tokens for the direct-object span: stopwords and repeats stay."""
    return raw_tokens(without_placeholders(query))


def excerpt(description: Column | str, limit: int = 160) -> Column:
    """First sentence with white space collapsed, cut to ``limit``; ``-`` if empty."""
    flat = F.trim(F.regexp_replace(_text(description), r"\s+", " "))
    first = F.substring_index(flat, ". ", 1)
    cut = F.substring(F.when((first == flat) | first.endswith("."), first).otherwise(F.concat(first, F.lit("."))), 1, limit)
    return F.when(flat == "", "-").otherwise(cut)


def word_stream(text: Column | str) -> Column:
    """Lower-case words of letters and digits, in order, with repeats."""
    return F.filter(_pieces(F.lower(_text(text))), lambda t: t != "")
