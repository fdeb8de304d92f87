"""Text functions as column expressions: folds of names, fingerprints and hosts, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(c: Column) -> Column:
    """One space for each run of white space, none at either end."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fold_ascii(c: Column) -> Column:
    """Collapsed and lower-cased: the fast form of `values.folded` for text without compatibility characters."""
    return F.lower(collapse(c))


def property_name(c: Column) -> Column:
    """camelCase, kebab-case and spaced names to snake_case; blanks at the ends go first."""
    parted = F.regexp_replace(F.regexp_replace(F.trim(c), r"[\s\-]+", "_"), "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(parted, "([A-Z]+)([A-Z][a-z])", "$1_$2"))


def readable_kind(c: Column) -> Column:
    """PascalCase to lower-case words; runs of capitals stay one word, as they are."""
    spaced = F.regexp_replace(F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    words = F.transform(F.split(spaced, " "), lambda w: F.when(w.rlike("^[A-Z]{2,}[0-9]*$"), w).otherwise(F.lower(w)))
    return F.array_join(words, " ")


def copy_fingerprint(c: Column, size: int = 8) -> Column:
    """The first words in lower case; texts with none have the empty fingerprint, which matches nothing."""
    return F.array_join(F.slice(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), 1, size), " ")


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_rest(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1))


def surt(c: Column) -> Column:
    """Sort-friendly form: reversed host labels without a leading www, then `)` and the path and query."""
    host = F.regexp_replace(url_host(c), "^www[0-9]*\\.", "")
    rest = url_rest(c)
    rest = F.when(rest == "", "/").when(F.startswith(rest, F.lit("?")), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def scrubbed(c: Column, limit: int = 300) -> Column:
    """Error text without keys and addresses, cut to `limit` characters."""
    hidden = F.regexp_replace(c, r"(?i)(api[-_]?key|token|secret|password|authorization)(\s*[=:]\s*)\S+", "$1$2***")
    hidden = F.regexp_replace(hidden, r"https?://\S+", "<url>")
    return F.left(F.regexp_replace(hidden, r"\b(sk|ghp|hf|xoxb)[-_][A-Za-z0-9\-_]{8,}", "***"), F.lit(limit))


def excerpt(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(" …"))).otherwise(c)


# names as evidence of identity


def bare_name(c: Column) -> Column:
    """Punctuation to spaces, lower-cased, collapsed."""
    return fold_ascii(F.regexp_replace(c, r"[^\w\s]+", " "))


def shingles(c: Column, size: int = 3) -> Column:
    """Distinct character n-grams; a text no longer than one is its own only shingle, and an empty one has none."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - size + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(size)))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(common / F.nullif(F.size(a) + F.size(b) - common, F.lit(0)), F.lit(0.0))


def char_entropy(c: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for the empty text."""

    def of(chars: Column) -> Column:
        each = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / F.size(chars))
        return F.aggregate(each, F.lit(0.0), lambda s, p: s - p * F.log2(p))

    # the characters are a variable of the function, so that they are split off once
    return F.when(F.length(c) == 0, 0.0).otherwise(F.element_at(F.transform(F.array(F.split(c, "")), of), 1))


#: A name shorter or more uniform than this is no evidence.
MIN_NAME, MIN_ENTROPY = 6, 1.5


def informative(c: Column) -> Column:
    telling = lambda name: (F.length(name) >= MIN_NAME) & (char_entropy(name) >= MIN_ENTROPY)
    return F.element_at(F.transform(F.array(bare_name(c)), telling), 1)


def canonical_json(*columns: str) -> Column:
    """The columns as one JSON object, names sorted, null fields kept: the same text for the same values."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def content_hash(*columns: str) -> Column:
    return F.sha2(canonical_json(*columns), 256)
