"""Text columns: tokens, trigrams, snippets, folding and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and what they fold to (fixed values).
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
LONGEST_TOKEN = 64


def fold(text: Column) -> Column:
    return F.translate(text, FOLD_FROM, FOLD_TO)


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def identifier_parts(text: Column) -> Column:
    """An identifier with blanks between its humps and between letters and digits."""
    out = F.regexp_replace(text, r"(\p{Ll})(\p{Lu})", "$1 $2")
    out = F.regexp_replace(out, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    out = F.regexp_replace(out, r"(\p{L})(\p{N})", "$1 $2")
    return F.regexp_replace(out, r"(\p{N})(\p{L})", "$1 $2")


def code_tokens(text: Column) -> Column:
    """Tokens for code search: the parts of each run, then the run itself if it was split; folded, lower case."""
    runs = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def each(run):
        parts = F.split(identifier_parts(run), " ")
        return F.when(F.size(parts) > 1, F.concat(parts, F.array(run))).otherwise(F.array(run))

    tokens = F.flatten(F.transform(runs, each))
    return F.filter(F.transform(tokens, lambda t: F.lower(fold(t))), lambda t: F.octet_length(t) <= LONGEST_TOKEN)


def trigrams(text: Column) -> Column:
    """All three-character substrings, case preserved, in order."""
    # A zero-width match at every character; the class keeps it from starting inside a surrogate pair.
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"(?=(\P{Cs}{3}))"), F.lit(1)), F.array().cast("array<string>"))


def snippet(text: Column, most: int = 500) -> Column:
    """At most ``most`` characters, cut back to the last line end if the text is longer."""
    head = F.left(text, F.lit(most))
    return F.when(F.char_length(text) <= most, text).otherwise(F.when(F.contains(head, F.lit("\n")), F.regexp_replace(head, r"\n[^\n]*\z", "")).otherwise(head))


def occurrences(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).cast("long")


def last_segment(name: Column) -> Column:
    """What follows the last ``.`` or ``::``."""
    return F.element_at(F.split(name, r"\.|::"), -1)


def complexity(body: Column) -> Column:
    """One more than the number of branch words and operators."""
    return 1 + occurrences(F.lower(body), r"\b(?:if|elseif|for|foreach|while|case|catch|select)\b|&&|\|\|")
