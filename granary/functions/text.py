"""Text analysis as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no search terms, patterns of questions out of scope, and of effective dates.
STOP_WORDS = ("a", "an", "and", "are", "be", "by", "can", "does", "for", "how", "in", "is", "it", "must", "of", "on", "or", "the", "to", "what", "when", "which", "with")
OUT_OF_SCOPE = (
    r"\b(?:tax deduction|cryptocurrency|crypto)\b",
    r"\bwhich stock\b|\bwhat stock\b|\bshould .*\b(?:buy|sell)\b",
    r"\b(?:employer|employment) law\b|\bviolated federal employment\b",
    r"\b(?:s&p|sp500|market)\b.*\b(?:close|price|next|predict)\b",
    r"\b(?:legal opinion|legal advice|complies with every)\b",
    r"\b(?:current|latest)\b.*\b(?:sec|cybersecurity|deadline)\b",
)
EFFECTIVE = r"\beff\.\s+([A-Z][a-z]{2,8}\.?)\s+(\d{1,2}),\s+(\d{4})"


def tokens(text: Column) -> Column:
    """Runs of characters that are no ASCII white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))


def terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def query_terms(question: Column) -> Column:
    """A question's distinct search terms, in order."""
    return F.array_distinct(F.filter(terms(question), lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS)))


def search_terms(question: Column) -> Column:
    """query_terms; a question without any that is a single word stands for itself, one of several words has none."""
    raw = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    alone = F.when(raw.rlike("^[a-z0-9]+$"), F.array(raw)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(query_terms(question)) > 0, query_terms(question)).otherwise(alone)


def out_of_scope(question: Column) -> Column:
    found = F.lit(False)
    for pattern in OUT_OF_SCOPE:
        found = found | F.coalesce(question, F.lit("")).rlike(f"(?iud){pattern}")
    return found


def effective_date(text: Column) -> Column:
    """The date of the first `eff. Month day, year`; null if there is none or its month has no such name."""
    part = lambda i: F.regexp_extract(text, EFFECTIVE, i)
    plain = F.concat_ws(" ", F.rtrim(part(1), F.lit(".")), part(2), part(3))
    return F.coalesce(F.try_to_date(plain, "MMM d yyyy"), F.try_to_date(plain, "MMMM d yyyy"))


def unreadable_date(text: Column) -> Column:
    """Whether text has an `eff. Month day, year` whose month has no such name, or whose day doesn't exist."""
    return F.coalesce(text.rlike(EFFECTIVE), F.lit(False)) & effective_date(text).isNull()


def effective_evidence(text: Column) -> Column:
    """The sentence, between full stops with a space, that holds the first `eff. Month day, year`; null if there is none."""
    at, found = F.regexp_instr(text, F.lit(EFFECTIVE)), F.regexp_extract(text, EFFECTIVE, 0)
    before = F.substring_index(F.substring(text, F.lit(1), at - 1), ". ", -1)
    rest = F.substring(text, at + F.length(found), F.length(text))
    after = F.concat(F.substring_index(rest, ". ", 1), F.when(F.contains(rest, F.lit(". ")), ".").otherwise(""))
    return F.when(at > 0, F.concat(before, found, after))
