"""Column functions on text: terms, scores, normal forms, hashes, polarity, references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of prohibition and of obligation in a constraint.
PROHIBITION = ("must not", "must never", "shall not", "may not", "cannot ", "can not ", "never ", "prohibit", "forbidden", "disallow", "not be allowed")
OBLIGATION = ("must ", "shall ", "always ", "required to", "is required", "are required", "has to ", "have to ")
# Markers of a negated constraint in the comparison of constraints.
NEGATION = ("must not", "shall not", "should not", "may not", "do not", "don't", "never", "prohibit", "forbid", "avoid")
# Words without content in that comparison.
STOP = (
    "must", "shall", "should", "will", "with", "that", "this", "from", "into", "have", "when", "then", "than", "them", "they", "each", "every", "always", "never", "only",
    "over", "under", "through", "directly", "avoid", "prohibited", "forbidden", "their", "there", "these", "those", "been", "being", "would", "could", "about",
)
# Words that name the kind of an entity.
GENERIC = ("service", "services", "svc", "module", "modules")


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits of three bytes or more, repeats kept."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) >= 3)


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term in lower-cased text; 0 for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return ((F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / len(term)).cast("long")


def term_frequency(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [occurrences(text, w) for w in words])


def distinct_terms(text: Column, words: list[str]) -> Column:
    """Number of the words that occur at all."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("long") for w in words])


def snippet(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def normal(text: Column) -> Column:
    """One blank between words, none at the ends (ASCII white space)."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "), "^ | $", "")


def content_hash(text: Column) -> Column:
    return F.sha2(normal(text), 256)


def tokens(text: Column) -> Column:
    """Set of blank-separated tokens of the normal form; empty for null."""
    return F.array_distinct(F.filter(F.split(normal(F.coalesce(text, F.lit(""))), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; 1 for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def polarity(text: Column) -> Column:
    """must_not, must or null, by the markers a text contains; prohibition comes first."""
    low = F.lower(text)
    has = lambda marks: reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in marks])
    return F.when(has(PROHIBITION), "must_not").when(has(OBLIGATION), "must")


def negated(text: Column) -> Column:
    """Whether a constraint forbids something, by the markers it contains; null for null."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in NEGATION])


def content_terms(text: Column) -> Column:
    """Distinct terms of more than three bytes that carry content."""
    return F.array_except(F.array_distinct(F.filter(terms(text), lambda w: F.octet_length(w) > 3)), F.array(*[F.lit(s) for s in STOP]))


def document_references(text: Column) -> Column:
    """Numbers, padded to at least four digits, of the records a text refers to by prefix and number."""
    found = F.regexp_extract_all(F.upper(text), F.lit(r"ADR[- ]*([0-9]+)"), F.lit(1))
    bare = F.transform(found, lambda n: F.regexp_replace(n, "^0+(?=[0-9])", ""))
    return F.array_distinct(F.transform(bare, lambda n: F.when(F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n)))  # lpad also cuts


def entity_tokens(name: Column) -> Column:
    """Lower-case parts of a name, cut at case changes and at signs, without generic words and plural s."""
    spaced = F.regexp_replace(name, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    parts = F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    own = F.filter(parts, lambda w: ~w.isin(*GENERIC))
    kept = F.when(F.size(own) > 0, own).otherwise(parts)
    return F.transform(kept, lambda w: F.when((F.octet_length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.regexp_replace(w, "s$", "")).otherwise(w))


def entity_key(name: Column) -> Column:
    """Key under which spellings of an entity's name meet."""
    return F.array_join(entity_tokens(name), " ")


def merged_reference(message: Column) -> Column:
    """Number of the request a merge or squash message names; '' if none (four forge forms)."""
    first = F.regexp_extract(message, r"^([^\n]*)", 1)
    forms = [r"^Merge pull request #(\d+) from ", r"\(#(\d+)\)\s*$", r"^Merged in .* \(pull request #(\d+)\)", r"See merge request [^\n]*!(\d+)"]
    found = [F.regexp_extract(first if i < 3 else message, p, 1) for i, p in enumerate(forms)]
    return F.coalesce(*[F.when(x != "", x) for x in found], F.lit(""))


def remote_owner(url: Column) -> Column:
    """owner/name of a repository's remote address, '' if it isn't one."""
    return F.regexp_replace(F.regexp_extract(url, r"^(?:git@[^:/]+:|(?:https?|ssh|git)://(?:[^@/]+@)?[^/]+/)([^/]+/[^/]+?)(?:\.git)?/?$", 1), r"\.git$", "")
