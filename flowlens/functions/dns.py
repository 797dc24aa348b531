"""String features of a DNS query name, all as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
BIGRAMS = {
    "th": 100, "he": 95, "in": 90, "er": 85, "an": 80, "re": 75, "ed": 70, "nd": 65, "on": 60, "en": 55, "at": 50,
    "ou": 45, "it": 40, "is": 35, "or": 30, "ti": 25, "ar": 20, "te": 18, "ng": 16, "al": 14, "se": 12, "st": 10,
    "as": 8, "to": 6, "le": 5, "co": 4, "ma": 3, "de": 2, "me": 1,
}
TRIGRAMS = {
    "the": 100, "and": 95, "ing": 90, "her": 85, "hat": 80, "his": 75, "tha": 70, "ere": 65, "for": 60, "ent": 55,
    "ion": 50, "ter": 45, "was": 40, "you": 35, "ith": 30, "ver": 25, "all": 20, "wit": 18, "thi": 16, "tio": 14,
    "com": 12, "con": 10, "pro": 8, "ser": 6,
}
BIGRAM_SHARE, TRIGRAM_SHARE, TOP_WEIGHT = 0.3, 0.7, 100
UNUSUAL_TLDS = [".tk", ".ml", ".ga", ".cf", ".gq", ".onion", ".bit"]
BASE64_RUN, HEX_RUN, REPEAT_RUN = "[a-zA-Z0-9+/]{20,}", "[0-9a-f]{16,}", r"([a-z0-9])\1{3,}"
VOWELS, LETTERS, NAME_SIGNS = "aeiou", "abcdefghijklmnopqrstuvwxyz", "0123456789.-_"
LONG_LABEL, LONG_QUERY, DEFAULT_TTL, RATIO_CAP = 20, 50, 300.0, 10.0
DNS_FEATURES = [
    "query_length", "query_entropy", "subdomain_count", "numeric_ratio", "ngram_score", "has_base64_pattern",
    "has_hex_pattern", "has_long_subdomain", "suspicious_length", "char_diversity", "vowel_consonant_ratio",
    "compressed_pattern", "unusual_tld", "avg_ttl", "min_ttl", "is_qtype_txt", "is_qtype_null", "is_nxdomain",
]
# -----------------------------------------------------------------------------


def _without(text: Column, char: Column | str) -> Column:
    return F.replace(text, F.lit(char) if isinstance(char, str) else char, F.lit(""))


def _guarded(query: Column, value: Column) -> Column:
    """Features of a missing or empty name are 0."""
    return F.when(F.length(query) > 0, value).otherwise(F.lit(0))


def entropy(query: Column) -> Column:
    """Shannon entropy in bits over the characters, case kept.

    Sorted characters form runs; with run lengths c over n characters the entropy
    is log2(n) - sum(c * log2(c)) / n.
    """
    n = F.length(query).cast("double")
    ordered = F.array_join(F.sort_array(F.split(query, "")), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1+"), F.lit(0))

    def add(total: Column, run: Column) -> Column:
        c = F.length(run).cast("double")
        return total + c * F.log2(c)

    return _guarded(query, F.log2(n) - F.aggregate(runs, F.lit(0.0), add) / n)


def numeric_ratio(query: Column) -> Column:
    digits = F.length(query) - F.length(F.translate(query, "0123456789", ""))
    return _guarded(query, digits / F.length(query))


def _by_first_letter(grams: list[str]) -> str:
    """One pattern for all grams, branching on the first letter only once."""
    tails: dict[str, list[str]] = {}
    for g in grams:
        tails.setdefault(g[0], []).append(g[1:])
    return "|".join(f"{head}(?:{'|'.join(rest)})" for head, rest in tails.items())


def _gram_total(text: Column, weights: dict[str, int]) -> Column:
    """Weighted count of the grams, overlapping matches included: one look-ahead
    pass finds the weighted grams, the few hits are then looked up."""
    size = len(next(iter(weights)))
    hits = F.regexp_extract_all(text, F.lit(f"(?=({_by_first_letter(list(weights))}))"), F.lit(1))
    table = F.create_map(*[F.lit(x) for gram, weight in weights.items() for x in (gram, weight)])
    total = F.aggregate(hits, F.lit(0), lambda acc, gram: acc + table[gram])
    return total / (F.greatest(F.length(text) - (size - 1), F.lit(1)) * TOP_WEIGHT)


def ngram_score(query: Column) -> Column:
    """Closeness to English letter pairs and triples, without the last label."""
    lowered = F.lower(query)
    last = F.substring_index(lowered, ".", -1)
    body = F.substr(lowered, F.lit(1), F.length(lowered) - F.when(F.instr(lowered, ".") > 0, F.length(last) + 1).otherwise(0))
    score = BIGRAM_SHARE * _gram_total(body, BIGRAMS) + TRIGRAM_SHARE * _gram_total(body, TRIGRAMS)
    return F.coalesce(F.least(score, F.lit(1.0)), F.lit(0.0))


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def longest_label(query: Column) -> Column:
    return F.array_max(F.transform(F.split(query, r"\."), lambda part: F.length(part)))


def char_diversity(query: Column) -> Column:
    bare = _without(F.lower(query), ".")
    return F.when(F.length(bare) > 0, F.size(F.array_distinct(F.split(bare, ""))) / F.length(bare)).otherwise(0.0)


def vowel_consonant_ratio(query: Column) -> Column:
    """Letters outside a-z are rare, so only what is left of the name after the
    usual characters were taken out goes through the letter pattern."""
    lowered = F.lower(query)
    vowels = F.length(lowered) - F.length(F.translate(lowered, VOWELS, ""))
    plain = F.translate(lowered, LETTERS, "")
    other = F.regexp_count(F.translate(plain, NAME_SIGNS, ""), F.lit(r"\p{L}"))
    consonants = F.length(lowered) - F.length(plain) + other - vowels
    return F.when(consonants > 0, F.least(vowels / consonants, F.lit(RATIO_CAP))).otherwise(0.0)


def unusual_tld(query: Column) -> Column:
    lowered, hit = F.lower(query), F.lit(False)
    for tld in UNUSUAL_TLDS:
        hit = hit | lowered.contains(tld)
    return _flag(hit)


def ttl_values(ttls: Column) -> Column:
    """The comma list as numbers; null when empty or any element is unreadable."""
    parts = F.filter(F.transform(F.split(ttls, ","), lambda x: F.trim(x)), lambda x: ~x.isin("", "-"))
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    return F.when((F.size(numbers) > 0) & ~F.exists(numbers, lambda x: x.isNull()), numbers)


def avg_ttl(ttls: Column) -> Column:
    v = ttl_values(ttls)
    return F.coalesce(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v), F.lit(DEFAULT_TTL))


def min_ttl(ttls: Column) -> Column:
    return F.coalesce(F.array_min(ttl_values(ttls)), F.lit(DEFAULT_TTL))


def _is(name: str, word: str) -> Column:
    return _flag(F.upper(F.col(name)) == word)


def dns_columns(query: str = "query", ttls: str = "TTLs") -> dict[str, Column]:
    q, t = F.col(query), F.col(ttls)
    lowered = F.lower(q)
    return {
        "query_length": F.coalesce(F.length(q), F.lit(0)),
        "query_entropy": entropy(q),
        "subdomain_count": F.coalesce(F.length(q) - F.length(_without(q, ".")), F.lit(0)),
        "numeric_ratio": numeric_ratio(q),
        "ngram_score": ngram_score(q),
        "has_base64_pattern": _flag(lowered.rlike(BASE64_RUN)),
        "has_hex_pattern": _flag(lowered.rlike(HEX_RUN)),
        "has_long_subdomain": _flag(longest_label(q) > LONG_LABEL),
        "suspicious_length": _flag(F.length(q) > LONG_QUERY),
        "char_diversity": char_diversity(q),
        "vowel_consonant_ratio": vowel_consonant_ratio(q),
        "compressed_pattern": _flag(lowered.rlike(REPEAT_RUN)),
        "unusual_tld": unusual_tld(q),
        "avg_ttl": avg_ttl(t),
        "min_ttl": min_ttl(t),
        "is_qtype_txt": _is("qtype_name", "TXT"),
        "is_qtype_null": _is("qtype_name", "NULL"),
        "is_nxdomain": _is("rcode_name", "NXDOMAIN"),
    }


def dns_features(df: DataFrame, *, query: str = "query") -> DataFrame:
    """The 18 features in one projection; missing inputs count as ``-``."""
    needed = [query, "qtype_name", "rcode_name", "TTLs"]
    df = df.withColumns({c: F.lit("-") for c in needed if c not in df.columns})
    return df.withColumns(dns_columns(query))
