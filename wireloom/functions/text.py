"""Column helpers for strings, vocabularies and small per-row arrays (all native expressions)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

from . import vocab as V


# fixed values: the white space characters of the text rules (the explicit class is far cheaper than a Unicode flag)
BLANK = r"[ \t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def lit_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(col: Column, body) -> Column:
    """``body(col)`` with ``col`` evaluated once, also inside a lambda where common sub-expressions are not shared."""
    return F.get(F.transform(F.array(col), body), 0)


def strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^{BLANK}+|{BLANK}+$", "")


def squeeze(col: Column) -> Column:
    """Collapse every run of white space to one blank and strip the ends."""
    return F.trim(F.regexp_replace(col, f"{BLANK}+", " "))


def squeezed_lower(col: Column) -> Column:
    return F.lower(squeeze(F.coalesce(col, F.lit(""))))


def has_any(text: Column, words: Iterable[str]) -> Column:
    """Substring test against a word list: one alternation, so the plan stays in generated code."""
    return text.rlike("|".join(r"\Q" + w + r"\E" for w in words))


def words_found(text: Column, words: Iterable[str]) -> Column:
    """Sorted array of the listed words that occur in the text."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in sorted(set(words))]))


def first_family(text: Column, families, default: str) -> Column:
    """Name of the first family with a word in the text."""
    out = None
    for name, words in families:
        cond = has_any(text, words)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(default)


def families_found(text: Column, families) -> Column:
    """Names of every family with a word in the text, in list order."""
    return F.array_compact(F.array(*[F.when(has_any(text, words), F.lit(name)) for name, words in families]))


def lookup(col: Column, table: Mapping) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), col)


def key_form(col: Column) -> Column:
    return F.translate(F.lower(strip(F.coalesce(col, F.lit("")))), "- ", "__")


def normalize_vocab(col: Column, values: Iterable[str], aliases: Mapping[str, str] | None = None) -> Column:
    """Vocabulary member in key form, or null when unknown."""
    values = tuple(values)
    table = {**{k: v for k, v in (aliases or {}).items() if v in values}, **{v: v for v in values}}
    return lookup(key_form(col), table)


def normalize_value(col: Column) -> Column:
    """Free value with placeholders dropped."""
    return let(squeeze(col), lambda c: F.when((c != "") & ~F.lower(c).isin(*V.PLACEHOLDERS), c))


def distinct_by(arr: Column, key) -> Column:
    """Items whose key has not occurred before, in input order."""
    return let(arr, lambda a: let(F.transform(a, key), lambda keys: F.filter(
        a, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)))


def first_wins(arr: Column) -> Column:
    """Distinct ignoring case, the first spelling stays; empty and null items drop out."""
    return distinct_by(F.filter(arr, lambda x: x.isNotNull() & (x != "")), F.lower)


def sort_by_lower(arr: Column) -> Column:
    keyed = F.array_sort(F.transform(arr, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v"))))
    return F.transform(keyed, lambda s: s["v"])


def canon_list(arr: Column) -> Column:
    """Squeezed, distinct ignoring case, sorted by lower form."""
    return sort_by_lower(first_wins(F.transform(arr, squeeze)))


def canon_tickers(arr: Column) -> Column:
    cleaned = F.transform(arr, lambda x: F.regexp_replace(F.upper(squeeze(x)), r"[^A-Z0-9.\-]", ""))
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda x: x != "")))


def canon_country(col: Column) -> Column:
    def named(clean: Column) -> Column:
        title = F.when((clean == F.lower(clean)) & (clean != F.upper(clean)), F.initcap(clean)).otherwise(clean)
        return F.coalesce(lookup(F.lower(clean), V.COUNTRY_ALIASES), title)

    return let(squeeze(col), named)


def canon_countries(arr: Column) -> Column:
    return sort_by_lower(first_wins(F.transform(arr, canon_country)))


def canon_name(col: Column) -> Column:
    """Placeholders become the empty string; only all-upper names are re-cased, token by token."""

    def recase(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda tok: (
            F.when(tok.isin(*V.ACRONYMS), tok)
            .when(F.lower(tok).isin(*V.SMALL_WORDS), F.lower(tok))
            .when((F.size(parts) == 1) & (F.length(tok) <= 4), tok)
            .otherwise(F.concat(F.upper(F.substring(tok, 1, 1)), F.lower(F.substring(tok, 2, 10_000)))))), " ")

    def named(clean: Column) -> Column:
        all_upper = (clean == F.upper(clean)) & (clean != F.lower(clean))
        return (
            F.when(F.lower(clean).isin(*V.PLACEHOLDERS), F.lit(""))
            .when(all_upper, let(F.split(clean, " "), recase))
            .otherwise(clean))

    return let(squeeze(col), named)


def canon_names(arr: Column) -> Column:
    return sort_by_lower(first_wins(F.transform(arr, canon_name)))


def org_family(col: Column) -> Column:
    return let(F.lower(canon_name(col)), lambda low: (
        F.when(low.isin(*V.KNOWN_COMPANIES), "companies")
        .when(has_any(low, V.INSTITUTION_MARKERS), "organizations")
        .otherwise("companies")))


def safe_token(col: Column) -> Column:
    """Lower token for hash inputs; separators are replaced and an empty value becomes the missing mark."""
    return let(squeezed_lower(col), lambda low: F.when(low == "", F.lit(V.MISSING)).otherwise(F.translate(low, "|=", "/-")))


def tokens(arr: Column, limit: int | None = None) -> Column:
    """Sorted distinct lower tokens with separators replaced."""
    low = F.transform(arr, lambda x: F.translate(F.lower(squeeze(x)), "|=", "/-"))
    out = F.array_sort(F.array_distinct(F.filter(low, lambda x: x.isNotNull() & (x != ""))))
    return F.slice(out, 1, limit) if limit else out


def joined(arr: Column) -> Column:
    return let(arr, lambda a: F.when(F.size(a) == 0, F.lit(V.MISSING)).otherwise(F.array_join(a, ",")))


def lowered_set(arr: Column) -> Column:
    """Distinct stripped lower values, empties dropped."""
    return F.array_distinct(F.filter(F.transform(arr, lambda x: F.lower(strip(x))), lambda x: x.isNotNull() & (x != "")))


def entity_signature(countries: Column, orgs: Column, people: Column) -> Column:
    """Typed entity tokens of one claim."""
    typed = lambda kind, arr: F.transform(lowered_set(arr), lambda x: F.concat(F.lit(kind + ":"), x))
    parts = [typed("country", countries), typed("org", orgs), typed("person", people)]
    return F.array_sort(F.concat(*parts))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(overlap(a, b) / union)


def word_tokens(col: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def compare_key(col: Column) -> Column:
    """Summary key: case folded, punctuation dropped, blanks squeezed."""
    return squeeze(F.regexp_replace(squeezed_lower(col), r"(?U)[^\w\s]", ""))


def preview(col: Column, limit: int = 320) -> Column:
    return F.when(F.length(col) > limit, F.concat(F.substring(col, 1, limit - 3), F.lit("..."))).otherwise(col)


def normalize_message(col: Column) -> Column:
    """Bulletin text clean-up in the fixed order of the rules."""
    text = squeeze(F.coalesce(col, F.lit("")))
    for pattern in (V.LEADING_MARKER_PATTERN, V.DATELINE_PATTERN, V.AGENCY_SUFFIX_PATTERN):
        text = F.regexp_replace(text, pattern, "")
    return squeeze(F.regexp_replace(text, V.REPEATED_PUNCT_PATTERN, "$1"))


def half_even_int(col: Column) -> Column:
    return F.bround(col).cast("long")


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))
