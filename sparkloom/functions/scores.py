"""Tiers, confidence models and scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def impact_tier(score: Column) -> Column:
    return F.when(score <= 5, "LOW").when(score <= 15, "MEDIUM").when(score <= 40, "HIGH").otherwise("CRITICAL")


def rename_tier(references: Column) -> Column:
    return F.when(references == 0, "SAFE").when(references <= 5, "LOW").when(references <= 20, "MEDIUM").otherwise("HIGH")


def change_tier(score: Column) -> Column:
    return F.when(score > 10, "HIGH").when(score > 3, "MEDIUM").otherwise("LOW")


def calibrated(base_structural: Column, resolved: Column, stability: Column, entropy: Column) -> Column:
    """.9 for structural evidence and .4 for heuristic, .65 of it if unresolved, times stability and 1 - .15 entropy; heuristics end at .6."""
    raw = F.when(base_structural, 0.9).otherwise(0.4) * F.when(resolved, 1.0).otherwise(0.65) * stability * (1 - 0.15 * entropy)
    return F.greatest(F.lit(0.0), F.least(raw, F.when(base_structural, 1.0).otherwise(0.6)))


def character_entropy(text: Column) -> Column:
    """Shannon entropy of the characters over that of as many equally frequent ones; 1 for an empty text, 0 for one distinct character."""
    chars = F.split(text, "")
    n = F.char_length(text)
    total = F.aggregate(
        F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n), F.lit(0.0), lambda s, p: s - p * F.log2(p)
    )
    distinct = F.size(F.array_distinct(chars))
    return F.when(n == 0, 1.0).when(distinct <= 1, 0.0).otherwise(total / F.log2(distinct))


def reinforced(current: Column, alpha: float, seen: bool = True) -> Column:
    """Stability after a scan that saw the evidence again (towards 1) or missed it (towards 0)."""
    return current + alpha * (1 - current) if seen else current * (1 - alpha)


def slug(heading: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(heading)), r"[^\p{L}\p{N}\s_-]", ""), r"\s+", "-")


def parent_dir(path: Column) -> Column:
    out = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(out == "", ".").otherwise(out)


def top_dir(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def human_size(size: Column) -> Column:
    unit = F.when(size < 1024, "B").when(size < 1 << 20, "KB").when(size < 1 << 30, "MB").otherwise("GB")
    return F.concat(F.format_number(size / F.when(size < 1024, 1).when(size < 1 << 20, 1 << 10).when(size < 1 << 30, 1 << 20).otherwise(1 << 30), 1), F.lit(" "), unit)


def permissions(mode: Column) -> Column:
    """rwxr-xr-x of the low nine bits."""
    return F.concat(*(F.when(mode.bitwiseAND(1 << (8 - i)) != 0, "rwx"[i % 3]).otherwise("-") for i in range(9)))


def synonyms_match(name: Column, term: str, groups: list[list[str]]) -> Column:
    """.5 if the name has a synonym of the term at a word boundary, else 0."""
    words = sorted({w for g in groups if term in g for w in g})
    return F.when(name.rlike("|".join(word_boundary(w) for w in words)), 0.5).otherwise(0.0) if words else F.lit(0.0)


def word_boundary(word: str) -> str:
    """A pattern for the word between separators (_ : . - /), at the ends or at a camel-case step."""
    w, up = word.lower(), word.capitalize()
    return rf"(?:(?:^|[_:.\-/ ]){w}(?:$|[_:.\-/ A-Z])|{up}(?:$|[_:.\-/ A-Z]))"
