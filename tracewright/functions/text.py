"""Signals, rules and sentences as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Unicode calls white space, within a character class of Java's or RE2's; their own \s is ASCII's.
SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def spaced(pattern: str) -> str:
    """The pattern with each \\s as any Unicode white space, inside character classes and outside; all else stays."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two == r"\s":
            out.append(SPACES if inside else f"[{SPACES}]")
        else:
            inside = two == "[^" or two[0] == "[" or (inside and two[0] != "]")
            out.append(two if two[0] == "\\" else two[0])
        at += len(out[-1]) if two != r"\s" else 2
    return "".join(out)


def trie_pattern(phrases: Iterable[str]) -> str:
    """Java pattern, without width, whose group 1 is the longest phrase that begins here as whole words: no ASCII letter or digit touches either end."""

    def node(rest: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for p in rest:
            if p:
                heads.setdefault(p[0], []).append(p[1:])
        ways = [(f"[{SPACES}]+" if c == " " else re.escape(c)) + node(tails) for c, tails in sorted(heads.items())]
        ways += ["(?![a-z0-9])"] * ("" in rest)
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return rf"(?<![a-z0-9])(?=({node(sorted(set(phrases)))}))"


class Phrases:
    """All phrases of some lists, found in one pass over a text; what the lists say is then looked up in the set of hits."""

    def __init__(self, *lists: Iterable[str]) -> None:
        self.all = sorted({p for some in lists for p in some})
        #: By phrase, itself and the longer ones that begin with it, of which each hit is one of it too.
        self.told_by = {p: [p, *[q for q in self.all if q != p and q.startswith(p) and not q[len(p)].isalnum()]] for p in self.all}

    def hits(self, lowered: Column) -> Column:
        """The distinct phrases in the text, each the longest that begins where it does, with single spaces."""
        found = F.regexp_extract_all(lowered, F.lit(trie_pattern(self.all)), F.lit(1))
        return F.array_distinct(F.transform(found, lambda p: F.regexp_replace(p, f"[{SPACES}]+", " ")))

    def any_of(self, hits: Column, phrases: Iterable[str]) -> Column:
        return F.arrays_overlap(hits, F.array(*[F.lit(q) for q in dict.fromkeys(q for p in phrases for q in self.told_by[p])]))

    def score(self, hits: Column, phrases: Iterable[str]) -> Column:
        """How many of the phrases occur."""
        phrases = tuple(phrases)
        alone = [p for p in phrases if len(self.told_by[p]) == 1]
        out = F.size(F.array_intersect(hits, F.array(*map(F.lit, alone)))) if alone else F.lit(0)
        for p in phrases:
            out = out if p in alone else out + self.any_of(hits, [p]).cast("int")
        return F.when(F.size(hits) > 0, out).otherwise(0)

    def first_rule(self, hits: Column, rules: Iterable[tuple[str, tuple[str, ...]]]) -> Column:
        """The code of the first rule that any phrase meets, else 'unknown'."""
        out = None
        for code, phrases in rules:
            out = F.when(self.any_of(hits, phrases), code) if out is None else out.when(self.any_of(hits, phrases), code)
        return out.otherwise("unknown")


def contains_one(text: Column, parts: Iterable[str]) -> Column:
    """Plain substrings, not bounded by word ends."""
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def sentences(text: Column) -> Column:
    """Sentences of a text with white space collapsed, without spaces and dashes at their ends, none empty."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.filter(F.transform(F.split(flat, r"(?<=[.!?])\s+"), lambda s: F.btrim(s, F.lit(" -"))), lambda s: s != "")


def first_of(array: Column) -> Column:
    return F.coalesce(F.get(array, 0), F.lit(""))


def last_of(array: Column) -> Column:
    return F.coalesce(F.get(array, F.size(array) - 1), F.lit(""))


def after(array: Column, sentence: Column) -> Column:
    """What follows the first sentence equal to `sentence`; all, if there is none."""
    at = F.array_position(array, sentence).cast("int")
    return F.slice(array, at + 1, F.greatest(F.size(array) - at, F.lit(0)))


def trim_words(text: Column, most: int) -> Column:
    """The text, whose words stand one space apart as in sentences(), if it has `most` words at most; else its first ones with '...' for the rest."""
    words = F.split(text, " ")
    cut = F.concat(F.rtrim(F.array_join(F.slice(words, 1, most), " "), F.lit(",.;:")), F.lit("..."))
    return F.when(F.size(words) <= most, text).otherwise(cut)


def spoken(code: Column) -> Column:
    """A code with spaces."""
    return F.replace(code, F.lit("_"), F.lit(" "))


def clean_lines(text: Column) -> Column:
    """Line ends as \\n, no white space at the ends of lines, no blank lines at either end; inner ones stay."""
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    stripped = F.regexp_replace(lines, r"(?U)[^\S\n]+(?=\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(stripped, r"\A\n+", ""), r"\n+\z", "")
