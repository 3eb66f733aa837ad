"""Literal phrases as regular expressions: tiered and flat scans.

Testing 174 expressions on each text is slow, so each family of phrases first goes through one expression in the
form of a trie over lower-cased text, which any hit must match; only texts that pass are tested phrase by phrase.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import phrases as P
from .text import blank

#: Letters that a case-insensitive match takes for ASCII ones, and what stands for them.
FOLDED, FOLDS = "İıſK", "iisk"


def phrase_regex(phrase: str, case_sensitive: bool = False) -> str:
    """A Java expression; word boundaries stand at alphanumeric edges only."""
    left, right = ("\\b" if x.isalnum() else "" for x in (phrase[0], phrase[-1]))
    return f"{'(?U)' if case_sensitive else '(?iuU)'}{left}{_escape(phrase)}{right}"


def _escape(text: str) -> str:
    return re.sub(r"([^\w\s]|_)", r"\\\1", text, flags=re.ASCII)


def trie_regex(words: Sequence[str]) -> str:
    """One expression that matches any of the words (lower case)."""
    tree: dict = {}
    for word in words:
        at = tree
        for c in word:
            at = at.setdefault(c, {})
        at[""] = {}

    def build(at: dict) -> str:
        if "" in at:
            return ""  # a shorter word ends here: it is enough
        parts = [_escape(c) + build(x) for c, x in sorted(at.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return build(tree)


@dataclass(frozen=True)
class Family:
    """Phrases of one kind of attack."""

    name: str
    strong: tuple[str, ...]
    weak: tuple[str, ...]
    acronyms: tuple[str, ...] = ()  # strong, case-sensitive, reported after the other strong ones

    def may_match(self, text: Column, weak: bool = True) -> Column:
        lower = F.lower(F.translate(text, FOLDED, FOLDS))
        words = [p.lower() for p in (*self.strong, *(self.weak if weak else ()))]
        # A phrase that starts with a letter or digit stands at a word's start only: most places of a text end there.
        parts = ("(?<![a-z])(?:", [w for w in words if w[0].isalnum()]), ("(?:", [w for w in words if not w[0].isalnum()])
        out = lower.rlike("|".join(f"{before}{trie_regex(some)})" for before, some in parts if some))
        if self.acronyms:
            out = out | text.rlike(f"(?U)\\b(?:{'|'.join(self.acronyms)})\\b")
        return F.coalesce(out, F.lit(False))

    def strong_hits(self, text: Column) -> Column:
        return _hits(text, [(p, phrase_regex(p)) for p in self.strong] + [(p, phrase_regex(p, True)) for p in self.acronyms])

    def weak_hits(self, text: Column) -> Column:
        return _hits(text, [(p, phrase_regex(p)) for p in self.weak])


def _hits(text: Column, expressions: list[tuple[str, str]]) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(rx), F.lit(p)) for p, rx in expressions)))


INJECTION = Family("injection", P.INJECTION_STRONG, P.INJECTION_WEAK)
JAILBREAK = Family("jailbreak", P.JAILBREAK_STRONG, P.JAILBREAK_WEAK, P.JAILBREAK_ACRONYMS)
SKELETON = Family("skeleton_key", P.SKELETON_STRONG, P.SKELETON_WEAK)
FAMILIES = (INJECTION, JAILBREAK, SKELETON)

NONE = "cast(array() as array<string>)"


def tiered(text: Column, family: Family) -> Column:
    """struct(detected, patterns, score, level) of a normalised text.

    A strong phrase is HIGH (3) at 0.9; two weak ones are MEDIUM (2) at 0.6; one is LOW (1) at 0.3. ``patterns``
    lists strong phrases and then weak ones.
    """
    run = family.may_match(text) & ~blank(text)
    strong = F.when(run, family.strong_hits(text)).otherwise(F.expr(NONE))
    weak = F.when(run, family.weak_hits(text)).otherwise(F.expr(NONE))
    return grade(strong, weak)


def grade(strong: Column, weak: Column) -> Column:
    s, w = F.size(strong), F.size(weak)
    return F.struct(
        (s + w > 0).alias("detected"),
        F.concat(strong, weak).alias("patterns"),
        F.when(s > 0, 0.9).when(w >= 2, 0.6).when(w == 1, 0.3).otherwise(0.0).alias("score"),
        F.when(s > 0, 3).when(w >= 2, 2).when(w == 1, 1).otherwise(0).alias("level"),
    )


def flat(text: Column, family: Family) -> Column:
    """struct(detected, patterns, score, level): strong phrases only, any hit is HIGH; score: the share that hit."""
    run = family.may_match(text, weak=False) & ~blank(text)
    found = F.when(run, family.strong_hits(text)).otherwise(F.expr(NONE))
    total = len(family.strong) + len(family.acronyms)
    return F.struct((F.size(found) > 0).alias("detected"), found.alias("patterns"), F.round(F.size(found) / F.lit(float(total)), 4).alias("score"), F.when(F.size(found) > 0, 3).otherwise(0).alias("level"))


def strong_hit(text: Column, family: Family) -> Column:
    """Whether any strong phrase occurs: one alternation, tried on texts that pass the trie."""
    words = "|".join(phrase_regex(p).removeprefix("(?iuU)") for p in family.strong)
    out = text.rlike(f"(?iuU)(?:{words})")
    if family.acronyms:
        out = out | text.rlike(f"(?U)\\b(?:{'|'.join(family.acronyms)})\\b")
    return F.coalesce(family.may_match(text, weak=False) & ~blank(text) & out, F.lit(False))


def any_hit(text: Column, family: Family) -> Column:
    """Whether any strong or weak phrase occurs."""
    words = "|".join(phrase_regex(p).removeprefix("(?iuU)") for p in (*family.strong, *family.weak))
    out = text.rlike(f"(?iuU)(?:{words})")
    if family.acronyms:
        out = out | text.rlike(f"(?U)\\b(?:{'|'.join(family.acronyms)})\\b")
    return F.coalesce(family.may_match(text) & ~blank(text) & out, F.lit(False))
