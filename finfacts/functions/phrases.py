"""All phrases of a list in one pass over a text.

The phrases become one alternation shaped as a trie, read by a look-ahead at every position of the text, so each
position gives the longest phrase that starts there. Phrases may overlap: one inside another starts at a position of
its own, and one that another begins with is known from the longer one. So the hits answer, for every phrase of the
list, whether the text contains it, without searching the text again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, functions as F


def _trie(phrases: Iterable[str]) -> dict:
    root: dict = {}
    for phrase in phrases:
        node = root
        for char in phrase:
            node = node.setdefault(char, {})
        node[""] = True
    return root


def _alternation(node: dict) -> str:
    branches = [re.escape(char) + _alternation(child) for char, child in sorted(node.items()) if char]
    if not branches:
        return ""
    body = branches[0] if len(branches) == 1 and "" not in node else "(?:" + "|".join(branches) + ")"
    # A phrase ends here, but a longer one is taken first.
    return body + "?" if "" in node else body


def pattern(phrases: Iterable[str]) -> str:
    """A look-ahead whose first group is the longest phrase at its position."""
    listed = [p for p in phrases if p]
    return f"(?=({_alternation(_trie(listed))}))" if listed else "(?!)()"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hits(text: Column, phrases: Iterable[str]) -> Column:
    """Distinct phrases found at the positions of the lower-cased text, the longest at each; NULL for a null text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern(phrases)), F.lit(1)))


class Matcher:
    """Look-ups in the hits of one pass for several lists of phrases."""

    def __init__(self, *lists: Sequence[str]):
        self.phrases = sorted({p for phrases in lists for p in phrases if p})

    def over(self, text: Column, use: Callable[[Column], Column]) -> Column:
        """``use(hits)`` after one pass over the text."""
        return let(hits(text, self.phrases), use)

    def any_of(self, found: Column, phrases: Sequence[str]) -> Column:
        """Does the text contain any of these phrases? A hit tells of every phrase that it begins with."""
        telling = [h for h in self.phrases if any(h.startswith(p) for p in phrases)]
        return F.arrays_overlap(found, F.array(*map(F.lit, telling))) if telling else F.lit(False)

    def least(self, found: Column, ranks: Mapping[str, int]) -> Column:
        """The least rank of all contained phrases of ``ranks``, NULL when there is none."""
        best = {}
        for h in self.phrases:
            ranked = [r for p, r in ranks.items() if p and h.startswith(p)]
            if ranked:
                best[h] = min(ranked)
        if not best:
            return F.lit(None).cast("int")
        table = F.create_map(*[F.lit(x) for pair in best.items() for x in pair])
        return F.array_min(F.transform(found, lambda h: F.try_element_at(table, h)))
