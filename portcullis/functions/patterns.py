"""Regular expressions written for Python, as Spark evaluates them."""

from math import prod

from pyspark.sql import functions as F

from ..dims.rules import literal_runs
from .text import sql_text

# Ignore case by Unicode rules; the dot takes everything (lines hold no line break).
IGNORE_CASE = "(?isuU)"
# Whole text, ignoring case, ^ and $ at every line; the dot stops at line feeds only.
WHOLE_TEXT = "(?imuUd)"
# Case matters; only line feeds end a line.
PLAIN = "(?Ud)"


def java(pattern, flags=IGNORE_CASE):
    """Java takes flags inside a pattern as Python before 3.11 did."""
    return flags + pattern


def guarded_tests(text, low, patterns, flags=WHOLE_TEXT):
    """SQL tests, one per pattern: does it occur in the column ``text``, whose folded form is the column ``low``?

    Plain containment of the guard, the longest literal that matches need, is far cheaper than the pattern. Patterns
    stand in the tests as literals, so that a task compiles each of them once and not for each text.
    """
    guards = [quick_part(max(literal_runs(p), key=len, default="")) for p in patterns]
    return [f"(contains({low}, {sql_text(g)}) AND {text} RLIKE {sql_text(flags + p)})" for g, p in zip(guards, patterns)]


def guarded(text, low, patterns, flags=WHOLE_TEXT):
    """Does one of the patterns occur in the column ``text``, whose folded form is the column ``low``?

    The lambda keeps the tests out of whole-stage code, whose single method would grow with the patterns.
    """
    return F.expr(f"exists(array({', '.join(guarded_tests(text, low, patterns, flags))}), r -> r)")


#: About how many of a thousand characters of code are this one; others are rare.
PER_MILLE = dict(zip("etaoinsrhdlucmwfgypbvk_.() \"", [95, 75, 65, 60, 58, 58, 52, 50, 30, 33, 35, 24, 27, 22, 12, 18, 16, 14, 20, 12, 9, 8, 15, 15, 12, 12, 150, 12]))
LONGEST_PIECE = 8


def commonness(piece, chars=60):
    """A rough share of lines that contain a piece. It orders tests and decides nothing else."""
    return min(0.9, (chars * prod(PER_MILLE.get(c, 3) / 1000 for c in piece)) ** 0.5)


#: What a test costs, in bytes passed over: a place where the first letter fits, and what follows where the test holds.
FIRST_FITS, TEST_HOLDS = 10, 600


def quick_part(text, chars=60):
    """The end of ``text`` for which a containment test costs least; where it does not occur, ``text`` does not either.

    A test compares whole texts wherever the first letter fits, so one that begins with a rare letter is cheaper. Where
    the shorter end occurs more often than the text, the tests behind it are made more often.
    """
    ends = [text[at:] for at in range(len(text))]
    first = lambda end: FIRST_FITS * chars * PER_MILLE.get(end[0], 3) / 1000
    return min(ends, key=lambda end: (first(end) + TEST_HOLDS * commonness(end), -len(end)), default=text)


def best_piece(texts, under=""):
    """The piece with which some texts cost fewest containment tests each, made only where it occurs; else None.

    Among texts that share ``under``, which is known to occur, it is a piece of some of them only.
    """
    having = {}
    for text in texts:
        for size in range(1, LONGEST_PIECE + 1):
            for at in range(len(text) - size + 1):
                having.setdefault(text[at : at + size], set()).add(text)
    # Tests for each text: the piece's own, and where it occurs those of the texts, most of which have pieces in common again.
    cost = {p: 1 / len(found) + commonness(p) * 0.7 for p, found in having.items() if 1 < len(found) < len(texts) + (under == "") and p not in under}
    best = min(cost, key=lambda p: (cost[p], -len(p), p), default=None)
    return best if best is not None and cost[best] < 0.9 else None
