"""Column helpers for text. All are built-in expressions, so they stay in generated code."""

import re

from pyspark.sql import Column, functions as F

# Whitespace as the scanned tools define it: Unicode spaces and the four separator controls.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
#: The characters of ``SPACE``, for trimming, which looks at the ends of a text alone.
SPACES = "".join(chr(c) for c in range(0x3001) if re.match(SPACE, chr(c)))


def col(c):
    return F.col(c) if isinstance(c, str) else c


def strip(c):
    return F.trim(col(c), F.lit(SPACES))


def strip_left(c):
    return F.ltrim(col(c), F.lit(SPACES))


def is_blank(c):
    return ~col(c).rlike(NOT_SPACE)


def has_any(c, words):
    """True if the text contains one of the words."""
    c, out = col(c), F.lit(False)
    for i, w in enumerate(words):
        out = c.contains(w) if i == 0 else out | c.contains(w)
    return out


def bands(c, table, otherwise):
    """The value of the first band (lower bound, value) that the number reaches."""
    c, out = col(c), None
    for bound, value in table:
        out = F.when(c >= bound, F.lit(value)) if out is None else out.when(c >= bound, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def lookup(c, mapping, otherwise=None):
    """A fixed small mapping as a literal map, so no join is needed."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), col(c))
    return found if otherwise is None else F.coalesce(found, otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def count_of(c, piece):
    """How often a piece occurs, without overlaps."""
    c = col(c)
    return (F.length(c) - F.length(F.replace(c, F.lit(piece), F.lit("")))) / len(piece)


def folded_sql(text):
    """Lower case for containment tests that must hold whenever a regex ignoring case matches.

    Java folds the long s and the dotless and dotted i to ASCII letters; ``lower`` does not.
    """
    return (
        f"CASE WHEN octet_length({text}) = char_length({text}) THEN lower({text}) "
        f"ELSE translate(lower({text}), '\u017f\u0131\u0307', 'si') END"
    )


def folded(name):
    return F.expr(folded_sql(name))


def sql_text(value):
    """A text as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def title_words(c):
    """``some_name`` as ``Some Name``."""
    return F.initcap(F.replace(col(c), F.lit("_"), F.lit(" ")))


def tenths(c):
    """A number of at least 0 in tenths, rounded exactly; a true tie goes to the even tenth.

    The sign of 20x - m is exact in doubles when taken as (16x - m) + 4x, so numbers that only look like
    a tie in decimal form are rounded by their real value.
    """
    x = col(c).cast("double")
    n = F.floor(x * 10)
    side = (x * 16 - (n * 2 + 1)) + x * 4
    return F.when(side > 0, n + 1).when(side < 0, n).otherwise(n + n % 2)


def fixed1(c):
    """A number of at least 0 with one decimal, as text."""
    t = tenths(c)
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def ordered_mean(order, value, kept=None):
    """Mean of a group's few values, summed in a fixed order so that equal inputs give equal results.

    Only for groups of known small size (the languages or the gates of a project).
    """
    pair = F.struct(col(order).alias("o"), col(value).alias("v"))
    listed = F.sort_array(F.collect_list(pair if kept is None else F.when(kept, pair)))
    total = F.aggregate(listed, F.lit(0.0), lambda acc, x: acc + x["v"])
    return F.when(F.size(listed) > 0, total / F.size(listed))
