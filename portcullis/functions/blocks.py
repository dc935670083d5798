"""Texts of bounded size from line tables, so that signs across line breaks are found without gathering a file."""

import re

from pyspark.sql import DataFrame, Window, functions as F

from .text import is_blank

BLOCK = 512


def reach(patterns):
    """How many lines with text a match of the patterns can span beyond its last one, blank lines aside.

    A match goes on to the next line only where the pattern allows white space of any length. Patterns that could cross
    lines in another way are refused.
    """
    for p in patterns:
        if re.search(r"\[\^|\\[WDSn]|\(\?s|\\s(?![+*])", p):
            raise ValueError(f"cannot tell how many lines this spans: {p}")
    return max((p.count(r"\s") for p in patterns), default=0)


def text_blocks(lines: DataFrame, lines_before: int, block=BLOCK) -> DataFrame:
    """Blocks of a line table as texts: project_id, path, language, block, own, whole.

    ``own`` are the block's lines; ``whole`` has the last lines with text before the block in front, as many as asked
    for. These may lie in any earlier block, as some blocks may be blank. A file of any size is spread over its blocks;
    only the last lines of each block are ordered per file.
    """
    keys = ["project_id", "path", "language"]
    blocked = lines.select(*keys, F.floor(F.col("line_no") / block).alias("block"), "line_no", "line")
    gathered = blocked.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("_lines"))
    texts = F.transform("_lines", lambda x: x["line"])
    own = F.array_join(texts, "\n")
    if not lines_before:
        return gathered.select(*keys, "block", own.alias("own"), own.alias("whole"))
    filled = F.filter(texts, lambda x: ~is_blank(x))
    tail = F.slice(filled, F.greatest(F.lit(1), F.size(filled) - lines_before + 1), lines_before)
    # Blank blocks have no tail and need none. Every other tail has a line at least, so as many tails are enough.
    tails = gathered.select(*keys, "block", tail.alias("_tail")).where(F.size("_tail") > 0)
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(-lines_before, -1)
    front = F.flatten(F.collect_list("_tail").over(before))
    carried = tails.select(*keys, "block", front.alias("_front"))
    front = F.array_join(F.slice("_front", F.greatest(F.lit(1), F.size("_front") - lines_before + 1), lines_before), "\n")
    joined = gathered.join(carried, [*keys, "block"], "left")
    return joined.select(*keys, "block", own.alias("own"), F.when(F.size("_front") > 0, F.concat(front, F.lit("\n"), own)).otherwise(own).alias("whole"))
