"""All matches of a pattern with their places, as a table function that is joined laterally to its rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import udtf

MATCH = "ordinal long, start long, end long, match string, window_start long, window string"


@udtf(returnType=MATCH, useArrow=True)
class Matches:
    """eval(text, pattern, before, after, overlapping): a row for each match, in order."""

    def eval(self, text: str | None, pattern: str, before: int, after: int, overlapping: bool) -> Iterator[tuple]:
        if text is None:
            return
        compiled, at, k = re.compile(pattern), 0, 0
        while at <= len(text) and (m := compiled.search(text, at)):
            start, end = m.span()
            left = max(0, start - before)
            yield k, start, end, m[0], left, text[left : end + after]
            k += 1
            at = start + 1 if overlapping or end == start else end


def all_matches(df: DataFrame, text: str, pattern: str, before: int = 0, after: int = 0, overlapping: bool = False) -> DataFrame:
    """df's rows, one for each match of the pattern (Python's syntax) in a text column: ordinal (from 0), start, end, match, window_start, window.

    Places count code points, the end is exclusive, and the window reaches from `before` code points before the match to `after` behind it, within the
    text. Matches don't overlap, leftmost first, unless overlapping asks for the first match from every place on. An empty match
    counts. Null texts and texts without a match give no row. df must have none of these column names.
    """
    return df.lateralJoin(Matches(F.col(text).outer(), F.lit(pattern), F.lit(before), F.lit(after), F.lit(overlapping)))
