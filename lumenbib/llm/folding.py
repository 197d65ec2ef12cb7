"""Native folding of names and titles to lower-case base letters, for keys and comparisons."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenbib.llm.confusables import LATIN_PROTOTYPES, LOOKALIKES


def _pairs() -> dict[str, str]:
    """Letters that fold to one ASCII letter: accented Latin by decomposition, wide forms by offset, look-alikes by table."""
    out = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(c))[0]
        if base != chr(c) and base.isascii():
            out[chr(c)] = base
    # Latin letters with a stroke, which do not decompose.
    out |= dict(zip("ØøŁłĐđĦħŦŧ", "OoLlDdHhTt", strict=True))
    return out | LATIN_PROTOTYPES | LOOKALIKES


_FOLD = _pairs()


def fold(col: Column) -> Column:
    """``col`` in lower case with marks and invisible signs removed and foreign forms made plain; null stays null."""
    bare = F.regexp_replace(col, "[̀-ͯ­͏​-‏‪-‮⁠-⁤︀-️﻿]", "")
    wide = F.regexp_replace(F.regexp_replace(bare, "[   -   　]", " "), "ﬁ", "fi")
    for ligature, plain in (("ﬀ", "ff"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ß", "ss")):
        wide = F.replace(wide, F.lit(ligature), F.lit(plain))
    folded = F.translate(wide, "".join(_FOLD), "".join(_FOLD.values()))
    return F.lower(F.when(col.rlike("[^ -~]"), folded).otherwise(col))
