"""Plain forms of disguised text: look-alike letters, hidden characters, mark-up, broken lines."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cyrillic and Greek letters that look like Latin ones, and the letters they pass for.
LOOK_ALIKE = "аеорсухіѕјԁһԛԝкмтвнгαοερτυικνχ"
LOOKS_LIKE = "aeopcyxisjdhqwkmtbhraoeptuiknx"
#: Characters that print nothing: soft hyphen, zero-width ones, joiners, direction marks.
HIDDEN = "[­͏؜ᅟ᠎​-‏‪-‮⁠-⁤︀-️﻿]"


def fold_table() -> tuple[str, str]:
    """Letters and the plain letters they fold to, by the rule of compatibility decomposition."""
    source, target = list(LOOK_ALIKE), list(LOOKS_LIKE)
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF10, 0xFF5B)]:
        c = chr(code)
        plain = unicodedata.normalize("NFKD", c)[:1].lower()
        if plain != c and plain.isalnum() and plain.isascii() and c not in LOOK_ALIKE:
            source.append(c)
            target.append(plain)
    return "".join(source), "".join(target)


def plain_text(c: Column) -> Column:
    """Lower case, folded, without hidden characters, mark-up and line-break hyphens (all in the JVM)."""
    source, target = fold_table()
    c = F.regexp_replace(c, HIDDEN, "")
    c = F.regexp_replace(c, r"<[^<>]{0,200}>", "")
    c = F.regexp_replace(c, r"&(nbsp|#160|ensp|emsp|thinsp);", " ")
    c = F.regexp_replace(c, r"&(amp|lt|gt|quot|#39|shy);", "")
    c = F.regexp_replace(c, r"(?<=\p{L})-[ \t]*\r?\n\s*(?=\p{L})", "")
    c = F.regexp_replace(F.translate(F.lower(c), source, target), r"\p{M}+", "")
    return c


#: What plain_text has to work on, besides capitals.
ODD = r"[^\x00-\x7F]|[<&]|-[ \t]*\r?\n"


def words(c: Column) -> Column:
    """Words and numbers of a plain text, in order; texts of plain letters take the short way."""
    short = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z]+|[0-9]+)"), F.lit(1))
    return F.when(c.rlike(ODD), F.regexp_extract_all(plain_text(c), F.lit(r"(\p{L}+|\p{N}+)"), F.lit(1))).otherwise(short)


_FOLD = str.maketrans(*fold_table())
_HIDDEN = re.compile(HIDDEN)
_MARKS = re.compile("[̀-ͯ]+")


def plain_python(text: str) -> str:
    """The folding of :func:`plain_text` for text that is worked on in Python, case kept out."""
    if text.isascii():
        return text.lower()
    return _MARKS.sub("", _HIDDEN.sub("", text).lower().translate(_FOLD))
