"""One spelling for labels that are only written differently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width digits and their plain forms.
FULL_WIDTH, PLAIN = "０１２３４５６７８９", "0123456789"
# Ways to write that a label is not known, without blanks and marks.
UNKNOWN = ("", "none", "null", "na", "nan", "unknown")


def canonical_label(c: Column, usual: tuple[str, ...] = ()) -> Column:
    """Lower case, without blanks and marks; unknown in any spelling is null.

    Labels in ``usual`` are canonical already and skip the work.
    """
    bare = F.regexp_replace(F.lower(F.translate(c, FULL_WIDTH, PLAIN)), r"[^\p{L}\p{N}]+", "")
    known = F.when(~bare.isin(*UNKNOWN), bare)
    return F.when(c.isin(*usual), c).otherwise(known) if usual else known


def canonical_number(c: Column) -> Column:
    """A shirt number as written plainly: no sign, prefix ("No. 7", "#7"), blanks or leading zeros.

    What holds no number stays a canonical label; unknown is null.
    """
    plain = c.try_cast("int")
    bare = canonical_label(c)
    number = F.regexp_replace(F.regexp_replace(bare, r"^(no|nr|number)(?=\d)", ""), r"^0+(?=\d)", "")
    return F.when(plain >= 0, plain.cast("string")).otherwise(number)
