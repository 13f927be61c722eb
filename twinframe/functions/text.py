"""Text functions of the audit tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words whose quoted value is a secret, in the order they are looked for.
SECRET_WORDS = ("KEY_ID", "SECRET", "SESSION_TOKEN", "KEY")
# Characters with the Unicode property White_Space.
WHITE_SPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def redacted(sql: Column) -> Column:
    """``sql`` with the quoted values after secret words, and bearer tokens, replaced by ``***``."""
    for word in SECRET_WORDS:
        sql = F.regexp_replace(sql, f"({word} ')[^']*(?=')", "$1***")
    return F.regexp_replace(sql, "('Bearer )[^']*(?=')", "$1***")


def stripped(text: Column) -> Column:
    """``text`` without white space of any kind at its ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))
