"""Column expressions that bring identifiers and labels to one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java classes: white space of any kind; format characters (zero-width and the like).
SPACES = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+"
INVISIBLE = r"\p{Cf}+"


#: Full-width forms and the ordinary characters they stand for.
WIDE, NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))


def fold_identifier(value: Column) -> Column:
    """Lower case and ordinary width, without invisible characters, outer white space or runs of it."""
    # Nearly all identifiers are plain ASCII; only the others go through the Unicode classes.
    other = F.translate(F.regexp_replace(F.regexp_replace(value, INVISIBLE, ""), SPACES, " "), WIDE, NARROW)
    plain = F.when(value.rlike(r"[^\x21-\x7E]"), other).otherwise(value)
    return F.lower(F.trim(plain))


def fold_digest(value: Column) -> Column:
    """A folded hexadecimal digest without the name of its algorithm."""
    return F.regexp_replace(fold_identifier(value), r"^[a-z][a-z0-9-]{1,15}[:=] ?(?=[0-9a-f]{32,}$)", "")


#: The four classes and the short names that stand for them.
CLASSES = ("REFUSED_RECOGNIZED", "REFUSED_UNRECOGNIZED", "ENGAGED_RECOGNIZED", "ENGAGED_UNRECOGNIZED")
SHORT = {"RR": "REFUSED_RECOGNIZED", "RU": "REFUSED_UNRECOGNIZED", "ER": "ENGAGED_RECOGNIZED", "EU": "ENGAGED_UNRECOGNIZED"}


def canonical_class(value: Column) -> Column:
    """One of the four class names for any spelling of it (case, separators, enum prefix, initials), else null."""
    bare = F.regexp_replace(F.upper(F.trim(value)), r"^.*\.", "")
    words = F.regexp_replace(F.regexp_replace(bare, r"[^A-Z]+", "_"), r"^_+|_+$", "")
    full = F.create_map(*[F.lit(x) for pair in SHORT.items() for x in pair])
    name = F.coalesce(full[words], words)
    return F.when(name.isin(*CLASSES), name)
