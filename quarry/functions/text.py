"""Text clean-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs that are deleted or become spaces, and contractions.
MARKS = "([,.!?:;])"
CONTRACTIONS = ["'m", "'re", "'ve", "'s", "'ll", "'d"]
MORE_STOPWORDS = ["", " ", "it's", "i'm", "&", "$"]


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def simple_words(text: Column) -> Column:
    """Lower case, marks deleted, split at every single space (so empty words can occur)."""
    return F.split(strip(F.translate(F.lower(text), MARKS, "")), " ")


def normal_words(text: Column) -> Column:
    """Lower case, marks to spaces, new lines deleted, contractions and numbers dropped, split at every single space."""
    out = F.translate(F.lower(text), MARKS + "\\\n", " " * (len(MARKS) + 1))  # the last sign has no other
    out = F.replace(F.replace(out, F.lit("can't"), F.lit("can not")), F.lit("won't"), F.lit("will not"))
    for c in CONTRACTIONS:
        out = F.replace(out, F.lit(c), F.lit(" "))
    # A word is tried from its start only, or from where the last one's sign behind it was dropped.
    dropped = F.regexp_replace(out, r"(?:\G|(?<![\p{L}\p{N}_]))[\p{L}\p{N}_]+n't.", "")
    out = F.when(F.contains(out, F.lit("n't")), dropped).otherwise(out)
    return F.split(strip(F.regexp_replace(out, r"\$*\p{Nd}+", "")), " ")  # no digit is left
