"""Row-wise features read out of prose, all built-in expressions."""

from __future__ import annotations

import re
import string
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word edges for any script; the plain word boundary differs between Java versions.
_EDGE = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
TRUNCATION_MARK = "\n[... truncated]"    # fixed value


def keyword_group(text: Column, words: Sequence[str]) -> Column:
    """How often any surface form of one concept occurs, case-insensitive whole words.

    Forms of word characters only are looked up among the words of the text, which is split once; other forms
    (phrases, patterns) are searched in the text itself.
    """
    lower = F.lower(text)
    plain = [w for w in words if re.fullmatch(r"\w+", w)]
    rest = [w for w in words if w not in plain]
    counts = []
    if plain:
        tokens = F.split(lower, r"[^\p{L}\p{N}_]+")
        counts.append(F.size(F.filter(tokens, lambda t: t.isin([w.lower() for w in plain]))))
    if rest:
        counts.append(F.regexp_count(lower, F.lit(_EDGE[0] + "(" + "|".join(rest) + ")" + _EDGE[1])))
    total = counts[0] if len(counts) == 1 else counts[0] + counts[1]
    return F.when(text.isNotNull(), total).cast("bigint")


def chars_in(text: Column, chars: str) -> Column:
    """How many characters of the text are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def number_after(text: Column, word: str) -> Column:
    """The first number written directly before ``word`` ("3 days"), else NULL."""
    found = F.regexp_extract(F.lower(text), rf"(\d+)\s*{word}", 1)
    return F.when(found != "", found.try_cast("double"))


def density(text: Column, chars: str) -> Column:
    return F.try_divide(chars_in(text, chars).cast("double"), F.length(text))


def style_features(text: Column, informal: Sequence[str]) -> Mapping[str, Column]:
    """Register signals: upper case, punctuation and digit density, money and time mentions, slang."""
    words = F.regexp_count(text, F.lit(r"[A-Za-z']+")).cast("double")
    return {
        "upper_ratio": F.try_divide(chars_in(text, string.ascii_uppercase).cast("double"), chars_in(text, string.ascii_letters)),
        "exclamation_density": density(text, "!"),
        "question_density": density(text, "?"),
        "digit_density": density(text, string.digits),
        "currency_mentions": F.regexp_count(text, F.lit(r"[$€£]\s*[0-9]")).cast("bigint"),
        "time_mentions": F.regexp_count(F.lower(text), F.lit(_EDGE[0] + r"[0-9]+\s*(hour|day|week|month|year)s?" + _EDGE[1])).cast("bigint"),
        "informal_ratio": F.try_divide(keyword_group(text, informal).cast("double"), words),
    }


def truncate(text: Column, limit: int, mark: str = TRUNCATION_MARK) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)
