"""Text of transcripts: tokens, marks, labels, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed sets of marks.
TERMINAL = "。！？；.!?;"
CLAUSE = "，、：,:"
SENTENCE_END = "。？?！!"
SUB_SENTENCE = "，。？！、；：,.?!;:"
CJK = r"^[一-鿿㐀-䶿]$"


def is_cjk_char(token: Column) -> Column:
    return token.rlike(CJK)


def strip(text: Column) -> Column:
    """Without white space at either end (trim() takes only spaces)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def mixed_tokens(text: Column) -> Column:
    """Runs of ASCII that isn't white space are words; every other character is a token."""
    return F.regexp_extract_all(text, F.lit(r"([!-~]+|[^\x00-\x7F])"), F.lit(1))


def render(tokens: Column) -> Column:
    """Join tokens, with a space only between two ASCII ones."""
    ascii_only = lambda t: ~t.rlike(r"[^\x00-\x7F]")
    parts = F.transform(tokens, lambda t, i: F.when((i > 0) & ascii_only(t) & ascii_only(F.get(tokens, i - 1)), F.concat(F.lit(" "), t)).otherwise(t))
    return F.array_join(parts, "")


def join_paragraphs(texts: Column) -> Column:
    """Trimmed texts, empty ones left out, with a comma where the last has no mark, and a full stop at the end."""
    kept = F.filter(F.transform(texts, strip), lambda t: t != "")
    joined = F.aggregate(kept, F.lit(""), lambda acc, t: F.when(acc == "", t).when(acc.rlike("[，。？?！!；;、：:,.]$"), F.concat(acc, t)).otherwise(F.concat(acc, F.lit("，"), t)))
    return F.when((joined == "") | joined.rlike("[。？?！!]$"), joined).otherwise(F.concat(joined, F.lit("。")))


def strip_label(text: Column, label: Column) -> Column:
    """Without a leading ``label:`` (either colon)."""
    at = lambda c: F.startswith(text, F.concat(label, F.lit(c)))
    return F.when(at(":") | at("："), F.substr(text, F.length(label) + 2)).otherwise(text)


def delay_seconds(text: Column) -> Column:
    """1h2m3.5s to seconds; null if no part of it is there."""
    part = lambda unit: F.regexp_extract(text, rf"([0-9]+(?:\.[0-9]+)?){unit}(?![a-z])", 1)
    parts = [(part("h"), 3600.0), (part("m"), 60.0), (part("s"), 1.0)]
    total = sum((F.coalesce(p.try_cast("double"), F.lit(0.0)) * w for p, w in parts), F.lit(0.0))
    return F.when(F.greatest(*(F.length(p) for p, _ in parts)) > 0, total)


def key_prefix(secret: Column) -> Column:
    """Enough of a secret to know it by: the first and last four characters of a long one."""
    return F.when(F.length(secret) > 8, F.concat(F.left(secret, F.lit(4)), F.lit("..."), F.right(secret, F.lit(4)))).otherwise("...")


def redact(text: Column, secret: Column) -> Column:
    return F.when(F.length(secret) > 0, F.replace(text, secret, F.lit("***"))).otherwise(text)


def numbered(n: Column, label: Column, text: Column) -> Column:
    return F.concat(F.lit("["), n.cast("string"), F.lit("] "), label, F.lit(": "), text)
