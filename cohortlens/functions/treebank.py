"""Treebank word tokens (F5): the published chain of rewriting rules, in order.

Contractions come apart, quotes become `` and '', punctuation marks are tokens, a final
period is cut off; digits and accents stay.  The rules are meant for one sentence at a
time (``sentence_tokens``).  ``text.tokens`` ([a-z]+ runs) stays for the other features.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published rules as (pattern, replacement), applied in this order
RULES = (
    ('^"', "`` "),
    ('([ (\\[{<])"', "$1 `` "),
    ("[.][.][.]", " ... "),
    ("([:,])([^0-9])", " $1 $2"),
    ("([:,])$", " $1 "),
    ("([;@#%&])", " $1 "),
    ("([$])", " $1 "),
    ("([^.])([.])([\\])}>\"']*)[ \t\n]*$", "$1 $2$3 "),
    ("([?!])", " $1 "),
    ("([^'])' ", "$1 ' "),
    ("([\\]\\[(){}<>])", " $1 "),
    ("--", " -- "),
    ("^", " "),
    ("$", " "),
    ('"', " '' "),
    ("([^ ])('')", "$1 $2 "),
    ("([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "),
    ("([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    ("(?i) (can)(not) ", " $1 $2 "),
    ("(?i) (d)('ye) ", " $1 $2 "),
    ("(?i) (gim)(me) ", " $1 $2 "),
    ("(?i) (gon)(na) ", " $1 $2 "),
    ("(?i) (got)(ta) ", " $1 $2 "),
    ("(?i) (lem)(me) ", " $1 $2 "),
    ("(?i) (more)('n) ", " $1 $2 "),
    ("(?i) ('t)(is|was) ", " $1 $2 "),
    ("(?i) (wan)(na) ", " $1 $2 "),
)
# end of fixed values
SPACES = "[ \t\n\x0b\f\r]+"


def treebank_tokens(sentence: Column) -> Column:
    """the tokens of one sentence (none of a null or blank one)."""
    t = F.coalesce(sentence, F.lit(""))
    for pattern, by in RULES:
        t = F.regexp_replace(t, pattern, by)
    return F.filter(F.split(t, SPACES), lambda x: x != "")


def sentence_tokens(sentences: Column) -> Column:
    """The tokens of an array of sentences, one after the other."""
    return F.flatten(F.transform(sentences, treebank_tokens))


def tokens_sql(x: str) -> str:
    """The same chain for the oracle."""
    e = f"coalesce({x}, '')"
    for pattern, by in RULES:
        by = by.replace("$1", "\\1").replace("$2", "\\2").replace("$3", "\\3").replace("'", "''")
        e = f"regexp_replace({e}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"
    return f"list_filter(string_split_regex({e}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
