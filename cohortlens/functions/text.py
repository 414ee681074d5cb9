"""Text features as column expressions (F4-F11, D5, built-in D6 tagger).

Tokens are ``[a-z]+`` runs of the lower-cased text (regex word tokens, not
Treebank: punctuation is not a word).  ASCII classes keep Spark (Java regex)
and other engines in agreement on accented letters.  Everything stays inside
Spark SQL expressions (higher-order functions over the token array), so a text
is processed whole, in one pass, with no Python worker.

Callers that need several features first add the token and tag arrays once
(:func:`with_text_arrays`) and build the features from those columns, so the
regex runs once per row.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import ADVERB_TAGS, NOUN_TAGS, PRONOUN_TAGS, SENTINEL_TEXTS, VERB_TAGS, Lexicon

# Fixed patterns (stated once; the oracle SQL uses the same text)
WORD_PATTERN = "[a-z]+"
SENTENCE_SPLIT = "[.!?]+[ \t\n\x0b\f\r]"
SENTENCE_CONTENT = "[A-Za-z0-9]"
VOWEL_GROUP = "[aeiouy]+"
NO_VOWEL_WORD = "(?<![a-z])[^aeiouy ]++(?![a-z])"  # among lower-cased words joined by a space
WHITESPACE = "\t\n\x0b\f\r"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _arr(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def post_text(title: Column | str, selftext: Column | str, drop_sentinels: bool = True) -> Column:
    """F4 (post): ``title + ' ' + selftext``; the selftext sentinels are ignored
    when ``drop_sentinels`` (language scripts) and kept otherwise (model scoring)."""
    st = _c(selftext)
    if drop_sentinels:
        st = F.when(~st.isin(list(SENTINEL_TEXTS)), st)
    return F.concat_ws(" ", _c(title), st)


def assemble_text(kind: Column | str, title: Column | str, selftext: Column | str,
                  body: Column | str, drop_sentinels: bool = True) -> Column:
    """reply -> body; post -> title + ' ' + selftext."""
    return F.when(_c(kind) == "reply", F.coalesce(_c(body), F.lit(""))) \
            .otherwise(post_text(title, selftext, drop_sentinels))


def is_blank(text: Column | str) -> Column:
    """Null, empty or whitespace-only text."""
    t = F.translate(F.coalesce(_c(text), F.lit("")), WHITESPACE, " " * len(WHITESPACE))
    return F.length(F.trim(t)) == 0


def tokens(text: Column | str) -> Column:
    """word tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(WORD_PATTERN), 0)


def sentences(text: Column | str) -> Column:
    """sentence pieces holding at least one letter or digit."""
    parts = F.split(F.coalesce(_c(text), F.lit("")), SENTENCE_SPLIT)
    return F.filter(parts, lambda s: s.rlike(SENTENCE_CONTENT))


def clean_tokens(toks: Column, lex: Lexicon) -> Column:
    """tokens without stop words."""
    stop = _arr(lex.stop_words)
    return F.filter(toks, lambda t: ~F.array_contains(stop, t))


def tag_of(token: Column, lex: Lexicon) -> Column:
    """Built-in D6 tagger: pronoun list -> PRP, then suffix rules in order, else default."""
    e = F.when(F.array_contains(_arr(lex.pronouns), token), F.lit("PRP"))
    for suffix, tag in lex.suffix_tags:
        e = e.when(token.endswith(suffix), F.lit(tag))
    return e.otherwise(F.lit(lex.default_tag))


def tags(toks: Column, lex: Lexicon) -> Column:
    return F.transform(toks, lambda t: tag_of(t, lex))


def with_text_arrays(df: DataFrame, text: Column | str, lex: Lexicon, toks: str = "_toks",
                     tg: str = "_tags", tagger: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add the token and tag arrays once; features read them by name.  ``tagger``
    (D6) maps the token array to a tag array of the same length, for instance a
    pandas UDF around a trained tagger; the default is the lexicon's."""
    made = tagger(F.col(toks)) if tagger else tags(F.col(toks), lex)
    return df.withColumn(toks, tokens(text)).withColumn(tg, made)


def _count_in(arr: Column, values) -> Column:
    return F.size(F.filter(arr, lambda x: x.isin(list(values))))


def _ratio(n: Column, d: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def keyword_flag(text: Column | str, keywords) -> Column:
    """any keyword is a substring of the lower-cased text."""
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    e = F.lit(False)
    for k in keywords:
        e = e | F.contains(low, F.lit(k))
    return e


def syllables(toks: Column) -> Column:
    """Vowel-group syllables, at least one per word: one pattern over the joined words
    finds the vowel groups and the words without a vowel."""
    return F.size(F.regexp_extract_all(F.array_join(toks, " "), F.lit(f"{VOWEL_GROUP}|{NO_VOWEL_WORD}"), 0))


def _read_parts(text: Column | str, toks: Column) -> tuple[Column, Column, Column]:
    n_w = F.size(toks).cast("double")
    n_s = F.greatest(F.size(sentences(text)), F.lit(1)).cast("double")
    return n_w, n_s, syllables(toks).cast("double")


def fk_grade(text: Column | str, toks: Column | None = None) -> Column:
    """Flesch-Kincaid grade = 0.39 w/s + 11.8 syl/w - 15.59 (0 for no words)."""
    n_w, n_s, syl = _read_parts(text, tokens(text) if toks is None else toks)
    return F.when(n_w > 0, F.lit(0.39) * (n_w / n_s) + F.lit(11.8) * (syl / n_w) - F.lit(15.59)) \
            .otherwise(F.lit(0.0))


def reading_ease(text: Column | str, toks: Column | None = None) -> Column:
    """Flesch reading ease = 206.835 - 1.015 w/s - 84.6 syl/w (0 for no words)."""
    n_w, n_s, syl = _read_parts(text, tokens(text) if toks is None else toks)
    return F.when(n_w > 0, F.lit(206.835) - F.lit(1.015) * (n_w / n_s) - F.lit(84.6) * (syl / n_w)) \
            .otherwise(F.lit(0.0))


def pos_ratios(toks: Column, tg: Column) -> dict[str, Column]:
    """F8: noun / verb / adverb shares of the words (0 when there are none)."""
    n = F.size(toks)
    return {"noun_ratio": _ratio(_count_in(tg, NOUN_TAGS), n),
            "verb_ratio": _ratio(_count_in(tg, VERB_TAGS), n),
            "adverb_ratio": _ratio(_count_in(tg, ADVERB_TAGS), n)}


def _pronoun_words(toks: Column, tg: Column) -> Column:
    return F.filter(toks, lambda w, i: F.get(tg, i).isin(list(PRONOUN_TAGS)))


def pronoun_features(toks: Column, tg: Column, lex: Lexicon) -> dict[str, Column]:
    """pronoun class counts among pronoun-tagged words (1st sg., 1st pl.,
    2nd, rest = 3rd) and their shares of all pronouns (0 when there are none)."""
    pw = _pronoun_words(toks, tg)
    fs = _count_in(pw, lex.first_singular)
    fp = _count_in(pw, lex.first_plural)
    sp = _count_in(pw, lex.second_person)
    tot = F.size(pw)
    tp = tot - fs - fp - sp
    return {
        "first_person_singular_pronouns": fs.cast("bigint"),
        "first_person_plural_pronouns": fp.cast("bigint"),
        "second_person_pronouns": sp.cast("bigint"),
        "third_person_pronouns": tp.cast("bigint"),
        "first_person_singular_ratio": _ratio(fs, tot),
        "first_person_plural_ratio": _ratio(fp, tot),
        "second_person_ratio": _ratio(sp, tot),
        "third_person_ratio": _ratio(tp, tot),
    }


def language_features(text: Column | str, toks: Column, tg: Column, lex: Lexicon) -> dict[str, Column]:
    """The 17 per-text features (F5-F11), as named columns."""
    n = F.size(toks)
    pr = pronoun_features(toks, tg, lex)
    return {
        "num_nouns": _count_in(tg, NOUN_TAGS).cast("bigint"),
        "num_verbs": _count_in(tg, VERB_TAGS).cast("bigint"),
        "num_adverbs": _count_in(tg, ADVERB_TAGS).cast("bigint"),
        **{k: pr[k] for k in ("first_person_singular_pronouns", "first_person_plural_pronouns",
                              "second_person_pronouns", "third_person_pronouns")},
        **pos_ratios(toks, tg),
        **{k: pr[k] for k in ("first_person_singular_ratio", "first_person_plural_ratio",
                              "second_person_ratio", "third_person_ratio")},
        "readability_score": fk_grade(text, toks),
        "keyword_score": keyword_flag(text, lex.keywords),
        "text_length": n.cast("bigint"),
    }


def first_person_share_of_words(toks: Column, tg: Column, lex: Lexicon) -> Column:
    """D8's variant: first-person-singular pronouns over all words."""
    # the word is looked at first: few words need their tag
    own = F.filter(toks, lambda w, i: w.isin(list(lex.first_singular)) & F.get(tg, i).isin(list(PRONOUN_TAGS)))
    return _ratio(F.size(own), F.size(toks))


def compound_sentiment(toks: Column, lex: Lexicon) -> Column:
    """Sum of lexicon valences normalised as s / sqrt(s^2 + 15) (0 with no hits).

    The lexicon is a literal map evaluated inside the scan stage: no explode,
    no join, no shuffle.
    """
    if not lex.valence:
        return F.lit(0.0)
    m = F.create_map(*[x for w, v in lex.valence for x in (F.lit(w), F.lit(float(v)))])
    s = F.aggregate(F.transform(toks, lambda t: F.coalesce(F.try_element_at(m, t), F.lit(0.0))),
                    F.lit(0.0), lambda a, b: a + b)
    return s / F.sqrt(s * s + F.lit(15.0))
