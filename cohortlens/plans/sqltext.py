"""DuckDB SQL snippets for the text features (oracle side of ``functions.text``).

Each helper returns SQL text over SQL expressions; the formulas and the
evaluation order match the Spark column expressions so that both engines
produce the same doubles.
"""

from __future__ import annotations

from ..functions.text import VOWEL_GROUP, WORD_PATTERN
from ..params import ADVERB_TAGS, NOUN_TAGS, PRONOUN_TAGS, SENTINEL_TEXTS, VERB_TAGS, Lexicon

SENT_SPLIT_SQL = r"[.!?]+[ \t\n\x0B\f\r]"
WS_SQL = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def lit_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{WORD_PATTERN}')"


def tag(t: str, lex: Lexicon) -> str:
    parts = [f"when {t} in {lit_list(lex.pronouns)} then 'PRP'"]
    parts += [f"when suffix({t}, '{s}') then '{g}'" for s, g in lex.suffix_tags]
    return f"(case {' '.join(parts)} else '{lex.default_tag}' end)"


def tags(toks: str, lex: Lexicon) -> str:
    return f"list_transform({toks}, lambda t: {tag('t', lex)})"


def count_in(lst: str, values) -> str:
    if not values:
        return "0"
    return f"len(list_filter({lst}, lambda x: x in {lit_list(values)}))"


def ratio(n: str, d: str) -> str:
    return f"coalesce(cast({n} as double) / nullif(cast({d} as double), 0), 0.0)"


def pronoun_words(toks: str, lex: Lexicon) -> str:
    return f"list_filter({toks}, lambda t: {tag('t', lex)} in {lit_list(PRONOUN_TAGS)})"


def keyword(x: str, kws) -> str:
    if not kws:
        return "false"
    return "(false or " + " or ".join(f"contains(lower(coalesce({x}, '')), '{k}')" for k in kws) + ")"


def syllables(toks: str) -> str:
    return (f"(coalesce(list_sum(list_transform({toks}, lambda w: len(regexp_extract_all(w, '{VOWEL_GROUP}')))), 0)"
            f" + len(list_filter({toks}, lambda w: not regexp_matches(w, '{VOWEL_GROUP}'))))")


def n_sentences(x: str) -> str:
    return (f"len(list_filter(string_split_regex(coalesce({x}, ''), '{SENT_SPLIT_SQL}'), "
            f"lambda s: regexp_matches(s, '[A-Za-z0-9]')))")


def fk_grade(x: str, toks: str) -> str:
    w = f"cast(len({toks}) as double)"
    s = f"cast(greatest({n_sentences(x)}, 1) as double)"
    y = f"cast({syllables(toks)} as double)"
    return f"(case when {w} > 0 then 0.39 * ({w} / {s}) + 11.8 * ({y} / {w}) - 15.59 else 0.0 end)"


def reading_ease(x: str, toks: str) -> str:
    w = f"cast(len({toks}) as double)"
    s = f"cast(greatest({n_sentences(x)}, 1) as double)"
    y = f"cast({syllables(toks)} as double)"
    return f"(case when {w} > 0 then 206.835 - 1.015 * ({w} / {s}) - 84.6 * ({y} / {w}) else 0.0 end)"


def compound(toks: str, lex: Lexicon) -> str:
    if not lex.valence:
        return "0.0"
    cases = " ".join(f"when '{w}' then {float(v)!r}" for w, v in lex.valence)
    s = f"cast(coalesce(list_sum(list_transform({toks}, lambda t: case t {cases} else 0.0 end)), 0.0) as double)"
    return f"({s} / sqrt({s} * {s} + 15.0))"


def post_text(title: str, selftext: str, drop_sentinels: bool = True) -> str:
    st = (f"case when {selftext} in {lit_list(SENTINEL_TEXTS)} then null else {selftext} end"
          if drop_sentinels else selftext)
    return f"concat_ws(' ', {title}, {st})"


def is_blank(x: str) -> str:
    return f"(length(trim(translate(coalesce({x}, ''), {WS_SQL}, '     '))) = 0)"


def pos_ratio_cols(toks: str, tg: str) -> dict[str, str]:
    n = f"len({toks})"
    return {"noun_ratio": ratio(count_in(tg, NOUN_TAGS), n),
            "verb_ratio": ratio(count_in(tg, VERB_TAGS), n),
            "adverb_ratio": ratio(count_in(tg, ADVERB_TAGS), n)}


def pronoun_cols(toks: str, lex: Lexicon) -> dict[str, str]:
    pw = pronoun_words(toks, lex)
    fs, fp, sp = count_in(pw, lex.first_singular), count_in(pw, lex.first_plural), count_in(pw, lex.second_person)
    tot = f"len({pw})"
    tp = f"({tot} - {fs} - {fp} - {sp})"
    return {
        "first_person_singular_pronouns": f"cast({fs} as bigint)",
        "first_person_plural_pronouns": f"cast({fp} as bigint)",
        "second_person_pronouns": f"cast({sp} as bigint)",
        "third_person_pronouns": f"cast({tp} as bigint)",
        "first_person_singular_ratio": ratio(fs, tot),
        "first_person_plural_ratio": ratio(fp, tot),
        "second_person_ratio": ratio(sp, tot),
        "third_person_ratio": ratio(tp, tot),
    }


def feature_cols(x: str, toks: str, tg: str, lex: Lexicon) -> dict[str, str]:
    """D9's 17 features."""
    pr = pronoun_cols(toks, lex)
    return {
        "num_nouns": f"cast({count_in(tg, NOUN_TAGS)} as bigint)",
        "num_verbs": f"cast({count_in(tg, VERB_TAGS)} as bigint)",
        "num_adverbs": f"cast({count_in(tg, ADVERB_TAGS)} as bigint)",
        **{k: v for k, v in pr.items() if k.endswith("pronouns")},
        **pos_ratio_cols(toks, tg),
        **{k: v for k, v in pr.items() if k.endswith("ratio")},
        "readability_score": fk_grade(x, toks),
        "keyword_score": keyword(x, lex.keywords),
        "text_length": f"cast(len({toks}) as bigint)",
    }
