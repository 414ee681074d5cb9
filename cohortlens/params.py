"""Parameters: group lists, weights, lexicons.

Everything is a frozen dataclass so an analysis states its own settings; the
defaults below are the values the original study used.  Tests and the fixture
queries pass the fixture settings (``FIXTURE_*``) because the synthetic words in
the test tables never match an English lexicon.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must equal the original study's settings; stated as given).
# ---------------------------------------------------------------------------
STUDY_SW_COMMUNITIES = ("SuicideWatch",)
STUDY_MH_COMMUNITIES = (
    "depression", "mentalhealth", "traumatoolbox", "BipolarReddit",
    "BPD", "ptsd", "psychoticreddit", "EatingDisorders", "StopSelfHarm",
    "survivorsofabuse", "rapecounseling", "hardshipmates",
    "panicparty", "socialanxiety",
)
STUDY_KEYWORDS = ("depression", "suicide", "anxiety", "suicidal", "can't")
STUDY_FIRST_SINGULAR = ("i", "me", "my", "mine", "myself")
STUDY_FIRST_PLURAL = ("we", "us", "our", "ours", "ourselves")
STUDY_SECOND_PERSON = ("you", "your", "yours", "yourself", "yourselves")
NOUN_TAGS = ("NN", "NNS", "NNP", "NNPS")
VERB_TAGS = ("VB", "VBD", "VBG", "VBN", "VBP", "VBZ")
ADVERB_TAGS = ("RB", "RBR", "RBS")
PRONOUN_TAGS = ("PRP", "PRP$")
SENTINEL_AUTHOR = "[deleted]"
SENTINEL_TEXTS = ("[removed]", "[deleted]")
EMOTION_LABELS = ("anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise")
GROUP_ORDER = ("SW", "MH", "Otr")
# allowed (cohort, community group) pairs of the language sample
SAMPLE_PAIRS = (("SW", "SW"), ("SW", "MH"), ("SW", "Otr"), ("MH", "MH"), ("MH", "Otr"), ("Otr", "Otr"))
# end of fixed values


@dataclass(frozen=True)
class Groups:
    """Community -> group mapping.  MH is tested before SW (case-sensitive)."""
    sw: tuple = STUDY_SW_COMMUNITIES
    mh: tuple = STUDY_MH_COMMUNITIES
    sw_label: str = "SW"
    mh_label: str = "MH"
    other_label: str = "Otr"

    @property
    def labels(self) -> tuple:
        return (self.sw_label, self.mh_label, self.other_label)


@dataclass(frozen=True)
class Lexicon:
    """Word lists for the language features."""
    first_singular: tuple = STUDY_FIRST_SINGULAR
    first_plural: tuple = STUDY_FIRST_PLURAL
    second_person: tuple = STUDY_SECOND_PERSON
    third_person: tuple = ()          # empty: every other pronoun is 3rd person
    keywords: tuple = STUDY_KEYWORDS
    stop_words: tuple = ()
    # built-in tagger: exact pronoun list -> PRP, then suffix rules in order
    pronouns: tuple = STUDY_FIRST_SINGULAR + STUDY_FIRST_PLURAL + STUDY_SECOND_PERSON
    suffix_tags: tuple = (("tion", "NN"), ("ing", "VBG"), ("ly", "RB"))
    default_tag: str = "XX"
    # compound sentiment lexicon (word, valence)
    valence: tuple = ()


@dataclass(frozen=True)
class PosScoreWeights:
    """D8 weights (noun ratio, first-person share of words, keyword, length)."""
    noun_ratio: float = -1.5
    first_person_singular_ratio: float = 1.0
    keyword_score: float = 2.0
    text_length: float = 0.005


@dataclass(frozen=True)
class LengthScoreWeights:
    """Only names containing 'ratio' take part, each divided by length."""
    weights: tuple = (
        ("noun_ratio", -1.5), ("verb_ratio", 0.0), ("adverb_ratio", 0.0),
        ("first_person_singular_ratio", 1.0), ("first_person_plural_ratio", 0.0),
        ("second_person_ratio", 0.0), ("third_person_ratio", 0.0),
        ("readability_score", 0.0), ("keyword_score", 2.0), ("text_length", 0.005),
    )


@dataclass(frozen=True)
class InteractionWeights:
    """D14/D15 reply and post interaction scores."""
    reply_weight: float = 3.0
    repeat_multiplier: float = 9.0
    post_score_weight: float = 0.5
    post_comment_weight: float = 0.5
    zero_reply: float = 2.0       # writing version: reply score 0 -> 2
    zero_post: float = -0.5       # writing version: post score 0 -> -0.5


@dataclass(frozen=True)
class CommWeights:
    """D12 communication score and W5 clip."""
    interactions: float = 1.0
    partners: float = 2.0
    groups: float = 3.0
    clip_quantile: float = 0.90


@dataclass(frozen=True)
class TimeScore:
    decay_rate: float = 0.05          # D11
    threshold_ratio: float = 0.5      # D13
    min_time_based: float = 0.01      # D13


@dataclass(frozen=True)
class RankWeights:
    post_weight: float = 2.0
    reply_weight: float = 1.0
    top_n: int = 500
    descending: bool = False
    # D18 component weights and normalisation ranges
    components: tuple = (("sentiment", 50.0), ("pos", 0.0), ("graph", 0.0), ("time_based", 0.0))
    norm_ranges: tuple = (("sentiment", (0.0, 1.0)), ("pos", (0.0, 1.0)),
                          ("graph", (0.0, 1.0)), ("time_based", (0.0, 1.0)))


STUDY_GROUPS = Groups()
STUDY_LEXICON = Lexicon()

# ---------------------------------------------------------------------------
# Fixture settings for the synthetic test tables (see FIXTURES.md).
# ---------------------------------------------------------------------------
FIXTURE_GROUPS = Groups(sw=("1-URGENT/F",), mh=("1-URGENT/O", "2-HIGH/F"))
FIXTURE_EV_GROUPS = Groups(sw=("error",), mh=("purchase",))
FIXTURE_LEXICON = Lexicon(
    first_singular=("it",), first_plural=("this",), second_person=("that",), third_person=("he",),
    keywords=("thatin", "blees", "hehely"),
    stop_words=("the", "of", "and", "to", "a", "in", "is"),
    pronouns=("it", "this", "that", "he"),
    suffix_tags=(("tion", "NN"), ("ing", "VBG"), ("ly", "RB")),
    default_tag="XX",
    valence=(("the", 1.0), ("of", -0.5), ("and", 0.25), ("to", -0.75)),
)
