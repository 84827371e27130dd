"""Grammar lexicons, inflection rules, tag patterns, quotas and the shape table.

Everything here is small, bounded by the grammar (never by the data), and is
turned into literal Spark expressions (maps / arrays) or tiny broadcast
DataFrames by the operators.  The word lists are the experiment's fixed
values; they must stay exactly as they are for results to line up with the
published stimulus grammars.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

# --------------------------------------------------------------------------
# Fixed values (must equal the experiment's grammars verbatim).
# --------------------------------------------------------------------------

# Sampling grammar "en_RC_PP": nouns (sg, pl), past-tense verbs, prepositions.
RC_PP_NOUNS_SG = [
    "student", "professor", "headmaster", "friend", "assistant",
    "dean", "advisor", "colleague", "president", "chancellor",
]
RC_PP_NOUNS_PL = [
    "students", "professors", "headmasters", "friends", "assistants",
    "deans", "advisors", "colleagues", "presidents", "chancellors",
]
RC_PP_VERBS_PAST = [
    "helped", "visited", "liked", "bothered", "inspired",
    "recruited", "assisted", "confounded", "accosted", "avoided",
]
RC_PP_PREPS = ["of", "near", "by", "behind", "with"]

# Sampling grammar "en_RC_PP_gen" (held-out vocabulary).
RC_PP_GEN_NOUNS_SG = [
    "house", "shed", "tree", "machine", "building",
    "church", "office", "motel", "barn", "shack",
]
RC_PP_GEN_NOUNS_PL = [
    "houses", "sheds", "trees", "machines", "buildings",
    "churches", "offices", "motels", "barns", "shacks",
]
RC_PP_GEN_VERBS_PAST = [
    "blocked", "dwarfed", "overlooked", "faced", "predated",
    "eclipsed", "concealed", "shaded", "overshadowed", "adjoined",
]
RC_PP_GEN_PREPS = ["beside", "near", "by", "behind", "around"]

DETERMINER = "the"
COMPLEMENTIZER = "that"
EOS = "[EOS]"

# Verbs whose present forms end in "es" (sg) / "e" (pl) instead of "s" / "".
E_FINAL_VERBS = ["liked", "inspired", "faced", "predated", "eclipsed", "shaded"]

# Parse grammar "en_FVN_02" (Franck, Vigliocco & Nicol 2002 items).
FVN_DETERMINERS = ["the", "my"]
FVN_COMPOUND_PARTS = ["real", "estate"]
FVN_NOUNS_SG = [
    "advertisement", "office", "agent", "announcement", "director", "foundation", "letter",
    "article", "writer", "magazine", "author", "speech", "city", "computer", "cousin", "program",
    "experiment", "contract", "actor", "film", "discussion", "topic", "paper", "dog",
    "path", "lake", "friend", "editor", "gift", "daughter", "visitor", "helicopter",
    "flight", "canyon", "lesson", "government", "country", "manual", "developer", "machine",
    "mast", "deck", "yacht", "meal", "guest", "inn-keeper", "museum", "picture", "poet",
    "design", "engine", "plane", "payment", "service", "school", "photo", "girl", "baby",
    "post", "support", "platform", "prescription", "doctor", "clinic", "producer", "movie",
    "artist", "publisher", "book", "king", "setting", "astronomer", "statue", "garden",
    "mansion", "switch", "light", "stairway", "telegram", "soldier", "threat", "president",
    "company", "tour", "monument", "train", "truck", "bridge", "stream",
]
FVN_NOUNS_PL = [
    "advertisements", "offices", "agents", "announcements", "directors", "foundations", "letters",
    "articles", "writers", "magazines", "authors", "speeches", "cities", "computers", "cousins",
    "programs", "experiments", "contracts", "actors", "films", "discussions", "topics", "papers",
    "dogs", "paths", "lakes", "friends", "editors", "gifts", "daughters", "visitors", "helicopters",
    "flights", "canyons", "lessons", "governments", "countries", "manuals", "developers",
    "machines", "masts", "decks", "yachts", "meals", "guests", "inn-keepers", "museums", "pictures",
    "poets", "designs", "engines", "planes", "payments", "services", "schools", "photos", "girls",
    "babies", "posts", "supports", "platforms", "prescriptions", "doctors", "clinics", "producers",
    "movies", "artists", "publishers", "books", "kings", "settings", "astronomers", "statues",
    "gardens", "mansions", "switches", "lights", "stairways", "telegrams", "soldiers", "threats",
    "presidents", "companies", "tours", "monuments", "trains", "trucks", "bridges", "streams",
]
FVN_VERBS = ["seem", "seems"]
FVN_PREPS = ["from", "of", "by", "for", "about", "with", "in", "on", "around", "over", "to", "near"]
FVN_ADJECTIVES = [
    "colorful", "important", "confusing", "young", "available", "acceptable", "boring",
    "happy", "blonde", "expensive", "safe", "interesting", "emotional", "comprehensible",
    "sturdy", "delicious", "open", "successful", "blurry", "solid", "ready", "famous",
    "wealthy", "appropriate", "impressive", "hidden", "unexpected", "serious", "disappointing",
    "crowded", "noisy", "new",
]

# Parse grammar "en_VN_98" (Vigliocco & Nicol 1998 items; questions).
VN_NOUNS_SG = [
    "advertisement", "announcement", "article", "author", "bill", "computer",
    "contract", "crowd", "deck", "discussion", "friend", "gift", "helicopter",
    "lesson", "letter", "manual", "meal", "museum", "design", "engine",
    "path", "photo", "prescription", "producer", "publisher", "statue", "support",
    "switch", "telegram", "threat", "tour", "train", "truck", "bridge",
    "club", "director", "writer", "speech", "accountant", "program", "actor",
    "street", "yacht", "topic", "editor", "baby", "flight", "government",
    "machine", "guest", "picture", "lake", "girl", "doctor", "movie", "book",
    "garden", "platform", "light", "soldier", "president", "city",
]
VN_NOUNS_PL = [
    "advertisements", "announcements", "articles", "authors", "bills", "computers", "contracts",
    "crowds", "decks", "discussions", "friends", "gifts", "helicopters", "lessons", "letters",
    "manuals", "meals", "museums", "designs", "engines", "paths", "photos", "prescriptions",
    "producers", "publishers", "statues", "supports", "switches", "telegrams", "threats", "tours",
    "trains", "trucks", "bridges", "clubs", "directors", "writers", "speeches", "accountants",
    "programs", "actors", "streets", "yachts", "topics", "editors", "babies", "flights",
    "governments", "machines", "guests", "pictures", "lakes", "girls", "doctors", "movies", "books",
    "gardens", "platforms", "lights", "soldiers", "presidents", "cities",
]
VN_VERBS = ["do", "does", "seem"]
VN_PREPS = ["from", "by", "of", "with", "for", "in", "about", "around", "to", "on"]
VN_ADJECTIVES = [
    "colorful", "important", "confusing", "young", "reasonable", "available",
    "acceptable", "restless", "spacious", "boring", "blonde", "expensive", "safe",
    "interesting", "emotional", "comprehensible", "delicious", "open", "successful",
    "scenic", "blurry", "ready", "famous", "wealthy", "impressive", "solid",
    "hidden", "unexpected", "serious", "disappointing", "crowded", "noisy", "new",
]

# Acceptance patterns over one-letter tags (full match).  Tags:
# D det, N noun, P prep, C 'that', V verb, A adjective, K compound part, E [EOS].
TAG_PATTERNS = {
    "en_RC_PP": r"DN(PDN|CVDN|CVE)*V(DN(PDN|CVDN|CVE)*|E)",
    "en_RC_PP_gen": r"DN(PDN|CVDN|CVE)*V(DN(PDN|CVDN|CVE)*|E)",
    "en_FVN_02": r"D(KKN|AN|N)(PD(KKN|AN|N))*V(A|E)",
    "en_VN_98": r"V(A|E)?D(AN|N)(PD(AN|N))*V(A|E)?",
}

# Balanced test set: target count per condition (head + interveners number,
# then each intervener's own structure).
BALANCED_QUOTAS = {
    "S": 64, "P": 64,
    "SS_RC": 256, "SP_RC": 256, "PP_RC": 256, "PS_RC": 256,
    "SS_PP": 256, "SP_PP": 256, "PP_PP": 256, "PS_PP": 256,
    "SSS_PP_PP": 256, "SSP_PP_PP": 256, "SPS_PP_PP": 256, "SPP_PP_PP": 256,
    "PPP_PP_PP": 256, "PPS_PP_PP": 256, "PSP_PP_PP": 256, "PSS_PP_PP": 256,
    "SSS_RC_RC": 256, "SSP_RC_RC": 256, "SPS_RC_RC": 256, "SPP_RC_RC": 256,
    "PPP_RC_RC": 256, "PPS_RC_RC": 256, "PSP_RC_RC": 256, "PSS_RC_RC": 256,
    "SSS_PP_RC": 256, "SSP_PP_RC": 256, "SPS_PP_RC": 256, "SPP_PP_RC": 256,
    "PPP_PP_RC": 256, "PPS_PP_RC": 256, "PSP_PP_RC": 256, "PSS_PP_RC": 256,
    "SSS_RC_PP": 256, "SSP_RC_PP": 256, "SPS_RC_PP": 256, "SPP_RC_PP": 256,
    "PPP_RC_PP": 256, "PPS_RC_PP": 256, "PSP_RC_PP": 256, "PSS_RC_PP": 256,
}

# Models of the experiment grid.
MODELS = [
    "google/t5-efficient-tiny", "google/t5-efficient-mini",
    "google/t5-efficient-small", "google/t5-efficient-base",
    "google/t5-efficient-base-dl2", "google/t5-efficient-base-dl4",
    "google/t5-efficient-base-dl6", "google/t5-efficient-base-dl8",
    "google/t5-efficient-base-el2", "google/t5-efficient-base-el4",
    "google/t5-efficient-base-el6", "google/t5-efficient-base-el8",
    "google/t5-efficient-base-nl2", "google/t5-efficient-base-nl4",
    "google/t5-efficient-base-nl8",
    "google/t5-efficient-mini-nl6", "google/t5-efficient-mini-nl8",
    "google/t5-efficient-mini-nl12", "google/t5-efficient-mini-nl24",
    "babyt5-1m", "c4-1m", "wikit5-1m", "simplewiki-1m", "babyt5-5m",
    "c4-10m", "c4-100m", "wikit5-10m", "wikit5-100m", "simplewiki-10m", "simplewiki-100m",
    "c4-100m_withchildes", "c4-1b", "wikit5-100m_withchildes", "wikit5-1b",
]

# Dataset configuration: lang -> dataset -> (p(pres), {split: n}, generator).
DATASET_CONFIG = {
    "en_RC_PP": {
        "nodist-pres-and-past": (0.5, {"train": 100000, "dev": 1000, "test": 10000}, "pres_or_past_no_pres_dist"),
        "dist-pres": (1.0, {"test": 10000}, "pres_or_past"),
    },
    "en_RC_PP_gen": {
        "dist-pres": (1.0, {"test": 10000}, "pres_or_past"),
    },
    "en_RC_PP_sm": {
        "nodist-pres-and-past": (0.5, {"train": 10000, "dev": 1000}, "pres_or_past_no_pres_dist"),
    },
}
DATASET_GRAMMAR = {"en_RC_PP": "en_RC_PP", "en_RC_PP_gen": "en_RC_PP_gen", "en_RC_PP_sm": "en_RC_PP"}
DATASET_PAIRS = [
    ("en_RC_PP-nodist-pres-and-past", "en_RC_PP-dist-pres"),
    ("en_RC_PP-nodist-pres-and-past", "en_RC_PP_gen-dist-pres"),
    ("en_RC_PP_sm-nodist-pres-and-past", "en_RC_PP-dist-pres"),
    ("en_RC_PP_sm-nodist-pres-and-past", "en_RC_PP_gen-dist-pres"),
]

MAX_SENTENCE_WORDS = 15      # generation length cap
MAX_PARSE_WORDS = 20         # scoring: words considered before parsing
MODIFIER_PROB = 0.1          # NP -> NP PP and NP -> NP CP each
NOUN_PROB = 0.8              # NP -> N

# --------------------------------------------------------------------------
# Rules
# --------------------------------------------------------------------------


def inflect(past: str, number: str) -> str:
    """Present-tense form of a regular past verb for a subject number."""
    ending = ("es" if number == "sg" else "e") if past in E_FINAL_VERBS else ("s" if number == "sg" else "")
    return past.removesuffix("ed") + ending if past.endswith("ed") else past


@dataclass(frozen=True)
class SamplingGrammar:
    lang: str
    nouns_sg: tuple
    nouns_pl: tuple
    verbs: tuple
    preps: tuple


SAMPLING_GRAMMARS = {
    "en_RC_PP": SamplingGrammar("en_RC_PP", tuple(RC_PP_NOUNS_SG), tuple(RC_PP_NOUNS_PL),
                                tuple(RC_PP_VERBS_PAST), tuple(RC_PP_PREPS)),
    "en_RC_PP_gen": SamplingGrammar("en_RC_PP_gen", tuple(RC_PP_GEN_NOUNS_SG), tuple(RC_PP_GEN_NOUNS_PL),
                                    tuple(RC_PP_GEN_VERBS_PAST), tuple(RC_PP_GEN_PREPS)),
}


@dataclass
class ParseLexicon:
    """word -> (tag letter, number or None) for one parse grammar."""
    lang: str
    entries: dict = field(default_factory=dict)

    def add(self, words, tag, number=None):
        for w in words:
            self.entries[w] = (tag, number)

    def rows(self):
        return [(self.lang, w, t, n) for w, (t, n) in sorted(self.entries.items())]


def _rc_pp_parse_lexicon(lang: str) -> ParseLexicon:
    g = SAMPLING_GRAMMARS[lang]
    lex = ParseLexicon(lang)
    lex.add([DETERMINER], "D")
    lex.add(g.nouns_sg, "N", "sg")
    lex.add(g.nouns_pl, "N", "pl")
    # every verb in its past, singular-present and plural-present form
    lex.add([f for v in g.verbs for f in (v, inflect(v, "sg"), inflect(v, "pl"))], "V")
    lex.add(g.preps, "P")
    lex.add([COMPLEMENTIZER], "C")
    lex.add([EOS], "E")
    return lex


def _fvn_parse_lexicon() -> ParseLexicon:
    lex = ParseLexicon("en_FVN_02")
    lex.add(FVN_DETERMINERS, "D")
    lex.add(FVN_COMPOUND_PARTS, "K")
    lex.add(FVN_NOUNS_SG, "N", "sg")
    lex.add(FVN_NOUNS_PL, "N", "pl")
    lex.add(FVN_VERBS, "V")
    lex.add([EOS], "E")
    lex.add(FVN_PREPS, "P")
    lex.add(FVN_ADJECTIVES, "A")
    return lex


def _vn_parse_lexicon() -> ParseLexicon:
    lex = ParseLexicon("en_VN_98")
    lex.add([DETERMINER], "D")
    lex.add(VN_NOUNS_SG, "N", "sg")
    lex.add(VN_NOUNS_PL, "N", "pl")
    lex.add(VN_VERBS, "V")
    lex.add([EOS], "E")
    lex.add(VN_PREPS, "P")
    lex.add(VN_ADJECTIVES, "A")
    return lex


PARSE_LEXICONS = {
    "en_RC_PP": _rc_pp_parse_lexicon("en_RC_PP"),
    "en_RC_PP_gen": _rc_pp_parse_lexicon("en_RC_PP_gen"),
    "en_FVN_02": _fvn_parse_lexicon(),
    "en_VN_98": _vn_parse_lexicon(),
}
SUPPORTED_LANGS = list(PARSE_LEXICONS)


def lexicon_rows(langs=None):
    """(lang, word, tag, number) rows of the parse lexicons."""
    langs = langs or SUPPORTED_LANGS
    return [r for lang in langs for r in PARSE_LEXICONS[lang].rows()]


# --------------------------------------------------------------------------
# Shape table: the weighted grammar flattened to sentence shapes.
# --------------------------------------------------------------------------

def catalan(n: int) -> int:
    return math.comb(2 * n, n) // (n + 1)


def _mod_words(mod: str) -> int:
    return 3 if mod == "P" else 4          # P D N  /  C V D N


def _mod_tags(mod: str) -> str:
    return "PDN" if mod == "P" else "CVDN"


@dataclass(frozen=True)
class Shape:
    shape_id: int
    subj_mods: str      # e.g. "PR": a PP then a relative clause on the subject
    obj_mods: str
    weight: int
    lo: int
    hi: int
    template: str       # one tag letter per word
    verb_pos: int       # 0-based position of the main verb


def build_shapes(max_words: int = MAX_SENTENCE_WORDS):
    """All subject/object modifier sequences that fit in ``max_words``.

    A DP with m modifiers (PP or RC, in linear order) has Catalan(m) bracketings,
    each with probability 0.8^(m+1) * 0.1^m.  Scaled by 10^8 every weight is an
    integer, so sampling is an exact integer range lookup; a word cap that lets
    in more modifiers than that scale can hold is an error.
    """
    shapes = []
    most = max(0, (max_words - 5) // 3)            # a modifier has at least 3 words
    if most > 3:
        raise ValueError(f"weights of {most} modifiers are not integral at this scale; {max_words} words allow them")
    for n_mods in range(most + 1):
        for a in range(n_mods, -1, -1):
            b = n_mods - a
            for subj in itertools.product("PR", repeat=a):
                for obj in itertools.product("PR", repeat=b):
                    words = 5 + sum(_mod_words(m) for m in subj + obj)
                    if words > max_words:
                        continue
                    weight = catalan(a) * catalan(b) * 8 ** (n_mods + 2) * 10 ** (6 - 2 * n_mods)
                    tmpl = "DN" + "".join(_mod_tags(m) for m in subj) + "V" + "DN" + "".join(_mod_tags(m) for m in obj)
                    shapes.append(("".join(subj), "".join(obj), weight, tmpl, 2 + sum(_mod_words(m) for m in subj)))
    out, lo = [], 0
    for i, (s, o, w, t, vp) in enumerate(shapes, start=1):
        out.append(Shape(i, s, o, w, lo, lo + w, t, vp))
        lo += w
    return out


SHAPES = build_shapes()
SHAPE_TOTAL = SHAPES[-1].hi     # 94,507,008 for the 15-word cap
