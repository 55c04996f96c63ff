"""Word lists for the registered queries.

The given corpus is invented prose, so the market lists of the library hardly match it.
These lists use frequent words of the corpus; every branch then meets real rows.
"""

ARTIFACT = {
    "codes": ("en", "de", "la"),
    "navigation": ("la de", "und die", "el de", "les de"),
    "auth_terms": ("que", "anea"),
    "switches": ("en de", "de la", "la en"),
    "leads": ("les", "los", "der", "thanedble"),
    "switch_codes": ("en", "de", "la"),
    "prepositions": ("que", "les", "der", "los"),
    "artifact_tokens": ("en", "de", "la", "que", "les", "der", "los", "una", "ther"),
}
STOP_PHRASE = {
    "prefixes": ("que", "les", "des", "con", "der"),
    "geo_tokens": ("de", "la", "en", "el", "die", "le"),
    "fillers": ("une", "los", "un"),
}
NEGATIVE = ("nicht", "anea", "rewh", "ononst", "thble", "avec")
INVALID_STARTS = ("und", "que", "les", "das")
CONFLICT = {
    "cities": ("ouan", "thre", "ther", "anea", "erst", "heit", "de la"),
    "connectors": ("la", "und", "the", "de"),
}
MOVED_PHRASE = "de la"
PHRASE = {
    "navigation": ("la de la", "les de la", "und die und"),
    "prepositions": ("de", "en", "der", "des", "la"),
    "common_words": ("que", "les", "una", "el", "la", "de", "die", "los", "le"),
    "temporal_names": ("die", "das", "est", "los"),
}
BLACKLIST = ("thth", "ouou", "Erst")
QUESTION_LEADS = ("que", "les", "der", "ther", "thre")
UNIVERSAL_DEFAULTS = ("que", "der", "all rights reserved", "anea")
UNIVERSAL_THRESHOLD = 0.3

PROTECTED = ("of the", "in the", "de la", "to the the", "und die", "en la")

INTENT_RULES = {
    "informational": ("que", "anea", "thanedble the"),
    "commercial": ("les", "thble", "rewh"),
    "transactional": ("der", "attion to"),
    "navigational": (),
    "direct_answer": ("de la", "los de"),
    "local": ("los", "en la", "thre"),
}
INTENT_SIGNALS = {
    "commercial": ("und", "erst"),
    "transactional": ("nicht", "dans"),
    "informational": ("pour", "sich"),
}
COMPETITORS = ("ereden.example.com", "thor.example.org", " ")

QUERY_PATTERNS = {
    "direct_answer": (r"^the\b", r"^que\b", r"\bof the of\b"),
    "complex_research": (r"\bis\b.*that", r"\bfactors\b", r"^der\b"),
    "comparative": (r"\bund die\b", r"\bor\b(?=.*\bthe\b)", r"\bbetter\b"),
    "tutorial": (r"^la\b", r"\bguide\b", r"\bque les\b"),
    "list": (r"^of\b", r"^and\s+\p{L}+ing\b", r"\bde la\b"),
    "definition": (r"^is\b", r"\bin the\b"),
}
QUERY_LOCALES = {"data": {"local": (r"\bnear me\b", r"\ben el\b", r"\band the\b")}}

TRUST_LOCALES = {
    "data": {
        "experience": ((r"\bthe of\b", "The of"), (r"\bque\b", "Que"), (r"\bin\s+the\b", "In the")),
        "expertise": ((r"\bthe and\b", "The and"), (r"\bder\b", "Der"), (r"\blicens[ez]\b", "Licence")),
        "authority": ((r"\ball rights\b", "Rights"), (r"\bis the\b", "Is the"), (r"\bund\b", "Und")),
        "trust": ((r"\bto the\b", "To the"), (r"\bla\s+(?:de|le)\b", "La de"), (r"\bthat\b", "That")),
    }
}

HEAD_TERMS = ("ther", "que")
SERP_TRIGGERS = (
    ("knowledge_panel", ("que", "anea")),
    ("featured_snippet", ("ther", "de la")),
    ("instant_answer", ("ononst", "erst")),
    ("local_pack", ("les ", "thre")),
    ("video_carousel", ("ther", "und")),
    ("shopping_results", ("der", "attion")),
)
TRIGGERS = {
    "commercial": ("les", "que", "ther", "und", "los"),
    "transactional": ("thre", "de la", "der "),
    "b2b": ("die", "la", "anea"),
    "local": ("est", "ou"),
}
GOALS = "leads and traffic"

SERVICE = ("que", "ther", "les")
PRODUCT = ("der", "anea")
TRADES = ("la", "los")
GOODS = ("de", "und")

ENTITY_STOPWORDS = ("de", "la", "the", "and", "of", "to", "der", "en")
NAME_STOPWORDS = ("que", "les", "the", "der")
TOPIC_STOPWORDS = ("que", "les", "the", "der", "los", "die", "das")

TERMS = (
    ("thanedble", "غرفة", ("غرفه", "اوضة")),
    ("anea", "أفضل", ()),
    ("que", "كيف", ("كيفه",)),
    ("der", "شراء", ()),
    ("thre", "مبنى", ()),
    ("les", "صيانة", ("صيانه",)),
    ("and", "في", ()),
)
LOCATIONS = (("la", "منطقة"), ("en", "في"), ("erst", "دبي"), ("de la", "حي"))
KEY_LOCATIONS = ("la", "erst", "nowhere")

GAZETTEER = (
    ("alias", "attion", "Region A", "Region A", None),
    ("alias", "ouan", "Region B", "Region B", None),
    ("emirate", "thanedble", "Region C", "Region C", None),
    ("emirate", "anea", "Region A", "Region A", None),
    ("emirate", "que", "Region D", "Region D", None),
    ("district", "de la", "De La", "Region B", "mixed"),
    ("district", "les", "Les", "Region D", "residential"),
    ("district", "thre", "Thre", "Region A", "commercial"),
    ("landmark", "ther", "Ther", "Region C", "landmark"),
    ("landmark", "der", "Der", "Region E", "event"),
    ("free_zone", "und", "UND", "Region E", "logistics"),
    ("free_zone", "ele", "ELE", "Region B", None),
    ("government", "rewh", "Rewh Office", "Region A", "government"),
    ("government", "los", "LOS", None, "utility"),
    ("certification", "erst", "ERST", "Region F", "certification"),
    ("certification", "ing", "ING", None, "certification"),
    ("legal", "die", "Die", "Region F", "document"),
    ("legal", "ble", "Ble", None, "permit"),
    ("construction", "on", "On", None, "trade"),
)
REGIONS = (("region-c", "Region C"), ("region-b", "Region B"), ("region-d", "Region D"))
