"""Default word lists, weights and patterns.

Everything in this module is a *fixed value*: results depend on the exact
content, so the values are written out plainly. Each operator takes its list as
an argument, so a deployment can replace any of them with its own table.
"""

from __future__ import annotations

# --- fixed values: stopwords --------------------------------------------------
ENGLISH_STOPWORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his
    himself she her hers herself it its itself they them their theirs themselves what
    which who whom this that these those am is are was were be been being have has had
    having do does did doing a an the and but if or because as until while of at by for
    with about against between into through during before after above below to from up
    down in out on off over under again further then once here there when where why how
    all each few more most other some such no nor not only own same so than too very s t
    can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn
    haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn
    """.split()
)

ARABIC_STOPWORDS = tuple(
    """
    ال أنا انا نحن أنت انت هو هي هم هن هذا هذه هؤلاء ذلك تلك الذي التي الذين ما من في على
    إلى الى عن مع ب ل ك بين فوق تحت عند منذ خلال حتى و أو او ثم لكن إذا اذا إن ان أن لو بل
    حيث كي ف أين اين كيف متى لماذا ماذا أي اي هنا هناك الآن قد سوف لن لم ليس كان كانت يكون
    هل كل بعض جميع غير مثل نفس فقط شو ليش وين
    """.split()
)

GULF_TRANSLITERATIONS = (
    "yani", "yalla", "habibi", "inshallah", "mashallah", "khalas", "mafi", "shway",
)

BILINGUAL_LANGUAGES = ("ar-en", "bilingual", "ae", "uae")


def stopwords(language: str = "en") -> tuple[str, ...]:
    """Stopword list of a language code; unknown codes give English."""
    code = language.lower().strip()
    if code == "ar":
        return ARABIC_STOPWORDS
    if code in BILINGUAL_LANGUAGES:
        return ENGLISH_STOPWORDS + ARABIC_STOPWORDS + GULF_TRANSLITERATIONS
    return ENGLISH_STOPWORDS


# --- fixed values: phrases kept together while n-grams form ---------------------
PROTECTED_PHRASES = (
    "abu dhabi", "ras al khaimah", "umm al quwain",
    "al reem island", "yas island", "saadiyat island", "khalifa city",
    "mohamed bin zayed city", "al ain", "al maryah island",
    "palm jumeirah", "dubai marina", "business bay", "downtown dubai",
    "jumeirah beach residence", "jumeirah lake towers",
    "near me", "fit out", "turn key", "real estate",
)

# --- fixed values: keyword filters ---------------------------------------------
MARKET_CODES = ("en", "ae", "ar", "uae")
ARTIFACT_TOKENS = (
    "en", "ae", "ar", "uae", "vs", "for", "near", "me",
    "best", "how", "what", "where", "when", "why", "which",
)
NAVIGATION_EXACT = (
    "en", "ae", "ar", "uae", "login", "sign in", "sign up", "register", "menu", "home",
    "contact", "about", "privacy policy", "terms of service", "cookie", "cookies",
    "subscribe", "newsletter",
)
AUTH_TERMS = ("login", "sign in", "sign up", "register")
LANGUAGE_SWITCHES = ("en ae", "ae en", "ar en", "uae en", "en uae", "ar ae")
QUERY_LEADS = ("vs", "for", "near me", "best", "how", "what", "where", "when", "why", "which")
SWITCH_CODES = ("en", "ae", "ar")
CODE_PREPOSITIONS = ("in", "from", "to", "for", "of")

STOP_PHRASE_PREFIXES = (
    "for", "in", "at", "on", "to", "from", "with", "by", "of",
    "how", "what", "where", "when", "why", "which", "who",
)
GEO_TOKENS = (
    "uae", "dubai", "abu", "dhabi", "sharjah", "ae", "en", "ar",
    "ajman", "fujairah", "khaimah", "ras",
)
STOP_PHRASE_FILLERS = ("to", "the", "a", "an")

NEGATIVE_TERMS = (
    "scam", "scams", "scammer", "scammers", "fraud", "fraudulent", "frauds",
    "complaint", "complaints", "fake", "fakes", "illegal", "illegally",
    "fine", "fines", "fined", "violation", "violations", "lawsuit", "lawsuits", "sued",
    "scandal", "scandals", "ripoff", "rip-off", "rip off", "warning", "warnings",
    "avoid", "avoided", "worst", "terrible", "horrible",
    "failed", "failure", "failures", "bankrupt", "bankruptcy",
)

INVALID_STARTS = ("vs", "versus", "or", "and", "but", "nor", "yet")
VALID_STARTS = ("how", "what", "where", "when", "why", "which", "who", "best", "top", "for")
INVALID_START_TAGS = ("CC", "IN", "DT", "TO", "EX", "WDT", "WP", "WP$", "WRB")
NOUN_RUN_STARTS = ("vs", "versus", "best", "top", "compare")
PATTERN_STARTS = ("how", "what", "where", "for")
NOUN_TAGS = ("NN", "NNS", "NNP", "NNPS")
OTHER_THAN_NOUNS = ("VERB", "ADJ", "ADV", "ADP", "DET", "PRON")
LINKING_PREPOSITIONS = ("in", "for", "to", "of", "with")
MOST_NOUNS = 3

CONFLICT_CITIES = (
    "dubai", "abu dhabi", "sharjah", "ajman", "fujairah",
    "ras al khaimah", "umm al quwain", "al ain",
)
CONFLICT_CONNECTORS = ("to", "vs", "versus", "or", "and", "from")

TEMPORAL_NAMES = (
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
)
NAVIGATION_PHRASES = (
    "step by step", "read more", "click here", "learn more", "see more", "view more",
    "show more", "get started", "sign up", "log in", "login", "signup", "subscribe",
    "download now", "buy now", "add to cart", "checkout", "continue reading",
    "next page", "previous page", "skip to content", "jump to content",
    "main content", "next article", "previous article",
)
DANGLING_PREPOSITIONS = (
    "of", "to", "for", "with", "in", "on", "at", "by", "from", "about", "into",
    "through", "during", "before", "after", "above", "below", "between", "under",
    "over", "without",
)
COMMON_WORDS = tuple(
    """
    the a an and or but is are was were be been being have has had do does did will
    would could should may might must can very good bad best worst more less most least
    quickly slowly well fast now then here there
    """.split()
)

UNIVERSAL_TERMS = (
    "login", "sign in", "sign up", "register", "password", "cookie", "cookies",
    "privacy", "privacy policy", "terms", "terms of service", "copyright",
    "all rights reserved", "home", "about", "contact", "menu", "footer", "header",
    "subscribe", "newsletter", "follow us", "share",
)

QUESTION_LEADS = ("how", "what", "why", "when", "where", "which", "who", "can", "does", "is")
QUESTION_WORDS = ("how", "what", "why", "when", "where", "which", "who")

# --- fixed values: seeds --------------------------------------------------------
SERVICE_TERMS = (
    "company", "companies", "contractor", "contractors", "service", "services",
    "agency", "agencies", "firm", "firms", "consultant", "consultants", "provider",
    "providers", "specialist", "specialists", "builder", "builders", "construction",
    "contracting", "renovation", "maintenance", "repair", "installation",
)
PRODUCT_TERMS = (
    "equipment", "material", "materials", "tools", "supplies", "machine", "machines",
    "product", "products", "item", "items", "software", "hardware", "device", "devices",
)
SERVICE_TRADES = (
    "contracting", "consulting", "design", "architecture", "engineering", "cleaning",
    "landscaping", "plumbing", "electrical", "painting", "flooring", "roofing", "hvac",
    "moving", "legal", "accounting",
)
PRODUCT_GOODS = (
    "coffee", "beans", "furniture", "clothes", "electronics", "appliances", "parts",
    "accessories",
)
SEED_TEMPLATES = (
    "how to {s}", "what is {s}", "best {s}", "top {s}", "{s} guide", "{s} tutorial",
    "{s} checklist", "{s} template", "{s} vs alternatives", "compare {s}", "{s} pricing",
    "{s} near me", "beginner {s} guide", "advanced {s}",
)
SERVICE_TEMPLATES = (
    "hire {s}", "find {s}", "{s} quotes", "{s} cost", "{s} companies", "trusted {s}",
    "reliable {s}", "{s} reviews",
)
PRODUCT_TEMPLATES = (
    "buy {s}", "where to buy {s}", "{s} price", "cheap {s}", "{s} for sale",
    "{s} reviews", "{s} comparison",
)
UNKNOWN_TEMPLATES = ("{s} reviews", "{s} comparison", "find {s}")
AUDIENCE_TEMPLATES = ("best {s} for {a}", "{s} for {a}", "how to {s} for {a}")
REFERENCE_TEMPLATES = (
    "best {s}", "{s} pricing", "{s} cost", "what is {s}", "how to choose {s}",
    "{s} reviews", "{s} comparison", "top {s} services", "{s} near me", "professional {s}",
)

# --- fixed values: intent --------------------------------------------------------
INTENT_RULES = {
    "informational": (
        "who", "what", "why", "how", "guide", "tutorial", "tips", "checklist", "template",
    ),
    "commercial": ("best", "top", "review", "compare", "vs", "alternatives", "pricing"),
    "transactional": (
        "buy", "discount", "coupon", "deal", "near me", "order", "book", "hire",
    ),
    "navigational": (),
    "direct_answer": ("what is", "define", "meaning of", "cost of"),
    "local": ("near me", "in dubai", "in abu dhabi", "in uae", "dubai", "abu dhabi"),
}
INTENT_SIGNALS = {
    "commercial": ("review", "vs", "versus", "alternative", "option", "recommend"),
    "transactional": ("order", "purchase", "get", "find", "hire", "book"),
    "informational": ("learn", "understand", "mean", "difference", "explain"),
}
FUNNEL = {"informational": "TOFU", "transactional": "BOFU"}
INTENTS = (
    "informational", "commercial", "transactional", "navigational",
    "direct_answer", "complex_research", "comparative", "local",
)
FUNNEL_STAGES = ("TOFU", "MOFU", "BOFU")
RESPONSE_INTENTS = (
    "direct_answer", "complex_research", "transactional", "local", "comparative",
)

# --- fixed values: answer-engine query types (word boundaries written \b) ---------
QUERY_TYPE_PATTERNS = {
    "direct_answer": (
        r"^what is\b", r"^how much\b", r"^how long\b", r"^when did\b",
        r"\bcost of\b", r"\bprice of\b", r"\bmeaning of\b",
    ),
    "complex_research": (
        r"\bprocess of\b", r"\bsteps to\b", r"\bhow does\b.*work",
        r"\bwhat are the\b.*considerations", r"\bfactors\b",
    ),
    "comparative": (
        r"\bvs\b", r"\bversus\b", r"\bcompared to\b", r"\bdifference between\b",
        r"\bor\b(?=.*\bwhich\b)", r"\bbetter\b",
    ),
    "tutorial": (
        r"^how to\b", r"\bguide\b", r"\btutorial\b", r"\bstep by step\b",
        r"\btips for\b", r"\bways to\b",
    ),
    "list": (
        r"^best\b", r"^top\s+\d+", r"\blist of\b", r"\btypes of\b",
        r"\brecommended\b", r"\bpopular\b",
    ),
    "definition": (
        r"^what is\b", r"^define\b", r"\bdefinition of\b", r"^what are\b", r"\bexplain\b",
    ),
}
QUERY_TYPE_LOCALES = {
    "en-AE": {
        "local": (
            r"\bin dubai\b", r"\bin abu dhabi\b", r"\bin uae\b", r"\bnear me\b",
            r"\bin sharjah\b", r"\bal ain\b", r"\bmussafah\b", r"\bin ajman\b",
            r"\bin ras al khaimah\b", r"\bin fujairah\b",
        ),
    },
    "en-US": {"local": (r"\bnear me\b", r"\bin my area\b", r"\blocal\b", r"\bnearby\b")},
}
# types the locale leaves out are tried last, in this order
QUERY_TYPE_FALLBACKS = {
    "local": (
        r"\bin dubai\b", r"\bin abu dhabi\b", r"\bin uae\b", r"\bnear me\b",
        r"\bin sharjah\b", r"\bal ain\b", r"\bmussafah\b",
    ),
}

TRUST_PATTERNS = {
    "experience": (
        (r"\byears? of experience\b", "Years of experience mentioned"),
        (r"\bcompleted\s+\d+\s+projects?\b", "Project count mentioned"),
        (r"\bcase stud(?:y|ies)\b", "Case studies present"),
        (r"\bbefore\s+and\s+after\b", "Before/after examples"),
        (r"\bclient testimonial", "Client testimonials"),
    ),
    "expertise": (
        (r"\blicensed\b", "Licensed professional"),
        (r"\bcertified\b", "Certifications mentioned"),
        (r"\bspeciali[sz]e\b", "Specialization stated"),
        (r"\biso\s*\d+", "ISO certification"),
    ),
    "authority": (
        (r"\baward(?:s|ed)?\b", "Awards mentioned"),
        (r"\bmember of\b", "Professional membership"),
        (r"\bapproved by\b", "Approval mentioned"),
    ),
    "trust": (
        (r"\bguarantee[ds]?\b", "Guarantee offered"),
        (r"\bwarrant(?:y|ies)\b", "Warranty mentioned"),
        (r"\binsured\b", "Insurance mentioned"),
        (r"\btransparent pricing\b", "Price transparency"),
        (r"\bno hidden\s+(fees?|costs?)\b", "No hidden costs"),
        (r"\bfree\s+(?:quote|estimate|consultation)\b", "Free quote/consultation"),
    ),
}
TRUST_LOCALES = {
    "en-AE": {
        "expertise": (
            (r"\bestidama\b", "Estidama certification"),
            (r"\bpearl rated?\b", "Pearl rating mentioned"),
        ),
        "authority": (
            (r"\bgovernment\s+approved\b", "UAE Government approval"),
            (r"\btamm\s+registered\b", "TAMM registration"),
            (r"\bded\s+(?:licensed|registered)\b", "DED license"),
        ),
    },
}
TRUST_MAXIMUM = {"experience": 5, "expertise": 6, "authority": 6, "trust": 6}
TRUST_WEIGHT = {"experience": 0.2, "expertise": 0.3, "authority": 0.25, "trust": 0.25}
TRUST_ADVICE = {
    "experience": "Add project examples, case studies, or years of experience",
    "expertise": "Highlight certifications (Estidama, ISO) and specializations",
    "authority": "Mention government approvals, TAMM registration, or awards",
    "trust": "Add guarantees, warranties, and transparent pricing info",
}

# --- fixed values: content formats (format, substrings, minimum words) --------------
CONTENT_FORMATS = (
    ("how_to", ("how to", "guide to", "steps to", "tutorial"), 1500),
    ("listicle", ("top", "best", "list of", "types of", "examples of"), 1200),
    ("comparison", ("vs", "versus", "compare", "difference between", "or"), 1000),
    ("faq", ("what is", "what are", "why", "when", "where"), 800),
    ("case_study", ("case study", "project", "portfolio", "example"), 1000),
    ("pricing", ("cost", "price", "rates", "quote", "estimate"), 800),
    ("local", ("in dubai", "in abu dhabi", "near me", "in uae"), 800),
)
GAP_TYPES = {
    "missing_topic": (1, "Create new pillar content"),
    "thin_content": (2, "Expand and deepen existing content"),
    "missing_location": (5, "Create location-targeted content"),
    "competitive_gap": (6, "Create competing content with differentiation"),
}

SCHEMA_CLUSTER_TERMS = (
    ("LocalBusiness", ("service", "contractor", "company", "repair", "install")),
    ("Product", ("product", "equipment", "material", "supply")),
)
SCHEMA_BY_INTENT = {
    "informational": "FAQPage", "transactional": "Service", "local": "LocalBusiness",
}
LENGTH_BY_INTENT = {
    "informational": "1500-2500 words (comprehensive guide)",
    "commercial": "1000-1500 words (comparison/review)",
    "transactional": "500-800 words (product-focused)",
    "navigational": "300-500 words (reference page)",
    "direct_answer": "300-600 words (quick answer + context)",
    "complex_research": "2000-3500 words (in-depth analysis)",
    "comparative": "1200-2000 words (detailed comparison)",
    "local": "600-1000 words (local landing page)",
}
TYPE_BY_INTENT = {
    "informational": "How-to Guide, Tutorial, or Explainer",
    "commercial": "Comparison Post, Review, or Listicle",
    "transactional": "Product Page, Landing Page, or Pricing Page",
    "navigational": "About Page, Contact, or FAQ",
    "direct_answer": "FAQ Entry, Snippet-optimized Post",
    "complex_research": "Ultimate Guide, Whitepaper, or Long-form Article",
    "comparative": "Versus Post, Comparison Table, or Buyer's Guide",
    "local": "Local Landing Page, Store Locator, or City Guide",
}
TOPIC_STOPWORDS = tuple(
    """
    for in at on to from with by of about a an the how what where when why which who
    is are was were be do does did and or but so if as than
    """.split()
)
VAGUE_TOPICS = ("general", "other", "misc", "")

# --- fixed values: scoring ------------------------------------------------------------
HEAD_TERMS = ("best", "top", "review", "compare", "pricing")
SERP_FEATURE_TRIGGERS = (
    ("knowledge_panel", (
        "what is", "what are", "define", "definition", "meaning", "who is", "who was",
        "when did", "when was", "where is", "capital of", "population of", "height of",
        "age of")),
    ("featured_snippet", (
        "how to", "how do", "steps to", "ways to", "tips for", "guide to", "tutorial",
        "best way", "top 10", "list of", "checklist", "template", "example",
        "examples of")),
    ("instant_answer", (
        "calculator", "convert", "conversion", "time in", "weather in", "exchange rate",
        "translate", "timer", "countdown", "sunrise", "sunset", "timezone",
        "distance from")),
    ("local_pack", (
        "near me", "in dubai", "in abu dhabi", "in sharjah", "nearby", "closest", "local",
        "around me", "open now", "hours", "directions to", "address")),
    ("video_carousel", (
        "how to", "tutorial", "diy", "review", "unboxing", "walkthrough",
        "demonstration", "explained", "course")),
    ("shopping_results", (
        "buy", "price", "cheap", "discount", "deal", "sale", "best price",
        "where to buy", "online", "order", "for sale", "cost of", "prices for")),
)
SERP_FEATURE_IMPACT = {
    "knowledge_panel": 0.30, "featured_snippet": 0.25, "instant_answer": 0.35,
    "local_pack": 0.20, "shopping_results": 0.15, "video_carousel": 0.10,
    "image_pack": 0.08, "people_also_ask": 0.05, "top_ads": 0.20, "bottom_ads": 0.05,
    "shopping_ads": 0.18,
}
TRIGGERS = {
    "commercial": (
        "quote", "quotes", "price", "prices", "pricing", "cost", "costs", "rates",
        "estimate", "estimates", "estimation", "companies", "company", "contractors",
        "contractor", "services", "hire", "hiring", "agency", "agencies", "firm", "firms",
        "consultation", "consult", "consultant", "consultants", "package", "packages",
        "plan", "plans"),
    "transactional": (
        "buy", "purchase", "order", "book", "booking", "get quote", "request quote",
        "free quote", "near me", "in my area", "local", "for sale", "deals", "discount",
        "offer"),
    "b2b": (
        "enterprise", "business", "commercial", "corporate", "b2b", "wholesale", "bulk",
        "industrial", "professional", "solutions", "platform", "software", "system"),
    "local": (
        "fit out", "fitout", "turnkey", "mep", "hvac", "renovation", "construction",
        "contracting", "interior design", "landscaping", "license", "approval", "permit",
        "villa", "warehouse", "office"),
}
INTENT_VALUE = {
    "transactional": 0.6, "commercial": 0.4, "comparative": 0.35, "local": 0.3,
    "complex_research": 0.2, "direct_answer": 0.1, "informational": 0.1,
    "navigational": 0.0,
}
GULF_GEOS = ("ae", "sa", "qa", "kw", "bh", "om")
NICHE_TERMS = {
    "contracting": ("villa", "warehouse", "fit out", "renovation", "mep"),
    "construction": ("villa", "warehouse", "fit out", "renovation", "mep"),
}
LEAD_GOALS = ("lead", "sales", "revenue", "conversion")
UNNATURAL_PHRASES = (
    "template owners developers facility", "en ae ar login menu",
    "cookie privacy terms login", "vs or and the for", "home about contact menu footer",
)

# --- fixed values: clusters -------------------------------------------------------------
CLUSTER_NAME_STOPWORDS = ("the", "and", "for", "with", "how", "what", "best", "top")
ENTITY_STOPWORDS = tuple(
    """
    the a an is are was were be been being have has had do does did will would could
    should may might must shall can need dare to of in for on with at by from as into
    through during before after above below between under again further then once here
    there when where why how all each few more most other some such no nor not only own
    same so than too very just and but if or because until while about against what which
    who whom this that these those am its it best top vs review guide
    """.split()
)

# --- fixed values: stored search responses ------------------------------------------------
SUGGESTION_LANGUAGES = {
    "ae": ("en", "ar"), "sa": ("ar", "en"), "qa": ("ar", "en"), "kw": ("ar", "en"),
    "bh": ("ar", "en"), "om": ("ar", "en"), "eg": ("ar", "en"),
}
SITEMAP_LOCATIONS = (
    "/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemaps/sitemap.xml",
)

# --- fixed values: HTML ----------------------------------------------------------------------
DROPPED_TAGS = (
    "script", "style", "noscript", "iframe", "svg", "canvas", "video", "audio",
    "source", "track",
)
CHROME_TAGS = ("footer", "nav", "aside")
NOISE_MARKERS = (
    "nav", "navbar", "navigation", "menu", "header-menu", "footer", "site-footer",
    "footer-widget", "footer-links", "sidebar", "widget", "widget-area", "popup",
    "modal", "cookie", "gdpr", "consent", "banner", "whatsapp", "chat-widget",
    "livechat", "chatbot", "wa-button", "social", "share", "follow-us", "advertisement",
    "ad-container", "sponsor", "contact-form", "newsletter", "subscribe", "lang-switch",
    "language-selector", "locale", "wpml", "polylang", "qtranslate", "translatepress",
)
PHONE_PREFIXES = ("+971", "971", "00971", "800")
TEXT_TAGS = ("h1", "h2", "h3", "h4", "p", "li", "td", "th")
CONTENT_MARKERS = (
    "content", "article", "post", "entry", "main", "body", "text", "story",
    "description", "detail", "about", "service", "project", "portfolio", "work",
)
CHROME_MARKERS = (
    "nav", "menu", "header", "footer", "sidebar", "widget", "comment", "social",
    "share", "related", "ad", "sponsor", "cookie", "popup", "modal", "banner",
    "subscribe",
)
WEIGHTED_DROPPED_TAGS = ("script", "style", "noscript", "nav", "footer", "header")
TAG_WEIGHTS = (
    ("title", 4.0), ("meta", 2.5), ("h1", 3.0), ("h2", 2.0), ("h3", 1.5),
    ("p", 1.0), ("li", 1.0),
)

# --- fixed values: Arabic / English ------------------------------------------------------------
# english, arabic, Gulf spellings
BILINGUAL_TERMS = (
    ("villa", "فيلا", ()), ("apartment", "شقة", ("شقه",)), ("building", "مبنى", ()),
    ("tower", "برج", ()), ("warehouse", "مستودع", ()), ("factory", "مصنع", ()),
    ("office", "مكتب", ()), ("shop", "محل", ()), ("mall", "مول", ()),
    ("kitchen", "مطبخ", ()), ("bathroom", "حمام", ()), ("bedroom", "غرفة نوم", ()),
    ("living room", "غرفة معيشة", ()), ("majlis", "مجلس", ()), ("garage", "كراج", ()),
    ("garden", "حديقة", ()), ("pool", "مسبح", ()),
    ("renovation", "تجديد", ("تجديد", "رينوفيشن")), ("construction", "بناء", ()),
    ("maintenance", "صيانة", ("صيانه", "مينتننس")), ("repair", "إصلاح", ()),
    ("installation", "تركيب", ()), ("fit out", "تشطيب", ("تشطيب", "فت اوت")),
    ("decoration", "ديكور", ()), ("design", "تصميم", ()),
    ("painting", "دهان", ("دهان", "صبغ", "بوية")),
    ("plumbing", "سباكة", ("سباكه", "بلمبنق")),
    ("electrical", "كهرباء", ("كهربا", "كهربه")), ("carpentry", "نجارة", ()),
    ("flooring", "أرضيات", ()), ("air conditioning", "تكييف", ("تكييف", "اي سي", "ايه سي")),
    ("glass", "زجاج", ()), ("doors", "أبواب", ()), ("windows", "نوافذ", ()),
    ("furniture", "أثاث", ()), ("lighting", "إضاءة", ()),
    ("contractor", "مقاول", ("مقاول", "كونتراكتر")), ("company", "شركة", ()),
    ("engineer", "مهندس", ()), ("price", "سعر", ()), ("cost", "تكلفة", ()),
    ("cheap", "رخيص", ()), ("best", "أفضل", ()), ("quality", "جودة", ()),
    ("licensed", "مرخص", ()), ("permit", "تصريح", ()), ("license", "رخصة", ()),
    ("contract", "عقد", ()),
)
BILINGUAL_LOCATIONS = (
    ("abu dhabi", "أبوظبي"), ("dubai", "دبي"), ("sharjah", "الشارقة"), ("ajman", "عجمان"),
    ("ras al khaimah", "رأس الخيمة"), ("fujairah", "الفجيرة"),
    ("umm al quwain", "أم القيوين"), ("al ain", "العين"),
    ("area", "منطقة"), ("district", "حي"), ("island", "جزيرة"),
    ("industrial", "صناعية"), ("commercial", "تجارية"), ("residential", "سكنية"),
    ("near", "قريب من"), ("in", "في"),
)
KEY_LOCATIONS = ("abu dhabi", "dubai", "sharjah", "al ain")
ARABIC_INTENTS = (
    ("informational", (
        "ما هو", "ما هي", "كيف", "لماذا", "متى", "أين", "معلومات عن", "دليل", "شرح", "تعريف")),
    ("commercial", (
        "أفضل", "أحسن", "مقارنة", "الفرق بين", "أنواع", "مراجعة", "تقييم", "أسعار")),
    ("transactional", (
        "شراء", "طلب", "حجز", "اتصل", "رقم", "هاتف", "عرض سعر", "تواصل", "احجز", "اطلب")),
    ("local", ("قريب مني", "في", "بـ", "منطقة")),
)

# --- fixed values: gazetteer (kind, key, display, emirate, type) -------------------------------
EMIRATES = (
    ("dubai", "Dubai"), ("abu dhabi", "Abu Dhabi"), ("sharjah", "Sharjah"),
    ("ajman", "Ajman"), ("ras al khaimah", "Ras Al Khaimah"), ("fujairah", "Fujairah"),
    ("umm al quwain", "Umm Al Quwain"),
)
GAZETTEER = (
    ("alias", "dxb", "Dubai", "Dubai", None),
    ("alias", "auh", "Abu Dhabi", "Abu Dhabi", None),
    ("alias", "shj", "Sharjah", "Sharjah", None),
    ("alias", "rak", "Ras Al Khaimah", "Ras Al Khaimah", None),
    ("alias", "uaq", "Umm Al Quwain", "Umm Al Quwain", None),
    ("alias", "abudhabi", "Abu Dhabi", "Abu Dhabi", None),
    ("alias", "abu-dhabi", "Abu Dhabi", "Abu Dhabi", None),
    ("alias", "ad", "Abu Dhabi", "Abu Dhabi", None),
    *(("emirate", key, name, name, None) for key, name in EMIRATES),
    ("district", "dubai marina", "Dubai Marina", "Dubai", "residential"),
    ("district", "business bay", "Business Bay", "Dubai", "commercial"),
    ("district", "downtown dubai", "Downtown Dubai", "Dubai", "mixed"),
    ("district", "jumeirah", "Jumeirah", "Dubai", "residential"),
    ("district", "deira", "Deira", "Dubai", "commercial"),
    ("district", "al quoz", "Al Quoz", "Dubai", "industrial"),
    ("district", "al barsha", "Al Barsha", "Dubai", "residential"),
    ("district", "media city", "Media City", "Dubai", "commercial"),
    ("district", "al reem island", "Al Reem Island", "Abu Dhabi", "residential"),
    ("district", "yas island", "Yas Island", "Abu Dhabi", "mixed"),
    ("district", "saadiyat island", "Saadiyat Island", "Abu Dhabi", "residential"),
    ("district", "khalifa city", "Khalifa City", "Abu Dhabi", "residential"),
    ("district", "masdar city", "Masdar City", "Abu Dhabi", "mixed"),
    ("district", "mussafah", "Mussafah", "Abu Dhabi", "industrial"),
    ("district", "icad", "Icad", "Abu Dhabi", "industrial"),
    ("district", "al ain", "Al Ain", "Abu Dhabi", "city"),
    ("district", "al nahda", "Al Nahda", "Sharjah", "residential"),
    ("district", "industrial area", "Industrial Area", "Sharjah", "industrial"),
    ("landmark", "burj khalifa", "Burj Khalifa", "Dubai", "landmark"),
    ("landmark", "dubai mall", "Dubai Mall", "Dubai", "commercial"),
    ("landmark", "jebel ali", "Jebel Ali", "Dubai", "industrial"),
    ("landmark", "etihad towers", "Etihad Towers", "Abu Dhabi", "landmark"),
    ("landmark", "yas mall", "Yas Mall", "Abu Dhabi", "commercial"),
    ("free_zone", "jafza", "Jebel Ali Free Zone", "Dubai", "logistics"),
    ("free_zone", "dmcc", "Dubai Multi Commodities Centre", "Dubai", "trading"),
    ("free_zone", "kizad", "Khalifa Industrial Zone Abu Dhabi", "Abu Dhabi", "industrial"),
    ("free_zone", "masdar city", "MASDAR CITY", "Abu Dhabi", "green"),
    ("free_zone", "adgm", "Abu Dhabi Global Market", "Abu Dhabi", "financial"),
    ("free_zone", "hamriyah free zone", "HAMRIYAH FREE ZONE", "Sharjah", "industrial"),
    ("government", "tamm", "TAMM Services Portal", "Abu Dhabi", "government"),
    ("government", "abu dhabi municipality", "ABU DHABI MUNICIPALITY", "Abu Dhabi", "government"),
    ("government", "rera", "Real Estate Regulatory Agency", "Dubai", "government"),
    ("government", "dewa", "Dubai Electricity and Water Authority", "Dubai", "utility"),
    ("government", "dubai municipality", "DUBAI MUNICIPALITY", "Dubai", "government"),
    ("certification", "estidama", "ESTIDAMA", "Abu Dhabi", "certification"),
    ("certification", "pearl rating", "PEARL RATING", "Abu Dhabi", "certification"),
    ("certification", "leed", "Leadership in Energy and Environmental Design", None, "certification"),
    ("certification", "iso 9001", "ISO 9001", None, "certification"),
    ("legal", "musataha", "Musataha", None, "ownership"),
    ("legal", "freehold", "Freehold", None, "ownership"),
    ("legal", "leasehold", "Leasehold", None, "ownership"),
    ("legal", "tawtheeq", "Tenancy Contract Registration", "Abu Dhabi", "document"),
    ("legal", "ejari", "Rental Contract Registration", "Dubai", "document"),
    ("legal", "building permit", "Building Permit", None, "permit"),
    ("legal", "trade license", "Trade License", None, "license"),
    ("construction", "villa renovation", "Villa Renovation", None, "service"),
    ("construction", "fit out", "Fit Out", None, "service"),
    ("construction", "turnkey", "Turnkey", None, "service"),
    ("construction", "mep", "Mep", None, "trade"),
    ("construction", "hvac", "Hvac", None, "trade"),
    ("construction", "flooring", "Flooring", None, "trade"),
    ("construction", "painting", "Painting", None, "trade"),
    ("construction", "landscaping", "Landscaping", None, "trade"),
    ("construction", "concrete", "Concrete", None, "material"),
    ("construction", "demolition", "Demolition", None, "service"),
)
