"""Words, weights and limits that results depend on."""

from __future__ import annotations

# --- Fixed values: results are only right with exactly these ---------------

STOPWORDS = {
    "fr": [
        "le", "la", "les", "un", "une", "des", "de", "du", "et", "ou", "où", "à", "au", "aux", "en", "dans", "par",
        "pour", "sur", "avec", "ce", "cet", "cette", "ces", "qui", "que", "quoi", "est", "sont", "il", "elle", "ils",
        "elles", "on", "nous", "vous", "je", "tu", "ne", "pas", "se", "sa", "son", "ses", "leur", "leurs", "mon",
        "ma", "mes", "notre", "nos", "votre", "vos", "y", "qu", "lui", "mais", "donc", "car", "ni",
    ],
    "en": [
        "the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "for", "with", "by", "from", "is", "are", "was",
        "were", "be", "it", "its", "this", "that", "these", "those", "as", "our", "we", "you", "your", "my", "me",
        "he", "she", "they", "them", "their", "but", "not", "so",
    ],
    "de": [
        "der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "einem", "einer", "eines", "und", "oder",
        "in", "im", "an", "am", "auf", "aus", "bei", "mit", "nach", "von", "vom", "zu", "zum", "zur", "für", "ist",
        "sind", "es", "sie", "wir", "ihr", "ich", "du", "er", "wie", "wo", "was", "nicht", "auch", "aber", "unser",
        "unsere", "euch", "uns",
    ],
}

#: Sets of words of which each finds the others.
SYNONYM_SETS = {
    "fr": [
        ["leucade", "lefkada", "lefkas"], ["édimbourg", "edinburgh"], ["londres", "london"], ["madère", "madeira"],
        ["majorque", "mallorca"], ["minorque", "menorca"], ["pouilles", "puglia"], ["vtt", "vélo"],
    ],
    "en": [
        ["hike", "hiking", "hikes"], ["bike", "biking", "cycling"], ["kids", "children"], ["lefkada", "lefkas"],
        ["teens", "teenagers"],
    ],
    "de": [["wanderung", "wandern", "wanderungen"], ["radtour", "radfahren", "fahrrad"], ["lefkada", "lefkas"]],
}

#: Words that also find another word, which does not find them.
SYNONYMS_ONE_WAY = {
    "fr": {"rando": ["randonnée"], "randos": ["randonnées"], "ado": ["adolescent"], "ados": ["adolescents"]},
}

COUNT_FIELDS = ["title", "heading", "content", "excerpt", "alt", "taxonomy", "custom", "guide"]
STRENGTH_FIELDS = ["place", "hub", "concept"]
FIELDS = COUNT_FIELDS + STRENGTH_FIELDS

WEIGHTS = {
    "title": 10.0, "heading": 5.0, "content": 3.0, "excerpt": 3.0, "alt": 3.0, "taxonomy": 2.0, "custom": 2.0,
    "guide": 12.0, "place": 7.0, "hub": 5.0, "concept": 2.5,
    "title_exact": 20.0, "title_phrase": 15.0, "title_all": 6.0, "content_phrase": 4.0,
}

VARIANTS = {"word": 1.0, "plural": 0.85, "prefix": 0.5, "synonym": 0.8, "concept": 1.0}

#: Letters that fold to one or two plain ones.
SPECIAL = [
    ("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("đ", "d"), ("ð", "d"), ("ł", "l"), ("þ", "th"), ("ı", "i"),
    ("ŀ", "l"),
]

PLACE_LEVELS = {"region": 80, "county": 80, "country": 65, "continent": 30}
HUB_STRENGTH = [100, 60, 36]  # by depth

MAX_QUERY_CHARS = 200
MAX_GROUPS = 10
MIN_PREFIX = 4
PREFIX_TERMS = 30
MAX_RESULTS = 500
PHRASE_CANDIDATES, QUOTED_CANDIDATES = 50, 300
MIN_TERM_CHARS, MAX_TERM_BYTES = 2, 64
LOG_KEY_CHARS = 191
MAX_RANK = 500
CLICK_SOURCES = ["result", "pinned", "photos", "guides"]
PROVEN_SEARCHES, PROVEN_RESULTS = 3, 5
SUGGEST_DAYS, SEASON_DAYS = 60, 21
SUGGEST_CHARS = (3, 40)
SKIP_SEGMENTS = ["tag", "category", "categorie", "page", "amp", "feed", "author", "auteur", "blog"]
PATH_WORDS = 8
LANGUAGES = ["fr", "en", "de"]

#: What scanners put in a search box, lowercased: SQL, code, templates, paths and their own hosts.
PROBES = [
    r"\b(?:union\s+(?:all\s+)?select|insert\s+into|drop\s+table|information_schema|waitfor\s+delay|xp_cmdshell|dbms_pipe)\b",
    r"\b(?:sleep|pg_sleep|benchmark|md5|sha1|concat|char|chr|extractvalue|updatexml|load_file|print|eval|exec|system|phpinfo|base64_decode|sysdate|now)\(",
    r"@@[a-z]", r"\$\{", r"\{\{", r"<\?", r"\bjndi:", r"/etc/(?:passwd|hosts|shadow)", r"win\.ini", r"web-inf", r"\.\.[/\\]",
    r"bxss\.me", r"\.acu/", r"vulnweb", r"acunetix", r"burpcollaborator", r"oastify", r"interact\.sh", r"\boast\.[a-z]", r"dnslog", r"nslookup", r"response\.write",
    r"\b(?:and|or|xor)\s+\d[\d\s+*-]*[=<>]",
]

#: Other marks of a query that no visitor types.
JUNK_LETTERS = r"[\\<>{}$=;|^*@`\x00-\x1f\x7f]"
BREAKER_RUN, BREAKER_BRACKET, BREAKER_QUOTE = r"[()'\"’,.]{4,}", r"[()]", r"['\"’]"
JUNK_PATH = r"(?i)/(?:[a-z]{2}-[a-z]{2}|page/[0-9]+)(/|$)"
JUNK_QUOTES, JUNK_CHARS = 2, 100
GLUED_WORD = r"^(?U:\s*)(\p{L}{3,12})[()'\"’,.\\<>]"
MAX_NEW_PER_DAY = 2000

#: HTML elements that end a line, and those whose content nobody reads.
BLOCK_TAGS = (
    "p|div|section|article|aside|header|footer|blockquote|figure|figcaption|li|ul|ol|dl|dt|dd|table|thead|tbody|tr|td|th|"
    "h[1-6]|pre|hr|details|summary"
)
UNSEEN_TAGS = "script|style|noscript|iframe|svg|template|object"
UNMARKED_TAGS = "script|style|textarea|mark|title|noscript"

#: Shapes of paths that lead to no article.
FILE_PATH = r"\.(?!html?$)[a-z0-9]{1,6}$"
SYSTEM_PATH = r"(^|/)(\.|wp-(admin|content|includes|json)(/|$))"
PATH_BYTES, PATH_SEGMENTS = 200, 6

#: Excerpts: characters of one, the fewest, and what may close a sentence that ends with one.
EXCERPT_CHARS, EXCERPT_LEAST = 450, 60
CLOSING = ".!?…)»\""
# --- end of fixed values ----------------------------------------------------
