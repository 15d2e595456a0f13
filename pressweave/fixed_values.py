"""Fixed values of the data rules.

Everything in this file is a constant of the data format (labels, word lists,
patterns, weights).  They are kept together, as plain text, because results
depend on them literally.  Every operator takes them as parameters, so a
different domain passes its own.  Large dictionaries (persons, organisations,
badges, watch-lists) are not here: they are tables, see ``sources.dictionaries``.
"""

# --- fixed values: defaults and placeholders -------------------------------
EMPTY_WORDS = ["nan", "none", "null", "nat"]
UNKNOWN_SOURCE = "Source inconnue"
DEFAULT_CATEGORY = "Autre"
DEFAULT_LEAGUE = "Premier League 🏴󠁧󠁢󠁥󠁮󠁧󠁿"
DEFAULT_REMOTE_LEAGUE = "Champions League 🇪🇺"
DEFAULT_SERVED_CATEGORY = "Premier League"
DEFAULT_SENTIMENT = "Neutre"
DEFAULT_NATIONALITY = "International 🌍"
UNKNOWN_FEE = "Non communiqué"
DEFAULT_ENTITY = "Joueur Star"
INVALID_STORY_KEYS = ["", "nan", "unknown__unknown__unknown"]

PLACEHOLDERS = {
    "entity": ["", "Joueur Mercato", "Joueur Star", "nan", "None"],
    "org_from": ["", "Club Vendeur", "Club Acquéreur", "nan", "None"],
    "org_to": ["", "Club Acheteur", "Club Cible", "nan", "None"],
    "fee_text": ["", "Non communiqué", "nan", "None"],
    "nationality": ["", "nan", "None"],
    "image_url": ["", "nan", "None"],
    "league": ["", "nan", "None"],
}
QUALITY_PLACEHOLDERS = {
    "entity": ["", "Joueur Mercato", "Joueur Star", "nan"],
    "org_from": ["", "Club Vendeur", "nan"],
    "org_to": ["", "Club Acheteur", "nan"],
    "fee_text": ["", "Non communiqué", "nan"],
}
IMAGE_ENTITY_PLACEHOLDERS = ["Joueur Mercato", "Joueur Star", "Star", "nan", "None"]
IMAGE_ORG_PLACEHOLDERS = ["Club Acheteur", "Club Vendeur", "Club Cible", "Club Acquéreur", "nan"]

# --- fixed values: status --------------------------------------------------
STATUS_OFFICIAL = "OFFICIEL ✅"
STATUS_AGREED = "HERE WE GO 🔥"
STATUS_TALKS = "NEGOCIATION 💬"
STATUS_RUMOUR = "RUMEUR 📰"
STATUS_WORDS = {
    STATUS_OFFICIAL: ["officiel", "official", "signe", "signé", "prolonge", "confirmé", "ufficiale"],
    STATUS_AGREED: ["here we go", "accord total", "deal done", "visite médicale", "fechado"],
    STATUS_TALKS: ["négociation", "pourparlers", "offre", "discussions", "proche", "avance",
                   "proposta", "trattativa", "talks", "bid"],
}
STATUS_PRIORITY = {STATUS_OFFICIAL: 4, STATUS_AGREED: 3, STATUS_TALKS: 2, STATUS_RUMOUR: 1}
STATUS_HEADERS = {
    "OFFICIEL": "🚨 OFFICIEL :",
    "HERE WE GO": "🔥 HERE WE GO :",
    "NEGOCIATION": "💬 NÉGOCIATION :",
    "": "📰 RUMEUR :",
}

# --- fixed values: sentiment -----------------------------------------------
SENTIMENT_UP = "Bullish"
SENTIMENT_DOWN = "Bearish"
SENTIMENT_POSITIVE = "Positif"
SENTIMENT_UP_WORDS = ["accord", "hot", "brûlant", "signe", "proche", "top", "avance", "record", "here we go"]
SENTIMENT_DOWN_WORDS = ["capote", "refus", "bloqué", "rejeté", "blessure", "échec", "froid", "avorté"]

# --- fixed values: direction words -----------------------------------------
EXTENSION_WORDS = ["prolonge", "renouvelle", "renovacao", "rinnova", "extends",
                   "contract extension", "verlangert", "تجديد"]
PAYS_ORG_PREFIXES = ["pagar ao", "paga ao", "proposta ao", "offre a", "bid to", "offer to"]
PAYS_ORG_FOR = ("ao", "por")
OFFER_FROM_PREFIX = "proposta do"
TOWARDS_ORG_PREFIXES = ["para o", "ao", "passa ai", "passa al", "vers", "to", "joins", "rejoint"]
TOWARDS_WORDS = ["para o", "ao", "vers", "rejoint", "signe a", "target", "to", "moves to", "joins",
                 "al", "ai", "zu", "nach", "نحو", "الى"]
LEAVES_WORDS = ["quitte", "laisse", "leaves", "ex", "deixa", "sai do", "dal", "von", "من"]

# --- fixed values: amounts -------------------------------------------------
FREE_WORDS = ["gratuit", "free", "prêt", "loan", "libre"]
FEE_PATTERNS = [
    r"(\d+[\.,]?\d*\s*(?:M€|millions?|M\$|M£|millions d'euros|million))",
    r"(gratuit|fin de contrat|free transfer|libre|prêt|loan)",
    r"(clause de \d+[\.,]?\d*\s*M€)",
]

# --- fixed values: topic filter --------------------------------------------
BLOCKED_SOURCES = [
    "business insider", "businessinsider", "yahoo finance", "yahoo news", "yahoo",
    "bloomberg", "techcrunch", "tech crunch", "buzzfeed", "huffpost",
    "new york times", "washington post", "the atlantic", "vox",
    "insider", "marketwatch", "market watch", "cnbc", "fox news", "daily mail",
    "the sun", "the mirror", "express", "people com", "tmz",
    "wsj", "wall street journal", "cointelegraph", "coin telegraph", "coindesk", "coin desk",
    "le monde", "le figaro", "hespress", "reuters",
]
TOPIC_PATTERNS = [
    r"\btransfer\b", r"\btransfert\b", r"\bmercato\b", r"\bsigning\b", r"\bsigned\b", r"\bloan\b",
    r"\bfree agent\b", r"\bcontract\b", r"\bbid\b", r"\boffer\b", r"\bdeal\b",
    r"\bfootball\b", r"\bsoccer\b", r"\bfoot\b", r"\bfutbol\b", r"\bfussball\b", r"\bcalcio\b",
    r"\bpremier league\b", r"\bla liga\b", r"\bserie a\b", r"\bbundesliga\b",
    r"\bchampions league\b", r"\bligue 1\b", r"\bliga\b", r"\bleague\b",
    r"\bstriker\b", r"\bmidfielder\b", r"\bdefender\b", r"\bwinger\b", r"\bgoalkeeper\b",
    r"\bbuteur\b", r"\bgardien\b", r"\bjoueur\b", r"\bgiocatore\b", r"\bjugador\b", r"\bspieler\b",
    r"\bprolongation\b", r"\bentraineur\b", r"\bselection\b", r"\bballon d.or\b", r"\bpret\b",
    r"\bfichaje\b", r"\btraspaso\b", r"\bcesion\b",
    r"\bcalciomercato\b", r"\bacquisto\b", r"\bprestito\b",
    r"\bwechsel\b", r"\bneuzugang\b",
    r"\breal madrid\b", r"\bbarcelona\b", r"\bman city\b", r"\bman utd\b", r"\blfc\b", r"\bchelsea fc\b",
]
TOPIC_RAW_WORDS = ["كرة القدم", "كرة قدم", "ميركاتو", "انتقال", "صفقة",
                   "لاعب", "نادي", "توقيع", "إعارة", "دوري", "فريق"]
OFF_TOPIC_PATTERNS = [
    r"\brecipe\b", r"\brecette\b", r"\bscrambled\b", r"\bkitchen\b", r"\bbathroom\b", r"\bmortgage\b",
    r"\binflation\b", r"\blayoff\b", r"\blayoffs\b", r"\bstartup\b", r"\bcryptocurren",
    r"\bimmobilier\b", r"\bimpots\b", r"\bcuisine\b", r"\bcolonel sanders\b", r"\bair fryer\b",
    r"\bscrambleg eggs\b", r"\bweightloss\b", r"\bnutrition\b", r"\bfinancial results\b",
    r"\bearnings report\b", r"\bstock market\b", r"\bipo\b", r"\bventure capital\b",
    r"\btech giant\b", r"\bpalm springs\b", r"\bkfc\b", r"\bbraid\b",
]

# --- fixed values: class keywords, in class order ---------------------------
CLASS_KEYWORDS = {
    "Premier League 🏴󠁧󠁢󠁥󠁮󠁧󠁿": [
        "premier league", "manchester city", "man city", "arsenal", "liverpool", "manchester united",
        "man utd", "chelsea", "tottenham", "spurs", "newcastle", "aston villa", "west ham", "brighton",
        "everton", "brentford", "crystal palace", "wolverhampton", "wolves", "fulham", "bournemouth",
        "nottingham forest", "england", "angletterre"],
    "La Liga 🇪🇸": [
        "la liga", "la liga santander", "real madrid", "barcelona", "barça", "fc barcelone",
        "atletico madrid", "atlético", "sevilla", "séville", "real betis", "villareal", "villarreal",
        "athletic bilbao", "real sociedad", "girona", "espagne", "spain"],
    "Ligue 1 🇫🇷": [
        "ligue 1", "psg", "paris saint-germain", "olympique de marseille", "om", "olympique lyonnais",
        "ol", "lyon", "monaco", "as monaco", "lille", "losc", "rennes", "stade rennais", "nice",
        "ogc nice", "lens", "rc lens", "strasbourg", "nantes", "toulouse", "france", "ligue1"],
    "Serie A 🇮🇹": [
        "serie a", "inter milan", "inter", "ac milan", "juventus", "juve", "napoli", "naples", "roma",
        "as roma", "lazio", "atala", "atalanta", "fiorentina", "bologna", "italie", "italy"],
    "Bundesliga 🇩🇪": [
        "bundesliga", "bayern munich", "bayern", "borussia dortmund", "dortmund", "bvb",
        "bayer leverkusen", "leverkusen", "rb leipzig", "leipzig", "eintracht frankfurt", "stuttgart",
        "allemagne", "germany"],
    "Saudi Pro League 🇸🇦": [
        "saudi pro league", "al nassr", "al-nassr", "al hilal", "al-hilal", "al ittihad", "al-ittihad",
        "al ahli", "al-ahli", "saudi", "arabie saoudite", "saudi league"],
    "Champions League 🇪🇺": [
        "champions league", "ligue des champions", "c1", "uefa", "europa league", "conference league"],
}

# --- fixed values: source scores, first match wins --------------------------
SOURCE_SCORES = {
    "Fabrizio Romano": 5,
    "Sky Sports Transfer Centre": 5,
    "BBC Sport Football": 5,
    "L'Équipe Mercato": 5,
    "David Ornstein": 5,
    "Foot Mercato": 4,
    "Marca Fichajes": 4,
    "RMC Sport Mercato": 4,
    "Goal.com Mercato": 4,
    "Marca Real Madrid": 4,
    "Marca Barcelona": 4,
    "Gazzetta dello Sport Mercato": 4,
    "Transfermarkt News": 4,
    "Football Italia": 4,
    "Sport.es Mercato": 3,
    "TalkSport Football": 3,
    "Eurosport Mercato": 3,
    "Saudi Pro League News": 4,
}
DEFAULT_SOURCE_SCORE = 3

# --- fixed values: text and urls --------------------------------------------
STOP_WORDS = [
    "a", "about", "actuellement", "actualites", "afrique", "al", "and", "articles", "avec", "aux",
    "be", "but", "can", "champions", "club", "coupe", "de", "des", "du", "en", "et", "europe",
    "football", "fr", "il", "in", "la", "le", "les", "ligue", "live", "monde", "news", "of", "on",
    "ou", "par", "pour", "pro", "sport", "sports", "sur", "the", "to", "uefa", "un", "une", "video",
]
# places where glued text is parted by a blank: after a mark, between aB, 1x and x1
GLUED_PATTERNS = ["([,;:!?])([^\\s])", "([a-zà-öø-ÿ])([A-ZÀ-ÖØ-Þ])", "([0-9])([A-Za-zÀ-ÿ])", "([A-Za-zÀ-ÿ])([0-9])"]
FRENCH_WORDS = ["le", "la", "les", "du", "des", "un", "une", "et", "en", "au", "aux"]
BAD_IMAGE_MARKERS = ["pixel", "tracking", "1x1", "spacer", "blank.gif", "favicon", "default-avatar",
                     "user_icon", "spinner", "badge-placeholder", "no-image", "empty."]
PLACEHOLDER_IMAGE_PATTERN = "pixel|spacer|blank"
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".gif"]
WIKI_HOSTS = ["wikipedia.org", "wikimedia.org"]
NO_PAGE_IMAGE_HOST = "news.google.com"
CSV_COLUMN_ORDER = ["title", "source", "lang", "url", "date", "summary", "category", "credibility",
                    "image_url", "image_caption"]
CSV_DROPPED_COLUMN = "resume"
PREFERRED_TABLES = ["verified_articles", "organized_articles", "articles"]
REPORT_TABLES = ["verified_articles", "organized_articles"]

# --- fixed values: organisation phrase in a biography -----------------------
BIO_ORG_PATTERN = (
    r"plays\s+(?:as\s+a\s+[\w\s]+)?for\s+(?:the\s+)?"
    r"(?:Saudi\s+Pro\s+League\s+club\s+|Premier\s+League\s+club\s+|La\s+Liga\s+club\s+"
    r"|Serie\s+A\s+club\s+|Ligue\s+1\s+club\s+|Bundesliga\s+club\s+|club\s+)?"
    r"([A-Z][A-Za-z0-9\s\.\-]{2,25}?)(?:\s+and\s+|\s+on\s+loan|\s+as\s+|\.|,)"
)

# --- fixed values: feed search queries --------------------------------------
FEED_SEARCH_URL = "https://news.google.com/rss/search?q="
SEARCH_KEYWORDS = {
    "fr": "(transfert OR mercato OR rumeur OR signature OR recrue OR prêt)",
    "en": "(transfer OR signing OR deal OR bid OR loan OR rumor OR target OR fee)",
    "es": "(fichaje OR traspaso OR mercado OR fichajes OR cesión OR rumor)",
    "it": "(calciomercato OR acquisto OR trattativa OR prestito OR ingaggio)",
    "de": "(wechsel OR transfer OR neuzugang OR gerücht OR ablöse)",
    "ar": "(انتقال OR صفقة OR ميركاتو OR توقيع OR إعارة)",
}
EDITIONS = {
    "en": "hl=en-GB&gl=GB&ceid=GB:en",
    "fr": "hl=fr&gl=FR&ceid=FR:fr",
    "es": "hl=es&gl=ES&ceid=ES:es",
    "it": "hl=it&gl=IT&ceid=IT:it",
    "de": "hl=de&gl=DE&ceid=DE:de",
    "ar": "hl=ar&gl=SA&ceid=SA:ar",
}
CATEGORY_LANGUAGES = {
    "Premier League 🏴󠁧󠁢󠁥󠁮󠁧󠁿": ["en", "fr", "es"],
    "La Liga 🇪🇸": ["es", "fr", "en"],
    "Serie A 🇮🇹": ["it", "fr", "en"],
    "Bundesliga 🇩🇪": ["de", "fr", "en"],
    "Ligue 1 🇫🇷": ["fr", "en", "es"],
    "Saudi Pro League 🇸🇦": ["ar", "en", "fr"],
}
DEFAULT_LANGUAGES = ["fr", "en"]
FRESHNESS_TERM = "when:24h"
PERSON_FEED_CREDIBILITY = 0.88
COACH_FEED_CREDIBILITY = 0.85
COACH_CATEGORY = "Entraîneurs 👔"

# --- fixed values: ranking ---------------------------------------------------
RANK_WEIGHTS = {"credibility": 0.40, "recency": 0.20, "engagement": 0.15, "source": 0.15, "keywords": 0.10}
SPAM_PATTERNS = ["cliquez ici", r"bit\.ly", "casino", "poker", "betting", "gagnez de l'argent",
                 "vente exclusive"]
VERIFIED_THRESHOLD = 0.60
