"""Dictionaries and word lists for the queries over the test corpus."""

ENTITIES = {
    "Thanedble": {"org": "Ering", "nationality": "EN", "aliases": ["thanedble er"]},
    "Eriner Thanea": {"org": "Thble", "nationality": "EN", "aliases": ["eriner", "thanea"]},
    "Queque": {"org": "De La", "nationality": "FR", "aliases": ["équeelle", "que"]},
    "Nichter": {"org": "", "nationality": "DE", "aliases": ["nicht", "und"]},
    "Onlyhe Hetion": {"org": "Attion", "nationality": "", "aliases": ["onlyhe", "hetion", "on the it"]},
    "Hation": {"org": "Ertion", "nationality": "EN", "aliases": []},
    "Zzqx Never": {"org": "Thble", "nationality": "XX", "aliases": ["zzqx"]},
}
ORGS = {
    "thble": "Thble", "the thble": "Thble", "attion": "Attion", "attion and": "Attion",
    "ertion": "Ertion", "ering": "Ering", "to the": "The", "de la": "De La", "der die": "Die",
    "elle": "Elle", "anble": "Anble", "th-ble": "Never", "équeelle": "Never",
}
WORDING = {"extension": ["ontion", "hable"], "towards": ["to ", "que", "sch"], "leaves": ["ing", "os "]}
STATUS = {
    "OFFICIEL ✅": ["thble", "ément"],
    "HERE WE GO 🔥": ["ing the", "de la"],
    "NEGOCIATION 💬": ["tion", "sch"],
}
CLASSES = {
    "Alpha": ["thanedble", "de la", "th-ble"],
    "Beta": ["ertion the", "nicht"],
    "Gamma": ["thtion", "queque"],
    "Delta": ["license", "ción"],
}
DEFAULT_CLASS = "Other"
UP_WORDS = ["thble", "élle", "nicht"]
DOWN_WORDS = ["ering", "ément", "ción"]
BLOCKED = ["src7", "src15"]
TOPIC = [r"\bthing\b", r"\bqui\b", r"\bein\b", r"\bonion\b", r"\bpara\b"]
TOPIC_RAW = ["übersch", "équeelle", "ñas"]
OFF_TOPIC = [r"\bthtion\b", r"\bdans\b", r"\blicense\b", r"\breing"]
SOURCE_SCORES = {"src3": 5, "The SRC12 Daily": 4, "src1": 2, "SRC": 1}
BADGES = {"ering": "https://img.example.org/ering.png", "th": "https://img.example.org/th.png",
          "De L": "https://img.example.org/dela.png"}
POSITIVE = ["the", "die", "les", "los"]
NEGATIVE = ["and", "und", "des", "que"]
NATIONS = {n: a["nationality"] for n, a in ENTITIES.items() if a["nationality"]}
SPAM = [r"license", r"[0-9]{3}-[0-9]{3}", r"@", r"\+\+\+", r"token ="]
AS_OF = "2024-01-30 12:00:00"
TODAY = "2024-02-01"
