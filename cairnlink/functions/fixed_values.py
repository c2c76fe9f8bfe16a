"""Fixed values of the entity-resolution semantics: word lists, maps, patterns and limits."""

# Spelling of a legal form to its canonical word.
LEGAL_MAP = {
    "corp": "corporation",
    "corpn": "corporation",
    "corporation": "corporation",
    "inc": "incorporated",
    "incorporated": "incorporated",
    "incorp": "incorporated",
    "ltd": "limited",
    "limited": "limited",
    "ltda": "limited",
    "pvt": "private",
    "private": "private",
    "pvte": "private",
    "co": "company",
    "company": "company",
    "llc": "llc",
    "llp": "llp",
    "svcs": "services",
    "services": "services",
    "svc": "services",
    "assoc": "associates",
    "associates": "associates",
    "assocs": "associates",
    "intl": "international",
    "international": "international",
    "internatl": "international",
    "grp": "group",
    "group": "group",
    "mfg": "manufacturing",
    "manufacturing": "manufacturing",
    "tech": "technology",
    "technology": "technology",
    "technologies": "technologies",
    "engg": "engineering",
    "engineering": "engineering",
    "eng": "engineering",
    "mgmt": "management",
    "management": "management",
    "ent": "enterprises",
    "enterprises": "enterprises",
    "enterprise": "enterprises",
    "ind": "industries",
    "industries": "industries",
    "est": "establishment",
    "establishment": "establishment",
    "trdg": "trading",
    "trading": "trading",
    "expts": "exports",
    "exports": "exports",
    "impts": "imports",
    "imports": "imports",
    "sarl": "sarl",
    "sas": "sas",
    "sasu": "sas",
    "sa": "sa",
    "eurl": "eurl",
    "eirl": "eirl",
    "gie": "gie",
    "sci": "sci",
    "snc": "snc",
    "scp": "scp",
    "societe": "societe",
    "ets": "etablissements",
    "cie": "compagnie",
}
LEGAL_TAIL_WORDS = 3

# French legal forms of several words and their short form; the first that ends a name counts.
LEGAL_PHRASES = [
    ("societe par actions simplifiee unipersonnelle", "sas"),
    ("societe par actions simplifiee", "sas"),
    ("societe a responsabilite limitee", "sarl"),
    ("entreprise unipersonnelle a responsabilite limitee", "eurl"),
    ("societe anonyme", "sa"),
    ("societe civile immobiliere", "sci"),
    ("groupement d interet economique", "gie"),
]

# Spelling of an address word to its canonical word.
ADDRESS_MAP = {
    "rd": "road",
    "road": "road",
    "st": "street",
    "street": "street",
    "str": "street",
    "ave": "avenue",
    "avenue": "avenue",
    "av": "avenue",
    "blvd": "boulevard",
    "boulevard": "boulevard",
    "bvd": "boulevard",
    "bd": "boulevard",
    "dr": "drive",
    "drive": "drive",
    "ln": "lane",
    "lane": "lane",
    "ct": "court",
    "court": "court",
    "cir": "circle",
    "circle": "circle",
    "pl": "place",
    "place": "place",
    "pkwy": "parkway",
    "parkway": "parkway",
    "hwy": "highway",
    "highway": "highway",
    "sq": "square",
    "square": "square",
    "trl": "trail",
    "trail": "trail",
    "ter": "terrace",
    "terrace": "terrace",
    "aly": "alley",
    "alley": "alley",
    "apt": "apartment",
    "apartment": "apartment",
    "ste": "suite",
    "suite": "suite",
    "fl": "floor",
    "floor": "floor",
    "bldg": "building",
    "building": "building",
    "dept": "department",
    "department": "department",
    "rue": "rue",
    "r": "rue",
    "allee": "allee",
    "chemin": "chemin",
    "chem": "chemin",
    "impasse": "impasse",
    "imp": "impasse",
    "passage": "passage",
    "batiment": "batiment",
    "residence": "residence",
    "nagar": "nagar",
    "ngr": "nagar",
    "marg": "marg",
    "gali": "gali",
    "mohalla": "mohalla",
    "colony": "colony",
    "col": "colony",
    "sector": "sector",
    "sec": "sector",
    "phase": "phase",
    "block": "block",
    "blk": "block",
    "plot": "plot",
    "ward": "ward",
    "dist": "district",
    "district": "district",
    "taluk": "taluk",
    "taluka": "taluk",
    "tehsil": "tehsil",
    "mandal": "mandal",
    "village": "village",
    "vill": "village",
    "opp": "opposite",
    "opposite": "opposite",
}
DIRECTIONS = {"n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest"}

# Spelling of a country to its canonical label.
COUNTRY_MAP = {
    "us": "us",
    "usa": "us",
    "united states": "us",
    "united states of america": "us",
    "u s": "us",
    "u s a": "us",
    "america": "us",
    "india": "india",
    "in": "india",
    "ind": "india",
    "bharat": "india",
    "hindustan": "india",
    "france": "france",
    "fr": "france",
    "fra": "france",
    "francia": "france",
    "french republic": "france",
    "republique francaise": "france",
    "uk": "uk",
    "gb": "uk",
    "gbr": "uk",
    "united kingdom": "uk",
    "great britain": "uk",
    "germany": "germany",
    "de": "germany",
    "deu": "germany",
    "deutschland": "germany",
    "canada": "canada",
    "ca": "canada",
    "can": "canada",
    "spain": "spain",
    "es": "spain",
    "esp": "spain",
    "espana": "spain",
    "italy": "italy",
    "it": "italy",
    "ita": "italy",
    "italia": "italy",
}
KNOWN_COUNTRIES = ["us", "india"]

# What counts as no address, whole or as its beginning.
MISSING_ADDRESSES = ["", "nan", "none", "null", "no address", "no address available", "not available", "unknown", "n/a", "missing", "[no_address]"]
MISSING_ADDRESS_STARTS = ["no address", "missing"]
MISSING_NAMES = ["nan", "none", "null", ""]
NO_ADDRESS = "[NO_ADDRESS]"

# Patterns of the normalisation.
URL = r"(?i)(?:https?://\S+|www\.\S+|\[.*?\]\(https?://\S+\)|\[www\.\S+\]|\|\s*\[.*?\]\(https?://\S+\))"
DOING_BUSINESS_AS = r"(?i)\b(?:d/?b/?a|doing\s+business\s+as)\b"
ORDINAL = r"(?i)\b(\d+)(?:st|nd|rd|th)\b"
LANDMARKS = [
    r"\bnear\s+(?:to\s+)?[a-z\s]+?",
    r"\bbehind\s+[a-z\s]+?",
    r"\bnext\s+to\s+[a-z\s]+?",
    r"\bbeside\s+[a-z\s]+?",
    r"\b(?:above|below)\s+[a-z\s]+?(?:shop|store|bank|office|restaurant)",
    r"\badjacent\s+to\s+[a-z\s]+?",
    r"\bin\s+front\s+of\s+[a-z\s]+?",
    r"\ben\s+face\s+de\s+[a-z\s]+?",
    r"\bpr[eè]s\s+de\s+[a-z\s]+?",
]
DIGIT_RUN = r"\b\d{4,10}(?:-\d{3,4})?\b"
TRAILING_SEGMENT = r",\s*([^,]+)$"
STREET_NUMBER = r"(?i)^\s*(?:#+\s*|(?:plot|shop|flat|door|h\.?\s*no|kh\.?\s*no|sy\.?\s*no|bldg|building|ward|gali|road|no)\s*(?:no\.?)?\s*[-:]?\s*)?(\d{1,6})\b"
PIN = r"\b([1-9][0-9]{5})\b"
ZIP = r"\b(\d{5})(?:-\d{4})?\b"

# Words without weight in addresses and at the start of names.
ADDRESS_STOPWORDS = [
    "road", "street", "st", "rd", "ave", "avenue", "lane", "ln", "dr", "drive", "blvd", "boulevard", "floor", "fl", "unit", "suite", "ste", "apt",
    "apartment", "no", "near", "opp", "opposite", "behind", "court", "ct", "way", "parkway", "pkwy", "city", "state", "county", "block", "house",
    "building", "bldg", "first", "second", "third", "main", "cross", "north", "south", "east", "west", "c/o", "co", "india", "usa", "us", "rue", "bd",
    "route", "chemin", "allee", "place", "impasse", "quai", "cours", "passage", "square", "france", "paris", "nagar", "marg", "colony", "sector",
    "plot", "bengal", "delhi", "mumbai", "cedex", "bp", "boite", "cs",
]
NAME_STOPWORDS = [
    "the", "a", "an", "and", "le", "la", "les", "l", "d", "de", "du", "des", "et", "en", "au", "aux", "sarl", "sas", "sasu", "sa", "eurl", "eirl",
    "sci", "snc", "scp", "ste", "societe", "ets", "etablissements", "cie", "compagnie", "gie", "ms", "m/s", "shree", "sri", "shri", "smt", "om",
]
KNOWN_ACRONYMS = [
    "ge", "ibm", "hp", "ups", "fedex", "dhl", "bmw", "sap", "att", "cvs", "pnc", "hsbc", "kpmg", "ey", "pwc", "bbva", "td", "bmo", "cibc", "citi",
    "ubs", "cs", "amc", "cbs", "nbc", "abc", "cnn", "fox", "espn", "hbo", "mri", "dna", "gmc", "vw", "fca", "byd", "tata", "lg", "nec", "jvc", "sony",
    "jpm", "bofa", "bnp", "ing", "aig", "axa", "geico", "mci", "ncr", "trw", "itt", "bap", "cat", "jcb", "cnh", "agco",
]
ACRONYM_SKIP = [
    "in", "at", "of", "on", "to", "by", "or", "an", "as", "is", "it", "de", "la", "le", "du", "et", "en", "st", "rd", "and", "the", "for",
]

# Blocking channels in the order of their bits, with base score; the first eight are exact.
CHANNELS = [
    ("exact_name", 1.00),
    ("sorted_name_tokens", 0.98),
    ("first_2_tokens", 0.90),
    ("exact_name_postal", 1.00),
    ("exact_name_street", 0.95),
    ("exact_name_trailing", 0.95),
    ("name_lead_postal", 0.90),
    ("name_lead_street_trailing", 0.90),
    ("address_structural", 0.85),
    ("address_tokens", None),
    ("token_inverted", None),
    ("char_ngram", None),
    ("acronym_match", 0.75),
]
EXACT_CHANNELS = 8
