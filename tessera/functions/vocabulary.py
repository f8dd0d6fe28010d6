"""Word lists, tables and patterns that results depend on."""

# Surnames too frequent to say much.
COMMON_SURNAMES = [
    "kumar", "singh", "devi", "khan", "sharma", "verma", "yadav", "gupta",
    "mishra", "pandey", "tiwari", "prasad", "lal", "ram", "kaur", "ali",
    "begum", "bano", "khatoon", "kumari", "nair", "reddy", "srivastava",
]

# Words of an address that don't name a place.
ADDRESS_STOP = [
    "lucknow", "nagar", "sector", "near", "road", "unknown", "approx", "gave",
    "mobile", "only", "area", "colony", "market", "house", "lane",
]

LOCALITIES = [
    "Gomti Nagar", "Vibhuti Khand", "Hazratganj", "Indira Nagar", "Mahanagar", "Alambagh", "Charbagh",
    "Aminabad", "Chowk", "Kaiserbagh", "Aliganj", "Vikas Nagar", "Chinhat", "Sarojini Nagar",
]

HONORIFICS = r"(?i)\b(mr|mrs|ms|dr|shri|smt|sri|late|mohd|md)\b\.?"
RELATIONS = r"(?i)\b(s/o|d/o|w/o|son\s+of|daughter\s+of|wife\s+of|r/o|c/o|alias|a\.k\.a\.?|bhai)\b"
INITIALS = r"\b([A-Za-z])\.\s*"
NOISE = r"(?i)\b(s/o|d/o|w/o|son of|daughter of|wife of|alias|a\.k\.a\.?|r/o|c/o)\b"

# Spelling variants, replaced in this order.
PHONETIC = [
    ("aa", "a"), ("ee", "i"), ("ii", "i"), ("oo", "u"), ("uu", "u"), ("ai", "e"),
    ("w", "v"), ("q", "k"), ("ph", "f"), ("z", "j"),
]

# Identifier patterns, in order of priority.
PHONE = r"(?<!\d)(?:\+91[-\s]?|0)?([6-9]\d{9})(?!\d)"
IMEI = r"(?<!\d)(\d{15})(?!\d)"
VEHICLE = r"(?i)\b([A-Z]{2}[-\s]?\d{1,2}[-\s]?[A-Z]{1,3}[-\s]?\d{1,4})\b"
ACCOUNT = r"(?<!\d)(\d{9,18})(?!\d)"

# Devanagari sounds.
VOWELS = {"अ": "a", "आ": "aa", "इ": "i", "ई": "ee", "उ": "u", "ऊ": "oo", "ऋ": "ri", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au"}
VOWEL_SIGNS = {"ा": "aa", "ि": "i", "ी": "ee", "ु": "u", "ू": "oo", "ृ": "ri", "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "ॅ": "e", "ॉ": "o"}
CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "n", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "n", "ट": "t",
    "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n", "प": "p", "फ": "ph",
    "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v", "श": "sh", "ष": "sh", "स": "s", "ह": "h",
}
DOTTED = {"क": "q", "ख": "kh", "ग": "gh", "ज": "z", "ड": "r", "ढ": "rh", "फ": "f"}
NASALS = {"ं": "n", "ँ": "n", "ः": "h"}
DOT, VIRAMA, DANDA = "़", "्", "।"
