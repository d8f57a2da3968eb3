"""Lookup tables of the normalization."""

# Results depend on these entries.
LEGAL_FORMS = {
    "inc": "inc", "incorporated": "inc", "llc": "llc", "corp": "corp", "corporation": "corp", "co": "co", "company": "co",
    "ltd": "ltd", "limited": "ltd", "lp": "lp", "llp": "llp", "pllc": "pllc", "pc": "pc",
    "pvt": "pvt", "private": "pvt", "opc": "opc",
    "praivet": "pvt", "praibhet": "pvt", "piraivet": "pvt", "praivrr": "pvt", "limitet": "ltd", "limirrd": "ltd", "elelpi": "llp",
    "sa": "sa", "sas": "sas", "sasu": "sasu", "sarl": "sarl", "eurl": "eurl", "sci": "sci", "snc": "snc", "ste": "ste", "societe": "ste",
    "ei": "ei", "eirl": "ei", "selarl": "selarl", "scop": "scop", "scp": "scp", "gie": "gie", "sca": "sca", "cie": "co", "compagnie": "co",
}
NAME_TOKENS = {"ets": "etablissements", "etab": "etablissements", "etabl": "etablissements", "st": "saint", "intl": "international", "assn": "association", "assoc": "association"}
NAME_PHRASES = {"pra li": "pvt ltd"}
NAME_STOPWORDS = ["the", "and", "of", "de", "du", "des", "la", "le", "les", "et", "www", "com", "au", "aux"]
STREET_TYPES = {
    "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "bd": "boulevard", "ln": "lane", "dr": "drive", "nr": "near",
    "opp": "opposite", "ngr": "nagar", "mkt": "market", "pl": "place", "rte": "route", "ch": "chemin", "imp": "impasse", "ct": "court",
    "cir": "circle", "hwy": "highway", "pkwy": "parkway", "trl": "trail", "sq": "square", "r": "rue", "all": "allee",
    "bld": "boulevard", "boul": "boulevard", "crs": "cours", "fbg": "faubourg", "fg": "faubourg", "chem": "chemin", "res": "residence", "qu": "quai",
}
PART_START = {"st": "saint", "ste": "sainte"}
STREET_END_ONLY = {"st": "street"}
ORDINALS = {"first": "1st", "second": "2nd", "third": "3rd", "fourth": "4th", "fifth": "5th", "sixth": "6th", "seventh": "7th", "eighth": "8th", "ninth": "9th", "tenth": "10th"}
ADDRESS_DROP = ["de", "du", "des", "la", "le", "les", "et", "null"]
ADDRESS_DESIGNATORS = ["unit", "apt", "apartment", "suite", "ste", "no", "ndeg", "flat", "floor", "fl", "door", "plot", "house"]
LANDMARK_CUES = ["near", "opposite", "behind", "beside", "next to", "pres de", "en face de"]
# Fixed patterns: which strings are elisions, dotted acronyms, the "M/s" before a name and house numbers is defined by them.
ELISION = r"\b[ld]'(?=[a-z])"
DOTTED = r"(?<=\b[a-z])\.(?=[a-z]\b)"
MESSRS = r"\bm/s\b"
HOUSE_NUMBER = r"(?<![a-z0-9])(\d+)([a-z])?(?:\s*-\s*(\d+))?(?![a-z0-9])"
#: Accented Latin letters and their plain forms.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY")
#: Letters that become two.
DIGRAPHS = {"ß": "ss", "œ": "oe", "æ": "ae", "Œ": "OE", "Æ": "AE"}
