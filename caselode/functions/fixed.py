"""Fixed values that results depend on."""

# Courts of high and of medium importance, in the order in which test sources stand for them.
HIGH_COURTS = ("SG Court of Appeal", "SG Privy Council", "UK House of Lords", "UK Supreme Court", "High Court of Australia", "CA Supreme Court")
MEDIUM_COURTS = (
    "SG High Court", "Singapore International Commercial Court", "HK High Court", "HK Court of First Instance", "UK Crown Court", "UK Court of Appeal",
    "UK High Court", "Federal Court of Australia", "NSW Court of Appeal", "NSW Court of Criminal Appeal", "NSW Supreme Court",
)
MULTIPLIERS = {"H": 10.0, "M": 8.5, "L": 1.0}
CONTENT_SHARE, TITLE_SHARE = 0.8, 0.2
FEEDBACK_SHARE, FEEDBACK_ZONES, FEEDBACK_DOCS, FEEDBACK_TERMS, ROCCHIO_ALPHA = 0.5, 3500, 5, 5, 0.8
SYNONYMS_PER_TERM = 6

# Sets of words that are met in the same context.
SYNONYM_SETS = (
    ("payment", "accept", "agreement", "wallet", "money"),
    ("phone", "telephone", "number", "mobile"),
    ("damage", "damages", "fault", "harm", "injury", "injure", "suffer", "suffering", "death", "foreseeable"),
    ("grade", "class", "low", "university", "education", "ranking"),
    ("call", "dial", "harass", "assault", "repeated", "series", "answer", "threat"),
    ("prostitute", "prostitutes", "prostitution", "sex", "services", "intercourse", "sexual", "oral", "vaginal", "condom"),
    ("exchange", "emails", "programme", "smiles"),
    ("scandal", "cheat", "cheating", "fraud", "scam", "cash-for-coursework"),
    ("child", "parent", "children", "disabled", "healthy", "conditions", "risks", "birth", "unborn"),
    ("fraud", "fraudulently", "thief"),
    ("traffic", "collision", "car", "accident"),
    ("forced", "rape", "threaten", "consent", "consented"),
    ("quiet", "silence", "silent", "psychiatric", "injury", "illness", "fear", "unpleasant", "menacing", "distress"),
    ("good", "progress", "practise"),
    ("fertility", "in vitro", "fertilisation", "IVF", "ATD", "reproductive", "plan", "pregnancy", "embryo", "treatment", "child"),
    ("treatment", "genetic", "counselling", "sperm", "doctor"),
)

# The larger alternative thesaurus of the feedback search.
FEEDBACK_SYNONYM_SETS = (
    ("murder", "kill", "victim", "harm", "manslaughter"),
    ("bail", "ankle", "electronic", "monitoring", "bond", "exoneration", "forfeiture", "test", "cost"),
    ("knife", "weapon", "firearm", "balaclava", "ammunition", "gun", "machete", "machine gun", "rifle", "shotgun", "sword"),
    ("arson", "fire", "burn", "ignite", "pyro", "firebombing"),
    ("robbery", "burglary", "steal", "money", "jewelry", "rob", "heist", "mask"),
    ("provoke", "taunt", "tempt", "threaten"),
    ("assist", "acquaint", "accomplice", "partner", "in", "crime"),
    ("acquittal", "extradition", "not guilty"),
    ("scam", "fool", "fake", "fraud", "blackmail", "deceit", "deception", "extortion", "hoax", "sham", "ripoff", "cheat"),
    ("hate", "crime", "racist", "black", "asian", "yellow", "white", "race", "police brutality", "unfair", "biased"),
    ("corruption", "bribe", "extort", "nepotism", "fraud", "graft"),
    ("scandal", "misconduct", "sex", "grades", "affair", "gratification", "explicitly"),
    ("adult", "mature", "grownup", "grown", "of age", "adolescent", "infant", "child", "consent", "18", "minor", "legal", "alcohol"),
    ("kidnap", "pay", "phone", "call", "warehouse", "abandon"),
    ("drugs", "death penalty", "grams", "medical marijuana", "overdose", "OD", "drug cartel"),
    ("arrest", "capture", "detention", "prison", "imprisonment", "jail", "incarceration", "custody", "stop", "captivity"),
    ("drink-driving", "alcohol", "influence", "speeding", "red-light", "accident", "incident", "crash", "totaled", "car", "negligent"),
    ("rape", "sex", "intercourse", "carnal knowledge", "sexual assault", "molest", "violate", "forced", "penetration", "penis", "vagina"),
    ("quiet", "muted", "silent", "soft", "hushed", "low", "mute"),
    ("phone", "telephone", "call", "ring", "communicate", "relay"),
    ("prostitute", "payment", "gigolo", "hooker", "whore", "call girl", "degrade"),
    ("damage", "injury", "burn", "cripple", "harm", "hurt", "impair", "loss", "ravage", "ruin", "scorch", "tarnish", "wound", "wreck", "rot", "disfigure", "deface", "spoil"),
)

# Topics with the documents known to be relevant.
RELEVANCE = {
    "1": ("6807771", "3992148", "4001247"),
    "2": ("2211154", "2748529"),
    "3": ("4273155", "3243674", "2702938"),
    "comp_1": ("3992148", "2225598", "6807771", "4001247", "6017101", "2491447", "2881982", "2753029", "2654334", "6058463"),
    "comp_2": ("2713720", "3965827", "2225651", "2225598", "2621151", "2886949", "3988910", "3974455", "3383594", "2145566"),
    "comp_3": ("2128079", "2884850", "2743282", "3752148", "3926753", "2621079", "6801089", "2705783", "2881916", "6709004"),
    "comp_4": ("2702938", "4273155", "6079409", "6709605", "3243674", "6707679", "6709476", "3752282", "3752306", "3752202"),
    "comp_5": ("3984147", "2763746", "3752368", "3750577", "2225598", "2225491", "2620743", "3984152", "2254567", "6927452"),
    "comp_6": ("2748529", "3752204", "2211154", "2253593", "2621721", "2851048", "6708332", "246771", "2707154", "2407977"),
}

# Irregular verb forms: the default lexicon (regular forms keep their surface unless a lexicon says otherwise).
IRREGULAR_VERBS = {
    "be": "am is are was were been being", "have": "has had having", "do": "does did done doing", "go": "goes went gone going", "say": "says said saying",
    "make": "makes made making", "take": "takes took taken taking", "give": "gives gave given giving", "get": "gets got gotten getting", "see": "sees saw seen seeing",
    "know": "knows knew known knowing", "find": "finds found finding", "come": "comes came coming", "think": "thinks thought thinking", "hold": "holds held holding",
    "pay": "pays paid paying", "bring": "brings brought bringing", "tell": "tells told telling", "keep": "keeps kept keeping", "leave": "leaves left leaving",
}

# English words that are no topic of a document.
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from "
    "further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or "
    "other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until "
    "up very was we were what when where which while who whom why will with you your yours yourself yourselves"
).split()
