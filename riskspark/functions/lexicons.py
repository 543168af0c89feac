"""Word lists and point tables of the scoring rules, and helpers that compile them to one pattern.

The dimension files (countries, materials, ports, routes, lexicon, feed registry) are data of the user:
see ``riskspark.sources.dims``. The lists here are fixed values: results depend on them word for word.
"""

from __future__ import annotations

import re

# Supply-chain context words, matched as substrings.
SUPPLY_CHAIN = [
    "supply chain", "supplier", "manufacturer", "factory", "plant", "production", "shipment", "freight", "logistics", "warehouse",
    "inventory", "procurement", "sourcing", "vendor", "component", "assembly", "semiconductor", "chip", "wafer", "port", "cargo",
    "container", "shipping", "trade", "export", "import", "raw material", "commodity", "stockpile", "shortage", "capacity", "throughput",
    "tier-1", "tier 1", "oem", "contract manufacturer", "foundry", "just-in-time", "just in time", "lead time", "bill of materials",
    "lng", "liquefied natural gas", "natural gas", "pipeline", "refinery", "oil field", "gas field", "oil terminal", "gas terminal",
    "tanker", "supertanker", "vlcc", "lng carrier", "regasification", "liquefaction", "petrochemical", "crude oil", "refined product",
    "upstream", "downstream", "midstream", "wellhead", "rig", "offshore platform", "onshore", "gas plant", "processing plant",
    "feedstock", "fuel supply", "energy supply", "power grid", "electricity grid", "grid outage", "blackout", "brownout",
    "power plant", "solar farm", "wind farm", "battery storage", "lithium", "cobalt", "nickel", "rare earth", "critical mineral",
    "mining", "mine", "smelter", "ore", "concentrate",
]

# Signals of press releases.
PRESS_RELEASE = [
    "press release", "for immediate release", "announces", "announced today", "proud to announce", "pleased to announce", "partnership with",
    "new product launch", "quarterly results", "earnings call", "investor relations", "shareholder", "dividend", "ipo",
    "we are excited", "delighted to", "proud to present",
]

# Phrases that name a country without meaning it.
GEO_NOISE = ["china clay", "china cabinet", "china set", "jordan almonds", "turkey dinner", "iran-ic", "india ink", "india rubber"]

# Points of a disruption domain; any other has OTHER_DOMAIN_POINTS.
DOMAIN_POINTS = {"conflict": 8, "commodity": 8, "labour": 7, "weather": 6, "political": 6, "infrastructure": 7, "regulatory": 6, "pandemic": 5}
OTHER_DOMAIN_POINTS, MULTI_DOMAIN_BONUS = 5, 5

# Phrases of domains that are matched besides those of the lexicon file.
INLINE_DOMAINS = {
    "infrastructure": [
        "pipeline rupture", "pipeline explosion", "pipeline leak", "pipeline fire", "refinery fire", "refinery explosion", "refinery outage", "refinery shutdown",
        "plant shutdown", "plant explosion", "facility shutdown", "terminal closure", "power outage", "blackout", "grid failure", "grid collapse", "grid disruption",
        "gas leak", "oil spill", "tanker collision", "tanker grounding", "platform shutdown", "rig accident", "well blowout",
        "compressor failure", "pump failure", "equipment failure", "infrastructure attack", "sabotage",
    ],
    "regulatory": [
        "sanctions", "export ban", "import ban", "export restriction", "trade embargo", "trade ban", "permit suspended", "licence revoked",
        "regulatory halt", "regulatory shutdown", "compliance failure", "forced shutdown", "government seizure", "nationalisation", "expropriation", "asset freeze",
    ],
    "commodity": [
        "price surge", "price spike", "supply crunch", "supply squeeze", "shortage", "scarcity", "stockpile depletion", "inventory shortage",
        "production cut", "output cut", "quota reduction", "lng shortage", "gas shortage", "oil shortage", "fuel shortage", "energy shortage", "power shortage", "electricity shortage",
    ],
}

# A small lexicon for tests and demonstrations; the full one is the user's lexicon file.
SAMPLE_LEXICON = {
    "pandemic": ["outbreak", "virus", "quarantine", "epidemic", "infections"],
    "labour": ["strike", "walked out", "union", "works council", "night shift"],
    "conflict": ["sanctions", "blockade", "attack", "embargo", "war risk"],
    "weather": ["storm", "flooding", "drought", "heavy rain", "aftershock"],
    "commodity": ["shortage", "sold out", "ran out", "rationing"],
    "political": ["protests", "elections", "tariff", "customs duty"],
}

# Industries in order of precedence; words stand alone, phrases are substrings.
INDUSTRIES = {
    "energy": ["lng", "oil", "gas", "refinery", "pipeline", "energy", "petroleum", "fuel", "power", "electricity", "solar", "wind"],
    "mining": ["lithium", "cobalt", "nickel", "copper", "iron ore", "coal", "gold", "silver", "mining", "mine", "smelter"],
    "semiconductors": ["semiconductor", "chip", "wafer", "fab", "tsmc", "foundry", "silicon", "microchip", "processor"],
    "logistics": ["port", "shipping", "container", "freight", "carrier", "vessel", "tanker", "rail", "trucking", "last mile"],
    "agriculture": ["wheat", "corn", "soy", "grain", "fertilizer", "crop", "harvest", "drought", "food supply"],
    "manufacturing": ["factory", "plant", "assembly", "production line", "oem", "tier-1", "supplier", "component"],
    "financial": ["tariff", "sanctions", "currency", "forex", "inflation", "interest rate", "credit"],
}

# Trust in outlets, the first that is part of the source's name counts.
OUTLET_TRUST = {
    "freightwaves": 0.92, "supplychaindive": 0.91, "joc.com": 0.90, "lloydslist": 0.90, "tradewindsnews": 0.88, "agpublications": 0.87, "semiconductorintelligence": 0.88,
    "electronicsnews": 0.85, "mining.com": 0.85, "reuters": 0.90, "bloomberg": 0.89, "financial times": 0.88, "the wall street journal": 0.87, "nikkei": 0.87,
    "south china morning post": 0.84, "associated press": 0.88, "agence france-presse": 0.87, "the guardian": 0.82, "bbc news": 0.83, "cnbc": 0.78, "forbes": 0.72, "techcrunch": 0.74,
}
OTHER_TRUST = 0.70

# Phrases of severity, propagation of domains and concentration of commodities in the older score.
HIGH_SEVERITY = [
    "complete halt", "full shutdown", "indefinitely suspended", "catastrophic", "major disruption", "critical shortage", "emergency", "force majeure", "grounded", "closure",
    "explosion", "collapsed", "destroyed", "blocked", "immediate effect", "effective immediately",
]
MEDIUM_SEVERITY = [
    "significant delay", "reduced capacity", "slowdown", "disrupted", "affected", "constrained", "impacted", "shortfall", "supply chain risk", "concerns",
    "warning", "alert", "monitoring", "uncertainty",
]
PROPAGATION = {"infrastructure": 8.5, "geopolitical": 8.0, "cyber_technology": 8.0, "labor": 7.0, "natural_disaster": 7.0, "financial": 7.5, "pandemic_health": 8.0, "regulatory": 5.5, "unknown": 4.0}
CONCENTRATION = {"lithium": 1.8, "rare earth": 1.9, "cobalt": 1.7, "semiconductor": 1.6, "steel": 1.3, "iron ore": 1.2, "copper": 1.1, "oil": 1.1, "gas": 1.1, "wheat": 1.1}

# Words that are no keywords.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were be been has have had will would could should that this it its they their them he she "
    "his her we our you your can may might not no new report said says say also after over more about up out into amid due per vs"
).split()

# Terms of country queries.
COUNTRY_TERMS = ["supply chain", "factory", "port", "logistics", "strike", "flood", "earthquake", "sanctions", "shortage", "disruption", "tariff", "export ban", "conflict"]
COMMODITY_TERMS = ["shortage", "export ban", "scarcity", "supply disruption", "price surge", "supply squeeze", "production halt", "output cut"]
ORIGIN_TERMS = ["strike", "ban", "shortage", "protest", "earthquake", "flood", "conflict", "embargo", "export restriction", "drought"]

# Weight of node types.
NODE_WEIGHT = {"supplier": 100, "material": 80, "port": 60, "route": 40, "country": 20}

EDGE_LEFT, EDGE_RIGHT = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def _escape(word: str) -> str:
    """Escapes that mean the same in Java's and RE2's patterns."""
    return re.sub(r"([.^$*+?()\[\]{}|\\/-])", r"\\\1", word)


def any_of(words: list[str]) -> str:
    return "(?:" + "|".join(_escape(w) for w in words) + ")"


def whole_words(words: list[str]) -> str:
    """One pattern that finds any of the words or phrases standing alone."""
    return EDGE_LEFT + any_of(words) + EDGE_RIGHT
