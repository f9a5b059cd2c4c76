"""Closed vocabularies, word lists and patterns that results depend on."""

from __future__ import annotations

# fixed values
TYPES = ["character", "location", "faction", "organization", "family", "creature", "item", "ability", "magic", "event", "quest", "mystery", "business", "other"]
STATUSES = ["confirmed", "rumor", "claim", "plan", "unresolved"]
SLOTS = ["occupation", "residence", "species", "age", "gender", "title", "allegiance", "status", "leader", "location", "owner", "purpose", "appearance"]
SLOT_ORDER = ["species", "age", "gender", "occupation", "title", "residence", "location", "allegiance", "leader", "owner", "status", "purpose", "appearance"]
RELATIONS = ["knows", "acquaintance", "ally", "friend", "employer", "employee", "rival", "enemy", "family", "mentor", "student", "romantic_interest", "partner", "other"]
ROMANTIC = ["romantic_interest", "partner"]
ACTIONS = ["create", "update", "mention", "ignore"]
UPDATE_STATES = ["confirmed", "false", "done", "abandoned"]

# fixed values: families of types
FAMILIES = {
    "character": "being", "creature": "being", "family": "group", "faction": "group", "organization": "group", "business": "place", "location": "place",
    "item": "thing", "ability": "power", "magic": "power", "event": "event", "quest": "event", "mystery": "event",
}

# fixed values: on, least appearances, least importance by type
TYPE_RULES = {
    "character": (True, 2, 3), "location": (True, 2, 3), "faction": (True, 2, 3), "organization": (True, 2, 3), "family": (True, 2, 3),
    "creature": (True, 2, 4), "item": (True, 2, 4), "ability": (True, 1, 5), "magic": (True, 1, 5), "event": (True, 1, 6), "quest": (True, 1, 5),
    "mystery": (True, 1, 6), "business": (True, 2, 3), "other": (False, 3, 5),
}

# fixed values: stop words
STOP_WORDS = "the a an of and in on at to from with for by his her their its is was are were be that this as or it he she they".split()

# fixed values: generic words that never name anything
GENERIC_WORDS = (
    "the a an man woman girl boy guard guards merchant waiter bartender he she it they him her them i you we me us city town village place person people "
    "lady lord sir master shop inn tavern road forest room house door night day old young stranger traveler traveller customer child kid soldier soldiers noble nobles"
).split()

# fixed values: articles and honorifics; descriptors add to them; nouns of relation
HONORIFICS = "the a an of and lord lady sir dame master miss mr mrs ms".split()
DESCRIPTORS = HONORIFICS + "young old little big great fox girl boy man woman elf dwarf beastfolk human".split()
RELATIONAL = "brother sister mother father son daughter wife husband friend servant ally enemy rival mentor student apprentice cousin uncle aunt lover partner boss employer".split()

# fixed values: whole-word lexicons, case-insensitive
HEDGE = [
    "seems?", "seemed", "appears? to", "appeared to", "might", "maybe", "perhaps", "possibly", "probably", "presumably", "allegedly", "supposedly", "apparently",
    "rumou?red", "rumou?rs?", "said to be", "thought to be", "believed to be", "speculat[A-Za-z0-9_]*", "suspects?", "suspected", "could be", "may be", "may have",
    "might have", "unclear", "uncertain",
]
FUTURE = [
    "plans? to", "planning to", "intends? to", "intending to", "is going to", "are going to", "going to", "will", "shall", "promises? to", "promised to",
    "vows? to", "vowed to", "swears? to", "aims? to", "hopes? to", "expects? to", "wants? to", "wishes? to", "scheduled to", "preparing to", "about to",
    "prepares to", "threatens? to",
]
CLAIM = [
    "claims?", "claimed", "says? (?:he|she|they|that|i)", "said (?:he|she|they|that)", "insists?", "insisted", "pretends?", "pretended", "lied", "lying about",
    "boasts?", "boasted", "alleges?", "alleged", "purports?", "professes?",
]
MENTAL = [
    "feels?", "felt", "feeling", "thinks?", "thought", "thinking", "wants?", "wanted", "decides?", "decided", "loves?", "loved", "likes?", "liked", "hates?",
    "hated", "trusts?", "trusted", "fears?", "feared", "intends?", "hopes?", "hoped", "believes?", "believed", "desires?", "craves?", "enjoys?", "enjoyed",
    "resents?", "regrets?", "consents?", "agrees?", "agreed", "chooses?", "chose", "swears?", "promises?", "attracted", "in love", "falls? for", "fell for",
]


# fixed values: why something that an extractor said is dropped
DROP_REASONS = {
    "no_shape": "not an object with an entities array",
    "no_name": "no name",
    "protagonist": "protagonist is never given a card",
    "no_source": "no cited messages (no provenance)",
    "agency": "asserts protagonist thoughts/feelings/choices",
    "no_quote": "evidence quote not found in cited messages",
    "bond_agency": "protagonist feelings/choices",
    "not_explicit": "romantic relationship not explicitly established",
    "bond_no_quote": "relationship evidence not found",
    "unknown_fact": "unknown fact id",
    "update_no_quote": "evidence not found",
}

# fixed values: titles of a card's uncertain parts
UNCERTAIN = (("rumor", "Rumors (unverified)"), ("claim", "Claims (may be false)"), ("plan", "Plans (not yet done)"), ("unresolved", "Unresolved"))

# fixed values: the members of an entry in the target besides those that are managed, as JSON text
ENTRY = {
    "keysecondary": "[]",
    "constant": "false",
    "vectorized": "false",
    "selective": "true",
    "selectiveLogic": "0",
    "addMemo": "true",
    "order": "100",
    "position": "0",
    "ignoreBudget": "false",
    "excludeRecursion": "false",
    "preventRecursion": "false",
    "matchPersonaDescription": "false",
    "matchCharacterDescription": "false",
    "matchCharacterPersonality": "false",
    "matchCharacterDepthPrompt": "false",
    "matchScenario": "false",
    "matchCreatorNotes": "false",
    "delayUntilRecursion": "0",
    "probability": "100",
    "useProbability": "true",
    "depth": "4",
    "outletName": '""',
    "group": '""',
    "groupOverride": "false",
    "groupWeight": "100",
    "scanDepth": "null",
    "caseSensitive": "null",
    "matchWholeWords": "null",
    "useGroupScoring": "null",
    "automationId": '""',
    "role": "0",
    "sticky": "null",
    "cooldown": "null",
    "delay": "null",
    "triggers": "[]",
    "characterFilter": '{"isExclude":false,"names":[],"tags":[]}',
}


def whole_words(words: list[str]) -> str:
    """A pattern for any of these as whole words, in Java, Python and RE2 syntax alike (ASCII word characters)."""
    return "(?:" + "|".join(words) + ")"
