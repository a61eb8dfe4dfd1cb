"""A small labelled URL table (1: unwanted site), built from general word lists by rules.

Hosts are compounds of a telling part and a neutral partner; partners, prefixes, suffixes and paths are the same for
both labels, so only the parts can tell.  No whole host is taken from the pages that a model judges, though parts of theirs are
among the words.  The held-out table joins the parts in other ways and with other partners, and has ordinary names that training doesn't have.
"""

import random

# Word parts that are common in the names of unwanted sites, and words of ordinary ones.
UNWANTED = ["casino", "poker", "slots", "jackpot", "bet", "bets", "gamble", "lottery", "win", "prize", "bonus", "adult", "xxx", "porn", "escort", "viagra", "pills", "pharma", "cheap", "replica", "fake", "loan", "payday", "spam", "scam", "ads", "track", "popup", "click", "warez", "crack", "hack", "free"]
ORDINARY = ["news", "library", "weather", "garden", "university", "museum", "recipes", "history", "school", "travel", "music", "science", "health", "city", "county", "church", "theatre", "sports", "forum", "wiki", "law", "physics", "photo", "bakery", "books", "football", "village", "river", "energy", "climate", "railway", "hospital"]
PARTNERS, OTHER_PARTNERS = ["zone", "club", "online", "world", "hub", "king"], ["farm", "house", "point", "land", "tube", "x"]
PREFIXES, SUFFIXES = ["", "www.", "blog.", "m."], ["example.com", "example.net", "example.org", "sample.com", "sample.net"]
PATHS = ["/", "/en/12", "/de/7.html", "/fr/301/", "/es/88?page=2", "/en/945#top"]
CONSONANTS, VOWELS = "bcdfghlmnprstvw", "aeiou"


def _names(count: int, seed: int) -> list[str]:
    """Invented names of two to four syllables, some with consonants in a row."""
    rng = random.Random(seed)
    syllable = lambda: rng.choice(CONSONANTS) + rng.choice(["", "", "h", "r"]) + rng.choice(VOWELS) + rng.choice(["", "n", "r", "s", "th"])
    return ["".join(syllable() for _ in range(rng.randint(2, 4))) for _ in range(count)]


def _urls(hosts: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Prefixes, suffixes and paths take turns; their periods share no factor with each other's."""
    return [(f"https://{PREFIXES[n % 4]}{host}.{SUFFIXES[n % 5]}{PATHS[n // 4 % 6]}", label) for n, (host, label) in enumerate(hosts)]


def labelled_urls() -> list[tuple[str, int]]:
    hosts = []
    for words, label in ((UNWANTED, 1), (ORDINARY, 0)):
        for k, word in enumerate(words):
            hosts.append((word, label))
            for i, partner in enumerate(PARTNERS):
                mark = ("", "-")[(i + k) % 2]
                hosts += [(f"{word}{mark}{partner}", label), (f"{partner}{('-', '')[(i + k) % 2]}{word}", label)]
    return _urls(hosts + [(name, 0) for name in _names(300, 1)])


def held_out_urls() -> list[tuple[str, int]]:
    hosts = [(f"{a}-{b}", 1) for a, b in zip(UNWANTED, UNWANTED[7:] + UNWANTED[:7], strict=True)]
    for words, label in ((UNWANTED, 1), (ORDINARY, 0)):
        hosts += [(f"{word}{('-', '')[k % 2]}{OTHER_PARTNERS[k % 6]}", label) for k, word in enumerate(words)]
    return _urls(hosts + [(name, 0) for name in _names(200, 2)])
