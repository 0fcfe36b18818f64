"""Comparison of two spellings of one name; plain Python for use inside Arrow batches.

A value is parsed once into a :class:`Value`; :func:`same_value` says whether two values name the same thing and how surely.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cached_property, lru_cache

import regex

# Common English forms of address, articles, words of legal form, and words for kinds of organisations.
TITLES = frozenset("dr prof professor rev reverend capt captain mr mrs ms miss sir dame lady lord fr hon col gen lt sgt".split())
ARTICLES = frozenset("the an".split())
FUNCTION_WORDS = frozenset("of and the in for to from over under on at with by an".split())
LEGAL_FORMS = frozenset("ltd limited inc incorporated llc plc gmbh partners".split())
ORG_WORDS = frozenset(
    "department trust institute association company corporation foundation laboratory university society school college bank group agency "
    "ministry museum office board council committee union club press studio studios federation league academy commission authority "
    "hospital orchestra theatre party network bureau centre center cooperative syndicate guild chamber".split()
)
ORG_SHORT = frozenset("dept fdn inst tr co corp univ assoc assn soc lab labs".split())
MONTHS = {m: i + 1 for i, m in enumerate("january february march april may june july august september october november december".split())}
SHORT_GIVEN_NAMES = frozenset("al bo ed jo ty li yu an bi wu xu ma le vi cy".split())

# Usual short forms of given names, after each the full names it may stand for.
NICKNAMES = {
    "abby": "abigail", "al": "albert alan alfred alexander", "alec": "alexander", "alex": "alexander alexandra aleksandra", "andy": "andrew andreas",
    "annie": "anne anna", "barb": "barbara", "bea": "beatrice", "becky": "rebecca", "ben": "benjamin", "benny": "benjamin", "bert": "albert robert herbert",
    "beth": "elizabeth", "betsy": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert",
    "carl": "charles", "cath": "catherine katherine", "charlie": "charles", "chris": "christopher christina", "chuck": "charles", "dan": "daniel",
    "danny": "daniel", "dave": "david", "dick": "richard", "dolly": "dorothy", "dora": "dorothy theodora", "dot": "dorothy", "dotty": "dorothy",
    "ed": "edward edwin", "eddie": "edward", "ellie": "eleanor elizabeth helen", "fran": "frances francisco", "frank": "francis franklin francisco",
    "fred": "frederick alfred", "freddie": "frederick", "fritz": "frederick friedrich", "gabby": "gabriela gabrielle", "gabe": "gabriel", "gina": "regina",
    "greg": "gregory gregor", "gus": "august augustus augusta", "gussie": "augusta", "hal": "harold henry", "hank": "henry", "harry": "harold henry",
    "hettie": "henrietta", "etta": "henrietta", "jack": "john", "jake": "jacob", "jan": "johannes janet", "jeff": "jeffrey", "jenny": "jennifer",
    "jim": "james", "jimmy": "james", "joe": "joseph", "joey": "joseph", "johnny": "john", "jo": "josephine joanna", "josie": "josephine", "kate": "katherine catherine",
    "kathy": "katherine catherine", "katie": "katherine catherine", "kit": "katherine christopher", "kitty": "katherine", "larry": "lawrence", "len": "leonard",
    "lenny": "leonard", "leo": "leonard leopold", "lex": "alexander", "libby": "elizabeth", "lisa": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "maggie": "margaret",
    "meg": "margaret", "peggy": "margaret", "greta": "margaret", "madge": "margaret", "matt": "matthew", "mick": "michael mikhail", "mike": "michael mikhail",
    "misha": "mikhail", "moll": "mary", "molly": "mary", "nan": "anne", "nat": "nathaniel natalie", "nate": "nathaniel", "ned": "edward", "nell": "eleanor helen",
    "nellie": "eleanor helen", "nick": "nicholas", "pat": "patricia patrick", "patty": "patricia", "trish": "patricia", "phil": "philip", "rick": "richard frederick",
    "ricky": "richard", "rich": "richard", "rob": "robert", "robbie": "robert", "ron": "ronald", "rosie": "rosalind rose", "roz": "rosalind", "sally": "sarah",
    "sam": "samuel samantha", "sammy": "samuel", "sandy": "alexander alexandra aleksandra", "sasha": "alexander aleksandra", "steve": "stephen steven", "sue": "susan",
    "ted": "edward theodore", "teddy": "theodore edward", "theo": "theodore", "tim": "timothy", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "vic": "victor victoria",
    "vicky": "victoria", "will": "william", "xan": "alexander", "zack": "zachary", "zach": "zachary", "zac": "zachary",
    "beppe": "giuseppe", "beppo": "giuseppe", "bruni": "brunhilde", "cilla": "priscilla", "dodo": "dorothea", "elli": "eleanor elisabeth", "gabi": "gabriela gabriele", "gigi": "luigi",
    "hannes": "johannes", "hans": "johannes", "jannis": "johannes yannick", "lilly": "elizabeth lilian", "lola": "dolores", "lupe": "guadalupe", "nacho": "ignacio", "nico": "nicholas",
    "nora": "eleanor", "ola": "orla", "ollie": "oliver olivia", "paco": "francisco", "pancho": "francisco", "pepe": "jose", "peppe": "giuseppe", "richie": "richard", "sascha": "alexander aleksandra",
    "tori": "victoria", "ulla": "ursula", "uschi": "ursula", "vasya": "vasily", "wolf": "wolfgang",
}

_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = regex.compile(r"\p{Cf}+")
_MARKS = regex.compile(r"[\p{Mn}\p{Cf}\p{Me}]+")
_CAMEL = re.compile(r"(?<=[a-zß-öø-ÿ0-9])(?=[A-ZÀ-ÖØ-Þ])")
_SEPARATOR = re.compile(r"[\s_\-–/.,]")
_EDGE = " _-–/.,;!\"'`()[]«»“”\n\t\u00a0"
_DIGITS = re.compile(r"\d+")
_ISO = re.compile(r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$")


class Value:
    """A parsed value.

    ``key``: letters and digits, accents removed, titles and articles dropped; ``comma``: the number of tokens before the first
    comma, 0 without one; ``canonical``: dates in ISO form, numbers without the words around them, else the key.
    """

    def __init__(self, key: str, digits: tuple[str, ...], tokens: tuple[str, ...], comma: int, canonical: str):
        self.key, self.digits, self.tokens, self.comma, self.canonical = key, digits, tokens, comma, canonical

    @cached_property
    def is_org(self) -> bool:
        t = self.tokens
        return len(t) > 1 and (t[-1] in LEGAL_FORMS or t[-1] in ORG_SHORT or any(_org_word(x) for x in t))

    @cached_property
    def content(self) -> tuple[str, ...]:
        """The tokens that can tell one organisation from another."""
        return tuple(t for t in self.tokens if t not in FUNCTION_WORDS and t not in LEGAL_FORMS)

    @cached_property
    def content_set(self) -> frozenset[str]:
        return frozenset(self.content)

    @cached_property
    def readings(self) -> list[tuple[str, tuple[str, ...]]]:
        """(surname, given names) in every reading: as the comma says, else last word or first word as the surname."""
        t = self.tokens
        if self.comma == 1:
            readings = [(t[0], t[1:])]
        else:
            readings = [(t[-1], t[:-1])] + ([(t[0], t[1:])] if len(t) == 2 else [])
        out = []
        for surname, given in readings:
            parts: list[str] = []
            for g in given:
                parts += list(g) if len(g) == 2 and g not in SHORT_GIVEN_NAMES and g not in NICKNAMES else [g]
            if len(surname) > 1:
                out.append((surname, tuple(parts)))
        return out

    @cached_property
    def is_name(self) -> bool:
        """Two to five words without digits or function words."""
        return not self.digits and 2 <= len(self.tokens) <= 5 and not any(t in FUNCTION_WORDS for t in self.tokens)


def fold(text: str) -> str:
    """Lower case without accents and invisible characters."""
    if text.isascii():
        return text.lower()
    return _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower()


def _date(tokens: list[str]) -> str | None:
    """ISO form of 'day month year' or 'month day year' in words."""
    if len(tokens) != 3:
        return None
    month = next((t for t in tokens if t in MONTHS), None)
    numbers = [t for t in tokens if t.isdigit()]
    if month is None or len(numbers) != 2:
        return None
    year = max(numbers, key=len)
    day = numbers[1 - numbers.index(year)]
    if len(year) != 4 or len(day) > 2:
        return None
    return f"{year}-{MONTHS[month]:02d}-{int(day):02d}"


@lru_cache(maxsize=200_000)
def _org_word(token: str) -> bool:
    return token in ORG_WORDS or (len(token) >= 6 and any(within_one(token, w) for w in ORG_WORDS))


@lru_cache(maxsize=200_000)
def parse(text: str) -> Value:
    visible = _INVISIBLE.sub("", text)
    if not re.search(r"[\s_\-–/.,]", visible.strip(" _-–/.,;!\"'`()[]«»“”\n\t ")):
        visible = _CAMEL.sub(" ", visible)
    if "," not in visible and visible.isascii():
        tokens, before = _WORD.findall(visible.lower()), 0
    else:
        words = [(fold(m.group()), m.end()) for m in _WORD.finditer(visible)]
        words = [(w, e) for w, e in words if w]
        cut = visible.find(",")
        before = sum(1 for _, e in words if e <= cut) if cut > 0 else 0
        if before == len(words):
            before = 0
        tokens = [w for w, _ in words]
    while len(tokens) > 1 and (tokens[0] in TITLES or tokens[0] in ARTICLES):
        tokens.pop(0)
        before = max(0, before - 1)
    joined = "".join(tokens)
    if joined.isalpha():
        return Value(joined, (), tuple(tokens), before, joined)
    digits = tuple(_DIGITS.findall(" ".join(tokens)))
    iso = _ISO.match("-".join(tokens)) if len(tokens) == 3 else None
    key = "".join(tokens)
    canonical = key
    if iso:
        canonical = f"{iso[1]}-{int(iso[2]):02d}-{int(iso[3]):02d}"
    elif (date := _date(tokens)) is not None:
        canonical = date
    elif digits:
        rest = [t for t in tokens if t not in ("year", "years", "c", "ca", "circa", "about", "in", "ad", "ce", "minutes", "min", "mins", "people", "employees")]
        canonical = "".join(rest) or key
    return Value(key, digits, tuple(tokens), before, canonical)


def within_one(a: str, b: str) -> bool:
    """At most one letter inserted, dropped, replaced, or exchanged with its neighbour."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return False
    i = 0
    while i < la and i < lb and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < la and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if la > lb else a[i:] == b[i + 1 :]


def _formal(name: str) -> set[str]:
    return {name, *NICKNAMES.get(name, "").split()}


@lru_cache(maxsize=200_000)
def given_match(a: str, b: str) -> int:
    """2: the same given name (or a short form or a slip of it); 1: one is the other's initial; 0: different."""
    if len(a) == 1 or len(b) == 1:
        if len(a) == len(b):
            return 2 if a == b else 0
        short, full = (a, b) if len(a) == 1 else (b, a)
        return 1 if any(f[0] == short for f in _formal(full)) else 0
    if a == b or _formal(a) & _formal(b):
        return 2
    if min(len(a), len(b)) >= 4 and within_one(a, b) or min(len(a), len(b)) == 3 and abs(len(a) - len(b)) == 1 and within_one(a, b):
        return 2
    if any(len(f) >= 5 and len(g) >= 5 and within_one(f, g) for f in _formal(a) for g in _formal(b)):
        return 2
    return 0


def surname_match(a: str, b: str) -> bool:
    return a == b or (min(len(a), len(b)) >= 5 and within_one(a, b))


def orders(v: Value) -> list[tuple[str, tuple[str, ...]]]:
    """(surname, given names) in every reading of a name."""
    return v.readings


def same_person(a: Value, b: Value) -> int:
    """2: the same person; 1: the same, if nobody else of the family has that initial; 0: different."""
    best = 0
    for sa, ga in orders(a):
        for sb, gb in orders(b):
            if not ga or not gb or not surname_match(sa, sb):
                continue
            level = given_match(ga[0], gb[0])
            if level and len(ga[0]) == 1 and len(gb[0]) == 1:
                level = 1
            if level and len(ga) > 1 and len(gb) > 1:
                level = min(level, 2 if given_match(ga[1], gb[1]) else 0)
            best = max(best, level)
    return best


def is_abbreviation(short: str, full: str) -> bool:
    """A shortened word: the same first letter, and all its letters in order in a clearly longer word."""
    if len(short) >= 3 and len(short) < len(full) and full.startswith(short):
        return True
    if len(short) >= len(full) - 1 or len(short) < 2 or len(full) < 5 or short[0] != full[0]:
        return False
    rest = iter(full)
    return all(c in rest for c in short)


def _hopeless(a: Value, b: Value) -> bool:
    """Whether too many words of the side with fewer words lack any that could pay for them; says no more than :func:`same_org`.

    Words that pay for each other agree in the first letter or, if the slip is there, in the last two.
    """
    big, small = (a, b) if len(a.content) >= len(b.content) else (b, a)
    if len(big.content_set) < len(big.content) or len(small.content_set) < len(small.content):
        return False
    rest = big.content_set - small.content_set
    lone = [y for y in small.content_set - big.content_set if not any(x[0] == y[0] or x[-2:] == y[-2:] for x in rest)]
    return len(lone) > 1 or (len(lone) == 1 and not 2 <= len(lone[0]) <= 4) or (not lone and len(big.content) - len(small.content) > 4)


def same_org(a: Value, b: Value) -> int:
    """2: all words agree in any order (slips, shortened words); 1: one lacks a word or is an acronym; 0: different."""
    if _hopeless(a, b):
        return 0
    ta, tb = list(a.content), list(b.content)
    if len(ta) < len(tb):
        ta, tb = tb, ta
    if not tb:
        return 0
    left = list(ta)
    unmatched = []
    anchored = False
    for test in (lambda x, y: x == y, lambda x, y: min(len(x), len(y)) >= 4 and within_one(x, y), lambda x, y: is_abbreviation(x, y) or is_abbreviation(y, x)):
        for y in list(tb):
            hit = next((x for x in left if test(x, y)), None)
            if hit is not None:
                anchored |= (hit == y or within_one(hit, y)) and len(y) >= 5 and y not in ORG_WORDS
                left.remove(hit)
                tb.remove(y)
    unmatched = tb
    if not anchored:
        return 0
    if not unmatched:
        if not left:
            return 2
        return 1 if len(left) == 1 and len(ta) >= 3 and (left[0] in ORG_WORDS or len(ta) - len(left) >= 2) else 0
    if len(unmatched) == 1 and 2 <= len(unmatched[0]) <= 4 and len(unmatched[0]) == len(left) and sorted(unmatched[0]) == sorted(x[0] for x in left):
        return 1
    return 0


def same_value(a: str, b: str, fuzzy: bool = True) -> int:
    """Whether two values are spellings of the same thing: 2 surely, 1 by an initial, acronym or lacking word only, 0 no.

    Digits never differ: another year or number is another value, however alike the rest is. ``fuzzy`` false allows no slips and
    no initials (for places, whose names differ by single letters), except between organisations.
    """
    va = parse(a)
    if a == b:
        return 2 if va.key else 0
    vb = parse(b)
    if va.key == vb.key or va.canonical == vb.canonical:
        return 2 if va.key else 0
    if va.digits != vb.digits:
        return 0
    org = va.is_org or vb.is_org
    if not fuzzy and not org:
        return 0
    ka, kb = va.key, vb.key
    # one slip in seven letters or more leaves the first three or the last three alike
    if (ka[:3] == kb[:3] or ka[-3:] == kb[-3:]) and -2 < len(ka) - len(kb) < 2 and min(len(ka), len(kb)) >= 7 and within_one(ka, kb):
        return 2
    if va.digits:
        return 0
    if org:
        return same_org(va, vb)
    if va.is_name and vb.is_name:
        return same_person(va, vb)
    return 0
