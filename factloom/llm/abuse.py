"""Abusive, hateful and sexually explicit content by a weighted finite-state pattern grammar (problem 8).

A sentence is read by transducers composed one after the other, each on what the one before wrote: the lexical transducer maps words,
disguised ones included, to symbols; the target transducer marks who may be meant, groups by their place in the sentence and not by a
list of names; the negation and reported-speech transducers mark the words they govern; the pattern transducers (insult, threat,
group, sexual) read all of it and pay weights, nothing for what is denied or reported. What counts is a whole clause, never a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from factloom.llm.names import fold

#: A clause of this weight or more is a case.
THRESHOLD = 2.0
#: Words between a weighed match and one that reports it or sets it in a sober context.
CONTEXT = 9
CATEGORIES = ("abusive", "hateful", "sexual")

# --- lexical transducer: word -> symbols. Word classes in English, German, Spanish and French, accents removed ----

WORDS = {
    "YOU": "you your yours yourself u ya youre youll du dich dir dein deine deinen deiner euch ihr tu te ti toi ton ta tes vous votre tus eres usted vosotros",
    "ME": "i ill im we well ich wir je nous yo",
    "WILL": "will ll gonna would shall could swear going werde werden vais voy vamos",
    "THEY": "they theyre sie ellos ellas ils elles",
    "THEM": "them sie los las les ihnen",
    "BE": "are re is sind son sont remain stay bleiben siguen restent",
    "REMAIN": "remain remains stay stays bleibt bleiben sigue siguen reste restent be",
    "ALWAYS": "always forever immer siempre toujours",
    "MODAL": "should must ought sollte sollten muss mussen habria hay faudrait faut deberian devrait devraient need",
    "NOT": "not never no nobody noone none dont doesnt isnt arent wont wouldnt shouldnt cannot cant didnt nicht kein keine keiner keinen nie niemand nunca jamais pas personne nadie ni",
    "INSULT": "idiot idiots moron morons imbecile imbeciles cretin cretins bastard bastards scumbag scumbags loser losers asshole assholes arsehole arseholes dumbass jackass dickhead prick pricks "
    "wanker wankers twat twats bitch bitches whore whores slut sluts cunt cunts motherfucker fucker shithead douchebag parasite vermin worm maggot pig swine halfwit nitwit dimwit fool fools retard retards "
    "lowlife degenerate clown bonehead blockhead numbskull twit coward scum ratte schwachkopf vollidiot idioten idiotin arschloch arschlocher wichser hurensohn schlampe "
    "dummkopf trottel depp drecksau missgeburt versager mistkerl penner spasti connard connasse salaud salope encule ordure abruti cretine debile batard pourriture idiote "
    "con conne idiota idiotas imbecil cabron cabrona gilipollas pendejo puta puto mamon capullo estupido estupida hijoputa inutil tarado basura escoria",
    "SLIGHT": "stupid dumb ugly worthless pathetic disgusting useless miserable absolute goddamn filthy brainless braindead drunk wertloser wertlose dummes dumme dummer bloder widerlicher inutile pauvre sale stupide minable asqueroso patetico maldito",
    "HARM": "kill beat break breaks smash punch stab shoot strangle hurt hunt crush cut slit burn rape murder slap choke bash thrash destroy gut drown hang kick skin cripple maim schlage schlagen schlag toten tote brechen breche "
    "umbringen prugeln verprugle aufschlitzen erschlage matar matare romper reventar partir pegar quemar casser tuer frapper crever buter briser defoncer",
    "BODY": "face teeth fingers bones neck legs head skull nose jaw throat arms knees ribs cara dientes huesos cuello figure gueule dents os nuque zahne fresse knochen genick hals",
    "PUNISHED": "beating beatings kicking whipping thrashing lynching flogging slap bullet noose death verprugelt erschlagen eingesperrt prugel paliza golpes gifle raclee",
    "DOOMED": "locked shot hanged beaten jailed caged drowned sterilised sterilized whipped flogged executed gassed burned exterminated lynched wiped",
    "DIE": "die dies died dead drown vanish vanished disappear disappeared hang perish burn crever creve mourir morir mueras mueran muere muera muerte sterben stirb verrecke verrecken krepier disparaitre",
    "MOURN": "tear miss cry care mourn notice grieve weep regrettera pleurera vermissen trauern llorara",
    "DESERVE": "deserve deserves need needs verdient verdienen gehort gehoren merecen merece merite meritent",
    "DWELL": "live lives sleep work works home park walk school take lebst wohnst vives habites",
    "HEIGHT": "bridge pier roof cliff building tower window balcony train bus",
    "KIN": "mother father family children kids wife husband sister brother dog friends mutter vater madre padre mere pere",
    "GROUP": "women foreigners foreigner immigrants immigrant migrants refugees refugee disabled jews jew muslims muslim christians hindus gays lesbians homosexuals queers blacks whites asians "
    "arabs africans mexicans gypsies roma cripples peasants natives minorities auslander frauen fluchtlinge juden muslime schwule behinderte migranten zigeuner mujeres extranjeros inmigrantes judios "
    "musulmanes gitanos discapacitados femmes etrangers immigres juifs musulmans homosexuels handicapes migrantes",
    "VERMIN": "vermin cockroach cockroaches rats rat animals animal savages savage scum disease plague parasites parasite pigs subhuman subhumans apes monkeys insects lice maggots pest cancer "
    "ungeziefer ratten abschaum tiere wilde parasiten ratas rata alimanas escoria animales salvajes cucarachas plaga vermine sauvage sauvages racaille cafards animaux betes untermenschen",
    "DIRT": "trash garbage filth dirt rubbish dreck basura ordures dechets",
    "CRIME": "thief thieves criminal criminals liar liars rapists crooks murderers terrorists diebe dieb verbrecher lugner ladrones ladron criminales mentirosos voleur voleurs menteurs criminels",
    "DULL": "stupid lazy dumb dirty primitive inferior simple dumm faul tontos vagos betes paresseux",
    "DECENT": "decent honest respectable good clean clever anstandig ehrlich honrado honnete",
    "MOVE": "send put throw ship drive kick chase round pack herd drag haul schickt werft treibt mandar meter envoyer jeter",
    "PURGE": "deport expel banish exterminate gas drown hang burn shoot lynch sink eradicate cleanse castrate sterilise treiben ersaufen ertranken vergasen verbrennen erschiessen aufhangen rauswerfen "
    "echarlos echar quemarles quemarlos quemar matarlos matar ahogarlos colgarlos expulsarlos expulsar noyer tuer expulser pendre bruler chasser virer gazer",
    "GONE": "deported expelled driven banished exterminated shot hanged gassed sterilised sterilized burned drowned wiped locked removed eradicated castrated",
    "OUT": "out weg raus fuera dehors verschwinden",
    "ADMIT": "trust hire believe rent sell serve marry employ feed let admit welcome",
    "PLACE": "world country city town street neighbourhood neighborhood land village europe welt stadt land mundo pais ciudad monde pays ville",
    "BETTER": "better cleaner safer nicer richer",
    "ABODES": "quarter houses house homes shops district church mosque synagogue temple camp shelter casas maisons hauser hutten",
    "CLEAN": "clean safe peaceful beautiful quiet sauber sicher limpio limpia seguro propre sur",
    "NUDE": "naked nude nudes bare topless undressed nackt nackte nackten nackter desnuda desnudo desnudas desnudos desnudaron nu nue nus nues",
    "SEXPART": "breasts breast tits boobs nipples nipple cock dick penis pussy vagina clit thighs thigh crotch groin ass butt balls bra panties bruste brust schenkel schwanz muschi titten pechos tetas muslos polla cono seins cuisses bite chatte fesses",
    "SEXACT": "licked lick licking suck sucked sucking moan moaned moaning moans gasped gasp groaned thrust thrusting stroked caressed straddled undress undressed stripped strip kissing penetrated "
    "leckte lecken stohnte stohnen saugte gemia gemio gemir lamia lamer chupo chupar acariciaba gemissait lechait suce sucait caresses caressait",
    "FUCK": "fuck fucks fucked fucking fickten ficken fickte gefickt follaron follar follando follo baise baiser baisaient baisent cogieron coger",
    "SEXWORD": "sex sexo sexe sexy porn porno pornographic xxx erotic sexbilder sexvideos nudes orgasm masturbate blowjob handjob anal threesome horny geil geile geiles cachonda cachondo",
    "OFFER": "videos video pics pictures clips photos fotos bilder cam cams profile link show chat uncensored unzensiert censura censure adults adultos adultes erwachsene wet willing ride tonight escort escorts limits",
    "PRON": "he she him her them me they ils sie elles se y",
    "GARMENT": "bra panties shirt dress clothes trousers skirt blouse underwear",
    "SPEAKS": "said says reported reports report counts counted wrote called calls quoted quotes removed banned condemned article police court study analysis analysed dictionary meaning clinical history historical novel "
    "poem reader exhibition museum survey statistics moderators moderator policy complained complaint apologised judge trial lecture definition example research researchers archive witness claimed shouted "
    "polizei bericht zeitung gericht studie sagte policia informe juez estudio dijo rapport etude tribunal",
    "MEDICAL": "cancer health medical clinic clinical doctor doctors patient patients hospital disease screening therapy treatment anatomy education contraception hormones surgery",
    "RATED": "rated rating brief censors classified certificate statue sculpture painting painted portrait sketch",
    "THING": "software loader script process job query program code build server index bug machine node table film films movie movies plot ending act book books song album sequel game mouse mice rats pests",
    "GAME": "chess tennis cards poker golf game games match race races election league points goals quiz football",
}

# --- pattern transducers: weight and symbols; '..' is a gap of up to five words, '.' of up to two, a|b alternatives,
# --- UPPER case a symbol, lower case a word; G is any word that may name a group, which pays for itself (see _group) ---------

PATTERNS = {
    "abusive": """
        2 HARM|drown|hang|shoot yourself
        2 bring|bringt dich|euch um
        1.5 crawl|crawls back . hole|cave|gutter|rock|sewer
        2 jump|leap off|from|under|out . HEIGHT
        2 go|rot|burn to|in hell
        2 go and|to die
        1 shut your mouth|trap|face
        2 shut your mouth|trap|face .. INSULT
        2 halt die|dein|deine fresse|schnauze|maul|klappe
        2 verpiss|fick|verzieh dich
        2 ferme|fermez ta|vos gueule
        2 va|allez crever|mourir
        2 va te faire
        2 vete|vayase a la mierda|chingada
        2 callate|cierra .. INSULT
        2 que te jodan|follen|mueras
        2 ojala . te|YOU mueras|muera|maten
        2 fuck|screw you|off
        2 YOU are|re|is dead|finished|history
        2 watch|mind your back
        2 ME WILL .. HARM YOU
        2 ME WILL .. HARM . YOU BODY
        2 ME WILL .. find|hunt|get|visit . YOU|where
        2 make you regret|pay|suffer|bleed
        2 ME know where|which|what|how .. YOU DWELL
        2 where you DWELL . make|and
        2 know|knows where you DWELL
        2 ME hope|wish|pray .. HARM|DIE .. YOU
        2 ME hope|wish|pray .. YOU .. DIE|HARM|suffer|choke
        2 NOT would|will|ne|wird .. MOURN .. YOU
        2 NOT ne|wird te|dich MOURN
        1 leave|go|walk without|minus BODY
        1.5 say that . my face
        2 someone|people|INSULT|SLIGHT like YOU .. DOOMED
        2 like YOU MODAL .. DOOMED
        2 YOU DESERVE .. PUNISHED|die
        2 a INSULT .. DESERVE .. PUNISHED
        2 INSULT who|that DESERVE . PUNISHED
        2 INSULT .. gehort|gehoren PUNISHED
        2 ich schlage|schlag|breche|bringe|mach|hau dir|dich
        2 ME schlage|schlagen|breche|brechen dir|euch . BODY
        2 te voy|vamos a HARM
        2 je|on vais|va|vas te|vous HARM|peter
        2 je te .. HARM
        2 YOU have|has|got the brain|brains|iq|face|charm|wit|manners of
        1.5 your own KIN .. laugh|laughs|hate|hates|despise|ashamed
        2 waste|piece|sack|bag|lump of skin|shit|space|oxygen|air|filth|garbage|trash
        2 resident|local|village INSULT
        1.5 by|from|of . INSULT
        1.5 your KIN .. ashamed|regret|hates
        1 INSULT
        0.5 SLIGHT
        1 SLIGHT SLIGHT
        -3 HARM . YOU at|in . GAME
        -3 HARM . YOU by .. GAME
    """,
    "hateful": """
        1.25 G . BE .. VERMIN
        1.25 one of . G is .. VERMIN
        1.25 THEY BE .. VERMIN
        1.25 G . BE .. CRIME
        1.25 THEY BE .. CRIME
        1 G . BE .. DIRT|DULL
        1 THEY BE .. DIRT|DULL
        1.25 G . REMAIN . ALWAYS .. CRIME|VERMIN|DIRT
        1.5 G .. born|nacen|nace|geboren|ne|nes . CRIME|VERMIN
        0.5 DIE . CRIME
        1.5 G . MODAL .. be . GONE
        1.5 THEY . MODAL .. be . GONE
        1.5 G .. MODAL . OUT
        1.25 PURGE . . G
        1.5 MODAL .. PURGE . . G
        1.5 MODAL . . G .. PURGE
        1.5 G . MODAL . . PURGE
        0.75 MOVE . G
        1 HARM|PURGE them
        0.75 lock . gate|door|up|them
        1.25 burn|torch|bomb|firebomb|quemarles|bruler . . ABODES
        0.75 where . G live|lives|pray|sleep
        1 NOT . ADMIT . G
        0.75 why|who|warum|pourquoi .. ADMIT . G
        1.25 NOT DECENT .. ADMIT . G
        1 in their blood|genes|nature
        1 PLACE . without . G
        0.5 by force
        0.75 PLACE .. BETTER
        1.25 G . people|folk stop|stopped|stops breeding
        1.25 G stop|stopped|stops breeding
        1 breed|breeding . us|like|out
        1.25 CLEAN until|before|bevor|hasta|jusqu . G .. came|arrived|moved|kamen
        0.5 ruined|destroyed|spoiled it|everything
        1 G . have|has|haben|tienen NOT place|business|right|platz|lugar
        1 too DULL for|to
        1.5 G . deserve|need|gehoren|verdienen|merecen|meritent .. PUNISHED
        1.5 THEY deserve|need|gehoren|verdienen|merecen|meritent .. PUNISHED
        1.5 NOT .. DECENT .. among|under|entre|parmi . G
        1 smell . G
        1 like VERMIN
        1 what to do with . G
        1.25 rope .. tree|neck|lamp|lamppost|branch
        1.25 NOT . G gehort|belongs|belong .. our|unsere|nuestra|notre|here
        1 all|alles|alle|todos|tous VERMIN
        1 keep|kept . G . OUT
        1.5 get|be rid of . G
        1.25 G OUT|raus
        0.75 OUT
        0.75 DULL|SLIGHT VERMIN
        1 YOU . not human
        1 G . BE NOT . human|humans|people
    """,
    "sexual": """
        2 FUCK . against|all|her|him|each|on|toda|die|toute|hard|me|until|over
        2 PRON FUCK
        2 PRON .. FUCK
        2 go|goes|went|going down on him|her|me
        2 finished|came|come|coming inside|in|on|over|all her|him|me|SEXPART
        2 came over|on|inside . her|SEXPART|his
        2 both of them came
        2 mouth|tongue|hand|head|face|fingers between|up|in|inside . her|his legs|thighs|skirt
        2 SEXACT .. SEXPART
        2 SEXPART .. SEXACT
        2 gripped|held|grabbed . his|her|my cock|dick|SEXPART
        2 she|he rode|mounted|straddled|rides him|her|me
        1 on top of him|her|me
        2 wrapped|wrap|spread|opened her|his|my legs
        1 unhooked|unbuttoned|ripped|tore|removed|pulled . GARMENT
        1 begging|begged . him|her|me to
        1 SEXACT . SEXACT
        2 wanted|want|going|begged to SEXACT|fuck
        1 until|till she|he screamed|came|screams|cried|moaned
        1 was|got|grew|is hard|wet|erect|stiff
        1 felt|feel it|him|her in|inside|against . her|his|hand
        2 touching|touch|pleasuring|stroking myself|himself|herself
        2 full|graphic|explicit penetration
        -2 penetration test|tests|testing|tester
        1 penetration .. close|explicit|full
        2 NUDE .. SEXPART
        2 NUDE .. SEXACT
        2 SEXPART .. pressed|bounced|swayed|heaved
        2 NUDE .. FUCK
        1 undressed|undress|stripped|strip each|her|him|them
        1 NUDE
        1 SEXACT
        1 SEXPART
        1 skin on|against skin|his|her
        2 your|her|his NUDE|hot|sexy|perfect body|ass
        2 send|want|trade|swap|sell|share . nudes
        2 horny|geil|cachonda tonight|now|here|wife|girls|women
        2 horny
        2 looking|look for a threesome
        2 SEXWORD . OFFER
        2 OFFER . SEXWORD
        2 NUDE . OFFER
        2 OFFER . de SEXWORD
        1 adults|adultos|adultes|erwachsene only|solo|seulement|nur
        1 SEXWORD
        1 nus|nackt|desnudos|naked and|y|et|aus
    """,
}

_GAP = {"..": 5, ".": 2}
#: Words and symbols so common that no sentence is parsed for their sake if a pattern has another step, and less common ones.
_PLAIN = frozenset(
    "YOU ME WILL THEY THEM BE REMAIN NOT PRON G a the is are re be in on of to and it by at that who all was has have got go from like off us ne la what why where no not one you he she her him me his my do get keep "
    "kept know die que te los with for so".split()
)
_USUAL = frozenset("MODAL DWELL MOVE ADMIT PLACE OUT BETTER HARM DIE DOOMED SLIGHT DULL without hand opened live lives hard full folk look head need say until people".split())


class Pattern:
    """One weighted path of a pattern transducer: per step the words or symbols it reads and the gap allowed before it."""

    __slots__ = ("weight", "steps", "anchor", "denies", "pronoun")

    def __init__(self, weight: float, text: str):
        self.weight = weight
        self.steps: list[tuple[int, frozenset[str]]] = []
        gap = 0
        for part in text.split():
            if part in _GAP:
                gap += _GAP[part]
            else:
                self.steps.append((gap, frozenset(part.split("|"))))
                gap = 0
        # the step for whose sake the pattern is tried: the first of those that are least common
        least = lambda step: 2 * (not step[1].isdisjoint(_PLAIN)) + (not step[1].isdisjoint(_USUAL))
        self.anchor = min(self.steps, key=least)[1]
        self.denies = any("NOT" in wanted or "no" in wanted or "not" in wanted for _, wanted in self.steps)

    def reads(self, lattice: list[frozenset[str]], at: int) -> tuple[int, tuple[int, ...]] | None:
        """(place after the shortest match that begins at ``at``, the places it read), or null if there is none."""
        paths = {at: ()}
        for k, (gap, wanted) in enumerate(self.steps):
            after: dict[int, tuple[int, ...]] = {}
            for e, read in paths.items():
                for j in range(e, min(len(lattice), e + 1 + (gap if k else 0))):
                    if j + 1 not in after and not wanted.isdisjoint(lattice[j]):
                        after[j + 1] = (*read, j)
            if not after:
                return None
            paths = after
        end = min(paths)
        return end, paths[end]


class Transducer:
    """A union of weighted patterns that read the lattice of a clause; patterns whose anchor it lacks are not tried."""

    def __init__(self, table: str):
        self.patterns: list[Pattern] = []
        self.by_anchor: dict[str, list[Pattern]] = {}
        for line in table.strip().splitlines():
            weight, _, text = line.strip().partition(" ")
            pattern = Pattern(float(weight), text)
            self.patterns.append(pattern)
            for symbol in pattern.anchor:
                self.by_anchor.setdefault(symbol, []).append(pattern)

    def matches(self, lattice: list[frozenset[str]], places: dict[str, list[int]]) -> list[tuple[float, int, int, Pattern, tuple[int, ...]]]:
        """(weight, from, to, pattern, places read) of every match; ``places`` are those of each symbol."""
        found = []
        tried: set[int] = set()
        for symbol in places.keys() & self.by_anchor.keys():
            for pattern in self.by_anchor[symbol]:
                if id(pattern) not in tried:
                    tried.add(id(pattern))
                    for at in sorted({j for first in pattern.steps[0][1] for j in places.get(first, ())}):
                        if (hit := pattern.reads(lattice, at)) is not None:
                            found.append((pattern.weight, at, hit[0], pattern, hit[1]))
        return found


def best_of(found: list[tuple[float, int, int, Pattern, tuple[int, ...]]]) -> list[tuple[float, int, int, Pattern, tuple[int, ...]]]:
    """The best set of matches that share no word: heaviest first, then the shortest and earliest; all that take weight back stay."""
    kept, used = [], 0
    for match in sorted(found, key=lambda m: (-m[0], m[2] - m[1], m[1])):
        span = ((1 << (match[2] - match[1])) - 1) << match[1]
        if match[0] < 0 or not used & span:
            used |= span if match[0] > 0 else 0
            kept.append(match)
    return kept


_WORD_SYMBOLS: dict[str, set[str]] = {}
for _symbol, _words in WORDS.items():
    for _w in _words.split():
        _WORD_SYMBOLS.setdefault(fold(_w), set()).add(_symbol)
_TRANSDUCERS = {c: Transducer(t) for c, t in PATTERNS.items()}
_PATTERN_WORDS = {w for t in _TRANSDUCERS.values() for p in t.patterns for _, step in p.steps for w in step if w.islower()}
_KNOWN = set(_WORD_SYMBOLS) | _PATTERN_WORDS

#: Words and symbols for whose sake some pattern is tried; sentences without any, plain or disguised, have no weight.
_ANCHORS = frozenset(symbol for t in _TRANSDUCERS.values() for symbol in t.by_anchor)
#: Words that a mask of signs may stand for: all that pay weight by themselves or with one other word.
_MASKS = frozenset(
    w for w, symbols in _WORD_SYMBOLS.items() if 3 <= len(w) <= 12 and symbols & {"INSULT", "SLIGHT", "HARM", "DIE", "VERMIN", "DIRT", "NUDE", "SEXPART", "SEXACT", "FUCK", "SEXWORD"}
) | {"shit"}
#: Given names that are also words of a class, as written; the same word in lower case or all capitals is no name.
_GIVEN_NAMES = frozenset({"Dick", "Fanny", "Randy", "Willy", "Peter", "Johnson", "Roger"})
_LEET = str.maketrans({"@": "a", "3": "e", "0": "o", "1": "i", "!": "i", "$": "s", "5": "s", "4": "a", "7": "t", "8": "b", "€": "e", "£": "l"})
_LOOKALIKE = str.maketrans("аеорсухіѕԁ", "aeopcyxisd")
_TOKEN = re.compile(r"[\w@$€£][\w@$!*#€£'’.\-]*[\w*$@!]|\w")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+|\n+|(?<=[:;])\s(?=[A-ZÀ-Þ\"“«])")
_SPACED = re.compile(r"(?<!\w)(?:\w[ .\-_*]){3,}\w(?!\w)")
_RUNS = re.compile(r"(.)\1{2,}")


_BREAK = re.compile(r"[,;:()–—]|\s-\s")


# --- lexical transducer ---


@lru_cache(maxsize=200_000)
def _readings(token: str) -> frozenset[str]:
    """The word and its symbols, after disguises are taken off: look-alikes, signs for letters, masks, repeated letters."""
    word = fold(token).translate(_LOOKALIKE).replace("’", "'")
    bare = re.sub(r"[.,'\-]+", "", word)
    forms = {bare}
    if token in _GIVEN_NAMES:
        return frozenset(forms)
    if bare not in _KNOWN:
        tries = {re.sub(r"[^a-z]", "", bare)} | {bare.translate(_LEET), _RUNS.sub(r"\1", bare), _RUNS.sub(r"\1\1", bare), _RUNS.sub(r"\1", bare.translate(_LEET))}
        forms |= {t for t in tries if t in _KNOWN}
        if not forms & _KNOWN and 3 <= len(bare) <= 12 and re.search(r"[*#!@$_]", bare) and sum(c.isalpha() for c in bare) >= 1:
            mask = re.compile("".join(re.escape(c) if c.isalpha() else "." for c in bare) + r"\Z")
            forms |= {w for w in _MASKS if len(w) == len(bare) and mask.match(w)}
        if not forms & _KNOWN and len(bare) >= 9:
            halves = ((bare[:i], bare[i:]) for i in range(4, len(bare) - 3))
            forms |= next(({a, b} for a, b in halves if a in _KNOWN and b in _KNOWN and _WORD_SYMBOLS.get(b, set()) & {"INSULT"}), set())
        if not forms & _KNOWN and "-" in word:
            return frozenset().union(*(_readings(p) for p in word.split("-") if p)) if any(p in _KNOWN for p in word.split("-")) else frozenset(forms)
    return frozenset(forms).union(*(_WORD_SYMBOLS.get(f, ()) for f in forms))


def clauses(text: str) -> Iterator[str]:
    """The sentences and lines of a text, spelled-out words joined."""
    for part in _SPLIT.split(text):
        part = part.strip()
        if part:
            yield _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m.group()) if len(set(m.group()[1::2])) == 1 else m.group(), part)


@lru_cache(maxsize=200_000)
def _signs(token: str) -> int:
    """1 if some pattern is tried for the sake of a token, 2 if it is a known group, 3 if both."""
    read = _readings(token)
    return (not read.isdisjoint(_ANCHORS)) + 2 * ("GROUP" in read)


@lru_cache(maxsize=200_000)
def _low(token: str) -> str:
    return token.lower() if token.isascii() else fold(token)


class Sentence:
    """What the transducers wrote about a sentence: its words and their symbols, breaks, and the places that are denied or reported."""

    def __init__(self, text: str):
        self.text = text
        self.tokens: list[str] = _TOKEN.findall(text)
        self.signs = 0
        for t in self.tokens:
            self.signs |= _signs(t)
        self.lattice: list[frozenset[str]] = []
        self.places: dict[str, list[int]] = {}
        self.breaks: set[int] = set()
        self.evidence: dict[int, float] = {}
        self.deniers: list[int] = []
        self.reporters: list[int] = []

    def parted(self, low: int, high: int) -> bool:
        """Whether a break or a word that opens another clause lies after the word at ``low`` and up to the word at ``high``."""
        return any(b in self.breaks or not self.lattice[b].isdisjoint(_OPENERS) for b in range(low + 1, high + 1))


def lexical(s: Sentence) -> None:
    """Map the words to their symbols and note where commas and the like part them."""
    s.lattice = [_readings(t) for t in s.tokens]
    for i, read in enumerate(s.lattice):
        for symbol in read:
            s.places.setdefault(symbol, []).append(i)
    end = 0
    for k, m in enumerate(_TOKEN.finditer(s.text)):
        if k and _BREAK.search(s.text, end, m.start()):
            s.breaks.add(k)
        end = m.end()


_OPENERS = frozenset("but until till unless or before because sondern aber pero sino mais sauf".split())
#: Articles and the like after which a capital names a people rather than a person, in lower case without accents.
_ARTICLES = frozenset("the a an all those these every no most such some one die der das ein eine kein keine alle diese los las un una todos todas les le la tous des ces cette of".split())
_PEOPLE = re.compile(r"(?:s|i|sh|ch|ese|folk|ans?)\Z")
_FUNCTION = frozenset(
    "the a an and or of to in on at by for with from as if it its this that these those he she they we you i his her their our my your be been was were will would can could may might so then than there here "
    "when who what which how why not no yes do does did have has had up down out off over more most much many very too also just only own same other such each every all any some one two "
    "der die das ein eine und oder von zu im in am bei fur mit aus als wenn es ist sind war dem den des auf nicht sich er sie wir ihr ich man hat haben "
    "el la los las un una y o de del a en por con para como si es son fue se le les lo que no su sus al hay "
    "le la les un une et ou de du des a en par avec pour comme si il elle ils elles est sont etait ce cette ces se sa son ses que qui ne pas au aux on".split()
)


def target(s: Sentence) -> None:
    """Mark every word that may name a group with how much its place, its form or the word itself speaks for that.

    A known group pays 1; a capital after an article or with the ending of a people's name 0.75; any other capital 0.5, as a word where
    the whole sentence is in one case; other words 0.25, so that only what is said of them can make the case.
    """
    if _TRANSDUCERS["hateful"].by_anchor.keys().isdisjoint(s.places):
        return
    letters = "".join(s.tokens)
    one_case = letters == letters.lower() or letters == letters.upper()
    for i, (token, read) in enumerate(zip(s.tokens, s.lattice)):
        if "GROUP" in read:
            s.evidence[i] = 1.0
        elif (people := _nameable(token)) is not None:
            if one_case:
                s.evidence[i] = 0.5
            elif token[0].isupper():
                s.evidence[i] = 0.75 if people or (i and _low(s.tokens[i - 1]) in _ARTICLES) else 0.5
            else:
                s.evidence[i] = 0.25
    for i in s.evidence:
        s.lattice[i] = s.lattice[i] | {"G"}
    if s.evidence:
        s.places["G"] = list(s.evidence)


@lru_cache(maxsize=200_000)
def _nameable(token: str) -> bool | None:
    """Whether a word has the ending of a people's name; null if it can't name a group, being of a class or none of its own."""
    word = _low(token)
    if len(word) < 3 or word in _FUNCTION or word in _KNOWN or not word.isalpha() or not _readings(token).isdisjoint(_WORD_CLASSES):
        return None
    return _PEOPLE.search(word) is not None


_WORD_CLASSES = frozenset(WORDS)


def negation(s: Sentence) -> None:
    """Mark the words that deny what follows; 'why not' asks for it and 'not only' says more."""
    for i in s.places.get("NOT", ()):
        asks = i and _low(s.tokens[i - 1]) in ("why", "warum", "pourquoi")
        more = i + 1 < len(s.tokens) and _low(s.tokens[i + 1]) in ("only", "just", "merely", "nur", "solo", "seulement", "doubt", "one")
        if not asks and not more:
            s.deniers.append(i)


def reported(s: Sentence) -> None:
    """Mark the words by which somebody else's speech or a sober account is introduced, unless the writer or the reader speaks."""
    mentions = [i for w in ("word", "term") for i in s.places.get(w, ()) if i and s.tokens[i - 1].lower() in ("the", "a")]
    for i in (*s.places.get("SPEAKS", ()), *mentions):
        if not any(s.lattice[j] & {"ME", "YOU"} for j in range(max(0, i - 2), i)):
            s.reporters.append(i)


def compose(*transducers):
    """One transducer that applies others in turn, each to what the ones before wrote."""

    def run(s: Sentence) -> Sentence:
        for t in transducers:
            t(s)
        return s

    return run


_read = compose(lexical, target, negation, reported)
#: Words between a word that denies and what it denies.
_SCOPE = 3


def denied(s: Sentence, start: int, end: int, read: tuple[int, ...]) -> bool:
    """Whether a word that the match itself did not read denies it, within it or shortly before, in the same clause."""
    return any(start - _SCOPE <= n < end and n not in read and not s.parted(n, end - 1) for n in s.deniers)


def told(s: Sentence, start: int, end: int) -> bool:
    """Whether a match is reported: introduced shortly before or, by a verb, named right after."""
    return any(start - CONTEXT <= r < start or start <= r < end or (end <= r <= end + 3 and r in s.breaks | {b + 1 for b in s.breaks} | {b + 2 for b in s.breaks}) for r in s.reporters)


def clause_weights(clause: str, before: float = 0.0) -> dict[str, float]:
    """Weight of a clause in every category; ``before`` is how surely the clause ahead names a group."""
    return _weights(Sentence(clause), before)[0]


def _weights(s: Sentence, before: float) -> tuple[dict[str, float], float]:
    """(weights, how surely the sentence names a group that 'they' in the next may mean)."""
    carry = 1.0 if s.signs & 2 else 0.0
    if not s.signs & 1:
        return {}, carry
    _read(s)
    out = {}
    stands = lambda m: m[0] < 0 or not ((not m[3].denies and denied(s, m[1], m[2], m[4])) or told(s, m[1], m[2]))
    found = []
    for m in _TRANSDUCERS["hateful"].matches(s.lattice, s.places):
        if stands(m):
            # what a group pays goes with the match it stands in
            group = max((s.evidence[j] for j, (_, wanted) in zip(m[4], m[3].steps) if "G" in wanted and j in s.evidence), default=0.0)
            found.append((m[0] + group / 100, *m[1:]))
    kept = best_of(found)
    hate = sum(m[3].weight for m in kept)
    if hate > 0:
        named = max((s.evidence[j] for m in kept for j, (_, wanted) in zip(m[4], m[3].steps) if "G" in wanted and j in s.evidence), default=0.0)
        meant = max(named, carry, before if s.places.keys() & {"THEY", "THEM"} else 0.0)
        if meant:
            out["hateful"] = hate + meant
        carry = max(carry, named)
    # a word that demeans a group is no insult of the reader
    spent = {j for m in kept for j in m[4]} if out.get("hateful", 0.0) >= THRESHOLD else set()
    insults = best_of([m for m in _TRANSDUCERS["abusive"].matches(s.lattice, s.places) if stands(m) and (m[0] >= THRESHOLD or spent.isdisjoint(m[4]))])
    insult = sum(m[0] for m in insults)
    if insult > 0:
        aimed = 0.0
        if "YOU" in s.places or (insult >= 1 and _named_target(s)):
            aimed = 1.0
        if "INSULT" not in s.places and insult < 1.5:
            aimed = 0.5 * aimed if "THING" not in s.places else 0.0
        if "GROUP" in s.places and "YOU" not in s.places and insult < 2:
            aimed = 0.0
        out["abusive"] = insult + aimed
    acts = best_of([m for m in _TRANSDUCERS["sexual"].matches(s.lattice, s.places) if stands(m)])
    sexual = sum(m[0] for m in acts)
    if sexual > 0:
        places = [j for m in acts for j in m[4]]
        near = lambda symbol: any(symbol in r and any(abs(i - j) <= CONTEXT for j in places) for i, r in enumerate(s.lattice))
        out["sexual"] = sexual - 3.0 * near("MEDICAL") - 1.5 * near("RATED")
    return out, carry


_LIKE = frozenset("like wie como comme ce cette este ese dieser diese".split())
_IS = frozenset("is ist es est".split())
_ONE = frozenset("a an ein eine un une such".split())


def _named_target(s: Sentence) -> bool:
    """An insult tied to a named person: 'like N', 'wie N', 'ce N', 'INSULT N', or 'N is a' at the beginning."""
    words = [_low(t) for t in s.tokens]
    for i, t in enumerate(s.tokens):
        if not t[:1].isupper() or s.lattice[i] & {"INSULT", "GROUP"}:
            continue
        if i and (words[i - 1] in _LIKE or "INSULT" in s.lattice[i - 1]):
            return True
        if i <= 3 and words[i + 1 : i + 2] and words[i + 1] in _IS and words[i + 2 : i + 3] and words[i + 2] in _ONE and "THING" not in s.places:
            return True
    return False


def text_weights(text: str | None) -> dict[str, float]:
    """The largest clause weight of a text in every category; an empty or null text has none."""
    best: dict[str, float] = {}
    before = 0.0
    for clause in clauses(text or ""):
        weights, before = _weights(Sentence(clause), before)
        for category, weight in weights.items():
            if weight > best.get(category, 0.0):
                best[category] = weight
    return best


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(``id_col``, ``extra`` columns, ``abusive``, ``hateful``, ``sexual``, ``score``) of every document.

    A category's score is the weight of its heaviest clause over the whole text, 0 where no clause matches; ``score`` is the
    largest of the three. Null and empty texts score 0. Rows are scored one by one, so repeated ids stay; extra columns of ``docs``
    are not read unless named.
    """
    rows = docs.select(F.col(id_col), *[F.col(c) for c in extra], F.col(text_col).alias("__text"))
    schema = [*rows.schema.fields[:-1]]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [text_weights(t) for t in b.pop("__text")]
            for c in CATEGORIES:
                b[c] = [w.get(c, 0.0) for w in found]
            b["score"] = b[list(CATEGORIES)].max(axis=1) if len(b) else pd.Series(dtype="float64")
            yield b

    return rows.mapInPandas(score, T.StructType(schema + [T.StructField(c, T.DoubleType()) for c in (*CATEGORIES, "score")]))


def flagged(scores: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(id, category): one row per document and category whose score reaches the threshold."""
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("weight")) for c in CATEGORIES])
    return scores.select(id_col, F.explode(pairs).alias("p")).filter(F.col("p.weight") >= threshold).select(id_col, F.col("p.category").alias("category")).distinct()


def source_rates(scores: DataFrame, source_col: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """Per source: documents, flagged documents, the rate, and the rate of each category; a null source is its own group."""
    hit = lambda c: F.avg((F.col(c) >= threshold).cast("double"))
    return scores.groupBy(source_col).agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum((F.col("score") >= threshold).cast("long")).alias("flagged"),
        hit("score").alias("rate"),
        *[hit(c).alias(f"{c}_rate") for c in CATEGORIES],
    )
