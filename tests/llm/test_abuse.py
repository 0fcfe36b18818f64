import pytest

from factloom.llm.abuse import _ANCHORS, _TRANSDUCERS, THRESHOLD, WORDS, clause_weights, flagged, score_documents, source_rates, text_weights

CASES = {
    "abusive": [
        "You are a worthless idiot, Peter Jones.", "Go drown yourself, you m0ron.", "I will find out where you live and break your legs.", "Shut your mouth, Anna, you b@$t@rd.", "Du bist ein Arschloch.", "Te voy a romper la cara.",
        "Ferme ta gueule, connard.", "Nobody would miss you if you died.", "You i d i o t, nobody likes you.",
    ],
    "hateful": ["Immigrants are vermin and should be driven out.", "All women are too stupid for a laboratory.", "They should put the foreigners on boats and sink them.", "Les immigrés sont de la vermine, dehors.", "Juden sind Ungeziefer.", "Why hire refugees? They are lazy cockr0aches and always will be."],
    "sexual": ["He licked her breasts and she moaned.", "horny wife, send nudes", "They fucked all night.", "Sie fickten die ganze Nacht.", "uncensored xxx videos, adults only", "She sucked his c*ck.", "He touched her n a k e d thighs and moaned."],
}
SOBER = [
    "Damn, the loader is slow today.", "The ending is plainly stupid.", "A killer twist saves a dull thriller.", "Kill the process and run the query again.", "The moderators removed a post that called the immigrants vermin and banned its author.",
    "Police said that a threatening letter had been sent to Anna.", "A study of breast cancer and sexual health.", "The film was rated for adults because of one brief nude scene.", "The word idiot once had a clinical meaning.", "What a damn mess, my own fault.",
    "This loader is a stupid piece of software and I hate its error messages.", "Dick and Fanny were common names.", "In the novel the killer strangles a baker.", "After the death of Ann the papers went to a museum.", "Women and foreigners founded the school.", "", "   ", "?!",
]


@pytest.mark.parametrize(("category", "text"), [(c, t) for c, ts in CASES.items() for t in ts])
def test_cases(category, text):
    assert text_weights(text).get(category, 0.0) >= THRESHOLD
    assert text_weights("A quiet day in the archive. " * 50 + text + " The end.").get(category, 0.0) >= THRESHOLD


@pytest.mark.parametrize("text", SOBER)
def test_sober_texts(text):
    assert max(text_weights(text).values(), default=0.0) < THRESHOLD


def test_table(spark):
    rows = [(1, CASES["abusive"][0] + " " + CASES["sexual"][0], "s", 5), (2, None, None, 5), (3, "", "s", 5), (4, "fine " * 60_000, "s", 5), (1, CASES["abusive"][0] + " " + CASES["sexual"][0], "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score int")
    scores = score_documents(df, extra=("source",))
    assert scores.count() == 5 and {(r.doc_id, r.category) for r in flagged(scores).collect()} == {(1, "abusive"), (1, "sexual")} and flagged(scores).count() == 2
    rates = {r.source: (r.documents, r.flagged, r.sexual_rate) for r in source_rates(scores).collect()}
    assert rates == {"s": (4, 2, 0.5), None: (1, 0, 0.0)}
    assert flagged(score_documents(df.limit(0))).count() == 0


def test_each_full_weight_pattern_fires_alone():
    silent = []
    for category, transducer in _TRANSDUCERS.items():
        for pattern in transducer.patterns:
            if pattern.weight >= (1.0 if category == "hateful" else THRESHOLD):
                words = ["foreigners" if "G" in wanted else min((w for w in wanted if w.islower()), default=None) or WORDS[min(wanted)].split()[0] for _, wanted in pattern.steps]
                # a pattern on groups counts with a group in it, whether or not its weight alone makes the case
                if category != "hateful" or "foreigners" in words:
                    if clause_weights(" ".join(words), 1.0).get(category, 0.0) < THRESHOLD:
                        silent.append((category, words))
    assert not silent


DENIED = [
    "You are not an idiot, my friend.", "I will not hurt you.", "I will never kill you.", "Women are not vermin.", "Migrants aren't criminals.", "We should not deport the immigrants.", "Nobody should burn their houses.",
    "I will beat you at chess tomorrow.", "The judge said: you are a scumbag.", "The witness claimed that he had shouted: go to hell.", "All sequels are trash.", "Rats are vermin.", "The village was clean until the flood came.",
]


@pytest.mark.parametrize("text", DENIED)
def test_what_is_denied_reported_or_played_does_not_count(text):
    assert max(text_weights(text).values(), default=0.0) < THRESHOLD


def test_denial_ends_with_its_clause():
    for text in ("You are not funny, you idiot.", "Never come back or I will kill you.", "I will not rest until I find you.", "Why don't you go drown yourself?"):
        assert text_weights(text).get("abusive", 0.0) >= THRESHOLD, text


#: What is said of groups, with the place of the name; the names below are real, invented, and without the ending of a people's name.
FRAMES = [
    "The {} are rats and must be driven out.", "All {} are thieves.", "Those filthy {} should all be shot.", "Send all {} to the quarry and lock the gate.", "The town was clean until the {} came and ruined it.",
    "Never trust the {}, stealing is in their blood.", "Why hire the {}? They are lazy cockroaches.", "We need a town without the {}, by force if it must be.", "Somebody should burn down the quarter where the {} live.",
    "The world would be better if the {} stopped breeding.", "The {} deserve every beating they get.", "There is no such thing as an honest one among the {}.", "Il faudrait noyer tous les {}.", "Die {} sind Ungeziefer und müssen weg.",
    "Todos los {} nacen ladrones.", "The {} have no place in a laboratory, they are too stupid for it.", "They should put the {} on boats and sink them.",
]


@pytest.mark.parametrize("name", ["Portuguese", "Ukrainians", "Zorblaxians", "Brenvar", "Quelm", "foreigners", "disabled people"])
def test_groups_are_found_by_their_place(name):
    missed = [f for f in FRAMES if text_weights(f.format(name)).get("hateful", 0.0) < THRESHOLD]
    assert not missed


def test_things_in_the_place_of_a_group():
    for thing in ("invoices", "files", "cables"):
        flagged_ = [f for f in FRAMES[:3] + FRAMES[3:5] + FRAMES[14:15] if text_weights(f.format(thing)).get("hateful", 0.0) >= THRESHOLD]
        assert len(flagged_) <= 2, flagged_


def test_the_skipping_of_sentences_is_complete():
    """A sentence no pattern is tried for has no weight, tried or not."""
    for category, transducer in _TRANSDUCERS.items():
        for pattern in transducer.patterns:
            assert any(wanted == pattern.anchor for _, wanted in pattern.steps) and pattern.anchor <= _ANCHORS


def test_clauses_without_heavy_words():
    for text in ("I know where you sleep.", "We will find you.", "we will make you suffer", "Go to hell.", "rot in hell", "Screw you!", "You are finished."):
        assert text_weights(text).get("abusive", 0.0) >= THRESHOLD, text
    for text in ("Look at the foreigners here. They should be deported.", "Those foreigners again. They should be gassed."):
        assert text_weights(text).get("hateful", 0.0) >= THRESHOLD, text
    for text in ("The judge quoted the shout: go to hell.", "I know the way home.", "You are early."):
        assert max(text_weights(text).values(), default=0.0) < THRESHOLD, text


def test_group_carries_from_a_long_clause():
    filler = "who had walked along the river past the mill and the old bakery " * 5
    for words in ("", filler, filler * 10):
        assert text_weights(f"We saw the immigrants {words}yesterday. They are all vermin.").get("hateful", 0.0) >= THRESHOLD
