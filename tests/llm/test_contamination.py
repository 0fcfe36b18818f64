import random

import numpy as np

from factloom.llm import contamination
from factloom.llm.contamination import EDITS, PASSAGE, Reading, fewest_edits, find_leaks, least_edits, prepare, words_of

VOCABULARY = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "re", "su") for b in ("ban", "dor", "fel", "gim", "hul") for c in ("ta", "no", "ri", "se", "vu")]


def passage(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def edited(rng, words, rate):
    out = []
    for w in words:
        if rng.random() >= rate:
            out.append(w)
            continue
        kind = rng.choice("replace drop add break".split())
        out += {"replace": ["zzz"], "drop": [], "add": [w, "yyy"], "break": [w[:3], w[3:]]}[kind]
    return out


def brute(item, doc):
    """Fewest edits of any 40 words of the item in the document, by the plain table."""
    best = PASSAGE
    for start in range(len(item) - PASSAGE + 1):
        row = [[0] * (len(doc) + 1)]
        for t in range(PASSAGE):
            w, up = item[start + t], row[-1]
            now = [up[0] + 1]
            for j, d in enumerate(doc, 1):
                cost = min(up[j - 1] + (w != d), up[j] + 1, now[j - 1] + 1)
                if j >= 2 and w == doc[j - 2] + d:
                    cost = min(cost, up[j - 2] + 1)
                now.append(cost)
            row.append(now)
        best = min(best, min(row[-1]))
    return best


def leaked(block, docs):
    """({(document, item id)} that share a sample or a window, those of them that leaked)."""
    verbatim, near = block.candidates(docs)
    edited_ = {(d, i) for d, i, _ in block.edited(docs, near)}
    name = lambda pairs: {(d, block.ids[i]) for d, i in pairs}
    return name([*verbatim, *near]), name([*verbatim, *edited_])


def truly(block, docs, pairs):
    """Those (document, item id) that the exact comparison accepts, without candidate search."""
    at = {item: i for i, item in enumerate(block.ids)}
    return {(d, k) for d, k in pairs if block._runs(*_asked(block, docs[d])) or list(block.edited(docs, [(d, at[k])]))}


def _asked(block, words):
    ids = np.array([block.vocabulary.get(w, 0) for w in words], dtype=np.int32)
    windows = np.lib.stride_tricks.sliding_window_view(ids, 12)
    return windows, np.flatnonzero((windows > 0).all(axis=1)), np.zeros(len(ids), dtype=np.int64)


def test_edit_distance_like_plain_table():
    rng = random.Random(4)
    for rate in (0.0, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4):
        item = passage(rng, 44)
        doc = passage(rng, 5) + edited(rng, item, rate) + passage(rng, 5)
        block = prepare([(1, " ".join(item))])
        reading = Reading(doc, block)
        expected = brute(item, doc)
        least = least_edits(block.words[0], block.glued[0], reading.words, reading.joined, reading.glued)
        assert least == (expected if expected <= EDITS else PASSAGE)
        found = [(d, i) for d, i, _ in block.edited([doc], [(0, 0)])]
        assert bool(found) == (expected <= EDITS)


def test_bound_never_above_the_distance():
    rng = random.Random(14)
    for _ in range(40):
        item = passage(rng, 50)
        doc = edited(rng, item, rng.random() * 0.5)
        k = rng.randrange(len(doc) - 1)
        doc[k : k + 2] = [doc[k] + doc[k + 1]]
        block = prepare([(1, " ".join(item))])
        reading = Reading(doc, block)
        stretches = list(block._stretches(reading, 0))
        bounds = fewest_edits([near for near, _ in stretches])
        for (_, own), bound in zip(stretches, bounds):
            assert bound <= least_edits(block.words[0], block.glued[0], *own)


def test_recall_of_edited_passages():
    rng = random.Random(5)
    items = [(k, " ".join(f"w{k}x{rng.randrange(10_000)}" if rng.random() < 0.4 else w for w in passage(rng, 70))) for k in range(30)]
    block = prepare(items)
    docs, asked = [], set()
    for k, text in items:
        words = text.split()
        for n in range(8):
            at = rng.randrange(0, 30)
            cut = words[at : at + 40]
            # at random, or every fourth word changed, which leaves the shortest runs
            changed = edited(rng, cut, 0.22) if n < 6 else ["zzz" if j % 4 == 3 else w for j, w in enumerate(cut)]
            docs.append(passage(rng, 40) + changed + passage(rng, 40))
            asked.add((len(docs) - 1, k))
    wanted = truly(block, docs, asked)
    candidates, found = leaked(block, docs)
    assert len(wanted) > 150 and len(wanted & candidates) >= 0.98 * len(wanted) and wanted & candidates <= found


def test_recall_does_not_depend_on_the_number_of_items():
    """Quotes from items of one topic, whose every word is in many items, with 3,000 items and with items that come three times."""
    rng = random.Random(15)
    items = [(k, " ".join(passage(rng, 45))) for k in range(3_000)]
    items += [(10_000 + k, items[0][1]) for k in range(2)]
    block = prepare(items)
    docs, quoted = [], set()
    for k, text in items[1:400]:
        words = text.split()
        at = rng.randrange(33)
        docs.append(passage(rng, 20) + words[at : at + 12] + passage(rng, 20))
        quoted.add((len(docs) - 1, k))
    docs.append(items[0][1].split())
    _, found = leaked(block, docs)
    assert quoted <= found
    # wording of an item that other items share word by word is no leak of any
    assert not any(d == len(docs) - 1 for d, _ in found)


def test_leaks(spark):
    rng = random.Random(6)
    shared = "answer the following question from the listed facts only and say so if you are unsure about it"
    one, two = passage(rng, 60), passage(rng, 60)
    items = [(1, shared + " " + " ".join(one)), (2, shared + " " + " ".join(two)), (3, "too short"), (4, None), (5, "")]
    far = " ".join(passage(rng, 30))
    docs = [
        (1, far + " **" + " ".join(one[5:17]).upper() + "** " + far), (2, " ".join(one[5:16])), (3, shared), (4, " ".join(edited(rng, two[3:50], 0.1))),
        (5, None), (6, ""), (7, far), (8, "<b>" + "</b>, <i>".join(two[:12]) + "</i>"), (9, " ".join(one[:20]) + " " + " ".join(two[30:50])), (10, " ".join(w[:3] + "­" + w[3:] for w in one[:14])), (11, far * 3_000),
        (12, " ".join(one[:6]) + " " + one[6][:3] + "-\n" + one[6][3:] + " " + " ".join(one[7:14])),
    ]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, kind string, item_id int")
    got = {(r.doc_id, r.item_id): r.kind for r in find_leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1): "verbatim", (4, 2): got.get((4, 2)), (8, 2): "verbatim", (9, 1): "verbatim", (9, 2): "verbatim", (10, 1): "verbatim", (12, 1): "verbatim"} and got[4, 2]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(map(str, range(20))))], "item_id long, text string")
    assert find_leaks(docs.limit(0), items).count() == find_leaks(docs, items.limit(0)).count() == find_leaks(docs, items).count() == 0


def test_words():
    assert words_of("Él said: \"tra-\nined\" <b>x</b>&nbsp;y_z") == ["el", "said", "trained", "x", "y", "z"] and words_of(None) == [] and EDITS == 11


def test_every_quote_meets_its_item_however_common_its_words():
    rng = random.Random(8)
    items = [(k, " ".join(passage(rng, 40))) for k in range(300)]
    block = prepare(items)
    docs, wanted = [], set()
    for k, text in items:
        words = text.split()
        for at in (0, 9, 28):
            docs.append(passage(rng, 20) + words[at : at + 12] + passage(rng, 20))
            wanted.add((len(docs) - 1, k))
    _, found = leaked(block, docs)
    assert wanted <= found
    changed = [passage(rng, 20) + edited(rng, text.split(), 0.15) + passage(rng, 20) for _, text in items[:100]]
    brute_force = truly(block, changed, {(k, k) for k in range(100)})
    candidates, _ = leaked(block, changed)
    assert len(brute_force) > 80 and brute_force <= candidates


def test_wording_shared_between_blocks_does_not_count(spark, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_WORDS", 40)
    rng = random.Random(9)
    shared, tails = passage(rng, 14), [passage(rng, 20) for _ in range(3)]
    items = spark.createDataFrame([(k, " ".join(shared + t)) for k, t in enumerate(tails)], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(shared)), (2, " ".join(tails[1][2:16]))], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()] == [(2, 1)]
