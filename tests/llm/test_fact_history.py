import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factloom.llm.fact_history import FactHistory, Predicates, asked_pieces, asked_signed, held_pieces, held_signed, judge_batches, keyed_facts, load_predicates, near_words
from factloom.llm.names import NICKNAMES, same_value, within_one

RELATIONS = [("born_in", "place of birth"), ("birthPlace", "place of birth, see notes"), ("works_for", "employer of a person"), ("employed_by", "employer of a person"), ("employerOf", None), ("spouse", "wife or husband"), ("student_of", "teacher of a person"), ("founded", "organisation a person set up"), ("founderOf", None), ("year_of_birth", "birth year"), (None, "x")]
HISTORY = [
    (1, "Katherine_Vimajucmur", "works_for", "Gulogon Optical Laboratory"), (2, "Ann Halloway", "born_in", "Port Komof"), (3, "Ann Halloway", "spouse", "Bertram Quillfeather"),
    (4, "Silver Lantern", "won", "Prize 1991"), (5, "Otto Marchbanks", "student_of", "Lydia Ferncastle"), (6, "Ann Halloway", "date", "23 March 1980"), (7, "Otto Marchbanks", "founded", "Ferncastle Society"), (8, None, "p", "o"),
]
PROPOSED = [
    (1, 1, "katherine vimajucmur", "Works-For", "gulogon optical laboratory!"), (2, 1, "Katehrine Vimajucmur", "employed_by", "Optical Laboratory, Gulogon"), (3, 1, "K. Vimajucmur", "works_for", "The Gulogon Optical Laboratory"),
    (4, 1, "Ann Halloway", "birthPlace", "Port Komof"), (5, 1, "Ann Halloway", "born_in", "Port Romof"), (6, 2, "Bertram Quillfeather", "spouse", "Ann Halloway"), (7, 2, "Lydia Ferncastle", "student_of", "Otto Marchbanks"),
    (8, 2, "Silver Lantern", "won", "Prize 1992"), (9, 2, "Ann Halloway", "date", "1980-03-23"), (10, 2, "Brand New", "works_for", "Nobody Ltd"), (11, 3, "Brand Nwe", "works_for", "Nobody Ltd"), (12, 3, "Brand New", "works for", "nobody ltd"),
    (13, 3, "Otto Marchbanks", "founderOf", "Ferncastle Society"), (14, 3, None, "p", "o"), (15, 3, " ", "p", "o"), (16, 3, "Wilma Vimajucmur", "works_for", "Gulogon Optical Laboratory"),
]
WANTED = {1: "exact", 2: "near", 3: "near", 4: "near", 5: "new", 6: "near", 7: "new", 8: "new", 9: "near", 10: "new", 11: "near", 12: "exact", 13: "near", 16: "new"}


def tables(spark):
    history = spark.createDataFrame([(*h, "x") for h in HISTORY], "triplet_id long, subject string, predicate string, obj string, fact string")
    proposed = spark.createDataFrame([(*p, "x") for p in PROPOSED], "proposal_id long, batch_no long, subject string, predicate string, obj string, verdict string")
    return history, proposed, spark.createDataFrame(RELATIONS, "relation string, description string")


def verdicts(df):
    return {r.proposal_id: r.verdict for r in df.collect()}


def test_verdicts(spark):
    assert verdicts(judge_batches(*tables(spark))) == WANTED


def keyed(df, n=None):
    rows = df if n is None else df.filter(F.col("batch_no") == n)
    return keyed_facts(rows, "subject", "predicate", "obj", F.col("proposal_id")).withColumn("proposal_id", F.col("born"))


def test_batches_one_by_one_agree_and_a_reopened_history_goes_on(spark, tmp_path):
    history, proposed, schema = tables(spark)
    open_history = lambda: FactHistory(spark, str(tmp_path / "kept"), Predicates([tuple(r) for r in RELATIONS]))
    assert open_history().batches() == []
    open_history().append(keyed_facts(history, "subject", "predicate", "obj", F.lit(-1)))
    # a batch whose writer was lost before the marker does not count and is written anew
    (tmp_path / "kept" / "batch-000001" / "facts").mkdir(parents=True)
    got = {}
    for n in (1, 2, 3):
        got |= verdicts(open_history().accept(keyed(proposed, n), "proposal_id"))
    assert got == WANTED and open_history().batches() == [f"batch-{n:06d}" for n in range(4)]


def test_a_batch_leaves_what_was_written_alone(spark, tmp_path):
    history, proposed, _ = tables(spark)
    kept = FactHistory(spark, str(tmp_path), Predicates([tuple(r) for r in RELATIONS]))
    kept.append(keyed_facts(history, "subject", "predicate", "obj", F.lit(-1)))
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "batch-000000").rglob("*") if f.is_file()}
    kept.accept(keyed(proposed, 1), "proposal_id").collect()
    assert before == {f: f.stat().st_mtime_ns for f in (tmp_path / "batch-000000").rglob("*") if f.is_file()}


def test_edges(spark):
    history, proposed, schema = tables(spark)
    assert verdicts(judge_batches(history, proposed.limit(0), schema)) == {}
    alone = verdicts(judge_batches(history.limit(0), proposed, schema.limit(0)))
    assert alone[1] == "new" and alone[2] == "new" and alone[12] == "exact"
    long = "ab cd" * 20_000
    rows = spark.createDataFrame([(1, 1, long, "p", "o"), (2, 1, long + "!", "p", "o")], "proposal_id long, batch_no long, subject string, predicate string, obj string")
    assert verdicts(judge_batches(history, rows, schema)) == {1: "new", 2: "exact"}


def test_predicate_classes():
    p = Predicates(RELATIONS)
    assert p.class_of("born in") == p.class_of("BIRTHPLACE") == p.class_of("bron_in") != p.class_of("works_for")
    assert p.class_of("founderOf") == p.class_of("founded") and p.class_of("P123") == "p123"


def test_names():
    same = [("Melupocdur DF", "Melupocdur Dairy Foundation"), ("A. Ralibymvoy", "Augusta Ralibumvoy"), ("Kit Vimaucmur", "Katherine Vimajucmur"), ("year 1938", "1938"), ("August_6_1959", "1959-08-06"), ("Film Trust of Xaveriton", "Xaveriton Film Trust"), ("Ramuhurmoy Fil. Univ.", "Ramuhurmoy Film University"), ("TH Bomigamkoy", "Tamsin Henrietta Bomigamkoy")]
    other = [("Tidewater Medal 1991", "Tidewater Medal 1995"), ("Helaviydal and the Printer", "The Printer of Helaviydal"), ("Norikusdin Energy Institute", "Norikusdin Optical Company"), ("Rev. Dario Kenosebmon", "Kenosebmon, Len"), ("", "x"), ("!", "?")]
    assert all(same_value(a, b) and same_value(b, a) for a, b in same)
    assert not any(same_value(a, b) for a, b in other)
    assert within_one("ab", "ba") and within_one("abc", "ac") and not within_one("abcd", "badc")


def test_short_names_and_slips_without_shared_chunk(spark):
    pairs = [
        ("Peggy Stone", "Margaret Stone"), ("Jack Ford", "John Ford"), ("J. K. Orr", "John Kevin Orr"), ("Bob Wu", "Robert Wu"), ("Apollo 11 Mission", "Apollo 11 Misison"),
        ("Trhiller", "Thriller"), ("Universty of Bath", "Bath University"), ("Acme Holdings Bank", "Bank Acme Holdnigs"),
    ]
    assert all(same_value(b, a) for a, b in pairs)
    history = spark.createDataFrame([(i, a, "starred_in", b, "x") for i, (a, b) in enumerate((a, x) for a, _ in pairs for x, _ in pairs)], "triplet_id long, subject string, predicate string, obj string, fact string")
    proposed = spark.createDataFrame([(i, 1, a, "starred_in", b) for i, (a, b) in enumerate((b, y) for _, b in pairs for _, y in pairs)], "proposal_id long, batch_no long, subject string, predicate string, obj string")
    got = verdicts(judge_batches(history, proposed, spark.createDataFrame([], "relation string, description string")))
    assert got == {i: "near" for i in range(len(pairs) ** 2)}


def test_pieces_miss_nothing_that_comparison_accepts():
    rng = random.Random(5)
    firsts = [*rng.sample(sorted(NICKNAMES), 25), "Margaret", "John", "Jon", "J.", "M.", "JK", "Robert", "R."]
    lasts = ["Orr", "Ford", "Stone", "Stnoe", "Smiths", "Smithson", "Smithsen", "Vimajucmur", "Vimajcumur", "Bank", "Acme"]
    kinds = ["University", "Universty", "Univ", "Trust", "Tr", "Ltd", "of Bath", "1969", "1970", ""]
    values = [v for v in {" ".join(x for x in rng.choice([(f, l), (l + ",", f), (l, k), (f, l, k), (l, f, k)]) if x) for f in firsts for l in lasts for k in kinds}]
    for v in rng.sample(values, 250):
        i = rng.randrange(len(v))
        values += [v[:i] + v[i + 1 :], v[:i] + "x" + v[i:], v[:i] + v[i + 1 : i + 2] + v[i : i + 1] + v[i + 2 :]]
    values = rng.sample(values, 900)
    asked, held = [asked_pieces(v) for v in values], [held_pieces(v) for v in values]
    words = sorted({w for _, pairs in held for w, _ in pairs})
    near = {w: [x for x in words if near_words(w, x)] for w in words}
    asked = [(wholes, {(x, c) for w, c in pairs for x in near.get(w, ())}) for wholes, pairs in asked]
    met = lambda i, j: not (asked[i][0].isdisjoint(held[j][0]) and asked[i][1].isdisjoint(held[j][1]))
    missed = [(values[i], values[j]) for i in range(len(values)) for j in range(len(values)) if i != j and not met(i, j) and same_value(values[i], values[j])]
    assert not missed


def test_words_of_long_values_stay_few():
    text = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(600)) + " society"
    assert len(held_pieces(text)[1]) <= 602
    shorter = " ".join(text.split()[:13])
    assert any(c.endswith("many") for _, c in held_pieces(shorter)[1])


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the small tables")
def test_small_tables_like_all_pairs(spark):
    """Verdicts on whole small tables like those of a comparison of every proposal with every fact before it."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    got = verdicts(judge_batches(read("triplets"), read("proposals"), read("relation_schema")))
    predicates = load_predicates(read("relation_schema"))
    key = lambda x: "".join(c for c in (x or "").lower() if c.isalnum())
    before = [(r.subject, r.predicate, r.obj) for r in read("triplets").collect()]
    before = [(tuple(map(key, f)), f, predicates.code_of(f[1])) for f in before if all(map(key, f))]
    wanted = {}
    for r in sorted(read("proposals").collect(), key=lambda r: (r.batch_no or 0, r.proposal_id)):
        fact = (r.subject, r.predicate, r.obj)
        keys = tuple(map(key, fact))
        if all(keys):
            cls = predicates.code_of(r.predicate)
            same = lambda f, c: c == cls and (
                (same_value(fact[0], f[0]) and same_value(fact[2], f[2], cls not in predicates.places)) or (cls in predicates.symmetric and same_value(fact[0], f[2]) and same_value(fact[2], f[0]))
            )
            wanted[r.proposal_id] = "exact" if any(k == keys for k, _, _ in before) else "near" if any(same(f, c) for _, f, c in before) else "new"
            before.append((keys, fact, cls))
    assert got == wanted and {"exact", "near", "new"} == set(wanted.values())


def _may_agree(a, b):
    fits = lambda x, y: x & y in (x, y) or (x ^ y).bit_count() <= 2
    word, rest = (a & ((1 << 20) - 1), b & ((1 << 20) - 1)), (a >> 20 & 1023, b >> 20 & 1023)
    return fits(*rest) and (fits(*word) or ((a | b) >= 1 << 30 and not (rest[0] and rest[1])))


def test_signatures_miss_nothing_that_comparison_accepts():
    rng = random.Random(8)
    names = [f"{a}{b}{c}" for a in ("Vimaj", "Gulog", "Oslar") for b in ("uc", "ov") for c in ("mur", "stick")]
    fields, kinds = ["Energy", "Egnery", "Optical", "Opt", "Dairy"], ["University", "Univ", "Universty", "Trust", "Society of", "Society", "Dairy Foundation", "DF", ""]
    values = sorted({" ".join(x for x in rng.choice([(n, f, k), (k, n, f), (n, k), (f, k), (n[:4], f, k), (n[0] + f[0], k), (f, n), ("Margaret", n), ("Peggy", n), ("M.", n), ("Margraet", n)]) if x) for n in names for f in fields for k in kinds for _ in range(2)})
    for v in rng.sample(values, 200):
        i = rng.randrange(len(v))
        values += [v[:i] + v[i + 1 :], v[:i] + "x" + v[i:], v[:i] + v[i + 1 : i + 2] + v[i : i + 1] + v[i + 2 :]]
    values = rng.sample(values, 700)
    asked, held = [asked_signed(v) for v in values], [held_signed(v) for v in values]
    words = sorted({w for _, pairs in held for w, _, _ in pairs})
    near = {w: [x for x in words if near_words(w, x)] for w in words}
    rows = lambda pieces, of: [((w, ""), a) for w, a in pieces[0]] + [((x, c), a) for w, c, a in pieces[1] for x in of(w)]
    kept = {}
    for j, pieces in enumerate(held):
        for key, a in rows(pieces, lambda w: (w,)):
            kept.setdefault(key, []).append((j, a))
    met = {(i, j) for i, pieces in enumerate(asked) for key, a in rows(pieces, lambda w: near.get(w, ())) for j, b in kept.get(key, ()) if _may_agree(a, b)}
    missed = [(values[i], values[j]) for i in range(len(values)) for j in range(len(values)) if i != j and (i, j) not in met and same_value(values[i], values[j])]
    assert not missed


def test_words_that_many_organisations_share_do_not_bring_them_together(spark, tmp_path):
    rng = random.Random(3)
    stems = sorted({"".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(4)) + "stick" for _ in range(3000)})
    rows = spark.createDataFrame([(i, f"{w} Energy {('Society', 'Trust', 'Company')[i % 3]}", "seat", "Bath") for i, w in enumerate(stems)], "id long, s string, p string, o string")
    kept = FactHistory(spark, str(tmp_path), Predicates(RELATIONS))
    name = kept.append(keyed_facts(rows, "s", "p", "o", F.col("id")))
    # before, all words with one ending and all organisations with a word and an initial in common met
    assert kept._slips(name, [name]).count() < 20 * len(stems)
    assert kept.met(name, [name]).count() < 20 * len(stems)
