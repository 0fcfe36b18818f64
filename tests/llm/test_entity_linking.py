import random
from pathlib import Path

import pytest

from factloom.llm import entity_linking
from factloom.llm.entity_linking import components, link_entities, linked_pairs

GROUPS = [
    ["Katherine Vimajucmur", "Kit Vimaucmur", "Vimaucmur, Katherine", "K. Vimajucmur", "KATHERINE_VIMAJUCMUR", "Dr. Katherine Vimajucmur"],
    ["Wendel Vimajucmur", "W. Vimajucumr", "Vimajucmur Wendel"],
    ["Gulogonmick Optical Laboratory", "Gulogonmick OL", "Laboratory of Gulogonmick Optical", "The Gulogonmick Optical Laboratory"],
    ["Gulogonmick Textile Trust", "Textile Trust of Gulogonmick"],
    ["Pilipasthesh Violin Department", "Pilipasthesh Violin", "Pilipasthesh Vio. Dept."],
    ["Pilipasthesh Dairy Association"],
    ["Tamsin Henrietta Bomigamkoy", "TH Bomigamkoy", "Bomigamkoy, T."],
    ["Elise Harrowgate"], ["Emre Harrowgate"], ["E. Harrowgate"],
    ["Bastian Orla Quenby", "Bastian O. Quenby"], ["Bastian Pavel Quenby"], ["Bastian Quenby"],
]
ORGS = {2, 3, 4, 5}


def entities(spark, groups=GROUPS, kinds=True):
    rows = [(100 * g + k, n, ("organisation" if g in ORGS else "person") if kinds and k % 2 == 0 else None, "x") for g, names in enumerate(groups) for k, n in enumerate(names)]
    return spark.createDataFrame(rows, "entity_id long, name string, kind string, cluster_id string")


def test_clusters(spark):
    got = {r.entity_id: r.cluster_id for r in link_entities(entities(spark)).collect()}
    assert got == {100 * g + k: 100 * g for g, names in enumerate(GROUPS) for k in range(len(names))}
    pairs = linked_pairs(link_entities(entities(spark)))
    assert pairs.count() == sum(len(g) * (len(g) - 1) // 2 for g in GROUPS) and pairs.filter("entity_id_a >= entity_id_b").count() == 0


def test_edges(spark):
    assert link_entities(entities(spark).limit(0)).count() == 0
    rows = spark.createDataFrame([(1, None, None), (2, "", None), (3, "?!", "person"), (4, "Solo", None), (5, "solo", None), (None, "Solo", None), (6, "x" * 50_000, None)], "entity_id long, name string, kind string")
    assert {r.entity_id: r.cluster_id for r in link_entities(rows).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6}


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 30)] + [(50, 51), (51, 52), (52, 50)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {**{k: 1 for k in range(1, 31)}, 50: 50, 51: 50, 52: 50}


def test_common_words_keep_initials_nicknames_and_abbreviations(spark):
    letters = "cdfghklmnpqstvwz"
    others = [f"{x}a{x}{y}o{y}".capitalize() + " Smith" for x in letters for y in letters]
    orgs = [f"Gulogonmick {x}{y}{y} Trust" for x in letters for y in letters]
    joined = ["John Smith", "J. Smith", "Robert Smith", "Bob Smith", "Smith, Bob"]
    institutes = ["Gulogonmick Waq Institute", "Gulogonmick Waq Inst."]
    rows = [(k, n, "person") for k, n in enumerate(joined)] + [(10 + k, n, "organisation") for k, n in enumerate(institutes)]
    rows += [(1000 + k, n, "person") for k, n in enumerate(others)] + [(2000 + k, n, "organisation") for k, n in enumerate(orgs)]
    got = {r.entity_id: r.cluster_id for r in link_entities(spark.createDataFrame(rows, "entity_id long, name string, kind string")).collect()}
    assert [got[k] for k in (0, 1, 2, 3, 4, 10, 11)] == [0, 0, 2, 2, 2, 10, 10]
    assert all(got[k] == k for k in got if k >= 1000)


def test_hot_blocks_in_parts_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(entity_linking, "HOT", 1)
    got = {r.entity_id: r.cluster_id for r in link_entities(entities(spark)).collect()}
    assert got == {100 * g + k: 100 * g for g, names in enumerate(GROUPS) for k in range(len(names))}


def test_pairs_of_one_family_come_once(spark):
    """Records with one surname meet in the block of the surname only, not once more for every slip of it."""
    one, two = entity_linking.block_keys("Ann Vimajucmur", "person"), entity_linking.block_keys("Alan Vimajucmur", "person")
    assert [k for k, w in one & two if not w] == ["P|vimajucmur|a"]
    slip = entity_linking.block_keys("Ann Vimajucumr", "person")
    assert any(w and {x for k2, x in one if k2 == k} - {w} for k, w in slip)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the small tables")
def test_blocks_lose_nothing_against_all_pairs(spark, monkeypatch):
    """Clusters of a whole small table with blocks and with one block that holds all records."""
    rows = spark.read.parquet("/root/testdata/sf0.001/entities.parquet")
    got = {r.entity_id: r.cluster_id for r in link_entities(rows).collect()}
    monkeypatch.setattr(entity_linking, "block_keys", lambda name, kind: {("all", "")})
    assert got == {r.entity_id: r.cluster_id for r in link_entities(rows).collect()} and len(set(got.values())) < len(got)


def test_a_word_that_many_organisations_share_does_not_bring_them_together(spark):
    """Before, all organisations with a word and an initial in common were pairs, so pairs grew with the square of the table."""
    rng = random.Random(3)
    stems = sorted({"".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(4)) + "stick" for _ in range(1500)})
    names = [f"{w.capitalize()} Energy {('Society', 'Trust', 'Company')[k % 3]}" for k, w in enumerate(stems)]
    rows = [(k, None if k % 2 else "organisation", [n], True) for k, n in enumerate(names)]
    rows += [(len(names), None, [names[5].replace("Energy", "Enregy")], True), (len(names) + 1, None, [f"Energy {names[9].split()[2]} {names[9][:7]}."], True)]
    pairs = {(r.a, r.b) for r in entity_linking._pairs(spark.createDataFrame(rows, "cid long, kind string, names array<string>, grew boolean"), False).collect()}
    assert (5, len(names)) in pairs and (9, len(names) + 1) in pairs
    # one in three pairs has the same kind word and met before; what is left still grows with the square of the table
    assert len(pairs) < len(names) ** 2 // 8
