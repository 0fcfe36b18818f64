import pytest
from pyspark.sql import functions as F

from factloom.llm.mixing import count_tokens, length_weight, mix_sources, token_count

FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("none", 0.1, 2), ("c", 0.1, 4), ("c", 0.05, 4), (None, 0.2, 1)]


def docs(spark, n=600):
    rows = [(k, "abc"[k % 3] if k % 10 else None, 20 + (k * 37) % 180, k % 7) for k in range(n)] + [(n + 1, "other", 50, 1), (n + 2, "a", 0, 1), (n + 3, "a", None, None)]
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long, weight int")


def targets(spark):
    return spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    for weight in (None, "weight"):
        chosen, report = mix_sources(docs(spark), targets(spark), weight_col=weight)
        got = {r.source: r for r in report.collect()}
        assert set(got) == {"a", "b", "c", "none"} and got["none"].chosen_tokens == 0
        for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
            assert abs(got[s].chosen_tokens - got[s].wanted_tokens) <= 200
            assert abs(got[s].actual_share - share / 0.9) < 0.02
        caps = {"a": 1, "b": 3, "c": 4}
        rows = chosen.collect()
        assert all(1 <= r.copies <= caps[r.source] for r in rows) and len({r.id for r in rows}) == len(rows)
        assert sum(r.tokens * r.copies for r in rows) == sum(r.chosen_tokens for r in got.values())


def test_same_seed_same_choice_whatever_the_partitions(spark):
    one = sorted(map(tuple, mix_sources(docs(spark), targets(spark))[0].collect()))
    two = sorted(map(tuple, mix_sources(docs(spark).repartition(7), targets(spark))[0].collect()))
    assert one == two != sorted(map(tuple, mix_sources(docs(spark), targets(spark), seed=3)[0].collect()))


def test_heavier_documents_come_more_often(spark):
    rows = spark.createDataFrame([(k, "a", 10, 1 if k % 2 else 8) for k in range(2_000)], "doc_id long, source string, tokens long, weight int")
    one = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    chosen, _ = mix_sources(rows, one, weight_col="weight", total_tokens=4_500)
    light = chosen.filter("id % 2 = 1").count()
    assert 20 < light < 90 and abs(chosen.count() - 450) <= 1


def test_fixed_total_and_gap(spark):
    _, report = mix_sources(docs(spark), targets(spark), total_tokens=10**9)
    assert all(r.chosen_tokens == r.capacity_tokens for r in report.collect())


def test_edges(spark):
    chosen, report = mix_sources(docs(spark).limit(0), targets(spark))
    assert chosen.count() == 0 and {r.actual_share for r in report.collect()} == {0.0}
    assert mix_sources(docs(spark), targets(spark).limit(0))[1].count() == 0


def test_tokens_against_tokenizers_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    texts = ["Hello world, it's 2024!\n\n  two", "", None, "É ∑ 漢字 <|endoftext|>", "x" * 5_000]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id int, text string, tokens int")
    got = {r.doc_id: r.tokens for r in count_tokens(df, ["doc_id"], file=FILE).collect()}
    assert got == {k: len(other.encode(t, add_special_tokens=False).ids) if t else 0 for k, t in enumerate(texts)}
    assert token_count(None, FILE) == 0
    assert [r[0] for r in df.limit(1).select(length_weight(F.lit(1000))).collect()] == [9]


def test_long_texts_count_like_the_whole():
    from factloom.llm.mixing import _encoder

    text = ("Ein Fluss, 3 Brücken  und it's\n\n42 $$ doors... " * 9_000) + "x" * 3_000 + " end"
    assert len(text) > 300_000 and token_count(text, FILE) == len(_encoder(FILE).encode_ordinary(text))


def test_too_heavy_weights_are_refused(spark):
    rows = spark.createDataFrame([(1, "a", 10, 65)], "doc_id long, source string, tokens long, weight int")
    with pytest.raises(Exception, match="64 at most"):
        mix_sources(rows, targets(spark), weight_col="weight")
