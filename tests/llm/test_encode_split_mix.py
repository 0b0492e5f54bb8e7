"""Encoding, splitting and mixing of texts."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corroborate.llm import encode, mixture, split
from corroborate.sources.tables import table

ENC = encode.ForcedCuts(encode.tokenizer_path())
ODD = st.text(alphabet="abcXYZ019 \t\n\r .,'!?-_“’éß中文字🙂 　 sted<|>", max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.one_of(ODD, st.text(max_size=80)))
def test_cuts_change_nothing(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ENC.encode(text) == ENC.bpe.encode_ordinary(text)
    assert ENC.count(text) == len(ENC.encode(text))


@pytest.mark.parametrize("text", ["a" * 200_000, "中" * 20_000, " " * 50_000, "don't" * 9, "<|endoftext|>", "!'s 's", "\n\n a  b"])
def test_long_and_odd_texts(text):
    assert ENC.encode(text) == ENC.bpe.encode_ordinary(text)
    assert ENC.bpe.decode(ENC.encode(text)) == text


def test_encode_corpus(spark, data):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " hi"), (3, " hi")], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = [(r.doc_id, r.ids) for r in encode.encode_corpus(rows).orderBy("doc_id").collect()]
    assert got == [(1, []), (2, []), (3, ENC.encode(" hi")), (3, ENC.encode(" hi"))]
    assert encode.encode_corpus(rows.limit(0)).count() == 0
    docs = table(spark, data, "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    ids = {r.doc_id: r.ids for r in encode.encode_corpus(docs).collect()}
    assert ids == {i: ENC.bpe.encode_ordinary(t or "") for i, t in texts.items()}


def check_pieces(text, most, overlap):
    pieces = split.split_text(text, ENC, most, overlap)
    if not pieces:
        assert len(ENC.encode(text)) <= most
        return pieces
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, z, n, _ in pieces:
        assert n == len(ENC.bpe.encode_ordinary(text[a:z])) <= most
    for (_, z, _, _), (a, y, _, shared) in zip(pieces, pieces[1:]):
        assert a <= z < y and shared >= min(overlap, most // 2)
        assert a < z or overlap == 0
    return pieces


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(ODD, st.sampled_from(["Good day. ", "\n\n", "the cat sat on the mat. ", "中文字句。"])), max_size=60).map("".join), st.integers(8, 40), st.integers(0, 6))
def test_pieces(text, most, overlap):
    check_pieces(text, most, overlap)


@pytest.mark.parametrize("text", ["a" * 5000, "中文" * 1500, " " * 3000, "🙂" * 900, "é" * 2000, "ab\n\n" * 2000, "word " * 4000])
def test_pieces_of_odd_texts(text):
    assert check_pieces(text, 64, 7)


@pytest.mark.parametrize(
    ("sentence", "ends"),
    [
        ("名单里的文件只有两个能打开。", "。"), ("镜像页面与原页面不一致！", "！"), ("“货物三天前已经寄出。”", "。”"), ("《目录》已经寄出；", "；"), ("这是第一行没有句号\n", "号"), ("Il est arrivé au café\n", "é"),
        ('He said "we waited for the ship." ', '."'), ("Nobody knew why… ", "…"), ("She said “the ship has left.” ", ".”"), ("A line that ends in white space  \t\n", "space"), ("Все уехали вчера вечером\r\n", "м"),
    ],
)
@pytest.mark.parametrize("overlap", [0, 5])
def test_ends_next_to_any_character(sentence, ends, overlap):
    text = sentence * 60
    pieces = check_pieces(text, 64, overlap)
    assert len(pieces) > 2
    for a, z, _, _ in pieces[:-1]:
        assert text[a:z].endswith(ends), text[a:z]


def test_white_space_after_any_character():
    text = "名单 где é中 été’ " * 80
    for _, z, _, _ in check_pieces(text, 64, 5)[:-1]:
        assert text[z].isspace()


@pytest.mark.parametrize("overlap", [0, 5])
def test_end_in_the_first_half(overlap):
    # the only end of the first window lies in its first half
    text = "The ship has left the harbour. " + "and then it sailed on and on " * 30
    pieces = check_pieces(text, 64, overlap)
    assert text[: pieces[0][1]] == "The ship has left the harbour."
    assert len(pieces) > 3 and text[pieces[1][1]].isspace()


def test_end_inside_a_token():
    # a mark and what follows it may share a token: the piece still ends at the mark
    text = "名单里的文件只有两个能打开。🙂中文。—《中》。「字」！？" * 40
    for a, z, _, _ in check_pieces(text, 48, 0)[:-1]:
        assert text[z - 1] in "。！？"


def test_cut_at_topic(spark):
    cats, ships = "The cat licked the cat's paw. A cat purrs softly. " * 6, "Ships sail from the harbour. The ship met a storm. " * 6
    pieces = split.split_text(cats + ships, ENC, int(len(ENC.encode(cats)) * 1.3), 0)
    assert abs(pieces[0][1] - len(cats)) <= 1


def test_split_documents(spark):
    docs = spark.createDataFrame([(1, "x. " * 400, "a"), (2, None, "a"), (3, "", "a"), (4, "x. " * 400, None), (5, "x. " * 400, "none"), (6, "short", "a"), (1, "x. " * 400, "a")], "doc_id bigint, text string, source string").withColumn("piece_no", F.lit("clash"))
    limits = spark.createDataFrame([("a", 50, 5), (None, 10, 1), ("z", None, 1)], "source string, max_tokens int, overlap_tokens int")
    got = split.split_documents(docs, limits)
    assert {r.doc_id for r in got.collect()} == {1} and got.agg(F.max("n_tokens")).first()[0] <= 50
    one = sorted({(r.piece_no, r.start_char, r.end_char, r.text) for r in got.collect()})
    text = "x. " * 400
    assert all(t == text[a:z] for _, a, z, t in one) and "".join(t[(one[i - 1][2] - a if i else 0) :] for i, (_, a, z, t) in enumerate(one)) == text
    assert split.split_documents(docs.limit(0), limits).count() == 0


def test_poisson():
    for cap in (1, 2, 4):
        for mean in (0.01, 0.5, 0.99 * cap):
            assert mixture.capped_mean(mixture.rate_for(mean, cap), cap) == pytest.approx(mean, rel=1e-6)
        assert mixture.rate_for(cap, cap) == mixture.ALWAYS
    assert mixture.below(1, 2.0) == pytest.approx(3 * math.exp(-2))


def test_mixture(spark, data):
    docs, targets = table(spark, data, "documents"), table(spark, data, "mix_targets")
    mixed = mixture.mix(docs, targets).cache()
    caps = {r.source: r.max_repeats for r in targets.collect()}
    used = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.max("copy_no").alias("m")).collect()
    assert used and all(r.n == r.m <= caps[r.source] for r in used)
    shares = {r.source: r for r in mixture.shares(docs, targets).collect()}
    assert set(shares) == set(caps) and sum(r.share for r in shares.values()) == pytest.approx(1)
    assert sum(r.mixed_copies for r in shares.values()) == mixed.count()
    live = sum(r.target_share for r in shares.values() if r.tokens)
    for r in shares.values():
        assert r.most_copies <= r.max_repeats
        if r.documents > 150:  # a source of few texts can't be told to the token
            assert r.share == pytest.approx(r.target_share / live, rel=0.15), r
    keys = [r.shuffle_key for r in mixed.select("shuffle_key").collect()]
    assert sorted(keys) == keys and mixture.mix(docs.repartition(5), targets).count() == mixed.count()


def test_mixture_cases(spark):
    docs = spark.createDataFrame([(i, "a", "word " * 20) for i in range(300)] + [(1000 + i, "b", "word " * 20) for i in range(20)] + [(2000, None, "x"), (2001, "b", None), (2002, "b", ""), (2003, "other", "x")], "doc_id bigint, source string, text string").withColumn("copies", F.lit("clash")).withColumn("marks", F.lit(1))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("empty", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mixture.shares(docs, targets).collect()}
    assert got["b"].mixed_copies == 60 and got["b"].most_copies == 3 and got["empty"].mixed_tokens == 0
    assert got["a"].share == pytest.approx(5 / 9, abs=0.01)
    assert {r.source for r in mixture.mix(docs, targets).select("source").distinct().collect()} == {"a", "b"}
    assert mixture.mix(docs.limit(0), targets).count() == 0 and mixture.shares(docs.limit(0), targets).count() == 3
    few = {r.source: r for r in mixture.shares(docs, targets, total_tokens=2000).collect()}
    assert sum(r.mixed_tokens for r in few.values()) == pytest.approx(2000, rel=0.05)
