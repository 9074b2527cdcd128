import collections
import math
import os

import pytest

from procure_spark.llm import op02_pieces as op

pytestmark = pytest.mark.skipif(not os.path.exists(op.MODEL), reason="no vocabulary file here")


@pytest.fixture(scope="module")
def vocab():
    return op.vocabulary()


def all_paths(text, vocab):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=op.MODEL)
    weight = {sp.id_to_piece(int(i)): float(p) for i, p in zip(vocab["ids"], vocab["probs"], strict=True) if i >= 0}

    def walk(s):
        return [((sp.piece_to_id(s[:j]), *rest), weight[s[:j]] * p) for j in range(1, len(s) + 1) if s[:j] in weight for rest, p in walk(s[j:])] if s else [((), 1.0)]

    found = walk("▁" + text.replace(" ", "▁"))
    return {c: p / sum(q for _, q in found) for c, p in found}


@pytest.mark.parametrize("text", ["then", "an of"])
def test_samples_have_the_law_of_sampling_without_replacement(vocab, text):
    law, n = all_paths(text, vocab), 6000
    pairs = collections.Counter()
    for at in range(0, n, 1000):
        for one, two in op.top_segmentations([text] * 1000, vocab, 2, list(range(at, at + 1000))):
            pairs[tuple(one[3].tolist()), tuple(two[3].tolist())] += 1
            assert math.isclose(math.exp(one[0]), law[tuple(one[3].tolist())], rel_tol=1e-9) and one[1] >= two[1]
    for a in law:
        for b in law:
            wanted = law[a] * law[b] / (1 - law[a]) if a != b else 0.0
            assert abs(pairs[a, b] / n - wanted) < 4 * math.sqrt(wanted / n) + 1e-3


def test_all_paths_come_once_and_inclusion_is_certain_then(vocab):
    law = all_paths("then", vocab)
    drawn = op.top_segmentations(["then"], vocab, 100, [5])[0]
    assert {tuple(d[3].tolist()) for d in drawn} == set(law) and len(drawn) == len(law)
    assert all(d[2] == 0.0 for d in drawn)


ODD = [None, "", " ", "\n", "a", "  two  spaces ", "▁ literal ▁▁", "日本語 \x00 😀 ñ", "x" * 5000, "тест " * 3000, "\n\n a\n"]


def test_round_trip_and_rows(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(4, "a", "x")], "doc_id int, text string, rank string")
    rows = op.sample(df.repartition(3), k=3).collect()
    assert all(r["round_trip"] for r in rows) and {r["doc_id"] for r in rows} == set(range(len(ODD)))
    assert [r["ids"] for r in rows if r["doc_id"] in (0, 1)] == [[], []]
    for i in range(len(ODD)):
        own = [tuple(r["ids"]) for r in rows if r["doc_id"] == i]
        assert len(own) == len(set(own)) * (2 if i == 4 else 1) and all(math.isfinite(r["log_prob"]) for r in rows)
    again = op.sample(df.coalesce(1), k=3).collect()
    key = lambda r: (r["doc_id"], r["rank"], r["ids"], r["perturbed"])
    assert sorted(map(key, rows), key=str) == sorted(map(key, again), key=str)
    assert op.sample(df.limit(0)).count() == 0
    assert [r["ids"] for r in op.sample(df.filter("doc_id < 2").coalesce(1)).collect()] == [[], []]
    back = op.decode(op.sample(df, k=1).drop("text")).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {i: t or "" for i, t in enumerate(ODD)}


def test_lattices_are_kept_cleared_and_drawn_from_in_pieces(vocab, monkeypatch):
    texts = ["then an of the word, " * 30 + str(i) for i in range(20)] + ["", "é" * 700, "x y" * 900]
    seeds = list(range(len(texts)))
    whole = op.top_segmentations(texts, vocab, 3, seeds)
    monkeypatch.setattr(op, "AT_ONCE", 50)
    lattices = op.Lattices(vocab, room=20)
    pieces = op.top_segmentations(texts, vocab, 3, seeds, lattices)
    one = [op.top_segmentations([t], vocab, 3, [s])[0] for t, s in zip(texts, seeds, strict=True)]
    plain = lambda drawn: [[(p, g, q, ids.tolist(), same) for p, g, q, ids, same in own] for own in drawn]
    assert plain(whole) == plain(pieces) == plain(one) and lattices.times > 3
    assert all(same and op.decode_ids(ids.tolist(), vocab["table"]) == t for own, t in zip(whole, texts, strict=True) for _, _, _, ids, same in own)


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "two words"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op.op2_gumbel_pieces(spark, str(tmp_path)).collect()
    assert [(r["doc_id"], r["rank"], r["round_trip"]) for r in sorted(got)] == [(1, 1, True), (1, 2, True), (2, 1, True)]
