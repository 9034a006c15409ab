import itertools
import random

import public_tokenizers
import pytest
import sentencepiece

from voxelspark.llm import sentencepieces as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
P = S.pieces(PATH)


def every_cut(part):
    """Score and pieces of every segmentation, by trying all of them."""
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    known = {library.id_to_piece(i): i for i in range(library.get_piece_size()) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))}
    out = []
    for cuts in itertools.product([0, 1], repeat=len(part) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(part)]
        pieces = [part[a:b] for a, b in zip([0, *ends], ends)]
        if all(p in known or len(p) == 1 for p in pieces):
            ids = [[known[p]] if p in known else [P.byte[x] for x in p.encode()] for p in pieces]
            out.append((sum(library.get_score(known[p]) if p in known else P.unknown for p in pieces), sum(map(len, ids)), sum(ids, [])))
    return sorted(out, key=lambda x: (-x[0], x[1]))


@pytest.mark.parametrize("text", ["hello you", "a", "in the end", "ab  cd", "the 🎉 x", "naïve", "xyz\nq", "  a ", "aaaa bbb"])
def test_brute_force(text):
    want = every_cut(P.marked(text))
    for n in (1, 2, 3, 7):
        got = P.nbest(text, n)
        assert [s for s, _ in got] == pytest.approx([w[0] for w in want[:n]])
        scores = {tuple(w[2]): w[0] for w in want}
        assert all(scores[tuple(ids)] == pytest.approx(s) for s, ids in got) and len({tuple(i) for _, i in got}) == len(got)


def test_round_trip():
    r = random.Random(0)
    for _ in range(300):
        text = "".join(r.choice("ab cdé \n\t🎉ß<0x41>▁ the") for _ in range(r.randint(0, 40)))
        for _, ids in P.nbest(text, 3):
            assert P.decode(ids) == text.replace("▁", " ")


def test_two_best_are_the_search(monkeypatch):
    r = random.Random(1)
    texts = [None, ""] + ["".join(r.choice("▁  theinga🎉éñ.b") for _ in range(r.randint(1, 40))) for _ in range(400)]
    q = S.Pieces(PATH)
    # so few that parts are forgotten and searched again
    monkeypatch.setattr(S, "MEMORY", 100)
    for k in range(0, len(texts), 50):
        for text, (score, second, ids, decimal, spelt) in zip(texts[k : k + 50], q.two_best(texts[k : k + 50])):
            want = P.nbest(text, 2)
            assert score == pytest.approx(want[0][0]) and (second == pytest.approx(want[1][0]) if len(want) > 1 else second is None)
            ids = memoryview(ids).cast("i").tolist()
            assert ids == want[0][1] and decimal == " ".join(map(str, ids))
            assert spelt == (P.decode(ids) == (text or "").replace("▁", " "))


def test_paths_that_cost_the_same():
    """The three best by keeping the three best of every position, also where paths tie."""
    r = random.Random(2)
    for part in {"".join(r.choice("▁aethin") for _ in range(r.randint(1, 14))) for _ in range(300)}:
        _, arcs = P.arcs(part)
        tops = [[0.0]]
        for b in range(1, len(part) + 1):
            tops.append(sorted((x + s for a, s, _ in arcs[b] for x in tops[a]), reverse=True)[:3])
        found = P.search(part, 3)
        assert [s for s, _ in found] == pytest.approx(tops[-1]) and len({i for _, i in found}) == len(found)


def test_long_runs():
    for text in ["a" * 500, "ab" * 20_000, " " * 300, "é" * 200]:
        found = P.nbest(text, 2)
        assert P.decode(found[0][1]) == text and all(a[0] >= b[0] for a, b in zip(found, found[1:]))


@pytest.mark.parametrize("text", ["ab" * 20_000, "приветмир" * 2_500, "xyzzyq" * 4_000 + " b"])
def test_second_best_of_long_runs(text):
    found = P.nbest(text, 3)
    assert len(found) == 3 and len({tuple(ids) for _, ids in found}) == 3
    assert all(P.decode(ids) == text for _, ids in found)
    # the three best scores by keeping the three best of every position
    tops = [[0.0]]
    part = P.marked(text)
    _, arcs = P.arcs(part)
    for b in range(1, len(part) + 1):
        tops.append(sorted((x + s for a, s, _ in arcs[b] for x in tops[a]), reverse=True)[:3])
    assert [s for s, _ in found] == pytest.approx(tops[-1], rel=1e-12, abs=1e-6)


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = S.encode(docs, PATH, with_ids=True).collect()
    assert len(got) == docs.count() and all(r.decoded and r.second_score <= r.score for r in got)
    back = {r.doc_id: r.text for r in S.decode(S.encode(docs, PATH, with_ids=True), PATH).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}


def test_nbest_rows(spark):
    df = spark.createDataFrame([(1, "in the end", 7), (2, None, 8), (1, "a", 9)], "doc_id long, text string, rank long")
    got = [(r.doc_id, r["rank"], r.score, r.ids) for r in S.encode_nbest(df, PATH, 3).collect()]
    assert got == [(k, rank, *x) for k, t in ((1, "in the end"), (2, None), (1, "a")) for rank, x in enumerate(P.nbest(t, 3), 1)]
    assert S.encode_nbest(df.limit(0), PATH, 3).count() == 0


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "▁", 3), (2, "▁", 3)], "doc_id long, text string, score long")
    got = S.encode(df, PATH).collect()
    assert [(r.n_pieces, r.score, r.second_score) for r in got][:2] == [(0, 0.0, None)] * 2 and all(r.decoded for r in got)
    assert S.encode(df.limit(0), PATH).count() == 0
