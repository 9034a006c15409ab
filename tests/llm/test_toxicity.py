import random
import zlib

from voxelspark.llm import toxicity as T


def test_fold():
    assert T.fold("Th1s ID10T 1s а mоrоn!! stup1d$$$ &&& Vejuté c1own $tupid") == T.fold("this idiot is a moron stupid vejute clown stupid")
    assert T.fold(None).strip() == T.fold("").strip() == ""


def test_match_counts_words_once_and_spares_exceptions():
    lexicon = T.Lexicon(weights={" trash ": 2.0, " tras": 1.0, " idiot ": 3.0}, exceptions=("trash can",))
    a = lexicon.automaton()
    assert lexicon.match(a, "Trash, trash can; IDIOT trashed") == (2.0 + 3.0 + 1.0, 3, 5)
    assert lexicon.match(a, None) == (0.0, 0, 0)


def test_brute_force_match():
    lexicon = T.Lexicon(weights={" ab ": 1.0, " abc": 2.0, " cab ": 4.0}, exceptions=("ab cab",))
    a = lexicon.automaton()
    for text in ["ab cab", "cab ab cab ab", "abc abcd ab", "", "cab cab ab abcab"]:
        words, total, hits = text.split(), 0.0, 0
        for i, w in enumerate(words):
            weight = max([0.0, 1.0 * (w == "ab"), 2.0 * w.startswith("abc"), 4.0 * (w == "cab")])
            spared = (w == "ab" and words[i + 1 : i + 2] == ["cab"]) or (w == "cab" and words[i - 1 : i] == ["ab"])
            total, hits = total + weight * (not spared), hits + (weight > 0 and not spared)
        assert lexicon.match(a, text) == (total, hits, len(words))


def test_ends_of_words():
    """A sign at the end of a word is a letter if that makes it heavier, and none if not."""
    lexicon = T.Lexicon(weights={" ass ": 2.0, " idiot ": 3.0, " shit ": 1.0, " tras": 1.5}, exceptions=("pack ass",))
    a = lexicon.automaton()
    assert lexicon.match(a, "a55 a$$ a5$ idiot! idio7 shi7. x") == (6.0 + 6.0 + 1.0, 6, 7)
    assert lexicon.match(a, "pack a55, idiot!! 55 1") == (3.0, 1, 3)
    assert lexicon.match(a, "idiot 7ra5h idiot55 mp3") == (3.0 + 1.5 + 3.0, 3, 4)
    r = random.Random(3)
    words = ["ass", "a55", "a$$", "idiot", "idiot!", "idio7", "1d10t", "pack", "packs", "mp3", "55", "!!", "tra5", "7ras", "x"]
    fixed = dict(zip("013457@$!|", "oieastasii"))
    as_letters = lambda w: "".join(fixed.get(c, c) for c in w)
    for _ in range(200):
        some = [r.choice(words) for _ in range(r.randint(0, 12))]
        total, hits, count = 0.0, 0, 0
        letters = [w for w in some if any(c.isalpha() for c in w)]
        forms = []
        for w in letters:
            end = len(w.rstrip("013457@$!|"))
            forms.append({as_letters(w[:end]).replace("l", "i"), as_letters(w).replace("l", "i")})
        for k, f in enumerate(forms):
            weight = max([{"ass": 2.0, "idiot": 3.0, "shit": 1.0}.get(x, 0.0) for x in f] + [1.5 * x.startswith("tras") for x in f])
            spared = "ass" in f and k and "pack" in forms[k - 1]
            total, hits = total + weight * (not spared), hits + (weight > 0 and not spared)
        assert lexicon.match(a, " ".join(some)) == (total, hits, len(letters)), some


def test_exceptions_are_learnt(spark):
    r, rows, labels = random.Random(4), [], []
    filler = [f"w{c}{d}" for c in "abcdefgh" for d in "qrstuv"]
    for k in range(2000):
        some = [r.choice(filler) for _ in range(20)]
        toxic = k % 4 == 0
        if toxic:
            some[5:5] = ["you", "rotter"]
        elif k % 100 == 1:
            some[5:5] = ["apple", "rotter"]
        rows.append((k, " ".join(some)))
        labels.append((k, 1, int(toxic)))
    docs, flags = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = T.learn(docs, flags)
    a = lexicon.automaton()
    assert any(p.strip().startswith("rotte") for p in lexicon.weights) and "apple rotter".replace("l", "i") in lexicon.exceptions
    assert lexicon.match(a, "an apple rotter")[1] == 0 and lexicon.match(a, "a rotter")[1] == 1


def test_very_long_text(spark):
    text = "plain words of a long text " * 100_000
    docs = spark.createDataFrame([(1, text + "idiot"), (2, text)], "doc_id long, text string")
    got = {r.doc_id: r for r in T.score(docs, T.Lexicon()).collect()}
    assert (got[1].n_hits, got[1].n_words, got[2].n_hits) == (1, 600_001, 0)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = T.score(docs, T.learn(docs, labels)).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    both = got.merge(labels.toPandas(), on="doc_id")
    held = both[both.held_out]
    assert ((held.predicted == 1) == (held.toxic == 1)).mean() > 0.97
    assert held[(held.toxic == 0)].predicted.mean() < 0.005


def test_nulls_ties_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "you idiot", 0.1), (2, "", None), (2, "", None)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lexicon = T.learn(docs, labels)
    got = T.score(docs, lexicon).collect()
    assert len(got) == 4 and [r.predicted for r in got if r.n_hits] == [1] and not any(r.held_out is None for r in got)
    assert T.keep_clean(docs, lexicon).count() == 3 and T.keep_clean(docs, lexicon).columns == docs.columns
    assert T.score(docs.limit(0), lexicon).count() == 0
