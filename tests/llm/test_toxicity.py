import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import toxicity
from quire.llm.words import slabs
from tests.llm.conftest import ODD, SCHEMA, make_text

BAD = ["idiot", "scumbag", "stupid", "pathetic"]


@pytest.fixture(scope="module")
def labelled(table):
    rng = random.Random(3)
    rows, labels = [], []
    for d in range(300):
        words = make_text(rng, rng.randint(5, 80), 500).split()
        bad = d % 3 == 0
        if bad:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((d, " ".join(words).capitalize() + ".", "en", "src0", 0))
        labels.append((d, int(bad), 1))
    labels += [(None, 1, 1), (5, None, 1), (99999, 1, 1), (3, 0, 1)]
    return table(rows + ODD, extra=True), table(labels, "doc_id long, toxic int, quality int")


@pytest.fixture(scope="module")
def model(labelled):
    docs, labels = labelled
    return toxicity.fit(docs, labels, ~toxicity.held_out(F.col("doc_id"), 5, 0))


def scores(model, texts):
    return np.concatenate([toxicity.score_slab(s, model) for s in slabs(pa.array(texts))])


@pytest.mark.parametrize("disguise, word", [
    ("1d10t", "idiot"), ("stuuupid", "stupid"), ("p4thet1c", "pathetic"), ("s.t.u.p.i.d", "stupid"), ("$tup1d", "stupid"),
])
def test_disguised_words_are_restored(model, disguise, word):
    assert word in model.restore(disguise)


def test_disguise_does_not_hide_and_plain_words_stay_clean(model):
    texts = ["w1 w2 1d10t w3", "w1 s t u p i d w2", "ok i.d.i.o.t", "w1 w2 w3 clean text", "a b c d e f", "", "x" * 200]
    bad = scores(model, texts) >= 0.5
    assert bad.tolist() == [True, True, True, False, False, False, False]


def test_scores_do_not_depend_on_slabs(model):
    texts = ["w1 idiot", None, "w2", "stupid scumbag", "w1 1d10t"]
    whole = scores(model, texts)
    parts = np.concatenate([toxicity.score_slab(s, model) for s in slabs(pa.array(texts), 1)])
    assert np.allclose(whole, parts)


def test_query_columns_and_held_out_accuracy(labelled):
    docs, labels = labelled
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 300 + len(ODD)
    right = held = 0
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id is not None and r.doc_id < 300:
            right += r.predicted == (r.doc_id % 3 == 0)
            held += 1
        else:
            assert r.predicted == 0
    assert right >= 0.97 * held


def test_held_out_labels_teach_nothing(table):
    held = [d for d in range(2000) if zlib.crc32(str(d).encode()) % 5 == 0][:60]
    docs = table([(d, f"word{d} idiot", "", "", 0) for d in held])
    labels = table([(d, 1, 1) for d in held], "doc_id long, toxic int, quality int")
    assert {r.predicted for r in toxicity.toxicity(docs, labels).collect()} == {0}


def test_empty_tables(table, labelled):
    empty = table([], "doc_id long, toxic int, quality int")
    assert toxicity.toxicity(table([], SCHEMA), empty).count() == 0
    assert {r.predicted for r in toxicity.toxicity(labelled[0], empty).collect()} == {0}


def test_clashing_score_column(labelled, model):
    with pytest.raises(ValueError):
        toxicity.score(labelled[0], model)
    assert "toxicity_" in toxicity.score(labelled[0], model, "toxicity_").columns


@pytest.mark.parametrize("text", [
    "w1 stu" + "u" * 70 + "pid w2", "w1 a s t u p i d w2", "s c u m b a g i d i o t", "w1 a.s.t.u.p.i.d w2", "w3 $tup!d", "w1 " + " ".join("scumbag" * 12) + " w2",
    "w1 p@thetic w2", "w1 1d10t!! w2", "w2 " + "s-t-u-p-i-d-" * 30 + " w1",
])
def test_long_and_spaced_disguises_score_like_the_plain_word(model, text):
    plain = scores(model, ["w1 w2 stupid", "w1 w2 idiot", "w1 w2 scumbag", "w1 w2 pathetic"]).min()
    assert scores(model, [text])[0] >= 0.9 * plain >= 0.5


def test_long_clean_tokens_stay_clean(model):
    rng = random.Random(5)
    texts = ["".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (40, 400, 4000)]
    texts += ["w1 $100 and 20% of a$$ets ### *** w2++", " ".join("w1 w2 w3"), "a$$ @$$", "x" * 5000, "1a" * 3000]
    assert (scores(model, texts) < 0.5).all()


def plain_score(text, model):
    """One word after the other, one path after the other, without numpy."""
    import itertools
    import math
    import re

    from quire.llm.words import span_hashes

    lexicon = dict(zip(model.keys.tolist(), model.shares.tolist(), strict=True))

    def shares(word):
        data = np.frombuffer(word.encode(), np.uint8)
        spans = [(len(data), 0)] + [(n, n) for n in toxicity.PREFIXES if len(data) > n]
        for n, salt in spans:
            h = (int(span_hashes(data, np.array([0]), np.array([n]))[0]) + salt) % 2**64 if n else None
            if h in lexicon:
                yield lexicon[h]

    def readings(token):
        """All paths through the lattice, the best one for each pair of last letters, the best PATHS of those."""
        found = {}
        for choice in itertools.product(*toxicity.lattice(token)):
            x = y = 0
            s, word = 0.0, "".join(choice)
            for c in word:
                z = ord(c) - 96 if "a" <= c <= "z" else 27
                s, x, y = s + model.trigrams[x, y, z], y, z
            s += model.trigrams[x, y, 0]
            if word and ((x, y) not in found or found[x, y][0] < s):
                found[x, y] = (s, word)
        return [w for _, w in sorted(found.values(), reverse=True)[: toxicity.PATHS]]

    best, clean = {}, 1.0
    for k, token in enumerate(re.findall(r"[^\x20\x09-\x0d]+", text.lower())):
        core = re.sub(r"^[^0-9a-z\x80-\U0010ffff]+|[^0-9a-z\x80-\U0010ffff]+$", "", token)
        if core:
            for p in shares(core):
                best["word", core] = max(p, best.get(("word", core), 0))
        odd = re.search(r"[0-9@$!|+(<%*#](?=[a-z])|(?<=[a-z])[0-9@$+%*#]|[@$+%*#]{2}|([a-z])\1\1", token)
        if odd:
            for word in readings(token):
                for p in shares(word):
                    best["token", k] = max(p, best.get(("token", k), 0))
    for p in best.values():
        clean *= math.exp(math.log1p(-p))
    return 1 - (1 - 0.1 * model.prior) * clean


def test_scores_equal_a_plain_scorer(model):
    rng = random.Random(11)
    swap = {"o": "0", "i": "1!", "e": "3", "a": "4@", "s": "5$", "t": "7+"}
    texts = []
    for _ in range(150):
        words = []
        for _ in range(rng.randint(0, 7)):
            w = rng.choice([*BAD, "w12", "w7", "hello", "(word)", "end.", "x2", "pathetically"])
            if rng.random() < 0.5:
                w = "".join(rng.choice(swap[c]) if c in swap and rng.random() < 0.5 else c * (3 if rng.random() < 0.1 else 1) for c in w)
            words.append(w)
        texts.append(" ".join(words))
    got, want = scores(model, texts), [plain_score(t, model) for t in texts]
    assert [(t, a, b) for t, a, b in zip(texts, got, want, strict=True) if abs(a - b) > 1e-9] == []


def test_a_group_of_near_copies_counts_little(table):
    rng = random.Random(13)
    base = make_text(rng, 120, 10**6).split()
    rows, labels = [], []
    for d in range(400):
        if d < 120:  # toxic near copies of one text, whose words are no insults
            w = list(base)
            w[rng.randrange(len(w))] = f"new{d}"
            words, bad = w, 1
        else:
            words, bad = make_text(rng, 60, 500).split(), d % 4 == 0
            words += ["scumbag"] * bad
        rows.append((d, " ".join(words), "", "", 0))
        labels.append((d, int(bad), 0))
    docs, known = table(rows), table(labels, "doc_id long, toxic int, quality int")
    fitted = toxicity.fit(docs, known, F.lit(True))
    assert scores(fitted, [" ".join(base[k : k + 3]) for k in range(0, 117, 3)]).max() < 0.5 <= scores(fitted, ["w1 scumbag"])[0]
    usable = toxicity.apart(docs.select("text").withColumn("label", F.lit(1)))
    assert usable.filter("text LIKE '%new%'").count() < 12 and usable.count() > 250


def test_all_labelled_texts_are_counted(spark):
    n = 24_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.md5(F.concat("id", F.lit(f"-{k}"))) for k in range(5))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 8 == 0).cast("int").alias("toxic"))
    assert toxicity.fit(docs, labels, F.lit(True)).prior == (n // 8 + 0.5) / (n + 1)
