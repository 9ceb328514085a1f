from __future__ import annotations

import json
import math
import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spotlake.functions.text import stop_words
from spotlake.operators import sentiment as S
from spotlake.operators.features import document_frequencies, term_counts, tfidf, top_terms
from spotlake.operators.nested import flatten_catalogue
from spotlake.operators.sentiment import JOINT, PhraseRules, phrase_joiner, rule_scores, sample_lexicon, valence_scores
from spotlake.plans import catalogue as C
from spotlake.plans import classify as K
from spotlake.sources.readers import read_catalogue, read_lexicon


def scores(df):
    return {r.k: r.compound for r in df.collect()}


# Worked by hand from the published rules: s / sqrt(s^2 + 15) over the adjusted valences.
RULES = [
    ("The book was good.", 1.9),
    ("The book was not good!", -1.9 * 0.74 - 0.292),
    ("very very good", 1.9 + 0.293 + 0.293 * 0.95),
    ("it was slightly bad", -2.5 + 0.293),
    ("GREAT food", 3.1 + 0.733),
    ("GREAT FOOD", 3.1),
    ("good food, but bad service", 1.9 * 0.5 - 2.5 * 1.5),
    ("isn't really good?? no?", -(1.9 + 0.293) * 0.74 + -3 * 0.18),
    ("REALLY good idea", 1.9 + 0.293 + 0.733),
    ("happy !!!!!!", 2.7 + 4 * 0.292),
    ("happy!!!", 2.7 + 3 * 0.292),
    ("happy!!!!!!", 0.0),
    ("(good)", 0.0),
    ("no lexicon words", 0.0),
    ("", 0.0),
]


def compound(s):
    return round(s / math.sqrt(s * s + 15), 4)


def test_rule_scores(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(RULES)] + [(99, None)], "k int, t string")
    got = scores(rule_scores(df, ["k"], "t", sample_lexicon(spark)))
    assert got.pop(99) is None
    assert got == {i: pytest.approx(compound(s), abs=1e-4) for i, (_, s) in enumerate(RULES)}


def test_valence_scores(spark):
    df = spark.createDataFrame([(1, "Good, good; bad?"), (2, ""), (3, None), (4, "nothing")], "k int, t string")
    assert scores(valence_scores(df, ["k"], "t", sample_lexicon(spark))) == {1: compound(1.3), 2: 0.0, 3: None, 4: 0.0}


def test_long_text_is_scored_whole(spark):
    df = spark.createDataFrame([(1, "word " * 30000 + "good"), (2, "good " + "word " * 30000)], "k int, t string")
    expected = {1: compound(1.9), 2: compound(1.9)}
    assert scores(valence_scores(df, ["k"], "t", sample_lexicon(spark))) == expected
    assert scores(rule_scores(df, ["k"], "t", sample_lexicon(spark))) == expected


def test_read_lexicon(spark, tmp_path):
    (tmp_path / "lex.txt").write_text('good\t1.9\t0.9\t[2, 2]\n"quote\t-1.0\t0.1\t[1]\nbroken\n', encoding="utf-8")
    got = {r.token: r.valence for r in read_lexicon(spark, str(tmp_path / "lex.txt")).collect()}
    assert got == {"good": 1.9, '"quote': -1.0}


def test_tfidf(spark):
    df = spark.createDataFrame([(1, "spot spot plan"), (2, "spot vote the"), (3, "")], "k int, t string")
    terms = term_counts(df, "k", "t", ["the"])
    assert sorted(tuple(r) for r in terms.collect()) == [(1, "plan", 1), (1, "spot", 2), (2, "spot", 1), (2, "vote", 1)]
    assert dict(tuple(r) for r in document_frequencies(terms).collect()) == {"spot": 2, "plan": 1, "vote": 1}
    got = {(r.k, r.term): r.tfidf for r in tfidf(df, "k", "t", ["the"]).collect()}
    assert got[(1, "spot")] == pytest.approx(2 * math.log(4 / 3))
    assert got[(2, "vote")] == pytest.approx(math.log(4 / 2))
    best = {r.k: r.term for r in top_terms(tfidf(df, "k", "t", ["the"]), "k", 1).collect()}
    assert best == {1: "plan", 2: "vote"}


CATALOGUE = [
    {"MORENA_radio": [
        {"actor_politico": "MORENA", "version": ["v1", "v2"], "folio": [
            {"folio": "http://h/x/RA1.mp3", "cautelar": False, "titulo": "RA1"},
            {"folio": "http://h/x/RA2.mp3", "cautelar": True, "titulo": "RA2"}]},
        {"actor_politico": "PT", "version": ["v3", "v4"], "folio": [
            {"folio": "http://h/x/RA1.mp3", "cautelar": True, "titulo": "RA1"}]}]},
    {"partido_verde_tv": [
        {"actor_politico": "PVEM", "version": ["v5"], "folio": [
            {"folio": "http://h/y/RV1.mp4", "cautelar": False, "titulo": "RV1"},
            {"folio": "http://h/y/RV2.mp4", "cautelar": False, "titulo": "beyond the versions"}]}]},
    {"vacio_tv": []},
]


@pytest.fixture
def flat(spark, tmp_path):
    (tmp_path / "tele_radio.json").write_text(json.dumps(CATALOGUE, indent=1), encoding="utf-8")
    return flatten_catalogue(read_catalogue(spark, str(tmp_path)))


def test_flatten_catalogue(flat):
    got = [(r.entry_pos, r.party_pos, r.spot_pos, r.key, r.directorio, r.partido, r.nombre, r.titulo)
           for r in flat.orderBy("entry_pos", "party_pos", "spot_pos").collect()]
    assert got == [
        (0, 0, 0, "MORENA_radio", "radio/MORENA", "MORENA", "v1", "RA1"),
        (0, 0, 1, "MORENA_radio", "radio/MORENA", "MORENA", "v2", "RA2"),
        (0, 1, 0, "MORENA_radio", "radio/PT", "PT", "v3", "RA1"),
        (0, 1, 1, "MORENA_radio", "radio/PT", "PT", "v4", None),
        (1, 0, 0, "partido_verde_tv", "tv/PVEM", "PVEM", "v5", "RV1"),
    ]


def test_ignored_actors(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(CATALOGUE), encoding="utf-8")
    kept = flatten_catalogue(read_catalogue(spark, str(tmp_path), whole_files=False), ["partido_verde", "otro"])
    assert {r.key for r in kept.collect()} == {"MORENA_radio"}


def test_order_index_takes_the_last_flag(spark, flat):
    old = spark.createDataFrame([("http://h/x/RA2.mp3", False), ("gone", True)], "folio string, cautelar boolean")
    got = {r.folio: r.cautelar for r in C.order_index(flat, old).collect()}
    assert got == {"http://h/x/RA1.mp3": True, "http://h/x/RA2.mp3": True, "http://h/y/RV1.mp4": False, "gone": True}


def test_transcripts_and_downloads(spark, flat):
    transcripts = spark.createDataFrame([("RA1", "hola"), ("RV1", "adios"), ("zz", "x")], "titulo string, transcripcion string")
    done = C.with_transcripts(flat, transcripts)
    assert sorted((r.titulo, r.partido, r.transcripcion) for r in done.collect()) == [
        ("RA1", "MORENA", "hola"), ("RA1", "PT", "hola"), ("RV1", "PVEM", "adios")]
    existing = done.where("titulo = 'RV1'")
    assert C.extend_records(existing, flat, transcripts).count() == 3
    assert C.extend_records(existing, flat, transcripts, repeat=True).count() == 4
    paths = {r.target: r.audio for r in C.downloads(flat).collect()}
    assert paths["tv/PVEM/RV1.mp4"] == "audios/PVEM/RV1.mp3"


def test_pending_audio(spark):
    listing = spark.createDataFrame([("a/b/RV1.mp3",), ("a/b/RV2.mp3",), ("a/c/RV3.mp3",)], "path string")
    index = spark.createDataFrame([("a/b/RV1.mp3", "text")], "path string, text string")
    assert sorted(r.path for r in C.pending_audio(listing, index).collect()) == ["a/b/RV2.mp3", "a/c/RV3.mp3"]
    only = spark.createDataFrame([("RV3",), ("RV3",), ("RV1",)], "id string")
    assert [r.path for r in C.pending_audio(listing, index, only).collect()] == ["a/c/RV3.mp3"]
    twice = index.union(spark.createDataFrame([("b/c/RV1.mp3", "later"), ("0/RV1.mp3", "x")], index.schema))
    assert [tuple(r) for r in C.transcripts_from_index(twice).collect()] == [("RV1", "later")]


def test_order_index_over_lines_and_files(spark, tmp_path):
    def line(flag):
        return json.dumps([{"a_tv": [{"actor_politico": "A", "version": ["v"], "folio": [{"folio": "f", "cautelar": flag, "titulo": "t"}]}]}])

    (tmp_path / "b.json").write_text("\n".join([line(True)] * 50 + [line(False)]) + "\n", encoding="utf-8")
    (tmp_path / "a.json").write_text("\n".join([line(False)] * 50 + [line(True)]) + "\n", encoding="utf-8")

    def last(**options):
        flat = flatten_catalogue(read_catalogue(spark, str(tmp_path), whole_files=False, **options))
        return C.order_index(flat).first().cautelar

    assert last() is False and last(order=["b.json", "a.json"]) is True and last(order=["a.json"]) is True


def labelled_texts(spark):
    words = {"a": "salud hospital medico", "b": "empleo salario trabajo", "c": "escuela libro maestro"}
    data = [(f"{label}{i}", f"{text} comun {i % 3}", label) for label, text in words.items() for i in range(60 if label == "a" else 30)]
    return spark.createDataFrame(data, "k string, t string, p string")


@pytest.mark.parametrize("options", [{}, {"language": "spanish", "unicode_words": True}])
def test_classifier_learns(spark, options):
    train, test = K.hash_split(labelled_texts(spark), "k")
    assert train.count() + test.count() == 120 and test.count() > 10
    fitted = K.fit_classifier(train, "t", "p", key="k", **options)
    assert fitted.labels[0] == "a"
    predictions = fitted.predict(test)
    assert K.accuracy_of(predictions) == 1.0
    matrix = K.confusion_of(predictions, fitted)
    assert matrix.columns == ["label", "0.0", "1.0", "2.0"]
    assert sum(sum(r[1:]) for r in matrix.collect()) == test.count()


def test_classifier_equals_mllib(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    data = [(i, " ".join(rng.choice(words[(i % 3) * 8:]) for _ in range(12)), "abc"[i % 3 if i % 7 else 0]) for i in range(300)]
    data += [(1000, "", "a"), (1001, "unknownword", "b"), (1002, None, "c")]
    df = spark.createDataFrame(data, "k int, t string, p string")
    train, test = K.hash_split(df, "k")
    mine = {r.k: r.prediction for r in K.fit_classifier(train, "t", "p", key="k").predict(test).collect()}
    texts = test.na.fill("", ["t"])
    theirs = {r.k: r.prediction for r in K.mllib_pipeline("t", "p").fit(train.na.fill("", ["t"])).transform(texts).collect()}
    assert len(mine) > 30 and mine == theirs


def test_classifier_with_features_from_all_rows(spark):
    data = labelled_texts(spark)
    train, test = K.random_split(data)
    fitted = K.fit_classifier(train, "t", "p", key="k", fit_features_on=data)
    assert K.accuracy_of(fitted.predict(test)) == 1.0


def test_classifier_with_more_terms_than_the_usual_vocabulary(spark):
    """Every term counts, however many there are: the telling ones are the rarest."""
    rows = spark.range(3000).select(
        F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("p"),
        F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("w"), (F.col("id") * 100 + i).cast("string"))),
                    F.concat(F.lit("mark"), (F.col("id") % 2).cast("string"))).alias("t"))
    fitted = K.fit_classifier(rows, "t", "p", key="k")
    assert fitted.weights.count() == 300_002 > 1 << 18
    new = spark.createDataFrame([(1, "mark1 w7 w7"), (2, "mark0 w299998")], "k long, t string").withColumn("p", F.lit(None).cast("string"))
    assert {r.k: r.predicted for r in fitted.predict(new).collect()} == {1: "even", 2: "odd"}


def test_stop_words_by_language():
    assert "the" in stop_words() and "para" in stop_words("spanish")


def test_custom_scorer(spark):
    from spotlake.operators.sentiment import custom_scores

    df = spark.createDataFrame([(1, "abcd"), (2, ""), (3, None)], "k int, t string")
    got = scores(custom_scores(df, ["k"], "t", lambda texts: texts.str.len() / 4.0))
    assert got[1] == 1.0 and got[2] == 0.0 and (got[3] is None or math.isnan(got[3]))


def rule_score(spark, text, phrases=None, lexicon=None):
    lexicon = lexicon or {"good": 1.9, "bad": -2.5}
    df = spark.createDataFrame([(1, text)], "k int, t string")
    words = spark.createDataFrame(list(lexicon.items()), "token string, valence double")
    return rule_scores(df, ["k"], "t", words, phrases=phrases).first()["compound"]


def normal(total):
    return round(total / (total * total + 15) ** 0.5, 4)


@pytest.mark.parametrize("text, total", [
    ("that was a kiss of death", -1.5),
    ("a KISS of Death, good", -1.5 + 1.9),
    ("it is kind of good", 1.9 - 0.293),
    ("just enough bad", -2.5 + 0.293),
    ("never so good", (1.9 + 0.293) * 1.5),
    ("never was this good", 1.9 * 1.25),
    ("never was good", 1.9 * -0.74),
    ("without any doubt good", 1.9),
    ("without any good", 1.9 * -0.74),
    ("least good", 1.9 * -0.74),
    ("at least good", 1.9),
    ("at the least good", 1.9 * -0.74),
    # An entry counts as one word: the negation is still within three words of the last one.
    ("not hand to mouth and good", -2.0 * -0.74 + 1.9 * -0.74),
    ("good but yeah right", 1.9 * 0.5 - 2.0 * 1.5),
    ("", 0.0),
])
def test_rules_of_several_words(spark, text, total):
    assert rule_score(spark, text, PhraseRules()) == pytest.approx(normal(total), abs=1e-4)


def test_phrases_are_longest_first_and_do_not_overlap():
    join = phrase_joiner(["a1 b1", "a1 b1 c1", "c1 d1", "b1 c1 d1", "x x1 y1", "solo", "e1 e1"])
    texts = {"a1 b1 c1 d1": "a1_b1_c1 d1", "A1 B1 d1": "A1_B1 d1", "z1 c1 d1 a1": "z1 c1_d1 a1", "x1 y1": "x1_y1", "e1 e1 e1": "e1_e1 e1",
             "solo": "solo", "": "", "a1": "a1"}
    got = join(pd.Series([t.split() for t in texts] + [None]))
    assert ["_".join("") if w is None else " ".join(w).replace(" ", "_") for w in got[:-1]] == list(texts.values()) and got.iloc[-1] is None
    rng = random.Random(1)
    phrases = [" ".join(rng.choice(["aa", "bb", "cc"]) for _ in range(rng.randrange(2, 5))) for _ in range(9)]
    known = {tuple(p.split()) for p in phrases}
    join = phrase_joiner(phrases)
    for _ in range(200):
        words = [rng.choice(["aa", "bb", "cc"]) for _ in range(rng.randrange(12))]
        expected, i = [], 0
        while i < len(words):
            n = max([n for n in range(1, 5) if tuple(words[i:i + n]) in known and i + n <= len(words)], default=1)
            expected.append(" ".join(words[i:i + n]))
            i += n
        assert list(join(pd.Series([words])).iloc[0]) == expected


def test_entries_replace_the_same_words_of_the_lexicon(spark):
    rules = PhraseRules(entries={"so so": -1.0, "good": 0.5})
    assert rule_score(spark, "so so", rules, {"so so": 2.0, "x1": 1.0}) == normal(-1.0)
    assert rule_score(spark, "good good", rules) == normal(1.0)
    assert rule_score(spark, "tip top", PhraseRules(), {"tip top": 2.0}) == normal(0.0)


def test_phrases_are_joined_in_slices(spark, monkeypatch):
    """Rows of a batch, long ones, empty ones and missing ones, come out as they do one by one."""
    rows = [["a1", "b1"] * 9, [], None, ["x"], ["b1", "a1", "b1", "a1"], ["a1"] * 30, None]
    join = phrase_joiner(["a1 b1"])
    arrays = pa.array(rows, pa.list_(pa.string())).slice(1)
    slices = S.word_slices(arrays, 5)
    assert [x for part in slices for x in part.to_pylist()] == rows[1:] and len(slices) >= 2
    assert all(len(part) == 1 or sum(len(x or ()) for x in part.to_pylist()) <= 5 for part in slices)
    monkeypatch.setattr(S, "WORDS_AT_ONCE", 5)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "k int, w array<string>").coalesce(1)
    got = {r.k: r.w for r in df.select("k", S.join_phrases(F.col("w"), ["a1 b1"]).alias("w")).collect()}
    assert got == dict(enumerate(join(pd.Series(rows, dtype=object))))
    assert S.word_slices(arrays.slice(0, 0), 5)
