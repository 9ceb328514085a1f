"""Lexicon sentiment, after Hutto and Gilbert, "VADER: a parsimonious rule-based
model for sentiment analysis of social media text", ICWSM 2014.

Tokens are looked up in a lexicon table by a join. Only tokens with a valence
and one closing row per text go on, and their sum is taken per text before the
shuffle, so a text costs one small shuffled row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlake.functions.text import word_tokens
from spotlake.operators.columns import quoted
from spotlake.operators.sizing import over_all_cores
from spotlake.shipping import ship
from spotlake.sources.scratch import materialise

ship(__name__)

# Fixed values of the published model.
NORMAL_ALPHA = 15.0
BOOST = 0.293
CAPS_BOOST = 0.733
NEGATION = -0.74
DAMPING = (1.0, 0.95, 0.9)
BEFORE_BUT = 0.5
AFTER_BUT = 1.5
EXCLAMATION = 0.292
QUESTION = 0.18
QUESTIONS_MANY = 0.96

# Fixed values, the one-word entries of the published model: words that strengthen the next word.
STRENGTHEN = [
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly", "deeply", "enormously",
    "entirely", "especially", "exceptionally", "extremely", "fabulously", "flipping", "fully", "greatly", "hella",
    "highly", "hugely", "incredibly", "intensely", "majorly", "more", "most", "particularly", "purely", "quite",
    "really", "remarkably", "so", "substantially", "thoroughly", "totally", "tremendously", "uber", "unbelievably",
    "unusually", "utterly", "very",
]

# Fixed values of the published model: words that weaken the next word.
WEAKEN = [
    "almost", "barely", "hardly", "kinda", "less", "little", "marginally", "occasionally", "partly", "scarcely",
    "slightly", "somewhat", "sorta",
]

# Fixed values of the published model: words that negate one of the next three words.
NEGATE = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "ain't", "aren't", "can't",
    "couldn't", "daren't", "didn't", "doesn't", "dont", "hadnt", "hasnt", "havent", "isnt", "mightnt", "mustnt",
    "neither", "don't", "hadn't", "hasn't", "haven't", "isn't", "mightn't", "mustn't", "neednt", "needn't", "never",
    "none", "nope", "nor", "not", "nothing", "nowhere", "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent",
    "oughtn't", "shan't", "shouldn't", "uh-uh", "wasn't", "weren't", "without", "wont", "wouldnt", "won't",
    "wouldn't", "rarely", "seldom", "despite",
]

# Fixed values of the published model: entries of several words, and words that weaken the next one.
IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "yeah right": -2.0, "cut the mustard": 2.0, "kiss of death": -1.5,
    "hand to mouth": -2.0,
}
WEAKEN_PHRASES = ["just enough", "kind of", "sort of"]
NEVER_SO = {2: 1.5, 3: 1.25}

# A small sample in the valence scale of the published lexicon (-4 to 4), for trials and
# tests. For real work read the full lexicon with `sources.readers.read_lexicon`.
SAMPLE_LEXICON = {
    "good": 1.9, "great": 3.1, "best": 3.2, "better": 1.9, "happy": 2.7, "love": 3.2, "win": 2.8, "hope": 1.9,
    "safe": 1.9, "peace": 2.5, "trust": 2.3, "strong": 2.3, "support": 1.7, "thanks": 1.9, "free": 2.3,
    "bad": -2.5, "worst": -3.1, "worse": -2.1, "sad": -2.1, "hate": -2.7, "lose": -1.7, "fear": -2.2,
    "danger": -2.4, "war": -2.9, "lie": -1.6, "weak": -1.9, "violence": -3.1, "corrupt": -3.1, "poor": -2.1,
}


def sample_lexicon(spark) -> DataFrame:
    return spark.createDataFrame(list(SAMPLE_LEXICON.items()), "token string, valence double")


def _written(lexicon: DataFrame) -> DataFrame:
    """The lexicon as a file, whose real size Spark plans by: a small one is broadcast and never shuffles the words."""
    return materialise(lexicon.select("token", "valence"), "lexicon")


def _compound(total: Column) -> Column:
    score = total / F.sqrt(total * total + NORMAL_ALPHA)
    return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)), 4)


def valence_scores(df: DataFrame, keys: list[str], text: str, lexicon: DataFrame) -> DataFrame:
    """(keys, compound): normalised sum of the valences of the words of each text.

    `keys` identify a text. A NULL text scores NULL, one without lexicon words 0.
    """
    words = over_all_cores(df.select(*[quoted(k) for k in keys], quoted(text)), keys).select(
        *[quoted(k) for k in keys], quoted(text).isNotNull().alias("_has"),
        F.explode_outer(F.array_append(word_tokens(quoted(text)), F.lit(None).cast("string"))).alias("token"))
    hits = words.join(_written(lexicon), "token", "left").where(F.col("valence").isNotNull() | F.col("token").isNull())
    sums = hits.groupBy(*[quoted(k) for k in keys]).agg(
        F.coalesce(F.sum("valence"), F.lit(0.0)).alias("_s"), F.max("_has").alias("_has"))
    return sums.select(*[quoted(k) for k in keys], F.when(F.col("_has"), _compound(F.col("_s"))).alias("compound"))


def custom_scores(
    df: DataFrame, keys: list[str], text: str, scorer: Callable[[pd.Series], pd.Series], name: str = "compound"
) -> DataFrame:
    """(keys, score) from a function over batches of texts, for scorers that are not a lexicon.

    The function gets the texts of an Arrow batch as one series and builds what it
    needs once per batch; NULL texts reach it as None.
    """
    score = F.pandas_udf(scorer, "double")
    rows = over_all_cores(df.select(*[quoted(k) for k in keys], quoted(text)), keys)
    return rows.select(*[quoted(k) for k in keys], score(quoted(text)).alias(name))


_PUNCTUATION = r"!\"#$%&'()*+,\-./:;<=>?@\[\]\\^_`{|}~"
# Fixed values of the published model: punctuation groups stripped from one end of a word.
_STRIPPED = r"(?:[.!?,;:\-'\"]|!{2,3}|\?{2,3}|(?:\?!)?\?!\?|(?:!\?)?!\?!|\?!\?!|!\?!\?)"


# A whole blank-separated token that is a word with one punctuation group at its front or its end.
_MARKED_WORD = rf"(?<!\S)(?:{_STRIPPED}([^{_PUNCTUATION}\s]{{2,}})|([^{_PUNCTUATION}\s]{{2,}}){_STRIPPED})(?!\S)"
# A token of two characters or more with an upper-case letter and no lower-case one.
_UPPER_WORD = r"(?<!\S)(?=\S*\p{Lu})[^\p{Ll}\s]{2,}(?!\S)"
_TOKEN = r"\S{2,}"


def _is_upper(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def _occurrences(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _emphasis(text: Column) -> Column:
    bangs = F.least(_occurrences(text, "!"), F.lit(4)) * EXCLAMATION
    asks = _occurrences(text, "?")
    return bangs + F.when(asks > 3, F.lit(QUESTIONS_MANY)).when(asks > 1, asks * QUESTION).otherwise(F.lit(0.0))


def _any(words: list[Column], test: Callable[[Column], Column]) -> Column:
    """Whether one of the words passes; a missing word does not."""
    return F.coalesce(*[F.when(test(w), F.lit(True)) for w in words], F.lit(False))


def _negates(word: Column, negators: list[str]) -> Column:
    return word.isin(negators) | word.contains("n't")


@dataclass(frozen=True)
class PhraseRules:
    """What the model reads in several words.

    `entries` score as one word of their own; `strengthen` and `weaken` act like one
    word. Then the rules of word pairs and triples: `never` before one of `so` is no
    negation but an emphasis; `without` before `doubt` is no negation; `least`
    negates unless a word of `at` is ahead of it.
    """

    entries: dict[str, float] = field(default_factory=lambda: dict(IDIOMS))
    strengthen: list[str] = field(default_factory=list)
    weaken: list[str] = field(default_factory=lambda: list(WEAKEN_PHRASES))
    never: str = "never"
    so: tuple[str, ...] = ("so", "this")
    without: str = "without"
    doubt: str = "doubt"
    least: str = "least"
    at: tuple[str, ...] = ("at", "very")

    def phrases(self) -> list[str]:
        return [*self.entries, *self.strengthen, *self.weaken]


# Words of a phrase that was found are joined by this, which is no blank to the patterns below.
JOINT = "\u00a0"


def as_token(phrase: str) -> str:
    """A phrase as the one word it becomes; words of one character are not read in texts either."""
    return JOINT.join(w for w in phrase.lower().split() if len(w) > 1)


def phrase_joiner(phrases: list[str]) -> Callable[[pd.Series], pd.Series]:
    """A function that joins the words of each array that make up a phrase.

    Phrases are indexed by first word and length. From left to right the longest
    phrase that starts at a word is taken, and reading goes on after it, so a text
    costs the same however many phrases there are.
    """
    index: dict[str, dict[int, set[str]]] = {}
    for phrase in phrases:
        words = as_token(phrase).split(JOINT)
        if len(words) > 1:
            index.setdefault(words[0], {}).setdefault(len(words), set()).add(JOINT.join(words))
    lengths = {first: sorted(found, reverse=True) for first, found in index.items()}

    def join(words):
        if words is None:
            return None
        low = [w.lower() for w in words]
        if index.keys().isdisjoint(low):
            return words
        out, i = [], 0
        while i < len(low):
            n = next((n for n in lengths.get(low[i], ()) if JOINT.join(low[i:i + n]) in index[low[i]][n]), 1)
            out.append(JOINT.join(words[i:i + n]))
            i += n
        return out

    return lambda series: series.map(join)


# Words that are Python objects at one time.
WORDS_AT_ONCE = 50_000


def word_slices(arrays: pa.Array, most: int) -> list[pa.Array]:
    """An array of word lists cut into slices of `most` words at most; a longer list is a slice of its own."""
    sizes = np.nan_to_num(pc.list_value_length(arrays).to_numpy(zero_copy_only=False))
    bounds, held = [0], 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            bounds.append(i)
            held = 0
        held += n
    return [arrays.slice(a, b - a) for a, b in zip(bounds, [*bounds[1:], len(arrays)])]


def join_phrases(words: Column, phrases: list[str]) -> Column:
    """An array of words with the words of each phrase joined to one.

    A batch stays in Arrow; only the words of a slice of it are Python objects.
    """
    join, kind = phrase_joiner(phrases), pa.list_(pa.string())

    @F.arrow_udf("array<string>")
    def joined(arrays: pa.Array) -> pa.Array:
        return pa.concat_arrays([
            pa.array(join(pd.Series(part.to_pylist(), dtype=object)).tolist(), kind) for part in word_slices(arrays, WORDS_AT_ONCE)])

    return joined(words)


def rule_scores(
    df: DataFrame, keys: list[str], text: str, lexicon: DataFrame,
    strengthen: list[str] | None = None, weaken: list[str] | None = None, negate: list[str] | None = None,
    phrases: PhraseRules | None = None,
) -> DataFrame:
    """(keys, compound): rule-based sentiment of each text, from -1 to 1.

    Covers intensity words, negation within three words, capitals, the contrast
    word "but" and repeated marks. With `phrases` also entries of several words and
    the rules for "least", "never so" and "without doubt"; a phrase counts as one
    word in all rules, and its words do not score by themselves. Word lists are parameters.
    `keys` identify a text; a NULL text scores NULL.
    """
    up, down, no = strengthen or STRENGTHEN, weaken or WEAKEN, negate or NEGATE
    ids = [quoted(k) for k in keys]
    raw = quoted(text)
    none = F.lit(None).cast("string")
    if phrases:
        up, down = [*up, *map(as_token, phrases.strengthen)], [*down, *map(as_token, phrases.weaken)]
        entries = df.sparkSession.createDataFrame([(as_token(p), float(v)) for p, v in phrases.entries.items()], "token string, valence double")
        # An entry of several words replaces one of the same words in the lexicon.
        lexicon = lexicon.withColumn("token", F.replace("token", F.lit(" "), F.lit(JOINT))).join(entries, "token", "left_anti").select(
            "token", "valence").unionByName(entries)
    lexicon = _written(lexicon)

    # The text-wide steps are single native passes; only the word array is exploded.
    bare = over_all_cores(df.select(*ids, raw.alias("_raw")), keys).select(
        *ids, F.col("_raw").isNotNull().alias("_has"), _emphasis(F.col("_raw")).alias("_mark"),
        F.regexp_replace("_raw", _MARKED_WORD, "$1$2").alias("_text"))
    words = bare.select(
        *ids, "_has", "_mark", F.regexp_extract_all("_text", F.lit(_TOKEN), F.lit(0)).alias("_words"),
        F.array_position(F.regexp_extract_all(F.lower("_text"), F.lit(_TOKEN), F.lit(0)), "but").alias("_but"),
        F.regexp_count("_text", F.lit(_UPPER_WORD)).alias("_caps"))
    mixed = (F.col("_caps") > 0) & (F.col("_caps") < F.size("_words"))
    if phrases:
        # Capitals are judged on the single words, places of words on the joined ones.
        words = words.withColumn("_caps", F.when(mixed, 1).otherwise(0)).withColumn("_words", join_phrases(F.col("_words"), phrases.phrases()))
        words = words.withColumn("_but", F.array_position(F.transform("_words", F.lower), "but"))
        mixed = F.col("_caps") > 0
    # Shifting the array by one, two and three places puts each word next to those before it;
    # the rows past the end have no word and keep texts without hits.
    shifted = F.arrays_zip(
        F.col("_words").alias("w"),
        F.concat(F.array(none), "_words").alias("p1"),
        F.concat(F.array(none, none), "_words").alias("p2"),
        F.concat(F.array(none, none, none), "_words").alias("p3"),
    )
    rows = words.select(*ids, "_has", "_mark", "_but", mixed.alias("_mixed"),
                        F.posexplode_outer(shifted).alias("_pos", "_t")).select(
        *ids, "_has", "_mark", "_but", "_mixed", "_pos", F.lower("_t.w").alias("token"),
        *[F.col(f"_t.{c}").alias(c) for c in ("w", "p1", "p2", "p3")])

    # Words that act on their neighbour carry no valence of their own.
    acting = F.col("token").isin([*up, *down])
    hits = rows.join(lexicon, "token", "left").where(
        F.col("token").isNull() | (F.col("valence").isNotNull() & ~acting))
    for i in (1, 2, 3):
        listed = lexicon.select(F.col("token").alias(f"_l{i}"), F.lit(True).alias(f"_in{i}"))
        hits = hits.join(listed, F.lower(f"p{i}") == F.col(f"_l{i}"), "left").drop(f"_l{i}")

    v = F.col("valence")
    v = v + F.when(_is_upper(F.col("w")) & F.col("_mixed"), F.signum(v) * CAPS_BOOST).otherwise(F.lit(0.0))
    for i, damping in zip((1, 2, 3), DAMPING):
        before, low = F.col(f"p{i}"), F.lower(f"p{i}")
        acts = before.isNotNull() & F.col(f"_in{i}").isNull()
        step = F.when(low.isin(up), F.lit(BOOST)).when(low.isin(down), F.lit(-BOOST))
        shout = F.when(_is_upper(before) & F.col("_mixed"), F.lit(CAPS_BOOST)).otherwise(F.lit(0.0))
        # Capitals of an intensity word push away from zero, whichever way the word itself acts.
        v = v + F.when(acts & step.isNotNull(), (step + shout) * F.signum(v) * damping).otherwise(F.lit(0.0))
        flip = F.when(acts & _negates(low, no), F.lit(NEGATION))
        if phrases and i > 1:
            between = [F.lower(f"p{j}") for j in range(1, i)]
            emphasis = acts & (low == phrases.never) & _any(between, lambda c: c.isin(*phrases.so))
            certain = acts & (low == phrases.without) & _any(between, lambda c: c == phrases.doubt)
            flip = F.when(emphasis, F.lit(NEVER_SO[i])).when(certain, F.lit(1.0)).when(acts & _negates(low, no), F.lit(NEGATION))
        v = v * flip.otherwise(F.lit(1.0))
    if phrases:
        least = F.col("_in1").isNull() & (F.lower("p1") == phrases.least) & ~F.coalesce(F.lower("p2").isin(*phrases.at), F.lit(False))
        v = v * F.when(least, F.lit(NEGATION)).otherwise(F.lit(1.0))
    place = F.col("_pos") + 1
    v = v * F.when((F.col("_but") > 0) & (place < F.col("_but")), F.lit(BEFORE_BUT)).when(
        (F.col("_but") > 0) & (place > F.col("_but")), F.lit(AFTER_BUT)).otherwise(F.lit(1.0))

    sums = hits.groupBy(*ids).agg(
        F.coalesce(F.sum(v), F.lit(0.0)).alias("_s"), F.max("_mark").alias("_mark"), F.max("_has").alias("_has"))
    total = F.col("_s") + F.signum("_s") * F.col("_mark")
    return sums.select(*ids, F.when(F.col("_has"), _compound(total)).alias("compound"))
