"""Catalogue flattening, tokens, TF-IDF, sentiment, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.reports import BOX_COLUMNS, rounded
from checks.tables import ENGLISH_STOP_WORDS, sql_list, table
from spotlake.functions.text import is_content_word, stop_words, word_tokens
from spotlake.operators.aggregates import accuracy, top_words, word_frequencies
from spotlake.operators.features import document_frequencies, hashed_features, term_counts, tfidf, top_terms
from spotlake.operators.heavy import frequent_words
from spotlake.operators.nested import flatten_catalogue
from spotlake.operators.sentiment import PhraseRules, custom_scores, rule_scores, valence_scores
from spotlake.plans import catalogue as P
from spotlake.plans import classify as K
from spotlake.plans import reports as R
from spotlake.sources.readers import read_catalogue, read_catalogue_array
from spotlake.sources.scratch import materialise, scratch_path

_STOP = sql_list(ENGLISH_STOP_WORDS)


def catalogue_lines(spark, d, own_folios=True):
    """One catalogue document per text: its lines as parties, their sentences as spots; one more entry per source.

    Without `own_folios` all texts share their folios.
    """
    owner = F.col("doc_id").cast("string") if own_folios else F.lit("x")

    def folio(n, i, j):
        return F.struct(
            F.concat(F.lit("http://host/a/"), owner, F.lit("/"), i.cast("string"), F.lit("_"),
                     j.cast("string"), F.lit(".mp4")).alias("folio"),
            (F.length(n) % 2 == 0).alias("cautelar"),
            F.concat(F.lit("T"), F.col("doc_id").cast("string"), F.lit("-"), i.cast("string"), F.lit("-"),
                     j.cast("string")).alias("titulo"))

    def party(line, i):
        sentences = F.split(line, r"\. ")
        return F.struct(
            F.concat(F.lit("P"), i.cast("string")).alias("actor_politico"), sentences.alias("version"),
            F.transform(sentences, lambda s, j: folio(s, i, j)).alias("folio"))

    by_line = F.create_map(F.concat_ws("_", "lang", "source"), F.transform(F.split("text", "\n"), party))
    by_source = F.create_map(
        F.concat(F.lit("autoridad_"), "lang"),
        F.array(F.struct(F.col("source").alias("actor_politico"), F.array("lang").alias("version"),
                         F.array(folio(F.col("lang"), F.lit(-1), F.lit(0))).alias("folio"))))
    return table(spark, d, "documents").select("doc_id", F.to_json(F.array(by_line, by_source)).alias("value"))


@query("flatten_nested", r"""
    WITH l AS (
        SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
            unnest(range(len(string_split(text, chr(10))))) AS i
        FROM documents WHERE lang <> 'de'
    ),
    s AS (
        SELECT doc_id, 0 AS entry_pos, i AS party_pos, lang || '_' || source AS key, 'P' || i AS partido, source AS medio,
            unnest(string_split(line, '. ')) AS nombre, unnest(range(len(string_split(line, '. ')))) AS j
        FROM l
        UNION ALL
        SELECT doc_id, 1, 0, 'autoridad_' || lang, source, lang, lang, 0 FROM documents
    )
    SELECT CAST(entry_pos AS INTEGER) AS entry_pos, CAST(party_pos AS INTEGER) AS party_pos, CAST(j AS INTEGER) AS spot_pos,
        key, partido, nombre, medio || '/' || partido AS directorio,
        'http://host/a/' || doc_id || '/' || CASE WHEN entry_pos = 1 THEN -1 ELSE party_pos END || '_' || j || '.mp4' AS folio,
        length(nombre) % 2 = 0 AS cautelar,
        medio || '/' || partido || '/' || CASE WHEN entry_pos = 1 THEN -1 ELSE party_pos END || '_' || j || '.mp4' AS target
    FROM s""")
def _flatten(spark, d):
    path = scratch_path(spark, "catalogue")
    catalogue_lines(spark, d).select("value").write.text(path)
    flat = P.work_list(read_catalogue(spark, path, whole_files=False), ignored_actors=["de"])
    return P.with_download_paths(flat).select(
        "entry_pos", "party_pos", "spot_pos", "key", "partido", "nombre", "directorio", "folio", "cautelar", "target")


@query("flatten_large_array", r"""
    WITH l AS (
        SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
            unnest(range(len(string_split(text, chr(10))))) AS i
        FROM documents
    )
    SELECT CAST(i AS INTEGER) AS party_pos, CAST(j AS INTEGER) AS spot_pos, lang || '_' || source AS key, 'P' || i AS partido, nombre,
        'http://host/a/' || doc_id || '/' || i || '_' || j || '.mp4' AS folio, length(nombre) % 2 = 0 AS cautelar
    FROM (SELECT *, unnest(string_split(line, '. ')) AS nombre, unnest(range(len(string_split(line, '. ')))) AS j FROM l)
    UNION ALL
    SELECT 0, 0, 'autoridad_' || lang, source, lang, 'http://host/a/' || doc_id || '/-1_0.mp4', length(lang) % 2 = 0 FROM documents""")
def _large_array(spark, d):
    """The catalogue as files of one array on one line each, cut into its entries by many tasks."""
    path = scratch_path(spark, "catalogue")

    def one_array(batches):
        import pandas as pd

        mark = "["
        for batch in batches:
            if len(batch):
                # Without the brackets of the row's own array.
                rows = batch["value"].str.slice(1, -1)
                yield pd.DataFrame({"value": [mark + rows.iloc[0], *("," + rows.iloc[1:])]})
                mark = ","
        yield pd.DataFrame({"value": ["]" if mark == "," else "[]"]})

    catalogue_lines(spark, d).select("value").mapInPandas(one_array, "value string").write.option("lineSep", " ").text(path)
    return flatten_catalogue(read_catalogue_array(spark, path)).select(
        "party_pos", "spot_pos", "key", F.col("actor_politico").alias("partido"), F.col("version").alias("nombre"), "folio", "cautelar")


@query("order_index", r"""
    WITH l AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
        FROM documents
    ),
    s AS (SELECT doc_id, i, unnest(string_split(line, '. ')) AS v, unnest(range(len(string_split(line, '. ')))) AS j FROM l)
    SELECT 'http://host/a/x/' || i || '_' || j || '.mp4' AS folio, arg_max(length(v) % 2 = 0, doc_id) AS cautelar FROM s GROUP BY i, j
    UNION ALL SELECT 'http://host/a/x/-1_0.mp4', arg_max(length(lang) % 2 = 0, doc_id) FROM documents""")
def _order_index(spark, d):
    """All texts share their folios: the last text, by file and line, decides."""
    path = scratch_path(spark, "catalogue")
    catalogue_lines(spark, d, own_folios=False).orderBy("doc_id").select("value").write.text(path)
    return P.order_index(flatten_catalogue(read_catalogue(spark, path, whole_files=False)))


@query("catalogue_records", r"""
    WITH l AS (
        SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
            unnest(range(len(string_split(text, chr(10))))) AS i
        FROM documents
    ),
    s AS (
        SELECT doc_id, source || '/P' || i AS directorio, 'P' || i AS partido, 'T' || doc_id || '-' || i || '-' AS t,
            unnest(string_split(line, '. ')) AS nombre, unnest(range(len(string_split(line, '. ')))) AS j
        FROM l
        UNION ALL SELECT doc_id, lang || '/' || source, source, 'T' || doc_id || '--1-', lang, 0 FROM documents
    )
    SELECT t || j AS titulo, directorio, partido, nombre, 't: ' || nombre AS transcripcion FROM s""")
def _records(spark, d):
    """Catalogue spots with their transcripts; every title has one."""
    path = scratch_path(spark, "catalogue")
    catalogue_lines(spark, d).select("value").write.text(path)
    flat = P.work_list(read_catalogue(spark, path, whole_files=False))
    transcripts = materialise(flat.select("titulo", F.concat(F.lit("t: "), "nombre").alias("transcripcion")), "transcripts")
    return P.with_transcripts(flat, transcripts).select("titulo", "directorio", "partido", "nombre", "transcripcion")


_TOKENS = r"list_filter(string_split_regex(lower(text), '\W+'), lambda x: x <> '')"


@query("token_counts", f"""
    SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS n_tokens,
        CAST(len(list_filter({_TOKENS}, lambda x: x NOT IN ({_STOP}))) AS BIGINT) AS n_content FROM documents""")
def _tokens(spark, d):
    words = table(spark, d, "documents").select("doc_id", word_tokens("text").alias("w"))
    out = stop_words()
    return words.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"),
                        F.size(F.filter("w", lambda x: is_content_word(x, out))).cast("bigint").alias("n_content"))


_WORDS_SQL = f"""
    w AS (
        SELECT word, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS word FROM (SELECT DISTINCT text FROM documents))
        WHERE word NOT IN ({_STOP}) GROUP BY word
    )"""


@query("word_frequencies", f"WITH {_WORDS_SQL} SELECT word, n FROM w")
def _words(spark, d):
    return word_frequencies(table(spark, d, "documents"), "text", stop_words())


@query("top_words", f"WITH {_WORDS_SQL} SELECT word, n FROM w ORDER BY n DESC, word LIMIT 50")
def _top_words(spark, d):
    return top_words(word_frequencies(table(spark, d, "documents"), "text", stop_words()), 50)


@query("heavy_hitters", f"WITH {_WORDS_SQL} SELECT word, n FROM w ORDER BY n DESC, word LIMIT 50")
def _heavy_hitters(spark, d):
    """The rows of top_words from summaries and an exact count of the candidates."""
    return frequent_words(table(spark, d, "documents"), "text", 50, stop_words())


_TF_SQL = f"""
    tf AS (
        SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents)
        WHERE term NOT IN ({_STOP}) GROUP BY doc_id, term
    ),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""


@query("document_frequencies", f"WITH {_TF_SQL} SELECT term, df FROM df")
def _df(spark, d):
    return document_frequencies(term_counts(table(spark, d, "documents"), "doc_id", "text", stop_words()))


_TERM_BUCKET = "CAST(CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 4096 AS INTEGER)"


@query("hashed_features", f"""
    WITH {_TF_SQL},
    h AS (SELECT doc_id, {_TERM_BUCKET} AS bucket, sum(CASE WHEN substr(md5(term), 9, 1) < '8' THEN tf ELSE -tf END) AS value FROM tf GROUP BY ALL)
    SELECT doc_id, bucket, CAST(value AS BIGINT) AS value FROM h WHERE value <> 0""")
def _hashed(spark, d):
    return hashed_features(term_counts(table(spark, d, "documents"), "doc_id", "text", stop_words()), "doc_id", 4096)


@query("tfidf_top_terms", f"""
    WITH {_TF_SQL},
    s AS (
        SELECT doc_id, tf.term, tf, df, round(tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)), 6) AS tfidf
        FROM tf JOIN df ON tf.term = df.term
    ),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term) AS INTEGER) AS rank FROM s)
    SELECT doc_id, term, tf, df, tfidf, rank FROM r WHERE rank <= 5""")
def _tfidf(spark, d):
    scores = tfidf(table(spark, d, "documents"), "doc_id", "text", stop_words())
    return top_terms(scores.withColumn("tfidf", F.round("tfidf", 6)), "doc_id", 5)


# Words that occur in the given texts, with valences that add up without rounding.
LEXICON = {
    "the": 0.5, "hand": 1.5, "thing": -1.5, "une": 1.0, "pas": -2.0, "avec": 0.5, "und": 0.5, "die": -1.0,
    "ist": 2.0, "del": -0.5, "los": 1.5, "con": -2.5, "that": -0.5, "was": 1.0,
}
STRENGTHEN = ["is", "est", "sehr", "muy", "most"]
WEAKEN = ["a", "un", "ein"]
NEGATE = ["not", "of", "nicht", "no", "ne"]

_LEX_SQL = "lex(token, valence) AS (VALUES " + ", ".join(
    f"('{t}', CAST({v} AS DOUBLE))" for t, v in LEXICON.items()) + ")"

_VALENCE_SQL = f"""
    {_LEX_SQL},
    tok AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents),
    hit AS (SELECT doc_id, sum(valence) AS s FROM tok JOIN lex ON tok.token = lex.token GROUP BY doc_id),
    score AS (
        SELECT d.doc_id, d.lang, round(coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15), 4) AS compound
        FROM documents d LEFT JOIN hit ON d.doc_id = hit.doc_id
    )"""


def lexicon(spark):
    return spark.createDataFrame(list(LEXICON.items()), "token string, valence double")


@query("lexicon_sentiment", f"WITH {_VALENCE_SQL} SELECT doc_id, lang, compound FROM score")
def _valence(spark, d):
    return valence_scores(table(spark, d, "documents"), ["doc_id", "lang"], "text", lexicon(spark))


@query("custom_scorer", "SELECT doc_id, round(length(text) / (length(text) + 100.0::DOUBLE), 6) AS compound FROM documents")
def _custom(spark, d):
    def saturating_length(texts):
        n = texts.str.len()
        return (n / (n + 100.0)).round(6)

    return custom_scores(table(spark, d, "documents"), ["doc_id"], "text", saturating_length)


@query("sentiment_per_airing", f"""
    WITH {_VALENCE_SQL} SELECT score.lang AS partido, compound FROM labels JOIN score ON labels.doc_id = score.doc_id""")
def _per_airing(spark, d):
    docs = table(spark, d, "documents")
    a = R.Airings(table(spark, d, "labels"), docs.select(F.col("doc_id").alias("titulo"), F.col("lang").alias("partido")), "doc_id")
    scores = valence_scores(docs, ["doc_id"], "text", lexicon(spark)).withColumnRenamed("doc_id", "titulo")
    return R.weighted_scores(a, scores, "compound")


@query("sentiment_histogram", f"""
    WITH {_VALENCE_SQL}, b AS (SELECT min(compound) AS lo, max(compound) AS hi FROM score),
    f AS (SELECT least(CAST(floor((compound - lo) / ((hi - lo) / 20)) AS INTEGER), 19) AS bin, count(*) AS n FROM score, b GROUP BY 1)
    SELECT CAST(r.bin AS INTEGER) AS bin, round(lo + r.bin * ((hi - lo) / 20), 6) AS lower,
        round(lo + (r.bin + 1) * ((hi - lo) / 20), 6) AS upper, coalesce(f.n, 0) AS n
    FROM range(20) AS r(bin) LEFT JOIN f ON r.bin = f.bin, b""")
def _score_histogram(spark, d):
    scores = materialise(valence_scores(table(spark, d, "documents"), ["doc_id"], "text", lexicon(spark)), "scores")
    return R.score_histogram(scores, "compound").withColumns({"lower": F.round("lower", 6), "upper": F.round("upper", 6)})


@query("sentiment_boxplot", f"""
    WITH {_VALENCE_SQL}, v AS (SELECT lang, compound AS x FROM score WHERE lang IN ('en', 'fr', 'es')),
    q AS (SELECT lang, count(*) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
            quantile_cont(x, 0.75) AS q3 FROM v GROUP BY lang),
    f AS (SELECT v.lang, x, q1, q3, x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
          FROM v JOIN q ON v.lang = q.lang),
    w AS (SELECT lang, least(min(x) FILTER (WHERE inside), any_value(q1)) AS lo,
            greatest(max(x) FILTER (WHERE inside), any_value(q3)) AS hi,
            count(*) FILTER (WHERE NOT inside) AS n_outliers FROM f GROUP BY lang)
    SELECT q.lang, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
        round(lo, 6) AS whisker_low, round(hi, 6) AS whisker_high, n_outliers
    FROM q JOIN w ON q.lang = w.lang""")
def _score_box(spark, d):
    scores = materialise(valence_scores(table(spark, d, "documents"), ["doc_id", "lang"], "text", lexicon(spark)), "scores")
    return rounded(R.score_box_plot(scores, "lang", "compound", ["en", "fr", "es"]), BOX_COLUMNS)


_PUNCT = r"!\"#$%&''()*+,\-./:;<=>?@\[\]\\^_`{|}~"
_ENDS = r"(?:[.!?,;:\-''\"]|!{2,3}|\?{2,3}|(?:\?!)?\?!\?|(?:!\?)?!\?!|\?!\?!|!\?!\?)"
_AHEAD = f"regexp_extract(t, '^{_ENDS}([^{_PUNCT}]{{2,}})$', 1)"
_BEHIND = f"regexp_extract(t, '^([^{_PUNCT}]{{2,}}){_ENDS}$', 1)"


def _upper_sql(w: str) -> str:
    return f"({w} = upper({w}) AND {w} <> lower({w}))"


def _step_sql(i: int, damping: float) -> tuple[str, str]:
    p = f"p{i}"
    acts = f"{p} IS NOT NULL AND lower({p}) NOT IN (SELECT token FROM lex)"
    shout = f"CASE WHEN {_upper_sql(p)} AND mixed THEN 0.733::DOUBLE ELSE 0 END"
    add = (f"CASE WHEN {acts} AND lower({p}) IN ({sql_list(STRENGTHEN)}) THEN (0.293::DOUBLE + {shout}) * sign(v) * {damping}::DOUBLE "
           f"WHEN {acts} AND lower({p}) IN ({sql_list(WEAKEN)}) THEN (-0.293::DOUBLE + {shout}) * sign(v) * {damping}::DOUBLE ELSE 0 END")
    flip = (f"CASE WHEN {acts} AND (lower({p}) IN ({sql_list(NEGATE)}) OR contains(lower({p}), 'n''t')) "
            f"THEN -0.74::DOUBLE ELSE 1 END")
    return add, flip


_STEPS = []
_PREVIOUS = "v0"
for _i, _damping in ((1, 1.0), (2, 0.95), (3, 0.9)):
    _add, _flip = _step_sql(_i, _damping)
    _STEPS.append(f"v{_i} AS (SELECT * EXCLUDE (v), (v + {_add}) * {_flip} AS v FROM {_PREVIOUS})")
    _PREVIOUS = f"v{_i}"

_RULE_SQL = f"""
    WITH {_LEX_SQL},
    word AS (
        SELECT doc_id, text, list_transform(regexp_extract_all(text, '\\S{{2,}}'), lambda t:
            CASE WHEN {_AHEAD} <> '' THEN {_AHEAD} WHEN {_BEHIND} <> '' THEN {_BEHIND} ELSE t END) AS ws
        FROM documents
    ),
    doc AS (
        SELECT doc_id, ws, coalesce(list_position(list_transform(ws, lambda x: lower(x)), 'but'), 0) AS but,
            len(list_filter(ws, lambda x: {_upper_sql('x')})) BETWEEN 1 AND len(ws) - 1 AS mixed,
            least(length(text) - length(replace(text, '!', '')), 4) * 0.292::DOUBLE +
            CASE WHEN length(text) - length(replace(text, '?', '')) > 3 THEN 0.96::DOUBLE
                 WHEN length(text) - length(replace(text, '?', '')) > 1
                 THEN (length(text) - length(replace(text, '?', ''))) * 0.18::DOUBLE ELSE 0 END AS mark
        FROM word
    ),
    pos AS (
        SELECT doc_id, but, mixed, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i,
            unnest(list_concat([NULL], ws)[1:len(ws)]) AS p1,
            unnest(list_concat([NULL, NULL], ws)[1:len(ws)]) AS p2,
            unnest(list_concat([NULL, NULL, NULL], ws)[1:len(ws)]) AS p3
        FROM doc
    ),
    v0 AS (
        SELECT pos.*, valence + CASE WHEN {_upper_sql('w')} AND mixed THEN sign(valence) * 0.733::DOUBLE ELSE 0 END AS v
        FROM pos JOIN lex ON lower(w) = token WHERE lower(w) NOT IN ({sql_list(STRENGTHEN + WEAKEN)})
    ),
    {', '.join(_STEPS)},
    total AS (
        SELECT doc_id, sum(v * CASE WHEN but > 0 AND i < but THEN 0.5::DOUBLE WHEN but > 0 AND i > but THEN 1.5::DOUBLE ELSE 1 END) AS s
        FROM v3 GROUP BY doc_id
    ),
    marked AS (
        SELECT doc.doc_id, coalesce(s, 0) + sign(coalesce(s, 0)) * mark AS s FROM doc LEFT JOIN total ON doc.doc_id = total.doc_id
    )
    SELECT doc_id, round(s / sqrt(s * s + 15), 4) AS compound FROM marked"""


@query("rule_sentiment", _RULE_SQL)
def _rules(spark, d):
    return rule_scores(table(spark, d, "documents"), ["doc_id"], "text", lexicon(spark), STRENGTHEN, WEAKEN, NEGATE)


# Frequent words of the texts in the roles of the model's phrases.
PHRASES = PhraseRules(
    entries={"of the": 1.7, "the of": -1.2, "and the of": 2.4, "it is": -0.9, "de la": 1.1, "der die": -2.1, "is on the": 0.8},
    strengthen=["was the", "que el"], weaken=["on the", "et le"], never="of", so=("and", "die", "y"), without="not", doubt="was",
    least="at", at=("by", "for"))


def _phrase_list(phrases) -> str:
    return sql_list([p.replace(" ", chr(160)) for p in phrases])


def _phrase_step(i: int, damping: float) -> str:
    p, between = f"p{i}", [f"lower(p{j})" for j in range(1, i)]
    acts = f"{p} IS NOT NULL AND lower({p}) NOT IN (SELECT token FROM every)"
    shout = f"CASE WHEN {_upper_sql(p)} AND mixed THEN 0.733::DOUBLE ELSE 0 END"
    add = " ".join(
        f"WHEN {acts} AND lower({p}) IN ({sql_list(words)}, {_phrase_list(more)}) THEN ({boost}::DOUBLE + {shout}) * sign(v) * {damping}::DOUBLE"
        for words, more, boost in ((STRENGTHEN, PHRASES.strengthen, 0.293), (WEAKEN, PHRASES.weaken, -0.293)))
    pairs = ""
    if between:
        so = " OR ".join(f"coalesce({b} IN ({sql_list(list(PHRASES.so))}), false)" for b in between)
        doubt = " OR ".join(f"coalesce({b} = '{PHRASES.doubt}', false)" for b in between)
        pairs = (f"WHEN {acts} AND lower({p}) = '{PHRASES.never}' AND ({so}) THEN {1.5 if i == 2 else 1.25}::DOUBLE "
                 f"WHEN {acts} AND lower({p}) = '{PHRASES.without}' AND ({doubt}) THEN 1 ")
    flip = f"CASE {pairs}WHEN {acts} AND (lower({p}) IN ({sql_list(NEGATE)}) OR contains(lower({p}), 'n''t')) THEN -0.74::DOUBLE ELSE 1 END"
    return f"s{i} AS (SELECT * EXCLUDE (v), (v + CASE {add} ELSE 0 END) * {flip} AS v FROM s{i - 1})"


_ENTRIES = ", ".join(f"('{p.replace(' ', chr(160))}', {v}::DOUBLE)" for p, v in PHRASES.entries.items())
_TWO = "lower(w) || chr(160) || lower(lead(w, 1) OVER t)"

# The words of the plain model, then the longest phrase at each word; of these, from left to right, those that begin after the one before.
_PHRASE_SQL = f"""
    WITH RECURSIVE {_RULE_SQL.split('WITH', 1)[1].split('    pos AS (', 1)[0]}
    every(token, valence) AS (SELECT token, valence FROM lex UNION ALL VALUES {_ENTRIES}),
    known(phrase) AS (SELECT unnest([{_phrase_list(PHRASES.phrases())}])),
    single AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM doc),
    runs AS MATERIALIZED (
        SELECT doc_id, i, {_TWO} AS two, {_TWO} || chr(160) || lower(lead(w, 2) OVER t) AS three
        FROM single WINDOW t AS (PARTITION BY doc_id ORDER BY i)
    ),
    hit AS MATERIALIZED (
        SELECT doc_id, i AS s, i + max(n) AS e
        FROM (SELECT doc_id, i, 2 AS n FROM runs WHERE two IN (FROM known) UNION ALL SELECT doc_id, i, 3 FROM runs WHERE three IN (FROM known))
        GROUP BY doc_id, i
    ),
    following AS MATERIALIZED (
        SELECT a.doc_id, a.s, a.e, b.s AS next FROM hit a ASOF LEFT JOIN hit b ON a.doc_id = b.doc_id AND a.e <= b.s
    ),
    taken(doc_id, s, e, next) AS (
        SELECT doc_id, min(s), arg_min(e, s), arg_min(coalesce(next, -1), s) FROM following GROUP BY doc_id
        UNION ALL
        SELECT f.doc_id, f.s, f.e, coalesce(f.next, -1) FROM taken t JOIN following f ON t.doc_id = f.doc_id AND t.next = f.s
    ),
    owner AS (
        SELECT x.doc_id, x.i, x.w, CASE WHEN x.i < t.e THEN t.s ELSE x.i END AS s
        FROM single x ASOF LEFT JOIN taken t ON x.doc_id = t.doc_id AND x.i >= t.s
    ),
    joined AS (SELECT doc_id, s, string_agg(w, chr(160) ORDER BY i) AS w FROM owner GROUP BY doc_id, s),
    numbered AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS i FROM joined),
    butted AS (SELECT doc_id, min(i) AS but FROM numbered WHERE lower(w) = 'but' GROUP BY doc_id),
    pos AS (
        SELECT n.doc_id, w, i, coalesce(b.but, 0) AS but, mixed, lag(w, 1) OVER t AS p1, lag(w, 2) OVER t AS p2, lag(w, 3) OVER t AS p3
        FROM numbered n JOIN doc ON n.doc_id = doc.doc_id LEFT JOIN butted b ON n.doc_id = b.doc_id
        WINDOW t AS (PARTITION BY n.doc_id ORDER BY i)
    ),
    s0 AS (
        SELECT pos.*, valence + CASE WHEN {_upper_sql('w')} AND mixed THEN sign(valence) * 0.733::DOUBLE ELSE 0 END AS v
        FROM pos JOIN every ON lower(w) = token
        WHERE lower(w) NOT IN ({sql_list(STRENGTHEN + WEAKEN)}, {_phrase_list(PHRASES.strengthen + PHRASES.weaken)})
    ),
    {', '.join(_phrase_step(_i, _damping) for _i, _damping in ((1, 1.0), (2, 0.95), (3, 0.9)))},
    total AS (
        SELECT doc_id, sum(v * CASE WHEN but > 0 AND i < but THEN 0.5::DOUBLE WHEN but > 0 AND i > but THEN 1.5::DOUBLE ELSE 1 END
            * CASE WHEN lower(p1) = '{PHRASES.least}' AND lower(p1) NOT IN (SELECT token FROM every)
                AND NOT coalesce(lower(p2) IN ({sql_list(list(PHRASES.at))}), false) THEN -0.74::DOUBLE ELSE 1 END) AS s
        FROM s3 GROUP BY doc_id
    ),
    marked AS (
        SELECT doc.doc_id, coalesce(s, 0) + sign(coalesce(s, 0)) * mark AS s FROM doc LEFT JOIN total ON doc.doc_id = total.doc_id
    )
    SELECT doc_id, round(s / sqrt(s * s + 15), 4) AS compound FROM marked"""


@query("rule_sentiment_phrases", _PHRASE_SQL)
def _phrase_rules(spark, d):
    return rule_scores(table(spark, d, "documents"), ["doc_id"], "text", lexicon(spark), STRENGTHEN, WEAKEN, NEGATE, PHRASES)


_BUCKET = "CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS INTEGER)"


@query("hash_split", f"SELECT doc_id, {_BUCKET} < 80 AS training FROM documents")
def _split(spark, d):
    return table(spark, d, "documents").select("doc_id", K.in_training("doc_id").alias("training"))


@query("exact_split", """
    SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR))) <= floor(0.8 * (SELECT count(*) FROM documents)) AS training FROM documents""")
def _exact_split(spark, d):
    train, test = K.exact_split(table(spark, d, "documents").select("doc_id"), "doc_id")
    return train.withColumn("training", F.lit(True)).unionByName(test.withColumn("training", F.lit(False)))


_BAYES_SQL = f"""
    d AS (SELECT doc_id, lang, {_BUCKET} < 80 AS train FROM documents),
    tf AS (
        SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents)
        WHERE term NOT IN ({_STOP}) GROUP BY doc_id, term
    ),
    vocab AS (
        SELECT term, ln(((SELECT count(*) FROM d WHERE train) + 1) / (count(*) + 1)) AS idf
        FROM tf JOIN d ON tf.doc_id = d.doc_id WHERE train GROUP BY term
    ),
    x AS (
        SELECT d.doc_id, d.lang, d.train, tf.term, tf * idf AS x
        FROM tf JOIN vocab ON tf.term = vocab.term JOIN d ON tf.doc_id = d.doc_id
    ),
    cls AS (
        SELECT d.lang AS c, ln(count(*) + 1) - ln((SELECT count(*) FROM d WHERE train) +
            (SELECT count(DISTINCT lang) FROM d WHERE train)) AS pi
        FROM d WHERE train GROUP BY d.lang
    ),
    mass AS (SELECT lang AS c, sum(x) + (SELECT count(*) FROM vocab) AS m FROM x WHERE train GROUP BY lang),
    weight AS (SELECT lang AS c, term, ln(sum(x) + 1) AS lw FROM x WHERE train GROUP BY lang, term),
    part AS (
        SELECT x.doc_id, cls.c, sum(x.x * (coalesce(w.lw, 0) - ln(m.m))) AS s
        FROM x CROSS JOIN cls JOIN mass m ON m.c = cls.c LEFT JOIN weight w ON w.c = cls.c AND w.term = x.term
        WHERE NOT x.train GROUP BY x.doc_id, cls.c
    ),
    scored AS (
        SELECT d.doc_id, d.lang, cls.c, cls.pi + coalesce(part.s, 0) AS s
        FROM d CROSS JOIN cls LEFT JOIN part ON part.doc_id = d.doc_id AND part.c = cls.c WHERE NOT d.train
    ),
    pred AS (SELECT doc_id, any_value(lang) AS lang, arg_max(c, s) AS predicted FROM scored GROUP BY doc_id)"""


def predictions(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    train, test = K.hash_split(docs, "doc_id")
    fitted = K.fit_classifier(train, "text", "lang", key="doc_id")
    return fitted, fitted.predict(test)


@query("nb_classify", f"WITH {_BAYES_SQL} SELECT doc_id, lang, predicted FROM pred")
def _bayes(spark, d):
    return predictions(spark, d)[1].select("doc_id", "lang", "predicted")


@query("nb_accuracy", f"""
    WITH {_BAYES_SQL} SELECT round(avg(CASE WHEN lang = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pred""")
def _accuracy(spark, d):
    return accuracy(predictions(spark, d)[1], "lang", "predicted").withColumn("accuracy", F.round("accuracy", 6))


@query("confusion_matrix", f"""
    WITH {_BAYES_SQL},
    idx AS (SELECT lang, row_number() OVER (ORDER BY count(*) DESC, lang) - 1 AS i FROM d WHERE train GROUP BY lang)
    SELECT CAST(a.i AS DOUBLE) AS label, """ + ", ".join(
        f'count(*) FILTER (WHERE p.i = {i}) AS "{i}.0"' for i in range(4)) + """
    FROM pred JOIN idx a ON pred.lang = a.lang JOIN idx p ON pred.predicted = p.lang GROUP BY a.i""")
def _confusion(spark, d):
    fitted, rows = predictions(spark, d)
    return K.confusion_of(rows, fitted)
