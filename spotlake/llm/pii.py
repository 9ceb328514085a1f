"""Personal data by weak supervision.

Regular expressions give the base spans. Labelers then vote on every candidate,
base or looser: a format labeler (check digits, ranges), a gazetteer labeler
(domains, calling codes, issuers, countries) and a context labeler (cue words
in the characters before). Votes are -1, 0 (none) or 1. Expectation-maximisation
over the counts of vote patterns estimates how reliable each labeler is; its
soft labels train a final naive Bayes classifier on what a span looks like. The
candidates it accepts are added; base spans always stay.

Only DataFrame functions run on the data. The driver sees two count tables,
whose sizes are fixed by the numbers of kinds, labelers and feature values.

Nulls and edge cases: a null text is empty and has no spans; the digest of no
spans is that of the empty string. Rows that share an id are rows of their own.
An empty table gives an empty result. Extra columns are ignored. Positions count
code points. No pattern rescans the characters of a long run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from spotlake.llm.common import row_number_column, text_of
from spotlake.sources.scratch import materialise

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# A run is entered at its start, or where the last match ended, so that failing runs are read once.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Looser candidates, which only the classifier can accept.
    "masked": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++\x20?[(\[{{](?:at|AT|@)[)\]}}]\x20?{_LABEL}++(?:(?:\.|\x20?[(\[{{](?:dot|DOT|\.)[)\]}}]\x20?){_LABEL}++)++",
    "national": r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]{4}){3,7}+(?![A-Za-z0-9])",
}
KINDS = list(PATTERNS)
BASE = KINDS[:4]
# A text without this has no match, which a plain search finds out sooner.
_HINT = {"email": "@", "ip": ".", "phone": "+", "ssn": "-", "masked": None, "card": None, "national": None, "iban": None}
_BEFORE = 40
ACCEPT = 0.9
ROUNDS = 30

# Public top-level domains, calling codes, card issuer prefixes and IBAN countries the gazetteer knows.
TOP_DOMAINS = ["com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "it", "eu", "us", "ca", "mx"]
CALLING_CODES = r"^\+(?:1|7|20|27|30|31|32|33|34|36|39|4[0-9]|5[1-8]|6[0-6]|81|82|84|86|9[0-58])"
CARD_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6)"
IBAN_COUNTRIES = r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"
# Cue words before personal data, and before numbers that are none.
CUES = r"(?i)(?:e-?mail|mail|contact|phone|tel|call|fax|mobile|card|credit|visa|iban|account|ssn|social|address|host|server|correo|tel[eé]fono|tarjeta|courriel|t[eé]l|carte|telefon|karte|konto|adresse)[^A-Za-z]{0,8}$"
COUNTER_CUES = r"(?i)(?:version|section|page|figure|table|isbn|issn|doi|serial|build|release|token|key|order|invoice)[^A-Za-z]{0,8}$"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit fits."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d < 5, 2 * d).otherwise(2 * d - 9)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def valid_base(kind: Column, span: Column) -> Column:
    """Whether a match of a base pattern passes the check of its kind."""
    digits = _digits(span)
    small = F.forall(F.split(span, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (
        F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255))
    return F.when(kind == "email", True).when(kind == "ip", small).when(
        kind == "card", F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    ).when(kind == "phone", F.length(digits).between(10, 15)).otherwise(False)


def _votes(kind: Column, span: Column, before: Column, valid: Column) -> list[Column]:
    """The three labelers' votes on a candidate."""
    digits = _digits(span)
    form = (F.when(kind.isin(BASE), F.when(valid, 1).otherwise(-1))
            .when(kind == "ssn", F.when(digits.rlike("^(?:000|666|9)") | digits.rlike("0000$"), -1).otherwise(1))
            .when(kind == "national", F.when(digits.rlike("^[01]"), -1).otherwise(1)).otherwise(1))
    domain = F.lower(F.regexp_extract(span, r"([A-Za-z0-9-]+)$", 1))
    listed = (F.when(kind.isin("email", "masked"), F.when(domain.isin(TOP_DOMAINS), 1).otherwise(0))
              .when(kind == "phone", F.when(span.rlike(CALLING_CODES), 1).otherwise(-1))
              .when(kind == "card", F.when(digits.rlike(CARD_ISSUERS), 1).otherwise(0))
              .when(kind == "ip", F.when(span.rlike(r"^(?:0|127|255)\."), -1).otherwise(0))
              .when(kind == "iban", F.when(span.rlike(IBAN_COUNTRIES), 1).otherwise(-1)).otherwise(0))
    context = F.when(before.rlike(CUES), 1).when(before.rlike(COUNTER_CUES), -1).otherwise(0)
    return [form.cast("int").alias("form"), listed.cast("int").alias("listed"), context.cast("int").alias("context")]


def matches(docs: DataFrame, id_col: str, text_col: str, row_col: str | None) -> DataFrame:
    """One row per document: `row`, `id`, and its matches as (kind, place, gap before, last characters of it, span)."""
    texts = docs.select(row_number_column(row_col).alias("row"), F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    none = F.array().cast("array<string>")
    for kind in KINDS:
        hint = _HINT[kind]
        found = F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))
        if hint is None:
            may = F.col("text").rlike({"masked": r"[(\[{](?:at|AT|@)[)\]}]", "iban": "[A-Z]{2}[0-9]{2}"}.get(kind, "[0-9]"))
        else:
            may = F.contains("text", F.lit(hint))
        texts = texts.withColumn(kind, F.when(may, found).otherwise(none))
    parts = []
    for k, kind in enumerate(KINDS):
        number = F.lit(k)
        gaps = F.transform(F.split("text", PATTERNS[kind], -1), lambda g, i: F.struct(
            i.alias("place"), F.length(g).alias("gap"), F.right(g, F.lit(_BEFORE)).alias("before")))
        parts.append(F.when(F.size(kind) > 0, F.zip_with(gaps, kind, lambda g, m: F.struct(
            number.alias("kind"), g["place"].alias("place"), g["gap"].alias("gap"), g["before"].alias("before"), m.alias("span")))))
    every = F.flatten(F.array_compact(F.array(*parts)))
    # The gap after the last match has no span.
    return texts.select("row", "id", F.filter(every, lambda m: m["span"].isNotNull()).alias("found"))


def candidates(found: DataFrame) -> DataFrame:
    """One row per candidate span with its place, validity and votes; loose ones that touch a base span are left out."""
    flat = found.where(F.size("found") > 0).select("row", F.explode("found").alias("m")).select("row", "m.*")
    ends = F.sum(F.col("gap") + F.length("span")).over(Window.partitionBy("row", "kind").orderBy("place"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    placed = flat.withColumns({"end": ends.cast("long"), "name": kind}).withColumns({
        "start": F.col("end") - F.length("span"), "valid": valid_base(F.col("name"), F.col("span"))})
    base_end = F.max(F.when(F.col("valid"), F.col("end")))
    base_start = F.min(F.when(F.col("valid"), F.col("start")))
    order = Window.partitionBy("row").orderBy("start", "kind")
    placed = placed.withColumns({
        "left": base_end.over(order.rowsBetween(Window.unboundedPreceding, -1)),
        "right": base_start.over(order.rowsBetween(1, Window.unboundedFollowing))})
    free = ~(F.coalesce(F.col("left") > F.col("start"), F.lit(False)) | F.coalesce(F.col("right") < F.col("end"), F.lit(False)))
    votes = _votes(F.col("name"), F.col("span"), F.col("before"), F.col("valid"))
    return placed.where(F.col("valid") | free).select(
        "row", "kind", "name", "start", "end", "valid", *votes,
        F.least(F.lit(7), F.floor(F.length("span") / 4)).cast("int").alias("f_length"),
        F.floor(4 * F.length(_digits(F.col("span"))) / F.length("span")).cast("int").alias("f_digits"),
        F.when(F.col("before") == "", 0).when(F.col("before").rlike(r"\s$"), 1).when(F.col("before").rlike(r"[A-Za-z0-9]$"), 2)
        .otherwise(3).alias("f_before"),
        F.when(F.col("before").rlike(CUES), 1).otherwise(0).alias("f_cue"),
        F.when(F.col("valid"), 1).otherwise(0).alias("f_valid"))


LABELERS = ["form", "listed", "context"]
FEATURES = ["kind", "f_length", "f_digits", "f_before", "f_cue", "f_valid"]


def reliabilities(patterns: list[Row], rounds: int = ROUNDS) -> tuple[float, dict[str, dict[int, tuple[float, float]]]]:
    """Prior, and for each labeler and vote its chances for personal and other spans, from counts of vote patterns."""
    prior = 0.5
    # To begin with, every labeler is taken to be right four times in five.
    chance = {name: {1: (0.6, 0.15), 0: (0.25, 0.25), -1: (0.15, 0.6)} for name in LABELERS}
    for _ in range(rounds):
        soft = [posterior(p, prior, chance) for p in patterns]
        yes = sum(s * p["count"] for s, p in zip(soft, patterns))
        total = sum(p["count"] for p in patterns)
        if not total:
            break
        prior = (yes + 1) / (total + 2)
        for name in LABELERS:
            sums = {v: [1.0, 1.0] for v in (-1, 0, 1)}
            for s, p in zip(soft, patterns):
                sums[p[name]][0] += s * p["count"]
                sums[p[name]][1] += (1 - s) * p["count"]
            chance[name] = {v: (a / (yes + 3), b / (total - yes + 3)) for v, (a, b) in sums.items()}
    return prior, chance


def posterior(votes, prior: float, chance) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(chance[n][votes[n]][0] / chance[n][votes[n]][1]) for n in LABELERS)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def _log_odds(prior: float, chance) -> Column:
    """Log odds of a candidate given its votes."""
    total = F.lit(math.log(prior / (1 - prior)))
    for name in LABELERS:
        ratio = {v: math.log(a / b) for v, (a, b) in chance[name].items()}
        total = total + F.when(F.col(name) == 1, ratio[1]).when(F.col(name) == -1, ratio[-1]).otherwise(ratio[0])
    return total


def span_scores(spans: DataFrame) -> DataFrame:
    """Candidates with `score`, the classifier's probability that they are personal data."""
    patterns = spans.groupBy(*LABELERS).count().collect()  # 27 rows at most
    prior, chance = reliabilities(patterns)
    soft = 1 / (1 + F.exp(-_log_odds(prior, chance)))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("int").alias("value")) for f in FEATURES)))
    counts = spans.select(soft.alias("soft"), each.alias("f")).groupBy("f.feature", "f.value").agg(
        F.sum("soft").alias("yes"), F.sum(1 - F.col("soft")).alias("no")).collect()  # one row per feature value
    odds = F.lit(math.log(prior / (1 - prior)))
    for feature in FEATURES:
        rows = [c for c in counts if c["feature"] == feature]
        yes, no = sum(c["yes"] for c in rows) + len(rows), sum(c["no"] for c in rows) + len(rows)
        term = F.lit(0.0)
        for c in rows:
            term = F.when(F.col(feature) == c["value"], math.log((c["yes"] + 1) / yes) - math.log((c["no"] + 1) / no)).otherwise(term)
        odds = odds + term
    return spans.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), odds)))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT,
                  row_col: str | None = None) -> DataFrame:
    """Every document with its spans of personal data.

    Returns `row`, `doc_id`, `n_email`, `n_ip`, `n_card`, `n_phone`,
    `base_sha256`, `spans` (text), `span_list` (kind, start, end).
    """
    found = materialise(matches(docs, id_col, text_col, row_col), "matches")
    spans = materialise(candidates(found), "candidates")
    scored = span_scores(spans).where(F.col("valid") | (F.col("score") >= accept))
    span = F.struct("start", "kind", "end", "name")
    per_row = scored.groupBy("row").agg(
        *(F.count_if(F.col("valid") & (F.col("name") == k)).alias(f"n_{k}") for k in BASE),
        F.collect_list(F.when(F.col("valid"), span)).alias("base"), F.collect_list(span).alias("all"))
    nothing = F.lit(0).cast("long")
    return found.select("row", "id").join(per_row, "row", "left").select(
        "row", F.col("id").alias("doc_id"), *(F.coalesce(f"n_{k}", nothing).alias(f"n_{k}") for k in BASE),
        F.sha2(F.coalesce(_joined(F.col("base")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(_joined(F.col("all")), F.lit("")).alias("spans"), F.array_sort("all").alias("span_list"))
