"""Personal data by weak supervision, in column expressions.

Candidates are all matches of the four base patterns (valid or not) and of two looser ones (a spelled-out e-mail address, a phone
number without country code).  Four labelers vote on each candidate: the strict pattern, a gazetteer (top-level domains,
country codes, issuer digits, reserved addresses), the words just before it, and the characters beside it.
Expectation-maximisation over the counts of vote patterns (at most a few hundred rows, the only thing that reaches the
driver) estimates how reliable each labeler is per kind; the posteriors then train a naive Bayes span classifier on
the candidate's features.  Valid base matches always stay; a looser candidate is added where the classifier says so and
no base span overlaps it.

Null text counts as empty and has no span.  Rows are independent, so repeated rows give repeated results; an empty
table gives an empty result.  Patterns loop without recursion, so long runs of digits or addresses are safe.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import id_and_text
from assayer.session import stored

KINDS = ("email", "ip", "card", "phone")
# Patterns as the contract fixes them, written so that they neither recurse nor start in the middle of a run.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",  # a run of fewer than 12 digits is no card wherever it starts
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?)[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+()./-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
# What the gazetteer and the context labeler know.
DOMAINS = ("at", "biz", "ch", "co", "com", "de", "edu", "es", "eu", "fr", "gov", "info", "io", "net", "org", "uk", "us")
COUNTRIES = ("1", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "86", "91")
CONTEXT = {
    "email": ("address", "contact", "correo", "email", "kontakt", "mail"),
    "ip": ("address", "adresse", "client", "from", "host", "ip", "server"),
    "card": ("card", "carte", "karte", "payment", "tarjeta", "visa"),
    "phone": ("call", "fax", "mobile", "phone", "tel", "telefon", "telefono"),
}
CONTEXT_CHARS = 32
#: Matches whose places are summed up in one go.
PLACE_BLOCK = 256
ROUNDS = 50
LABELERS = ("pattern", "gazetteer", "context", "beside")
FEATURES = ("gazetteer", "context", "before", "after", "digits")

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    digits = F.translate(match, "+ ().-", "")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15)


def _within(block: Column, n: Column) -> Column:
    return F.sequence(block * PLACE_BLOCK, F.least((block + 1) * PLACE_BLOCK, n) - 1)


def block_starts(matches: Column, between: Column) -> Column:
    """Where each block of matches begins in the text; ``between`` are the pieces of text around the matches."""
    n = F.size(matches)
    moved = lambda i: F.length(F.get(between, i)) + F.length(F.get(matches, i))
    sums = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / PLACE_BLOCK).cast("int")),
        lambda b: F.aggregate(_within(b, n), F.lit(0), lambda total, i: total + moved(i)),
    )
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(
        sums, first, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")), lambda s: s["starts"]
    )


def places(matches: Column, between: Column, starts: Column) -> Column:
    """Start and text of every match.  Work goes block by block, so it stays in proportion to the matches."""
    n = F.size(matches)

    def step(state: Column, i: Column) -> Column:
        at, found = state["at"] + F.length(F.get(between, i)), F.get(matches, i)
        span = F.struct(at.alias("start"), found.alias("found"))
        return F.struct((at + F.length(found)).alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def block(start: Column, b: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<struct<start:int,found:string>>").alias("spans"))
        return F.aggregate(_within(b, n), first, step, lambda s: s["spans"])

    return F.flatten(F.transform(starts, block))


def _member(value: Column, known: tuple[str, ...]) -> Column:
    return value.isin(*known)


def gazetteer_vote(kind: str, found: Column) -> Column:
    digits = F.translate(found, "+ ().-", "")
    if kind == "email":
        last = F.lower(F.regexp_extract(found, "([A-Za-z0-9-]+)$", 1))
        known = _member(last, DOMAINS)
    elif kind == "ip":
        known = ~found.rlike(r"^0*(?:0|255)\.")
    elif kind == "card":
        known = F.substring(digits, 1, 1).isin("3", "4", "5", "6")
    else:
        known = found.startswith("+") & (
            _member(F.substring(digits, 1, 1), COUNTRIES) | _member(F.substring(digits, 1, 2), COUNTRIES)
        ) | ~found.startswith("+") & ~F.substring(digits, 1, 1).isin("0", "1")
    return F.when(known, 1).otherwise(-1)


def context_vote(kind: str, before: Column) -> Column:
    words = F.split(F.lower(before), "[^a-z]+")
    return F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in CONTEXT[kind]])), 1).otherwise(0)


def char_class(c: Column) -> Column:
    return (
        F.when(c == "", "end").when(c.rlike("[0-9]"), "digit").when(c.rlike(r"\p{L}"), "letter").when(c.rlike(r"\s"), "space").otherwise("mark")
    )


def described(kind: str, spans: Column, text: Column, loose: bool) -> Column:
    """The votes and features of every span of one kind."""

    def one(span: Column) -> Column:
        found, start = span["found"], span["start"]
        end = start + F.length(found)
        first = F.greatest(F.lit(0), start - CONTEXT_CHARS)
        before = F.substring(text, first + 1, start - first)
        left = char_class(F.when(start == 0, "").otherwise(F.substring(text, start, F.lit(1))))
        right = char_class(F.substring(text, end + 1, F.lit(1)))
        ok = F.lit(False) if loose else valid(kind, found)
        gazetteer, context = gazetteer_vote(kind, found), context_vote(kind, before)
        beside = F.when(left.isin("digit", "letter") | right.isin("digit", "letter"), -1).otherwise(1)
        strict = F.lit(0) if loose else F.when(ok, 1).otherwise(-1)
        return F.struct(
            start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), ok.alias("base"), F.lit(loose).alias("loose"),
            F.array(strict, gazetteer, context, beside).alias("votes"),
            F.array(
                gazetteer.cast("string"), context.cast("string"), left, right,
                F.least(F.length(F.regexp_replace(found, "[^0-9]", "")), F.lit(20)).cast("string"),
            ).alias("features"),
        )

    return F.transform(spans, one)


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id`` and every candidate span with its votes and features."""
    text = F.col("text")
    could = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    loose_could = {"email": F.contains(text, F.lit("at]")) | F.contains(text, F.lit("at)"))}
    asked = [(k, p, False, could.get(k)) for k, p in PATTERNS.items()] + [(k, p, True, loose_could.get(k)) for k, p in LOOSE.items()]
    none = F.array().cast("array<string>")
    frame = id_and_text(docs)
    found = frame.select(
        "doc_id", "text",
        *[
            (F.regexp_extract_all(text, F.lit(p), F.lit(0)) if c is None else F.when(c, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none))
            .alias(f"m{i}") for i, (_, p, _, c) in enumerate(asked)
        ],
    )
    empty = "array<struct<start:int,found:string>>"
    n = range(len(asked))
    split = found.select("*", *[F.when(F.size(f"m{i}") > 0, F.split(text, asked[i][1], -1)).alias(f"p{i}") for i in n])
    begun = split.select("*", *[F.when(F.size(f"m{i}") > 0, block_starts(F.col(f"m{i}"), F.col(f"p{i}"))).alias(f"b{i}") for i in n])
    placed = begun.select(
        "doc_id", "text",
        *[
            F.when(F.size(f"m{i}") > 0, places(F.col(f"m{i}"), F.col(f"p{i}"), F.col(f"b{i}"))).otherwise(F.array().cast(empty)).alias(f"s{i}")
            for i in n
        ],
    )
    return placed.select("doc_id", F.concat(*[described(k, F.col(f"s{i}"), text, l) for i, (k, _, l, _) in enumerate(asked)]).alias("spans"))


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]]) -> dict[tuple[int, tuple[int, ...]], float]:
    """Expectation-maximisation on ``(kind, votes, count)``: the probability of personal data for each pattern."""
    out: dict[tuple[int, tuple[int, ...]], float] = {}
    for kind in sorted({k for k, _, _ in patterns}):
        rows = [(v, n) for k, v, n in patterns if k == kind]
        yes = [{1: 0.7, 0: 0.2, -1: 0.1} for _ in LABELERS]
        no = [{1: 0.1, 0: 0.2, -1: 0.7} for _ in LABELERS]
        prior = 0.5
        for _ in range(ROUNDS):
            said = []
            for votes, n in rows:
                a = math.log(prior) + sum(math.log(yes[j][v]) for j, v in enumerate(votes))
                b = math.log(1 - prior) + sum(math.log(no[j][v]) for j, v in enumerate(votes))
                said.append(1 / (1 + math.exp(max(-50.0, min(50.0, b - a)))))
            total = sum(n for _, n in rows)
            prior = min(0.999, max(0.001, (sum(p * n for p, (_, n) in zip(said, rows)) + 1) / (total + 2)))
            for table, weight in ((yes, said), (no, [1 - p for p in said])):
                whole = sum(w * n for w, (_, n) in zip(weight, rows))
                for j in range(len(LABELERS)):
                    for v in (1, 0, -1):
                        mass = sum(w * n for w, (votes, n) in zip(weight, rows) if votes[j] == v)
                        table[j][v] = (mass + 1) / (whole + 3)
        out |= {(kind, votes): p for (votes, _), p in zip(rows, said)}
    return out


def train(spans: DataFrame) -> dict[str, float]:
    """The weights of the naive Bayes classifier, keyed ``kind`` (prior) and ``kind|feature|value``."""
    one = spans.select(F.explode("spans").alias("s")).select(F.col("s.kind").alias("kind"), F.col("s.votes").alias("votes"), F.col("s.features").alias("features"))
    counted = one.groupBy("kind", "votes").count().collect()  # at most 4 x 81 rows
    known = reliabilities([(r["kind"], tuple(r["votes"]), r["count"]) for r in counted])
    if not known:
        return {}
    pattern = F.concat_ws("|", F.col("kind").cast("string"), F.transform("votes", lambda v: v.cast("string")))
    posterior = F.create_map(*[x for (k, v), p in known.items() for x in (F.lit("|".join(map(str, (k, *v)))), F.lit(p))])
    weighed = one.select("kind", F.element_at(posterior, pattern).alias("p"), F.posexplode("features").alias("feature", "value"))
    sums = weighed.groupBy("kind", "feature", "value").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    weights: dict[str, float] = {}
    for kind in sorted({r["kind"] for r in sums}):
        rows = [r for r in sums if r["kind"] == kind]
        yes, no = (sum(r[c] for r in rows if r["feature"] == 0) for c in ("yes", "no"))
        weights[str(kind)] = math.log((yes + 1) / (no + 1))
        for r in rows:
            weights[f"{kind}|{r['feature']}|{r['value']}"] = math.log((r["yes"] + 1) / (yes + 2)) - math.log((r["no"] + 1) / (no + 2))
    return weights


def of_kind(kind: int):
    return lambda s: s["kind"] == kind


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256`` and ``spans`` (all) for every row."""
    found = stored(candidates(docs), "pii-candidates")
    weights = train(found)
    table = F.create_map(*[x for k, w in sorted(weights.items()) for x in (F.lit(k), F.lit(w))]) if weights else F.create_map().cast("map<string,double>")

    def score(s: Column) -> Column:
        kind = s["kind"].cast("string")
        parts = F.transform(s["features"], lambda v, i: F.coalesce(F.element_at(table, F.concat_ws("|", kind, i.cast("string"), v)), F.lit(0.0)))
        return F.aggregate(parts, F.coalesce(F.element_at(table, kind), F.lit(0.0)), lambda a, b: a + b)

    names = F.array(*[F.lit(k) for k in KINDS])
    base = F.filter("spans", lambda s: s["base"])
    added = F.filter(
        "spans", lambda s: s["loose"] & (score(s) > 0) & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    )
    # by start, then kind, then end: the leading fields of the struct
    shown = lambda spans: F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))
    rows = found.select("doc_id", "spans", base.alias("base")).select("doc_id", "base", F.concat("base", added).alias("all"))
    return rows.select(
        "doc_id",
        *[F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("all")).alias("spans"),
    )
