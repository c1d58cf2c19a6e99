"""Personal data by weak supervision, in column expressions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The certain patterns. Quantifiers are possessive and starts are bound to the previous match or
# to the start of a run, which finds the same leftmost matches in one pass over any text.
LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9](?:[\x20().-]*+[0-9])++"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"
KINDS = ("email", "ip", "card", "phone")

# Wider patterns that propose candidates; the labelers and the model decide on them.
WIDE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?:\G|(?<![0-9.]))[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}+(?::[0-9]{1,5}+)?",
    "card": r"(?:\G|(?<![0-9]))[0-9]{4}+(?:[\x20.-]?[0-9]{4}){2,3}(?:[\x20.-]?[0-9]{1,7}+)?",
    "phone": r"(?:\+|\b00)?(?:\([0-9]{2,4}\)|\b[0-9]{2,4})[\x20./-]\(?[0-9]{2,4}\)?[\x20./-][0-9]{2,4}(?:[\x20./-][0-9]{2,4}){0,2}\b",
}
#: Cheap tests before a pattern is tried.
GATE: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: t.contains("@") | t.rlike(r"(?:\(|\[|\x20)at(?:\)|\]|\x20)"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20.-]?[0-9]){11}"),
    "phone": lambda t: t.rlike(r"[0-9]\)?[\x20().0-9/-]{6}"),
}
CONTEXT = {
    "email": r"(?i)mail|contact|write|reach|kontakt|courriel|correo",
    "ip": r"(?i)\bip\b|address|host|server|from|login|adresse|direcci",
    "card": r"(?i)card|visa|master|amex|account|payment|iban|karte|carte|tarjeta",
    "phone": r"(?i)tel|phone|call|fax|mobile|cell|whatsapp|anruf|appel|llam",
}
#: Known endings, networks, issuers and country codes: (what speaks for, what speaks against).
GAZETTEER = {
    "email": (r"(?i)(?:\.|dot\)?\]?\x20?)(?:com|org|net|edu|gov|io|info|de|fr|es|eu|uk|us|ch|at)$", r"(?i)\.(?:png|jpg|gif|js|css|html|py|exe|zip)$"),
    "ip": (r"^(?!0|127\.|255|22[4-9]|23[0-9]|24[0-9])[0-9]", r"^(?:0|127|255)\."),
    "card": (r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)", r"^(?:0|1|9)"),
    "phone": (r"^(?:\+|00)(?:1|33|34|49|44|41|43|39|31|32|351)|^\(?0", r"^(?:19|20)[0-9]{2}[\x20./-]"),
}
#: The shapes that a careful writer would use, and those that speak against.
SHAPE = {
    "email": (r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,10}$", r"\x20at\x20.*\x20(?!dot)"),
    "ip": (OCTETS, r"^(?:[0-9]\.){3}[0-9]$"),
    "card": (r"^[0-9]{4}(?:([\x20-]?)[0-9]{4})(?:\1[0-9]{4}){2}$", r"\."),
    "phone": (r"^(?:\+|00)[0-9]", r"^[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}$"),
}
VOTES = ("certain", "shape", "gazetteer", "before", "after")
CONTEXT_CHARS = 40
RUN = 64  # numbers of a block of a running sum
BLOCK = 1024  # characters of a block of the interval join
SPAN = "struct<kind:string,start:int,end:int>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression over a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def running_sum(numbers: Column) -> Column:
    """Sums of an array's first one, two, three, ... numbers.

    Arrays grow by copies, so the sums are made in blocks: their totals first, then each block from
    the total before it. The copies are RUN for each number, and one for each pair of blocks.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / RUN).cast("int")), lambda b: F.slice(numbers, b * RUN + 1, F.lit(RUN)))

    def scan(start: Column, some: Column) -> Column:
        first = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))
        return F.aggregate(some, first, step, lambda acc: acc["out"])

    def whole(parts: Column) -> Column:
        totals = scan(F.lit(0), F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda x, y: x + y)))
        return _let(totals, lambda ends: F.flatten(F.transform(parts, lambda part, i: scan(F.when(i == 0, 0).otherwise(F.get(ends, i - 1)), part))))

    return F.when(F.size(numbers) > 0, _let(blocks, whole)).otherwise(F.array().cast("array<int>"))


def found(text: Column, pattern: str) -> Column:
    """Array of (start, end, value, left, right) of the leftmost matches, in code points.

    What lies between the matches gives the places; ``left`` and ``right`` are up to
    CONTEXT_CHARS of the match before and what lies between, and the same behind.
    """

    def placed(m: Column) -> Column:
        values, gaps = m["values"], m["gaps"]
        ends = running_sum(F.transform(values, lambda v, i: F.length(F.get(gaps, i)) + F.length(v)))

        def match(end: Column, i: Column) -> Column:
            value = F.get(values, i)
            left = F.concat(F.coalesce(F.get(values, i - 1), F.lit("")), F.get(gaps, i))
            right = F.concat(F.get(gaps, i + 1), F.coalesce(F.get(values, i + 1), F.lit("")))
            return F.struct(
                (end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"),
                F.right(left, F.lit(CONTEXT_CHARS)).alias("left"), F.left(right, F.lit(CONTEXT_CHARS)).alias("right"),
            )

        return F.transform(ends, match)

    matched = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("gaps"))
    return _let(matched, placed)


def gated(test: Column, value: Column) -> Column:
    return F.when(test, value).otherwise(F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """The check digit of a card number."""
    digits = F.reverse(F.split(_digits(value), ""))
    each = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


#: What a match of a certain pattern must also be.
HOLDS: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(OCTETS),
    "card": lambda v: F.length(_digits(v)).between(16, 19) & luhn(v),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}
CERTAIN = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}


def certain_spans(text: Column) -> Column:
    """Array of (kind, start, end) of the certain patterns, by kind, then start."""
    gate = {"email": text.contains("@"), "ip": GATE["ip"](text), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": text.contains("+")}

    def of(kind: str) -> Column:
        good = F.filter(gated(gate[kind], found(text, CERTAIN[kind])), lambda m: HOLDS[kind](m["value"]))
        return F.transform(good, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    return F.concat(*(of(kind) for kind in KINDS))


def candidates(text: Column) -> Column:
    """Array of candidate spans with the votes (1 for, -1 against, 0 abstains) of all labelers but the certain patterns."""

    def vote(value: Column, pair: tuple[str, str]) -> Column:
        return F.when(value.rlike(pair[0]), 1).when(value.rlike(pair[1]), -1).otherwise(0)

    def of(kind: str) -> Column:
        def shape(value: Column) -> Column:
            formed = vote(value, SHAPE[kind])
            return F.when(luhn(value), formed).otherwise(-1) if kind == "card" else formed

        def judged(m: Column) -> Column:
            return F.struct(
                F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
                shape(m["value"]).alias("shape"),
                vote(m["value"], GAZETTEER[kind]).alias("gazetteer"),
                F.when(m["left"].rlike(CONTEXT[kind]), 1).otherwise(0).alias("before"),
                F.when(m["right"].rlike(CONTEXT[kind]), 1).when(m["right"].rlike(r"^[0-9A-Za-z]"), -1).otherwise(0).alias("after"),
                F.least(F.length(_digits(m["value"])), F.lit(20)).alias("digits"),
            )

        return F.transform(gated(GATE[kind](text), found(text, WIDE[kind])), judged)

    return F.concat(*(of(kind) for kind in KINDS))


def with_certain(scanned: DataFrame) -> DataFrame:
    """One row for each candidate with the vote of the certain patterns (``certain``) and whether any of their spans touches it (``taken``).

    An interval join by (row, block of BLOCK characters): a candidate meets the certain spans of
    the blocks it lies in, and no others, however many a text has.
    """
    blocks = lambda start, end: F.explode(F.sequence(F.floor(F.col(start) / BLOCK), F.floor((F.col(end) - 1) / BLOCK)))
    each = scanned.select("row", F.posexplode("candidates").alias("at", "c")).select("row", "at", "c.*")
    base = scanned.select("row", F.explode("base").alias("b")).select("row", F.col("b.kind").alias("b_kind"), F.col("b.start").alias("b_start"), F.col("b.end").alias("b_end"))
    met = each.withColumn("block", blocks("start", "end")).join(base.withColumn("block", blocks("b_start", "b_end")), ["row", "block"])
    own = met.where((F.col("b_start") < F.col("end")) & (F.col("b_end") > F.col("start"))).groupBy("row", "at").agg(F.bool_or(F.col("b_kind") == F.col("kind")).alias("same"))
    vote = F.when(F.col("same"), 1).when(F.col("same").isNotNull(), -1).otherwise(0)
    return each.join(own, ["row", "at"], "left").withColumns({"certain": vote, "taken": F.col("same").isNotNull()}).drop("at", "same")


def _patterns(each: DataFrame) -> list:
    """Counts of the different combinations of kind, votes and digits: bounded, whatever the input."""
    return each.groupBy("kind", *VOTES, "digits").count().collect()


class LabelModel:
    """Reliabilities of the labelers by expectation-maximisation, one prior per kind.

    Votes are independent given the truth. The first guess is the majority; counts of one are
    added, so a labeler that never speaks stays undecided.
    """

    def __init__(self, patterns: list, rounds: int = 50):
        self.posterior: dict[tuple, float] = {}
        rows = [(r["kind"], tuple(r[v] for v in VOTES), r["digits"], r["count"]) for r in patterns]
        truth = [0.9 if sum(votes) > 0 else 0.5 if sum(votes) == 0 else 0.1 for _, votes, _, _ in rows]
        for _ in range(rounds if rows else 0):
            prior: dict[str, list[float]] = {}
            seen: dict[tuple, list[float]] = {}
            for (kind, votes, _, n), p in zip(rows, truth):
                cell = prior.setdefault(kind, [1.0, 1.0])
                cell[0] += n * p
                cell[1] += n * (1 - p)
                for j, vote in enumerate(votes):
                    for key in ((kind, j, vote), (kind, j)):
                        cell = seen.setdefault(key, [1.0, 1.0] if len(key) == 3 else [3.0, 3.0])
                        cell[0] += n * p
                        cell[1] += n * (1 - p)
            moved = 0.0
            for i, (kind, votes, _, _) in enumerate(rows):
                z = math.log(prior[kind][0] / prior[kind][1])
                for j, vote in enumerate(votes):
                    some, every = seen[kind, j, vote], seen[kind, j]
                    z += math.log(some[0] / every[0]) - math.log(some[1] / every[1])
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
                # the certain pattern is never wrong by definition, so it keeps the classes' meaning
                p = max(p, 0.99) if votes[0] == 1 else p
                moved, truth[i] = max(moved, abs(p - truth[i])), p
            if moved < 1e-6:
                break
        self.rows = [(kind, votes, digits, n, p) for (kind, votes, digits, n), p in zip(rows, truth)]


def names_of_features() -> list[str]:
    return [f"{k}:{v}" for k in KINDS for v in ("bias", "shape", "gazetteer", "before", "after", "digits")]


def _features(kind: str, votes: tuple, digits: int) -> dict[str, float]:
    """The span classifier sees kind, shape, word lists, context and length, not the certain pattern."""
    return {f"{kind}:bias": 1.0, f"{kind}:shape": votes[1], f"{kind}:gazetteer": votes[2], f"{kind}:before": votes[3], f"{kind}:after": votes[4], f"{kind}:digits": digits / 10}


def train_classifier(model: LabelModel, rounds: int = 200, penalty: float = 1e-3) -> dict[str, float]:
    """Logistic regression of the estimated truth on the features, by gradient steps on counted combinations."""
    weights = dict.fromkeys(names_of_features(), 0.0)
    totals: dict[str, float] = {}
    for kind, _, _, n, _ in model.rows:
        totals[kind] = totals.get(kind, 0.0) + n
    for _ in range(rounds):
        grad = dict.fromkeys(weights, 0.0)
        for kind, votes, digits, n, p in model.rows:
            x = _features(kind, votes, digits)
            guess = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[k] * v for k, v in x.items())))))
            for k, v in x.items():
                grad[k] += n / totals[kind] * (guess - p) * v
        for k in weights:
            weights[k] -= 1.0 * (grad[k] + penalty * weights[k])
    return weights


def _accepts(weights: dict[str, float], c: Column) -> Column:
    """The classifier as an expression: positive where its probability is above a half."""
    z = F.lit(0.0)
    for kind in KINDS:
        w = {v: weights[f"{kind}:{v}"] for v in ("bias", "shape", "gazetteer", "before", "after", "digits")}
        own = F.lit(w["bias"]) + c["shape"] * w["shape"] + c["gazetteer"] * w["gazetteer"] + c["before"] * w["before"] + c["after"] * w["after"] + c["digits"] / 10 * w["digits"]
        z = F.when(c["kind"] == kind, own).otherwise(z)
    return z > 0


def personal_spans(documents: DataFrame) -> DataFrame:
    """``doc_id, base, spans``: certain spans, and these with the accepted candidates beside them.

    One scan makes spans and votes, which are small and written once to the shared folder;
    the counts of vote combinations train the two models; the accepted candidates join their rows' spans. Time
    grows with a text's length and its number of matches. A null text is empty; null ids, repeated rows and
    other columns change nothing; no rows give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = documents.select("doc_id", F.monotonically_increasing_id().alias("row"), certain_spans(text).alias("base"), candidates(text).alias("candidates")).checkpoint(eager=True)
    each = with_certain(scanned).checkpoint(eager=True)
    weights = train_classifier(LabelModel(_patterns(each)))
    new = each.where(~F.col("taken") & _accepts(weights, F.struct("kind", "shape", "gazetteer", "before", "after", "digits")))
    added = new.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    both = F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>")))
    rank = F.array(*(F.lit(k) for k in KINDS))
    ordered = F.array_sort(F.transform(both, lambda s: F.struct(F.array_position(rank, s["kind"]).alias("place"), s["start"], s["end"], s["kind"])))
    spans = F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return scanned.join(added, "row", "left").select("doc_id", "base", spans.alias("spans"))


def _text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ",")


def report(documents: DataFrame) -> DataFrame:
    """Counts of the certain spans, their digest and all spans."""
    spans = personal_spans(documents)
    count = lambda k: F.size(F.filter("base", lambda p: p["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select("doc_id", *(count(k) for k in KINDS), F.sha2(_text("base"), 256).alias("base_sha256"), _text("spans").alias("spans"))
