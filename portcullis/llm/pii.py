"""Personal data in texts: patterns, and further spans chosen by a classifier that learns from labelers' votes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portcullis.llm.common import let, once, saved

KINDS = ["email", "ip", "card", "phone"]
#: Kinds without a base pattern follow: their spans are chosen by the classifier alone.
ALL_KINDS = [*KINDS, "secret"]

# Base patterns. Possessive repeats and the looks back keep the search linear; the matches are those of the plain
# patterns: a run of the first class is tried from its first character (or the end of the match before) only.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Wider patterns of each kind, which only give candidates. They are written so that no base match overlaps the part of
# a wider match before it: a wider match ends where no character of a base match follows.
_WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]++)++(?![A-Za-z0-9._%+@-])",
    "ip": r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:.])",
    "card": r"(?<![0-9.])[0-9]{4}(?:[./][0-9]{4}){3}(?![0-9./]|[\x20-][0-9])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9().+-]| [0-9])",
}
#: Any long value of letters and digits is a candidate for a secret; the labelers tell it from names and check sums.
_SECRET = r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9=.@][A-Za-z0-9])"
_BASE = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}
#: The wider alternative comes first where it may begin with what a base pattern matches.
_PATTERN = {k: (f"(?:{_WIDE[k]})|{_BASE[k]}" if k == "card" else f"{_BASE[k]}|(?:{_WIDE[k]})") for k in KINDS} | {"secret": _SECRET}
#: Texts without this have no match of the kind.
_NEEDED = {
    "email": lambda t: F.contains(t, F.lit("@")) | t.rlike(r"\([aA][tT]\)|\[[aA][tT]\]"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]|:[0-9A-Fa-f]{1,4}:"),
    "card": lambda t: t.rlike(r"[0-9][\x20./-]?[0-9][\x20./-]?[0-9]"),
    "phone": lambda t: t.rlike(r"\+[0-9]|[0-9]{3}\)? ?[ .-]?[0-9]{3}[ .-][0-9]{4}"),
    "secret": lambda t: t.rlike(r"[0-9][A-Za-z+/_-]|[A-Za-z+/_-][0-9]"),
}
#: The usual form of each kind, without the checks of the base patterns. Fixed values.
FORM = {
    "email": r"^[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$|[(\[]at[)\]]",
    "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$|:",
    "card": r"^(?:[0-9]{4}([ ./-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}|3[0-9]{3}([ -]?)[0-9]{6}\2[0-9]{4,5})$",
    "phone": r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}$|^\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}$",
    "secret": r"^(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})$|^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}$",
}

#: Words that name a kind of data. Fixed values.
CONTEXT_WORDS = {"email": "mail|contact|write|address", "ip": r"\bip\b|host|server|addr|login", "card": "card|visa|credit|pay|account|iban", "phone": "phone|call|tel|mobile|fax|whatsapp", "secret": r"(?:token|secret|passwor[dt]|passwd|pwd|key|bearer|credentials?)[\"']? ?[:= ] ?[\"']?$"}
#: Gazetteer: last labels of mail hosts, first digits of card issuers, reserved blocks of addresses, country codes, heads of keys. Fixed values.
GAZETTEER = {
    "email": r"[.)\]] ?(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$",
    "ip": r"^(?:10|127|172|192|[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6)",
    "phone": r"^(?:\+(?:1|7|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-9]|8[0-9]|9[0-9])|\(?[2-9][0-9]{2})",
    "secret": r"^(?:akia|ghp_|gho_|sk-|sk_live|xox[abp]-|aiza|glpat-|ya29)",
}


def running(values: Column, add) -> Column:
    """add over all elements (of 0 or more) before each one, plus that over all at the end; in pieces of 64, so long arrays stay cheap."""
    n = F.size(values)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / 64).cast("int")), lambda c: F.slice(values, c * 64 + 1, 64))
    total = lambda a: F.aggregate(a, F.lit(0), add)
    return let(
        pieces,
        lambda p: let(
            F.transform(p, total),
            lambda sums: F.concat(
                F.flatten(F.transform(p, lambda piece, c: let(total(F.slice(sums, 1, c)), lambda before: F.transform(piece, lambda _, i: add(before, total(F.slice(piece, 1, i))))))),
                F.array(total(sums)),
            ),
        ),
    )


def running_sums(sizes: Column) -> Column:
    """Sums of all elements before each one, plus the total at the end."""
    return running(sizes, lambda a, x: a + x)


def _luhn(digits: Column) -> Column:
    """Whether a text of digits passes the check of card numbers."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.try_cast("int"))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).otherwise(F.when(v * 2 > 9, v * 2 - 9).otherwise(v * 2)))
    return F.aggregate(F.filter(doubled, lambda v: v.isNotNull()), F.lit(0), lambda a, v: a + v) % 10 == 0


def _is_base(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "secret":
        return F.lit(False)
    if kind == "email":
        return hit.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$")
    if kind == "ip":
        parts_fit = F.forall(F.split(hit, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda q: (F.length(q) <= 3) & (q.try_cast("int") <= 255)))
        return ~F.contains(hit, F.lit(":")) & F.coalesce(parts_fit, F.lit(False))
    if kind == "card":
        return ~hit.rlike("[./]") & F.length(digits).between(14, 19) & _luhn(digits)
    return F.startswith(hit, F.lit("+")) & F.length(digits).between(10, 15)


def _candidates(text: Column, kind: str) -> Column:
    """All matches of a kind: (kind, start, end, hit, base, left, right) with places in code points, end exclusive."""
    pattern = _PATTERN[kind]
    empty = F.expr("filter(array(named_struct('kind', '', 'start', 0, 'end', 0, 'hit', '', 'base', false, 'left', '', 'right', '')), c -> false)")

    def rows(gaps: Column, found: Column) -> Column:
        sizes = F.transform(gaps, lambda g, i: F.length(g) + F.coalesce(F.length(F.get(found, i)), F.lit(0)))
        return let(
            running_sums(sizes),
            lambda at: F.transform(
                found,
                lambda h, i: F.struct(
                    F.lit(kind).alias("kind"),
                    (F.get(at, i) + F.length(F.get(gaps, i))).alias("start"),
                    F.get(at, i + 1).alias("end"),
                    h.alias("hit"),
                    _is_base(kind, h).alias("base"),
                    F.lower(F.right(F.get(gaps, i), F.lit(24))).alias("left"),
                    F.left(F.get(gaps, i + 1), F.lit(1)).alias("right"),
                ),
            ),
        )

    matches = let(F.split(text, pattern, -1), lambda gaps: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: rows(gaps, found)))
    return F.when(_NEEDED[kind](text), matches).otherwise(empty)


def with_candidates(docs: DataFrame, text: str, out: str = "_candidates") -> DataFrame:
    """All columns of docs and the candidates of all kinds in the whole text; null texts have none."""
    names = docs.columns
    found = {f"_c{i}": _candidates(F.coalesce(F.col(text), F.lit("")), kind) for i, kind in enumerate(ALL_KINDS)}
    rows = once(docs, **{f"_v{i}": F.col(f"`{n}`") for i, n in enumerate(names)}, **found)
    return rows.select(*(F.col(f"_v{i}").alias(n) for i, n in enumerate(names)), F.concat(*(F.col(c) for c in found)).alias(out))


def votes(c: Column) -> Column:
    """Votes of the labelers on a candidate: 2 for personal data, 0 against, 1 abstains.

    Form: has the usual form of its kind. Gazetteer: known issuer, code, host, block or head of a key. Context: a word
    before it names the kind; secrets need one. Shape: separators of one sort, and no word inside a secret. Border: no
    letter, digit or sign that would make it part of something longer; a secret stands in quotes or behind a sign.
    Whether a base pattern accepts a candidate is no vote, so that estimation does not learn that pattern.
    """
    by_kind = lambda values: F.coalesce(*(F.when(c["kind"] == k, v) for k, v in values.items()))
    vote = lambda yes, no: F.when(yes, 2).when(no, 0).otherwise(1)
    secret = c["kind"] == "secret"
    formed = by_kind({k: c["hit"].rlike(w) for k, w in FORM.items()})
    named = by_kind({k: c["left"].rlike(w) for k, w in CONTEXT_WORDS.items()})
    known = by_kind({k: F.lower(c["hit"]).rlike(w) for k, w in GAZETTEER.items()})
    even = c["hit"].rlike(r"^[^\x20().-]*$|^[^().-]*$|^[^\x20().]*$|^[^\x20()-]*$") | c["hit"].rlike(r"^\+?[0-9]* ?\([0-9]+\) ?[0-9]+-[0-9]+$")
    clean = F.when(secret, ~c["hit"].rlike("[A-Za-z]{9,}")).otherwise(even)
    glued = c["left"].rlike(r"[a-z0-9_/#=]$") | c["right"].rlike(r"[A-Za-z0-9_/#=]")
    apart = F.when(secret, c["left"].rlike(r"[:=] ?[\"']?$") | (c["left"].rlike(r"[\"']$") & c["right"].rlike(r"[\"']"))).otherwise(~glued)
    return F.array(vote(formed, ~formed), vote(known, ~known & ~secret), vote(named, secret), vote(clean, ~clean), vote(apart, ~apart))


LABELERS = 5


def _features(c: Column) -> Column:
    """Texts that describe a candidate for the classifier; each takes few values whatever the data."""
    shape = F.regexp_replace(F.regexp_replace(F.substring(c["hit"], 1, 24), "[0-9]+", "9"), "[A-Za-z]+", "a")
    size = F.least(F.floor(F.length(c["hit"]) / 4), F.lit(8)).cast("string")
    digits = F.least(F.length(F.regexp_replace(c["hit"], "[^0-9]", "")), F.lit(20)).cast("string")
    values = [F.substring(shape, 1, 12), size, digits, F.regexp_extract(c["left"], r"(mail|call|tel|phone|card|ip|server|version|order|nr|no|token|secret|password|passwd|pwd|key|bearer)[^a-z]*$", 1), F.regexp_extract(c["left"], r"([:=\"'#/-]?) ?[\"']?$", 1)]
    cells = [F.concat_ws("|", F.lit(str(i)), v) for i, v in enumerate(values)]
    return F.transform(F.array(*cells), lambda v: (_kind_no(c["kind"]) * FEATURE_CELLS + F.pmod(F.xxhash64(v), F.lit(FEATURE_CELLS))).cast("int"))


#: Feature cells of each kind.
FEATURE_CELLS = 256


def _kind_no(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ALL_KINDS)), kind).cast("int") - 1


@dataclass
class Model:
    """By kind: a share of personal data and the labelers' reliabilities; and what each feature cell adds to the log odds."""

    prior: list[float]
    reliability: list[list[list[list[float]]]]  # by kind, labeler, class and vote
    odds: list[float]


def _posterior(prior: float, reliability: list, ballot: Column) -> Column:
    """The probability that a candidate of a kind with these votes is personal data."""
    logit = F.lit(math.log(prior / (1 - prior)))
    for i in range(LABELERS):
        odds = [math.log(reliability[i][1][v] / reliability[i][0][v]) for v in range(3)]
        logit = logit + F.get(F.array(*map(F.lit, odds)), F.get(ballot, F.lit(i)))
    return 1 / (1 + F.exp(-logit))


def _posterior_of(prior: float, reliability: list, ballot: tuple) -> float:
    """The same for one ballot outside Spark."""
    odds = prior / (1 - prior) * math.prod(reliability[i][1][v] / reliability[i][0][v] for i, v in enumerate(ballot))
    return odds / (1 + odds)


def _estimated(ballots: dict[tuple, float], rounds: int) -> tuple[float, list]:
    """(prior, reliabilities) of one kind by expectation-maximisation over counted ballots; the start values without any."""
    prior, reliability = 0.5, [[[0.6, 0.25, 0.15], [0.1, 0.3, 0.6]] for _ in range(LABELERS)]
    everything = sum(ballots.values())
    for _ in range(rounds if ballots else 0):
        yes = {ballot: n * _posterior_of(prior, reliability, ballot) for ballot, n in ballots.items()}
        all_yes = sum(yes.values())
        prior = min(max(all_yes / everything, 0.01), 0.99)
        voted = lambda table, i, v: sum(n for ballot, n in table.items() if ballot[i] == v)
        reliability = [
            [
                [(voted(ballots, i, v) - voted(yes, i, v) + 1) / (everything - all_yes + 3) for v in range(3)],
                [(voted(yes, i, v) + 1) / (all_yes + 3) for v in range(3)],
            ]
            for i in range(LABELERS)
        ]
    return prior, reliability


def learn(docs: DataFrame, text: str, rounds: int = 8) -> Model:
    """Estimates the labelers' reliabilities for each kind by expectation-maximisation and trains the classifier on the result.

    All candidates of all texts are counted by kind, votes and features; each takes a bounded number of values, so the
    table of counts is small however many candidates there are. The rounds run over the counts of the votes alone, a few
    hundred numbers. The classifier is naive Bayes on the features, trained on the votes' posterior as soft labels.
    Without candidates the start values stay.
    """
    found = with_candidates(docs.select(F.col(text).alias("text")), "text").select(F.explode("_candidates").alias("c"))
    told = found.select(_kind_no(F.col("c.kind")).alias("kind"), votes(F.col("c")).alias("votes"), _features(F.col("c")).alias("cells"))
    counts = saved(told.groupBy("kind", "votes", "cells").agg(F.count(F.lit(1)).cast("double").alias("n")), "votes")
    kinds = range(len(ALL_KINDS))
    ballots: list[dict] = [{} for _ in kinds]
    for r in counts.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect():  # at most 3 ** LABELERS rows of a kind
        ballots[r["kind"]][tuple(r["votes"])] = r["n"]
    estimates = [_estimated(some, rounds) for some in ballots]
    # The classifier's counts: how much of each feature cell is personal data by the votes.
    posterior = F.coalesce(*(F.when(F.col("kind") == k, _posterior(*estimates[k], F.col("votes"))) for k in kinds))
    soft = counts.select(F.explode("cells").alias("cell"), "n", (F.col("n") * posterior).alias("yes"))
    by_cell = {r["cell"]: (r["yes"], r["n"]) for r in soft.groupBy("cell").agg(F.sum("yes").alias("yes"), F.sum("n").alias("n")).collect()}  # at most FEATURE_CELLS rows of a kind
    odds, shares = [0.0] * (FEATURE_CELLS * len(ALL_KINDS)), []
    for k in kinds:
        own = {cell: pair for cell, pair in by_cell.items() if cell // FEATURE_CELLS == k}
        share = min(max(sum(y for y, _ in own.values()) / max(sum(n for _, n in own.values()), 1.0), 0.01), 0.99)
        shares.append(share)
        for cell, (yes, n) in own.items():
            odds[cell] = math.log((yes + share) / (n - yes + 1 - share)) - math.log(share / (1 - share))
    return Model(shares, [reliability for _, reliability in estimates], odds)


def probability(c: Column, model: Model) -> Column:
    """The classifier's probability that a candidate is personal data."""
    table = F.array(*map(F.lit, model.odds))
    start = F.get(F.array(*(F.lit(math.log(p / (1 - p))) for p in model.prior)), _kind_no(c["kind"]))
    return 1 / (1 + F.exp(-F.aggregate(_features(c), start, lambda a, cell: a + F.get(table, cell))))


def with_spans(docs: DataFrame, text: str, model: Model, least: float = 0.9, out: str = "spans") -> DataFrame:
    """All columns of docs and the spans (start, kind_no, kind, end, base) of the whole text, in order of start and kind.

    Base matches that pass their check always stay; other candidates are added if they match a wider pattern, or may be
    secrets, and the classifier gives at least this probability. Null and empty texts have no spans. Nothing is shuffled.
    """
    wide = lambda c: F.coalesce(*(F.when(c["kind"] == k, c["hit"].rlike(f"^(?:{w})$")) for k, w in _WIDE.items()), F.lit(True))
    kept = F.filter("_candidates", lambda c: c["base"] | (wide(c) & (probability(c, model) >= least)))
    number = lambda kind: F.array_position(F.array(*map(F.lit, ALL_KINDS)), kind).cast("int")
    spans = F.array_sort(F.transform(kept, lambda c: F.struct(c["start"].alias("start"), number(c["kind"]).alias("kind_no"), c["kind"].alias("kind"), c["end"].alias("end"), c["base"].alias("base"))))
    return with_candidates(docs, text).withColumn(out, spans).drop("_candidates")


#: Code points in each piece that texts are cut into for masking.
_PIECE = 4096


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap become one, named by the first of them.

    spans: in order of their starts. The text is cut into pieces once, so a gap is found without reading the text before it.
    """

    def between(pieces: Column, begin: Column, end: Column) -> Column:
        first, last = F.floor(begin / _PIECE).cast("int"), F.floor(F.greatest(end - 1, begin) / _PIECE).cast("int")
        some = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
        return F.when(end > begin, some.substr(begin - first * _PIECE + 1, end - begin)).otherwise("")

    def joined(pieces: Column, ends: Column) -> Column:
        # ends has the last end of all spans before each one: spans that start there or later begin a new gap.
        opens = F.filter(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.get(ends, i).alias("gap"))), lambda s: s["start"] >= s["gap"])
        parts = F.transform(opens, lambda s: F.concat(between(pieces, s["gap"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), between(pieces, F.get(ends, F.size(spans)), F.length(text)))

    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _PIECE), F.lit(0))
    last_ends = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    return F.when(F.size(spans) > 0, let(pieces, lambda p: let(last_ends, lambda ends: joined(p, ends)))).otherwise(text)
