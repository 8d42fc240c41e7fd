"""Personal data and secrets by weak supervision, in DataFrame expressions only.

Base spans come from fixed patterns and stay. Wider patterns propose further spans. Six labelers vote on every candidate
by evidence of their own: form (checks that the proposing pattern doesn't make: checksums, number ranges, entropy classes),
variety of characters, gazetteers, the words before, technical words before, and what follows. Their vote patterns are
counted over all documents; from these counts (a table whose size labelers and features fix, whatever the corpus)
expectation-maximisation estimates how reliable each labeler is and how likely each candidate kind is right, and a
logistic classifier is fitted to the resulting labels. It also sees length and share of digits, which no labeler does.
As an expression it decides on the proposed spans.

Every text is searched once: candidates and votes are stored, then counted, then decided. All steps over the matches of
a text are linear in their number, but for small chunks.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspark.llm.storage import materialise, whole_row

BASE = ("email", "ip", "card", "phone")
ADDED = ("address", "email_spelled", "iban", "name", "phone_local", "secret", "ssn")
KINDS = BASE + ADDED
LABELERS = ("form", "variety", "gazetteer", "before", "technical", "after")

# The base patterns, with possessive repeats and bounds on where a match can begin that leave what they
# find as it is and keep the time for long texts linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# The gazetteers.
TITLES = "Mr Mrs Ms Miss Dr Prof Sir Herr Frau Monsieur Madame Mme Señor Señora Sr Sra".split()
GIVEN_NAMES = (
    "Alice Ana Andrea Anna Antonio Carlos Carmen Charles Charlotte Claire Daniel David Elena Elizabeth Emily Emma Felix Francois Hans Heinrich"
    " Isabel James Javier Jean Jennifer Jessica Johann John Jose Joseph Juan Julia Karen Karl Klaus Laura Linda Louis Lucia Luis Marie Maria Mark Martin"
    " Mary Matthew Michael Michel Miguel Nathalie Nicolas Patricia Paul Pedro Peter Philippe Pierre Richard Robert Sabine Sarah Sofia Sophie Stefan Susan"
    " Thomas Ursula William Wolfgang"
).split()
CUES = "[Nn]ame is|[Dd]ear|[Ss]igned(?: by)?|[Rr]egards,?|[Ss]incerely,?|[Cc]ontact|[Ww]ritten by|[Ii] am|[Ii]'m"
TOP_DOMAINS = "com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au ch at be br in jp cn ru se no dk fi pl".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
CARD_STARTS = "30 34 35 36 37 38 4 51 52 53 54 55 60 62 64 65".split()
STREETS = "Street St Avenue Ave Road Rd Lane Ln Drive Boulevard Blvd Square Court".split()
FAVOURABLE = {
    "email": "e-?mail|contact|write|reach|correo|courriel", "email_spelled": "e-?mail|contact|write|reach|correo|courriel",
    "ip": r"\bip\b|address|host|login|client|server", "card": "card|visa|master|amex|credit|tarjeta|carte|karte|payment",
    "phone": "phone|tel|call|mobile|fax|cell|m[oó]vil", "phone_local": "phone|tel|call|mobile|fax|cell|m[oó]vil",
    "ssn": "ssn|social|security", "iban": "iban|account|bank|konto|cuenta|compte", "name": "name|dear|by|from|contact|signed|regards",
    "address": "address|live|lives|located|street|ship|deliver|visit|home",
    "secret": "token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|credential|bearer|session|cookie",
}
#: Beginnings of published key formats.
KEY_FORMATS = r"AKIA[0-9A-Z]{16}|gh[pousr]_|sk-|xox[abprs]-|eyJ|AIza"
#: Payment cards by range and length.
CARD_FORMS = "4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:5[1-5]|2[2-7])[0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2}|4[4-9][0-9])[0-9]{12}|3(?:0[0-5]|[68][0-9])[0-9]{11}|35[0-9]{14}|62[0-9]{14,17}"
TECHNICAL = r"(?i)(?:version|\bv|token|key|hash|sha|md5|commit|build|isbn|doi|order|invoice|serial|part|no\.?|nr\.?|id|#|=)[\s\"':=#]*$"

TECHNICAL_OF_SECRETS = r"(?i)(?:hash|sha-?[0-9]*|md5|crc|commit|revision|checksum|digest|etag|uuid|href|src|url|path|class|id)[\s\"':=#]*$"

#: What proposes further spans, one alternative for each kind; candidates of this pattern never overlap each other.
PROPOSED = {
    "email_spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,24})++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone_local": r"(?<![0-9+(.-])(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "address": rf"(?<![0-9A-Za-z.])[0-9]{{1,5}} (?:[A-Z][a-z]++ ){{1,3}}(?:{'|'.join(STREETS)})(?![A-Za-z])",
    "name": rf"(?<![A-Za-z])(?=[A-Z])(?:(?:{'|'.join(TITLES)})\.? [A-Z][a-z]++(?: [A-Z][a-z]++)?|(?:(?<=(?:{CUES}) )[A-Z][a-z]++|{'|'.join(GIVEN_NAMES)}) [A-Z][a-z]++)",
}
#: Values assigned to something, and published key formats; what stands before the value is cut off the match.
SECRET = rf"(?:[=:][\"' ]{{0,3}}|(?={KEY_FORMATS}))[A-Za-z0-9][A-Za-z0-9+/_-]{{15,}}={{0,2}}"
BEFORE_SECRET = r"^[=:][\"' ]{0,3}"
CONTEXT = 40
CHUNK = 128
_SPAN = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, zero: int, combine: Callable[[Column, Column], Column]) -> Column:
    """What ``combine``, which is associative, makes of all numbers before each one, starting with ``zero``.

    An aggregate copies its state at every step, so states must stay small: totals of chunks are run over first, then
    the numbers of each chunk from there.
    """

    def along(all_: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int"))
        # Slicing would copy the whole array for each chunk.
        own = lambda k: F.transform(F.sequence(k * CHUNK, F.least((k + 1) * CHUNK, F.size(all_)) - 1), lambda i: all_[i])
        step = lambda acc, x: F.struct(combine(acc["state"], x).alias("state"), F.concat(acc["out"], F.array(acc["state"])).alias("out"))
        begin = lambda state: F.struct(state.alias("state"), F.array().cast("array<int>").alias("out"))
        firsts = F.aggregate(F.transform(chunks, lambda k: F.aggregate(own(k), F.lit(zero), combine)), begin(F.lit(zero)), step)["out"]
        whole = let(firsts, lambda of: F.flatten(F.transform(chunks, lambda k: F.aggregate(own(k), begin(of[k]), step)["out"])))
        return F.when(F.size(all_) == 0, F.array().cast("array<int>")).otherwise(whole)

    return let(values, along)


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches with the number of characters before and in them and the text around.

    ``before`` and ``after`` reach ``CONTEXT`` characters, but not beyond the next match of the same pattern.
    """

    def found(gaps: Column) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m, k: F.struct(F.length(gaps[k]).alias("gap"), F.length(m).alias("size"), m.alias("match"), F.substring(gaps[k], -CONTEXT, CONTEXT).alias("before"), F.substring(gaps[k + 1], 1, CONTEXT).alias("after")))

    return F.when(text.rlike(pattern), let(F.split(text, pattern, -1), found)).otherwise(F.array().cast("array<struct<gap:int,size:int,match:string,before:string,after:string>>"))


def placed(found: Column) -> Column:
    """Matches with start and end in code points, the end exclusive."""
    at = running(F.transform(found, lambda x: x["gap"] + x["size"]), 0, lambda a, b: a + b)

    def spans(before: Column) -> Column:
        # ``found`` is no operand of a lambda here but the array that it goes along.
        return F.transform(found, lambda x, k: F.struct((before[k] + x["gap"]).alias("start"), (before[k] + x["gap"] + x["size"]).alias("end"), x["match"].alias("match"), x["before"].alias("before"), x["after"].alias("after")))

    return F.when(F.size(found) == 0, F.array().cast(_SPAN)).otherwise(let(at, spans))


def marks(spans: Column, others: Column) -> Column:
    """Starts and ends of spans and others in order; of those that begin together, others come first."""
    mark = lambda c, own: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end")))
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), F.array().cast("array<struct<start:int,own:boolean,end:int>>")).otherwise(F.array_sort(F.concat(mark(others, False), mark(spans, True))))


def ends_before(marks: Column) -> Column:
    """For each mark the latest end of others that begin before it."""
    return running(F.transform(marks, lambda x: F.when(x["own"], 0).otherwise(x["end"])), 0, lambda a, b: F.greatest(a, b))


def starts_behind(marks: Column) -> Column:
    """For each mark, from the last to the first, the earliest start of others behind it."""
    return running(F.transform(F.reverse(marks), lambda x: F.when(x["own"], 2**31 - 1).otherwise(x["start"])), 2**31 - 1, lambda a, b: F.least(a, b))


def apart(df: DataFrame, spans: str, others: Column) -> DataFrame:
    """``df`` with only those of the spans in a column that overlap none of the others; spans don't overlap each other."""
    names = df.columns
    marked = df.select(*names, marks(F.col(spans), others).alias("marks"))
    run = marked.select(*names, "marks", ends_before(F.col("marks")).alias("ends"), F.reverse(starts_behind(F.col("marks"))).alias("starts"))
    # Bound by ``let``, as a column that a lambda refers to once may be worked out in it for every element.
    check = lambda ends, starts: F.transform("marks", lambda x, k: F.when(x["own"], (ends[k] <= x["start"]) & (starts[k] >= x["end"])))
    clear = let(F.col("ends"), lambda ends: let(F.col("starts"), lambda starts: F.filter(check(ends, starts), lambda x: x.isNotNull())))
    told = run.select(*names, clear.alias("clear"))
    kept = F.when(F.size("clear") == 0, F.col(spans)).otherwise(let(F.col("clear"), lambda ok: F.filter(spans, lambda _, k: ok[k])))
    return told.select(*[kept.alias(c) if c == spans else F.col(c) for c in names])


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def valid_ip(match: Column) -> Column:
    def small(part: Column) -> Column:
        short = F.ltrim(part, F.lit("0"))
        return F.when(F.length(short) > 3, F.lit(False)).otherwise(F.concat(F.lit("0"), short).cast("int") <= 255)

    return F.forall(F.split(match, r"\."), small)


def valid_card(match: Column) -> Column:
    number = F.reverse(digits(match))
    n = F.length(number)

    def worth(k: Column) -> Column:
        d = F.substring(number, k, F.lit(1)).cast("int")
        twice = 2 * d
        return F.when(k % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, k: s + worth(k))
    return F.when(n.between(12, 19), total % 10 == 0).otherwise(F.lit(False))


def valid_phone(match: Column) -> Column:
    return F.length(digits(match)).between(9, 15)


def base_matches(text: Column) -> dict[str, Column]:
    """The matches of the base patterns, before any check."""
    only = lambda mark, pattern: F.when(F.contains(text, F.lit(mark)), matches(text, pattern)).otherwise(matches(F.lit(""), pattern))
    return {"email": only("@", EMAIL), "ip": matches(text, IP), "card": matches(text, CARD), "phone": only("+", PHONE)}


def valid(kind: str, match: Column) -> Column:
    return {"email": lambda m: F.lit(True), "ip": valid_ip, "card": valid_card, "phone": valid_phone}[kind](match)


def _kind_of(match: Column) -> Column:
    """The kind whose alternative made a proposed match; the first that fits in the order of ``PROPOSED``."""
    bare = {k: p for k, p in PROPOSED.items()}
    out = F.lit("name")
    for kind in reversed(list(bare)[:-1]):
        out = F.when(match.rlike(rf"\A(?:{bare[kind]})\z"), F.lit(kind)).otherwise(out)
    return out


def _vote(*cases: tuple[Column, int]) -> Column:
    out = F.lit(0)
    for condition, value in reversed(cases):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out.cast("int")


def _iban_rest(match: Column) -> Column:
    """An account number modulo 97, which is 1 if its check digits are right."""
    bare = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))
    step = lambda rest, c: F.when(c.rlike("^[0-9]$"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def candidate(kind: Column, span: Column) -> Column:
    """A candidate with the votes of all labelers: 1 for personal data, -1 against, 0 for no opinion."""
    match, number, before, after = span["match"], digits(span["match"]), span["before"], span["after"]
    is_ = lambda *kinds: kind.isin(*kinds)
    distinct = F.size(F.array_distinct(F.split(match, "")))
    varied = F.size(F.array_distinct(F.split(number, "")))
    form = _vote(
        (is_("email") & match.rlike(r"^(?!\.)(?!.*\.\.)[^@]*[^.@]@[A-Za-z0-9][^@]*\.[A-Za-z]{2,24}$"), 1), (is_("email"), -1),
        (is_("ip") & match.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])(?:\.(?:0|[1-9][0-9]{0,2})){3}$"), 1), (is_("ip"), -1),
        (is_("card") & number.rlike(f"^(?:{CARD_FORMS})$"), 1), (is_("card"), -1), (is_("phone") & match.rlike(r"^\+[1-9][0-9 .-]*(?:\([0-9]+\)[0-9 .-]*)?$"), 1), (is_("phone"), -1),
        (is_("ssn") & match.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), 1), (is_("ssn"), -1), (is_("iban") & (_iban_rest(match) == 1), 1), (is_("iban"), -1),
        (is_("phone_local") & number.rlike("^[2-9][0-9]{8,11}$"), 1), (is_("phone_local"), -1), (is_("email_spelled") & match.rlike(r"[\(\[]at[\)\]]"), 1),
        (is_("name") & match.rlike(r"^(?:[A-Z][a-z]{0,7}\.? )?[A-Z][a-z]{1,14} [A-Z][a-z]{1,14}$"), 1), (is_("address") & match.rlike("^[1-9][0-9]{0,3} "), 1),
        (is_("secret") & match.rlike(rf"^(?:(?:{KEY_FORMATS})|[0-9a-f]{{32,}}$|[0-9A-F]{{32,}}$|(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])(?=[^0-9]*[0-9]).{{20,}}$)"), 1), (is_("secret") & match.rlike("^(?:[A-Za-z_/-]+|[0-9_/-]+)$"), -1),
    )
    variety = _vote((is_("secret") & (distinct >= 12), 1), (is_("secret") & (distinct < 9), -1), (is_("ip", "card", "phone", "phone_local", "ssn", "iban") & (varied <= 3), -1), (is_("card", "phone", "phone_local") & (varied >= 6), 1))
    listed = _vote(
        (is_("email", "email_spelled") & F.lower(match).rlike(rf"(?:\.|dot ?[\)\]]? ?)(?:{'|'.join(TOP_DOMAINS)})$"), 1), (is_("email", "email_spelled"), -1),
        (is_("phone") & number.rlike(rf"^(?:{'|'.join(CALLING_CODES)})"), 1), (is_("phone"), -1), (is_("card") & number.rlike(rf"^(?:{'|'.join(CARD_STARTS)})"), 1), (is_("card"), -1),
        (is_("ip") & match.rlike(r"^(?:0|127|255)\."), -1), (is_("name") & match.rlike(rf"\b(?:{'|'.join(GIVEN_NAMES)})\b"), 1), (is_("secret") & match.rlike(f"^(?:{KEY_FORMATS})"), 1),
    )
    lower = F.lower(before)
    context = _vote(*[(is_(k) & lower.rlike(words), 1) for k, words in FAVOURABLE.items()])
    technical = _vote((~is_("secret") & before.rlike(TECHNICAL), -1), (is_("secret") & before.rlike(TECHNICAL_OF_SECRETS), -1))
    follows = _vote((after.rlike(r"^[.:/@-]?[0-9A-Za-z_]"), -1), (after.rlike(r"^(?:$|[\s.,;:!?)\]\"'<])"), 1))
    votes = dict(zip(LABELERS, (form, variety, listed, context, technical, follows), strict=True))
    share = F.when(F.length(number) == 0, 0).when(2 * F.length(number) < F.length(match), 1).otherwise(2)
    return F.struct(span["start"].alias("start"), kind.alias("kind"), span["end"].alias("end"), *[v.alias(k) for k, v in votes.items()], _length_class(match).alias("length"), share.alias("digits"))


def _length_class(match: Column) -> Column:
    return F.least(F.lit(4), F.floor(F.log2(F.length(match).cast("double") + 1) / 1.5)).cast("int")


@dataclass(frozen=True)
class SpanClassifier:
    """Logistic weights, and what expectation-maximisation found on the way."""

    intercept: float
    kinds: dict[str, float]
    votes: dict[str, float]
    length: float
    digits: dict[int, float]
    reliability: dict[str, float]
    prior: dict[str, float]

    def probability(self, x: Column) -> Column:
        score = F.lit(self.intercept) + self.length * x["length"]
        for share, w in self.digits.items():
            score = score + F.when(x["digits"] == share, F.lit(w)).otherwise(F.lit(0.0))
        by_kind = F.lit(0.0)
        for kind, w in self.kinds.items():
            by_kind = F.when(x["kind"] == kind, F.lit(w)).otherwise(by_kind)
        for name, w in self.votes.items():
            score = score + w * x[name]
        return 1 / (1 + F.exp(-(score + by_kind)))


def fit(patterns: list[tuple[str, tuple[int, ...], int, int, int]], rounds: int = 100) -> SpanClassifier:
    """Reliabilities by expectation-maximisation, then the classifier, from (kind, votes, length, digits, count) rows."""
    patterns = sorted(patterns)
    reliability, prior = [0.8] * len(LABELERS), {k: 0.5 for k in KINDS}
    label = [0.5] * len(patterns)
    for _ in range(rounds):
        for i, (kind, votes, *_) in enumerate(patterns):
            yes, no = math.log(prior[kind]), math.log(1 - prior[kind])
            for r, v in zip(reliability, votes, strict=True):
                if v:
                    yes, no = yes + math.log(r if v > 0 else 1 - r), no + math.log(1 - r if v > 0 else r)
            label[i] = 1 / (1 + math.exp(min(500.0, no - yes)))
        for j in range(len(LABELERS)):
            right = 8.0 + sum(n * (p if v[j] > 0 else 1 - p) for (_, v, *_, n), p in zip(patterns, label, strict=True) if v[j])
            total = 10.0 + sum(n for _, v, *_, n in patterns if v[j])
            reliability[j] = min(0.99, max(0.51, right / total))
        for kind in KINDS:
            mass = sum(n for k, *_, n in patterns if k == kind)
            prior[kind] = min(0.95, max(0.05, (1.0 + sum(n * p for (k, *_, n), p in zip(patterns, label, strict=True) if k == kind)) / (2.0 + mass)))
    # Logistic regression on the labels; every pattern weighs by the root of its count, so none drowns the others.
    names = [f"kind:{k}" for k in KINDS] + [f"vote:{x}" for x in LABELERS] + [f"digits:{x}" for x in range(3)] + ["length", "one"]
    w = dict.fromkeys(names, 0.0)
    total = sum(math.sqrt(n) for *_, n in patterns) or 1.0
    for _ in range(400):
        step = {x: -0.002 * w[x] for x in names}
        for (kind, votes, length, share, n), p in zip(patterns, label, strict=True):
            x = {f"kind:{kind}": 1.0, "one": 1.0, "length": length / 4, f"digits:{share}": 1.0, **{f"vote:{l}": float(v) for l, v in zip(LABELERS, votes, strict=True)}}  # noqa: E741
            error = p - 1 / (1 + math.exp(-max(-500.0, min(500.0, sum(w[f] * v for f, v in x.items())))))
            for f, v in x.items():
                step[f] += math.sqrt(n) / total * error * v
        for f in names:
            w[f] += 2.0 * step[f]
    return SpanClassifier(w["one"], {k: w[f"kind:{k}"] for k in KINDS}, {x: w[f"vote:{x}"] for x in LABELERS}, w["length"] / 4, {x: w[f"digits:{x}"] for x in range(3)}, dict(zip(LABELERS, reliability, strict=True)), prior)


def with_candidates(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``found``: the candidates ``base`` and ``added`` of a text with their votes.

    Added candidates overlap neither base ones nor each other. What several steps use is a column of its own.
    """
    # A spelled-out address has a "dot"; texts without one are spared its pattern, which starts to match at every word.
    # The other patterns start with a capital, a digit or a bracket, which is looked at first.
    whole = "|".join(PROPOSED.values())
    rest = "(?=[A-Z0-9(])(?:" + "|".join(p for k, p in PROPOSED.items() if k != "email_spelled") + ")"
    proposed = F.when(F.contains(text, F.lit("dot")), matches(text, whole)).otherwise(matches(text, rest))

    def value(s: Column) -> Column:
        cut = F.regexp_replace(s["match"], BEFORE_SECRET, "")
        lead = F.length(s["match"]) - F.length(cut)
        return F.struct((s["start"] + lead).alias("start"), s["end"].alias("end"), cut.alias("match"), F.concat(s["before"], F.substring(s["match"], F.lit(1), lead)).alias("before"), s["after"].alias("after"))

    voted = lambda spans, kind: F.transform(spans, lambda s: candidate(kind(s), s))
    names = df.columns
    found = df.select(*names, *[m.alias(f"of_{k}") for k, m in base_matches(text).items()], matches(text, SECRET).alias("secrets"), proposed.alias("proposed"))
    spans = found.select(*names, *[placed(F.col(c)).alias(c) for c in (*(f"of_{k}" for k in BASE), "secrets", "proposed")])

    def of_kind(kind: str) -> Column:
        return voted(F.filter(f"of_{kind}", lambda s: valid(kind, s["match"])), lambda _: F.lit(kind))

    base = F.concat(*map(of_kind, BASE))
    checked = spans.select(*names, base.alias("base"), F.transform("secrets", value).alias("secrets"), "proposed")
    place = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    free = apart(checked, "secrets", F.col("base"))
    free = apart(free, "proposed", F.concat(place("base"), place("secrets")))
    added = F.concat(voted(F.col("secrets"), lambda _: F.lit("secret")), voted(F.col("proposed"), lambda s: _kind_of(s["match"])))
    return free.select(*names, F.struct("base", added.alias("added")).alias("found"))


def train(found: DataFrame) -> SpanClassifier:
    """A classifier from the vote patterns of all candidates in the column ``found``."""
    names = ["kind", *LABELERS, "length", "digits"]
    rows = found.select(F.explode(F.concat("found.base", "found.added")).alias("c")).select(*[f"c.{x}" for x in names]).groupBy(*names).agg(F.count(F.lit(1)).alias("rows")).collect()
    return fit([(r.kind, tuple(r[x] for x in LABELERS), r["length"], r["digits"], r["rows"]) for r in rows])


def _listed(spans: Column) -> Column:
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("order"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame, *, text: str = "text", columns: tuple[str, ...] | None = None, threshold: float = 0.5, classifier: SpanClassifier | None = None) -> DataFrame:
    """Adds to every row ``n_email n_ip n_card n_phone`` (base spans), ``base_sha256``, ``spans`` (all) and ``n_spans``.

    Null and empty texts have no spans. Repeated rows each get their result. Columns of these names are replaced; others
    stay, whatever their names, or only ``columns`` of them: what stays is stored beside the candidates while these are
    counted. Added spans never overlap base spans or each other; their kinds are those of ``ADDED``. An empty table gives
    an empty table.
    """
    names = [*(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"]
    kept = [c for c in (docs.columns if columns is None else columns) if c not in names]
    own = docs.select(whole_row(docs.select(*[F.col(f"`{c}`") for c in kept])), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    df = materialise(with_candidates(own, F.col("body")).drop("body"), "personal-candidates")
    model = classifier or train(df)
    count = lambda kind: F.size(F.filter("found.base", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.concat("found.base", F.filter("found.added", lambda c: model.probability(c) >= threshold))
    return df.select("row.*", *[count(k) for k in BASE], F.sha2(_listed(F.col("found.base")).cast("binary"), 256).alias("base_sha256"), _listed(every).alias("spans"), F.size(every).cast("long").alias("n_spans"))
