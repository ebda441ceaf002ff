"""Personal data: patterns propose spans, checksums confirm, context words score.

Only DataFrame functions. For each kind the text is cut at the matches of its
pattern; lengths of the pieces and of the matches give the spans in code points.
Patterns are written so that each start is tried once (atomic runs behind a
look-behind), which finds the same leftmost matches as the plain form but stays
linear on long runs. Checks: parts of addresses at most 255, Luhn for cards,
9 to 15 digits for phones, ISO 7064 mod 97 for account numbers.

Besides the base kinds (email, ip, card, phone), which are kept whatever their
score, the operator finds ``iban`` (length of its country, checksum), ``secret`` (keys
of known form, assigned passwords, private-key blocks), ``token`` (runs of letters and
digits) and ``ssn`` (numbers of that form). Every span carries a score: the kind's
weight plus 0.2 if one of the kind's context words stands within ``WINDOW`` characters
before it (and after the kind's previous match), at most 1. Further kinds are kept if
their score reaches ``threshold``: iban and secret by their own weight, token and ssn
only where context speaks for them.

Cases: null is an empty text without spans; very long texts are scanned whole;
repeated rows are scanned alike; an empty table stays empty; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh

WINDOW, THRESHOLD = 40, 0.75
#: Characters of an account number after the country code, by country.
IBAN_LENGTHS = {
    13: "NO", 14: "BE", 16: "DK FI FO GL NL SD", 17: "MK SI", 18: "AT BA EE KZ LT LU XK", 19: "CH CR HR LI LV", 20: "BG BH DE GB GE IE ME RS VA",
    21: "AE GI IL IQ OM TL", 22: "AD CZ ES MD PK RO SA SE SK TN VG", 23: "LY PT ST", 24: "IS TR", 25: "BI DJ FR GR IT MC MR SM", 26: "AL AZ BY CY DO GT HU LB PL SV",
    27: "BR EG PS QA UA", 28: "JO KW MU", 29: "MT SC", 30: "LC", 31: "RU",
}
IBAN = "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 2}}}" for n, c in IBAN_LENGTHS.items())
SECRET = (
    r"AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|[sr]k_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
    r"|(?:password|passwd|secret|token|api_?key)\x20?[=:]\x20?[\x22\x27]?[A-Za-z0-9+/_-]{8,}"
)
KEY_BLOCK = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
#: kind: (pattern, a pattern without which there is no match, weight, context words).
#: The first four find what the plain patterns of the kinds find.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write|schreib|correo"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", None, 0.7, "ip|host|server|address|adresse"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None, 0.8, "card|visa|credit|karte|carte|tarjeta"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.8, "phone|call|tel|mobile|fax"),
    "iban": (rf"(?<![A-Za-z0-9_])(?:{IBAN})(?![A-Za-z0-9_])", None, 0.8, "iban|account|bank|konto|compte|cuenta"),
    "secret": (rf"(?<![A-Za-z0-9_])(?:{SECRET})|{KEY_BLOCK}", None, 0.8, "key|password|token|secret|aws"),
    "token": (r"(?<![A-Za-z0-9_])[A-Za-z0-9_-]{20,}+", None, 0.6, "key|token|secret|bearer|credential|auth"),
    "ssn": (r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])", "-", 0.6, "ssn|social security|tax id"),
}
BASE = ("email", "ip", "card", "phone")
DIGIT_RUN = r"[0-9](?:[\x20-]?[0-9]){12}"
TOKEN_LIKE = r"[A-Za-z0-9_-]{20}"


def luhn(digits: Column) -> Column:
    """True where the digit string's Luhn sum is a multiple of ten."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(F.filter(d, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """True where an account number (letters and digits only) has remainder 1."""
    turned = F.split(F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4))), "")
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    step = lambda a, c: F.when(c == "", a).when(value(c) < 10, (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97)
    return F.aggregate(turned, F.lit(0), step) == 1


def _sound(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(small(p)) <= 3) & (F.lpad(small(p), 3, "0") <= "255"))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(match, " ", ""))
    if kind == "token":
        return match.rlike("[A-Za-z]") & match.rlike("[0-9]")
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def spans(text: Column, kind: str) -> Column:
    """array<struct<start, end, match, before>> of a kind's proposals, unchecked."""
    pattern = KINDS[kind][0]
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("piece"), found.alias("match"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string,before:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        one = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), F.lower(F.right(x["piece"], F.lit(WINDOW))).alias("before"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

    return F.aggregate(pairs, zero, step)["out"]


def _kind(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, score>>, confirmed spans in order; lazily: only
    texts that hold the kind's needle are cut up."""
    _, needle, weight, words = KINDS[kind]
    may = F.contains(text, F.lit(needle)) if needle else text.rlike({"ip": r"[0-9]\.[0-9]++\.[0-9]", "card": DIGIT_RUN, "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]", "secret": r"AKIA|gh[pousr]_|xox|AIza|k_live_|eyJ|PRIVATE KEY|password|passwd|secret|token|api_?key", "token": TOKEN_LIKE}[kind])
    score = lambda s: F.least(F.lit(1.0), F.lit(weight) + F.when(s["before"].rlike(rf"(?<![a-z])(?:{words})"), 0.2).otherwise(0.0))
    good = F.filter(spans(text, kind), lambda s: _sound(kind, s["match"]))
    out = F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score(s).alias("score")))
    return F.when(may, out).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>"))


def find(docs: DataFrame, text: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """docs plus ``pii``: array<struct<kind, start, end, score>> by kind, then start."""
    names = fresh(docs, *[f"pii_{k}" for k in KINDS], "pii")
    whole = F.coalesce(col(text), F.lit(""))
    # two layers: one regular-expression pass a kind, then plain array work
    out = docs.select("*", *[_kind(whole, k).alias(n) for k, n in zip(KINDS, names, strict=False)])
    extra = [F.filter(col(n), lambda s: s["score"] >= threshold) if k not in BASE else col(n) for k, n in zip(KINDS, names, strict=False)]
    return out.select(*[col(c) for c in docs.columns], F.concat(*extra).alias(names[-1]))


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(*kinds: str):
    """A filter for spans of the given kinds."""
    return lambda s: s["kind"].isin(*kinds)


def redact(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with every span of ``text`` replaced by its kind in square brackets."""
    out = find(docs, text, **options)
    mark = out.columns[-1]
    inner = F.array_sort(col(mark), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(a["end"] - b["end"]))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(a: Column, s: Column) -> Column:
        fresh_ = s["start"] >= a["at"]
        more = F.concat(a["done"], F.substr(col(text), a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh_, more).otherwise(a["done"]).alias("done"))

    done = F.aggregate(inner, start, step)
    return out.withColumn(text, F.concat(done["done"], F.substr(col(text), done["at"] + 1))).drop(mark)
