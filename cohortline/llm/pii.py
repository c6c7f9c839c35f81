"""Personal data: regular expressions propose spans, validators confirm them, words nearby adjust their score.

DataFrame functions only. A kind's matches and the text between them alternate, so positions are running sums of
lengths, and the words nearby are the ends of the neighbouring pieces: no text is cut by position.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Code points before and after a match in which words count
NEAR = 48
#: Matches whose positions are summed in one go; the sums of such runs are added up first, so no long list grows step by step
RUN = 256
#: A span that isn't of a base kind stays from this score on
THRESHOLD = 0.5
#: What a word for the kind adds to the score and a word against it takes away
GAIN, LOSS = 0.4, 0.4


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Texts without this string or this pattern have no match that stays
    holds: str = ""
    gate: str = ""
    #: Every match has a digit
    numeric: bool = True
    #: Whether a match is confirmed
    valid: Callable[[Column], Column] = lambda match: F.lit(True)
    #: Score of a confirmed match without words nearby
    prior: float = 0.5
    #: Patterns over the lower-cased text before or after a match: for the kind, and against it
    before: str = ""
    after: str = ""
    against: str = ""
    base: bool = False


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def has_digits(least: int, most: int) -> Callable[[Column], Column]:
    return lambda match: F.length(digits(match)).between(least, most)


def luhn(least: int, most: int) -> Callable[[Column], Column]:
    return lambda match: has_digits(least, most)(match) & F.call_function("luhn_check", digits(match))


def small_parts(match: Column) -> Column:
    """Each of the four numbers is at most 255, leading zeros aside."""
    return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$")


def mod97(match: Column) -> Column:
    """Remainder 1 of an account number whose first four characters go last, with letters as 10 to 35."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = letters(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))))
    return F.aggregate(turned, F.lit(0), lambda a, c: F.when(F.ascii(c) < 58, (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)) == 1


def routing(match: Column) -> Column:
    """Nine digits, not all zero, whose sum is a multiple of ten when they are weighed 3, 7 and 1 in turn."""
    weighed = F.transform(letters(match), lambda c, k: c.cast("int") * F.get(F.array(F.lit(3), F.lit(7), F.lit(1)), k % 3))
    return (F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10 == 0) & (match != "000000000")


def mixed(match: Column) -> Column:
    return match.rlike("[0-9]") & match.rlike("[A-Za-z]")


#: Characters of an international account number, and the countries with so many: fixed values.
ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|NL", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|DE|GB|GE|IE|ME|RS",
    23: "AE|GI|IL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "PT", 26: "IS|TR", 27: "FR|GR|IT|MC|MR|SM",
    28: "AL|AZ|CY|DO|GT|HU|LB|PL", 29: "BR|PS|QA", 30: "JO|KW|MU", 31: "MT",
}
ACCOUNTS = "|".join(f"(?:{countries})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, countries in ACCOUNT_LENGTHS.items())
ASSIGNED = r"""(?:token|secret|api[ _-]?key|access[ _-]?key|private[ _-]?key|password|passwd|pwd)["']?\s{0,3}[:=]{1,2}>?\s{0,3}["']?"""

#: The first four are the base kinds. Their matches are those of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`,
#: `[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)`, `[0-9]([\x20-]?[0-9])+` and `\+[0-9][\x20().0-9-]+[0-9]`, but each character is
#: passed a bounded number of times, and no match goes deep into the stack: a run of characters is tried from its start or from
#: the last match's end (\G) only, since any other start in it ends alike, and what can't be given back is possessive.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", holds="@", numeric=False, prior=0.7,
         before="mail|contact|kontakt|correo|courriel|write to|schreib", against="example|no-?reply", base=True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", gate=r"[0-9]\.[0-9]", valid=small_parts, prior=0.6,
         before=r"\bip\b|address|adresse|host|server|client|login", against="version|release|build|firmware|section|kapitel", base=True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", gate="[0-9](?:[ -]?[0-9]){13}", valid=luhn(14, 19), prior=0.6,
         before="card|karte|tarjeta|carte|visa|master|amex|credit|kredit|payment", after="cvv|cvc|exp", against="isbn|order|invoice|tracking|serial|bestell", base=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", holds="+", valid=has_digits(10, 15), prior=0.6,
         before="phone|tel|call|mobil|fax|anruf|llama|appel", against="version|offset|utc|gmt", base=True),
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{ACCOUNTS})(?![A-Za-z0-9])", gate="[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", valid=mod97, prior=0.8,
         before="iban|konto|account|cuenta|compte|bank"),
    Kind("ssn", "(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", gate="[0-9]{3}-[0-9]{2}-[0-9]{4}", prior=0.3,
         before=r"\bssn\b|social security|taxpayer", against="order|part|isbn|case"),
    Kind("routing", "(?<![0-9])[0-9]{9}(?![0-9])", gate=r"(?i)routing|\baba\b|bank transit", valid=routing, prior=0.2, before=r"routing|\baba\b|bank transit"),
    Kind("secret", "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+", gate=f"(?i){ASSIGNED}", valid=mixed, prior=0.2, before=f"{ASSIGNED}$"),
)
FOUND = "array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double>>"


def _score(kind: Kind, left: Column, right: Column) -> Column:
    seen = lambda pattern, text: F.lower(text).rlike(pattern) if pattern else F.lit(False)
    raised = F.when(seen(kind.before, left) | seen(kind.after, right), GAIN).otherwise(0.0)
    lowered = F.when(seen(kind.against, left), LOSS).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(kind.prior) + raised - lowered)), 2)


def _described(kind: Kind, parts: str, hits: str) -> Column:
    """For each match: the length of the text before it, its own, and its score, null if it isn't confirmed."""

    def one(hit: Column, k: Column) -> Column:
        left, right = F.get(parts, k), F.get(parts, k + 1)
        score = F.when(kind.valid(hit), _score(kind, F.right(left, F.lit(NEAR)), F.left(right, F.lit(NEAR))))
        return F.struct(F.length(left).cast("long").alias("gap"), F.length(hit).cast("long").alias("size"), score.alias("score"))

    return F.transform(hits, one)


def _runs(described: str) -> Column:
    """The same in runs of RUN."""
    some = F.size(described) > 0
    return F.when(some, F.transform(F.sequence(F.lit(0), F.greatest(F.size(described) - 1, F.lit(0)), F.lit(RUN)), lambda at: F.slice(F.col(described), at + 1, F.lit(RUN))))


def _starts(runs: str) -> Column:
    """Where each run starts."""
    sizes = F.transform(runs, lambda run: F.aggregate(run, F.lit(0).cast("long"), lambda a, x: a + x["gap"] + x["size"]))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all"))
    return F.aggregate(sizes, first, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])


def _placed(kind: Kind, rank: int, runs: str, starts: str, threshold: float) -> Column:
    """The confirmed matches with their places; a kind of the method's own has to reach the threshold."""

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["size"]).alias("end"), F.lit(kind.name).alias("kind"), x["score"].alias("score"))
        stays = x["score"].isNotNull() if kind.base else F.coalesce(x["score"] >= threshold, F.lit(False))
        return F.struct((start + x["size"]).alias("at"), F.when(stays, F.concat(a["all"], F.array(span))).otherwise(a["all"]).alias("all"))

    def placed(run: Column, at: Column) -> Column:
        return F.aggregate(run, F.struct(at.alias("at"), F.array().cast(FOUND).alias("all")), step, lambda a: a["all"])

    return F.coalesce(F.flatten(F.zip_with(runs, starts, placed)), F.array().cast(FOUND))


def pii_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_<kind> of each base kind, base_sha256, spans, score, found.

    found lists start, rank (of the kind), end (outside), kind and score of each span by start, then kind; places are code
    points. Matches of a kind don't overlap, spans of several kinds may. base_sha256 digests the base kinds' spans as
    kind:start:end, comma-joined; spans is all of them, joined likewise; score the highest one, 0 without spans. Base kinds stay
    whatever their score. Null texts count as empty; null ids and repeated rows stay; only the two named columns are read. No
    shuffle, and the work on a text grows with its length and matches.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_numeric", F.col("_text").rlike("[0-9]"))
    able = {}
    for kind in kinds:
        able[kind] = F.col("_numeric") if kind.numeric else F.lit(True)
        if kind.holds:
            able[kind] &= F.contains("_text", F.lit(kind.holds))
        if kind.gate:
            able[kind] &= F.col("_text").rlike(kind.gate)
    rows = rows.withColumns({f"_able_{k.name}": able[k] for k in kinds})
    rows = rows.withColumns({f"_parts_{k.name}": F.when(F.col(f"_able_{k.name}"), F.split("_text", k.pattern, -1)) for k in kinds}
                            | {f"_hits_{k.name}": F.when(F.col(f"_able_{k.name}"), F.regexp_extract_all("_text", F.lit(k.pattern), 0)) for k in kinds})
    rows = rows.withColumns({f"_told_{k.name}": _described(k, f"_parts_{k.name}", f"_hits_{k.name}") for k in kinds})
    rows = rows.withColumns({f"_runs_{k.name}": _runs(f"_told_{k.name}") for k in kinds})
    rows = rows.withColumns({f"_starts_{k.name}": _starts(f"_runs_{k.name}") for k in kinds})
    rows = rows.withColumn("found", F.array_sort(F.concat(*(_placed(k, r, f"_runs_{k.name}", f"_starts_{k.name}", threshold) for r, k in enumerate(kinds)))))
    base = [k for k in kinds if k.base]
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda *names: F.filter("found", lambda x: x["kind"].isin(*names))
    return rows.select(
        "doc_id", *(F.size(of(k.name)).cast("long").alias(f"n_{k.name}") for k in base),
        F.sha2(joined(of(*(k.name for k in base))), 256).alias("base_sha256"),
        joined("found").alias("spans"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)).alias("score"), "found")
