"""Secret scans with DataFrame operations only.

Base rules are regular expressions; their offsets follow from the gaps that a split by the same expression leaves.
The method adds candidate strings whose sliding-window Shannon entropy is high for their character class. The window
moves by one character; its counts, and of the sum over counts c*log2(c) the terms, change for the leaving and the
entering character only. Strings on the allow-list (placeholders, UUIDs, sequences, single words) and strings that overlap a base
span are suppressed.

Defined results: a null text counts as empty; offsets count code points; a candidate of any length is folded in
time linear in its length; rows with equal texts get equal results; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudspark.llm.common import whole_text

KINDS = ("assign", "access", "hex", "entropy")
#: Expression, group whose length counts, least length, a literal that any match needs (checked first).
RULES = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, None),
    "access": (r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    "hex": (r"[0-9a-f]{24,}", 0, 24, None),
}
SPAN = "array<struct<start:int,kind:string,end:int,found:string>>"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Counts in a long; each has 64 // LONG bits and goes up to WINDOW.
LONG = 12
#: Least entropy in bits of a window of 20 characters, by class; strings of another class are not secrets.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.7, "grouped": 3.6}
#: Parts of up to ALLOWED characters that match are no secrets; in a longer one a match may be chance.
ALLOWED = 64
ALLOW = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|0000|1234567|abcdefg|qwerty"
#: Candidates that match as a whole are none.
WHOLE = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^sha(1|256|384|512)-"


def spans(text: Column, kind: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Array of (start, kind, end, found) of the matches whose group has ``least`` characters; matches are never empty."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.arrays_zip(gaps.alias("gap"), found.alias("found"), sized.alias("sized"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(F.length(x["found"]), F.lit(0))
        one = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["found"].alias("found")))
        return F.struct(end.alias("at"), F.when(F.length(x["sized"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(parts, start, step)["out"]).otherwise(start["out"])


def _term(n: int) -> float:
    return n * math.log2(n) if n > 0 else 0.0


def max_entropy(s: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy in bits of ``window`` consecutive characters of ``s``, which has at least as many and
    only characters from + to z.

    One fold over the characters as an array, read by place. The counts of a window are numbers of a few bits in a few longs;
    a step changes those of the character that leaves and of the one that enters, and the sum of c*log2(c) by what these
    two counts add. So the time is linear in the length.
    """
    cell, words = 64 // LONG, -(-(ord("z") - ord("+") + 1) // LONG)
    add = F.array(*[F.lit(_term(n + 1) - _term(n)) for n in range(window + 1)])

    def of(counts: Column, c: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, F.floor(c / LONG).cast("int")), ((c % LONG) * cell).cast("int")).bitwiseAND((1 << cell) - 1).cast("int")

    def change(v: Column, i: Column, c: Column, sign: int) -> Column:
        one = F.call_function("shiftleft", F.lit(1).cast("long"), ((c % LONG) * cell).cast("int"))
        return F.when(F.floor(c / LONG) == i, one * sign).otherwise(F.lit(0).cast("long"))

    def whole(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            into, out = F.get(codes, i), F.get(codes, i - window)
            counts, leaves = acc["counts"], F.coalesce(out, F.lit(-1))
            gone = F.when(leaves >= 0, -F.get(add, of(counts, leaves) - 1)).otherwise(F.lit(0.0))
            come = F.get(add, of(counts, into) - F.when(into == leaves, 1).otherwise(0))
            total = acc["sum"] + gone + come
            moved = F.transform(counts, lambda v, j: v + change(v, j, into, 1) + F.when(leaves >= 0, change(v, j, leaves, -1)).otherwise(F.lit(0).cast("long")))
            least = F.when(i >= window - 1, F.least(acc["least"], total)).otherwise(acc["least"])
            return F.struct(moved.alias("counts"), total.alias("sum"), least.alias("least"))

        start = F.struct(F.array_repeat(F.lit(0).cast("long"), words).alias("counts"), F.lit(0.0).alias("sum"), F.lit(_term(window)).alias("least"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda acc: acc["least"])

    codes = F.transform(F.filter(F.split(s, ""), lambda x: x != ""), lambda x: F.ascii(x) - ord("+"))
    least = F.transform(F.array(codes), whole)[0]  # bound by transform: codes are read at each step
    return F.lit(math.log2(window)) - least / window


def char_class(s: Column) -> Column:
    """hex, alnum, base64 or grouped (one letter case, digits and separators); null for strings without both a digit and a letter, which are words or numbers."""
    mixed = s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    return (
        F.when(~mixed, F.lit(None).cast("string"))
        .when(s.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(s.rlike("^[A-Za-z0-9]+$"), "alnum")
        .when(s.rlike("[a-z]") & s.rlike("[A-Z]"), "base64")
        .otherwise("grouped")
    )


def _parts(s: Column) -> Column:
    return F.filter(F.split(s, "[/=_-]+"), lambda x: x != "")


def is_random(s: Column) -> Column:
    """A part between separators that is on the allow-list is left out; the rest is judged. A grouped string counts
    without its separators, if parts that mix digits and letters make up half of it: others are names and dates."""
    rest = F.array_join(F.filter(_parts(s), lambda x: ~(x.rlike(ALLOW) & (F.length(x) <= ALLOWED)) & (F.lower(x) != "your")), "-")

    def mixed(x: Column) -> Column:
        return x.rlike("[0-9]") & x.rlike("[A-Za-z]")

    def pair(x: Column) -> Column:
        kind, joined = char_class(x), F.array_join(_parts(x), "")
        half = F.length(F.array_join(F.filter(_parts(x), mixed), "")) * 2 >= F.length(joined)
        return F.struct(F.when((kind != "grouped") | half, kind).alias("kind"), F.when(kind == "grouped", joined).otherwise(x).alias("text"))

    def judge(x: Column) -> Column:
        least = F.lit(None).cast("double")
        for k, v in THRESHOLDS.items():
            least = F.when(x["kind"] == k, F.lit(v)).otherwise(least)
        return F.when(x["kind"].isNull() | (F.length(x["text"]) < WINDOW), F.lit(False)).otherwise(F.round(max_entropy(x["text"]), 9) >= least)

    whole = s.rlike(WHOLE)
    text = F.when(s.rlike(ALLOW), rest).otherwise(s)  # bound by transform, else each use would compute it anew
    found = F.transform(F.transform(F.transform(F.array(text), lambda x: x), pair), judge)[0]
    return F.when(whole, F.lit(False)).otherwise(found)


def scan(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """(doc, spans): the row as a struct; all spans as an array of (start, kind, end), by start, then kind as in KINDS."""
    names = [c for c in docs.columns if keep_text or c != text_col]
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("doc"), whole_text(text_col).alias("text"))
    text = F.col("text")
    base = []
    for kind, (pattern, group, least, literal) in RULES.items():
        own = spans(text, kind, pattern, group, least)
        base.append(F.when(F.contains(text, F.lit(literal)), own).otherwise(F.array().cast(SPAN)) if literal else own)
    found = rows.withColumn("base", F.concat(*base)).withColumn("more", spans(text, "entropy", CANDIDATE))
    more = F.filter(
        "more",
        lambda x: F.when(F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])), F.lit(False)).otherwise(is_random(x["found"])),
    )
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    ordered = F.array_sort(F.transform(F.concat("base", more), lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return found.select("doc", F.transform(ordered, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""
    found = scan(docs.select("doc_id", "text"), keep_text=False)
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "entropy")
    return found.select(
        "doc.doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("entropy").alias("n_entropy"),
    )
