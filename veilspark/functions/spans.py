"""Detection as column expressions: no UDF, no shuffle, one row in and one row out.

Findings are an array of structs with half-open code-point offsets. Spark has no
"find all with positions", so a text is cut at the findings of a kind: marks are
put around them in one regex pass, the text is split at the marks, and running
lengths of the parts are the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import BLOCK, LABELLED, LABELS, MAX_TEXT, MAY_HOLD, PATTERNS, PREVIEW, PRIORITY, checked_literals, enabled_kinds

#: The mark, and what stands for it where a text holds it: noncharacters, which no pattern distinguishes.
MARK, STAND_IN = "﷐", "﷑"
#: A candidate: priority, negative length, start, end, kind, value. Plain array order is the order of precedence.
CANDIDATE = "array<struct<p:int,n:int,s:int,e:int,k:string,v:string>>"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def bound(value: Column, use) -> Column:
    """`use` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def escaped(literal: str) -> str:
    """A literal as a Java pattern, character by character."""
    return "".join(c if c.isalnum() or ord(c) > 127 else f"\\x{ord(c):02x}" for c in literal)


def cut(text: Column, pattern: str, labelled: bool) -> Column:
    """array<struct<s,e>> of the matches of a pattern."""
    put = f"$1{MARK}$2{MARK}" if labelled else f"{MARK}$0{MARK}"
    safe = F.when(F.contains(text, F.lit(MARK)), F.replace(text, F.lit(MARK), F.lit(STAND_IN))).otherwise(text)
    parts = F.split(F.regexp_replace(safe, F.lit(pattern), F.lit(put)), MARK, -1)
    none = F.array().cast("array<struct<s:int,e:int>>")

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + F.length(x)
        one = F.array(F.struct(a["at"].alias("s"), end.alias("e")))
        return F.struct(end.alias("at"), (~a["odd"]).alias("odd"), F.when(a["odd"], F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), none.alias("out"))
    return F.aggregate(parts, start, step, lambda a: a["out"])


def digits(v: Column) -> Column:
    return F.regexp_replace(v, r"\P{Nd}", "")


def luhn(value: Column) -> Column:
    """13 to 19 ASCII digits, not all equal, whose Luhn sum is a multiple of ten."""
    plain = F.regexp_replace(value, "[^0-9]", "")

    def valid(chars: Column) -> Column:
        doubled = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
        total = F.aggregate(doubled, F.lit(0), lambda a, x: a + x)
        return F.size(chars).between(13, 19) & (F.size(F.array_distinct(chars)) >= 2) & (total % 10 == 0)

    return bound(F.filter(F.split(F.reverse(plain), ""), lambda c: c != ""), valid)


def valid_iban(value: Column) -> Column:
    """15 to 34 characters without spaces; with the first four at the end, letters as 10 to 35, the remainder by 97 is one."""

    def valid(plain: Column) -> Column:
        turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
        fold = F.aggregate(
            F.filter(F.split(turned, ""), lambda c: c != ""),
            F.lit(0),
            lambda a, c: F.when(c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97),
        )
        return F.length(plain).between(15, 34) & plain.rlike("^[A-Z0-9]+$") & (fold == 1)

    return bound(F.replace(value, F.lit(" "), F.lit("")), valid)


OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
CHECKS = {
    "card": luhn,
    "iban": valid_iban,
    "ipv4": lambda v: v.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"),
    "phone": lambda v: F.length(digits(v)).between(9, 15) & ~v.rlike(r"^\p{Nd}{4}[.-]\p{Nd}{2}[.-]\p{Nd}{2}$"),
}


def of_kind(text: Column, kind: str, pattern: str, check=None, gate: Column | None = None) -> Column:
    """Candidates of one kind. A failed check drops a candidate; shorter ones in its place are not tried."""

    def candidate(m: Column) -> Column:
        v = F.substr(text, m["s"] + 1, m["e"] - m["s"])
        return F.struct(F.lit(PRIORITY[kind]).alias("p"), (m["s"] - m["e"]).alias("n"), m["s"], m["e"], F.lit(kind).alias("k"), v.alias("v"))

    out = F.transform(cut(text, pattern, kind in LABELLED), candidate)
    if check:
        out = F.filter(out, lambda c: check(c["v"]))
    none = F.array().cast(CANDIDATE)
    return F.when(gate, out.cast(CANDIDATE)).otherwise(none) if gate is not None else out.cast(CANDIDATE)


def candidates(text: Column, enabled: list[str] | None = None, literals: list[str] | None = None) -> Column:
    """All candidates of the enabled kinds; only their expressions are built. Null texts have none."""
    kinds, literals = enabled_kinds(enabled), checked_literals(literals)
    text = F.coalesce(text, F.lit(""))
    found = []
    for kind, pattern in PATTERNS.items():
        if kind in kinds:
            may = MAY_HOLD[kind]
            gate = F.contains(text, F.lit(may)) if len(may) == 1 else text.rlike(may)
            found.append(of_kind(text, kind, pattern, CHECKS.get(kind), gate))
    if "custom" in kinds:
        for literal in literals:
            pattern = "(?iu)" + escaped(literal)
            found.append(of_kind(text, "custom", pattern, None, text.rlike(pattern)))
    return F.concat(*found) if found else F.array().cast(CANDIDATE)


def resolved(cands: Column) -> Column:
    """Greedy by precedence (priority, longer, earlier): a candidate stays if it meets none that stayed. Ordered by start."""
    none = F.array().cast(CANDIDATE)
    meets = lambda m: lambda q: (m["s"] < q["e"]) & (q["s"] < m["e"])
    fold = F.aggregate(F.array_sort(cands), none, lambda acc, m: F.when(F.exists(acc, meets(m)), acc).otherwise(F.concat(acc, F.array(m))))
    spans = F.transform(F.when(F.size(cands) > 1, fold).otherwise(cands), lambda m: F.struct(m["s"].alias("start"), m["e"].alias("end"), m["k"].alias("kind"), m["v"].alias("value")))
    return F.transform(F.array_sort(spans), lambda m: F.struct(m["kind"], m["start"], m["end"], m["value"])).cast(SPAN)


def folded(value: Column) -> Column:
    """A value without case. Upper-casing first folds letters such as sharp s to what they are the same as."""
    return F.lower(F.upper(value))


def redacted(text: Column, spans: Column, mode: str = "labels") -> Column:
    """The text with its spans replaced: by "[KIND_n]", n counting a kind's different values by first appearance, or by one block."""
    if mode not in ("labels", "blocks"):
        raise ValueError("mode is labels or blocks")
    if mode == "blocks":
        value = lambda m, seen: F.lit(BLOCK)
    else:
        key = lambda m: F.concat(m["kind"], F.lit(MARK), folded(m["value"]))

        def value(m: Column, seen: Column) -> Column:
            upto = F.slice(seen, F.lit(1), F.array_position(seen, key(m)).cast("int"))
            n = F.size(F.filter(upto, lambda s: F.startswith(s, F.concat(m["kind"], F.lit(MARK)))))
            return F.concat(F.lit("["), F.upper(m["kind"]), F.lit("_"), n.cast("string"), F.lit("]"))

    keys = F.array_distinct(F.transform(spans, key)) if mode == "labels" else F.array().cast("array<string>")

    def whole(seen: Column) -> Column:
        def piece(m: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)
            return F.concat(F.substr(text, before + 1, m["start"] - before), value(m, seen))

        last = F.element_at(spans, -1)["end"]
        return F.concat(F.array_join(F.transform(spans, piece), ""), F.substr(text, last + 1))

    return F.when(F.size(spans) > 0, bound(keys, whole)).otherwise(text)


def label_of(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), kind)


def public(spans: Column) -> Column:
    """Findings without their values."""
    return F.transform(
        spans,
        lambda m: F.struct(m["kind"].alias("kind"), label_of(m["kind"]).alias("label"), m["start"].alias("start"), m["end"].alias("end"), (m["end"] - m["start"]).alias("length"), F.lit(PREVIEW).alias("preview")),
    )


def counts(spans: Column) -> Column:
    """map<kind, number> of the kinds that were found."""
    kinds = F.array_sort(F.array_distinct(F.transform(spans, lambda m: m["kind"])))
    return F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, F.size(F.filter(spans, lambda m: m["kind"] == k)))))


def blocks_of(preview: Column) -> Column:
    """Labels turned to blocks in a text redacted with labels."""
    return F.regexp_replace(preview, r"\[(" + "|".join(k.upper() for k in LABELS) + r")_[0-9]+\]", BLOCK.replace("[", "\\[").replace("]", "\\]"))


def too_long(text: Column) -> Column:
    return F.length(text) > MAX_TEXT

