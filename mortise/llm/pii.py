"""Operator 5: personal data in texts, with DataFrame functions only.

Base spans are what four patterns with checks find (email, ip, card, phone): leftmost and non-overlapping for each kind.
They always stay. Further spans come from candidate gradient boosting:

1. Generators with high recall propose spans, overlapping ones too: those that the base patterns find, and the forms that they
   cannot see or refuse: addresses with "(at)", "[dot]" or " at ... dot ", quads with disguised dots, cards of 13 to 15 digits or with
   other separators, telephone numbers without a plus.
2. Each proposal has format features (the kind's check on its plain form, digit groups, a date's shape) and context features (a cue word
   of its kind before it, what touches its ends). What tells the base form from a disguised one (the plus, the plain @ and dot,
   the number of a card's digits) is hidden, so that trees learnt on base forms say something about the others.
3. Boosted trees of depth 2 are fitted to the logistic loss. Labels are weak: 1 for a base span; 0 for a proposal whose
   plain form fails its kind's check, that is torn from a longer token, overlaps a base span, or has neither a cue word before it nor a disguise;
   the rest has no label and is what the trees judge. Features are discrete, so the corpus comes
   down to counts for each feature vector, over all documents; there are at most 4 * 2^len(FEATURES) vectors, and only those that occur.
4. For each kind, a threshold is calibrated on the documents that fitting left out (a fifth, by hash): the lowest
   score from which labelled proposals are personal in PRECISION of cases; without 20 of them no span is added for that kind.
5. The trees are compiled into one SQL expression. Chosen spans that overlap a base span or an
   earlier chosen one of their kind are dropped.

Offsets are code points, end exclusive. A pattern's matches and the gaps between them (a split on the same
pattern) give the offsets. Patterns are possessive and start at the edge of a run, which finds the same matches in
linear time. Null and empty texts have no spans. Every row is judged by itself, so repeated rows and ids, and null ids (which fit,
but calibrate nothing), give a row each. Only doc_id and text are read: extra columns of any name do no harm. An empty table gives an empty result.
Of spans that overlap, base ones win, then earlier kinds in the order of KINDS, then the earlier start.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from mortise.session import materialise

KINDS = ("email", "ip", "card", "phone")
# The base patterns, made possessive; \G admits a start right behind the last match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?: ?(?:@|[(\[{]at[)\]}]) ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[{]dot[)\]}]) ?[A-Za-z0-9-]++)++| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\.|[(\[{]\.[)\]}]| ?[(\[{]dot[)\]}] ?| dot )[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}+[0-9])++",
    "phone": r"(?<![0-9A-Za-z])\+?+\(?[0-9][\x20().0-9-]{5,22}[0-9]",
}
NEEDS = {"email": r"@|[(\[{]at[)\]}]| dot ", "ip": r"[0-9](?:\.|[(\[{]\.|[(\[{ ]{1,2}dot)", "card": "[0-9]", "phone": "[0-9]"}
_CUE_END = r"\p{L}{0,5}(?:[\s:.#-]+(?:number|address|no|nr|is|me|us|at|on)){0,3}[\s:.#=(-]{0,4}$"
# Words that announce a span of a kind.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel)" + _CUE_END,
    "ip": r"(?i)\b(?:ip|host|server|address|gateway|node|login)" + _CUE_END,
    "card": r"(?i)\b(?:card|karte|carte|tarjeta|visa|mastercard|amex|credit)" + _CUE_END,
    "phone": r"(?i)\b(?:tel|phone|fon|call|fax|mobile|cell|sms|whatsapp)" + _CUE_END,
}
DISGUISE = {"email": r"[(\[{](?:at|dot)[)\]}]", "ip": r"[(\[{]| dot "}
FEATURES = ("cue", "touches_left", "touches_right", "check", "groups", "date")
PRECISION, LEAST = 0.98, 20
ROUNDS, RATE = 40, 0.3


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _matches(text: Column, pattern: str, needs: str, kind: str) -> Column:
    """array<struct<kind, start, end, s, left, right>>: what pattern finds, with the text around it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    shape = "array<struct<kind:string,start:int,end:int,s:string,left:string,right:string>>"

    def spans(g: Column) -> Column:
        def of(m: Column) -> Column:
            step = F.transform(m, lambda x, i: F.struct(F.char_length(F.get(g, i)).alias("gap"), F.char_length(x).alias("n"), x.alias("s"), F.right(F.get(g, i), F.lit(32)).alias("left"), F.left(F.get(g, i + 1), F.lit(2)).alias("right")))
            start = F.struct(F.lit(0).alias("at"), F.array().cast(shape).alias("out"))

            def add(acc: Column, x: Column) -> Column:
                a, b = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["n"]
                one = F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"), x["s"].alias("s"), x["left"].alias("left"), x["right"].alias("right"))
                return F.struct(b.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

            return F.aggregate(step, start, add, lambda acc: acc["out"])

        return _let(found, of)

    return F.when(text.rlike(needs), _let(gaps, spans)).otherwise(F.array().cast(shape))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    """Whether the digits of s pass the Luhn check."""
    each = F.transform(F.split(F.reverse(_digits(s)), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(F.filter(each, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def _octets(s: Column) -> Column:
    return F.forall(F.split(s, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"))


def _valid(kind: str, x: Column) -> Column:
    n = F.char_length(_digits(x["s"]))
    return {
        "email": lambda: F.lit(True), "ip": lambda: _octets(x["s"]), "phone": lambda: n.between(8, 15),
        "card": lambda: F.when(n.between(16, 19), _luhn(x["s"])).otherwise(False),
    }[kind]()


def _base(text: Column) -> list[Column]:
    # a lambda's parameters are counted by filter(), so each kind has a closure, not a default
    check = lambda k: lambda x: _valid(k, x)
    return [F.filter(_matches(text, BASE[k], NEEDS[k], k), check(k)) for k in KINDS]


def _plain(kind: str, s: Column) -> Column:
    """A proposal without its disguise: "a (at) b dot c" as "a@b.c"."""
    dotted = F.regexp_replace(s, r" ?[(\[{](?:dot|\.)[)\]}] ?| dot ", ".")
    return {"email": lambda: F.regexp_replace(F.regexp_replace(dotted, r" ?[(\[{]at[)\]}] ?| at ", "@"), " ", ""), "ip": lambda: dotted}.get(kind, lambda: s)()


def _check(kind: str, s: Column) -> Column:
    """Whether a proposal's plain form can be personal data of its kind."""
    n = F.char_length(_digits(s))
    return {
        "email": lambda: _plain(kind, s).rlike(r"[A-Za-z0-9][^@]*+@[^@]++(?<=\.[A-Za-z]{2,24})$"), "ip": lambda: _octets(_plain(kind, s)), "phone": lambda: n.between(8, 15),
        "card": lambda: F.when(n.between(13, 19), _luhn(s)).otherwise(False),
    }[kind]()


def _flags(kind: str, x: Column) -> dict[str, Column]:
    return {
        "cue": x["left"].rlike(CUES[kind]), "touches_left": x["left"].rlike(r"[\p{L}0-9_=#\"'.-]$"), "touches_right": x["right"].rlike(r"^([\p{L}0-9_\"']|[.-][0-9])"),
        "check": _check(kind, x["s"]), "groups": x["s"].rlike(r"[0-9][\x20().-]+[0-9]"), "date": x["s"].rlike(r"^[12][0-9]{3}([.-][01]?[0-9][.-][0-3]?[0-9]| ?- ?[12][0-9]{3})$"),
    }


def proposals(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of the base spans), loose (array of proposals; each with its vector and weak label: 1, 0, or null where the trees decide)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    found = rows.select(
        "doc_id", F.explode(F.array(F.struct(
            F.flatten(F.array(*_base(text))).alias("base"), *(_matches(text, LOOSE[k], NEEDS[k], k).alias(k) for k in KINDS),
        ))).alias("x"))
    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["kind"] == b["kind"])
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])

    def marked(kind: str):  # noqa: ANN202
        def of(c: Column) -> Column:
            flags, base = _flags(kind, c), F.col("x.base")
            torn = c["left"].rlike(r"[\p{L}0-9_]$") | c["right"].rlike(r"^[\p{L}0-9_]")  # a piece of a longer token
            hinted = flags["cue"] | c["s"].rlike(DISGUISE[kind]) if kind in DISGUISE else flags["cue"]
            refused = torn | ~flags["check"] | ~hinted | F.exists(base, lambda b: meets(b, c))
            label = F.when(F.exists(base, lambda b: same(b, c)), 1).when(refused, 0)
            vector = F.array_join(F.array(*(F.when(flags[f], "1").otherwise("0") for f in FEATURES)), "")
            return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), vector.alias("vector"), label.alias("label"))

        return of

    thin = F.transform("x.base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    return found.select("doc_id", thin.alias("base"), F.flatten(F.array(*(F.transform(f"x.{k}", marked(k)) for k in KINDS))).alias("loose"))


def _boost(x: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> list[tuple[int, int, list[float]]]:
    """Depth-2 trees (feature, feature, four leaf values) on the counts of each vector, by Newton steps."""
    f, trees = np.zeros(len(x)), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-f))
        g, h = pos * (1 - p) - neg * p, (pos + neg) * p * (1 - p)
        best = (-1.0, 0, 0, None)
        for a in range(x.shape[1]):
            for b in range(a, x.shape[1]):
                leaf = x[:, a] * 2 + x[:, b]
                sg, sh = np.bincount(leaf, g, 4), np.bincount(leaf, h, 4) + 1.0
                if (gain := float((sg**2 / sh).sum())) > best[0]:
                    best = (gain, a, b, (RATE * sg / sh).round(6).tolist())
        _, a, b, values = best
        trees.append((a, b, values))
        f += np.array(values)[x[:, a] * 2 + x[:, b]]
    return trees


def fit(found: DataFrame) -> dict[str, tuple[list, float]]:
    """For each kind: its trees, and the score from which a proposal is redacted (infinite: never)."""
    each = found.select(F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False)).alias("out"), F.explode("loose").alias("c")).where("c.label is not null")
    counts = each.groupBy("out", "c.kind", "c.vector", "c.label").count().collect()  # bounded: see the module's step 3
    model = {}
    for k in KINDS:
        table: dict = {}
        for r in counts:
            if r["kind"] == k:
                table.setdefault(r["vector"], np.zeros(4))[(2 if r["out"] else 0) + r["label"]] += r["count"]
        if not table:
            model[k] = ([], float("inf"))
            continue
        x = np.array([[int(c) for c in v] for v in sorted(table)])
        n = np.array([table[v] for v in sorted(table)])
        trees = _boost(x, n[:, 1], n[:, 0])
        score = sum(np.array(t[2])[x[:, t[0]] * 2 + x[:, t[1]]] for t in trees)
        at = float("inf")
        for s in np.unique(score)[::-1]:  # from the surest down, while what is above stays precise
            good, bad = n[score >= s, 3].sum(), n[score >= s, 2].sum()
            if good + bad and good / (good + bad) < PRECISION:
                break
            at = float(s) if good + bad >= LEAST else at
        model[k] = (trees, at)
    return model


def _score(vector: Column, trees: list) -> Column:
    bit = lambda i: F.substring(vector, i + 1, 1) == "1"
    total = F.lit(0.0)
    for a, b, v in trees:
        total = total + F.when(bit(a) & bit(b), v[3]).when(bit(a), v[2]).when(bit(b), v[1]).otherwise(v[0])
    return total


def _passes(kind: str, trees: list, at: float):  # noqa: ANN202
    return lambda c: (c["kind"] == kind) & c["label"].isNull() & (_score(c["vector"], trees) >= at - 1e-9)


def find(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, base and spans (arrays of kind, start, end: base spans, and those with what the model adds)."""
    found = materialise(proposals(docs), "proposals")
    model = fit(found)
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    chosen = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    for k in KINDS:
        trees, at = model[k]
        if trees and at < float("inf"):
            sure = F.filter("loose", _passes(k, trees, at))
            chosen = F.concat(chosen, F.transform(sure, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
    # earlier kinds win among chosen spans that overlap
    apart = F.aggregate(chosen, F.array().cast("array<struct<kind:string,start:int,end:int>>"), lambda acc, c: F.when(F.exists(acc, lambda o: meets(o, c)) | F.exists("base", lambda o: meets(o, c)), acc).otherwise(F.concat(acc, F.array(c))))
    rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k)
    order = lambda a: F.transform(F.array_sort(F.transform(a, lambda c: F.struct(rank(c["kind"]).alias("r"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return found.select("doc_id", order(F.col("base")).alias("base"), order(F.concat("base", apart)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """find()'s rows with spans as text: n_<kind> (base spans), base_sha256, spans, n_spans."""
    text = lambda a: F.array_join(F.transform(a, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")
    of = lambda k: lambda c: c["kind"] == k
    base = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *base, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
