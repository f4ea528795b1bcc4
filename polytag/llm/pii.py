"""Personal data: candidate spans, boosted trees, calibrated thresholds.  DataFrame functions only.

Base spans (email, ip, card, phone) come from fixed patterns with checks.  Beside them, high-recall generators
propose overlapping candidates: e-mail-like spans with written-out or spaced @ and dots, tight and loose
runs of seven digits or more.  Every candidate has a few small categorical features of its format (digits, groups, separators,
signs) and its context (neighbouring characters, a keyword before it).

Training is weakly supervised: a candidate whose own string passes a kind's base check is a positive of that kind, one that
does not is a negative, and the feature that decides the check (the leading +, the @ sign) is withheld from that kind's model, so
trees learn what such a span looks like otherwise.  All candidates of the corpus are counted per feature
combination by one aggregation, a written table; its ``COMBINATIONS`` most frequent combinations come to the driver as weighted
training rows, where gradient-boosted depth-2 trees are fitted.  Documents with crc32(doc_id) mod 4 = 2 are left out of fitting and
calibrate each kind's threshold: the lowest score at which the smoothed precision of all candidates above it is at least ``PRECISION``.
For that all combinations, not only those fitted on, are scored on Spark and summed per score; the driver
reads the sums one after the other, from the highest score, and keeps only the totals.
The trees become one CASE expression, so scoring is a projection.  A candidate that passes and does not overlap a base
span is added under its kind.

Cases: a null text is empty; an empty text has no span; without candidates (or of one class only) the model adds nothing; rows
are independent, so ties, repeats and null ids change nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch, crc_rest

KINDS = ("email", "ip", "card", "phone")
COMBINATIONS = 5_000
PRECISION = 0.98
ROUNDS, RATE, LEAST_WEIGHT = 24, 0.3, 5.0

# fixed values: the base patterns.  Their repetitions are possessive and a local part starts only where its run
# of characters starts (or a match ended), which gives the same leftmost matches in linear time.
_PATTERN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: a text without it has no match
_SIGN = {"email": "@", "ip": ".", "card": None, "phone": "+"}

_GENERATORS = {
    "mail": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:@|[\[(]\x20?at\x20?[\])])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[A-Za-z0-9-]++)++",
    "tight": r"\+?[0-9](?:[\x20.-]?[0-9]){6,}+",
    "loose": r"[+(]{0,2}[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+",
}
#: fixed values: words before a span that tell its kind
_CONTEXT = {
    1: "phone|tel|call|mobile|cell|fax|whatsapp|telefon|téléphone|teléfono|móvil",
    2: "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta",
    3: "ip|host|server|addr|address|client",
    4: "mail|contact|write|kontakt|courriel|correo",
    5: "order|invoice|isbn|issn|id|ref|nr|no|version|page",
}
FEATURES = ("generator", "digits", "groups", "longest", "plus", "paren", "dots", "gaps", "before", "after", "context", "sign", "tail")
_WITHHELD = {"email": ("sign",), "ip": (), "card": (), "phone": ("plus",)}


def located(pieces: Column, found: Column) -> Column:
    """Array of (text, start, end) in code points from the pieces between matches and the matches themselves."""
    step = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<text:string,start:int,end:int>>)").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        one = F.struct(x["m"].alias("text"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    both = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    return F.aggregate(both, step, add, lambda acc: acc["out"])


def matched(df: DataFrame, name: str, pattern: str, sign: str | None) -> DataFrame:
    """Adds column ``name``: the located matches of the pattern in ``text`` (empty array if none)."""
    none = F.expr("cast(array() as array<struct<text:string,start:int,end:int>>)")
    pieces = F.split("_text", pattern, -1)
    if sign:
        pieces = F.when(F.contains("_text", F.lit(sign)), pieces)
    df = df.withColumn("_pieces", pieces)
    found = F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
    return df.withColumn(name, F.when(F.size("_pieces") > 1, located(F.col("_pieces"), found)).otherwise(none)).drop("_pieces")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets(m: Column) -> Column:
    part = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))


#: what a match must pass, beside its pattern
_PASSES: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": _octets,
    "card": lambda m: F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds email, ip, card, phone: arrays of (text, start, end)."""
    df = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    for kind in KINDS:
        df = matched(df, kind, _PATTERN[kind], _SIGN[kind])
        passes = _PASSES[kind]
        df = df.withColumn(kind, F.filter(kind, lambda x: passes(x["text"])))  # noqa: B023
    return df


def _class(c: Column) -> Column:
    return (
        F.when(c.isNull() | (c == "") | (c == "\n"), 0).when(c == " ", 1).when(c.rlike("^[0-9]"), 3).when(c.rlike(r"^[\p{L}_]"), 2).otherwise(4)
    )


def _features(x: Column, generator: int) -> Column:
    m, text = x["text"], F.col("_text")
    before = F.when(x["start"] > 0, F.substring(text, x["start"], F.lit(1)))
    after = F.substring(text, x["end"] + 1, F.lit(1))
    lead = F.lower(F.substring(text, F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24))))
    context = F.lit(0)
    for n, w in reversed(_CONTEXT.items()):
        context = F.when(lead.rlike(rf"(?<!\p{{L}})(?:{w})(?!\p{{L}})"), n).otherwise(context)
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: F.length(g) > 0)
    count = lambda chars: F.length(m) - F.length(F.regexp_replace(m, chars, ""))
    label = F.regexp_extract(m, r"([A-Za-z0-9-]*)$", 1)
    values = {
        "generator": F.lit(generator), "digits": F.least(count("[0-9]"), F.lit(20)), "groups": F.least(F.size(groups), F.lit(8)),
        "longest": F.least(F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), F.lit(20)),
        "plus": F.startswith(m, F.lit("+")).cast("int"), "paren": F.contains(m, F.lit("(")).cast("int"), "dots": F.least(count("[.]"), F.lit(4)),
        "gaps": F.least(count(r"[\x20/-]"), F.lit(6)), "before": _class(before), "after": _class(after), "context": context,
        "sign": F.contains(m, F.lit("@")).cast("int"), "tail": F.when(label.rlike("^[A-Za-z]+$"), F.least(F.length(label), F.lit(6))).otherwise(0),
    }
    return F.struct(*(values[f].cast("int").alias(f) for f in FEATURES))


def _own_kind(m: Column, generator: str) -> Column:
    """The kind whose base check the whole string passes, or null."""
    kinds = ("email",) if generator == "mail" else ("ip", "phone", "card")
    out = F.lit(None).cast("string")
    for kind in reversed(kinds):
        out = F.when(m.rlike(rf"^{_PATTERN[kind]}$") & _PASSES[kind](m), kind).otherwise(out)
    return out


def candidates(df: DataFrame) -> DataFrame:
    """Adds ``candidates``: array of (start, end, kind its own string passes, features)."""
    for n, (name, pattern) in enumerate(_GENERATORS.items()):
        df = matched(df, f"_{name}", pattern, None)
        df = df.withColumn(f"_{name}", F.transform(f"_{name}", lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), _own_kind(x["text"], name).alias("passes"), _features(x, n).alias("f"))))  # noqa: B023
    return df.withColumn("candidates", F.concat(*(f"_{name}" for name in _GENERATORS))).drop(*(f"_{name}" for name in _GENERATORS))


# ---- boosted trees on weighted feature combinations (driver, bounded) ----

Tree = tuple  # (feature, cut, left, right) with subtrees or leaf values; left: value <= cut


def _leaf(g: float, h: float) -> float:
    return -RATE * g / (h + 1.0)


def _grow(rows: list[tuple[tuple[int, ...], float, float]], depth: int, usable: tuple[int, ...]) -> Tree | float:
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = None
    if depth:
        for f in usable:
            total: dict[int, list[float]] = {}
            for x, a, b in rows:
                t = total.setdefault(x[f], [0.0, 0.0])
                t[0] += a
                t[1] += b
            ga = ha = 0.0
            for v in sorted(total)[:-1]:
                ga, ha = ga + total[v][0], ha + total[v][1]
                gain = ga * ga / (ha + 1) + (g - ga) ** 2 / (h - ha + 1) - g * g / (h + 1)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, v)
    if best is None or best[0] <= 1e-6:
        return _leaf(g, h)
    _, f, v = best
    left, right = [r for r in rows if r[0][f] <= v], [r for r in rows if r[0][f] > v]
    return (f, v, _grow(left, depth - 1, usable), _grow(right, depth - 1, usable))


def _value(tree: Tree | float, x: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(rows: list[tuple[tuple[int, ...], float, float]], usable: tuple[int, ...]) -> tuple[float, list]:
    """rows (features, positives, negatives) -> (base score, trees) of a logistic boosted model; no trees if one class lacks."""
    rows = [r for r in rows if r[1] + r[2] > 0]
    pos, neg = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if pos < LEAST_WEIGHT or neg <= 0:
        return -10.0, []
    base = math.log(pos / neg)
    score = [base] * len(rows)
    trees = []
    for _ in range(ROUNDS):
        work = []
        for (x, p, n), s in zip(rows, score, strict=True):
            q = 1 / (1 + math.exp(-s))
            work.append((x, (p + n) * q - p, (p + n) * q * (1 - q)))
        tree = _grow(work, 2, usable)
        if not isinstance(tree, tuple):
            break
        trees.append(tree)
        score = [s + _value(tree, r[0]) for s, r in zip(score, rows, strict=True)]
    return base, trees


def _lowest(falling: Iterable[tuple[float, float, float]], precision: float) -> float:
    """The threshold from (score, positives, negatives) by falling score."""
    best, p, n = math.inf, 0.0, 0.0
    for s, a, b in falling:
        p, n = p + a, n + b
        if (p + 0.5) / (p + n + 1) >= precision:
            best = s
    return best


def threshold(scored: list[tuple[float, float, float]], precision: float = PRECISION) -> float:
    """Lowest score at which (positives + 1/2) / (all + 1) of the candidates at or above it is ``precision``; inf if none."""
    by_score: dict[float, list[float]] = {}
    for s, a, b in scored:
        t = by_score.setdefault(s, [0.0, 0.0])
        t[0] += a
        t[1] += b
    return _lowest(((s, *by_score[s]) for s in sorted(by_score, reverse=True)), precision)


def _tree_column(tree: Tree | float, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(f[FEATURES[tree[0]]] <= tree[1], _tree_column(tree[2], f)).otherwise(_tree_column(tree[3], f))


def _score(base: float, trees: list, f: Column) -> Column:
    return sum((_tree_column(x, f) for x in trees), F.lit(base))


def _own(kind: str, generator: Column) -> Column:
    return generator == 0 if kind == "email" else generator > 0


def calibrated(table: DataFrame, models: dict[str, tuple[float, list, float]]) -> dict[str, tuple[float, list, float]]:
    """The models with their thresholds from the held-out counts of all combinations."""
    parts = []
    for kind, (base, trees, _) in models.items():
        if trees:
            others = sum((F.col(f"{k}_true") for k in (*KINDS, "") if k != kind), F.lit(0))
            # rounded, so that sums which differ in the last bits only are one score (added_spans allows for it)
            score = F.round(_score(base, trees, F.struct(*FEATURES)), 9)
            parts.append(table.filter(_own(kind, F.col("generator"))).select(F.lit(kind).alias("kind"), score.alias("score"), F.col(f"{kind}_true").alias("p"), others.alias("n")))
    if not parts:
        return models
    sums = reduce(DataFrame.unionByName, parts).groupBy("kind", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    out = dict(models)
    for kind, rows in groupby(sums.orderBy("kind", F.desc("score")).toLocalIterator(), lambda r: r["kind"]):
        out[kind] = (*models[kind][:2], _lowest(((r["score"], float(r["p"]), float(r["n"])) for r in rows), PRECISION))
    return out


def train(found: DataFrame, combinations: int = COMBINATIONS) -> dict[str, tuple[float, list, float]]:
    """found (doc_id, candidates) -> per kind (base, trees, threshold)."""
    one = found.select((F.coalesce(crc_rest(F.col("doc_id"), 4), F.lit(0)) == 2).alias("held"), F.explode("candidates").alias("c"))
    counts = [F.sum((F.col("held") == h).cast("long") * (F.coalesce(F.col("c.passes"), F.lit("")) == k).cast("long")).alias(f"{k}_{h}".lower()) for k in (*KINDS, "") for h in (False, True)]
    table = one.groupBy(*(F.col(f"c.f.{f}").alias(f) for f in FEATURES)).agg(F.count(F.lit(1)).alias("n"), *counts)
    table = Scratch(found.sparkSession, "pii").write(table, "combinations")
    rows = [r.asDict() for r in table.orderBy(F.desc("n"), *FEATURES).limit(combinations).collect()]
    models = {}
    for kind in KINDS:
        mine = [r for r in rows if (r["generator"] == 0) == (kind == "email")]
        others = [k for k in (*KINDS, "") if k != kind]
        x = [tuple(r[f] for f in FEATURES) for r in mine]
        fit = [(a, float(r[f"{kind}_false"]), float(sum(r[f"{k}_false"] for k in others))) for a, r in zip(x, mine, strict=True)]
        base, trees = boost(fit, tuple(i for i, f in enumerate(FEATURES) if f not in _WITHHELD[kind]))
        models[kind] = (base, trees, math.inf)
    return calibrated(table, models)


def added_spans(models: dict[str, tuple[float, list, float]]) -> Column:
    """Array of (kind, start, end): candidates that pass their kind's threshold, overlap no base span and no better candidate."""
    none = F.expr("cast(array() as array<struct<margin:double,kind:string,start:int,end:int>>)")
    passing = []
    for kind in KINDS:
        base, trees, cut = models[kind]
        if not trees or math.isinf(cut):
            continue
        right = lambda c: _own(kind, c["f"]["generator"])  # noqa: E731, B023
        margin = lambda c: _score(base, trees, c["f"]) - cut  # noqa: E731, B023
        scored = F.transform(F.filter("candidates", right), lambda c: F.struct(margin(c).alias("margin"), F.lit(kind).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))  # noqa: B023
        passing.append(F.filter(scored, lambda c: c["margin"] >= -1e-9))
    if not passing:
        return none
    base = F.concat(*KINDS)
    free = F.filter(F.concat(*passing), lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))

    def take(acc: Column, c: Column) -> Column:
        return F.when(F.exists(acc, lambda a: (a["start"] < c["end"]) & (c["start"] < a["end"])), acc).otherwise(F.concat(acc, F.array(c)))

    best_first = F.array_sort(free, lambda a, b: F.when(a["margin"] > b["margin"], -1).when(a["margin"] < b["margin"], 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(F.when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).otherwise(0)))
    return F.aggregate(best_first, none, take)


def _written(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))


def _slim(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and candidates as positions and features, without texts."""
    df = candidates(base_spans(docs.select(F.col("doc_id").cast("long"), "text")))
    return df.select("doc_id", *(F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(k) for k in KINDS), "candidates")


def personal_data(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, base spans per kind, ``added`` spans (kind, start, end); one row per document."""
    found = Scratch(docs.sparkSession, "pii").write(_slim(docs), "spans")
    return found.withColumn("added", added_spans(train(found))).drop("candidates")


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans as text."""
    more = lambda k: F.transform(F.filter("added", lambda a: a["kind"] == k), lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end")))
    base = F.concat_ws(",", F.concat(*(_written(F.col(k), k) for k in KINDS)))
    every = F.concat_ws(",", F.concat(*(_written(F.array_sort(F.concat(F.col(k), more(k))), k) for k in KINDS)))
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), every.alias("spans")
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets ([EMAIL], ...); n_chars, if there, is recounted.

    Of overlapping spans the earlier (then longer) one names the replacement, which covers both.  A text without spans stays as it is.
    """
    models = train(Scratch(docs.sparkSession, "pii").write(_slim(docs), "spans"))
    kept = [F.col(c) for c in docs.columns]
    # the work columns are kept apart from columns of the same name in the input
    inner = docs.select(F.struct(*kept).alias("_row"), F.col("text").cast("string").alias("text"))
    df = candidates(base_spans(inner)).withColumn("_added", added_spans(models))
    span = lambda k: F.transform(k, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), F.lit(k.upper()).alias("kind")))
    learnt = F.transform("_added", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), F.upper(x["kind"]).alias("kind")))
    df = df.withColumn("_spans", F.array_sort(F.concat(*(span(k) for k in KINDS), learnt)))
    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        between = F.substring("_text", acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        fresh = F.concat(acc["out"], F.array(between, F.concat(F.lit("["), x["kind"], F.lit("]"))))
        return F.struct(F.greatest(acc["at"], -x["back"]).alias("at"), F.when(x["start"] < acc["at"], acc["out"]).otherwise(fresh).alias("out"))

    joined = F.aggregate("_spans", begin, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring("_text", acc["at"] + 1, F.length("_text"))))
    df = df.withColumn("_new", F.when(F.size("_spans") > 0, joined).otherwise(F.col("text")))
    out = []
    for c, t in docs.dtypes:
        if c == "text":
            out.append(F.col("_new").alias(c))
        elif c == "n_chars":
            out.append(F.when(F.size("_spans") > 0, F.length("_new").cast(t)).otherwise(F.col("_row")[c]).alias(c))
        else:
            out.append(F.col("_row")[c].alias(c))
    return df.select(*out)
