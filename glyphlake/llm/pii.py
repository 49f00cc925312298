"""Personal data by candidate gradient boosting, in DataFrame operations only.

Generators with high recall propose spans, which may overlap: the four base patterns, and beside them local
telephone numbers, spelled-out mail addresses, IPv6 addresses and long mixed keys. Matches are turned into code
point offsets by splitting the text at the same pattern. Every candidate gets a cell: its generator and binned
format and context features (at most 2 ** 11 cells). Its weak label comes from evidence that the cell does not
hold: the digits and letters of the match itself (numbering plans, issuer digits, randomness) and which word
announces it. One aggregation counts candidates and labels by cell and fold; the fold is a hash of the match, so
copies of one string are never on both sides. Boosted trees of depth two are fitted to that bounded table on the
driver, one model a fold; a cell's score is the lower of the two. Each generator's threshold is the lowest score at which the
labels of what it selects hold the precision in both folds, and the cells above it go back into the plan as a literal set. Valid
base matches always stay.

Lists of a text's candidates are walked by `_scan`, whose cost grows with n ** 1.5 and not with the square.

The patterns run in linear time: a match can begin only where a run of its characters begins or the last match
ended (\\G), and the loops are possessive, which changes no match because what follows can't be in the loop.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

KINDS = ("email", "ip", "card", "phone", "secret")
_MAIL = "[A-Za-z0-9._%+-]"
#: (kind, pattern, cheap test a text must pass before the pattern is tried).
GENERATORS: tuple[tuple[str, str, str], ...] = (
    ("email", rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", "[0-9]"),
    ("card", r"[0-9](?:[\x20-]?+[0-9])++", "[0-9]"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    ("phone", r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", "[0-9]{4}"),
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\s?[\[(]\s?at\s?[\])]\s?[a-z0-9-]{1,63}(?:(?:\s?[\[(]\s?dot\s?[\])]\s?|\.)[a-z0-9-]{1,63})++", r"(?i)[\[(]\s?at\s?[\])]"),
    ("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+", "[0-9]"),
    ("ip", r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])", ":"),
)
N_BASE = 4
CUE = r"(?i)(tel|phone|fon|call|mail|card|visa|konto|token|key|secret|passw|ip|id)\W{0,4}$|[=:]\s*[\"']?$"
ROUNDS, RATE, PRECISION = 30, 0.5, 0.9


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("s")),
        lambda a, c: F.struct((a.i + 1).alias("i"), (a.s + F.when(a.i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2).cast("int") % 10 + F.floor(c.cast("int") / 5).cast("int"))).cast("int").alias("s")),
    )["s"]
    return total % 10 == 0


def _valid(generator: int, m: Column) -> Column:
    d = _digits(m)
    if generator == 1:
        return m.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])){3}$")
    if generator == 2:
        return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False))
    if generator == 3:
        return F.length(d).between(8, 15)
    if generator == 4:
        return m.rlike(r"^\(?[2-9]")
    if generator == 6:
        return m.rlike("[A-Za-z]") & (F.length(d) >= 5)
    return F.lit(True)


def _evidence(generator: int, m: Column, left: Column) -> Column:
    """The weak label of a match of valid format: what its characters, and the word before it, say for it."""
    d = _digits(m)
    if generator in (0, 5):
        return m.rlike(r"[A-Za-z]{2,24}$") & ~m.rlike(r"^\.|\.@|@-|\.{2}")
    if generator == 1:
        return m.rlike(r"^(?!0|127\.|2[3-5][0-9]\.)") & m.rlike("[0-9]{2}")
    if generator == 2:
        return d.rlike("^[3-6]") & ~d.rlike(r"^([0-9])\1{7}")
    if generator == 3:
        return d.rlike("^[1-9]") & ~d.rlike(r"([0-9])\1{6}")
    if generator == 4:
        return d.rlike("^[2-9](?!11)[0-9]{2}[2-9](?!11)")
    if generator == 6:
        switches = F.size(F.regexp_extract_all(m, F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]"), F.lit(0)))
        return (switches * 8 >= F.length(m)) & left.rlike(r"(?i)(token|key|secret|passw|pwd|auth|credential)[a-z]*\W{0,4}$")
    return m.rlike("(?i)^(?:[23]|f[cde])") & ~m.rlike(r"(?i)^([0-9a-f]{1,4})(?::\1){7}$")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(items: Column, start: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """emit(state, x) for each of the items, the state starting at `start` and going to step(state, x).

    The result is built in runs of the square root of its length, for every append copies what is there.
    """
    none = F.array().cast(f"array<{kind}>")

    def run(state: Column, part: Column) -> Column:
        return F.aggregate(part, F.struct(state.alias("at"), none.alias("out")), lambda a, x: F.struct(step(a.at, x).alias("at"), F.array_append(a.out, emit(a.at, x)).alias("out")))

    def whole(all_: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(all_))).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / width).cast("int")), lambda i: F.slice(all_, i * width + 1, width))
        zero = F.struct(start.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.flatten(F.aggregate(runs, zero, lambda a, part: _let(run(a.at, part), lambda r: F.struct(r.at.alias("at"), F.array_append(a.out, r.out).alias("out"))))["out"])

    return _let(items, lambda all_: F.when(F.size(all_) == 0, none).when(F.size(all_) <= 64, run(start, all_)["out"]).otherwise(whole(all_)))


SPAN = "struct<k:int,s:int,e:int,code:int>"
#: Bits of a candidate's code beyond its cell: the weak label, the fold.
CELLS, LABEL, FOLD = 1 << 11, 1 << 11, 1 << 12


def _candidates(generator: int, text: Column) -> Column:
    """Array of (k, s, e, code) for one generator."""
    kind, pattern, test = GENERATORS[generator]
    parts = F.split(text, pattern, -1)
    each = _let(
        F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), parts.alias("p")),
        lambda v: F.transform(
            F.arrays_zip(v.m.alias("m"), F.slice(v.p, 1, F.size(v.m)).alias("l"), F.slice(v.p, 2, F.size(v.m)).alias("r")),
            lambda x: F.struct(F.length(x["m"]).alias("n"), F.length(x["l"]).alias("gap"), x["m"].alias("m"), F.right(x["l"], F.lit(16)).alias("l"), F.left(x["r"], F.lit(1)).alias("r")),
        ),
    )

    def code(x: Column) -> Column:
        left = F.right(x.l, F.lit(1))
        side = lambda c: F.when((c == "") | c.rlike(r"^\s"), 0).when(c.rlike("[\"'=(<\\[]"), 1).when(c.rlike(r"^\p{L}|^\d"), 2).otherwise(3)
        size = F.when(x.n < 12, 0).when(x.n < 18, 1).when(x.n < 28, 2).otherwise(3)
        valid = _valid(generator, x.m)
        cell = F.lit(generator) + 8 * valid.cast("int") + 16 * side(left) + 64 * side(x.r) + 256 * x.l.rlike(CUE).cast("int") + 512 * size
        return (cell + LABEL * (valid & _evidence(generator, x.m, x.l)).cast("int") + FOLD * (F.crc32(x.m) % 2)).cast("int")

    place = lambda at, x: F.struct(F.lit(KINDS.index(kind)).alias("k"), (at + x.gap).alias("s"), (at + x.gap + x.n).alias("e"), code(x).alias("code"))
    spans = _scan(each, F.lit(0), lambda at, x: at + x.gap + x.n, place, SPAN)
    return F.when(text.rlike(test), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _apart(base: Column, more: Column) -> Column:
    """base, and those of more that overlap nothing of base: spans (k, s, e) in order, without repeats."""
    mark = lambda spans, own: F.transform(spans, lambda x: F.struct(x.s.alias("s"), F.lit(own).alias("own"), x.k.alias("k"), x.e.alias("e"), F.lit(False).alias("hit")))
    kind = "struct<s:int,own:int,k:int,e:int,hit:boolean>"
    note = lambda x, hit: F.struct(x.s.alias("s"), x.own.alias("own"), x.k.alias("k"), x.e.alias("e"), (x.hit | ((x.own == 1) & hit)).alias("hit"))
    both = F.array_sort(F.concat(mark(base, 0), mark(more, 1)))
    # Base spans that begin no later reach beyond its start, or one that begins later begins before its end.
    both = _scan(both, F.lit(-1), lambda at, x: F.when(x.own == 0, F.greatest(at, x.e)).otherwise(at), lambda at, x: note(x, at > x.s), kind)
    both = _scan(F.reverse(both), F.lit(2**31 - 1), lambda at, x: F.when(x.own == 0, x.s).otherwise(at), lambda at, x: note(x, at < x.e), kind)
    return F.filter(both, lambda x: ~x.hit)


def _in_order(spans: Column) -> Column:
    """(k, s, e) sorted, each once."""
    spans = F.array_sort(F.transform(spans, lambda x: F.struct(x.k.alias("k"), x.s.alias("s"), x.e.alias("e"))))
    return _let(spans, lambda all_: F.filter(all_, lambda x, i: (i == 0) | (x != F.get(all_, i - 1))))


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda x: x.k == kind)).cast("long")


def _features(code: int) -> list[int]:
    """One-hot features of a cell."""
    g, ok, left, right, cue, size = code % 8, code // 8 % 2, code // 16 % 4, code // 64 % 4, code // 256 % 2, code // 512
    return [*(int(g == i) for i in range(8)), ok, *(int(left == i) for i in range(4)), *(int(right == i) for i in range(4)), cue, *(int(size == i) for i in range(4))]


#: (candidates, candidates with the weak label) of a cell.
Cells = dict[int, tuple[int, int]]


def boost(cells: Cells, rounds: int = ROUNDS, rate: float = RATE) -> Callable[[int], float]:
    """Logistic gradient boosting with trees of depth two over labelled cells; the log odds of any cell."""
    keys = sorted(cells)
    x, y = [_features(c) for c in keys], [cells[c][1] / cells[c][0] for c in keys]
    w, f = [math.sqrt(cells[c][0]) for c in keys], [0.0] * len(keys)
    width = len(x[0]) if x else 0
    #: (root feature, for each of its sides (feature, steps of its sides)); a feature of None has one side.
    trees: list[tuple[int | None, list[tuple[int | None, list[float]]]]] = []

    def best(rows: list[int], grad: list[float], hess: list[float]) -> int | None:
        gain, at = 1e-9, None
        g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
        for k in range(width):
            gk, hk = sum(grad[i] for i in rows if x[i][k]), sum(hess[i] for i in rows if x[i][k])
            if (new := gk * gk / (hk + 1) + (g - gk) ** 2 / (h - hk + 1) - g * g / (h + 1)) > gain:
                gain, at = new, k
        return at

    def sides(rows: list[int], k: int | None) -> list[list[int]]:
        return [rows] if k is None else [[i for i in rows if x[i][k] == v] for v in (0, 1)]

    for _ in range(rounds if keys else 0):
        p = [1 / (1 + math.exp(-v)) for v in f]
        grad, hess = [wi * (yi - pi) for wi, yi, pi in zip(w, y, p, strict=True)], [wi * pi * (1 - pi) for wi, pi in zip(w, p, strict=True)]
        root, halves = best(list(range(len(keys))), grad, hess), []
        for half in sides(list(range(len(keys))), root):
            k, steps = best(half, grad, hess), []
            for leaf in sides(half, k):
                steps.append(rate * sum(grad[i] for i in leaf) / (sum(hess[i] for i in leaf) + 1))
                for i in leaf:
                    f[i] += steps[-1]
            halves.append((k, steps))
        trees.append((root, halves))

    def odds(cell: int) -> float:
        v = _features(cell)
        total = 0.0
        for root, halves in trees:
            k, steps = halves[0 if root is None else v[root]]
            total += steps[0 if k is None else v[k]]
        return total

    return odds


def select_cells(folds: tuple[Cells, Cells], precision: float = PRECISION) -> list[int]:
    """The cells to redact: those that the models of both folds hold likely, down to their generator's threshold.

    A cell's score is the lower one of the two models'; each has not seen the candidates of the other fold. The threshold is
    calibrated on the very cells that it selects: the lowest score such that the share with the weak label among
    all their candidates is at least the precision in each of the folds that holds any. A generator that never reaches
    it selects nothing.
    """
    models = [boost(f) for f in folds]
    scores = {c: min(m(c) for m in models) for c in {*folds[0], *folds[1]}}
    chosen: list[int] = []
    for g in range(len(GENERATORS)):
        ranked = sorted((c for c in scores if c % 8 == g and scores[c] > 0), key=lambda c: (-scores[c], c))
        total, good, kept = [0, 0], [0, 0], 0
        for at, c in enumerate(ranked):
            for i in (0, 1):
                n, labelled = folds[i].get(c, (0, 0))
                total[i], good[i] = total[i] + n, good[i] + labelled
            whole = at + 1 == len(ranked) or scores[ranked[at + 1]] < scores[c]  # ties stand or fall together
            if whole and all(good[i] >= precision * total[i] for i in (0, 1)):
                kept = at + 1
        chosen += ranked[:kept]
    return sorted(chosen)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans.

    The counts and base_sha256 are those of the valid base matches; `spans` also has what the model selects
    and no base match overlaps ("kind:start:end", code points, end exclusive, by kind, then start). Kind
    `secret` comes last. A null text is empty; rows are judged one by one, repeated ones alike. An empty table
    gives no rows; other columns are not read.
    """
    text = F.col("t")
    rows = materialize(
        docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t")).select("doc_id", F.concat(*(_candidates(g, text) for g in range(len(GENERATORS)))).alias("c"))
    )
    # At most 2 ** 13 codes, however many rows.
    folds: tuple[Cells, Cells] = ({}, {})
    for r in rows.select(F.explode("c.code").alias("code")).groupBy("code").agg(F.count("*").alias("n")).collect():
        fold, cell = folds[r.code // FOLD], r.code % CELLS
        n, labelled = fold.get(cell, (0, 0))
        fold[cell] = (n + r.n, labelled + (r.n if r.code & LABEL else 0))
    chosen = select_cells(folds, precision)
    is_base = lambda x: (x.code % 8 < N_BASE) & (F.shiftright(x.code, 3) % 2 == 1)
    rows = rows.withColumn("base", F.filter("c", is_base))
    rows = rows.withColumn("more", F.filter("c", lambda x: ~is_base(x) & (x.code % CELLS).isin(chosen)) if chosen else F.slice("c", 1, 0))
    rows = rows.withColumn("spans", F.when(F.size("more") == 0, _in_order(F.col("base"))).otherwise(_in_order(_apart(F.col("base"), F.col("more")))))
    names = F.array(*map(F.lit, KINDS))
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.k), x.s.cast("string"), x.e.cast("string"))), ",")
    base = F.array_sort(F.transform("base", lambda x: F.struct(x.k.alias("k"), x.s.alias("s"), x.e.alias("e"))))
    return rows.select(
        "doc_id",
        *(_count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS[:4])),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
