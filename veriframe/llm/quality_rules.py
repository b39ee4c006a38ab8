"""Quality rules as a learned decision list, in built-in expressions only.

Document signals are computed inside each row with array functions. The list is learned by sequential covering:
a rule (a conjunction of thresholds that rejects) grows by the condition with the best information gain on
two thirds of the still uncovered labelled rows, is pruned on the other third, and is kept while it stays precise;
then the rows it covers are set aside and the next rule is sought. Every step sees labelled statistics only: one
aggregation of label counts by signal and bin. The result is an ordered conditional expression.

Defined cases: null and empty texts have no words, fail the base rule and are not kept; labels other than 0 and 1
are ignored, a document labelled twice counts once (low quality if either says so); without labels of both kinds
the list is empty and keeps what the base rule passes; texts are read whole; repeated rows are treated alike;
other columns are ignored; an empty table gives an empty table. At most about ``max_train_docs`` labelled rows, chosen by hash, are learned from.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import cut, hash_below, held_out

WINDOW = 5
MAX_TRAIN_DOCS = 20_000
MAX_RULES, MAX_CONDITIONS = 8, 3
MIN_PRECISION, MIN_COVER = 0.8, 5
CUTS = 24
SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SIGNALS = ("n_words", "word_length", "symbol_rate", "symbol_word_rate", "dup_line_rate", "repeat_rate", "distinct_rate")

Condition = tuple[str, str, float]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body (or a lambda in it) uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that the text has at least twice. Window hashes are sorted with their places, equal
    neighbours give the places, and the overlapping windows are summed as a union."""

    def covered(places: Column) -> Column:
        step = lambda p, k: F.least(F.lit(window), F.coalesce(F.get(places, k + 1) - p, F.lit(window)))
        return F.aggregate(F.transform(places, step), F.lit(0), lambda a, x: a + x)

    def among(pairs: Column) -> Column:
        same = lambda e, other: F.coalesce(F.get(pairs, other)["h"] == e["h"], F.lit(False))
        twice = F.filter(pairs, lambda e, k: F.when(k > 0, same(e, k - 1)).otherwise(False) | same(e, k + 1))
        return let(F.sort_array(F.transform(twice, lambda e: e["p"])), covered)

    def of_hashes(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(pairs, among))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))
        return F.when(F.size(w) <= window, 0).otherwise(let(hashes, of_hashes))

    return let(words, of_words)


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, and two more that the rules use."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), repeat_words(w).alias("repeat"), F.size(F.filter(w, lambda x: x.rlike(r"[#*$%&|<>]"))).alias("symbol_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    made = docs.select(
        "doc_id",
        of_words.alias("w"),
        of_lines.alias("l"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).alias("n_symbols"),
    )
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return made.select(
        "doc_id", long("w.n", "n_words"), long("word_chars", "word_chars"), long("n_symbols", "n_symbols"), long("l.dup", "n_dup_lines"),
        long("w.repeat", "n_repeat_words"), long("w.distinct", "n_distinct"), long("w.symbol_words", "n_symbol_words"), long("l.n", "n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def signals() -> dict[str, Column]:
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).cast("double")
    return {
        "n_words": F.col("n_words").cast("double"), "word_length": rate("word_chars", "n_words"), "symbol_rate": rate("n_symbols", "n_words"),
        "symbol_word_rate": rate("n_symbol_words", "n_words"), "dup_line_rate": rate("n_dup_lines", "n_lines"),
        "repeat_rate": rate("n_repeat_words", "n_words"), "distinct_rate": rate("n_distinct", "n_words"),
    }


def condition(c: Condition) -> Column:
    name, op, value = c
    own = signals()[name]
    return own <= value if op == "<=" else own > value


def conjunction(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & condition(c)
    return out


def _holds(c: Condition) -> Column:
    """The condition on a training row, whose signals are columns of their own."""
    return F.col(c[0]) <= c[2] if c[1] == "<=" else F.col(c[0]) > c[2]


def _all(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & _holds(c)
    return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p > 0 else 0.0


def _best_condition(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[float, Condition | None, float]:
    """The condition with the largest gain on these rows, from label counts by signal and bin."""
    bins = [F.struct(F.lit(s).alias("signal"), sum([(F.col(s) > c).cast("int") for c in cuts[s]], F.lit(0)).alias("bin")) for s in SIGNALS]
    table = rows.select("low", F.explode(F.array(*bins)).alias("b")).groupBy("b.signal", "b.bin").agg(F.sum("low").alias("p"), F.sum(1 - F.col("low")).alias("n"))
    by: dict[str, dict[int, tuple[int, int]]] = {}
    for r in table.collect():  # at most signals x cuts rows
        by.setdefault(r.signal, {})[r.bin] = (r.p, r.n)
    best: tuple[float, Condition | None, float] = (0.0, None, 0.0)
    for signal in sorted(by):
        p0, n0 = (sum(v[k] for v in by[signal].values()) for k in (0, 1))
        p = n = 0
        for k, value in enumerate(cuts[signal]):
            dp, dn = by[signal].get(k, (0, 0))
            p, n = p + dp, n + dn
            for op, a, b in (("<=", p, n), (">", p0 - p, n0 - n)):
                if a >= MIN_COVER and (gain := _gain(a, b, p0, n0)) > best[0] + 1e-9:
                    best = (gain, (signal, op, value), a / (a + b))
    return best


def learn(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS) -> list[list[Condition]]:
    """The decision list's rejecting rules, in order; ``max_rules`` and ``max_conditions`` bound its size."""
    own = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg((1 - F.min("quality")).alias("low"))
    # about max_train_docs ids and labels, so they may be broadcast and the texts stay where they are
    chosen = F.broadcast(own.filter(hash_below(F.col("doc_id"), max_train_docs / max(own.count(), 1))))
    rows = counts(docs.select("doc_id", "text").join(chosen, "doc_id", "left_semi")).filter(~base_failed())
    rows = rows.join(chosen, "doc_id").select("low", *[c.alias(s) for s, c in signals().items()], (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) < 2).alias("grow"))
    rows = cut(rows)
    levels = [k / CUTS for k in range(1, CUTS)]
    got = rows.agg(*[F.percentile_approx(F.when(F.col("low") == y, F.col(s)), levels, 2000).alias(f"{s}_{y}") for s in SIGNALS for y in (0, 1)]).first()
    cuts = {s: sorted({float(f"{v:.6g}") for y in (0, 1) for v in (got[f"{s}_{y}"] or [])}) for s in SIGNALS}
    rules: list[list[Condition]] = []
    while len(rules) < max_rules:
        left = rows
        for rule in rules:
            left = left.filter(~_all(rule))
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            _, found, precision = _best_condition(left.filter(F.col("grow") & _all(rule)), cuts)
            if found is None:
                break
            rule.append(found)
            if precision >= 0.99:
                break
        if not rule:
            break
        ends = range(1, len(rule) + 1)
        tried = left.filter(~F.col("grow")).agg(*[F.sum(F.when(_all(rule[:k]), F.lit(1) * c).otherwise(0)).alias(f"{name}{k}") for k in ends for name, c in (("p", F.col("low")), ("n", 1 - F.col("low")))]).first()
        value = lambda k: ((tried[f"p{k}"] or 0) - (tried[f"n{k}"] or 0)) / max((tried[f"p{k}"] or 0) + (tried[f"n{k}"] or 0), 1)  # noqa: E731, B023
        k = max(ends, key=lambda k: (value(k), -k))
        p, n = tried[f"p{k}"] or 0, tried[f"n{k}"] or 0
        if p < 1 or p / (p + n) < MIN_PRECISION:
            break
        rules.append(rule[:k])
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """Ordered conditional expression: the first rule that holds rejects, else the document is kept."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        out = out.when(conjunction(rule), F.lit(False))
    return out.otherwise(F.lit(True))


def apply(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    return counts(docs).select("doc_id", *COUNTS, base_failed().alias("base_failed"), verdict(rules).alias("kept"))
