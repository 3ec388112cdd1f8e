"""Quality rules learned as a decision list; DataFrame functions only.

`text_statistics` counts on whole texts. Sequential covering then learns which documents to reject: a rule starts
empty and takes, one at a time, the threshold (`>=` or `<` on a feature) that gains most information on the growing
rows; it is cut back to the prefix that does best on the pruning rows, and kept if its precision there is high enough.
Rows that it covers leave, and the next rule starts. All rows with a label take part: each step counts them once by
feature and threshold, and the driver sees only those counts. The result is an ordered conditional expression.

Missing texts count as empty: no words, so they fail the base rule. Documents without words fail it too. Repeated rows
each get their verdict. Labels for unknown documents, missing labels or labels other than 0 and 1 are not used; a
document with differing labels counts once for each. Without labels there are no rules. An empty table gives an empty
result. Extra columns are not read by `text_statistics`; `verdicts` works on its rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailscope.llm.common import kept

#: White space between words, as a character class.
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_marks")
#: Features of the rules: each is a share, a mean or a count of the statistics.
FEATURES: dict[str, Callable[[], Column]] = {
    "symbol_share": lambda: F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
    "repeat_share": lambda: F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
    "dup_line_share": lambda: F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    "upper_share": lambda: F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
    "digit_share": lambda: F.col("n_digits") / F.greatest(F.col("word_chars"), F.lit(1)),
    "mark_share": lambda: F.col("n_marks") / F.greatest(F.col("word_chars"), F.lit(1)),
    "distinct_share": lambda: F.col("n_distinct_words") / F.greatest(F.col("n_words"), F.lit(1)),
    "word_length": lambda: F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
    "words": lambda: F.col("n_words").cast("double"),
}
#: Thresholds tried for every feature: 0.001 to 10,000 in steps of a tenth of a power of ten.
THRESHOLDS = [float(f"{10 ** (e / 10):.3g}") for e in range(-30, 41)]


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, also where `use` repeats it for each element."""
    return F.transform(F.array(value), use)[0]


def repeat_words(hashes: Column) -> Column:
    """Words inside windows of `WINDOW` words found twice or more; from the words' hashes."""

    def covered(places: Column) -> Column:
        """Words covered by the windows that start at these ascending places."""
        last = F.size(places) - 1
        steps = F.transform(places, lambda p, j: F.when(j == last, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), F.get(places, j + 1) - p)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("p"))))

        def doubled(found: Column) -> Column:
            near = lambda x, j: F.coalesce(F.get(found, j)["k"] == x["k"], F.lit(False))
            return F.sort_array(F.transform(F.filter(found, lambda x, j: near(x, j - 1) | near(x, j + 1)), lambda x: x["p"]))

        none_twice = F.size(F.array_distinct(keys)) == F.size(keys)
        return F.when(none_twice, F.lit(0).cast("long")).otherwise(bind(bind(placed, doubled), covered))

    starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
    keys = F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))
    return F.when(F.size(hashes) < WINDOW, F.lit(0).cast("long")).otherwise(bind(keys, repeated))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `STATISTICS` (longs), one row for each document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = lambda pattern: F.regexp_count(F.col("text"), F.lit(pattern)).cast("long")

    def of_words(words: Column) -> Column:
        return bind(
            F.transform(words, lambda w: F.xxhash64(w)),
            lambda hashes: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
                repeat_words(hashes).alias("n_repeat_words"),
                F.size(F.array_distinct(hashes)).cast("long").alias("n_distinct_words"),
            ),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    words = F.filter(F.split(F.col("text"), GAP), lambda w: w != "")
    lines = F.filter(F.split(F.col("text"), "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\f\r")) != "")
    counted = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id",
        bind(words, of_words).alias("w"),
        bind(lines, of_lines).alias("l"),
        found(SYMBOLS).alias("n_symbols"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", r"[0-9]+", ""))).cast("long").alias("n_digits"),
        found(r"[!?]").alias("n_marks"),
    )
    return counted.select("doc_id", "w.*", "l.*", "n_symbols", "n_upper", "n_digits", "n_marks").select("doc_id", *STATISTICS)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """`feature >= threshold`, or `<` where `below`."""

    feature: str
    threshold: float
    below: bool

    def value(self) -> Column:
        feature = FEATURES[self.feature]()
        return feature < self.threshold if self.below else feature >= self.threshold

    def step(self) -> Column:
        """The same on the step that the feature reached, in rows made by `stepped`."""
        reached = THRESHOLDS.index(self.threshold) + 1
        return F.col(self.feature) < reached if self.below else F.col(self.feature) >= reached

    def __str__(self) -> str:
        return f"{self.feature} {'<' if self.below else '>='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def met(rule: Rule, by: Callable[[Condition], Column]) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & by(condition)
    return out


def stepped(statistics: DataFrame, labels: DataFrame) -> DataFrame:
    """bad (0 or 1), grows, and for every feature how many thresholds it reaches; one row for each label."""
    rungs = F.array(*(F.lit(float(t)) for t in THRESHOLDS))
    reached = lambda value: F.size(F.filter(rungs, lambda t: t <= value))

    good = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1))
    rows = statistics.join(good, "doc_id").select("doc_id", (1 - F.col("quality")).alias("bad"), *(f().alias(name) for name, f in FEATURES.items()))
    return rows.select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grows"), *(reached(F.col(name)).cast("int").alias(name) for name in FEATURES))


def gain(p: int, n: int, all_p: int, all_n: int) -> float:
    """What the rule gains on the rows of the wanted class that it still covers."""
    return p * (math.log2(p / (p + n)) - math.log2(all_p / (all_p + all_n))) if p else 0.0


def best_condition(rows: DataFrame) -> tuple[Condition | None, int, int]:
    """The condition that gains most on these rows, with the wanted and other rows that it covers."""
    names = list(FEATURES)
    melted = rows.select("bad", F.explode(F.array(*(F.struct(F.lit(i).alias("feature"), F.col(name).alias("step")) for i, name in enumerate(names)))).alias("x"))
    counted = melted.groupBy("x.feature", "x.step").agg(F.sum("bad").alias("p"), F.count(F.lit(1)).alias("all")).collect()  # at most features x steps
    held = {(names[r.feature], r.step): (int(r.p), int(r["all"]) - int(r.p)) for r in counted}
    best, covers = (1e-9, None), (0, 0)
    for name in names:
        own = [held.get((name, s), (0, 0)) for s in range(len(THRESHOLDS) + 1)]
        all_p, all_n = sum(p for p, _ in own), sum(n for _, n in own)
        p = n = 0
        for step in range(1, len(own)):
            p, n = p + own[step - 1][0], n + own[step - 1][1]
            for below, (a, b) in ((True, (p, n)), (False, (all_p - p, all_n - n))):
                if (g := gain(a, b, all_p, all_n)) > best[0]:
                    best, covers = (g, Condition(name, THRESHOLDS[step - 1], below)), (a, b)
    return best[1], *covers


def learn(statistics: DataFrame, labels: DataFrame, most_rules: int = 8, longest: int = 4, precision: float = 0.95, least: int = 3) -> list[Rule]:
    """Rules for documents to reject, in order; each covers at least `least` pruning rows at `precision`."""
    rows = kept(stepped(statistics, labels), "labelled")
    rules: list[Rule] = []
    while len(rules) < most_rules:
        left = rows.filter(~met_any(rules)) if rules else rows
        rule: Rule = ()
        while len(rule) < longest:
            condition, p, n = best_condition(left.filter(F.col("grows") & met(rule, Condition.step)))
            if condition is None:
                break
            rule = (*rule, condition)
            if not n:
                break
        if not rule:
            break
        pruning = left.filter(~F.col("grows"))
        sums = pruning.agg(*(f(F.when(met(rule[:k], Condition.step), F.col("bad") if f is F.sum else F.lit(1))).alias(f"{f.__name__}{k}") for k in range(1, len(rule) + 1) for f in (F.sum, F.count))).first()
        score = {k: (int(sums[f"sum{k}"] or 0), int(sums[f"count{k}"])) for k in range(1, len(rule) + 1)}
        size = max(score, key=lambda k: ((2 * score[k][0] - score[k][1]) / max(score[k][1], 1), score[k][0], -k))
        good, all_ = score[size]
        if good < least or good < precision * all_:
            break
        rules.append(rule[:size])
    return rules


def met_any(rules: list[Rule]) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | met(rule, Condition.step)
    return out


def decision(rules: list[Rule]) -> Column:
    """Number (from 1) of the first rule that rejects the row, missing if none does."""
    if not rules:
        return F.lit(None).cast("int")
    out = F.when(met(rules[0], Condition.value), F.lit(1))
    for number, rule in enumerate(rules[1:], 2):
        out = out.when(met(rule, Condition.value), F.lit(number))
    return out


def verdicts(statistics: DataFrame, rules: list[Rule]) -> DataFrame:
    """The statistics with base_failed, kept, and the number and text of the rule that rejected the row."""
    texts = F.array(*(F.lit(" and ".join(map(str, r))) for r in rules)).cast("array<string>")
    judged = statistics.withColumn("base_failed", base_failed()).withColumn("rule", decision(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).withColumn("rule_text", F.get(texts, F.col("rule") - 1))
