"""Quality rules as a learned decision list: sequential covering over text statistics, emitted as Spark conditions.

The main path holds DataFrame functions only. The learner works on a bounded, documented sample of labelled
rows that is already reduced to a few numbers a row; it grows a conjunction of thresholds by information
gain, prunes it on rows kept aside, removes what it covers, and goes on while rules hold up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import col, once, uniform

SYMBOLS = "[#*$%&|<>]+"
_SPACE = r"[ \t\n\x0B\f\r]+"
_BLANKS = " \t\n\x0b\f\r"
#: What rules may test; all are ratios or counts of one whole text.
FEATURES = ("n_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "distinct_share", "lines_per_word")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def free_prefix(df: DataFrame, prefix: str = "__q_") -> str:
    """A prefix that no column of df has."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def with_statistics(df: DataFrame, text: Column, prefix: str = "__q_") -> DataFrame:
    """df with the statistics of a text as columns named prefix + name. Every column of df stays; none may begin with the prefix (see free_prefix).

    Each step is a projection of its own: what it defines is used more than once above, so it is computed
    once a row. A repeated 3-word window is found by sorting (hash, position) pairs, only where some hash
    repeats: time grows as n log n in the words of a text, and nothing is exploded or shuffled.
    """
    if free_prefix(df, prefix) != prefix:
        raise ValueError(f"a column of the table begins with {prefix}")
    p = lambda name: F.col(f"`{prefix}{name}`")
    df = df.withColumn(f"{prefix}text", F.coalesce(text.cast("string"), F.lit("")))
    df = df.withColumn(f"{prefix}trim", F.btrim(p("text"), F.lit(_BLANKS)))
    df = df.withColumn(f"{prefix}words", F.when(p("trim") == "", F.array().cast("array<string>")).otherwise(F.split(p("trim"), _SPACE)))
    df = df.withColumn(f"{prefix}lines", F.filter(F.split(p("text"), "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != ""))
    # the last two hash fewer words and so equal no other window
    df = df.withColumn(f"{prefix}hash", F.transform(p("words"), lambda x, i: F.xxhash64(x, F.get(p("words"), i + 1), F.get(p("words"), i + 2))))
    df = df.withColumn(f"{prefix}sorted", F.when(F.size(F.array_distinct(p("hash"))) < F.size(p("hash")), F.sort_array(F.transform(p("hash"), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    at = lambda k: F.get(p("sorted"), k).getField("h")
    df = df.withColumn(f"{prefix}twice", F.sort_array(F.transform(F.filter(p("sorted"), lambda s, j: s.getField("h").eqNullSafe(at(j - 1)) | s.getField("h").eqNullSafe(at(j + 1))), lambda s: s.getField("i"))))
    covered = F.aggregate(F.transform(p("twice"), lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p("twice"), j + 1), x + 3) - x)), F.lit(0).cast("long"), lambda a, x: a + x)
    n = F.size(p("words")).cast("long")
    df = df.select(
        *[col(c) for c in df.columns if not c.startswith(prefix)],
        n.alias(f"{prefix}n_words"),
        F.length(F.array_join(p("words"), "")).cast("long").alias(f"{prefix}word_chars"),
        (F.length(p("text")) - F.length(F.regexp_replace(p("text"), SYMBOLS, ""))).cast("long").alias(f"{prefix}n_symbols"),
        (F.size(p("lines")) - F.size(F.array_distinct(p("lines")))).cast("long").alias(f"{prefix}n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias(f"{prefix}n_repeat_words"),
        F.size(p("lines")).cast("long").alias(f"{prefix}n_lines"),
        F.size(F.array_distinct(p("words"))).cast("long").alias(f"{prefix}n_distinct"),
        (F.length(p("text")) - F.length(F.regexp_replace(p("text"), r"\p{Lu}+", ""))).cast("long").alias(f"{prefix}n_upper"),
    )
    words = F.greatest(p("n_words"), F.lit(1)).cast("double")
    return df.withColumns({
        f"{prefix}mean_word_chars": p("word_chars") / words,
        f"{prefix}symbols_per_word": p("n_symbols") / words,
        f"{prefix}dup_line_share": p("n_dup_lines") / F.greatest(p("n_lines"), F.lit(1)),
        f"{prefix}repeat_share": p("n_repeat_words") / words,
        f"{prefix}upper_share": p("n_upper") / F.greatest(p("word_chars"), F.lit(1)),
        f"{prefix}distinct_share": p("n_distinct") / words,
        f"{prefix}lines_per_word": p("n_lines") / words,
        f"{prefix}base_failed": once((p("n_words") < 50) | (100 * p("n_repeat_words") > 50 * p("n_words"))),
    })


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self, prefix: str = "__q_") -> Column:
        c = F.col(f"`{prefix}{self.feature}`").cast("double")
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction whose rows are rejected, with what it covered when it was accepted."""

    conditions: tuple[Condition, ...]
    rejects: int
    clean: int

    def column(self, prefix: str = "__q_") -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column(prefix)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions)) + f" -> reject ({self.rejects} of {self.rejects + self.clean})"


def learn_rules(rows: list[dict], *, max_rules: int = 16, max_conditions: int = 4, bins: int = 48, precision: float = 0.9) -> list[Rule]:
    """An ordered list of rejecting rules from rows that hold FEATURES, `bad` (bool) and `prune` (bool).

    Sets of rows are bit masks. A rule is grown on the rows that aren't kept aside by FOIL gain, its last
    conditions are dropped while that doesn't lower (p - n) / (p + n) on the rows kept aside, and it is accepted while
    its precision (with one row of each class added) reaches `precision` over all rows. No rows or a
    single class: no rules. Ties go to the earlier feature, then the lower threshold.
    """
    bit = lambda f: sum(1 << k for k, r in enumerate(rows) if f(r))
    bad, aside, every = bit(lambda r: r["bad"]), bit(lambda r: r["prune"]), (1 << len(rows)) - 1
    tests: list[tuple[Condition, int]] = []
    for feature in FEATURES:
        order = sorted(range(len(rows)), key=lambda k: rows[k][feature])
        values = [rows[k][feature] for k in order]
        cuts, mask, last = set(), 0, 0
        for q in range(1, bins):
            k = q * len(values) // bins
            while 0 < k < len(values) and values[k] == values[k - 1]:
                k += 1
            if 0 < k < len(values):
                cuts.add(k)
        for share in (0.002, 0.005, 0.01):  # finer at both ends
            for k in (round(share * len(values)), len(values) - round(share * len(values))):
                if 0 < k < len(values) and values[k] != values[k - 1]:
                    cuts.add(k)
        for k in sorted(cuts):
            for j in order[last:k]:
                mask |= 1 << j
            last = k
            cut = (values[k - 1] + values[k]) / 2
            tests += [(Condition(feature, False, cut), mask), (Condition(feature, True, cut), every & ~mask)]
    rules: list[Rule] = []
    left = every
    while len(rules) < max_rules:
        grow, chosen, here = left & ~aside, [], left
        now = grow
        while len(chosen) < max_conditions:
            p0, n0 = (now & bad).bit_count(), (now & ~bad).bit_count()
            if not p0 or not n0:
                break
            best, gain = None, 1e-9
            for test in tests:
                p1 = (now & test[1] & bad).bit_count()
                if p1 < 3:
                    continue
                n1 = (now & test[1] & ~bad).bit_count()
                if (g := p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))) > gain:
                    best, gain = test, g
            if best is None:
                break
            chosen.append(best)
            now &= best[1]
        if not chosen:
            break
        worth, keep = -2.0, len(chosen)
        covers, mask = [], left
        for _, m in chosen:
            mask &= m
            covers.append(mask)
        for k in range(1, len(chosen) + 1):
            p, n = (covers[k - 1] & aside & bad).bit_count(), (covers[k - 1] & aside & ~bad).bit_count()
            if (w := (p - n) / (p + n) if p + n else -1.0) > worth:
                worth, keep = w, k
        here = covers[keep - 1]
        p, n = (here & bad).bit_count(), (here & ~bad).bit_count()
        if (p + 1) / (p + n + 2) < precision and here != covers[-1]:
            here, keep = covers[-1], len(chosen)
            p, n = (here & bad).bit_count(), (here & ~bad).bit_count()
        if (p + 1) / (p + n + 2) < precision:
            break
        rules.append(Rule(tuple(c for c, _ in chosen[:keep]), p, n))
        left &= ~here
        if not left & bad:
            break
    return rules


def as_column(rules: list[Rule], prefix: str = "__q_") -> Column:
    """The decision list as one ordered conditional expression: the first rule that holds decides, else keep."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(prefix), F.lit(False))
    for rule in rules[1:]:
        out = out.when(rule.column(prefix), F.lit(False))
    return out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 6000, **options) -> list[Rule]:
    """Learn from at most max_rows labelled rows, chosen by a hash of their id; label 0 marks what to reject.

    Rows that fail the base test teach nothing. Labels other than 0 and 1, and null ids, are left out.
    """
    some = labels.where(col(label_col).isin(0, 1) & col(id_col).isNotNull())
    some = some.select(col(id_col).cast("long").alias("__id"), (col(label_col) == 0).alias("__bad")).distinct()
    some = some.orderBy(F.xxhash64("__id"), "__id", "__bad").limit(max_rows)
    rows = docs.select(col(id_col).cast("long").alias("__id"), col(text_col).alias("__text")).join(F.broadcast(some), "__id")
    rows = with_statistics(rows, F.col("__text")).where(~F.col("__q_base_failed")).select("__id", "__bad", *[F.col(f"__q_{f}").cast("double").alias(f) for f in FEATURES])
    got = [r.asDict() for r in rows.withColumn("__u", uniform(F.col("__id"), F.lit("prune"))).collect()]
    got.sort(key=lambda r: (r["__id"], r["__bad"], *[r[f] for f in FEATURES]))
    return learn_rules([{f: r[f] for f in FEATURES} | {"bad": r["__bad"], "prune": r["__u"] < 1 / 3} for r in got], **options)


def judge(docs: DataFrame, rules: list[Rule], *, text_col: str = "text", prefix: str | None = None) -> DataFrame:
    """Every row of docs with its columns, the statistics and the verdict `kept`, both named with a prefix (__q_, or a longer one where a column of docs has that).

    Null and empty texts have no words: their counts are 0, and they fail the base test. Each row is judged
    by itself, so repeated rows get equal verdicts and an empty table gives an empty one.
    """
    prefix = prefix or free_prefix(docs)
    out = with_statistics(docs, col(text_col), prefix)
    return out.withColumn(f"{prefix}kept", once(~F.col(f"`{prefix}base_failed`") & as_column(rules, prefix)))


def report(docs: DataFrame, rules: list[Rule], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base statistics, base_failed and kept of every document. Nulls, empty texts, repeated rows and empty tables are as in judge; other columns are not read."""
    out = judge(docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")), rules)
    return out.select("doc_id", *[F.col(f"__q_{c}").alias(c) for c in (*BASE, "base_failed", "kept")])


def keep(docs: DataFrame, rules: list[Rule], *, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with the columns of docs and nothing else.

    Null and empty texts fail the base test and go. Repeated rows stay or go together; an empty table gives
    an empty one; columns of any name pass unchanged, those that begin like the statistics' too.
    """
    prefix = free_prefix(docs)
    return judge(docs, rules, text_col=text_col, prefix=prefix).where(f"`{prefix}kept`").select(*[col(c) for c in docs.columns])
