"""Quality rules: text statistics and a learned decision list, in DataFrame functions only.

learn_rules() fits a decision list on statistics of labelled documents by sequential covering: each
rule is a conjunction of thresholds, grown by information gain on two thirds of the documents not
yet covered, pruned from its end on the other third, and kept while it is precise enough there; the
documents that it covers are then set aside. The list is emitted as one conditional expression
(when rule 1: rejected, when rule 2: rejected, ..., otherwise kept), so that scoring is a projection.

The sample for fitting is bounded (`most` labelled rows, those with the least hash of doc_id); it
alone reaches the driver. Labels that are null, of unknown documents, or all alike give no rule.
Null texts have no words and fail the base rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word rule and the counted symbols.
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
MOST_LABELLED = 4000


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and n_distinct_words, n_lines.

    A 3-word window counts as found again by the 64-bit hash of its words' hashes. Sorting the
    windows of a text brings equal ones together, so no text needs more than n log n steps. The row
    number, never negative, keeps filters above the statistics: pushed below, they would compute them
    anew for every window of a text.
    """
    text = F.coalesce("text", F.lit(""))
    bare = F.btrim(text, F.lit(SPACE))
    none = F.expr("cast(array() as array<string>)")
    words = F.when(bare == "", none).otherwise(F.split(bare, "[ \\x09-\\x0D]+"))
    df = docs.withColumn("_words", words).withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_words")
    at = F.expr("if(size(_words) < 3, cast(array() as array<int>), sequence(0, size(_words) - 3))")
    h = F.col("_hashes")
    df = df.withColumn("_windows", F.sort_array(F.transform(at, lambda i: F.struct(F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("i")))))
    s = F.col("_windows")
    again = lambda k: (F.get(s, k)["h"] == F.get(s, k - 1)["h"]) | (F.get(s, k)["h"] == F.get(s, k + 1)["h"])
    covered = F.transform(F.filter(at, lambda k: F.coalesce(again(k), F.lit(False))), lambda k: F.get(s, k)["i"])
    df = df.withColumn("_covered", covered)
    repeated = F.size(F.array_distinct(F.flatten(F.transform("_covered", lambda i: F.array(i, i + 1, i + 2)))))
    return df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(F.monotonically_increasing_id() >= 0, repeated.cast("long")),
        "n_distinct_words": F.size(F.array_distinct("_hashes")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
    }).drop("_words", "_lines", "_hashes", "_windows", "_covered")


#: What thresholds are set on, as SQL over the statistics; all are 0 for a text without words.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeated_share": "n_repeat_words / greatest(n_words, 1)",
    "duplicate_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "mean_word_length": "word_chars / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "words": "double(n_words)",
}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    value: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.value if self.above else row[self.feature] <= self.value

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.value!r}D"


Rule = tuple[Test, ...]


def covers(rule: Rule, row: dict) -> bool:
    return all(t.holds(row) for t in rule)


def counts(rule: Rule, rows: list[dict]) -> tuple[int, int]:
    """(rejected-labelled, other) rows that the rule covers."""
    hit = [r["bad"] for r in rows if covers(rule, r)]
    return sum(hit), len(hit) - sum(hit)


def best_test(rows: list[dict]) -> tuple[float, Test | None]:
    """The threshold with the most information gain over all features; among equals that in the widest gap.

    Thresholds lie midway between neighbouring values, so that a gap between the classes is halved.
    """
    total, bad = len(rows), sum(r["bad"] for r in rows)
    before, best, found = math.log2(bad / total), (1e-9, 0.0), None
    for f in FEATURES:
        ranked = sorted((r[f], r["bad"]) for r in rows)
        span, p = (ranked[-1][0] - ranked[0][0]) or 1.0, 0
        for n, ((low, is_bad), (high, _)) in enumerate(zip(ranked, ranked[1:], strict=False), 1):
            p += is_bad
            if low == high:
                continue
            for above, hits, size in ((False, p, n), (True, bad - p, total - n)):
                if hits:
                    worth = (round(hits * (math.log2(hits / size) - before), 9), (high - low) / span)
                    if worth > best:
                        best, found = worth, Test(f, above, round((low + high) / 2, 6))
    return best[0], found


def grow(rows: list[dict]) -> Rule:
    """Adds tests until no other row is covered or nothing is gained."""
    rule: Rule = ()
    while len(rule) < 4 and 0 < sum(r["bad"] for r in rows) < len(rows):
        _, test = best_test(rows)
        if test is None:
            break
        rule, rows = (*rule, test), [r for r in rows if test.holds(r)]
    return rule


def prune(rule: Rule, rows: list[dict]) -> Rule:
    """The beginning of the rule that is worth most on rows it was not grown on; the shorter of equals."""

    def worth(r: Rule) -> float:
        a, b = counts(r, rows)
        return (a - b) / (a + b) if a + b else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())


def cover(rows: list[dict], precision: float = 0.95, least: int = 3, most_rules: int = 12) -> list[Rule]:
    """The ordered rules that reject; rows are dicts of FEATURES and bad (0 or 1)."""
    rules: list[Rule] = []
    left = rows
    while len(rules) < most_rules and any(r["bad"] for r in left):
        held = left[::3]
        rule = prune(grow([r for i, r in enumerate(left) if i % 3]), held)
        if not rule:
            break
        a, b = counts(rule, left)
        p, q = counts(rule, held)
        if a < least or a < precision * (a + b) or p < precision * (p + q):
            break
        rules.append(rule)
        left = [r for r in left if not covers(rule, r)]
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> list[Rule]:
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    met = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # `most` ids
    texts = met.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
    rows = with_statistics(texts).select("doc_id", F.expr("int(quality = 0)").alias("bad"), *(F.expr(f"double({e})").alias(n) for n, e in FEATURES.items()))
    found = [r.asDict() for r in rows.collect()]
    return cover(sorted(found, key=lambda r: (r["doc_id"], *(r[f] for f in FEATURES))))


def verdict(rules: list[Rule]) -> Column:
    """Whether the decision list keeps a row of statistics."""
    chain = None
    for rule in rules:
        test = F.expr(" AND ".join(t.sql() for t in rule))
        chain = F.when(test, False) if chain is None else chain.when(test, False)
    return F.lit(True) if chain is None else chain.otherwise(True)


def judged(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """docs with statistics, base_failed and kept (false if base_failed, else the list's verdict)."""
    rules = learn_rules(docs, labels, most)
    scored = with_statistics(docs).withColumn("base_failed", base_failed())
    return scored.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def kept_only(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """The rows of docs that judged() keeps, with its columns."""
    return judged(docs, labels, most).where("kept")
