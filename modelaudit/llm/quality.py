"""Quality classifier: a sparse ensemble of rules read off trees.

Statistics of each whole text (shares of characters and words of various kinds, repetition, lengths) are columns. Shallow
trees are fitted on a labelled sample; each path from a root is a rule, a conjunction of comparisons; an L1-penalised
logistic regression over all rules keeps few of them; and those are compiled into one Spark column expression over the
statistics. Scoring a corpus is one pass: statistics by array operations on batches, then the expression.

The training sample holds ``MAX_TRAIN`` labelled documents at most, those with the smallest hashes of their id. Labels,
lang, source and doc_id are never inputs of a score.

Defined cases: a null text counts as an empty one, whose statistics are all zero; labels that are null, or of ids that no
document has, are left out; a document with several labels is several training rows; with no labels, or one class only, each
score is the share of that class (0.5 without labels); ties in the training sample go by id; other columns are carried along;
an empty table gives an empty one. Statistics hold a long text's words at once. The same rows give the same model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelaudit.llm.storage import materialize, release

MAX_TRAIN, TREES, DEPTH, THRESHOLD = 20_000, 24, 4, 0.3
STATISTICS = (
    "log_chars", "log_words", "word_length", "share_upper", "share_digit", "share_symbol", "share_point", "share_bar", "share_bang", "share_other",
    "words_upper", "words_symbol_end", "words_bare_symbol", "words_repeat_last", "distinct_words", "words_a_line", "lines_repeated", "longest_word", "pairs_repeated", "half_repeats",
)
Rule = tuple[tuple[str, bool, float], ...]  # (statistic, at most?, bound)

_KIND = np.zeros(256, np.int8)  # 1 upper, 2 digit, 3 symbol, 4 point, 5 bar, 6 bang, 7 byte of a letter beyond ASCII
for _chars, _kind in ((range(65, 91), 1), (range(48, 58), 2), (b"#$%&*@^_~=+<>\\/{}[]", 3), (b".,;:?-'\"()", 4), (b"|", 5), (b"!", 6), (range(128, 256), 7)):
    _KIND[list(_chars)] = _kind
_SYMBOLS = "#$%&*@^_~=+<>\\/{}[]|!"


def statistics(text: str | None) -> list[float]:
    """The values of ``STATISTICS`` for one text."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_KIND[data], minlength=8) / len(data)
    n, lines = len(words), [x for x in text.split("\n") if x.strip()]
    upper = sum(1 for x in words if len(x) > 1 and x.isupper()) / n
    ends = sum(1 for x in words if x[-1] in _SYMBOLS) / n
    bare = sum(1 for x in words if not x[0].isalnum() and len(x) == 1) / n
    again = sum(1 for a, b in zip(words, words[1:], strict=False) if a == b) / n
    half = n // 2
    return [
        float(np.log1p(len(text))), float(np.log1p(n)), len(text) / n, *(float(kinds[k]) for k in range(1, 8)),
        upper, ends, bare, again, len(set(words)) / n, n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), float(min(max(map(len, words)), 1000)),
        1 - len(set(zip(words, words[1:], strict=False))) / max(1, n - 1), float(half > 4 and words[:half] == words[half : 2 * half]),
    ]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by its statistics; other columns stay."""
    own = {f"_{x}" for x in STATISTICS}
    kept = [f for f in docs.schema if f.name != text and f.name not in own]
    docs = docs.select(text, *[f"`{f.name}`" for f in kept])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`_{x}` double" for x in STATISTICS])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(x.as_py()) for x in batch[text]], float).reshape(-1, len(STATISTICS))
            names = [f.name for f in kept]
            yield pa.RecordBatch.from_arrays([batch[x] for x in names] + [pa.array(rows[:, i]) for i in range(len(STATISTICS))], names + [f"_{x}" for x in STATISTICS])
        release()

    return docs.mapInArrow(measure, schema)


def tree_rules(text: str) -> list[Rule]:
    """Every path from a root in the printed form of a forest, to leaves and inner nodes alike, as conjunctions without doubles."""
    rules: dict[Rule, None] = {}
    path: list[tuple[int, tuple[str, bool, float]]] = []
    for line in text.splitlines():
        depth = len(line) - len(line.lstrip())
        if found := re.match(r"\s*(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dE]+)\)", line):
            path = [x for x in path if x[0] < depth] + [(depth, (STATISTICS[int(found[1])], found[2] == "<=", float(found[3])))]
            tightest: dict[tuple[str, bool], float] = {}
            for _, (name, below, bound) in path:
                old = tightest.get((name, below))
                tightest[name, below] = bound if old is None else (min if below else max)(old, bound)
            rules[tuple(sorted((n, b, t) for (n, b), t in tightest.items()))] = None
        elif line.strip().startswith("Tree"):
            path = []
    return list(rules)


def rule_column(rule: Rule) -> Column:
    tests = [F.col(f"_{name}") <= bound if below else F.col(f"_{name}") > bound for name, below, bound in rule]
    out = tests[0]
    for x in tests[1:]:
        out = out & x
    return out.cast("double")


class RuleEnsemble:
    """A base value and weighted rules; ``score`` is a column of their logistic sum."""

    def __init__(self, base: float, rules: Sequence[tuple[Rule, float]]) -> None:
        self.base, self.rules = base, list(rules)

    def score(self) -> Column:
        total = F.lit(self.base)
        for rule, weight in self.rules:
            total = total + F.lit(weight) * rule_column(rule)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def __str__(self) -> str:
        return "\n".join(f"{w:+.3f}  " + " and ".join(f"{n} {'<=' if b else '>'} {t:.4g}" for n, b, t in r) for r, w in sorted(self.rules, key=lambda x: -abs(x[1])))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, penalty: float = 0.0005) -> RuleEnsemble:
    """Fit on documents (doc_id, text) and labels (doc_id, label of 0 or 1)."""
    known = labels.filter("label in (0, 1)").select("doc_id", F.col("label").cast("double").alias("label"))
    # max_train rows at most, so they may be broadcast
    sample = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_train)
    sample = materialize(sample, "quality-sample")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    x = F.array(*[f"_{s}" for s in STATISTICS])
    rows = with_statistics(texts.select("doc_id", "label", "text")).withColumn("features", array_to_vector(x)).coalesce(4)
    # learners draw by a row's place, so the order is fixed
    rows = materialize(rows, "quality-train").repartition(2, "doc_id").sortWithinPartitions("doc_id", "label", *[f"_{s}" for s in STATISTICS])
    shares = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two classes at most
    if len(shares) < 2:
        p = next(iter(shares), 0.5)
        return RuleEnsemble(float(np.log((p + 1e-3) / (1 - p + 1e-3))), [])
    rows = rows.cache()
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, featureSubsetStrategy="onethird", minInstancesPerNode=10, seed=7).fit(rows)
    rules = tree_rules(forest.toDebugString)
    applied = rows.select("label", array_to_vector(F.array(*[rule_column(r) for r in rules])).alias("features")).cache()
    model = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=50, standardization=False).fit(applied)
    weights = model.coefficients.toArray()
    rows.unpersist(), applied.unpersist()
    return RuleEnsemble(float(model.intercept), [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def score_documents(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """``docs`` without text, with ``score`` and ``predicted``."""
    scored = with_statistics(docs).withColumn("score", model.score())
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).drop(*[f"_{x}" for x in STATISTICS])


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> RuleEnsemble:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return fit(docs, labels.filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(True))))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_documents(docs, trained(spark, docs, sf_dir))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
