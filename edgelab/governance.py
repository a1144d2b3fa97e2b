"""Splits, folds, registers and verdicts: driver-side records around the distributed work."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOOKS = "id string, reason string"
#: Dates at which validation and holdout begin (fixed values).
DECLARED = {"validate": "2024-07-01", "holdout": "2025-09-01"}
TRIAL = "id string, name string, segment string, when string, params string, score double"
STATES = ("EDGE", "SIGNAL ONLY", "INCONCLUSIVE", "NO EDGE")
REQUIRED = {"title": 0, "claim": 40, "mechanism": 30, "data": 0, "event": 0, "outcome": 0, "family": 0, "null": 0, "decision": 20, "author": 0}


@dataclass
class Split:
    """Train, validation and holdout ranges of bar numbers; the embargo trims the ends of the first two. ledger: a JSON ledger
    that keeps the looks at the holdout, so that another process finds it spent too."""

    n: int
    train: float = 0.6
    validate: float = 0.2
    embargo: int = 0
    looks: list[str] = field(default_factory=list)
    ledger: str | None = None

    def bounds(self) -> dict[str, tuple[int, int]]:
        a, b = int(self.n * self.train), int(self.n * (self.train + self.validate))
        return {"train": (0, max(0, a - self.embargo)), "validate": (a, max(a, b - self.embargo)), "holdout": (b, self.n)}

    def segment(self, bars: DataFrame) -> DataFrame:
        c = None
        for name, (lo, hi) in self.bounds().items():
            inside = (F.col("i") >= lo) & (F.col("i") < hi)
            c = F.when(inside, name) if c is None else c.when(inside, name)
        return bars.withColumn("segment", c)

    def holdout(self, bars: DataFrame, reason: str) -> DataFrame:
        """The holdout opens for a stated reason only; a second look finds it spent."""
        if len(reason.strip()) < 20:
            raise PermissionError("the holdout needs a reason of at least 20 characters")
        spark = bars.sparkSession
        if self.looks or (self.ledger and read_ledger(spark, self.ledger, LOOKS).count()):
            raise PermissionError("the holdout is spent")
        self.looks.append(reason)
        if self.ledger:
            append_new(spark, self.ledger, spark.createDataFrame([(record_id({"reason": reason, "n": self.n}), reason)], LOOKS))
        return self.segment(bars).filter("segment = 'holdout'")


def walk_forward(n: int, lookback: int, step: int, embargo: int = 0, anchored: bool = False) -> list[tuple[int, int, int, int]]:
    """(fit from, fit to, test from, test to) of each fold; folds whose fit range is under half the lookback are left out."""
    out = []
    for start in range(lookback, n, step):
        lo, hi = (0 if anchored else start - lookback), start - embargo
        if hi - lo >= lookback // 2:
            out.append((lo, hi, start, min(start + step, n)))
    return out


def record_id(record: dict, length: int = 16) -> str:
    return hashlib.sha256(json.dumps(record, sort_keys=True).encode()).hexdigest()[:length]


def check_hypothesis(record: dict) -> str:
    """The record's id; raises if a field is missing or too short."""
    for name, least in REQUIRED.items():
        if len(str(record.get(name, "")).strip()) < max(1, least):
            raise ValueError(f"{name} needs at least {max(1, least)} characters")
    return record_id(record)


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON ledger; none where there is no such ledger yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).json(path) if there else spark.createDataFrame([], schema)


def append_new(spark: SparkSession, path: str, rows: DataFrame, key: str = "id") -> int:
    """Append rows whose key the JSON ledger does not hold; returns how many."""
    new = rows.join(read_ledger(spark, path, rows.schema).select(key), key, "left_anti").dropDuplicates([key])
    n = new.count()
    if n:
        new.write.mode("append").json(path)
    return n


def ladder(rungs: list[tuple[str, str]]) -> str:
    """Verdict of ordered (name, fail|warn|pass|skip): failures outrank gaps, gaps outrank warnings."""
    states = [s for _, s in rungs]
    if "fail" in states:
        return "REJECTED"
    if "skip" in states:
        return "INCOMPLETE"
    return "PASSED WITH WARNINGS" if "warn" in states else "PASSED"


def information_verdict(p_max: float, peer_ratio: float, other_symbol_agrees: bool) -> str:
    if p_max >= 0.05:
        return "NO EDGE"
    return "INCONCLUSIVE" if peer_ratio >= 2.5 or not other_symbol_agrees else "SIGNAL ONLY"


# ------------------------------------------------------------------ boundaries and trials


def boundaries(bars: DataFrame, stamps: dict[str, int]) -> DataFrame:
    """(symbol, name, first_bar): the number of bars before each stamp, which is the first bar of what begins there."""
    return bars.groupBy("symbol").agg(*(F.sum((F.col("ts") < t).cast("long")).alias(n) for n, t in stamps.items())).unpivot("symbol", list(stamps), "name", "first_bar")


def declared_segments(bars: DataFrame, dates: dict[str, str] | None = None) -> DataFrame:
    """Adds segment by the declared dates; the last session before each date belongs to none (the embargo). bars have session."""
    d = dates or DECLARED
    last = bars.groupBy("symbol").agg(*(F.max(F.when(F.col("session") < day, F.col("session"))).alias(f"last_{n}") for n, day in d.items()))
    x = bars.join(last, "symbol")
    segment = F.when(F.col("session") < d["validate"], F.when(F.col("session") != F.col("last_validate"), "train")).when(F.col("session") < d["holdout"], F.when(F.col("session") != F.col("last_holdout"), "validate")).otherwise("holdout")
    return x.withColumn("segment", segment).drop(*(f"last_{n}" for n in d))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("latest", F.row_number().over(w)).filter("latest = 1").drop("latest")


class TrialRegister:
    """Every configuration tried, with its results by bar: a ledger of trials and a table of results by segment."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def record(self, name: str, params: dict, segment: str, when: str, pnl: DataFrame, score: float | None = None) -> str:
        """Add a trial and its results (t, pnl); returns its id, which its name, parameters and segment fix."""
        trial = record_id({"name": name, "params": params, "segment": segment}, 12)
        self.spark.createDataFrame([(trial, name, segment, when, json.dumps(params, sort_keys=True), score)], TRIAL).coalesce(1).write.mode("append").json(f"{self.path}/trials")
        pnl.select(F.lit(trial).alias("id"), F.lit(when).alias("when"), "t", "pnl", F.lit(segment).alias("segment")).write.mode("append").partitionBy("segment").parquet(f"{self.path}/results")
        return trial

    def trials(self) -> DataFrame:
        """Each trial once, as last recorded."""
        return latest(read_ledger(self.spark, f"{self.path}/trials", TRIAL), ["id"], ["when"])

    def matrix(self, segment: str) -> DataFrame:
        """(cfg, t, pnl) of a segment's trials, as last recorded, of those with the usual number of bars (of equal ones the larger)."""
        rows = self.spark.read.parquet(f"{self.path}/results").filter(F.col("segment") == segment)
        rows = rows.join(self.trials().select("id", "when"), ["id", "when"]).dropDuplicates(["id", "t"])
        sizes = rows.groupBy("id").agg(F.count("*").alias("n"))
        usual = sizes.groupBy("n").agg(F.count("*").alias("k")).agg(F.max_by("n", F.struct("k", "n")).alias("n"))
        return rows.join(sizes.join(usual, "n").select("id"), "id").select(F.col("id").alias("cfg"), "t", "pnl")


# ------------------------------------------------------------------ protocol and verdicts


@dataclass
class Protocol:
    """A ladder of checks in order. A rung is a name and a function that gives (state, detail); the first failure stops the climb, and
    rungs after it stay unseen."""

    name: str
    rungs: list[tuple[str, object]] = field(default_factory=list)
    seen: list[tuple[str, str, str]] = field(default_factory=list)

    def climb(self) -> str:
        self.seen = []
        for name, check in self.rungs:
            state, detail = check()
            if state not in ("pass", "warn", "fail", "skip"):
                raise ValueError(f"{name}: no such state as {state}")
            self.seen.append((name, state, detail))
            if state == "fail":
                break
        return self.verdict()

    def verdict(self) -> str:
        return ladder([(n, s) for n, s, _ in self.seen] + [(n, "skip") for n, _ in self.rungs[len(self.seen) :]])

    def report(self) -> str:
        width = max([len(n) for n, _ in self.rungs] + [4])
        lines = [f"{n:<{width}}  {s:<4}  {d}".rstrip() for n, s, d in self.seen] + [f"{n:<{width}}  not reached" for n, _ in self.rungs[len(self.seen) :]]
        return "\n".join([self.name, "-" * len(self.name), *lines, "", f"Verdict: {self.verdict()}"])

    def save(self, spark: SparkSession, path: str) -> None:
        """The result as JSON and the report as text, in a folder of any store that Spark writes."""
        result = {"name": self.name, "verdict": self.verdict(), "rungs": [list(x) for x in self.seen]}
        for name, text in (("result.json", json.dumps(result, sort_keys=True)), ("report.txt", self.report())):
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/{name}")


@dataclass(frozen=True)
class Verdict:
    """The answer of a run: a state, the one reason that binds, and, for an EDGE alone, what to trade and its net expectancy."""

    name: str
    state: str
    reason: str
    config: str = ""
    net: str = ""
    evidence: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.state not in STATES:
            raise ValueError(f"no such state as {self.state}")
        if len(self.reason.strip()) < 20:
            raise ValueError("the reason needs to be a sentence of at least 20 characters")
        edge = self.state == "EDGE"
        if edge != bool(self.config) or edge != bool(self.net):
            raise ValueError("an EDGE names its configuration and net expectancy, and nothing else does")

    @classmethod
    def of_gates(cls, name: str, gates: list[tuple[str, str, str]], config: str = "", net: str = "") -> "Verdict":
        """The first gate that failed binds; with none, the configuration is an EDGE."""
        failed = [g for g in gates if g[1] == "fail"]
        if not failed:
            return cls(name, "EDGE", f"All {len(gates)} gates of the ladder were passed.", config, net)
        return cls(name, "NO EDGE", f"Stopped at the gate {failed[0][0]}: {failed[0][2]}", evidence=tuple(f"{n}: {d}" for n, _, d in failed[1:]))

    @classmethod
    def of_information(cls, name: str, p_max: float, peer_ratio: float, others_agree: bool) -> "Verdict":
        state = information_verdict(p_max, peer_ratio, others_agree)
        return cls(name, state, f"Family p {p_max:.4f}, winner over its peers {peer_ratio:.2f}, other symbols {'agree' if others_agree else 'do not agree'}.")


def replay(spark: SparkSession, path: str) -> list[Verdict]:
    """The verdicts of saved information tests, again from their numbers: a JSON ledger of (name, p_max, peer_ratio, others_agree)."""
    rows = read_ledger(spark, path, "name string, p_max double, peer_ratio double, others_agree boolean").orderBy("name").toLocalIterator()
    return [Verdict.of_information(r["name"], r["p_max"], r["peer_ratio"], r["others_agree"]) for r in rows]


def overfitting_report(pbo: dict) -> str:
    """Lines of a report on cross-validated overfitting, from the row of inference.pbo."""
    judged = "overfit" if pbo["pbo"] > 0.5 else "doubtful" if pbo["pbo"] > 0.1 else "sound"
    return "\n".join([f"Splits: {pbo['combinations']}", f"Probability of overfitting: {pbo['pbo']:.3f} ({judged})", f"Median logit: {pbo['lambda_median']:.3f}", f"In to out of sample: {pbo['slope']:.3f} x + {pbo['intercept']:.3f}", f"Chance of a loss out of sample: {pbo['prob_oos_loss']:.3f}"])
