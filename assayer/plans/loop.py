"""Active-learning rounds: train on the ledger, score the library, score the best new items for real."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.operators.joins import not_in
from assayer.operators.ledger import fold, round_stats, STATS_SHARE, union_rounds
from assayer.plans.consensus import select_top
from assayer.plans.models import library_vectors, score_vectors
from assayer.session import fresh_path, stored


def score_items(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], n_tasks: int | None = None, strict: bool = True) -> DataFrame:
    """``item, name, score, reason`` from an expensive scorer run over even parts of the table.

    The scorer takes a frame of ``item, name`` and returns ``name, score``.  A failing
    part fails the job when strict; otherwise its rows carry the reason.
    """
    schema = T.StructType(
        [df.schema["item"], df.schema["name"], T.StructField("score", T.DoubleType()), T.StructField("reason", T.StringType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                scored = batch.merge(scorer(batch)[["name", "score"]], on="name", how="left")
                scored["reason"] = scored["score"].isna().map({True: "no score", False: None})
            except Exception as error:
                if strict:
                    raise
                scored = batch.assign(score=None, reason=str(error))
            yield scored[["item", "name", "score", "reason"]]

    rows = df.select("item", "name")
    return (rows.repartition(n_tasks) if n_tasks else rows.repartition("name")).mapInPandas(run, schema)


def with_features(df: DataFrame, fn: Callable[[pd.Series], pd.DataFrame], item: str, schema: str, reason: str | None = None) -> DataFrame:
    """Descriptor columns from a featuriser over Arrow batches; a failing item gets NULLs and, in column ``reason``, why.

    A batch that fails is halved until the failing items stand alone, so a few bad ones cost a few more calls each.
    """
    added = T._parse_datatype_string(schema)
    names = added.names
    fields = [*df.schema.fields, *added.fields] + ([T.StructField(reason, T.StringType())] if reason else [])

    def features(values: pd.Series) -> pd.DataFrame:
        try:
            return fn(values).reset_index(drop=True)[names].assign(_reason=None)
        except Exception as error:
            if len(values) == 1:
                return pd.DataFrame([dict.fromkeys(names) | {"_reason": str(error) or type(error).__name__}])
        half = len(values) // 2
        return pd.concat([features(values.iloc[:half]), features(values.iloc[half:])], ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                found = features(batch[item]).set_axis(batch.index)
                out = pd.concat([batch, found[names]], axis=1)
                yield out.assign(**{reason: found["_reason"]}) if reason else out

    return df.mapInPandas(run, T.StructType(fields))


class Rounds:
    """The files of a run: one folder per step and round, and a mark that is written after it.

    A step counts as done only with its mark, so what a killed run left half-written is written anew, and what is done is
    read back instead of being chosen or scored again.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def step(self, name: str, number: int, make: Callable[[], DataFrame]) -> DataFrame:
        path, mark = f"{self.folder}/{name}/round={number}", f"{self.folder}/marks/{name}-{number}"
        if not self._there(mark):
            out = make()
            out.write.mode("overwrite").parquet(path)
            self.spark.createDataFrame([(name, number, json.dumps(out.schema.jsonValue()))], "step string, round int, schema string").write.mode("overwrite").json(mark)
        schema = T.StructType.fromJson(json.loads(self.spark.read.schema("schema string").json(mark).first().schema))
        return self.spark.read.schema(schema).parquet(path)

    def _there(self, mark: str) -> bool:
        try:
            return not self.spark.read.schema("step string").json(mark).isEmpty()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return False
            raise


def run_rounds(
    library: DataFrame, start: DataFrame, score: Callable[[DataFrame], DataFrame], fits: Mapping[str, Callable[[DataFrame], Model]],
    rounds: int = 5, bits: str = "bits", n_bits: int = 2048, folder: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The ledger after all rounds (``item, name, score, round``) and its per-round statistics.

    ``library`` and ``start`` have ``item, name`` and the set bits; ``score`` is the
    expensive scorer as a frame to frame function with ``name, score``.  Each round's
    batch and results are written and read back, so no plan grows with the rounds.  A run that
    is started again on the ``folder`` of one that broke off goes on after its last whole step.
    """
    spark = library.sparkSession
    files = Rounds(spark, folder or fresh_path(spark, "rounds"))

    def scored(batch: DataFrame, number: int) -> DataFrame:
        out = files.step("scores", number, lambda: score(batch.select("item", "name")).select("item", "name", "score"))
        missing = out.filter(F.col("score").isNull()).count()
        if missing:
            raise RuntimeError(f"the scorer failed on {missing} items in round {number}")
        return out

    # fingerprints are read in every round, as vectors
    vectors = files.step("vectors", 0, lambda: library_vectors(library, bits, n_bits=n_bits))
    first = scored(files.step("batch", 0, lambda: start.select("item", "name")), 0)
    k = first.count()
    ledger = files.step("ledger", 0, lambda: fold(first, first.limit(0)))
    history = [(0, ledger)]
    for number in range(1, rounds + 1):
        def chosen(ledger: DataFrame = ledger) -> DataFrame:
            known = vectors.join(ledger.select("name", F.col("score").alias("y")), "name")
            train = stored(known.select("name", F.when(F.col("_known"), F.col("features")).alias("features"), "y"), "train")
            models = {label: fit(train) for label, fit in fits.items()}
            preds = stored(score_vectors(models, vectors), "preds")
            best = select_top(preds, list(models), k)
            return library.join(not_in(best, ledger, "name").select("name"), "name", "left_semi").select("item", "name")

        new = scored(files.step("batch", number, chosen), number)
        history.append((number, not_in(new.filter(F.col("score") < 0), ledger, "name")))
        ledger = files.step("ledger", number, lambda new=new, ledger=ledger: fold(new, ledger))
    # a row scored in round r counts in the statistics of r and every later round
    everything = stored(union_rounds(history), "history")
    so_far = everything.select("name", "score", F.explode(F.sequence(F.col("round"), F.lit(rounds))).alias("round"))
    stats = round_stats(
        so_far.withColumn("_tie", F.xxhash64("name")), int(k * STATS_SHARE), "round", "score", "_tie"
    )
    return everything, stats
