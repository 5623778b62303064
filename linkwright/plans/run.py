"""The whole linkage from files to checked match lists, in stages that are skipped once they are done.

    python -m linkwright.plans.run --data DIR --work DIR [--eval-blocking] [--n-s1 150000] [--top-k 50] ...

``--data`` has ``train`` and ``test`` with ``{split}_source{1,2,3}.tsv``, and the truth of ``train``. Every stage writes a
folder under ``--work`` that counts once its ``_SUCCESS`` marker is there, so a run that was broken off goes on where it was.
Folders are named by the settings that they depend on.
"""

from __future__ import annotations

import argparse
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.functions.scripts import latin_records
from linkwright.operators import measure, model, quality, sampling
from linkwright.plans import linkage
from linkwright.plans.linkage import Linkage, Settings, run_stage
from linkwright.sources import records as R

MODES = ("auto", "on", "off")


def options(arguments: list[str] | None = None) -> argparse.Namespace:
    own, places = Settings(), R.Places()
    p = argparse.ArgumentParser(description="link business records")
    p.add_argument("--data", default=places.data)
    p.add_argument("--work", default=places.work)
    p.add_argument("--model-dir", help="a saved bundle; trains one under --work without it")
    p.add_argument("--eval-blocking", action="store_true", help="also writes the recall of the candidates of a sample")
    p.add_argument("--check-ids", action="store_true", help="also checks that every id of the lists is known")
    p.add_argument("--rebuild", action="store_true", help="makes every stage again")
    p.add_argument("--batches", type=int, default=8, help="parts of the first source that are scored one after the other")
    p.add_argument("--stage3", choices=MODES, default=own.stage3)
    whole = ("n_s1", "top_k", "reverse_k", "siblings", "seed", "rounds", "patience", "least_rows")
    for name in (*whole, "drop_s1", "stage1_recall", "min_idf"):
        p.add_argument("--" + name.replace("_", "-"), type=int if name in whole else float, default=getattr(own, name))
    return p.parse_args(arguments)


def settings_of(o: argparse.Namespace) -> Settings:
    return Settings(**{k: getattr(o, k) for k in Settings.__dataclass_fields__ if hasattr(o, k)})


def sources(spark: SparkSession, places: R.Places, split: str) -> DataFrame:
    """The records of a split, with src, in Latin letters."""
    read = R.read_tsv(spark, [places.source(split, i) for i in (1, 2, 3)])
    return latin_records(read.withColumn("src", R.source_of(F.col("entity_id"))))


def run(spark: SparkSession, o: argparse.Namespace) -> int:
    """An exit code: that of the check of the written lists."""
    settings, places = settings_of(o), R.Places(o.data, o.work)
    if not R.exists(spark, places.source("train", 1)) and (found := R.find_training_folder(spark, o.data)):
        places = R.Places(found, o.work)
    tag = hashlib.md5(repr((places.data, settings)).encode()).hexdigest()[:12]
    stage = lambda name, make: run_stage(spark, name, places.artefact(f"{tag}/{name}"), make, o.rebuild)

    def work_on(split: str, truth: DataFrame) -> Linkage:
        """A linkage whose index, reverse lists and prepared records are stages of their own."""
        work = Linkage(stage(f"{split}_records", lambda: sources(spark, places, split)), truth, settings, keep=True)
        bags = stage(f"{split}_bags", lambda: work.bags)
        work.__dict__["bags"] = bags
        for name in ("index1", "index23"):
            work.__dict__[name] = tuple(stage(f"{split}_{name}_{part}", lambda i=i, name=name: getattr(work, name)[i]) for i, part in enumerate(("postings", "idf")))
        for name in ("reverse", "prepared"):
            work.__dict__[name] = stage(f"{split}_{name}", lambda name=name: getattr(work, name))
        return work

    bundle = o.model_dir or places.artefact(f"{tag}/model")
    if not o.model_dir or o.eval_blocking:
        truth = stage("truth", lambda: measure.truth_pairs(R.read_tsv(spark, places.truth("train"), R.TRUTH)))
        train = work_on("train", truth)
        if o.eval_blocking:
            sample = train.some(sampling.fixed_sample(train.s1, 10_000, settings.seed), keep=True)
            own = truth.join(sample.s1.select(F.col("entity_id").alias("source1_entity_id")), "source1_entity_id", "left_semi")
            stage("blocking_recall", lambda: measure.recall_at_k(sample.forward, own)).orderBy("k").show(truncate=False)
        if not o.model_dir and (o.rebuild or not R.exists(spark, f"{bundle}/selection/_SUCCESS")):
            linkage.learn(train, bundle)
    models, selection = model.load(spark, bundle)
    test = work_on("test", spark.createDataFrame([], "source1_entity_id string, candidate_entity_id string"))
    scored = linkage.score_in_batches(spark, test, models, selection, places.artefact(f"{tag}/scored"), o.batches, o.rebuild)
    matches, candidates = linkage.lists(test, scored, selection)
    matching, listed = places.artefact("matching_results.tsv"), places.artefact("candidate_pairs.tsv")
    R.write_tsv(matches, matching)
    R.write_tsv(candidates, listed)
    rates = quality.list_statistics(matches.select(F.col("source1_entity_id").alias("entity_id"), F.col("matched_entity_ids").alias("ids"))).first()
    print(f"{rates['n_rows']} entities, {rates['n_empty']} without a match, {rates['n_ids']} matches")
    known = test.s23.select("entity_id") if o.check_ids else None
    return quality.check_files(spark, matching, listed, R.read_ids(spark, places.source("test", 1)), known)


def main(arguments: list[str] | None = None) -> int:
    return run(SparkSession.builder.appName("linkage").getOrCreate(), options(arguments))


if __name__ == "__main__":
    raise SystemExit(main())
