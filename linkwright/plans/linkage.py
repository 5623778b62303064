"""The linkage of records as one lazy plan, with the steps that its stages share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.functions.scripts import latin_records
from linkwright.operators import bag, candidates, decide, measure, model, pairs, quality, retrieve, sampling
from linkwright.sources import records as R


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the place that all machines share; without one only a local master goes on, with a folder of its own."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        top = f"{tempfile.gettempdir()}/checkpoints"
    return f"{top}/linkwright-{uuid.uuid4().hex}"


@contextmanager
def shuffles_cleared(spark: SparkSession):
    """Spark deletes the shuffles of each execution in here as it ends; otherwise they lie on disk until the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def written(df: DataFrame) -> DataFrame:
    """``df`` by way of Parquet in the folder that all machines share, so that later steps don't compute it again.

    What its computation shuffled is deleted, so that a plan's disk is that of its largest step, not of all of them.
    """
    path = shared_folder(df.sparkSession)
    with shuffles_cleared(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Pair features are made in so many parts, one after another.
PARTS = 4


def featured(rows: DataFrame, prepared: DataFrame, parts: int = PARTS) -> DataFrame:
    """``rows`` (pairs, written before) with their pair features, written.

    Every pair carries a prepared record through a shuffle, several times the input in all, so the pairs go part by part, by hash
    of the entity, and each part's shuffles are deleted before the next. All pairs are in one of the parts.
    """
    path = shared_folder(rows.sparkSession)
    part = lambda c, i: F.pmod(F.xxhash64(c), F.lit(parts)) == i
    with shuffles_cleared(rows.sparkSession):
        for i in range(parts):
            made = pairs.pair_features(rows.where(part("source1_entity_id", i)), prepared)
            made.write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(made.schema).parquet(path)


@dataclass
class Settings:
    """What a run may set."""

    top_k: int = 50
    reverse_k: int = 3
    n_anchor: int = 5
    siblings: int = 5
    min_idf: float = retrieve.MIN_IDF
    stage1_recall: float = 0.998
    stage3: str = "auto"
    seed: int = 42
    drop_s1: float = 0.18  # share of first-source records that training leaves out, so that their matches match nothing
    n_s1: int = 150_000  # first-source records whose pairs training takes
    rounds: int = 3000  # of boosting, at the most
    patience: int = 100  # rounds without a gain that end it
    least_rows: int | None = None  # of a leaf; by stage unless given


class Linkage:
    """Steps from records to candidate pairs. ``records`` has entity_id, src, country, business_name and business_address.

    ``keep`` writes what several steps read, as a production run does; other scripts are then romanised first, unless ``latin``
    is false (without it, records are taken to be in Latin letters, or to have gone through ``latin_records``). ``whole``: the
    linkage of all records, whose bags, index, reverse lists and prepared records hold for this one of some first-source records,
    too. ``world``: as ``whole``, but those others are gone from the first source, so reverse lists are this one's own.
    """

    def __init__(self, records: DataFrame, truth: DataFrame, settings: Settings, keep: bool = False, whole: Linkage | None = None, latin: bool = True, world: Linkage | None = None) -> None:
        self.truth, self.settings, self.part, self.larger = truth, settings, whole is not None, whole or world
        self.keep = written if keep else lambda df: df
        self.records = written(latin_records(records)) if keep and latin and self.larger is None else records
        if self.larger is not None:
            self.__dict__.update({k: getattr(self.larger, k) for k in ("index23", "prepared", *(["reverse"] if self.part else []))})

    def some(self, wanted: DataFrame, keep: bool = False, world: bool = False) -> Linkage:
        """The linkage of those first-source records that ``wanted`` (entity_id) names, against all others."""
        others, named = self.records.where("src <> 'S1'"), {"world" if world else "whole": self}
        return Linkage(others.unionByName(self.s1.join(wanted.select("entity_id"), "entity_id", "left_semi").select(*others.columns)), self.truth, self.settings, keep, **named)

    @cached_property
    def s1(self) -> DataFrame:
        return self.records.where("src = 'S1'")

    @cached_property
    def s23(self) -> DataFrame:
        return self.records.where("src <> 'S1'")

    @cached_property
    def bags(self) -> DataFrame:
        if self.larger is not None:
            return self.larger.bags23.unionByName(self.larger.bags1.join(self.s1.select("entity_id"), "entity_id", "left_semi").select(*self.larger.bags.columns))
        return self.keep(bag.bags(self.records.select("entity_id", "src", "country", "business_name", "business_address")).select("entity_id", "src", "country", "bag"))

    @cached_property
    def bags1(self) -> DataFrame:
        return self.bags.where("src = 'S1'")

    @cached_property
    def bags23(self) -> DataFrame:
        return self.bags.where("src <> 'S1'")

    @cached_property
    def index23(self) -> tuple:
        return tuple(map(self.keep, retrieve.build_index(self.bags23, self.settings.min_idf)))

    @cached_property
    def index1(self) -> tuple:
        return tuple(map(self.keep, retrieve.build_index(self.bags1, self.settings.min_idf)))

    @cached_property
    def forward(self) -> DataFrame:
        return self.keep(retrieve.forward(self.bags1, self.index23, self.settings.top_k))

    @cached_property
    def reverse(self) -> DataFrame:
        return self.keep(retrieve.reverse(self.bags23, self.index1, self.settings.reverse_k))

    @cached_property
    def united(self) -> DataFrame:
        pairs = candidates.union_reverse(self.forward, self.reverse)
        own = self.s1.select(F.col("entity_id").alias("source1_entity_id"))
        return pairs.join(own, "source1_entity_id", "left_semi") if self.part else pairs

    @cached_property
    def anchored(self) -> DataFrame:
        return self.keep(candidates.anchors(self.united, self.reverse, self.settings.n_anchor))

    #: The nearest records of these anchors and others, where they have been found already.
    near = None

    @cached_property
    def edges(self) -> DataFrame:
        return self.keep(candidates.sibling_edges(self.anchored, self.bags23, self.index23, self.settings.siblings, self.near))

    @cached_property
    def expanded(self) -> DataFrame:
        return candidates.sibling_expand(self.anchored, self.edges)

    @cached_property
    def context(self) -> DataFrame:
        return self.keep(candidates.context_features(self.expanded, self.reverse, retrieve.reverse_summary(self.reverse), self.settings.reverse_k))

    @cached_property
    def prepared(self) -> DataFrame:
        return self.keep(pairs.token_weights(pairs.prepare(self.records), self.index23[1]))

    @cached_property
    def labelled(self) -> DataFrame:
        return measure.label_pairs(self.context, self.truth)

    @cached_property
    def entities(self) -> DataFrame:
        return measure.entity_counts(self.s1, self.truth)


def training_part(work: Linkage) -> Linkage:
    """What is learned from: a share of the first source is left out of the world, and of the rest some give pairs."""
    s = work.settings
    stay = written(sampling.drop_world(work.s1, s.drop_s1, s.seed + 1).select("entity_id"))
    world = work.some(stay, keep=True, world=True)
    return world.some(written(sampling.fixed_sample(stay, s.n_s1, s.seed)), keep=True)


def share(work: Linkage, part: Linkage) -> None:
    """Gives ``part``, which is of ``work``, those lists of all records that hold for it, before both need them.

    The other sources and their index are the same for both. So a record's forward list is the same, and so are the records
    nearest to an anchor, which are found once for the anchors of both. For callers that need the lists of all records anyway.
    """
    own = part.s1.select(F.col("entity_id").alias("source1_entity_id"))
    part.__dict__["forward"] = work.forward.join(own, "source1_entity_id", "left_semi")
    both = candidates.chosen_anchors(work.anchored).unionByName(candidates.chosen_anchors(part.anchored))
    work.near = part.near = written(candidates.nearest(both, work.bags23, work.index23, work.settings.siblings))


def train(work: Linkage) -> tuple[dict, dict]:
    """(models by stage, selection parameters and diagnostics).

    Rounds, rules and stages are chosen on a held-out fifth of the entities. Then the models are fitted again to all of them,
    with a tenth more rounds.
    """
    s, held = work.settings, sampling.is_validation(F.col("source1_entity_id"), seed=work.settings.seed)
    trees = {"minInstancesPerNode": s.least_rows} if s.least_rows else {}
    best = lambda df, stage: model.best_fit(df.where("NOT held"), df.where("held"), stage, s.rounds, s.patience, **trees)
    more = lambda stage: max(1, int(1.1 * rounds[stage]))
    rows = written(work.labelled.withColumn("held", held))
    entities = written(work.entities.where(sampling.is_validation(F.col("entity_id"), seed=s.seed)))
    nine = lambda c: F.round(c, 9)
    rounds, models, final = {}, {}, {}
    rounds[1], models[1] = best(rows, 1)
    final[1] = model.fit(rows, 1, more(1), **trees)
    scored = written(model.predict(final[1], model.predict(models[1], rows, "p1"), "f1"))
    positives = scored.where("held").select(nine("p1").alias("p1"), "label")
    least = model.prune_threshold(positives, s.stage1_recall)
    # Kernels run once over the pairs that either of the two models leaves.
    full = featured(scored.where((nine("p1") >= least) | (nine("f1") >= least)), work.prepared)
    own, every = full.where(nine("p1") >= least), full.where(nine("f1") >= least)
    rounds[2], models[2] = best(own, 2)
    choices = [(2, model.predict(models[2], own.where("held")))]
    if s.stage3 != "off":
        oof = model.out_of_fold(own.where("NOT held"), 2, rounds=rounds[2], **trees)
        third = written(decide.second_order(written(oof.unionByName(model.predict(models[2], own.where("held"), "p2"))), work.edges))
        rounds[3], models[3] = best(third, 3)
        choices.append((3, model.predict(models[3], third.where("held"))))
    tried = []
    for stage, df in choices:
        p = written(df.select("source1_entity_id", "candidate_entity_id", "p", "label"))
        rules = (("threshold", decide.tune_threshold(p, entities)), ("expected", decide.tune_expected(p, entities)))
        setting = max(({"stage": stage, "mode": mode} | decide.best_setting(table) for mode, table in rules), key=lambda x: x["f05"])
        loose = decide.select_threshold(p, 0.5, exclusive=False)
        tried.append(setting | {"f05_not_exclusive": decide.macro_f05(loose, entities).first()["f05"]})
    chosen = tried[-1] if s.stage3 == "on" else max(tried, key=lambda x: x["f05"])
    final[2] = model.fit(every, 2, more(2), **trees)
    if chosen["stage"] == 3:
        oof = written(model.out_of_fold(every, 2, rounds=more(2), **trees))
        final[3] = model.fit(written(decide.second_order(oof, work.edges)), 3, more(3), **trees)
    points = decide.operating_points(positives, entities, score="p1")
    report = {
        "val_by_stage": {str(t["stage"]): t["f05"] for t in tried}, "rounds": {str(k): v for k, v in rounds.items()}, "n_pairs": rows.count(),
        "positive_rate": rows.agg(F.avg("label")).first()[0], "oracle_f05": decide.oracle_f05(rows.where("held"), entities).first()[0],
        "oracle_f05_after_stage1": decide.oracle_f05(own.where("held"), entities).first()[0], "operating_points": [r.asDict() for r in points.orderBy("keep").collect()],
        "importances": {str(k): model.importances(m) for k, m in final.items()},
    }
    return final, chosen | {"stage1_threshold": least, "stages": sorted(final), "report": report}


def score(work: Linkage, models: dict, selection: dict) -> DataFrame:
    """Survivors of the first stage with p."""
    first = model.predict(models[1], work.context, "p1").where(F.round("p1", 9) >= selection["stage1_threshold"])
    full = featured(written(first), work.prepared)
    p2 = model.predict(models[2], full, "p2")
    if selection["stage"] == 2:
        return p2.withColumnRenamed("p2", "p")
    return model.predict(models[3], decide.second_order(written(p2), work.edges))


def choose(scored: DataFrame, selection: dict) -> DataFrame:
    if selection["mode"] == "threshold":
        return decide.select_threshold(scored, selection["threshold"], selection["rel"])
    return decide.select_expected(scored, selection["miss"], selection["power"])


def learn(work: Linkage, path: str, shared: bool = False) -> None:
    """Trains on a part of ``work`` and saves the bundle of models and selection. ``shared``: ``work`` itself is scored as a whole later."""
    part = training_part(work)
    if shared:
        share(work, part)
    models, selection = train(part)
    model.save(models, selection, work.records.sparkSession, path)


def link(records: DataFrame, truth: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame, dict]:
    """(match lists, candidate lists, selection) from records and the truth to learn from."""
    work = Linkage(records, truth, settings, keep=True)
    spark, bundle = records.sparkSession, shared_folder(records.sparkSession)
    learn(work, bundle, shared=True)
    models, selection = model.load(spark, bundle)
    scored = written(score(work, models, selection))
    return *lists(work, scored, selection), selection


def lists(work: Linkage, scored: DataFrame, selection: dict) -> tuple[DataFrame, DataFrame]:
    """(match lists, candidate lists) of all first-source records from scored pairs."""
    kept = choose(scored.select("source1_entity_id", "candidate_entity_id", "p"), selection)
    return quality.match_lists(work.s1, kept), quality.match_lists(work.s1, scored, column="candidate_entity_ids")


def documents(spark: SparkSession, sf_dir: str, settings: Settings, keep: bool = False) -> Linkage:
    """The linkage of the records made of ``documents``, which are read once. ``keep``: other scripts are romanised."""
    own = written(R.document_records(spark, sf_dir))
    return Linkage(own, R.document_truth(own), settings, keep=True, latin=keep)


def run_stage(spark: SparkSession, title: str, path: str, make, again: bool = False) -> DataFrame:
    """What a stage wrote, if it has; else, or ``again``, makes and writes it. A folder counts once its _SUCCESS marker is there."""
    if again or not R.exists(spark, f"{path}/_SUCCESS"):
        spark.sparkContext.setJobDescription(title)
        made = make()
        with shuffles_cleared(spark):
            made.write.mode("overwrite").parquet(path)
        spark.sparkContext.setJobDescription(None)
    return spark.read.parquet(path)


def score_in_batches(spark: SparkSession, work: Linkage, models: dict, selection: dict, path: str, batches: int, again: bool = False) -> DataFrame:
    """Scores by hash of the entity, a folder a batch; batches that are written are not computed again.

    The folder's name holds a digest of the settings, so other settings never meet its files. All pairs of an entity are in
    one batch, as the third stage needs.
    """
    tag = hashlib.md5(repr((work.settings, selection, batches)).encode()).hexdigest()[:12]
    for i in range(batches):
        part = work.some(work.s1.where(sampling.draw(F.col("entity_id"), 0) % batches == i))
        columns = ("source1_entity_id", "candidate_entity_id", "p")
        run_stage(spark, f"batch {i + 1} of {batches}", f"{path}/{tag}/batch={i}", lambda part=part: score(part, models, selection).select(*columns), again)
    return spark.read.parquet(f"{path}/{tag}").select("source1_entity_id", "candidate_entity_id", "p")
