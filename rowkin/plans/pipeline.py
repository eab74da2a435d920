"""Entry points: train on a labelled split, score a new one, adapt the joint scorer to it, decide again from saved scores.

Stages are materialised as Parquet under a work folder that all executors see. A complete stage of an earlier run is used again if its inputs, by content, and its configuration
are the same. What was trained can be saved, and loaded in another session.

The versions of the second model add to each other: v1 the competition around the first model's score; v2 the joint scorer; v3 a second, adapted scorer and sibling consensus; v4 a
third scorer; v5 the generic-word features; v6 a fourth scorer.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkin.operators import blocking, context, decide, features, folds
from rowkin.operators.normalize import normalise, pair_text
from rowkin.plans.models import FoldModels, PairScorer, embedded, fit_folds, likely
from rowkin.sources.tables import fingerprint, id_lists, materialised, read_text, truth_pairs, write_text

#: The joint scorers that a version reads, by column.
SCORERS = {"v1": (), "v2": ("ce",), "v3": ("ce", "ce2"), "v4": ("ce", "ce2", "ce3"), "v5": ("ce", "ce2", "ce3"), "v6": ("ce", "ce2", "ce3", "ce4")}
#: Boosting rounds of the second model; from v3 on the other fold may stop them early.
ROUNDS, STOPPED, HELD = {"v1": 300}, ("v3", "v4", "v5", "v6"), 0.3


@dataclass
class Config:
    """Work folder, retrieval cuts, boosting, version of the second model, decision, pseudo-labels, and the embedder and joint scorer of a run."""

    work: str
    top: int = 20
    kx: int = 3
    ks: int = 10
    drop: float = 0.19
    trees: dict = field(default_factory=dict)
    trees2: dict = field(default_factory=dict)
    version: str = "v2"
    embed: Callable[[Column], Column] = field(default_factory=blocking.NgramEmbedder)
    scorer: Callable[..., PairScorer] = PairScorer
    least_p: float = 0.005  # pairs worth the joint scorers
    generic_share: float = 0.002
    base_pairs: int = 1_000_000  # labelled pairs that an adapted scorer is trained on
    hot: str | None = None  # the country that pseudo-labels are drawn from first
    most_hot: int = 900_000
    most_other: int = 600_000
    thresholds: dict[str, float] = field(default_factory=dict)
    default_threshold: float = 0.7

    def key(self) -> str:
        """What results depend on."""
        return repr({k: getattr(v, "__qualname__", None) or repr(v) for k, v in vars(self).items() if k not in ("work", "thresholds", "default_threshold")})


@dataclass
class Trained:
    """Both models, the joint scorers by column, the embedder, the chosen decision, and its reports on out-of-fold scores of the matcher folds and on the validation folds."""

    stage1: FoldModels
    scorers: dict[str, PairScorer]
    stage2: FoldModels
    method: str
    report: DataFrame
    validation: DataFrame
    version: str
    embed: Callable[[Column], Column]
    base: str  # fingerprints of the tables and the configuration: of all versions, and of this one
    key: str

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.stage1.save(f"{path}/stage1")
        self.stage2.save(f"{path}/stage2")
        for name, scorer in self.scorers.items():
            scorer.save(f"{path}/scorers/{name}")
        for name, df in (("report", self.report), ("validation", self.validation)):
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        embed = vars(self.embed) if isinstance(self.embed, blocking.NgramEmbedder) else None
        write_text(spark, f"{path}/decision.json", json.dumps({"method": self.method, "version": self.version, "scorers": list(self.scorers), "embed": embed, "base": self.base, "key": self.key}))

    @classmethod
    def load(cls, path: str, scorer: type[PairScorer] = PairScorer, embed: Callable[[Column], Column] | None = None) -> Trained:
        """What ``save`` wrote. An embedder of another kind than the default must be given."""
        spark = SparkSession.active()
        known = json.loads(read_text(spark, f"{path}/decision.json"))
        if embed is None:
            if known["embed"] is None:
                raise ValueError("the embedder was not saved; pass the one that was trained with")
            embed = blocking.NgramEmbedder(known["embed"]["size"], known["embed"]["n"], known["embed"]["weights"] and tuple(known["embed"]["weights"]))
        scorers = {name: scorer.load(f"{path}/scorers/{name}") for name in known["scorers"]}
        report, validation = (spark.read.parquet(f"{path}/{name}") for name in ("report", "validation"))
        return cls(FoldModels.load(f"{path}/stage1"), scorers, FoldModels.load(f"{path}/stage2"), known["method"], report, validation, known["version"], embed, known["base"], known["key"])


@dataclass
class Split:
    """The tables of one split on the way: normalised records of both sides, their embeddings, and the pruned candidate pairs."""

    left: DataFrame
    right: DataFrame
    entities: DataFrame
    records: DataFrame
    candidates: DataFrame


def candidates(primary: DataFrame, secondary: DataFrame, config: Config, name: str, embed: Callable[[Column], Column], key: str) -> Split:
    """Normalised sources, embeddings and the pruned candidate pairs of a split."""
    left, right = (materialised(normalise(df), f"{config.work}/{name}_norm_{side}", key) for side, df in (("s", primary), ("x", secondary)))
    e, r = (materialised(embedded(df, embed).select(F.col("country").alias("block"), F.col("entity_id").alias(k), "e"), f"{config.work}/{name}_embed_{k}", key) for df, k in ((left, "s"), (right, "x")))
    return Split(left, right, e, r, materialised(blocking.prune(blocking.block_topk(e, r, config.top), config.kx, config.ks).drop("block"), f"{config.work}/{name}_cand", key))


def texts(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    text = pair_text(F.coalesce("business_name", F.lit("")), F.coalesce("business_address", F.lit("")))
    return pairs.join(left.select(F.col("entity_id").alias("s"), text.alias("text_s")), "s").join(right.select(F.col("entity_id").alias("x"), text.alias("text_x")), "x")


def stage2_columns(feat: DataFrame, scored: DataFrame, logits: dict[str, DataFrame], version: str = "v2", split: Split | None = None, generic_share: float = 0.002, generic: bool = True) -> DataFrame:
    """Kept pair columns with all that a version's second model reads: the competition around the scores, sibling consensus and the generic-word features.

    ``scored``: s, x, p1 and what is to be kept beside; ``logits``: a frame (s, x, name) for each scorer of the version. From v3 on ``split`` gives the embeddings, from v5 on the records, if not ``generic`` is off.
    """
    kept = feat.select("s", "x", *(c for c in (features.KEPT if version == "v1" else features.KEPT2) if c in feat.columns))
    others = []
    if version not in ("v1", "v2"):
        others.append(context.sibling_consensus(scored.select("s", "x", F.col("p1").alias("p")), split.entities, split.records))
    if generic and version in ("v5", "v6"):
        others.append(features.generic_features(scored.select("s", "x"), split.left, split.right, generic_share))
    every = context.all_rounds(context.assembled(kept, scored, {name: logits[name] for name in SCORERS[version]}, others), "p1", SCORERS[version])
    return context.sibling_rank(every) if others else every


def _logits(scorers: dict[str, PairScorer], scored: DataFrame, split: Split, config: Config, name: str, key: str) -> dict[str, DataFrame]:
    """Each scorer's log-odds of the likely pairs."""
    if not scorers:
        return {}
    pairs = texts(likely(scored, config.least_p).select("s", "x"), split.left, split.right)
    return {c: materialised(scorer.score(pairs, c).select("s", "x", c), f"{config.work}/{name}_{c}", key) for c, scorer in scorers.items()}


def _report(best: DataFrame, truth: DataFrame, left: DataFrame, config: Config, chosen: tuple[int, ...]) -> DataFrame:
    """Every method's score over the entities of some folds that are not left out."""
    keys = left.select(F.col("entity_id").alias("s")).filter(~folds.dropped("s", config.drop) & folds.fold("s").isin(list(chosen)))
    return decide.choose_method(best.filter(F.col("f").isin(list(chosen))), truth.join(keys, "s", "left_semi"), keys)


def train(primary: DataFrame, secondary: DataFrame, lists: DataFrame, config: Config, earlier: Trained | None = None, scorers: dict[str, PairScorer] | None = None) -> Trained:
    """Fits both models and the joint scorer, and chooses the decision on out-of-fold scores of the matcher folds.

    ``scorers``: those that ``adapt`` made, by column; versions from v3 on need them. ``earlier``: what a version before was trained to on the same tables; its first model, embedder
    and scorers are used again.
    """
    scorers = (earlier.scorers if earlier else {}) | (scorers or {})
    if lacking := [c for c in SCORERS[config.version] if c != "ce" and c not in scorers]:
        raise ValueError(f"{config.version} reads {', '.join(lacking)}; adapt() makes them")
    base = fingerprint("base", replace(config, version="", trees2={}).key(), primary, secondary, lists)
    key = fingerprint(base, config.version, config.trees2, {c: getattr(scorers[c], "key", repr(scorers[c])) for c in SCORERS[config.version] if c in scorers})
    same = earlier if earlier and earlier.base == base else None
    truth, embed = truth_pairs(lists), same.embed if same else config.embed
    if hasattr(embed, "fit") and not same:
        known = primary.filter(folds.fold("entity_id").isin(list(folds.EMBEDDING_FOLDS)))
        embed = embed.fit(known.select(F.lower(pair_text(F.coalesce("business_name", F.lit("")), F.coalesce("business_address", F.lit("")))).alias("text")))
    split = candidates(primary, secondary, config, "train", embed, base)
    feat = materialised(folds.labelled(features.pair_features(split.candidates, split.left, split.right), truth).withColumn("f", folds.fold("s")), f"{config.work}/train_feat", base)
    stage1 = same.stage1 if same else fit_folds(feat, features.STAGE1, **config.trees)
    scored = materialised(stage1.score(feat, "p1").select("s", "x", "y", "f", "p1"), f"{config.work}/train_p1", base)
    if SCORERS[config.version] and "ce" not in scorers:
        scorers = {"ce": config.scorer().fit(texts(folds.hard_pairs(feat), split.left, split.right).select("text_s", "text_x", F.col("y").cast("double").alias("y")))} | scorers
    scorers = {c: scorers[c] for c in SCORERS[config.version]}
    logits = _logits(scorers, scored, split, config, f"train_{config.version}", key)
    full = stage2_columns(feat, scored.filter(~folds.dropped("s", config.drop)), logits, config.version, split, config.generic_share)
    full = materialised(full, f"{config.work}/train_{config.version}_full", key)
    most = {"maxIter": ROUNDS.get(config.version, 400)}
    stage2 = fit_folds(full, features.STAGE2[config.version], validate=HELD if config.version in STOPPED else 0.0, **(most | config.trees | config.trees2))
    best = materialised(decide.exclusive(stage2.score(full, "q")), f"{config.work}/train_{config.version}_best", key)
    report, validation = (_report(best, truth, split.left, config, f) for f in (folds.MATCHER_FOLDS, folds.VALIDATION_FOLDS))
    return Trained(stage1, scorers, stage2, report.filter("chosen").first()["method"], report, validation, config.version, embed, base, key)


def score(primary: DataFrame, secondary: DataFrame, trained: Trained, config: Config, name: str = "test") -> DataFrame:
    """(s, x, p1, q, country) of all candidate pairs of a new split."""
    base = fingerprint("score", replace(config, version="", trees2={}).key(), trained.base, primary, secondary)
    key = fingerprint(base, trained.key)
    split = candidates(primary, secondary, config, name, trained.embed, base)
    feat = materialised(features.pair_features(split.candidates, split.left, split.right), f"{config.work}/{name}_feat", base)
    scored = materialised(trained.stage1.score(feat, "p1", None).select("s", "x", "p1"), f"{config.work}/{name}_p1", base)
    logits = _logits(trained.scorers, scored, split, config, f"{name}_{trained.version}", key)
    full = trained.stage2.score(stage2_columns(feat, scored, logits, trained.version, split, config.generic_share), "q", None).select("s", "x", "p1", "q")
    return materialised(full.join(split.left.select(F.col("entity_id").alias("s"), "country"), "s"), f"{config.work}/{name}_{trained.version}_scores", key)


def adapt(trained: Trained, scores: DataFrame, new: tuple[DataFrame, DataFrame], base: tuple[DataFrame, DataFrame, DataFrame], config: Config) -> dict[str, PairScorer]:
    """The scorers with a further one, ce2, ce3 or ce4, that goes on from the last: trained on hard labelled pairs and on sure pairs of an unlabelled split.

    ``scores``: what ``score`` returned for the split; ``new``: its sources; ``base``: primary, secondary and match lists that the model was trained on, in ``config``'s work folder.
    """
    primary, secondary, lists = base
    known = lists.sparkSession.read.parquet(f"{config.work}/train_cand").withColumn("f", folds.fold("s"))
    hard = folds.sampled(folds.labelled(folds.hard_pairs(known).select("s", "x"), truth_pairs(lists)), ["s", "x"], config.base_pairs, seed="5")
    pseudo = folds.pseudo_labels(scores, config.hot, config.most_hot, config.most_other)
    both = [texts(pairs, *sides).select("text_s", "text_x", F.col("y").cast("double").alias("y")) for pairs, sides in ((hard, (primary, secondary)), (pseudo, new))]
    last = list(trained.scorers.values())[-1]
    return trained.scorers | {f"ce{len(trained.scorers) + 1}": config.scorer(start=last).fit(both[0].unionByName(both[1]))}


def rounds(base: tuple[DataFrame, DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], config: Config, last: str = "v6") -> tuple[Trained, DataFrame]:
    """The whole loop from v2 up to a version: train, score the new split, adapt a scorer to it, and train again. The last model and its scores."""
    versions = [v for v in SCORERS if "v1" < v <= last]
    trained = train(*base, replace(config, version=versions[0]))
    scores = score(*new, trained, config, "new")
    for version in versions[1:]:
        scorers = adapt(trained, scores, new, base, config) if len(SCORERS[version]) > len(trained.scorers) else trained.scorers
        trained = train(*base, replace(config, version=version), trained, scorers)
        scores = score(*new, trained, config, "new")
    return trained, scores


def results(scores: DataFrame, primary: DataFrame, method: str) -> tuple[DataFrame, DataFrame]:
    """The match lists and the candidate lists, one row per primary entity."""
    picked = decide.predictions(decide.exclusive(scores), method)
    return id_lists(picked, primary), id_lists(scores, primary, "candidate_entity_ids")


def decide_again(scores: DataFrame, primary: DataFrame, thresholds: dict[str, float], default: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Match lists by thresholds per country from saved scores, and their report."""
    picked = decide.above_by_group(decide.exclusive(scores), thresholds, default)
    return id_lists(picked, primary), decide.variant_report(picked, primary.select(F.col("entity_id").alias("s"), "country"))
