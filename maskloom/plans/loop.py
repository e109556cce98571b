"""The curation loop: predict, judge, relabel, move, refill, balance, repeat.

State is one narrow membership table, whose changes are written once per cycle (or after every step);
pixels stay where they are and are read only to fit, to predict and to judge. The driver holds
counts, scores and fitted parameters; a journal beside the states holds them, too, so that a run
can go on from any stored step.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import arrays as a
from maskloom.functions import masks
from maskloom.functions.hashing import DEFAULT_SEED
from maskloom.operators import curation as cur
from maskloom.operators import evaluate as ev
from maskloom.operators import registry as reg
from maskloom.operators import splits
from maskloom.operators.index import position_index
from maskloom.plans import learners
from maskloom.session import shared_dir
from maskloom.sources.changes import ChangeStore, changed_rows
from maskloom.sources.journal import RESUMED, Entry

# Collections that points live in; A is the parent of its parts and never changes.
BASE = ("A", "A_train", "A_val", "A_test", "B", "Z")

MEMBER_COLUMNS = ("point_id", "ord", "value", "collection")

# Steps of a cycle, as stored in snapshots.
SETUP, PREDICTED, BUILT_C, SPLIT_C, TRAINED, JUDGED, FOUND, RELABELED, UPDATED = range(9)

SCORES_SCHEMA = "run string, cycle int, model string, loss double, metric double"
STATS_SCHEMA = (
    "run string, cycle int, machine_labels bigint, selected bigint, lost bigint, removed bigint, "
    "filled bigint, transferred bigint, seconds double"
)
HISTORY_SCHEMA = "run string, cycle int, " + learners.HISTORY_SCHEMA


@dataclass
class LoopSettings:
    """What a run is parameterised by. ``weights=None`` uses the fallback shares."""

    run: str = "run"
    weights: splits.Weights | dict | None = splits.DEFAULT_WEIGHTS
    percent_to_replace: int = 30
    balance: bool = False
    fillup: bool = True
    seed: int = DEFAULT_SEED
    # Images per evaluation batch of the segmenter's score.
    eval_batch: int = ev.BATCH_SIZE
    # Truncate the machine side's images to whole numbers before judging, and only those.
    machine_uint8: bool = False
    # Demand size(A_test) = size(B) when C is built.
    strict: bool = True
    # Leave the loop when no machine label is found; else the former D is sampled again.
    stop_on_empty: bool = True
    store_after_each_step: bool = False
    c_ratios: tuple[float, float, float] = splits.FALLBACK_C_RATIOS


@dataclass
class CurationLoop:
    """One run over a points table (point_id, pos, h, w, image, truth) with dense ``pos``.

    ``labels`` (point_id, truth) are masks drawn by hand for relabelled points; where there are
    none, a relabelled point gets its stored truth.
    """

    points: DataFrame
    settings: LoopSettings = field(default_factory=LoopSettings)
    segmenter: str | learners.Segmenter = "threshold"
    discriminator: str | learners.Discriminator = "agreement"
    labels: DataFrame | None = None
    path: str | None = None
    # Loss and metric of the segmenter as expressions over pixel sums; see functions.metrics.
    loss: Column | None = None
    metric: Column | None = None

    def __post_init__(self) -> None:
        self.spark: SparkSession = self.points.sparkSession
        if self.path is None:
            self.path = f"{shared_dir(self.spark)}/loop-{uuid.uuid4().hex}"
        self.store = ChangeStore(self.spark, f"{self.path}/states")
        # Parts that the last stored state is made of, and collections that differ from it.
        self.parts: dict[str, list[str]] = {}
        self.fresh: set[str] = set()
        # Journal lines that go with the next stored state.
        self.pending: list[tuple[str, object]] = []
        # Collections that points move between, as last written.
        self.base: DataFrame | None = None
        # Collections a cycle derives from them: (point_id, ord, value) by name.
        self.derived: dict[str, DataFrame] = {}
        self.cycle, self.step = 0, SETUP
        self.n_points = 0
        self.sizes: dict[str, int] = {}
        self.segmenter_model = None
        self.discriminator_model = None
        self.scores: list[tuple] = []
        self.stats: list[tuple] = []
        self.history: list[tuple] = []
        # Folders of lost points and of predictions, by cycle.
        self.lost_folders: list[str] = []
        self.predicted_folders: dict[int, str] = {}
        # Counters of the cycle so far.
        self.counts: dict[str, int] = {}

    # --- state ------------------------------------------------------------------------------

    @property
    def members(self) -> DataFrame:
        """All collections as one membership frame."""
        columns = ("point_id", "ord", "value", "collection")
        rows = [self.base.select(*columns)]
        rows += [
            df.withColumn("collection", F.lit(name)).select(*columns)
            for name, df in self.derived.items()
        ]
        return reduce(DataFrame.unionByName, rows)

    def collection(self, name: str) -> DataFrame:
        """(point_id, ord, value) of one collection; a base collection is a folder of its own."""
        if name in self.derived:
            return self.derived[name]
        return self.base.filter(F.col("collection") == name).select("point_id", "ord", "value")

    def _derive(self, step: int, size: int | None = None, **collections: DataFrame) -> None:
        """Register derived collections and store the state if every step is stored."""
        for name, df in collections.items():
            self.derived[name] = df.select("point_id", "ord", F.col("value").cast("int").alias("value"))
            self.fresh.add(name)
            if size is not None:
                self.sizes[name] = size
        self.step = step
        if self.settings.store_after_each_step:
            self._save(step)

    def _save(self, step: int, base: DataFrame | None = None, changes: DataFrame | None = None) -> None:
        """Store what differs from the last state: derived collections whole, base ones by their changes.

        ``base`` writes the base collections whole. Counters and models so far go into the same entry.
        """
        names = sorted(self.fresh)
        frames = [
            self.derived[name].withColumn("collection", F.lit(name)).select(*MEMBER_COLUMNS) for name in names
        ]
        if base is not None:
            frames.append(base.select(*MEMBER_COLUMNS))
            names += list(BASE)
        whole = reduce(DataFrame.unionByName, frames) if frames else None
        self.parts = self.store.save(
            self.settings.run, self.cycle, step, whole, names, changes, self.parts, self._entries(step)
        )
        self.fresh.clear()

    def _entries(self, step: int) -> list[Entry]:
        """The waiting journal lines, as entries of a step."""
        lines, self.pending = self.pending, []
        return [Entry(self.settings.run, self.cycle, step, kind, payload) for kind, payload in lines]

    def _rebase(self, base: DataFrame, moves: list[DataFrame]) -> None:
        """Write the state with moved points and read it back: a cycle's lineage ends here.

        Rows are written in proportion to what moved, and a collection with many changes anew.
        """
        ids = reduce(DataFrame.union, [m.select("point_id") for m in moves])
        self.step = UPDATED
        self._save(UPDATED, changes=changed_rows(self.base, base, ids))
        whole, names = self.store.compact(self.parts)
        if names:
            self.parts = self.store.save(
                self.settings.run, self.cycle, UPDATED, whole, names, before=self.parts
            )
        self._load()

    def _load(self) -> None:
        """Read the state made of ``parts``; each derived collection from its own part only."""
        # A row per collection, about a dozen.
        state = self.store.read(self.parts)
        self.sizes = {r["collection"]: r["n_points"] for r in reg.sizes(state).collect()}
        self.base = self.store.read({name: self.parts.get(name, []) for name in BASE})
        self.derived = {
            name: self.store.read({name: self.parts[name]}).select("point_id", "ord", "value")
            for name in self.sizes
            if name not in BASE
        }
        self.fresh.clear()

    def _work(self, name: str, df: DataFrame) -> DataFrame:
        """Write an intermediate result of a cycle and read it back."""
        folder = f"{self.path}/work/run={self.settings.run}/cycle={self.cycle}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def _attach(self, name: str, members: DataFrame) -> DataFrame:
        """Pixels of the members of a collection, read only where such members can be."""
        ranges = splits.source_ranges(
            name, self.n_points, self.settings.weights, self.settings.balance
        )
        inside = self.points.filter(splits.in_ranges(F.col("pos"), ranges))
        return cur.attach(inside, members, self.sizes.get(name, 0))

    def _pixels(self, name: str) -> DataFrame:
        rows = self._attach(name, self.collection(name).select("point_id", "ord"))
        if self.labels is None or name != "A_train":
            return rows
        by_hand = self.labels.select("point_id", F.col("truth").alias("_by_hand"))
        # A mask drawn by hand counts wherever its point is trained on.
        return (
            rows.join(by_hand, "point_id", "left")
            .withColumn("truth", F.coalesce(F.col("_by_hand"), F.col("truth")))
            .drop("_by_hand")
        )

    # --- steps ------------------------------------------------------------------------------

    def setup_data(self, n_points: int | None = None) -> None:
        """Split the points into A, B, Z and the parts of A."""
        self.n_points = self.points.count() if n_points is None else n_points
        rows = splits.setup_split(self.points, self.n_points, self.settings.weights)
        self.derived, self.parts, self.step = {}, {}, SETUP
        self.pending.append(("points", self.n_points))
        self._save(SETUP, base=rows.withColumn("value", F.lit(None).cast("int")))
        self._load()

    def resume(
        self, n_points: int | None, cycle: int, step: int, store: ChangeStore | None = None
    ) -> "CurationLoop":
        """Continue from a stored state, with the models, scores and counters it had.

        ``proceed`` or the next step function takes it from there. With the ``store`` of another
        run's folder its states stay as they are, and this run's own store starts from there; in its own
        store, what the run had beyond that state is superseded. ``n_points`` may be None.
        """
        run, source = self.settings.run, store or self.store
        entries = source.journal.until(run, cycle, step)
        self.cycle, self.step = cycle, step
        self.parts = source.parts(run, cycle, step)
        if source is self.store:
            self.store.journal.append([Entry(run, cycle, step, RESUMED, None)])
        else:
            self.store.journal.append(entries)
        self.scores, self.stats, self.history = [], [], []
        self.lost_folders, self.predicted_folders, self.counts = [], {}, {}
        self.segmenter_model = self.discriminator_model = None
        self.n_points = n_points
        for e in entries:
            if e.kind == "points" and n_points is None:
                self.n_points = e.payload
            elif e.kind in ("scores", "stats", "history"):
                getattr(self, e.kind).append(tuple(e.payload))
            elif e.kind == "lost":
                self.lost_folders.append(e.payload)
            elif e.kind == "predictions":
                self.predicted_folders[e.cycle] = e.payload
            elif e.kind == "counts" and e.cycle == cycle:
                self.counts = dict(e.payload)
            elif e.kind in ("segmenter", "discriminator"):
                setattr(self, f"{e.kind}_model", learners.restore_model(e.payload))
        self._load()
        return self

    def _model(self, role: str):
        model = getattr(self, f"{role}_model")
        if model is None:
            raise ValueError(f"there is no {role} model: its class could not be stored; set {role}_model")
        return model

    def _remember_model(self, role: str, model) -> None:
        setattr(self, f"{role}_model", model)
        self.pending.append((role, learners.describe_model(model, f"{self.path}/models")))
        self._remember(model.history)

    def run_segmenter(self) -> None:
        """Fit on A_train with A_val, predict A_test, keep the predicted masks and score them."""
        self.counts = {}
        model = learners.make_segmenter(self.segmenter).fit(
            self._pixels("A_train"), self._pixels("A_val")
        )
        self._remember_model("segmenter", model)

        # One pass over the pixels: packed masks, and the sums that scores are made of.
        folder = f"{self.path}/predictions/{uuid.uuid4().hex}"
        masks.reduce_predictions(model.transform(self._pixels("A_test"))).write.parquet(folder)
        self.predicted_folders[self.cycle] = folder
        self.pending.append(("predictions", folder))
        sums = self._predicted(self.cycle).select("point_id", "n", "tp", "st", "sp", "bce")
        places = position_index(self.collection("A_test")).select("point_id", "idx")
        score = ev.evaluate_segmenter(
            sums.join(places, "point_id"), self.settings.eval_batch, self.loss, self.metric
        )
        self._score("classifier", score)

        self._derive(PREDICTED, self.sizes.get("A_test", 0), A_test_pred=self.collection("A_test"))

    def _predicted(self, cycle: int) -> DataFrame:
        return self.spark.read.schema(masks.PREDICTION_SCHEMA).parquet(self.predicted_folders[cycle])

    def predicted_masks(self, cycle: int | None = None) -> DataFrame:
        """(cycle, point_id, pos, h, w, mask, …sums) of A_test_pred of one or all cycles; ``mask`` is packed.

        ``functions.masks.unpack_mask`` gives its pixels.
        """
        cycles = sorted(self.predicted_folders) if cycle is None else [cycle]
        frames = [self._predicted(c).withColumn("cycle", F.lit(c)) for c in cycles]
        if not frames:
            return self.spark.createDataFrame([], f"{masks.PREDICTION_SCHEMA}, cycle int")
        return reduce(DataFrame.unionByName, frames)

    def build_c(self) -> None:
        """C: predicted masks (label 1) and expert masks (label 0), shuffled and sliced."""
        if self.step != BUILT_C:
            self._shuffle_c()
        s = self.settings
        sizes = splits.c_part_sizes(self.n_points, s.weights, s.c_ratios)
        shuffled, total = self.collection("C"), self.sizes["C"]
        start, parts = 0, {}
        for name, size in zip(("C_train", "C_val", "C_test"), sizes):
            inside = (F.col("ord") >= start) & (F.col("ord") < start + size)
            parts[name] = shuffled.filter(inside).withColumn("ord", F.col("ord") - start)
            self.sizes[name] = max(0, min(size, total - start))
            start += size
        self._derive(SPLIT_C, **parts)

    def _shuffle_c(self) -> None:
        s = self.settings
        n_machine, n_expert = self.sizes.get("A_test", 0), self.sizes.get("B", 0)
        unordered = cur.build_c(
            self.collection("A_test_pred"), self.collection("B"), n_machine, n_expert, s.strict
        )
        # Written once: the order is read by three slices and the judging below.
        shuffled = self._work("c", cur.shuffle_c(unordered, self.cycle, s.seed))
        self._derive(BUILT_C, n_machine + n_expert, C=shuffled)

    def _pairs(self, name: str) -> DataFrame:
        """(image, mask, label) of a part of C; the mask is the prediction on the machine side."""
        rows = self._attach(
            name, self.collection(name).select("point_id", F.col("value").alias("label"))
        )
        machine = F.col("label") == cur.MACHINE
        # The prediction is made from the untouched image, in the same pass.
        rows = self._model("segmenter").transform(rows).withColumnRenamed("mask", "_mask")
        if self.settings.machine_uint8:
            whole = a.to_uint8("image").cast(dict(rows.dtypes)["image"])
            rows = rows.withColumn("image", F.when(machine, whole).otherwise(F.col("image")))
        mask = F.when(machine, F.col("_mask")).otherwise(F.col("truth").cast("array<double>"))
        return rows.select("point_id", "h", "w", "image", mask.alias("mask"), "label")

    def run_discriminator(self, until: int = JUDGED) -> None:
        """Build C, train the discriminator the first time, judge every row of C_test.

        Goes on from the step reached, as far as ``until``.
        """
        begun = self.step if PREDICTED <= self.step < JUDGED else PREDICTED
        if begun < BUILT_C:
            self._shuffle_c()
            if until == BUILT_C:
                return
        if begun < SPLIT_C:
            self.build_c()
            if until == SPLIT_C:
                return
        if begun < TRAINED:
            if self.discriminator_model is None:
                choice = self.discriminator
                if isinstance(choice, str):
                    cut = getattr(self._model("segmenter"), "cut", 0.5)
                    choice = learners.make_discriminator(choice, cut=cut)
                model = choice.fit(self._pairs("C_train"), self._pairs("C_val"))
                self._remember_model("discriminator", model)
            self._derive(TRAINED)
            if until == TRAINED:
                return

        # Written once: the verdicts cost a pass over the pixels of C_test.
        judged = self._work("verdicts", self._model("discriminator").transform(self._pairs("C_test")))
        self._score("discriminator", ev.evaluate_classes(judged))
        verdicts = judged.select("point_id", F.col("verdict").alias("value"))
        placed = self.collection("C_test").select("point_id", "ord").join(verdicts, "point_id")
        self._derive(JUDGED, self.sizes["C_test"], C_test_pred=placed)

    def find_machine_labels(self) -> int:
        """D: rows of C_test judged machine. Returns their number; on 0 the former D stays."""
        verdicts = self.collection("C_test_pred").select("point_id", F.col("value").alias("verdict"))
        found = self._work("d", cur.machine_labels(self.collection("C_test"), verdicts))
        count = found.count()
        self.counts = {"found": count}
        if count:
            self.pending.append(("counts", self.counts))
            self._derive(FOUND, count, D=found)
        return count

    def relabel(self, until: int = UPDATED) -> dict[str, int]:
        """Sample D, find origins, move the sample to A_train, refill from Z, balance.

        Returns the counters of the cycle. Without a D nothing happens.
        """
        s = self.settings
        counts = dict(selected=0, lost=0, removed=0, filled=0, transferred=0)
        if not self.sizes.get("D"):
            return counts
        if self.step == RELABELED and "origins" in self.counts:
            # Stored with the sample; the places of the sample give the order of moves.
            sample = self.collection("D_relabeled")
            ranked = cur.with_origin(sample.select("point_id", "value", F.col("ord").alias("rank")), self.base)
        else:
            ranked = self._select_sample()
        origins, lost = self.counts["origins"], self.counts["lost"]
        n_moved = sum(origins.values())
        counts["lost"], counts["selected"] = lost, n_moved + lost
        if until == RELABELED:
            return counts

        moves = cur.relabel_moves(ranked)
        counts["removed"] = n_moved
        if s.fillup:
            moves = moves.unionByName(
                cur.refill_moves(ranked, self.base, n_moved, self.cycle, s.seed)
            )
            counts["filled"] = n_moved
        base = reg.move(self.base, moves, strict=False, may_collide=False)
        touched = [moves]

        if s.balance:
            after = {name: self.sizes.get(name, 0) for name in cur.BALANCED}
            after["A_train"] += n_moved
            if not s.fillup:
                for name in ("A_test", "B"):
                    after[name] -= origins.get(name, 0)
            plan = cur.balance_plan(after)
            counts["transferred"] = sum(count for _, _, count in plan)
            if plan:
                base = self._work("refilled", base)
                picks = cur.balance_moves(base, plan, self.cycle, s.seed)
                base = reg.move(base, picks, strict=False, may_collide=False)
                touched.append(picks)
        self._rebase(base, touched)
        return counts

    def _select_sample(self) -> DataFrame:
        """Sample D, find origins, note the lost ones, register D_relabeled: (point_id, value, rank, origin)."""
        s = self.settings
        selected = self._work(
            "selected",
            cur.select_for_relabel(
                self.collection("D"), self.base, s.percent_to_replace, self.cycle, s.seed
            ),
        )
        # One row per origin.
        origins = {
            r["origin"]: r["n"]
            for r in selected.groupBy("origin").agg(F.count("*").alias("n")).collect()
        }
        lost = origins.pop(None, 0)
        n_moved = sum(origins.values())
        if s.fillup and n_moved > self.sizes.get("Z", 0):
            raise ValueError(f"Z holds {self.sizes.get('Z', 0)} points, {n_moved} are needed")
        self.counts |= {"origins": origins, "lost": lost}
        if lost:
            rows = cur.lost_points(selected).select(
                F.lit(s.run).alias("run"), F.lit(self.cycle).alias("cycle"), "point_id"
            )
            folder = f"{self.path}/lost/{uuid.uuid4().hex}"
            rows.write.parquet(folder)
            self.lost_folders.append(folder)
            self.pending.append(("lost", folder))
            ranked = position_index(selected.filter(F.col("origin").isNotNull()), "idx", "rank")
        else:
            ranked = selected.withColumn("rank", F.col("idx"))
        self.pending.append(("counts", self.counts))
        self._derive(RELABELED, n_moved, D_relabeled=ranked.withColumn("ord", F.col("rank")))
        return ranked

    def relabeled_pixels(self) -> DataFrame:
        """D_relabeled with pixels: image, label, and the mask drawn by hand or the truth."""
        rows = self._attach(
            "D_relabeled",
            self.collection("D_relabeled").select("point_id", F.col("value").alias("label")),
        )
        mask = F.col("truth")
        if self.labels is not None:
            by_hand = self.labels.select("point_id", F.col("truth").alias("_by_hand"))
            rows = rows.join(by_hand, "point_id", "left")
            mask = F.coalesce(F.col("_by_hand"), mask)
        return rows.select("point_id", "h", "w", "image", mask.alias("mask"), "label")

    def run(self, runs: int = 1, until: int = UPDATED) -> "CurationLoop":
        """Set up and run up to ``runs`` cycles, the last one as far as the step ``until``."""
        self.setup_data()
        return self.proceed(runs, until)

    def proceed(self, runs: int, until: int = UPDATED) -> "CurationLoop":
        """Go on from the step reached, in the middle of a cycle or between two, to ``until`` of cycle ``runs``."""
        between = self.step in (SETUP, UPDATED)
        for cycle in range(self.cycle + between, runs + 1):
            started = time.time()
            last = until if cycle == runs else UPDATED
            if self.step in (SETUP, UPDATED):
                self.cycle = cycle
                self.run_segmenter()
            if self.step < min(last, JUDGED):
                self.run_discriminator(last)
            if self.step >= last:
                break
            found = self.counts["found"] if self.step >= FOUND else self.find_machine_labels()
            if found == 0 and self.settings.stop_on_empty:
                self._note(found, {}, started)
                break
            if self.step >= last:
                break
            counts = self.relabel(last)
            if last < UPDATED:
                break
            self.step = UPDATED
            self._note(found, counts, started)
        return self

    # --- results ----------------------------------------------------------------------------

    def _score(self, model: str, row: DataFrame) -> None:
        first = row.collect()[0]
        self.scores.append((self.settings.run, self.cycle, model, first["loss"], first["metric"]))
        self.pending.append(("scores", self.scores[-1]))

    def _remember(self, history: list[tuple]) -> None:
        rows = [(self.settings.run, self.cycle, *row) for row in history]
        self.history.extend(rows)
        self.pending.extend(("history", row) for row in rows)

    def _note(self, found: int, counts: dict[str, int], started: float) -> None:
        keys = ("selected", "lost", "removed", "filled", "transferred")
        row = (self.settings.run, self.cycle, found, *(counts.get(k, 0) for k in keys))
        self.stats.append((*row, time.time() - started))
        self.pending.append(("stats", self.stats[-1]))
        self.store.journal.append(self._entries(self.step))

    def scores_table(self) -> DataFrame:
        return self.spark.createDataFrame(self.scores, SCORES_SCHEMA)

    def stats_table(self) -> DataFrame:
        return self.spark.createDataFrame(self.stats, STATS_SCHEMA)

    def history_table(self) -> DataFrame:
        return self.spark.createDataFrame(self.history, HISTORY_SCHEMA)

    def lost_table(self) -> DataFrame:
        schema = "run string, cycle int, point_id string"
        if not self.lost_folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*self.lost_folders)

    def predictions(self, num_samples: int = 100) -> DataFrame:
        """Image, truth and predicted mask of the first points by position."""
        first = self.points.filter(F.col("pos") < num_samples)
        return self._model("segmenter").transform(first).select(
            "point_id", "pos", "h", "w", "image", "truth", "mask"
        )
