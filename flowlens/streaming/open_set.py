"""The open-set loop over a stream of blocks: score, route, buffer what nobody accepts, form new learners from it, and let learners grow.

A block is scored with the learners known at its start; a learner born in a block sees rows from the next block on. Everything the loop
keeps is a table under the batch's number (`<name>/batch=N`): the registry of learners, the buffer, history pools, rows of small
learners, and what each block adds to counters. A batch that is run again after a failure reads the state of the batch before it and
overwrites its own, so nothing is counted twice; totals are sums over batches.

In a block: score all rows, count acceptances and pairs, assign, buffer the unknown, cluster the buffer once it has `trigger` rows, judge
and number the clusters, put small learners' rows back and cluster again, count labels, train learners further on their new rows, log.

The driver holds a row for each learner. What is held on purpose in one place is bounded by options: a model's sample (`most_rows`), a
learner's pool (`pool_rows`), new rows of an increment (`most_new`), rows of a learner that is still small (`small_rows`).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import in_place
from flowlens.operators import increments as I
from flowlens.operators import lifecycle as L
from flowlens.operators.clusters import new_classes
from flowlens.operators.models import fit_learners, score_learners, with_own_loss
from flowlens.operators.overlap import accepted, pair_counts, route, route_confidence
from flowlens.operators.purity import PurityGate, judge_clusters
from flowlens.operators.quantiles import exact_quantiles
from flowlens.session import discard, keep

from .small_blocks import LOG, REGISTRY, SmallBlock

UNKNOWN = "UNKNOWN"


@dataclass
class OpenSet:
    """rows of the stream: row_index, label and features. trigger: None never clusters the buffer. most_buffer: 0 holds all unknown rows, else the newest so many, the labels of
    the others being counted. gate: None trains learners once only. purity: None lets every cluster pass. small_rows: 0 never puts
    learners back."""

    spark: SparkSession
    root: str
    features: list[str]
    backend: str = "iforest"
    trigger: int | None = 200
    most_buffer: int = 0
    most_rows: int = 5000
    least_fit: int = 2
    eps: float = 1.0
    least: int = 5
    least_class: int = 50
    benign_scale: float = 1.0
    quantile: float = 0.95
    risk: float = 1e-3
    purity: PurityGate | None = None
    reinject: bool = True
    small_rows: int = 0
    small_trigger: int = 10
    gate: L.Gate | None = None
    guard: I.Guard | None = None
    most_new: int = 2000
    low_share: float = 1.0
    stratified: bool = True
    pool_rows: int = 10_000
    history_rate: float = 0.5
    history_rows: int = 2000
    decay: float = 0.0
    epochs: int = 5
    anchor_share: float | None = None
    drift_rows: int = 500
    #: Gives row_index, learner, loss, threshold, is_benign of a block, instead of the registry's models.
    scorer: Callable[[DataFrame], DataFrame] | None = None
    #: With a scorer and without a trigger nothing changes from block to block. Then a micro-batch may hold many blocks of so many rows by
    #: row_index; the log still has a line for each. 0: a micro-batch is a block.
    block: int = 0
    #: A block is worked on in the driver while it, the buffer, the pools and the small learners have so many rows together; 0: never.
    driver_rows: int = 250_000
    _held: dict | None = None

    def __post_init__(self):
        if self.block and (self.scorer is None or self.trigger is not None or self.gate or self.small_rows or self.most_buffer):
            raise ValueError("blocks go together only with a scorer, and without trigger, gate, small_rows and most_buffer")

    # tables of the loop

    def _path(self, name: str, number: int) -> str:
        return f"{self.root}/{name}/batch={number}"

    def _put(self, df: DataFrame, name: str, number: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(name, number))
        return self.spark.read.schema(df.schema).parquet(self._path(name, number))

    def _state(self, name: str, number: int, schema) -> DataFrame:
        """The table as batch `number` left it; before the first batch it is empty."""
        return self.spark.read.schema(schema).parquet(self._path(name, number)) if number >= 0 else self.spark.createDataFrame([], schema)

    def _deltas(self, name: str, schema: str, upto: int | None = None) -> DataFrame:
        """What all batches (up to one) added."""
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not fs.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(fs):
            return self.spark.createDataFrame([], schema + ", batch int")
        df = self.spark.read.schema(schema + ", batch int").parquet(f"{self.root}/{name}")
        return df if upto is None else df.where(F.col("batch") <= upto)

    def _learners(self, number: int) -> list:
        return self.spark.read.schema(REGISTRY).parquet(self._path("learners", number)).collect()  # a row for each learner

    def _registry(self, fitted: DataFrame, birth: int, last: int) -> DataFrame:
        out = fitted.withColumns({"birth": F.lit(birth).cast("long"), "last_trained": F.lit(last).cast("long"), "retrains": F.lit(0)})
        if "guard" not in out.columns:
            out = out.withColumns({"seed_count": F.lit(None).cast("long"), "cutoff": F.lit(None).cast("double"), "guard": F.lit(None).cast("binary")})
        return out.select(*[f.split()[0] for f in REGISTRY.split(", ")])

    def _with_guards(self, registry: DataFrame, rows: DataFrame) -> DataFrame:
        """registry with a guard for each of its learners that has enough rows."""
        if self.guard is None:
            return registry
        made = I.fit_guards(rows, self.features, self.guard)
        return registry.drop("seed_count", "cutoff", "guard").join(F.broadcast(made), "learner", "left")  # a row for each learner

    # the loop

    def start(self, known: DataFrame, group: str) -> None:
        """Learners of the known groups (row_index, group, features); names with BENIGN are benign."""
        rows = keep(known.select("row_index", F.col(group).alias("learner"), *(["label"] if "label" in known.columns and group != "label" else []),
            *self.features), "known")
        n, last = rows.agg(F.count(F.lit(1)), F.max("row_index")).first()
        last = last or 0
        if n <= self.driver_rows:  # each learner in one task
            fitted = in_place.fit_learners(rows, self.features, self.backend, self.most_rows, self.quantile, self.risk, self.guard)
            self._put(self._registry(fitted, 0, last), "learners", -1)
        else:
            fitted = fit_learners(rows, "learner", "row_index", self.features, self.backend, self.most_rows, self.quantile, self.risk)
            self._put(self._with_guards(self._registry(fitted, 0, last), rows), "learners", -1)
        pool = rows.select("learner", "row_index", *self.features)
        if self.gate is not None:
            self._put(self._capped_pool(pool, self._learners(-1)), "pools", -1)

    def batch(self, rows: DataFrame, number: int) -> None:
        small = SmallBlock(self, rows, number)
        if small.load():
            return small.run()
        self._held = None
        began = time.perf_counter()
        known = self._learners(number - 1) if number or not self.scorer else []
        # a block is one file, but its rows are scored side by side
        rows = keep(rows.select("row_index", "label", *self.features).repartition(self.spark.sparkContext.defaultParallelism), "block")
        span = rows.agg(F.min("row_index"), F.max("row_index"), F.count(F.lit(1))).first()
        if not span[2]:
            span = (0, -1, 0)
        is_benign = F.contains(F.upper("learner"), F.lit("BENIGN"))
        scored = self.scorer(rows) if self.scorer else score_learners(rows, "row_index", self.features, known).withColumn("is_benign", is_benign)
        losses = keep(scored.select("row_index", "learner", "loss", "threshold", "is_benign"), "losses")
        taken = keep(accepted(losses, self.benign_scale).select("row_index", "learner"), "accepted")
        self._put(taken.groupBy("learner").agg(F.count(F.lit(1)).alias("n")), "accepts", number)
        self._put(pair_counts(taken), "pairs", number)
        routed = route(losses, self.benign_scale).select("row_index", F.col("assigned_learner").alias("learner"))
        mine = keep(rows.join(routed, "row_index", "left").withColumn("learner", F.coalesce("learner", F.lit(UNKNOWN))), "assigned")
        self._put(mine.select("row_index", "learner", F.lit("stream").alias("phase")), "assignments", number)
        detected = time.perf_counter()

        shape = rows.schema
        unknown = mine.where(F.col("learner") == UNKNOWN).select(*rows.columns)
        buffer = self._fifo(self._state("buffer", number - 1, shape).unionByName(unknown), number)
        log = dict.fromkeys(("checked", "passed", "rejected", "reinjected", "dropped", "destroyed", "retrained"), 0)
        last = self.spark.read.schema(LOG).parquet(self._path("log", number - 1)).agg(F.max("next_id").alias("next_id")).first() if number > 0 else None
        next_id = last["next_id"] if last else 1
        table = self.spark.createDataFrame(known, REGISTRY)
        labels = mine.where(F.col("learner") != UNKNOWN).groupBy("learner", "label").agg(F.count(F.lit(1)).alias("n"))
        buffer, made, born, next_id, clustered, created = self._cluster(buffer, known, next_id, number, span[1], log)
        created_rows = [made] if made is not None else []
        gone: list[str] = []
        if self.small_rows:
            held = self._small(number, mine, created_rows)
            gone = self._too_small(number, [r["learner"] for r in known] +
                ([r["learner"] for r in born.select("learner").collect()] if born is not None else []), labels, created_rows)
            log["destroyed"] = len(gone)
            if gone:
                back = held.where(F.col("learner").isin(gone)).select(*rows.columns)
                buffer = self._fifo(buffer.unionByName(back), number, more=True)
                table = table.where(~F.col("learner").isin(gone))
                born = born.where(~F.col("learner").isin(gone)) if born is not None else None
                buffer, again, second, next_id, more_c, more_n = self._cluster(buffer, [r for r in known if r["learner"] not in gone], next_id,
                    number, span[1], log)
                clustered, created = clustered + more_c, created + more_n
                if again is not None:
                    created_rows.append(again)
                    held = held.where(~F.col("learner").isin(gone)).unionByName(again.select(*held.columns))
                    born = second if born is None else born.unionByName(second)
                else:
                    held = held.where(~F.col("learner").isin(gone))
            self._put(held, "small", number)
            self._put(self.spark.createDataFrame([(x,) for x in gone], "learner string"), "destroyed", number)
        creations = created_rows[0].withColumn("_turn", F.lit(0)) if created_rows else None
        if len(created_rows) > 1:
            creations = creations.unionByName(created_rows[1].withColumn("_turn", F.lit(1)))
        if creations is not None:
            labels = labels.unionByName(creations.groupBy("learner", "label").agg(F.count(F.lit(1)).alias("n")))
            self._put(creations.select("row_index", "learner", F.lit("creation").alias("phase"), "_turn"), "creations", number)
        self._put(labels, "labels", number)
        table = table if born is None else table.unionByName(born)
        trained = time.perf_counter()
        if self.gate is not None:
            table = self._increment(number, mine.where(F.col("learner") != UNKNOWN), losses, [r for r in known if r["learner"] not in gone], table,
                creations, span, log)
        learners = self._put(table, "learners", number).count()
        buffered = self._put(buffer, "buffer", number).count()
        now = time.perf_counter()
        parts, lines = self._parts(mine, span), []
        seconds = [x / len(parts) for x in (detected - began, clustered, created, now - trained, now - began)]
        for first, after, n, unknown_after in parts:  # a line for each block
            lines.append((first, after, n, learners, buffered - unknown_after, next_id, *log.values(), *seconds))
        self._put(self.spark.createDataFrame(lines, LOG).coalesce(1), "log", number)
        discard(rows, losses, taken, mine)

    def _parts(self, mine: DataFrame, span) -> list[tuple]:
        """First row, row after the last, rows of each block of a micro-batch, and the unknown rows of its later blocks."""
        if not self.block or not span[2]:
            return [(span[0], span[1] + 1, span[2], 0)]
        unknown = (F.col("learner") == UNKNOWN).cast("long")
        found = mine.groupBy(F.floor(F.col("row_index") / self.block).alias("_b")).agg(F.min("row_index"), F.max("row_index") + 1, F.count(F.lit(1)),
            F.sum(unknown)).collect()
        out, later = [], 0
        for _, first, after, n, u in sorted(found, reverse=True):
            out.append((first, after, n, later))
            later += u
        return out[::-1]

    def _fifo(self, buffer: DataFrame, number: int, more: bool = False) -> DataFrame:
        """The newest most_buffer rows; the labels of those that fall out are counted."""
        if not self.most_buffer:
            return buffer
        buffer = keep(buffer, "buffer")
        n = buffer.count()
        if n <= self.most_buffer:
            return buffer
        first = exact_quantiles(buffer, [], "row_index", [(n - self.most_buffer) / max(1, n - 1)]).first()["q"][0]
        out = F.col("row_index") >= round(first)
        self._put(buffer.where(~out).groupBy("label").agg(F.count(F.lit(1)).alias("n")), f"overflow{int(more)}", number)
        return buffer.where(out)

    def _cluster(self, buffer: DataFrame, known: list, next_id: int, number: int, last: int, log: dict):
        """The buffer without the rows of new classes, those rows with their learner, the new learners, the next number, and seconds."""
        began = time.perf_counter()
        if self.trigger is None:
            return buffer, None, None, next_id, 0.0, 0.0
        buffer = keep(buffer, "buffer")
        if buffer.count() < self.trigger:
            return buffer, None, None, next_id, time.perf_counter() - began, 0.0
        found = keep(buffer.join(new_classes(buffer, "row_index", self.features, self.eps, self.least, self.least_class), "row_index"), "found")
        judged = {r["cluster"]: True for r in found.select("cluster").distinct().collect()}  # a row for each class
        if self.purity is not None and judged:
            scored = score_learners(found, "row_index", self.features, known).withColumn("is_benign", F.contains(F.upper("learner"), F.lit("BENIGN")))
            verdicts = judge_clusters(found.select("row_index", "cluster", *self.features), scored, self.features, self.purity, self.benign_scale)
            self._put(verdicts, "verdicts", number)
            rows = verdicts.collect()
            judged = {r["cluster"]: r["passed"] for r in rows}
            lost = sum(r["n"] for r in rows if not r["passed"])
            log["checked"] += len(rows)
            log["passed"] += sum(judged.values())
            log["rejected"] += len(rows) - sum(judged.values())
            log["reinjected" if self.reinject else "dropped"] += lost
            if not self.reinject and lost:
                out = found.where(F.col("cluster").isin([c for c, ok in judged.items() if not ok]))
                self._put(out.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "rejected", number)
                buffer = buffer.join(out.select("row_index"), "row_index", "left_anti")
        numbers = {c: next_id + k for k, c in enumerate(sorted(c for c, ok in judged.items() if ok))}
        clustered = time.perf_counter()
        if not numbers:
            return buffer, None, None, next_id, clustered - began, 0.0
        names = F.create_map(*[x for c, k in numbers.items() for x in (F.lit(c).cast("long"), F.lit(f"NEW_{k}"))])
        made = keep(found.where(F.col("cluster").isin(list(numbers))).withColumn("learner", F.element_at(names, F.col("cluster"))).drop("cluster"), "created")
        size = made.groupBy("learner").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= self.least_fit).select("learner")
        fitted = fit_learners(made.join(F.broadcast(size), "learner", "left_semi"), "learner", "row_index", self.features, self.backend,
            self.most_rows, self.quantile, self.risk)
        born = keep(self._with_guards(self._registry(fitted, number, last), made), "born")
        # numbers go on when a class is too small for a learner; its rows are used up all the same
        rest = keep(buffer.join(made.select("row_index"), "row_index", "left_anti"), "buffer")
        return rest, made, born, next_id + len(numbers), clustered - began, time.perf_counter() - clustered

    # learners that stay small

    def _small(self, number: int, mine: DataFrame, created: list[DataFrame]) -> DataFrame:
        """Rows of new learners that have had up to small_rows rows so far."""
        columns = ["learner", *[c for c in mine.columns if c != "learner"]]
        new = mine.where(F.startswith("learner", F.lit("NEW_"))).select(*columns)
        for x in created:
            new = new.unionByName(x.select(*columns))
        rows = self._state("small", number - 1, new.schema).unionByName(new)
        large = self._deltas("labels", "learner string, label string, n long",
            number - 1).groupBy("learner").agg(F.sum("n").alias("_n")).where(F.col("_n") >= self.small_rows)
        rows = keep(rows.join(F.broadcast(large), "learner", "left_anti"), "small")  # a row for each learner
        n = rows.groupBy("learner").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < self.small_rows).select("learner")
        return rows.join(F.broadcast(n), "learner", "left_semi")

    def _too_small(self, number: int, names: list[str], labels: DataFrame, created: list[DataFrame]) -> list[str]:
        before = self._deltas("labels", "learner string, label string, n long", number - 1).select("learner", "n").unionByName(labels.select("learner", "n"))
        for x in created:
            before = before.unionByName(x.groupBy("learner").agg(F.count(F.lit(1)).alias("n")))
        new = [x for x in names if x.startswith("NEW_")]
        n = before.where(F.col("learner").isin(new)).groupBy("learner").agg(F.sum("n").alias("n")).where((F.col("n") > 0) & (F.col("n") < self.small_rows))
        found = sorted(r["learner"] for r in n.collect())  # a row for each learner
        return found if len(found) > self.small_trigger else []

    # increments

    def _capped_pool(self, rows: DataFrame, known: list) -> DataFrame:
        """The pool of each learner: all its rows, or pool_rows of them at even places of its loss."""
        scored = with_own_loss(rows, self.features, known)
        return I.spread_by_loss(scored, self.pool_rows).select("learner", "row_index", *self.features)

    def _increment(self, number: int, mine: DataFrame, losses: DataFrame, known: list, table: DataFrame, creations: DataFrame | None, span,
        log: dict) -> DataFrame:
        """The registry after learners have been trained on rows of this block; writes the trace, the losses and the pools."""
        gate, spark = self.gate, self.spark
        names = sorted(r["learner"] for r in known)
        anchor = next((x for x in names if _benign(x)), None)
        scaled = losses.withColumn("threshold", F.col("threshold") * F.when(F.col("is_benign"), self.benign_scale).otherwise(1.0))
        margin = (F.col("threshold") - F.col("loss")) / (F.abs("threshold") + 1e-12)
        own, first = F.col("learner") == F.col("_to"), F.col("learner") == F.lit(anchor)
        pick = lambda test, c: F.max(F.when(test, F.col(c)))
        to = mine.where(F.col("learner").isin(names)).select("row_index", F.col("learner").alias("_to"))
        stats = to.join(scaled, "row_index").groupBy("row_index", F.col("_to").alias("learner")).agg(
            pick(own, "loss").alias("loss"), pick(own, "threshold").alias("threshold"), pick(own, "is_benign").alias("is_benign"), pick(first,
                "loss").alias("benign_loss"), pick(first, "threshold").alias("benign_threshold"),
            F.max(F.when(F.col("is_benign"), 1 / (1 + F.exp(-4 * margin)))).alias("benign_prob"),
        )
        sure = F.lit(True) if gate.benign_confidence is None else F.coalesce(~F.col("is_benign") | (F.col("benign_loss") <= F.col("benign_threshold") * gate.benign_confidence), F.lit(True))
        rows = stats.join(mine.drop("learner"), "row_index").withColumn("passed", sure)
        if gate.route_rows is not None:
            rows = rows.join(route_confidence(losses, to.withColumnRenamed("_to", "assigned_learner"), self.benign_scale).select("row_index",
                F.col("keep").alias("route_keep"), F.col("gap").isNotNull().alias("route_valid")), "row_index", "left")
        rows = keep(rows, "own-rows")
        pools = self._state("pools", number - 1, rows.select("learner", "row_index", *self.features).schema)
        ok = F.col("passed")
        aggs = [
            F.max("is_benign").alias("is_benign"), F.sum(ok.cast("long")).alias("kept"), F.max("row_index").alias("latest"), F.avg(F.when(ok,
                (F.col("loss") > F.col("threshold")).cast("double"))).alias("exceed"),
            F.avg(F.when(ok, F.col("benign_prob"))).alias("benign_prob"),
        ]
        if gate.route_rows is not None:
            sound = ok & F.coalesce(F.col("route_valid"), F.lit(False))
            aggs += [F.avg(F.when(sound, F.col("route_keep").cast("double"))).alias("confident_ratio"), F.sum((ok & F.coalesce("route_keep",
                F.lit(True))).cast("long")).alias("route_kept")]
        state = spark.createDataFrame([(r["learner"], r["birth"], r["last_trained"], r["retrains"]) for r in known], "learner string, birth_window "
            "long, last_trained long, retrains int")
        batches = rows.groupBy("learner").agg(*aggs).join(F.broadcast(state), "learner").withColumn("window_id", F.lit(number).cast("long"))
        if gate.least_drift is not None:
            batches = batches.join(F.broadcast(L.drift_scores(pools, rows.where("passed"), self.features, self.drift_rows)), "learner", "left")
        reason = L.batch_reason(gate)
        if gate.most_retrains:
            early = F.coalesce(reason.isin(*L.BEFORE_CAP), F.lit(False))
            reason = F.when(early, reason).when(F.col("retrains") >= gate.most_retrains, "max_retrain_per_learner").otherwise(reason)
        batches = keep(batches.withColumn("reason", reason), "batches")
        open_ = batches.where("reason is null").select("learner", F.col("is_benign").alias("_b"), "kept")
        ready = rows.where("passed").join(F.broadcast(open_), "learner")  # a row for each learner
        if gate.route_rows is not None:
            asked = F.startswith("learner", F.lit("NEW_")) & (F.col("kept") >= gate.route_rows)
            ready = ready.withColumn("route_out", asked & ~F.coalesce("route_keep", F.lit(True)))
        else:
            ready = ready.withColumn("route_out", F.lit(False))
        ready = ready.withColumn("guard_out", F.lit(False))
        if self.guard is not None:
            ready = self._guarded(ready, pools, known)
        left = ready.where("not route_out and not guard_out").groupBy("learner").agg(F.count(F.lit(1)).alias("_left"))
        ready = keep(ready.join(F.broadcast(left), "learner", "left"), "ready")
        enough = F.coalesce("_left", F.lit(0)) >= (gate.least_rows if self.guard is not None else 1)
        able = ready.where(enough & ~F.col("route_out") & ~F.col("guard_out")).select("learner", "row_index", "loss", *self.features)
        chosen = keep(I.subsample(able, self.most_new, self.low_share, self.stratified), "chosen")
        old = I.history_sample(with_own_loss(pools.join(chosen.select("learner").distinct(), "learner", "left_semi"), self.features, known),
            self.history_rate, self.history_rows, self.decay) if self.history_rows else pools.where("false")
        update = chosen.select("learner", "row_index", *self.features, F.lit(True).alias("is_new")).unionByName(old.select("learner", "row_index",
            *self.features, F.lit(False).alias("is_new")))
        grown = I.grow(update, self.features, known, self.epochs, self.quantile, self.risk, self.anchor_share)
        self._put(grown.drop("params").withColumn("window_id", F.lit(number).cast("long")), "increments", number)
        log["retrained"] = grown.count()

        # why each accepted row does or doesn't train
        marks = ready.select("row_index", "route_out", "guard_out", (~enough).alias("few")).join(chosen.select("row_index",
            F.lit(True).alias("used")), "row_index", "left")
        why = F.when(F.col("reason").isNotNull(), F.col("reason")).when(~F.col("passed"), "benign_conf_filter")
        why = why.when(F.col("few"), I.GUARD_LEFT_FEW).when(F.col("guard_out"), I.GUARD_FILTERED).when(F.col("route_out"),
            I.ROUTE_FILTERED).when(F.col("used").isNull(), I.SUBSAMPLED).otherwise("")
        trace = rows.join(F.broadcast(batches.select("learner", "reason")), "learner").join(marks, "row_index", "left")
        used = F.coalesce("used", F.lit(False))
        self._put(trace.select("learner", "row_index", "label", F.lit(span[0]).alias("window_left"), F.lit(span[1] + 1).alias("window_right"),
            "passed", used.alias("used"), why.alias("reason")), "trace", number)

        # pools take what passed, with the losses of the models of this block's start
        pool = pools.unionByName(rows.where("passed").select("learner", "row_index", *self.features)).where(F.col("learner").isin(names))
        pool = self._capped_pool(pool, known)
        if creations is not None:
            pool = pool.unionByName(creations.select("learner", "row_index", *self.features))
        self._put(pool, "pools", number)
        latest = batches.select("learner", "latest")
        new = grown.select("learner", F.col("threshold").alias("_t"), F.col("params").alias("_p")).join(latest, "learner")
        out = table.join(F.broadcast(new), "learner", "left")  # a row for each learner
        out = out.withColumns({"threshold": F.coalesce("_t", "threshold"), "params": F.coalesce("_p", "params"),
            "last_trained": F.when(F.col("_t").isNotNull(), F.col("latest")).otherwise(F.col("last_trained")), "retrains": F.col("retrains") +
                F.col("_t").isNotNull().cast("int")})
        out = out.drop("_t", "_p", "latest")
        if self.guard is not None and self._new_guards is not None:
            made = self._new_guards.select("learner", F.col("seed_count").alias("_s"), F.col("cutoff").alias("_c"), F.col("guard").alias("_g"))
            out = out.join(F.broadcast(made), "learner", "left").withColumns({"seed_count": F.coalesce("seed_count", "_s"),
                "cutoff": F.coalesce("cutoff", "_c"), "guard": F.coalesce("guard", "_g")}).drop("_s", "_c", "_g")
        out = keep(out.select(*[f.split()[0] for f in REGISTRY.split(", ")]), "registry")
        discard(rows, batches, ready, chosen)
        return out

    _new_guards: DataFrame | None = None

    def _guarded(self, ready: DataFrame, pools: DataFrame, known: list) -> DataFrame:
        """ready with guard_out. A learner without a guard gets one from its pool."""
        asked = F.lit(True) if not self.guard.new_only else F.startswith("learner", F.lit("NEW_"))
        able = ready.where(asked & ~F.col("route_out"))
        large = able.groupBy("learner").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= self.guard.rows).select("learner")
        able = able.join(F.broadcast(large), "learner", "left_semi")  # a row for each learner
        have = {r["learner"]: r for r in known if r["guard"] is not None}
        lack = large.where(~F.col("learner").isin(list(have))) if have else large
        self._new_guards = keep(I.fit_guards(pools.join(F.broadcast(lack), "learner", "left_semi"), self.features, self.guard), "guards")
        judged = I.guarded(able, self.features, [*have.values(), *self._new_guards.collect()])
        return ready.drop("guard_out").join(judged.select("row_index", (~F.col("guard_keep")).alias("guard_out")), "row_index",
            "left").withColumn("guard_out", F.coalesce("guard_out", F.lit(False)))

    # what a run leaves

    def run(self, stream: DataFrame) -> DataFrame:
        """owners() after all rows that the stream has now."""
        query = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.owners()

    def _last(self) -> int:
        return self._deltas("log", LOG).agg(F.max("batch")).first()[0]

    def _gone(self) -> DataFrame:
        return self._deltas("destroyed", "learner string").select("learner").distinct()

    def owners(self) -> DataFrame:
        """row_index, assigned_learner, phase of every row: the learner that it was made from last, if that one still stands, else the one
        that it was assigned to, if that one still stands, else UNKNOWN."""
        gone = F.broadcast(self._gone().withColumn("_gone", F.lit(True)))  # a row for each learner that was put back
        made = self._deltas("creations", "row_index long, learner string, phase string, _turn int").join(gone, "learner", "left").where("_gone is null")
        made = made.groupBy("row_index").agg(F.max_by("learner", F.struct("batch", "_turn")).alias("_made"))
        flow = self._deltas("assignments", "row_index long, learner string, phase string").join(gone, "learner", "left")
        flow = flow.select("row_index", F.when(F.col("_gone").isNull(), F.col("learner")).otherwise(UNKNOWN).alias("learner"))
        out = flow.join(made, "row_index", "left")
        return out.select("row_index", F.coalesce("_made", "learner").alias("assigned_learner"), F.when(F.col("_made").isNotNull(),
            "creation").otherwise("stream").alias("phase"))

    def accept_counts(self) -> DataFrame:
        """learner, n: how many rows each learner took, assigned to it or not."""
        return self._deltas("accepts", "learner string, n long").join(F.broadcast(self._gone()), "learner",
            "left_anti").groupBy("learner").agg(F.sum("n").alias("n"))

    def pair_counts(self) -> DataFrame:
        """learner_a < learner_b, both: how many rows both took."""
        gone = self._gone()
        found = self._deltas("pairs", "learner_a string, learner_b string, both long")
        for c in ("learner_a", "learner_b"):
            found = found.join(F.broadcast(gone.withColumnRenamed("learner", c)), c, "left_anti")
        return found.groupBy("learner_a", "learner_b").agg(F.sum("both").alias("both"))

    def label_counts(self) -> DataFrame:
        """learner, label, n of all rows so far; UNKNOWN has what is buffered, fell out of the buffer or was dropped."""
        known = self._deltas("labels", "learner string, label string, n long").join(F.broadcast(self._gone()), "learner",
            "left_anti").select("learner", "label", "n")
        waiting = self.spark.read.parquet(self._path("buffer", self._last())).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        for name in ("overflow0", "overflow1", "rejected"):
            waiting = waiting.unionByName(self._deltas(name, "label string, n long").select("label", "n"))
        return known.unionByName(waiting.select(F.lit(UNKNOWN).alias("learner"), "label", "n")).groupBy("learner", "label").agg(F.sum("n").alias("n"))

    def trace(self) -> DataFrame:
        return self._deltas("trace", "learner string, row_index long, label string, window_left long, window_right long, passed boolean, used "
            "boolean, reason string").drop("batch")

    def pools(self) -> DataFrame:
        return self.spark.read.parquet(self._path("pools", self._last()))

    def learners(self) -> DataFrame:
        return self.spark.read.schema(REGISTRY).parquet(self._path("learners", self._last()))

    def increment_losses(self) -> DataFrame:
        return self._deltas("increments", "learner string, threshold double, rows long, " + ", ".join(f"{s}_loss_{w} double" for s in ("before",
            "after") for w in ("mean", "median", "p95")) + ", window_id long").drop("batch")

    def window_log(self) -> DataFrame:
        """A row for each block, with counts and seconds by stage."""
        return self._deltas("log", LOG).withColumnRenamed("batch", "window_id")


def _benign(name: str) -> bool:
    return "BENIGN" in name.upper()

