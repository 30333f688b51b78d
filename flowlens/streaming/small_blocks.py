"""A block of the open-set loop in the driver, for blocks and a state of few rows.

A small block that trains learners takes 88 jobs as tables (8 here, in the tests' example), and jobs more time than rows. Here rows are
scored on the executors, in one job, which gives back each row's losses; what follows is done on arrays. Learners are made and trained
on executors, side by side. The tables that a block leaves are those of OpenSet.batch(), as files that the driver writes, so that a
batch may be run again, and blocks of either way may follow each other. The state of the last block stays in memory, and is read
from its tables where there is none.

`driver_rows` bounds what is held: the rows of the block, the buffer, the pools and the small learners, and 40 numbers a row for losses.
"""

from __future__ import annotations

import os
import pickle
import tempfile
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructType

from flowlens.operators import in_place as P
from flowlens.operators import increments as I
from flowlens.operators.models import matrix, score_learners
from flowlens.operators.purity import judge_clusters

_LABELS, _NUMBERS = "learner string, label string, n long", 40
_UNKNOWN = "UNKNOWN"
REGISTRY = "learner string, n long, threshold double, params binary, birth long, last_trained long, retrains int, seed_count long, cutoff double, guard binary"
LOG = "window_left long, window_right long, rows long, learners long, buffered long, next_id long, checked long, passed long, rejected long, reinjected long, dropped long, destroyed long, retrained long, " + ", ".join(
    f"{s}_seconds double" for s in ("detect", "cluster", "create", "retrain", "window")
)


def _is_benign(name: str) -> bool:
    return "BENIGN" in name.upper()


def able(loop) -> bool:
    """Whether the loop's options have a form in place."""
    gate = loop.gate
    return bool(loop.driver_rows) and loop.scorer is None and not loop.decay and (gate is None or (gate.least_drift is None and gate.route_rows is None))


class SmallBlock:
    """One block of `loop`, an OpenSet. load() says whether it is small enough; run() does it."""

    def __init__(self, loop, rows: DataFrame, number: int):
        self.loop, self.number, self.spark = loop, number, loop.spark
        self.rows = rows.select("row_index", "label", *loop.features)
        self.schema = self.rows.schema
        self.began = time.perf_counter()

    # tables

    def _put(self, df: pd.DataFrame, name: str, schema) -> None:
        """df as the one file of a table of this batch; what was there before goes."""
        spark, path = self.spark, self.loop._path(name, self.number)
        shape = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        names = shape.fieldNames()
        table = pa.Table.from_pandas(df[names] if len(df.columns) else pd.DataFrame(columns=names), schema=to_arrow_schema(shape), preserve_index=False)
        handle, local = tempfile.mkstemp(suffix=".parquet")
        os.close(handle)
        try:
            pq.write_table(table, local)
            of = spark._jvm.org.apache.hadoop.fs.Path
            fs = of(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
            fs.delete(of(path), True)
            fs.mkdirs(of(path))
            fs.copyFromLocalFile(False, True, of(f"file://{local}"), of(f"{path}/part-00000.parquet"))
        finally:
            os.unlink(local)

    def _spread(self, df: pd.DataFrame, schema) -> DataFrame:
        """df as a DataFrame."""
        shape = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        return self.spark.createDataFrame(pa.Table.from_pandas(df[shape.fieldNames()], schema=to_arrow_schema(shape), preserve_index=False), shape)

    def _by_learner(self, df: pd.DataFrame, shape: StructType) -> DataFrame:
        """_spread() with the rows of a learner in one task, and few other learners there: adaptive execution would put all into one."""
        return self._spread(df, shape).repartition(2 * self.spark.sparkContext.defaultParallelism, "learner")

    def _of_learner(self) -> StructType:
        return self._shape(["learner", "row_index", *self.loop.features])

    def _shape(self, names: list[str]) -> StructType:
        out = StructType()
        for c in names:
            out = out.add("learner", "string") if c == "learner" else out.add(self.schema[c])
        return out

    # what there is before the block

    def load(self) -> bool:
        loop, last = self.loop, self.number - 1
        if not able(loop) or self.schema["row_index"].dataType.typeName() != "long":
            return False
        if any(self.schema[c].dataType.typeName() not in ("double", "float", "long", "integer", "short") for c in loop.features):
            return False
        n = self.rows.count()
        held = loop._held if loop._held is not None and loop._held["number"] == last else None
        if held is None:
            small = ["row_index", "label", *loop.features]
            wanted = {"buffer": self.schema}
            if loop.small_rows:
                wanted["small"] = self._shape(["learner", *small])
            if loop.gate is not None:
                wanted["pools"] = self._shape(["learner", "row_index", *loop.features])
            if n + sum(loop._state(name, last, shape).count() for name, shape in wanted.items() if last >= 0) > loop.driver_rows:
                return False
            held = {"number": last, "learners": [r.asDict() for r in loop._learners(last)], "next_id": 1, "totals": {}, "pool_loss": {}}
            for name, shape in wanted.items():
                held[name] = loop._state(name, last, shape).toArrow().to_pandas()
            if last >= 0:
                held["next_id"] = loop.spark.read.parquet(loop._path("log", last)).agg(F.max("next_id")).first()[0]
                done = loop._deltas("labels", _LABELS, last).groupBy("learner").agg(F.sum("n").alias("n")).collect()  # a row for each learner
                held["totals"] = {r["learner"]: r["n"] for r in done}
        self.held = held
        rows = n + sum(len(held[name]) for name in ("buffer", "small", "pools") if name in held)
        return rows <= loop.driver_rows and n * len(held["learners"]) <= loop.driver_rows * _NUMBERS

    # the block

    def run(self) -> None:
        loop, held, number = self.loop, self.held, self.number
        loop._held = None
        self.known = sorted(held["learners"], key=lambda r: r["learner"])
        names = np.array([r["learner"] for r in self.known], object)
        rows, self.losses = self._scored()
        span = (int(rows["row_index"].min()), int(rows["row_index"].max()), len(rows)) if len(rows) else (0, -1, 0)
        self.span = span
        self.benign = np.array([_is_benign(x) for x in names], bool)
        self.limits = np.array([r["threshold"] for r in self.known], float)
        ok = self.losses <= self.limits * np.where(self.benign, max(0.0, min(1.0, loop.benign_scale)), 1.0)
        self._put(pd.DataFrame({"learner": names[ok.any(axis=0)], "n": ok.sum(axis=0)[ok.any(axis=0)]}), "accepts", "learner string, n long")
        both = ok.astype(np.float32).T @ ok.astype(np.float32) if len(rows) < 2**24 else ok.astype(float).T @ ok.astype(float)
        a, b = np.nonzero(np.triu(both, 1))
        self._put(pd.DataFrame({"learner_a": names[a], "learner_b": names[b], "both": both[a, b].astype(np.int64)}), "pairs", "learner_a string, "
            "learner_b string, both long")
        self.to = self._routed(ok)
        mine = rows.assign(learner=np.append(names, _UNKNOWN)[self.to])
        self._put(mine[["row_index", "learner"]].assign(phase="stream"), "assignments", "row_index long, learner string, phase string")
        detected = time.perf_counter()

        columns = list(rows.columns)
        buffer = self._fifo(self._both(held["buffer"], mine.loc[self.to < 0, columns]))
        self.log = dict.fromkeys(("checked", "passed", "rejected", "reinjected", "dropped", "destroyed", "retrained"), 0)
        self.next_id = held["next_id"]
        assigned = mine[self.to >= 0]
        labels = [assigned.groupby(["learner", "label"], dropna=False, sort=False).size().rename("n").reset_index()]
        buffer, made, clustered = self._cluster(buffer, self.known)
        created_rows = [made] if made is not None else []
        to_fit = [self._large(x) for x in created_rows]
        gone: list[str] = []
        known = self.known
        if loop.small_rows:
            small = self._small(assigned, created_rows)
            names = [r["learner"] for r in self.known] + [name for x in to_fit for name in x["learner"].unique()]
            gone = self._too_small(names, labels, created_rows)
            self.log["destroyed"] = len(gone)
            if gone:
                back = small["learner"].isin(gone)
                buffer = self._fifo(self._both(buffer, small.loc[back, columns]), more=True)
                known = [r for r in known if r["learner"] not in gone]
                to_fit = [x[~x["learner"].isin(gone)] for x in to_fit]  # what is put back at once needs no model
                small = small[~back]
                buffer, again, more = self._cluster(buffer, known)
                clustered += more
                if again is not None:
                    created_rows.append(again)
                    small = self._both(small, again[small.columns])
                    to_fit.append(self._large(again))
            held["small"] = small
            self._put(small, "small", self._shape(["learner", *columns]))
            self._put(pd.DataFrame({"learner": gone}), "destroyed", "learner string")
        fitting = time.perf_counter()
        born = self._born(pd.concat(to_fit, ignore_index=True)) if to_fit else []
        created = time.perf_counter() - fitting
        creations = None
        if created_rows:
            creations = pd.concat([x.assign(_turn=k) for k, x in enumerate(created_rows)], ignore_index=True)
            labels.append(creations.groupby(["learner", "label"], dropna=False, sort=False).size().rename("n").reset_index())
            self._put(creations.assign(phase="creation"), "creations", "row_index long, learner string, phase string, _turn int")
        counted = pd.concat(labels, ignore_index=True)
        self._put(counted, "labels", _LABELS)
        for name, n in counted.groupby("learner")["n"].sum().items():
            held["totals"][name] = held["totals"].get(name, 0) + int(n)
        learners = [*known, *born]
        trained = time.perf_counter()
        if loop.gate is not None:
            learners = self._increment(assigned, gone, learners, creations)
        self._put(pd.DataFrame(learners, columns=[f.split()[0] for f in REGISTRY.split(", ")]), "learners", REGISTRY)
        self._put(buffer, "buffer", self.schema)
        now = time.perf_counter()
        line = (span[0], span[1] + 1, span[2], len(learners), len(buffer), self.next_id, *self.log.values(), detected - self.began, clustered, created,
            now - trained, now - self.began)
        self._put(pd.DataFrame([line], columns=StructType.fromDDL(LOG).fieldNames()), "log", LOG)
        held |= {"number": number, "learners": learners, "buffer": buffer, "next_id": self.next_id}
        loop._held = held

    @staticmethod
    def _both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([x for x in (a, b) if len(x)], ignore_index=True) if len(a) or len(b) else a

    def _scored(self) -> tuple[pd.DataFrame, np.ndarray]:
        """The block's rows in the order of their index, and a column of losses for each known learner."""
        features, packed = self.loop.features, [bytes(r["params"]) for r in self.known]

        def score(batches):
            models = [pickle.loads(raw) for raw in packed]
            for pdf in batches:
                x = matrix(pdf, features)
                found = np.stack([model.loss((x - mean) / std) for mean, std, model in models], axis=1) if models else np.empty((len(x), 0))
                yield pdf.assign(_losses=list(found))

        spread = self.rows.repartition(self.spark.sparkContext.defaultParallelism)
        shape = StructType([*self.schema.fields]).add("_losses", ArrayType(DoubleType()))
        table = spread.mapInPandas(score, shape).toArrow().sort_by("row_index")
        losses = table.column("_losses").combine_chunks()
        flat = losses.flatten().to_numpy(zero_copy_only=False) if len(table) else np.empty(0)
        return table.drop_columns("_losses").to_pandas(), flat.reshape(len(table), len(self.known))

    def _routed(self, ok: np.ndarray) -> np.ndarray:
        """Of each row the place of its learner: of those that accept, one that isn't benign, and of these the one of least loss, the smaller
        name if equal; -1 for none."""
        out = np.full(len(ok), -1)
        for side in (self.benign, ~self.benign):
            at = np.flatnonzero(side)
            if len(at):
                have = np.flatnonzero(ok[:, at].any(axis=1))
                out[have] = at[np.where(ok[np.ix_(have, at)], self.losses[np.ix_(have, at)], np.inf).argmin(axis=1)]
        return out

    def _fifo(self, buffer: pd.DataFrame, more: bool = False) -> pd.DataFrame:
        most = self.loop.most_buffer
        if not most or len(buffer) <= most:
            return buffer
        out = buffer["row_index"] < np.sort(buffer["row_index"].to_numpy())[len(buffer) - most]
        fallen = buffer[out].groupby("label", dropna=False).size().rename("n").reset_index()
        self._put(fallen, f"overflow{int(more)}", "label string, n long")
        return buffer[~out].reset_index(drop=True)

    def _classes(self, buffer: pd.DataFrame) -> np.ndarray:
        loop = self.loop
        found = P.new_classes(buffer, loop.features, loop.eps, loop.least, loop.least_class)
        if found is not None:
            return found
        from flowlens.operators.clusters import new_classes

        rows = self._spread(buffer, self.schema)  # too many near cells for one place
        of = new_classes(rows, "row_index", loop.features, loop.eps, loop.least, loop.least_class).toArrow().to_pandas()
        return buffer[["row_index"]].merge(of, on="row_index", how="left")["cluster"].fillna(-1).to_numpy(np.int64)

    def _cluster(self, buffer: pd.DataFrame, known: list[dict]):
        """The buffer without the rows of new classes, those rows with their learner, and seconds."""
        loop, log, began = self.loop, self.log, time.perf_counter()
        if loop.trigger is None or len(buffer) < loop.trigger:
            return buffer, None, time.perf_counter() - began
        cluster = self._classes(buffer)
        judged = dict.fromkeys(np.unique(cluster[cluster >= 0]).tolist(), True)
        if loop.purity is not None and judged:
            found = self._spread(buffer.assign(cluster=cluster)[cluster >= 0], StructType([*self.schema.fields]).add("cluster", "long"))
            scored = score_learners(found, "row_index", loop.features, known).withColumn("is_benign", F.contains(F.upper("learner"), F.lit("BENIGN")))
            verdicts = judge_clusters(found.select("row_index", "cluster", *loop.features), scored, loop.features, loop.purity, loop.benign_scale)
            rows = loop._put(verdicts, "verdicts", self.number).collect()  # a row for each class
            judged = {r["cluster"]: r["passed"] for r in rows}
            lost = sum(r["n"] for r in rows if not r["passed"])
            log["checked"] += len(rows)
            log["passed"] += sum(judged.values())
            log["rejected"] += len(rows) - sum(judged.values())
            log["reinjected" if loop.reinject else "dropped"] += lost
            if not loop.reinject and lost:
                out = np.isin(cluster, [c for c, passed in judged.items() if not passed])
                self._put(buffer[out].groupby("label", dropna=False).size().rename("n").reset_index(), "rejected", "label string, n long")
                buffer, cluster = buffer[~out].reset_index(drop=True), cluster[~out]
        numbers = {c: self.next_id + k for k, c in enumerate(sorted(c for c, passed in judged.items() if passed))}
        if not numbers:
            return buffer, None, time.perf_counter() - began
        new = np.isin(cluster, list(numbers))
        made = buffer[new].assign(learner=[f"NEW_{numbers[c]}" for c in cluster[new].tolist()]).reset_index(drop=True)
        self.next_id += len(numbers)
        return buffer[~new].reset_index(drop=True), made, time.perf_counter() - began

    def _large(self, made: pd.DataFrame) -> pd.DataFrame:
        """Rows of the classes that are large enough for a learner."""
        return made[made["learner"].map(made["learner"].value_counts()) >= self.loop.least_fit]

    def _born(self, made: pd.DataFrame) -> list[dict]:
        loop = self.loop
        if not len(made):
            return []
        rows = self._by_learner(made, self._of_learner())
        found = P.fit_learners(rows, loop.features, loop.backend, loop.most_rows, loop.quantile, loop.risk, loop.guard).collect()
        return [r.asDict() | {"birth": self.number, "last_trained": self.span[1], "retrains": 0} for r in found]

    # learners that stay small

    def _small(self, assigned: pd.DataFrame, created: list[pd.DataFrame]) -> pd.DataFrame:
        """Rows of new learners that have had up to small_rows rows so far."""
        small, most = self.held["small"], self.loop.small_rows
        for x in (assigned[assigned["learner"].str.startswith("NEW_")], *created):
            small = self._both(small, x[small.columns])
        small = small[~small["learner"].isin([name for name, n in self.held["totals"].items() if n >= most])]
        return small[small["learner"].map(small["learner"].value_counts()) < most].reset_index(drop=True)

    def _too_small(self, names: list[str], labels: list[pd.DataFrame], created: list[pd.DataFrame]) -> list[str]:
        n = dict(self.held["totals"])
        for name, k in [*labels[0].groupby("learner")["n"].sum().items(), *(p for x in created for p in x["learner"].value_counts().items())]:
            n[name] = n.get(name, 0) + int(k)
        found = sorted(x for x in set(names) if x.startswith("NEW_") and 0 < n.get(x, 0) < self.loop.small_rows)
        return found if len(found) > self.loop.small_trigger else []

    # increments

    def _increment(self, assigned: pd.DataFrame, gone: list[str], learners: list[dict], creations: pd.DataFrame | None) -> list[dict]:
        """The registry after learners have been trained on rows of this block; writes the trace, the losses and the pools."""
        loop, gate, held, number = self.loop, self.loop.gate, self.held, self.number
        features = loop.features
        known = {r["learner"]: r for r in self.known if r["learner"] not in gone}
        place = {r["learner"]: k for k, r in enumerate(self.known)}
        anchor = next((x for x in known if _is_benign(x)), None)
        at = np.flatnonzero(self.to >= 0)
        rows = assigned.assign(loss=self.losses[at, self.to[at]]).reset_index(drop=True)
        stays = rows["learner"].isin(list(known)).to_numpy()
        rows, at = rows[stays].reset_index(drop=True), at[stays]
        scaled = self.limits * np.where(self.benign, loop.benign_scale, 1.0)
        rows["_over"] = rows["loss"].to_numpy() > scaled[self.to[at]]
        benign = [place[x] for x in known if _is_benign(x)]
        rows["passed"], rows["_prob"] = True, np.nan
        if benign:
            margin = (scaled[benign] - self.losses[np.ix_(at, benign)]) / (np.abs(scaled[benign]) + 1e-12)
            rows["_prob"] = (1 / (1 + np.exp(-4 * margin))).max(axis=1) if len(at) else np.empty(0)
            if gate.benign_confidence is not None:
                sure = self.losses[at, place[anchor]] <= scaled[place[anchor]] * gate.benign_confidence
                rows["passed"] = ~self.benign[self.to[at]] | sure
        batches = {}
        for name, part in rows.groupby("learner"):
            passed = part[part["passed"]]
            r = known[name]
            mean = lambda c, passed=passed: float(passed[c].mean()) if passed[c].notna().any() else None
            batches[name] = {"learner": name, "is_benign": _is_benign(name), "kept": len(passed), "latest": int(part["row_index"].max()), "exceed": mean("_over"),
                "benign_prob": mean("_prob"), "birth_window": r["birth"], "last_trained": r["last_trained"], "retrains": r["retrains"], "window_id": number}
        reasons = {name: P.batch_reason(gate, b) for name, b in batches.items()}
        open_ = [name for name, reason in reasons.items() if reason is None]
        ready = rows[rows["passed"] & rows["learner"].isin(open_)]
        guard_out = np.zeros(len(rows), bool)
        new_guards = {}
        if loop.guard is not None:
            guard_out, new_guards = self._guarded(rows, ready, known)
        free = ready[~guard_out[ready.index]]
        left = free["learner"].value_counts()
        least = gate.least_rows if loop.guard is not None else 1
        few = {x for x in open_ if left.get(x, 0) < least}
        able_ = free[~free["learner"].isin(few)]
        chosen = [part.index.to_numpy()[P.subsample(part["loss"].to_numpy(), part["row_index"].to_numpy(), loop.most_new, loop.low_share, loop.stratified)]
            for _, part in able_.groupby("learner")]
        chosen = rows.loc[np.concatenate(chosen) if chosen else []]
        pools = self._pools(known)
        old = []
        if loop.history_rows:
            for _, part in pools[pools["learner"].isin(chosen["learner"].unique())].groupby("learner"):
                k = min(loop.history_rows, max(1, int(np.floor(len(part) * loop.history_rate))))
                old.append(part.iloc[P.spread_by_loss(part["loss"].to_numpy(), part["row_index"].to_numpy(), k)].assign(is_new=False))
        figures = "learner string, threshold double, rows long, " + ", ".join(f"{s}_loss_{w} double" for s in ("before", "after") for w in ("mean", "median", "p95"))
        grown, lines = {}, []
        if len(chosen):
            shape = self._of_learner().add("is_new", "boolean")
            update = self._by_learner(pd.concat([chosen.assign(is_new=True), *old], ignore_index=True), shape)
            lines = [r.asDict() for r in I.grow(update, features, self.known, loop.epochs, loop.quantile, loop.risk, loop.anchor_share).collect()]
            grown = {r["learner"]: r for r in lines}
        figures = StructType.fromDDL(figures).add("window_id", "long")
        self._put(pd.DataFrame([r | {"window_id": number} for r in lines], columns=figures.fieldNames()), "increments", figures)
        self.log["retrained"] = len(grown)

        # why each accepted row does or doesn't train
        name, used = rows["learner"], rows.index.isin(chosen.index)
        why = np.select([name.map(reasons).notna(), ~rows["passed"], name.isin(few), guard_out, ~used], [name.map(reasons).fillna(""), "benign_conf_filter",
            I.GUARD_LEFT_FEW, I.GUARD_FILTERED, I.SUBSAMPLED], "") if len(rows) else []
        self._put(rows.assign(window_left=self.span[0], window_right=self.span[1] + 1, used=used, reason=why), "trace", "learner string, row_index long, "
            "label string, window_left long, window_right long, passed boolean, used boolean, reason string")

        # pools take what passed, with the losses of the models of this block's start
        both = self._both(pools, rows.loc[rows["passed"], list(pools.columns)])
        capped = [part.iloc[P.spread_by_loss(part["loss"].to_numpy(), part["row_index"].to_numpy(), loop.pool_rows)] for _, part in both.groupby("learner")]
        pool = pd.concat(capped, ignore_index=True) if capped else pools
        if creations is not None:
            pool = self._both(pool, creations[["learner", "row_index", *features]].assign(loss=np.nan))
        pool.loc[pool["learner"].isin(list(grown)), "loss"] = np.nan  # its model changes
        held["pools"] = pool
        self._put(pool, "pools", self._of_learner())
        out = []
        for r in learners:
            g, made = grown.get(r["learner"]), new_guards.get(r["learner"])
            if g:
                r = r | {"threshold": g["threshold"], "params": g["params"], "last_trained": batches[r["learner"]]["latest"], "retrains": r["retrains"] + 1}
            if made and r["guard"] is None:
                r = r | {c: made[c] for c in ("seed_count", "cutoff", "guard")}
            out.append(r)
        return out

    def _pools(self, known: dict) -> pd.DataFrame:
        """Pools of the known learners with the losses of their models; losses are worked out anew where the model has changed."""
        pools, loop = self.held["pools"], self.loop
        pools = pools[pools["learner"].isin(list(known))].reset_index(drop=True)
        if "loss" not in pools:
            pools["loss"] = np.nan
        lack = pools["loss"].isna()
        for name, part in pools[lack].groupby("learner"):
            mean, std, model = pickle.loads(bytes(known[name]["params"]))
            pools.loc[part.index, "loss"] = model.loss((matrix(part, loop.features) - mean) / std)
        return pools[["learner", "row_index", *loop.features, "loss"]]

    def _guarded(self, rows: pd.DataFrame, ready: pd.DataFrame, known: dict) -> tuple[np.ndarray, dict]:
        """Of each row whether a guard keeps it out, and the guards that were made. A learner without a guard gets one from its pool."""
        loop, out = self.loop, np.zeros(len(rows), bool)
        asked = ready[ready["learner"].str.startswith("NEW_")] if loop.guard.new_only else ready
        n = asked["learner"].value_counts()
        large = list(n.index[n >= loop.guard.rows])
        able_ = asked[asked["learner"].isin(large)]
        if not len(able_):
            return out, {}
        lack = [x for x in large if known[x]["guard"] is None]
        made = {}
        if lack:
            pool = self.held["pools"]
            seen = self._by_learner(pool[pool["learner"].isin(lack)], self._of_learner())
            made = {r["learner"]: r.asDict() for r in I.fit_guards(seen, loop.features, loop.guard).collect()}
        guards = [{"learner": x, "cutoff": r["cutoff"], "guard": r["guard"]} for x in large for r in (made.get(x) or known[x],) if r["guard"] is not None]
        judged = I.guarded(self._spread(able_, self._of_learner()), loop.features, guards).toArrow().to_pandas()
        kept = rows[["row_index"]].merge(judged[["row_index", "guard_keep"]], on="row_index", how="left")["guard_keep"]
        return (kept == False).to_numpy(), made  # noqa: E712
