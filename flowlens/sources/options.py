"""The options of a run: five sections of named values with defaults, read from YAML or a mapping, checked, copied and written back."""

from __future__ import annotations

import copy

from pyspark.sql import SparkSession

from flowlens.operators.increments import Guard
from flowlens.operators.lifecycle import Gate
from flowlens.operators.purity import PurityGate

from .run_store import load_config
from .sinks import write_text

#: What must be given, and the defaults of the rest, by section.
REQUIRED: dict[str, list[str]] = {
    "paths": ["data_dir", "output_dir"],
    "runtime": ["cpu_only", "max_rows", "seed"],
    "stream": ["init_known_mode", "init_ratio", "window_size"],
    "tsieve": ["batch_size", "increment_epochs", "increment_min_samples", "init_epochs", "lr", "max_increment_samples", "max_train_per_class",
        "min_class_samples", "new_class_epochs"],
    "tmagnifier": ["cluster_trigger_size", "dbscan_eps", "dbscan_min_samples", "max_unknown_buffer", "new_class_min_size"],
    "tscissors": [],
}
DEFAULTS: dict[str, dict[str, object]] = {
    "paths": {"input_files": None},
    "runtime": {
        "attack_sample_per_type": 0, "attack_type_exclude": None, "attack_type_include": None, "benign_accept_scale": 1.0,
            "benign_sample_max_rows": 0, "feature_profile": "all_numeric_no_env",
        "freeze_benign_incremental": False, "missing_value_strategy_enabled": True, "pca_n_components": 0, "performance_benchmark": False,
            "prefer_non_benign_first": True, "protocol_include": None,
        "risk_soft_k": 4.0, "uniform_learner_treatment": False, "year_benign_exclude": None, "year_include": None,
    },
    "stream": {"init_benign_count": 0, "init_benign_year": ""},
    "tsieve": {
        "benign_history_confidence_scale": 0.6, "classifier_backend": "ae", "historical_sample_rate": 0.5, "history_pool_compress_enabled": True,
            "history_samples_per_update": 2000, "history_time_decay_lambda": 0.0,
        "increment_drift_gate_enabled": False, "increment_drift_min_history_samples": 500, "increment_drift_min_score": 0.12,
            "increment_gate_enabled": False, "increment_gate_max_own_exceed_rate": 0.9,
        "increment_gate_min_benign_prob_mean": 0.02, "increment_iforest_guard_apply_to_new_only": True, "increment_iforest_guard_enabled": False,
            "increment_iforest_guard_keep_quantile": 0.9,
        "increment_iforest_guard_min_samples": 300, "increment_iforest_guard_n_estimators": 200, "increment_iforest_guard_train_max_samples": 5000,
            "increment_low_loss_quantile_keep": 1.0,
        "increment_route_gate_enabled": False, "increment_route_min_confident_ratio": 0.55, "increment_route_min_samples": 300,
            "increment_sampling_mode": "random", "increment_use_last_train_gap": False,
        "max_history_samples_per_learner": 10000, "max_retrain_per_learner": 0, "new_learner_cooldown_windows": 0,
            "small_learner_recluster_count_trigger": 10, "small_learner_recluster_enabled": True,
        "small_learner_sample_threshold": 1000, "threshold_refresh_new_ratio": 0.2, "threshold_refresh_use_anchor": False,
    },
    "tmagnifier": {
        "cluster_gate_max_benign_accept_rate": 1.0, "cluster_gate_max_benign_prob_mean": 1.0, "cluster_gate_max_benign_prob_p90": 1.0,
            "cluster_gate_mixed_check_enabled": False, "cluster_gate_mixed_prob_high": 0.8,
        "cluster_gate_mixed_prob_low": 0.2, "cluster_gate_rejected_action": "reinject_unknown", "cluster_gate_route_consistency_enabled": False,
            "cluster_gate_route_max_top1_share": 0.7,
        "cluster_gate_route_min_multi_accept_ratio": 0.3, "cluster_gate_route_min_samples": 500, "cluster_gate_soft_k": 4.0,
            "cluster_gate_structure_check_enabled": False,
        "cluster_gate_structure_min_child_ratio": 0.2, "cluster_gate_structure_min_samples": 600, "cluster_gate_structure_min_silhouette": 0.18,
            "cluster_gate_structure_min_split_gain": 0.45, "cluster_purity_gate_enabled": False,
    },
    "tscissors": {"evt_quantile": 0.95, "evt_risk": 1e-3, "fallback_quantile": 0.995},
}
#: Options that take one of a few names.
CHOICES = {
    ("runtime", "feature_profile"): ["all_numeric_no_env", "stable_stats_no_env", "compact_stats_no_env"], ("stream",
        "init_known_mode"): ["benign_only", "all_labels"], ("tsieve", "classifier_backend"): ["ae", "iforest"],
    ("tsieve", "increment_sampling_mode"): ["random", "stratified_loss"], ("tmagnifier", "cluster_gate_rejected_action"): ["reinject_unknown", "drop"],
}


class Options:
    """Values by section and name. Names without a default are kept as they are given; a wrong kind or choice, or a value that must be
    given and isn't, is a ValueError that names all of them."""

    def __init__(self, given: dict | str):
        found = load_config(given) if isinstance(given, str) else copy.deepcopy(given)
        wrong: list[str] = []
        self.values: dict[str, dict[str, object]] = {}
        for section in {**DEFAULTS, **found}:
            own = found.get(section) or {}
            if not isinstance(own, dict):
                self.values[section] = own
                if section in DEFAULTS:
                    wrong.append(f"{section} is no mapping")
                continue
            wrong += [f"{section}.{name} is missing" for name in REQUIRED.get(section, []) if name not in own]
            for name, default in DEFAULTS.get(section, {}).items():
                value = own.get(name, default)
                if (section, name) in CHOICES:
                    if value not in CHOICES[section, name]:
                        wrong.append(f"{section}.{name} is {value!r}, not one of {CHOICES[section, name]}")
                elif isinstance(default, bool) and not isinstance(value, bool) or isinstance(default, (int, float)) and not isinstance(default,
                    bool) and (isinstance(value, bool) or not isinstance(value, (int, float))):
                    wrong.append(f"{section}.{name} is {value!r}, not a {type(default).__name__}")
            self.values[section] = copy.deepcopy({**DEFAULTS.get(section, {}), **own})
        if wrong:
            raise ValueError("; ".join(wrong))

    def get(self, section: str, name: str) -> object:
        """A copy, so that nobody changes the options by their value."""
        return copy.deepcopy(self.values[section][name])

    def changed(self, **sections: dict) -> Options:
        """New options with some values replaced; these stay as they are."""
        both = copy.deepcopy(self.values)
        for section, values in sections.items():
            both.setdefault(section, {}).update(copy.deepcopy(values))
        return Options(both)

    def text(self) -> str:
        import yaml

        return yaml.safe_dump(self.values, sort_keys=True, allow_unicode=True)

    def snapshot(self, spark: SparkSession, path: str) -> None:
        """Writes the options, defaults included, as YAML text."""
        write_text(spark, self.text().splitlines(), path)

    # what the engine's parts take

    def gate(self) -> Gate:
        t, free = self.values["tsieve"], self.values["runtime"]["uniform_learner_treatment"]
        asked = t["increment_gate_enabled"]
        return Gate(
            benign_confidence=None if free else t["benign_history_confidence_scale"],
                freeze_benign=not free and self.values["runtime"]["freeze_benign_incremental"], cooldown_windows=t["new_learner_cooldown_windows"],
            least_rows=t["increment_min_samples"], by_gap=t["increment_use_last_train_gap"], most_retrains=t["max_retrain_per_learner"],
                least_drift=t["increment_drift_min_score"] if t["increment_drift_gate_enabled"] else None,
            least_benign_prob=t["increment_gate_min_benign_prob_mean"] if asked else None,
                most_exceed=t["increment_gate_max_own_exceed_rate"] if asked else None,
            route_rows=t["increment_route_min_samples"] if t["increment_route_gate_enabled"] else None,
                route_confident=t["increment_route_min_confident_ratio"],
        )

    def guard(self) -> Guard | None:
        t = self.values["tsieve"]
        if not t["increment_iforest_guard_enabled"]:
            return None
        return Guard(t["increment_iforest_guard_min_samples"], t["increment_iforest_guard_keep_quantile"],
            t["increment_iforest_guard_train_max_samples"], t["increment_iforest_guard_n_estimators"], t["increment_iforest_guard_apply_to_new_only"])

    def purity(self) -> PurityGate | None:
        t = self.values["tmagnifier"]
        if not t["cluster_purity_gate_enabled"]:
            return None
        g = lambda name: t[f"cluster_gate_{name}"]
        return PurityGate(
            g("max_benign_accept_rate"), g("max_benign_prob_mean"), g("max_benign_prob_p90"), g("soft_k"), g("mixed_check_enabled"),
                g("mixed_prob_low"), g("mixed_prob_high"), g("structure_check_enabled"), g("structure_min_samples"),
            g("structure_min_child_ratio"), g("structure_min_silhouette"), g("structure_min_split_gain"), 10, g("route_consistency_enabled"),
                g("route_min_samples"), g("route_min_multi_accept_ratio"), g("route_max_top1_share"),
        )

    def open_set(self) -> dict[str, object]:
        """The arguments of streaming.open_set.OpenSet besides session, folder and features."""
        t, m, c, r = self.values["tsieve"], self.values["tmagnifier"], self.values["tscissors"], self.values["runtime"]
        return {
            "backend": t["classifier_backend"], "trigger": m["cluster_trigger_size"], "most_buffer": m["max_unknown_buffer"],
                "most_rows": t["max_train_per_class"], "least_fit": t["min_class_samples"], "eps": m["dbscan_eps"],
            "least": m["dbscan_min_samples"], "least_class": m["new_class_min_size"], "benign_scale": r["benign_accept_scale"],
                "quantile": c["evt_quantile"], "risk": c["evt_risk"], "purity": self.purity(),
            "reinject": m["cluster_gate_rejected_action"] == "reinject_unknown",
                "small_rows": t["small_learner_sample_threshold"] if t["small_learner_recluster_enabled"] else 0,
            "small_trigger": t["small_learner_recluster_count_trigger"], "gate": self.gate(), "guard": self.guard(),
                "most_new": t["max_increment_samples"], "low_share": t["increment_low_loss_quantile_keep"],
            "stratified": t["increment_sampling_mode"] == "stratified_loss",
                "pool_rows": t["max_history_samples_per_learner"] if t["history_pool_compress_enabled"] else 1 << 40,
                    "history_rate": t["historical_sample_rate"],
            "history_rows": t["history_samples_per_update"], "decay": t["history_time_decay_lambda"], "epochs": t["increment_epochs"],
            "anchor_share": t["threshold_refresh_new_ratio"] if t["threshold_refresh_use_anchor"] else None,
                "drift_rows": t["increment_drift_min_history_samples"],
        }
