"""The facade: one object with the verbs of the engine, every result a lazy DataFrame, plans of named steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.operators import audits, change, clean, outliers, profile, quality, statistics
from cairn.sources import readers, sql

# The steps of each goal.
GOALS: dict[str, list[str]] = {
    "inspect": ["profile", "missing", "duplicates", "quality"], "clean": ["deduplicate", "fill", "profile"], "analyze": ["profile", "descriptive", "correlations", "outliers"],
    "prepare": ["deduplicate", "fill", "readiness"], "audit": ["quality", "contracts", "imbalance", "fingerprint"],
}


class Engine:
    """Verbs over tables. ``plugins`` are functions of a DataFrame that plans may name."""

    def __init__(self, spark: SparkSession):
        self.spark, self.plugins, self.log = spark, {}, []
        self.steps: dict[str, Callable[[DataFrame], DataFrame]] = {
            "profile": profile.full_profile, "quick_profile": profile.quick_profile, "missing": profile.missing_values, "duplicates": profile.duplicate_rows, "quality": quality.completeness, "readiness": quality.readiness,
            "descriptive": lambda d: profile.descriptive(d, profile.numeric_columns(d.schema)), "contracts": clean.contracts, "deduplicate": clean.remove_duplicates, "fill": lambda d: clean.handle_missing(d, "mean"),
            "correlations": self._correlations, "outliers": lambda d: outliers.density(d, profile.numeric_columns(d.schema)), "fingerprint": quality.fingerprint, "imbalance": self._imbalance, "rules": clean.infer_rules,
        }

    @staticmethod
    def _correlations(df: DataFrame) -> DataFrame:
        from cairn.operators.association import pearson_pairs

        return pearson_pairs(df, profile.numeric_columns(df.schema))

    @staticmethod
    def _imbalance(df: DataFrame) -> DataFrame:
        best = quality.target_candidates(df).orderBy(F.desc("score"), "column_name").first()["column_name"]
        return quality.imbalance(df, best)

    def load(self, path: str, **options) -> DataFrame:
        return readers.load(self.spark, path, **options)

    def sql(self, query: str, limit: int | None = None) -> DataFrame:
        return sql.run(self.spark, query, limit)

    def register(self, name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
        self.plugins[name] = fn

    def step(self, name: str, df: DataFrame) -> DataFrame:
        fn = self.plugins.get(name) or self.steps.get(name)
        if fn is None:
            raise ValueError(f"unknown step {name!r}")
        self.log.append(name)
        return fn(df)

    def run(self, goal: str | list[str], df: DataFrame) -> dict[str, DataFrame]:
        """The results of a goal's steps; cleaning steps hand their table on, a failing step doesn't stop the others."""
        names = goal if isinstance(goal, list) else GOALS.get(goal)
        if names is None:
            raise ValueError(f"unknown goal {goal!r}")
        out, errors, cur = {}, {}, df
        for n in names:
            try:
                res = self.step(n, cur)
            except Exception as e:  # noqa: BLE001  one step's failure is a result too
                errors[n] = str(e)
                continue
            if n in ("deduplicate", "fill"):
                cur = res
            out[n] = res
        if errors:
            out["errors"] = self.spark.createDataFrame(list(errors.items()), "step string, error string")
        return out

    def compare(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """What changed from a to b: schema, numbers, categories and gaps, a row per changed column."""
        return change.table_changes(a, b)

    def audit_leakage(self, train: DataFrame, test: DataFrame | None, target: str, **options) -> dict[str, DataFrame]:
        found = audits.leakage(train, test, target, **options)
        return {"findings": found, "score": audits.leakage_score(found)}

    def audit_labels(self, df: DataFrame, label: str, features: list[str], **options) -> dict[str, DataFrame]:
        dims = audits.label_quality(df, label, features, **options)
        return {"dimensions": dims, "score": audits.overall(dims)}

    def audit_bias(self, df: DataFrame, groups: list[str], label, **options) -> dict[str, DataFrame]:
        found = audits.bias(df, groups, label, **options)
        return {"findings": found, "score": audits.bias_score(found)}

    def audit_training(self, train: DataFrame, test: DataFrame | None, target: str, groups: list[str], positive) -> dict[str, DataFrame]:
        """Labels, leakage and bias of a training table, one after the other; a part that fails doesn't stop the others."""
        features = [c for c in train.columns if c != target and c not in groups]
        parts = {"labels": lambda: self.audit_labels(train, target, features), "leakage": lambda: self.audit_leakage(train, test, target), "bias": lambda: self.audit_bias(train, groups, positive)}
        out, errors = {}, {}
        for name, part in parts.items():
            try:
                out |= {f"{name}_{k}": v for k, v in part().items()}
            except Exception as e:  # noqa: BLE001
                errors[name] = str(e)
        if errors:
            out["errors"] = self.spark.createDataFrame(list(errors.items()), "part string, error string")
        return out

    def find_outliers(self, df: DataFrame, key: str, names: list[str], share: float = 0.5) -> DataFrame:
        """Rows on which at least ``share`` of the detectors agree."""
        return outliers.consensus(df, key, names, share)

    def compare_groups(self, df: DataFrame, group: str, names: list[str]) -> DataFrame:
        """The fitting test of each column between groups."""
        out = None
        for c in names:
            row = statistics.compare_groups(df, group, c).select(F.lit(c).alias("column_name"), "*")
            out = row if out is None else out.union(row)
        return out
