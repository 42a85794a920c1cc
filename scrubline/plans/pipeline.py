"""The whole cleaning job: profile, rules, learned steps, mapping, report.

Each layer is fitted by a few aggregations over the table and applied as column expressions and
joins. What was fitted is kept in a ``CleaningPlan`` that can be applied to new data.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.columns import agg_row, col, nan_to_null, present
from scrubline.functions import vocab
from scrubline.operators.detect import detect_categorical
from scrubline.operators.forest import ForestFit, apply_forest, fit_and_flag
from scrubline.operators.fuzzy import apply_fuzzy, fit_fuzzy
from scrubline.operators.impute import (
    NumericFit, apply_modes, apply_numeric_fill, fit_knn, fit_median, fit_modes,
)
from scrubline.operators.mapping import BATCH, Mapper, run_mapping
from scrubline.operators.profile import Profile, profile_aggregates, profile_dataset
from scrubline.operators.report import cleaning_report
from scrubline.operators.rules import RuleFit, apply_rules, fit_normalized
from scrubline.operators.text import Conversions, normalize_text
from scrubline.storage import Scratch, write_table


@dataclass(frozen=True)
class CleaningConfig:
    date_columns: tuple[str, ...] = ()
    type_map: dict[str, str] = field(default_factory=dict)
    convert_currency: bool = False
    # None: find the category columns; an empty tuple: no spelling merge at all.
    fuzzy_columns: tuple[str, ...] | None = None
    fuzzy_threshold: float = 85
    # What counts as a category column when they are found.
    max_unique: int = 200
    max_avg_length: int = 40
    fill_categorical_missing: bool = False
    neighbours: int = 5
    numeric_fill: str = "knn"  # or "median"
    exclude_ids_from_imputation: bool = False
    contamination: float = 0.02
    seed: int = 42
    mapper: Mapper | None = None
    # None: the same columns as the spelling merge.
    mapper_columns: tuple[str, ...] | None = None
    mapper_batch: int = BATCH


@dataclass
class LearnedFit:
    """The fitted learned layer."""

    fill: NumericFit
    forest: ForestFit | None
    category_columns: list[str]
    spellings: DataFrame | None
    modes: dict[str, str]
    still_missing: dict[str, int]


@dataclass
class CleaningPlan:
    """Everything that was learned from one table, to be repeated on others.

    Mapper answers are not part of it: they belong to the values seen.
    """

    rules: RuleFit
    learned: LearnedFit

    def apply(self, df: DataFrame) -> DataFrame:
        return apply_learned(apply_rules(df, self.rules), self.learned)


@dataclass
class CleaningResult:
    df: DataFrame
    before: Profile
    report: DataFrame
    plan: CleaningPlan
    messages: list[str]
    conversions: Conversions = field(default_factory=Conversions)
    scratch: Scratch = field(default_factory=Scratch)

    def release(self) -> None:
        """Delete the intermediate tables, once ``df`` is written and ``plan`` saved: both read them."""
        self.scratch.release(self.df.sparkSession)


def apply_learned(df: DataFrame, fit: LearnedFit) -> DataFrame:
    df = apply_forest(apply_numeric_fill(df, fit.fill), fit.forest)
    if fit.spellings is not None:
        df = apply_fuzzy(df, fit.spellings, fit.category_columns)
    return apply_modes(df, fit.modes)


def fit_learned(
    df: DataFrame,
    fuzzy_columns: Iterable[str] | None = None,
    auto_detect_fuzzy: bool = True,
    fill_categorical_missing: bool = False,
    config: CleaningConfig = CleaningConfig(),
) -> tuple[DataFrame, LearnedFit]:
    """Fill numeric gaps, flag outliers, merge spellings and, if asked, fill category gaps."""
    if config.numeric_fill == "median":
        fill = fit_median(df, exclude_ids=config.exclude_ids_from_imputation)
    elif config.numeric_fill == "knn":
        fill = fit_knn(df, k=config.neighbours, exclude_ids=config.exclude_ids_from_imputation)
    else:
        raise ValueError(f"numeric_fill is 'knn' or 'median', not {config.numeric_fill!r}")
    df = apply_numeric_fill(df, fill)
    if fill.donors is not None and fill.columns:
        df = write_table(df, "filled")  # the neighbour search is done once
    df, forest = fit_and_flag(df, contamination=config.contamination, seed=config.seed)

    columns = present(df, fuzzy_columns or ())
    if not columns and auto_detect_fuzzy:
        columns = detect_categorical(
            df, max_unique=config.max_unique, max_avg_length=config.max_avg_length
        )
    spellings = None
    if columns:
        spellings = fit_fuzzy(df, columns, config.fuzzy_threshold)
        df = apply_fuzzy(df, spellings, columns)
    modes: dict[str, str] = {}
    missing: dict[str, int] = {}
    if fill_categorical_missing:
        modes = fit_modes(df, columns or None)
        df = apply_modes(df, modes)
    elif columns:
        gaps = agg_row(df, {c: F.count_if(col(c).isNull()) for c in columns})
        missing = {c: n for c, n in gaps.items() if n}
    return df, LearnedFit(fill, forest, columns, spellings, modes, missing)


def run_ml_cleaning(
    df: DataFrame,
    fuzzy_columns: Iterable[str] | None = None,
    auto_detect_fuzzy: bool = True,
    fill_categorical_missing: bool = False,
) -> DataFrame:
    return fit_learned(df, fuzzy_columns, auto_detect_fuzzy, fill_categorical_missing)[0]


def clean(df: DataFrame, config: CleaningConfig = CleaningConfig()) -> CleaningResult:
    """Profile, clean and report on a table of any schema.

    What it stores on the way stays until ``release`` of the result.
    """
    with Scratch() as scratch:
        result = _clean(df, config)
    result.scratch = scratch
    return result


def _clean(df: DataFrame, config: CleaningConfig) -> CleaningResult:
    df = nan_to_null(df)
    # The first scan stores the normalised table and counts for the profile; the profile needs two more.
    normalized, conversions, seen = normalize_text(df, also=profile_aggregates(df))
    before = profile_dataset(df, seen=seen)
    ruled, rules = fit_normalized(
        normalized, conversions, config.date_columns, config.type_map, config.convert_currency)
    out, learned = fit_learned(
        ruled, config.fuzzy_columns, config.fuzzy_columns is None,
        config.fill_categorical_missing, config,
    )
    messages: list[str] = []
    if config.mapper is not None:
        columns = config.mapper_columns
        out, messages = run_mapping(
            out, learned.category_columns if columns is None else columns,
            config.mapper, config.mapper_batch,
        )
    return CleaningResult(
        out, before, cleaning_report(before, out), CleaningPlan(rules, learned), messages, conversions)
