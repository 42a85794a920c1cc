"""Profiling and cleaning of messy tables of any schema, as Spark DataFrame operators."""

from scrubline.operators.currency import convert_currency_by_column
from scrubline.operators.detect import (
    detect_boolean, detect_categorical, detect_currency_pairs, detect_date_columns, detect_email,
    detect_gender, detect_gpa, detect_multi_currency, detect_numeric_text, detect_year_of_study,
)
from scrubline.columns import drop_id_like
from scrubline.operators.forest import flag_outliers_isolation_forest
from scrubline.operators.fuzzy import fuzzy_standardize, similar_pairs
from scrubline.operators.impute import (
    impute_knn, impute_median, impute_mode, round_integer_like,
)
from scrubline.operators.mapping import (
    apply_value_mapping, distinct_value_batches, run_mapping, standardize_with_mapper,
    suggest_missing,
)
from scrubline.operators.profile import (
    profile_dataset, profile_duplicates, profile_missing, profile_outliers,
)
from scrubline.operators.report import cleaning_report
from scrubline.operators.rules import (
    cap_outliers_iqr, remove_exact_duplicates, run_rule_cleaning,
)
from scrubline.operators.text import (
    Conversions, detect_name_columns, normalize_text, standardize_casing, standardize_category_casing, standardize_missing,
    standardize_name_casing, trim_whitespace,
)
from scrubline.operators.typed import (
    cast_columns, clean_email, clean_numeric_text, enforce_domain_bounds, run_type_cleaning,
    standardize_boolean, standardize_dates, standardize_dates_auto, standardize_gender,
    standardize_gpa, standardize_year_of_study,
)
from scrubline.plans.pipeline import (
    CleaningConfig, CleaningPlan, CleaningResult, clean, run_ml_cleaning,
)
from scrubline.plans.store import load_plan, save_plan
from scrubline.sources.csv import read_csv
from scrubline.sources.tables import (
    JdbcPartitioning, load, load_files, preview, read_jdbc, union_with_source, write_clean,
)

__all__ = [name for name in dir() if not name.startswith("_")]
