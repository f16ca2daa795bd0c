from nutriyield.functions.semantics import (
    cols_between, comma_format, drop_na_rows, first_by, in_levels, level_rank,
    mean_na_rm, median_na_rm, n_distinct_r, numeric_cols, paste, r_ifelse, safe_div, sig,
    snap_doubles, str_remove_first, str_replace_first, str_to_title, strict_mean,
    strict_sum, sum_na_rm,
)

__all__ = [
    "cols_between", "comma_format", "drop_na_rows", "first_by", "in_levels", "level_rank",
    "mean_na_rm", "median_na_rm", "n_distinct_r", "numeric_cols", "paste", "r_ifelse", "safe_div", "sig",
    "snap_doubles", "str_remove_first", "str_replace_first", "str_to_title", "strict_mean",
    "strict_sum", "sum_na_rm",
]
