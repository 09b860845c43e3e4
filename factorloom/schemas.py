"""Column layouts of the engine's tables, as DDL. All numbers are doubles; a missing number is null, never NaN."""

SURFACE = "date date, expiry string, tenor string, vol double"
VEGA = "expiry string, tenor string, vega double"
GRID = "expiry string, tenor string, e_idx int, t_idx int, bucket int, e_years double, t_years double"
MOVES = "t long, date date, bucket int, x double, dvol double, prev double"
MOVE_VECTORS = "t long, date date, x array<double>, dvol array<double>, prev array<double>"
SPECS = "name string, family string, transform string, n_components int, covariance_method string, shrinkage_alpha double, factor_rank int, vega_weight_power double, weight_min double, weight_max double, r_expiry int, r_tenor int"
PREDICTIONS = "model string, window int, fold int, transform string, family string, t long, date date, train_start date, train_end date, full_pnl double, projected_pnl double, error double, failure string"
MODEL = "model string, window int, fold int, mean array<double>, weights array<double>, components array<array<double>>, eigenvalues array<double>"
BASIS = "o int, r int, w double"
CONSTRAINTS = "c int, r int, a double"
