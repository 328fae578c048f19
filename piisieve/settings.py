"""Run settings shared by operators and queries."""

# ---- fixed values: run settings of the original solution, kept so that results match it ----
# confident-outside cut applied to occurrences before the mean (strict <)
CUT_TOKEN_MODEL = 0.995
# outside threshold applied to the mean (inclusive <=)
THRESHOLD_SPAN_MODELS = 0.9
# windows: pieces per window (special pieces included) and pieces shared by neighbours
MAX_LENGTH = 1024
STRIDE = 256
STRIDE_SPAN_MODELS = 128
# batching: windows per batch, padded length rounded up to a multiple of
BATCH_SIZE = 4
PAD_MULTIPLE = 16
# early stopping: evaluations without improvement
PATIENCE = 10
# splits: position mod 5, document mod 4, random 25 % with seed 42, external fold id 99
POSITION_FOLDS = 5
KEY_FOLDS = 4
RANDOM_VALID_FRACTION = 0.25
RANDOM_SEED = 42
EXTERNAL_FOLD = 99
# prefix sample of the external sets
EXTERNAL_SAMPLING_RATE = 0.15
# ---- end of fixed values ----
