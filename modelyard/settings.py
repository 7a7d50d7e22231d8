"""Default thresholds and budgets. Every function takes them as keyword arguments."""

# Task names.
TASKS = ("classification", "regression", "clustering", "dimensionality_reduction")

# Model status names.
STATUSES = ("created", "training", "active", "failed", "archived")

# Search.
CV_FOLDS = 5
N_TRIALS = 200
SEARCH_TIMEOUT_SECONDS = 3600
PATIENCE = 10
MIN_DELTA = 0.001

# Training.
TEST_SIZE = 0.2
RANDOM_STATE = 42
IMPROVEMENT_THRESHOLD = 0.01

# Monitoring.
DRIFT_P_VALUE = 0.05
JS_THRESHOLD = 0.1
JS_BINS = 30
PERFORMANCE_RATIO = 0.95
CHECK_INTERVAL_SECONDS = 3600
HISTORY_DAYS = 30
ALERT_COOLDOWN_SECONDS = 3600
MIN_DRIFT_ROWS = 1000
CURRENT_WINDOW_ROWS = 1000
REFERENCE_WINDOW_ROWS = 10000
HISTORY_ROWS = 1000
VERSIONS_KEPT = 5

# Scoring and storage.
CACHE_TTL_SECONDS = 3600
MAX_FILE_BYTES = 104857600
MAX_CATEGORIES = 20
K_BEST = 20
CONTAMINATION = 0.1

# Severity ranks.
SEVERITY_RANKS = {"critical": 1, "high": 2, "medium": 3, "low": 4}
